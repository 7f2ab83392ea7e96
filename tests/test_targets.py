"""Targets by what hosts tell, the checkpoint's gate and rereading exports."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import delta, discovery, projects, targets
from threadloom.sources import logs

KNOWN = [("/w/main", "/w/main/.git"), ("/w/tree", "/w/main/.git"), ("/w/other", "/w/other/.git")]
HOST = "request string, session_id string, directory string, worktree string, adapter string, native_id string, project_hint string, fingerprint string"


def known(spark):
    return spark.createDataFrame(KNOWN, "root string, common string")


def test_host_context(spark):
    rows = {
        "fine": ("ses_a", "/w/main/src/", "/w/main", "opencode", "ses_a", "/w/main//", None),
        "tree": ("ses_a", "/w/tree/x", "/w/main", "opencode", "ses_a", "/w/tree", None),
        "id": ("bad id", "/w/main", "/w/main", "opencode", "bad id", "/w/main", "malformed-host-context"),
        "no id": (None, "/w/main", "/w/main", "opencode", "ses_a", "/w/main", "malformed-host-context"),
        "source": ("ses_a", "/w/main", "/w/main", "codex", "ses_a", "/w/main", "host-source-mismatch"),
        "native": ("ses_a", "/w/main", "/w/main", "opencode", "ses_b", "/w/main", "host-source-mismatch"),
        "path": ("ses_a", "main", "/w/main", "opencode", "ses_a", "/w/main", "malformed-host-context"),
        "hint": ("ses_a", "/w/main", "/w/main", "opencode", "ses_a", None, "malformed-host-context"),
        "project": ("ses_a", "/w/other", "/w/main", "opencode", "ses_a", "/w/main", "host-project-mismatch"),
        "outside": ("ses_a", "/plain/a", "/plain/b", "opencode", "ses_a", "/plain/a", "host-project-mismatch"),
        "inside": ("ses_a", "/plain/b/a", "/plain/b", "opencode", "ses_a", "/plain/b/a", None),
        "prefix": ("ses_a", "/plain/bc", "/plain/b", "opencode", "ses_a", "/plain/bc", "host-project-mismatch"),
        "root": ("ses_a", "/plain/x", "/", "opencode", "ses_a", "/plain/x", None),
    }
    df = spark.createDataFrame([(k, *v[:6], "f") for k, v in rows.items()], HOST)
    got = {r["request"]: r for r in targets.host_context(df, known(spark)).collect()}
    assert {k: r["refusal"] for k, r in got.items()} == {k: v[6] for k, v in rows.items()}
    assert all((r["project_key"] is None) == (r["refusal"] is not None) == (r["fingerprint"] is None) for r in got.values())
    assert got["fine"]["project_key"] == got["tree"]["project_key"] != got["inside"]["project_key"]


def test_dispatch_and_documents(spark):
    session = lambda name, adapter, there=True, project="k": (f"{adapter}:s:{name}", project, adapter, name, there, "f")
    rows = [session("a", "codex"), session("b", "codex"), session("c", "codex", False), session("d", "codex", True, "one"), session("ses_a", "opencode"), session("ses_b", "opencode", False), session("ses_c", "opencode")]
    s = spark.createDataFrame(rows, "source_id string, project_key string, adapter string, native_id string, native_available boolean, fingerprint string").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    asked = {
        "1": ("codex", "k", "a", "host_id_match"), "2": ("codex", "k", "c", "host_id_unknown"), "3": ("codex", "k", None, "ambiguous_target"), "4": ("codex", "one", None, "unique_candidate"), "5": ("codex", "none", "a", "no_eligible_target"),
        "6": ("codex", "k", "b", "host_id_unknown"), "7": ("opencode", "k", None, "host_id_match"), "8": ("opencode", "k", None, "missing-host-context"), "9": ("opencode", "k", None, "host-source-mismatch"), "10": ("opencode", "k", None, "unavailable_target"),
        "11": ("opencode", "k", None, "selected_source"), "12": ("opencode", "one", None, "foreign_project"), "13": ("opencode", "k", None, "stale_index"), "14": ("grok", "k", None, "unsupported-harness"),
    }
    requests = spark.createDataFrame([(k, *v[:3]) for k, v in asked.items()], "request string, harness string, project_key string, current_native_id string")
    hosts = spark.createDataFrame([("7", "k", "ses_a", "f", None), ("9", None, None, None, "host-source-mismatch"), ("10", "k", "ses_b", "f", None), ("11", "k", "ses_c", "f", None), ("12", "k", "ses_a", "f", None), ("13", "k", "ses_a", "old", None)], "request string, project_key string, native_id string, fingerprint string, refusal string")
    excluded = s.where("native_id in ('b', 'ses_c')")
    found = targets.document(targets.dispatch(requests, s, hosts, excluded)).collect()
    # b is one of the sources, so a is the only one left of its project
    assert {r["request"]: r["code"] for r in found} == {k: v[3] for k, v in asked.items()} | {"3": "unique_candidate"}
    for r in found:
        body = json.loads(r["document"])
        assert sorted(body) == ["candidate_count", "code", "kind", "reason", "schema_version"] and body["reason"] and "ses_" not in r["document"]


def test_candidates_with_warnings(spark):
    rows = [("1", "codex", "/w/main/a"), ("2", "codex", "/w/tree//"), ("3", "codex", "/w/other"), ("4", "codex", "relative"), ("5", "codex", None), ("6", "grok", "/w/main")]
    found, told = targets.discovered(spark.createDataFrame(rows, "source_id string, adapter string, project_hint string"), known(spark), "/w/main")
    assert sorted(r["source_id"] for r in found.collect()) == ["1", "2"] and sorted((r["source_id"], r["code"]) for r in told.collect()) == [("4", "project-hint-unavailable"), ("5", "project-hint-unavailable")]
    assert projects.resolve(spark.createDataFrame([("/w/main",)], "project_hint string"), known(spark)).first()["display_name"] == "main"


def test_gate_and_rollups(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id string")
    found = spark.createDataFrame([("a", "new"), ("b", "changed"), ("c", "changed"), ("d", "unchanged"), ("e", "removed")], "source_id string, op string")
    told = delta.skipped(found, ids("a", "b"), ids("a"))
    assert sorted((r["source_id"], r["code"]) for r in told.collect()) == [("b", "capsule-not-built"), ("c", "session-not-indexed")]
    prior, following = (spark.createDataFrame([(x, f)], "source_id string, fingerprint string") for x, f in (("a", "1"), ("a", "2")))
    assert delta.gated(prior, following, told).first()["fingerprint"] == "2" and delta.gated(prior, following, told.limit(0)).first()["fingerprint"] == "2"
    held = told.unionByName(told.limit(1).withColumn("code", F.lit("unresolved-project")))
    assert [r["fingerprint"] for r in delta.gated(prior, following, held).collect()] == ["1"]
    status = spark.createDataFrame([("x", "complete"), ("x", "ready"), ("y", "unavailable"), ("y", "broken"), ("z", "complete"), ("z", "partial"), ("u", "ready"), ("u", "broken")], "k string, status string")
    assert {r["k"]: r["status"] for r in delta.rolled_up(status, ["k"]).collect()} == {"x": "complete", "y": "unavailable", "z": "partial", "u": "partial"}
    assert delta.rolled_up(status.limit(0), []).first()["status"] == "unavailable"


def test_rereading_exports(spark, tmp_path):
    said = lambda i, x: {"info": {"id": f"m{i}", "sessionID": x, "role": "user", "time": {"created": i}}, "parts": [{"type": "text", "text": f"t{i}"}]}
    for name, own in (("ses_a", "ses_a"), ("ses_b", "ses_other"), ("ses_c", "ses_c")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"info": {"id": own, "directory": "/w/", "model": {"id": "m1", "providerID": "p", "variant": "v"}, "time": {"created": 1, "updated": 9}}, "messages": [said(i, own) for i in range(4)]}))
    (tmp_path / "ses_d.json").write_text("{cut")
    rows = [(f"opencode:s:{k}", a, k, f, loc, h) for k, a, f, loc, h in (("ses_a", "opencode", "9", "session:ses_a", "/w"), ("ses_b", "opencode", "9", "session:ses_b", "/w"), ("ses_c", "opencode", "8", "session:ses_c", "/w//"), ("ses_d", "opencode", "9", "session:ses_d", "/w"), ("ses_e", "opencode", "9", "session:ses_e", "/w"))]
    rows += [(f"opencode:t:{i}", *x) for i, x in enumerate([("codex", "ses_a", "9", "session:ses_a", "/w"), ("opencode", "ses_a", "abc", "session:ses_a", "/w"), ("opencode", "ses_a", "9", "elsewhere", "/w"), ("opencode", "ses_a", "9", "session:ses_a", "/v"), ("opencode", "ses_a", None, None, None)])]
    turns, heads, warnings = logs.reread_exports(spark, spark.createDataFrame(rows, "source_id string, adapter string, native_id string, fingerprint string, locator string, project_hint string"), str(tmp_path), 1, 3)
    assert sorted((r["source_id"][-5:], r["ordinal"], r["text"]) for r in turns.collect()) == [("ses_a", 1, "t1"), ("ses_a", 2, "t2"), ("ses_c", 1, "t1"), ("ses_c", 2, "t2")]
    assert {r["source_id"].partition(":")[2]: (r["code"]) for r in warnings.collect()} == {"s:ses_b": "identity-mismatch", "s:ses_c": "source-changed", "s:ses_d": "malformed-export", "s:ses_e": "missing-source", "t:0": "wrong-source", "t:1": "unsupported-fingerprint", "t:2": "identity-mismatch", "t:3": "project-mismatch", "t:4": "unsupported-fingerprint"}
    status = {r["source_id"].partition(":")[2]: (r["read_status"], r["model_id"], r["effort"]) for r in heads.collect()}
    assert status["s:ses_a"] == ("complete", "m1", "v") and status["s:ses_c"] == ("partial", "m1", "v") and status["t:3"] == ("unavailable", None, None) and len(status) == 10


def test_browsing_capsules(spark):
    body = lambda name, *said: json.dumps({"display_name": name, "excerpts": [{"role": r, "text": t} for r, t in said], "session_header": {"visible_turn_count": 3, "model_id": True}})
    capsules = spark.createDataFrame([("a", body("A", ("agent", "x"), ("user", "asked"))), ("b", "broken"), ("z", body("Z"))], "source_id string, content_json string")
    sessions = spark.createDataFrame([("a", "p", 1), ("b", "p", 2), ("c", "p", 3)], "source_id string, project_key string, u long").withColumn("updated_at", F.timestamp_seconds("u")).drop("u")
    rows = discovery.browse_kept(capsules, sessions, F.col("project_key") == "p").collect()
    assert [(r["source_id"], r["display_name"], r["excerpt"], r["visible_turn_count"], r["model_id"]) for r in rows] == [("b", None, None, None, None), ("a", "A", "asked", 3, None)]
    with pytest.raises(ValueError):
        discovery.browse_kept(capsules, sessions, F.lit(True), limit=0)
