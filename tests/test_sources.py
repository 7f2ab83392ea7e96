"""The six log loaders, on logs written here in the shapes that the sources have, and the index stream."""

import json
import shutil

from pyspark.sql import functions as F

from threadloom.operators import catalog, search
from threadloom.sources import files, logs
from threadloom.streaming import index

ID = "019f6000-5678-7000-8000-00000000000"


def write(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + end)


def told(scan):
    return [(r["ordinal"], r["role"], r["text"], r["locator"]) for r in scan.turns.orderBy("source_id", "ordinal").collect()]


def codes(scan):
    return sorted(r["code"] for r in scan.warnings.collect())


def codex_rows(task="task_complete"):
    said = lambda role, kind, *texts: {"timestamp": "2026-07-14T20:00:02Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": kind, "text": t} for t in texts]}}
    return [
        {"timestamp": "2026-07-14T20:00:00Z", "type": "session_meta", "payload": {"id": ID + "1", "timestamp": "2026-07-14T19:59:59Z", "cwd": "/work/demo", "model_provider": "openai"}},
        said("user", "input_text", "a", "b"),
        "{broken",
        said("assistant", "output_text", "answer"),
        said("assistant", "input_text", "not shown"),
        {"timestamp": "2026-07-14T20:00:05Z", "type": "turn_context", "payload": {"model": "m-1", "effort": "high"}},
        {"timestamp": "2026-07-14T20:00:09Z", "type": "event_msg", "payload": {"type": task}},
    ]


def test_codex(spark, tmp_path):
    write(tmp_path / f"2026/07/rollout-2026-07-14T20-00-00-{ID}1.jsonl", codex_rows())
    write(tmp_path / f"rollout-{ID}2.jsonl", [*codex_rows("task_started")[:2], '{"cut": '], end="")
    write(tmp_path / "unnamed.jsonl", codex_rows())
    scan = logs.codex(spark, str(tmp_path))
    s = {r["native_id"]: r for r in scan.sessions.collect()}
    assert set(s) == {ID + "1", ID + "2"} and s[ID + "1"]["health"] == "complete" and s[ID + "2"]["health"] == "unknown"
    one = s[ID + "1"]
    assert (one["model_id"], one["effort"], one["model_provider"], one["project_hint"]) == ("m-1", "high", "openai", "/work/demo") and len(one["fingerprint"]) == 64
    assert one["started_at"].isoformat().startswith("2026-07-14T19:59:59") and one["updated_at"].isoformat().startswith("2026-07-14T20:00:09")
    assert told(scan) == [(0, "user", "a\nb", "jsonl:2"), (1, "agent", "answer", "jsonl:4"), (0, "user", "a\nb", "jsonl:2")]
    assert codes(scan) == ["malformed-jsonl", "truncated-jsonl", "unrecognized-session-name"]
    assert {r["read_status"] for r in scan.status().collect()} == {"partial"}
    assert logs.selected(scan.turns, 1, 2).count() == 1


def test_grok(spark, tmp_path):
    base = tmp_path / "sessions/%2Fwork%2Fdemo" / (ID + "3")
    write(base / "summary.json", [{"created_at": "2026-07-14T20:00:00Z", "updated_at": "naive", "generated_title": "T", "current_model_id": "g"}])
    chunk = lambda kind, text, method="session/update": {"method": method, "timestamp": 1784059200, "params": {"sessionId": ID + "3", "update": {"sessionUpdate": kind, "content": {"type": "text", "text": text}}}}
    write(base / "updates.jsonl", [chunk("user_message_chunk", "hi"), chunk("agent_thought_chunk", "no"), chunk("agent_message_chunk", "one", "_x.ai/session/update"), chunk("agent_message_chunk", "two"), chunk("agent_message_chunk", "no", "other"), "nope"])
    scan = logs.grok(spark, str(tmp_path))
    s = scan.sessions.first()
    assert s["title"] == "T" and s["project_hint"] == "/work/demo" and s["model_id"] == "g" and s["updated_at"] is not None
    assert [x[:3] for x in told(scan)] == [(0, "user", "hi"), (1, "agent", "one"), (2, "agent", "two")]
    assert codes(scan) == ["malformed-update", "summary-time-drift"]


def test_opencode(spark, tmp_path):
    write(tmp_path / "session-list.json", [json.dumps([{"id": "ses_a", "directory": "/w/", "title": "A", "time": {"created": 1000, "updated": 5000}}, {"id": "ses_b", "directory": "/w", "title": " ", "updated": 1, "created": 1}, {"id": "ses_c", "directory": "/x", "title": "C", "updated": 1, "created": 1}])])
    said = lambda i, role, at, *parts: {"info": {"id": i, "sessionID": "ses_a", "role": role, "time": {"created": at}}, "parts": [{"type": "text", "text": t, "ignored": g} for t, g in parts]}
    write(tmp_path / "exports/a.json", [json.dumps({"info": {"id": "ses_a", "model": {"id": "m", "providerID": "p", "variant": "v"}, "time": {"created": 1000, "updated": 4000}}, "messages": [said("m2", "assistant", 20, ("late", False)), said("m1", "user", 10, ("first", False), ("hidden", True)), said("m1", "user", 10, ("again", False)), said(None, "user", 1, ("x", False))]})])
    scan = logs.opencode(spark, str(tmp_path / "session-list.json"), str(tmp_path / "exports"), "/w")
    s = scan.sessions.collect()
    assert [(r["native_id"], r["fingerprint"], r["model_id"], r["effort"]) for r in s] == [("ses_a", "5000", "m", "v")]
    assert told(scan) == [(0, "user", "first", "message:m1"), (1, "agent", "late", "message:m2")]
    assert codes(scan) == ["malformed-message", "source-changed", "unsupported-session"]
    versions = spark.createDataFrame([("1.17.18", True), ("v1.20.0", True), ("1.17.17", False), ("2.0.0", False), ("x", False)], "v string, ok boolean")
    assert all(r["ok"] == r["got"] for r in versions.withColumn("got", logs.supported_version(F.col("v"))).collect())


def test_opencode_catalogs_of_many_pages(spark, tmp_path):
    entry = lambda n, at: {"id": f"ses_{n}", "directory": "/w", "title": f"T{n} {at}", "time": {"created": 1, "updated": at}}
    write(tmp_path / "pages/a.json", [json.dumps([entry(n, 5) for n in range(500)])])
    write(tmp_path / "pages/b.json", [json.dumps([entry(n, 7) for n in range(498, 700)])])
    said = {"info": {"id": "m", "sessionID": "ses_499", "role": "user", "time": {"created": 1}}, "parts": [{"type": "text", "text": "once"}]}
    write(tmp_path / "exports/x.json", [json.dumps({"info": {"id": "ses_499", "time": {"created": 1, "updated": 7}}, "messages": [said]})])
    scan = logs.opencode(spark, str(tmp_path / "pages"), str(tmp_path / "exports"))
    titles = {r["native_id"]: r["title"] for r in scan.sessions.collect()}
    assert titles == {f"ses_{n}": f"T{n} {5 if n < 498 else 7}" for n in range(700)} and scan.sessions.count() == 700
    assert told(scan) == [(0, "user", "once", "message:m")] and codes(scan) == []
    # a page of more than what is read of a file is told
    write(tmp_path / "pages/c.json", [json.dumps([entry(n, 9) for n in range(700, 1201)])])
    scan = logs.opencode(spark, str(tmp_path / "pages"), str(tmp_path / "exports"))
    assert scan.sessions.count() == 1200 and codes(scan) == ["catalog-limit"]


def test_cursor(spark, tmp_path):
    said = lambda role, *parts: {"role": role, "message": {"content": list(parts)}}
    write(tmp_path / "projects/-w/agent-transcripts/s1/s1.jsonl", [said("user", {"type": "text", "text": "q"}), said("assistant", {"type": "text", "text": "a"}, {"type": "tool_use", "name": "Task", "input": {"model": "fast"}}), said("system", {"type": "text", "text": "no"})])
    write(tmp_path / "chats/x/s1/meta.json", [{"title": "T", "createdAtMs": 1000, "updatedAtMs": 2000, "cwd": "/w"}])
    scan = logs.cursor(spark, str(tmp_path / "projects"), str(tmp_path / "chats"))
    s = scan.sessions.first()
    assert (s["title"], s["model_id"], s["project_hint"], s["updated_at"].second) == ("T", "fast", "/w", 2)
    assert told(scan) == [(1, "user", "q", "line:1"), (2, "agent", "a", "line:2")] and scan.status().first()["read_status"] == "complete"
    meta = spark.range(1).select(logs.store_meta(F.hex(F.lit('{"name":"N","lastUsedModel":"m"}'))).alias("m")).first()["m"]
    assert (meta["name"], meta["lastUsedModel"]) == ("N", "m")


def test_claude(spark, tmp_path):
    rows = [{"type": "permission-mode"}, {"type": "user", "timestamp": "2026-07-01T10:00:00", "cwd": "/w", "message": {"role": "user", "content": '[{"not": "blocks"}]'}}, {"type": "ai-title", "aiTitle": "Old"}, {"type": "ai-title", "aiTitle": "New"}, {"type": "assistant", "timestamp": "2026-07-01T10:00:05Z", "message": {"role": "assistant", "model": "c-1", "content": [{"type": "text", "text": "x"}, {"type": "thinking", "text": "no"}, {"type": "text", "text": "y"}]}}]
    write(tmp_path / "projects/-w" / f"{ID}4.jsonl", rows)
    scan = logs.claude(spark, str(tmp_path))
    s = scan.sessions.first()
    assert (s["title"], s["model_id"], s["model_provider"], s["project_hint"]) == ("New", "c-1", "anthropic", "/w") and s["started_at"].second == 0 and s["updated_at"].second == 5
    assert told(scan) == [(1, "user", '[{"not": "blocks"}]', "line:2"), (2, "agent", "x\ny", "line:5")]


def test_antigravity(spark, tmp_path):
    write(tmp_path / "history.jsonl", [{"display": "first", "timestamp": 1000, "workspace": "/w", "conversationId": ID + "5"}, {"display": " ", "timestamp": 3000, "workspace": "/w/", "conversationId": ID + "5"}, {"display": "x", "timestamp": 1, "workspace": "/other", "conversationId": ID + "6"}, {"display": "x", "timestamp": 1, "workspace": "/w", "conversationId": "no-uuid"}])
    row = lambda source, kind, content: {"source": source, "type": kind, "content": content, "created_at": "2026-07-01T10:00:00Z"}
    write(tmp_path / "brain" / (ID + "5") / "transcript.jsonl", [row("USER_EXPLICIT", "USER_INPUT", "noise <USER_REQUEST>\n do it </USER_REQUEST>"), row("MODEL", "PLANNER_RESPONSE", "see file:///x"), row("MODEL", "PLANNER_RESPONSE", "done"), row("MODEL", "TOOL", "no")])
    scan = logs.antigravity(spark, str(tmp_path / "history.jsonl"), str(tmp_path / "brain"), "/w")
    s = scan.sessions.collect()
    assert [(r["native_id"], r["title"], r["updated_at"].second) for r in s] == [(ID + "5", "first", 3)]
    assert told(scan) == [(1, "user", "do it", "line:1"), (2, "agent", "done", "line:3")]


def test_union_and_files(spark, tmp_path):
    write(tmp_path / "c" / f"rollout-{ID}1.jsonl", codex_rows())
    write(tmp_path / "p/agent-transcripts/s/s.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "q"}]}}])
    both = logs.union([logs.codex(spark, str(tmp_path / "c")), logs.cursor(spark, str(tmp_path / "p"))])
    assert both.sessions.count() == 2 and both.turns.count() == 3
    (tmp_path / "c/link.jsonl").symlink_to("/etc/hostname")
    assert files.unsafe_entries(str(tmp_path / "c")) == [str(tmp_path / "c/link.jsonl")]
    assert files.to_json_documents(spark.createDataFrame([(1, None)], "b int, a string")).first()[0] == '{"a":null,"b":1}'


def test_index_stream(spark, tmp_path):
    def send(name, rows):
        full = [(s, "p", "codex", s, f, None, "unknown", None, None, op, [(0, "user", t, "l")]) for s, f, t, op in rows]
        spark.createDataFrame(full, index.STREAM).withColumn("updated_at", F.timestamp_seconds(F.lit(5))).coalesce(1).write.parquet(str(tmp_path / "tmp" / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        for p in (tmp_path / "tmp" / name).glob("*.parquet"):
            p.rename(tmp_path / "in" / f"{name}-{p.name}")

    def run():
        seen = []
        index.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "catalog"), str(tmp_path / "ck"), seen.append).awaitTermination()
        return seen

    send("one", [("a", "1", "Fix it", "new"), ("b", "1", "hello", "new")])
    assert run() == [{"indexed": 2, "removed": 0}] and run() == []
    send("two", [("a", "1", "Fix it", "new"), ("b", "2", "Build it", "changed")])
    assert run() == [{"indexed": 1, "removed": 0}]
    send("three", [("a", "1", "", "removed")])
    assert run() == [{"indexed": 0, "removed": 1}]
    store = catalog.Catalog(spark, str(tmp_path / "catalog"))
    assert [r["source_id"] for r in store.tables()["sessions"].collect()] == ["b"]
    assert json.loads(store.tables()["capsules"].first()["content_json"])["display_name"] == "Build it"
    # the postings follow the capsules, hold redacted text only, and serve a search by themselves
    assert {r["term"] for r in store.tables()["postings"].collect()} == {"build", "it"}
    numbers = store.current()["tables"]["sessions"]["parts"]
    send("four", [("c", "1", "Builds with password: hunter22; fine", "new")])
    assert run() == [{"indexed": 1, "removed": 0}]
    spark.createDataFrame([("d", "elsewhere", "codex", "d", "1", None, "unknown", None, None, "new", [(0, "user", "building", "l")])], index.STREAM).withColumn("updated_at", F.timestamp_seconds(F.lit(9))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "five"))
    for f in (tmp_path / "in" / "five").glob("*.parquet"):
        f.rename(tmp_path / "in" / f.name)
    shutil.rmtree(tmp_path / "in" / "five")
    before = store.current()["tables"]["capsules"]["parts"]
    assert run() == [{"indexed": 1, "removed": 0}]
    after = store.current()["tables"]["capsules"]["parts"]
    assert after[store.part_of("p")] == before[store.part_of("p")] and store.part_of("elsewhere") in after and numbers
    store.commit({"sessions": store.tables()["sessions"]})
    found = search.kept(store, "builds", F.col("project_key") == "p")
    assert [r["source_id"] for r in found.collect()] == ["b", "c"]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString() and "BatchEvalPython" not in found._jdf.queryExecution().toString()
    assert search.kept(store, "hunter22", F.lit(True)).count() == 0 and search.hints(search.kept(store, "hunter22", F.lit(True))).count() == len(search.HINTS) and search.hints(found).count() == 0
    shown = {r["source_id"]: r["snippet"] for r in search.shown(found, store.tables()["capsules"]).collect()}
    assert shown["b"] == "[Build] it" and shown["c"].startswith("[Builds] with password=[REDACTED:") and "hunter" not in shown["c"]
    assert search.kept(store, "build", F.lit(True)).count() == 3


def test_links_out_of_the_root_are_not_read(spark, tmp_path):
    name = "rollout-2024-01-01T00-00-00-019f6000-1234-7000-8000-00000000000{}.jsonl"
    line = json.dumps({"type": "session_meta", "payload": {"cwd": "/w"}}) + "\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / name.format(1)).write_text(line)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / name.format(2)).write_text(line)
    (tmp_path / "in" / name.format(2)).symlink_to(tmp_path / "out" / name.format(2))
    (tmp_path / "in" / "more").symlink_to(tmp_path / "out")
    found = logs.codex(spark, str(tmp_path / "in"))
    assert [r["native_id"][-1] for r in found.sessions.collect()] == ["1"]
    assert [r["code"] for r in found.warnings.collect()] == ["unsafe-session-source"] * 2
    assert not logs.has_files(spark, str(tmp_path / "none")) and logs.has_files(spark, str(tmp_path / "out")) and not logs.has_files(spark, str(tmp_path / "out"), "*.json")


def test_what_lies_beside_a_chat(spark, tmp_path):
    import hashlib
    import sqlite3

    def store(path, meta):
        path.parent.mkdir(parents=True)
        db = sqlite3.connect(path)
        db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
        db.execute("INSERT INTO meta VALUES ('0', ?)", (json.dumps(meta).encode().hex(),))
        db.commit()
        db.close()

    for name in "abc":
        at = tmp_path / "projects" / "work-x" / "agent-transcripts" / name
        at.mkdir(parents=True)
        (at / f"{name}.jsonl").write_text(json.dumps({"role": "user", "message": {"content": [{"type": "text", "text": "hi"}]}}) + "\n")
    own, other = hashlib.md5(b"/work/x").hexdigest(), "0" * 32
    store(tmp_path / "chats" / own / "a" / "store.db", {"name": " Named ", "createdAt": 1000, "updatedAt": 2000, "lastUsedModel": "m1", "mode": "agent"})
    store(tmp_path / "chats" / other / "b" / "store.db", {"name": "wrong one"})
    (tmp_path / "chats" / own / "b").mkdir()
    (tmp_path / "chats" / own / "b" / "meta.json").write_text(json.dumps({"title": "Mine", "createdAtMs": 5000, "cwd": "/work/x"}))
    (tmp_path / "chats" / own / "c").mkdir()
    (tmp_path / "chats" / own / "c" / "store.db").write_bytes(b"no database")
    plain = {r["native_id"]: r["fingerprint"] for r in logs.cursor(spark, str(tmp_path / "projects")).sessions.collect()}
    found = logs.cursor(spark, str(tmp_path / "projects"), str(tmp_path / "chats"))
    got = {r["native_id"]: r for r in found.sessions.collect()}
    assert (got["a"]["title"], got["a"]["model_id"], got["a"]["effort"], got["a"]["started_at"].second) == ("Named", "m1", "agent", 1)
    assert (got["b"]["title"], got["b"]["project_hint"], got["c"]["title"]) == ("Mine", "/work/x", None)
    assert [(r["code"], r["source_id"][-1]) for r in found.warnings.collect()] == [("cursor-store-drift", "c")]
    assert len({r["fingerprint"] for r in got.values()} | set(plain.values())) == len(set(plain.values())) + 3


def test_versions_and_folders_that_name_projects(spark, tmp_path):
    (tmp_path / "list.json").write_text("[]")
    (tmp_path / "ex").mkdir()
    (tmp_path / "ex" / "x.json").write_text("{}")
    bad = logs.opencode(spark, str(tmp_path / "list.json"), str(tmp_path / "ex"), version="1.16.0")
    assert bad.sessions.count() == 0 and [r["code"] for r in bad.warnings.collect()] == ["unsupported-version"]
    assert logs.opencode(spark, str(tmp_path / "list.json"), str(tmp_path / "ex"), version="v1.17.18").warnings.count() == 0
    at = tmp_path / "grok" / "group" / "019f6000-1234-7000-8000-000000000001"
    at.mkdir(parents=True)
    (tmp_path / "grok" / "group" / ".cwd").write_text("/named/here\n")
    (at / "summary.json").write_text(json.dumps({"created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z"}))
    (at / "updates.jsonl").write_text("")
    assert [r["project_hint"] for r in logs.grok(spark, str(tmp_path / "grok")).sessions.collect()] == ["/named/here"]


def test_values_of_other_types_are_null_and_take_nothing_with_them(spark, tmp_path):
    """Truth values for texts, texts for numbers, numbers for objects: in all six sources the rest of the record stands."""
    block = lambda kind, x: {"timestamp": 5, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": kind, "text": x}, {"type": kind, "text": True}, "loose", {"type": 7, "text": "no"}]}}
    write(tmp_path / f"codex/rollout-{ID}1.jsonl", [{"timestamp": True, "type": "session_meta", "payload": {"cwd": ["/w"], "model_provider": 5, "timestamp": {}}}, {"type": "turn_context", "payload": {"model": 4, "effort": "high"}}, block("input_text", "said"), {"type": "response_item", "payload": "text"}, {"type": 9}])
    scan = logs.codex(spark, str(tmp_path / "codex"))
    s = scan.sessions.first()
    assert (s["project_hint"], s["model_provider"], s["model_id"], s["effort"], s["started_at"]) == (None, None, None, "high", None)
    assert told(scan) == [(0, "user", "said", "jsonl:3")] and codes(scan) == []
    at = tmp_path / "grok/%2Fw" / (ID + "2")
    chunk = lambda n, content: {"method": "session/update", "timestamp": n, "params": {"sessionId": ID + "2", "update": {"sessionUpdate": "user_message_chunk", "content": content}}}
    write(at / "summary.json", [{"created_at": "2024-01-01T00:00:00Z", "updated_at": 5, "generated_title": False, "git_root_dir": 3}])
    write(at / "updates.jsonl", [chunk("1", {"type": "text", "text": "one"}), chunk(2, {"type": "text", "text": 2}), chunk(3, "three"), {"method": 1}])
    scan = logs.grok(spark, str(tmp_path / "grok"))
    assert scan.sessions.select("title", "project_hint").first()[:] == (None, "/w") and [(r["text"], r["at"]) for r in scan.turns.collect()] == [("one", None)]
    write(tmp_path / "open/list.json", [json.dumps([{"id": "ses_a", "directory": 4, "title": "A", "created": 1, "updated": 5}, {"id": "ses_b", "title": "B", "created": "1", "updated": 5}, "loose", {"id": "ses_c", "title": True, "created": 1, "updated": 1}])])
    said = lambda i, parts, role="user": {"info": {"id": i, "sessionID": "ses_a", "role": role, "time": {"created": 7}}, "parts": parts}
    write(tmp_path / "open/ex/a.json", [json.dumps({"info": {"id": "ses_a", "model": "m", "time": {"updated": 5}}, "messages": [said("m1", [{"type": "text", "text": "hi", "ignored": "yes"}, {"type": "text", "text": 1}, 3]), said("m2", "parts"), said("m3", [], True), 4]})])
    scan = logs.opencode(spark, str(tmp_path / "open/list.json"), str(tmp_path / "open/ex"))
    assert [(r["native_id"], r["project_hint"], r["model_id"]) for r in scan.sessions.collect()] == [("ses_a", None, None)]
    assert told(scan) == [(0, "user", "hi", "message:m1")] and codes(scan).count("unsupported-session") == 3 and codes(scan).count("malformed-message") == 2
    write(tmp_path / "cursor/projects/-w/agent-transcripts/s/s.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "q"}, {"type": "text", "text": None}, 5]}}, {"role": True, "message": {"content": [{"type": "text", "text": "no"}]}}, {"role": "user", "message": {"content": "flat"}}, {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "Task", "input": {"model": 7}}, {"type": "text", "text": "a"}]}}])
    write(tmp_path / "cursor/chats/x/s/meta.json", [{"title": 9, "createdAtMs": "1000", "updatedAtMs": 2000, "cwd": "/w"}])
    scan = logs.cursor(spark, str(tmp_path / "cursor/projects"), str(tmp_path / "cursor/chats"))
    s = scan.sessions.first()
    assert (s["title"], s["model_id"], s["project_hint"], s["updated_at"].second) == (None, None, "/w", 2) and [x[2] for x in told(scan)] == ["q", "a"]
    write(tmp_path / "claude" / f"{ID}4.jsonl", [{"type": "ai-title", "aiTitle": 5}, {"type": "user", "cwd": 7, "message": {"content": 5}}, {"type": "user", "timestamp": 9, "message": {"content": {"a": 1}}}, {"type": "user", "message": {"content": [{"type": "text", "text": "x"}, {"type": "text", "text": 3}]}}, {"type": "assistant", "message": {"model": True, "content": "y"}}, {"type": "user", "message": "flat"}])
    scan = logs.claude(spark, str(tmp_path / "claude"))
    assert scan.sessions.select("title", "project_hint", "model_id").first()[:] == (None, None, None) and told(scan) == [(1, "user", "x", "line:4"), (2, "agent", "y", "line:5")]
    write(tmp_path / "anti/history.jsonl", [{"display": 5, "timestamp": "1000", "workspace": "/w", "conversationId": ID + "5"}, {"display": "named", "timestamp": 2000, "workspace": 3, "conversationId": ID + "5"}, {"conversationId": 5}])
    write(tmp_path / "anti/brain" / (ID + "5") / "transcript.jsonl", [{"source": "USER_EXPLICIT", "type": "USER_INPUT", "content": 5, "created_at": 7}, {"source": "USER_EXPLICIT", "type": "USER_INPUT", "content": "do", "created_at": 7}])
    scan = logs.antigravity(spark, str(tmp_path / "anti/history.jsonl"), str(tmp_path / "anti/brain"))
    s = scan.sessions.first()
    assert (s["title"], s["started_at"].second, s["updated_at"].second) == ("named", 2, 2) and [(r["text"], r["at"]) for r in scan.turns.collect()] == [("do", None)]


def test_guarded_values(spark):
    from threadloom.functions.guarded import parsed

    rows = ['{"a":"x","b":5,"c":true,"d":{"e":"y","f":[{"n":2},{"n":"2"},7]}}', '{"a":5,"b":"5","c":1,"d":"no"}', '{"b":true,"c":"true","d":{"e":null,"f":{}}}', "nope", "[1]", "null", '{"b":1.5,"a":null}', '{"b":12345678901234567890}', None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(parsed(F.col("v"), "a string, b bigint, c boolean, d struct<e:string,f:array<struct<n:bigint>>>").alias("r")).collect()]
    plain = [r and (r["a"], r["b"], r["c"], r["d"] and (r["d"]["e"], r["d"]["f"] and [x and x["n"] for x in r["d"]["f"]])) for r in got]
    assert plain == [("x", 5, True, ("y", [2, None, None])), (None,) * 4, (None, None, None, (None, None)), None, None, None, (None,) * 4, (None,) * 4, None, None]
