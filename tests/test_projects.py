"""Projects by repositories."""

import hashlib

from pyspark.sql import functions as F

from threadloom.operators import projects


def key(kind, path):
    return f"{kind}:sha256:{hashlib.sha256(path.encode()).hexdigest()}"


def test_paths(spark):
    known = {"/a/b/": "/a/b", "//a//./b/../c": "/a/c", "/": "/", "/../x": "/x", "a/b": None, "": None, None: None, "file:///a%20b/c+d": "/a b/c+d", "file:/x//": "/x", "/p%20q": "/p%20q"}
    rows = spark.createDataFrame([(k,) for k in known], "p string").select("p", projects.absolute(F.col("p")).alias("q"))
    assert {r["p"]: r["q"] for r in rows.collect()} == known
    up = projects.ancestors(spark.createDataFrame([("/a/b/c",), ("/",)], "path string"))
    assert sorted((r["path"], r["ancestor"]) for r in up.collect()) == sorted([("/a/b/c", x) for x in ("/a/b/c", "/a/b", "/a", "/")] + [("/", "/")])


def test_projects_of_folders(spark, tmp_path):
    def put(path, body):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)

    put("main/.git/HEAD", "ref: x\n")
    put("main/.git/worktrees/w/commondir", "../..\n")
    put("main/lib/nested/.git/HEAD", "ref: x\n")
    put("tree/.git", f"gitdir: {tmp_path}/main/.git/worktrees/w\n")
    put("main/module/.git", "gitdir: ../.git/modules/m\n")
    put("main/broken/.git", "nothing\n")
    (tmp_path / "plain" / "deep").mkdir(parents=True)
    known = projects.repositories(projects.repository_files(spark, str(tmp_path)))
    t = str(tmp_path)
    assert {r["root"]: r["common"] for r in known.collect()} == {f"{t}/main": f"{t}/main/.git", f"{t}/main/lib/nested": f"{t}/main/lib/nested/.git", f"{t}/tree": f"{t}/main/.git", f"{t}/main/module": f"{t}/main/.git/modules/m"}
    want = {
        f"{t}/main/src//": ("git", f"{t}/main/.git", "main", "current"), f"{t}/tree/x": ("git", f"{t}/main/.git", "main", "current"), f"{t}/main/lib/nested/a": ("git", f"{t}/main/lib/nested/.git", "nested", "foreign"),
        f"{t}/main/lib": ("git", f"{t}/main/.git", "main", "current"), f"{t}/main/module": ("git", f"{t}/main/.git/modules/m", "m", "foreign"), f"{t}/plain/deep/": ("directory", f"{t}/plain/deep", "deep", "foreign"),
        f"{t}/mainly": ("directory", f"{t}/mainly", "mainly", "foreign"), f"{t}/main/broken": ("git", f"{t}/main/.git", "main", "current"),
    }
    hints = spark.createDataFrame([(h,) for h in [*want, *want, "relative", None, "/ctl\x07"]], "project_hint string")
    got = {r["project_hint"]: (r["project_key"], r["kind"], r["display_name"], r["scope"]) for r in projects.resolve(hints, known, f"{t}/main/src/").collect()}
    assert got == {h: (key(k, p), k, n, s) for h, (k, p, n, s) in want.items()} | {"relative": (None, None, None, "unresolved"), None: (None, None, None, "unresolved"), "/ctl\x07": (key("directory", "/ctl\x07"), "directory", "ctl?", "foreign")}
    assert projects.resolve(hints.limit(0), known).count() == 0
    assert {r["scope"] for r in projects.resolve(hints, known.limit(0)).collect()} == {"foreign", "unresolved"}
