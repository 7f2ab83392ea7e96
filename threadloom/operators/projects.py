"""Which project a session's folder belongs to: the repository around it, whichever worktree it is in, or the folder itself.

Repositories are told by their own small files. A folder's ancestors are exploded and joined with the repositories' folders,
and the longest that is one wins; so a hash join on whole paths takes the place of a walk up the tree for every folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text

#: Characters of a project's name that are shown.
NAME_LIMIT = 80


def absolute(path: Column) -> Column:
    """A path without repeated or trailing slashes, '.' and '..'; of a file URL its decoded path; null if it isn't absolute."""
    plain = F.when(F.startswith(path, F.lit("file:/")), text.percent_decoded(F.replace(F.regexp_replace(path, r"\Afile:/+", "/"), F.lit("+"), F.lit("%2B")))).otherwise(path)
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    up = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.array_append(done, p))
    whole = F.aggregate(parts, F.array().cast("array<string>"), up)
    return F.when(F.startswith(plain, F.lit("/")), F.concat(F.lit("/"), F.array_join(whole, "/")))


def repositories(files: DataFrame) -> DataFrame:
    """(root, common): the working folders of repositories, and the folder that their worktrees share.

    files: (path, body) of the files `.git`, `.git/HEAD` and `commondir`. A folder `.git` with a HEAD is its own; a file
    `.git` names the folder that a worktree or submodule is kept in, whose `commondir` names the shared one, if there is one.
    """
    rows = files.select(absolute(F.col("path")).alias("path"), F.trim(F.regexp_replace("body", r"\s+\z", "")).alias("body"))
    folder = lambda c: F.regexp_replace(c, r"/[^/]*\z", "")
    within = lambda base, to: absolute(F.when(F.startswith(to, F.lit("/")), to).otherwise(F.concat(base, F.lit("/"), to)))
    own = rows.where(F.endswith("path", F.lit("/.git/HEAD"))).select(folder(folder(F.col("path"))).alias("root"), folder(F.col("path")).alias("common"))
    kept = rows.where(F.endswith("path", F.lit("/.git")) & F.startswith("body", F.lit("gitdir: ")))
    kept = kept.select(folder(F.col("path")).alias("root"), within(folder(F.col("path")), F.substring("body", 9, 1 << 20)).alias("at"))
    shared = rows.where(F.endswith("path", F.lit("/commondir"))).select(folder(F.col("path")).alias("at"), within(folder(F.col("path")), F.col("body")).alias("shared"))
    trees = kept.join(shared, "at", "left").select("root", F.coalesce("shared", "at").alias("common"))
    return own.unionByName(trees).dropDuplicates(["root"])


def repository_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of what repositories() reads below a folder of any store; Spark's readers pass over names that begin with a dot, so they are listed by the store."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, pending = [], [top]
    while pending:
        for s in store.listStatus(pending.pop()):
            path, name = s.getPath(), s.getPath().getName()
            if s.isDirectory():
                if name == ".git":
                    inner = [jvm.org.apache.hadoop.fs.Path(path, "HEAD")]
                    trees = jvm.org.apache.hadoop.fs.Path(path, "worktrees")
                    inner += [jvm.org.apache.hadoop.fs.Path(t.getPath(), "commondir") for t in store.listStatus(trees)] if store.exists(trees) else []
                    found += [p for p in inner if store.exists(p)]
                else:
                    pending.append(path)
            elif name == ".git":
                found.append(path)
    bodies = []
    for path in found:
        stream = store.open(path)
        bodies.append((path.toUri().getPath(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")))
        stream.close()
    return spark.createDataFrame(bodies, "path string, body string")


def ancestors(paths: DataFrame) -> DataFrame:
    """(path, ancestor): each path with itself and all folders above it."""
    parts = F.split(F.substring("path", 2, 1 << 20), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return paths.select("path", F.explode(F.array_append(F.when(F.col("path") != "/", up).otherwise(F.array().cast("array<string>")), F.lit("/"))).alias("ancestor"))


def resolve(hints: DataFrame, known: DataFrame, current: str | None = None) -> DataFrame:
    """(project_hint, project_key, kind, display_name, scope) of distinct hints; known: (root, common) of repositories.

    A hint that is no absolute path has no key. current: a folder; its project's hints are in scope `current`.
    """
    told = hints.select("project_hint").distinct().withColumn("path", absolute(F.col("project_hint")))
    if current is not None:
        told = told.unionByName(told.sparkSession.createDataFrame([(None,)], "project_hint string").withColumn("path", absolute(F.lit(current))))
    near = ancestors(told.select("path").where("path is not null").distinct()).join(known.select(F.col("root").alias("ancestor"), "common"), "ancestor")
    near = near.groupBy("path").agg(F.max_by("common", F.length("ancestor")).alias("common"))
    rows = told.join(near, "path", "left")
    at = F.coalesce("common", "path")
    kind = F.when(F.col("common").isNotNull(), "git").otherwise("directory")
    key = F.concat(kind, F.lit(":sha256:"), F.sha2(at.cast("binary"), 256))
    name = F.regexp_extract(F.regexp_replace(at, r"(?<=.)/\.git\z", ""), r"([^/]*)\z", 1)
    shown = F.substring(F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"\p{C}", "?")), F.lit("")), F.lit("unnamed-project")), 1, NAME_LIMIT)
    known_path = F.col("path").isNotNull()
    rows = rows.select("project_hint", "path", F.when(known_path, key).alias("project_key"), F.when(known_path, kind).alias("kind"), F.when(known_path, shown).alias("display_name"))
    mine = F.lit(None).cast("string")
    if current is not None:
        own = rows.where(F.col("path") == absolute(F.lit(current))).select(F.col("project_key").alias("own")).limit(1)
        rows = rows.join(F.broadcast(own), how="left")
        mine = F.col("own")
    scope = F.when(F.col("project_key").isNull(), "unresolved").when(F.col("project_key") == mine, "current").otherwise("foreign")
    return rows.withColumn("scope", scope).where("project_hint is not null or path is null").select("project_hint", "project_key", "kind", "display_name", "scope").distinct()
