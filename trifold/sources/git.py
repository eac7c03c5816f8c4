"""Git history and working trees as DataFrames.

`GitBlobs` is a Python data source: spark.read.format("gitblobs").options(repo=..., rev=...).load()
gives (path, content) of a revision, and with revs="a,b,c" and names="x,y,z" (path, x, y, z) of
several. `paths` (one a line) limits it to those files, which is pushed to git: nothing else is
read. A partition is a slice of the paths and runs one `git cat-file --batch`, so the repository
must lie at the same place on every executor.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that a walk skips, beside those whose name begins with a dot.
SKIPPED = ["node_modules", "target", "__pycache__", "venv"]


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=60)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "replace")


def show(repo: str, rev: str, path: str) -> str:
    """A file at a revision; the empty text where it isn't there."""
    try:
        return _git(repo, "show", f"{rev}:{path}")
    except RuntimeError:
        return ""


def repo_root(path: str) -> str:
    folder = path if os.path.isdir(path) else os.path.dirname(path) or "."
    return _git(folder, "rev-parse", "--show-toplevel").strip()


def discover_root(path: str | None = None) -> str:
    """The repository of an absolute path, else the folder that TRIFOLD_REPO names, else the repository of the current folder."""
    if path and os.path.isabs(path):
        try:
            return repo_root(path)
        except RuntimeError:
            pass
    named = os.environ.get("TRIFOLD_REPO", "")
    return named if os.path.isdir(named) else repo_root(".")


def merge_base(repo: str, a: str, b: str) -> str:
    return _git(repo, "merge-base", a, b).strip()


def blobs(repo: str, wanted: Iterable[str]) -> Iterator[str]:
    """The contents of rev:path names, in order, by one git process; the empty text where there is no such file."""
    run = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    try:
        for name in wanted:
            run.stdin.write(name.encode() + b"\n")
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) != 3 or not head[2].isdigit():  # missing, or a name that is no object
                yield ""
                continue
            content = run.stdout.read(int(head[2]) + 1)[:-1]
            yield content.decode("utf-8", "replace") if head[1] == b"blob" else ""
    finally:
        run.stdin.close()
        run.stdout.close()
        run.wait()


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options["repo"]
        self.revs = options.get("revs", options.get("rev", "HEAD")).split(",")
        self.paths = options["paths"].split("\n") if "paths" in options else None
        self.slices = int(options.get("slices", 8))

    def partitions(self) -> list[_Slice]:
        paths = self.paths
        if paths is None:
            trees = [_git(self.repo, "ls-tree", "-r", "-z", "--name-only", rev).split("\0") for rev in self.revs]
            paths = sorted({x for tree in trees for x in tree})
        paths = [x for x in paths if x]
        return [_Slice(paths[i :: self.slices]) for i in range(min(self.slices, max(1, len(paths))))]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        found = blobs(self.repo, (f"{rev}:{path}" for path in partition.paths for rev in self.revs))
        for path in partition.paths:
            yield (path, *(next(found) for _ in self.revs))


class GitBlobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitblobs"

    def schema(self) -> str:
        return ", ".join(f"{x} string" for x in ["path", *self.options.get("names", "content").split(",")])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitBlobs)


def commits(spark: SparkSession, repo: str, limit: int | None = None) -> DataFrame:
    """(commit, parents) of HEAD's history."""
    rows = [(x[0], x[1:]) for x in map(str.split, _git(repo, "log", "--format=%H %P", *([f"-{limit}"] if limit else [])).splitlines())]
    return spark.createDataFrame(rows, "commit string, parents array<string>")


def merge_commits(history: DataFrame, limit: int = 500) -> DataFrame:
    return history.filter(F.size("parents") == 2).limit(limit)


def changed_paths(repo: str, a: str, b: str, modified_only: bool = False) -> list[str]:
    return [x for x in _git(repo, "diff", "--name-only", "-z", *(["--diff-filter=M"] if modified_only else []), f"{a}..{b}").split("\0") if x]


def changed_files(spark: SparkSession, repo: str, a: str, b: str, modified_only: bool = False) -> DataFrame:
    """(file) changed between two revisions."""
    return spark.createDataFrame([(x,) for x in sorted(changed_paths(repo, a, b, modified_only))], "file string")


def replayed(spark: SparkSession, repo: str, limit: int = 500) -> DataFrame:
    """(commit, file_path, base, ours, theirs, human) of the files that both sides of a merge commit modified."""
    register(spark)
    out = None
    for row in merge_commits(commits(spark, repo), limit).collect():
        ours, theirs = row.parents
        start = merge_base(repo, ours, theirs)
        paths = sorted(set(changed_paths(repo, start, ours, True)) & set(changed_paths(repo, start, theirs, True)))
        if paths:
            one = spark.read.format("gitblobs").options(repo=repo, revs=f"{start},{ours},{theirs},{row.commit}", names="base,ours,theirs,human", paths="\n".join(paths)).load()
            one = one.select(F.lit(row.commit).alias("commit"), F.col("path").alias("file_path"), "base", "ours", "theirs", "human")
            out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "commit string, file_path string, base string, ours string, theirs string, human string") if out is None else out


def diff_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose content differs between two (path, content) tables, or that only one has."""
    a, b = (x.select("path", F.md5(F.col("content").cast("binary")).alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def merge_inputs(spark: SparkSession, repo: str, ours: str, theirs: str) -> DataFrame:
    """(file_path, base, ours, theirs) for files that both branches changed since their merge base."""
    register(spark)
    start = merge_base(repo, ours, theirs)
    both = sorted(set(changed_paths(repo, start, ours)) & set(changed_paths(repo, start, theirs)))
    found = spark.read.format("gitblobs").options(repo=repo, revs=f"{start},{ours},{theirs}", names="base,ours,theirs", paths="\n".join(both)).load()
    return found.withColumnRenamed("path", "file_path").orderBy("file_path")


def working_tree(spark: SparkSession, root: str, endings: list[str]) -> DataFrame:
    """(path, content) of the supported files under root, without skipped and hidden folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), base, -1)
    hidden = path.rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + r")/") | path.rlike(r"(^|/)\.[^/]*$")
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.endswith(F.lower(path), F.lit(e))
    return found.select(path.alias("path"), F.decode("content", "utf-8").alias("content"), hidden.alias("h"), ends.alias("e")).filter("not h and e").drop("h", "e").orderBy("path")


def save_cases(merged: DataFrame, path: str) -> None:
    """Recorded cases, one folder per category."""
    merged.write.partitionBy("category").mode("overwrite").parquet(path)


def save_results(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").json(path)
