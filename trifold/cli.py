"""Commands over a working tree: python -m trifold.cli [--root DIR] COMMAND ...

setup, preview BRANCH, status, claim, release, bench CASES, bench-repo, summary FILE. State is the
operation log in <root>/.trifold/log.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold import api
from trifold.functions.markers import parse
from trifold.functions.parsers import LANGUAGES
from trifold.functions.text import right_stripped
from trifold.operators import bench, files, state
from trifold.sources import git

ENDINGS = [e for group in LANGUAGES.values() for e in group]


def session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def workspace(spark: SparkSession, root: str) -> api.Workspace:
    return api.Workspace(spark, git.working_tree(spark, root, ENDINGS), f"{root}/.trifold/log")


def show(rows: DataFrame) -> None:
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, sort_keys=True))


def setup(root: str) -> None:
    """Make this package the repository's merge driver for the files that it parses."""
    config = {"merge.trifold.name": "entity merge", "merge.trifold.driver": f"{sys.executable} -m trifold.driver %O %A %B -p %P"}
    for key, value in config.items():
        subprocess.run(["git", "-C", root, "config", key, value], check=True)
    path = Path(root, ".gitattributes")
    held = path.read_text().splitlines() if path.exists() else []
    path.write_text("".join(f"{x}\n" for x in dict.fromkeys([*held, *(f"*{e} merge=trifold" for e in ENDINGS)])))


def compared(cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ours_clean, line_clean and, where cases have `human`, matches_human."""
    taken = bench.eligible(cases)
    merged = files.merge_table(taken, keys).select(*keys, F.col("is_clean").alias("ours_clean"), "content")
    lines = files.line_merge_table(taken, keys).select(*keys, (F.col("n_conflicts") == 0).alias("line_clean"))
    human = taken.select(*keys, (F.col("human") if "human" in cases.columns else F.lit(None).cast("string")).alias("human"))
    same = F.coalesce(right_stripped(F.col("content")) == right_stripped(F.col("human")), F.lit(False))
    return merged.join(lines, keys).join(human, keys).select(*keys, "ours_clean", "line_clean", same.alias("matches_human"))


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="trifold")
    args.add_argument("--root")
    commands = args.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    add("setup")
    one = add("preview")
    one.add_argument("branch")
    one.add_argument("--file")
    one = add("status")
    one.add_argument("--file")
    one.add_argument("--agent")
    for name in ("claim", "release"):
        one = add(name)
        for word in ("agent_id", "file_path", "entity_name"):
            one.add_argument(word)
    add("bench").add_argument("cases", help="JSON lines of file_path, base, ours, theirs")
    one = add("bench-repo")
    one.add_argument("--limit", type=int, default=500)
    one.add_argument("--save")
    one = add("summary")
    one.add_argument("file")
    got = args.parse_args(argv)
    got.root = got.root or git.discover_root(getattr(got, "file_path", None))

    if got.command == "setup":
        setup(got.root)
        return 0
    if got.command == "summary":
        for row in parse(Path(got.file).read_text(encoding="utf-8")):
            print(json.dumps(dict(zip(("entity", "kind", "complexity", "confidence", "hint"), row))))
        return 0
    spark = session()
    if got.command == "preview":
        merged = api.preview_merge(spark, got.root, "HEAD", got.branch)
        merged = merged.filter(F.col("file_path") == got.file) if got.file else merged
        show(merged.select("file_path", "is_clean", "confidence", F.size("conflicts").alias("conflicts")))
        show(files.preview(merged))
    elif got.command == "bench":
        cases = spark.read.json(got.cases).withColumn("case", F.monotonically_increasing_id())
        show(bench.false_conflict_reduction(compared(cases, ["case"])))
    elif got.command == "bench-repo":
        found = compared(git.replayed(spark, got.root, got.limit), ["commit", "file_path"])
        if got.save:
            git.save_cases(bench.categories(found), got.save)
        show(bench.matrix(found))
    else:
        w = workspace(spark, got.root)
        if got.command == "status":
            agents = state.agent_status(w.log())
            show(api.status(w, got.file) if got.file else agents.filter(F.col("agent_id") == got.agent) if got.agent else agents)
        else:
            act = api.claim_entity if got.command == "claim" else api.release_entity
            show(act(w, got.agent_id, got.file_path, got.entity_name, int(time.time() * 1000)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
