"""Operators on entity tables: differences, renames, nesting, guards, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def semantic_diff(before: DataFrame, after: DataFrame, key: str, content_hash: str) -> DataFrame:
    """key, change: added, modified or deleted; unchanged entities give no row.

    Contents are compared by a 64-bit hash, a null content as one that differs from all others.
    """
    h = F.when(F.col(content_hash).isNotNull(), F.xxhash64(content_hash))
    side = lambda x, n: x.select(key, *[(h if k == n else F.lit(None).cast("long")).alias(f"h{k}") for k in (1, 2)], F.lit(n).alias("side"))
    one = side(before, 1).unionByName(side(after, 2)).groupBy(key).agg(F.max("h1").alias("b"), F.max("h2").alias("a"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    change = F.when(F.col("lo") == 2, "added").when(F.col("hi") == 1, "deleted").when(~F.col("b").eqNullSafe(F.col("a")), "modified")
    return one.select(key, change.alias("change")).filter("change is not null")


def diff_with_renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity_id, change, was: as semantic_diff, but an entity that took a gone one's body is `renamed`, and `was` names that.

    Both tables have entity_id, ord, content_hash, body_hash and structural_hash.
    """
    changed = semantic_diff(before, after, "entity_id", "content_hash")
    moved = renames(before, after)
    told = changed.join(moved.select(F.col("branch_id").alias("entity_id"), F.col("base_id").alias("was")), "entity_id", "left")
    told = told.join(moved.select(F.col("base_id").alias("entity_id")), "entity_id", "left_anti")
    return told.select("entity_id", F.when(F.col("was").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "was")


def renames(base: DataFrame, branch: DataFrame) -> DataFrame:
    """(branch_id, base_id) from tables of entity_id, ord, body_hash, structural_hash.

    A branch entity new by id takes the last base entity of its body hash, or, only
    where that finds nothing, of its structural hash. The base id must be gone from
    the branch, and the first branch entity of each base id wins.
    """
    last = lambda c: base.groupBy(c).agg(F.max_by("entity_id", "ord").alias(f"by_{c}"))
    new = branch.join(base.select("entity_id"), "entity_id", "left_anti")
    found = new.join(last("body_hash"), "body_hash", "left").join(last("structural_hash"), "structural_hash", "left")
    hit = found.select(F.col("entity_id").alias("branch_id"), "ord", F.coalesce("by_body_hash", "by_structural_hash").alias("base_id")).filter("base_id is not null")
    gone = hit.join(branch.select(F.col("entity_id").alias("base_id")), "base_id", "left_anti")
    return gone.groupBy("base_id").agg(F.min_by("branch_id", "ord").alias("branch_id")).select("branch_id", "base_id")


def rename_conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """base_id, ours_id, theirs_id: one base entity under two new names."""
    both = ours.select("base_id", F.col("branch_id").alias("ours_id")).join(theirs.select("base_id", F.col("branch_id").alias("theirs_id")), "base_id")
    return both.filter("ours_id <> theirs_id")


def outermost(entities: DataFrame, group: list[str]) -> DataFrame:
    """Entities that no other of their group strictly contains: a running maximum over distinct ranges, not a range join."""
    before = Window.partitionBy(*group).orderBy("start_line", F.col("end_line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = entities.select(*group, "start_line", "end_line").distinct()
    free = ranges.withColumn("reach", F.max("end_line").over(before)).filter("reach is null or reach < end_line").drop("reach")
    return entities.join(free, [*group, "start_line", "end_line"], "left_semi")


def excessive_duplicates(entities: DataFrame, group: list[str], name: str, limit: int = 5) -> DataFrame:
    """group, most: groups in which a name occurs `limit` times or more."""
    return entities.groupBy(*group, name).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.max("n").alias("most")).filter(F.col("most") >= limit)


def last_content(regions: DataFrame, key: list[str], order: str, content: str) -> DataFrame:
    """The content of the last region of each key."""
    return regions.groupBy(*key).agg(F.max_by(content, order).alias(content))


def join_lines(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """key, content: the lines of each key in order, each ended by a newline."""
    inside = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(line).alias("line"))))
    return lines.groupBy(*key).agg(inside.alias("all")).select(*key, F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def predecessors(entities: DataFrame, group: list[str], order: str, entity: str) -> DataFrame:
    """The entity before each one in file order; null for the first."""
    return entities.withColumn("predecessor", F.lag(entity).over(Window.partitionBy(*group).orderBy(order)))


def changed_in_both(ours: DataFrame, theirs: DataFrame, path: str = "file") -> DataFrame:
    return ours.select(path).intersect(theirs.select(path))


def modified_by_name(before: DataFrame, after: DataFrame, keys: list[str], content_hash: str) -> DataFrame:
    """Distinct keys of entities in `after` that are new or changed; deletions don't count."""
    old = before.select(*keys, F.col(content_hash).alias("__old"))
    found = after.join(old, keys, "left").filter(F.col("__old").isNull() | (F.col("__old") != F.col(content_hash)))
    return found.select(*keys).distinct()
