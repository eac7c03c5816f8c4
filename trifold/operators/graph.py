"""Dependency graphs as edge tables (src depends on dst)."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trifold.storage import drop_shared, shared_dir, write_shared


def dependencies(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("src")).join(edges, "src").distinct()


def dependents(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.join(entities.select(F.col("id").alias("dst")), "dst").select("src", "dst").distinct()


def resolve_name(entities: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    """Entities of a name: those in file_path, or, where it has none, those in any file."""
    named = entities.filter(F.col("name") == name)
    if file_path is None:
        return named
    exact = named.filter(F.col("file_path") == file_path)
    return exact if not exact.isEmpty() else named


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, depth): entities that depend on the starts, directly or not, with the fewest steps.

    A frontier moves one step a round and only over entities not yet seen, so
    cycles end. The edges are written once, and each frontier once, into one table of
    all that was seen.
    """
    spark = edges.sparkSession
    stored = write_shared(edges.select("src", "dst"), "edges")
    edges = spark.read.schema(edges.select("src", "dst").schema).parquet(stored)
    table = f"{shared_dir(spark)}/reach-{uuid.uuid4().hex}"
    schema = starts.select("id", F.lit(0).alias("depth")).schema
    part = lambda depth: spark.read.schema(schema).parquet(f"{table}/round-{depth:06d}")
    starts.select("id", F.lit(0).alias("depth")).distinct().write.parquet(f"{table}/round-{0:06d}")
    for depth in itertools.count(1):
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(table)
        step = edges.join(part(depth - 1).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        found = Observation()
        new = step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)).observe(found, F.count(F.lit(1)).alias("n"))
        new.write.parquet(f"{table}/round-{depth:06d}")
        if not found.get["n"]:
            drop_shared(spark, stored)
            return seen.filter("depth > 0")


def validate(edges: DataFrame, modified: DataFrame) -> DataFrame:
    """One row per edge both of whose ends were modified: entity (src) and what it references (dst)."""
    ids = modified.select("id").distinct()
    found = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return found.select("src", "dst").distinct().filter("src <> dst")


def warning_text(kind, entity_type, name, related_type, related):
    """The sentence for a warning."""
    middle = F.when(kind == "dependency_also_modified", "references").otherwise("is used by")
    plain = F.format_string("warning: %s `%s` was modified and %s %s `%s` which was also modified", entity_type, name, middle, related_type, related)
    failed = F.format_string("warning: merged output for `%s` failed to parse — result may be syntactically broken", name)
    return F.when(kind == "parse_failed_after_merge", failed).otherwise(plain)


def build_edges(entities: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(src, dst) where the content of src names the entity dst; an entity's own members and parent don't count.

    `entities` is files.entity_table. A name means the entity of that name in the
    same file, else one in a file that this file imports (`imports`: file_path,
    imported), else the only one of that name anywhere; a name that many files
    define is no reference, so a common word makes no row for each pair of its uses
    and namesakes.
    """
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    named = entities.select("entity_id", "file_path", F.coalesce("parent_id", F.lit("")).alias("parent"), F.col("name").alias("own"), F.explode(words).alias("name")).filter("name <> own")
    targets = entities.select(F.col("entity_id").alias("dst"), "file_path", "name", F.coalesce("parent_id", F.lit("")).alias("dst_parent"))
    of_file = targets.select("file_path", "name").distinct()
    ends = ["entity_id", "parent", "dst", "dst_parent"]
    found = named.join(targets, ["file_path", "name"]).select(*ends)
    elsewhere = named.join(of_file, ["file_path", "name"], "left_anti")
    if imports is not None:
        there = targets.withColumnRenamed("file_path", "imported")
        seen = elsewhere.join(imports.select("file_path", "imported").distinct(), "file_path").join(there, ["imported", "name"])
        found = found.union(seen.select(*ends))
        elsewhere = elsewhere.join(seen.select("file_path", "name").distinct(), ["file_path", "name"], "left_anti")
    only = targets.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("dst"), F.first("dst_parent").alias("dst_parent")).filter("n = 1")
    found = found.union(elsewhere.join(only, "name").select(*ends))
    return found.filter("entity_id <> dst and parent <> dst and dst_parent <> entity_id").select(F.col("entity_id").alias("src"), "dst").distinct()
