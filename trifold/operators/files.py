"""Whole-file merges over a table (file_path, base, ours, theirs, further columns), and entity tables of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.functions import merge3
from trifold.storage import bound_batches, spread

CONFLICT = "struct<entity_name:string,entity_type:string,kind:string,base:string,ours:string,theirs:string,detail:string>"
STATS = "struct<unchanged:int,ours_only:int,theirs_only:int,both_changed_merged:int,conflicted:int,added_ours:int,added_theirs:int,deleted:int,via_lines:int,via_inner:int,used_fallback:boolean>"
MERGED = f"content string, is_clean boolean, confidence string, conflicts array<{CONFLICT}>, warnings array<string>, stats {STATS}"
ENTITY = "file_path string, ord int, entity_id string, name string, entity_type string, parent_id string, start_line int, end_line int, content string, content_hash string, body_hash string, structural_hash string"

_C = pa.struct([(x, pa.string()) for x in ("entity_name", "entity_type", "kind", "base", "ours", "theirs", "detail")])
_S = pa.struct([(x, pa.int32()) for x in ("unchanged", "ours_only", "theirs_only", "both_changed_merged", "conflicted", "added_ours", "added_theirs", "deleted", "via_lines", "via_inner")] + [("used_fallback", pa.bool_())])
_MERGED = [("content", pa.string()), ("is_clean", pa.bool_()), ("confidence", pa.string()), ("conflicts", pa.list_(_C)), ("warnings", pa.list_(pa.string())), ("stats", _S)]


def merge_table(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the merge of each row. Trivial rows (a side equals another) never reach Python."""
    bound_batches(files.sparkSession)
    read = ("file_path", "base", "ours", "theirs")
    text = files.select(*[k for k in keys if k not in read], *[F.coalesce(c, F.lit("")).alias(c) for c in read])
    trivial = (F.col("ours") == F.col("theirs")) | (F.col("base") == F.col("ours")) | (F.col("base") == F.col("theirs"))
    kept = F.when((F.col("ours") == F.col("theirs")) | (F.col("base") == F.col("theirs")), F.col("ours")).otherwise(F.col("theirs"))
    mine = ((F.col("base") == F.col("theirs")) & (F.col("ours") != F.col("theirs"))).cast("int")
    other = ((F.col("base") == F.col("ours")) & (F.col("ours") != F.col("theirs"))).cast("int")
    zero = F.lit(0)
    stats = F.struct(zero.alias("unchanged"), mine.alias("ours_only"), other.alias("theirs_only"), *[zero.alias(x) for x in ("both_changed_merged", "conflicted", "added_ours", "added_theirs", "deleted", "via_lines", "via_inner")], F.lit(False).alias("used_fallback"))
    easy = text.filter(trivial).select(*keys, kept.alias("content"), F.lit(True).alias("is_clean"), F.lit("very_high").alias("confidence"), F.array().cast(f"array<{CONFLICT}>").alias("conflicts"), F.array().cast("array<string>").alias("warnings"), stats.alias("stats"))
    hard = text.filter(~trivial)
    kinds = ", ".join(f"`{k}` {hard.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trifold.functions.file_merge import merge_files

        for b in batches:
            rows = [merge_files(base, ours, theirs, path).row() for base, ours, theirs, path in zip(*(b[c].to_pylist() for c in ("base", "ours", "theirs", "file_path")), strict=True)]
            made = [pa.array([r[name] for r in rows], kind) for name, kind in _MERGED]
            yield pa.RecordBatch.from_arrays([b[k] for k in keys] + made, keys + [n for n, _ in _MERGED])

    return easy.unionByName(spread(hard.select(*dict.fromkeys([*keys, *read]))).mapInArrow(run, f"{kinds}, {MERGED}"))


def line_merge_table(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, merged and n_conflicts of the plain line merge."""
    bound_batches(files.sparkSession)
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [merge3.merge(*x) for x in zip(*(b[c].to_pylist() for c in ("base", "ours", "theirs")), strict=True)]
            yield pa.RecordBatch.from_arrays([b[k] for k in keys] + [pa.array([x.text for x in found], pa.string()), pa.array([x.conflicts for x in found], pa.int32())], [*keys, "merged", "n_conflicts"])

    text = files.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "ours", "theirs")])
    return spread(text).mapInArrow(run, f"{kinds}, merged string, n_conflicts int")


def entity_table(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """One row per entity of each file, in file order."""
    bound_batches(files.sparkSession)
    names = [x.split(" ")[0] for x in ENTITY.split(", ")]
    numbers = {"ord", "start_line", "end_line"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trifold.functions.parsers import extract_entities

        for b in batches:
            rows = []
            for file_path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                for n, e in enumerate(extract_entities(text or "", file_path or "")):
                    rows.append((file_path, n, e.entity_id, e.name, e.entity_type, e.parent_id, e.start_line, e.end_line, e.content, e.content_hash, e.body_hash, e.structural_hash))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in numbers else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    return spread(files.select(F.col(path).alias("path"), F.col(content).alias("text"))).mapInArrow(run, ENTITY)


def region_table(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """file_path, ord, kind (entity or gap), key, content: the regions of each file; joined in order they are the file."""
    bound_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trifold.functions.parsers import extract_entities, extract_regions

        for b in batches:
            rows = []
            for file_path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                for n, r in enumerate(extract_regions(text or "", extract_entities(text or "", file_path or ""))):
                    rows.append((file_path, n, r.kind, r.key, r.content))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.string()) for k, c in enumerate(columns)], ["file_path", "ord", "kind", "key", "content"])

    return spread(files.select(F.col(path).alias("path"), F.col(content).alias("text"))).mapInArrow(run, "file_path string, ord int, kind string, key string, content string")


def separators(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, expanded (separators on lines of their own) and collapsed (that undone)."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trifold.functions.file_merge import collapse_separators, expand_separators

        for b in batches:
            expanded = [expand_separators(x or "") for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(expanded, pa.string()), pa.array(list(map(collapse_separators, expanded)), pa.string())], ["key", "expanded", "collapsed"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, expanded string, collapsed string").withColumnRenamed("key", key)


def preview(merged: DataFrame) -> DataFrame:
    """One row: files analysed, clean, conflicted, auto-resolved, and the least confidence."""
    order = F.when(F.col("confidence") == "conflict", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "high", 2).otherwise(3)
    least = F.min(order)
    return merged.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("is_clean").alias("clean"),
        F.count_if(~F.col("is_clean")).alias("conflicted"),
        F.sum(F.col("stats.both_changed_merged").cast("long")).alias("auto_merged"),
        F.when(least == 0, "conflict").when(least == 1, "medium").when(least == 2, "high").otherwise("very_high").alias("confidence"),
    )
