"""Operator 2: shards as runs of a Hilbert curve over quantised metadata.

Each metadata dimension becomes a small integer: numbers by quantile, strings by
the rank of the whole string among the distinct ones, which keeps their order.
The Hilbert index of that cell orders the rows, and equal runs of the order are
the shards, so each shard covers a compact box of every dimension and minimum
and maximum statistics of its file prune well on any of them.

The order is global but nothing is sorted globally: cells are counted, a cell of
many rows is dealt to as many salts as its count asks for, rows are counted per
(cell, salt), the counts get running sums in two levels (at most
2 ** (dims * bits) rows meet in one task), and a row's rank is its count's
offset plus its place among the rows of its own (cell, salt). Texts are read
once, for their size and crc; every later pass reads a small stored table.

Law: ``rows``; shard counts differ by one at most. Defined results: null text
has no bytes; null metadata takes the lowest level; rows that repeat a doc_id
are rows of their own (ties end in the crc of the text); the general form takes
rows without columns hilbert, shard and slot; very long texts count by their size;
an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trifold.llm.common import fresh, quantile_splits, range_bucket
from trifold.storage import Scratch, cut


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points (n, dims) with `bits` bits in each coordinate (Skilling's transform)."""
    x = [np.array(c, np.int64) for c in cells.T]
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        p = q - 1
        for i in range(dims):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_bit, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for one in x:
            index = (index << 1) | (((one ^ flip) >> b) & 1)
    return index


def string_splits(rows: DataFrame, name: str, buckets: int) -> list[str]:
    """At most buckets - 1 increasing strings that cut the distinct values into runs of equal counts."""
    ordered = rows.select(F.coalesce(F.col(name), F.lit("")).alias("value")).distinct().orderBy("value")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = cut(ordered.select("value", F.spark_partition_id().alias("part"), place.alias("place")), "distinct-values")
    begins, n = {}, 0
    for part, count in sorted(held.groupBy("part").count().collect()):
        begins[part], n = n, n + count
    wanted = sorted({i * n // buckets for i in range(1, buckets)} - {0})
    part_of = lambda rank: max((b, p) for p, b in begins.items() if b <= rank)
    keys = [(p, rank - b) for rank in wanted for b, p in [part_of(rank)]]
    found = [(F.col("part") == p) & (F.col("place") == at) for p, at in keys]
    return sorted((r.value for r in held.filter(functools.reduce(Column.__or__, found)).collect()), key=str.encode) if found else []


def string_level(column: Column, splits: list[str]) -> Column:
    """Number of splits that are <= column; null counts as the empty string."""
    return functools.reduce(Column.__add__, [(F.coalesce(column, F.lit("")) >= s).cast("int") for s in splits], F.lit(0))


def hilbert_shards(rows: DataFrame, dimensions: list[str], tie: list[str], shards: int, bits: int = 4, salt_rows: int = 50_000) -> DataFrame:
    """Add hilbert (long), shard (int) and slot (long) to rows; `tie` columns order the rows of one cell. `rows` should be stored."""
    if len(dimensions) * bits > 20:
        raise ValueError("at most 20 bits of cells, so that their counts stay few")
    levels = []
    for name in dimensions:
        if isinstance(rows.schema[name].dataType, T.StringType):
            levels.append(string_level(F.col(name), string_splits(rows, name, 1 << bits)))
        else:
            code = F.col(name).cast("double")
            levels.append(range_bucket(code, quantile_splits(rows.select(code.alias("code")), "code", 1 << bits)))

    @F.pandas_udf("long")
    def curve(cell: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cell.to_numpy(), bits))

    own = fresh(rows, *[f"h{i}" for i in range(len(levels))])
    salt, n, whole, base, total, offset, place = fresh(rows, "salt", "n", "whole", "base", "total", "offset", "place")
    placed = rows.withColumns(dict(zip(own, levels, strict=True)))
    placed = placed.withColumn("hilbert", curve(F.struct(*own))).drop(*own)

    earlier = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("hilbert").agg(F.count(F.lit(1)).alias(whole))
    all_rows = F.sum(whole).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cells = cells.select("hilbert", whole, F.coalesce(F.sum(whole).over(earlier), F.lit(0)).alias(base), all_rows.alias(total))
    # at most 2 ** 20 rows of four numbers
    salts = F.ceil(F.col(whole) / salt_rows)
    placed = placed.join(F.broadcast(cells), "hilbert").withColumn(salt, F.pmod(F.xxhash64(*tie), salts).cast("int")).drop(whole)

    counts = placed.groupBy("hilbert", salt, base).agg(F.count(F.lit(1)).alias(n))
    inside = Window.partitionBy("hilbert").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("hilbert", salt, (F.col(base) + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(offset))

    in_group = F.row_number().over(Window.partitionBy("hilbert", salt).orderBy(*tie)) - 1
    ranked = placed.withColumn(place, in_group).join(offsets, ["hilbert", salt])
    rank = F.col(offset) + F.col(place)
    # shard s begins at rank ceil(s * total / shards)
    ranked = ranked.withColumn("shard", F.expr(f"cast(((`{offset}` + `{place}`) * {shards}) div `{total}` as int)"))
    first = F.expr(f"(shard * `{total}` + {shards} - 1) div {shards}")
    return ranked.withColumn("slot", rank - first).drop(salt, offset, place, total, base)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    with Scratch(docs.sparkSession) as hold:
        small = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
        placed = hilbert_shards(hold.cut(small, "sizes"), ["size", "lang", "source"], ["doc_id", "text_crc32"], shards)
        found = placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
        return hold.result(found, "shards")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write whole documents into one folder per shard, in Hilbert order. Needs unique doc_id."""
    placed = docs.join(shard_documents(docs, shards).select("doc_id", "shard", "slot", "hilbert"), "doc_id")
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
