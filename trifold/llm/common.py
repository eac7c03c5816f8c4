"""Helpers shared by the training-data operators: tables, bounded broadcasts, order-preserving buckets."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast; with rows of a few numbers this is some 10 MB.
BROADCAST_ROWS = 200_000
#: Bytes that the strings of such a side may have.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df, whose rows are a few numbers, if its counted rows are within BROADCAST_ROWS; else the planner shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def few_strings(df: DataFrame, column: str) -> bool:
    """Whether df, which has one column of strings, is small enough to be broadcast, by rows and bytes."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def quantile_splits(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most buckets - 1 increasing split points that cut the column into runs of about equal counts."""
    if buckets <= 1:
        return []
    got = df.approxQuantile(column, [i / buckets for i in range(1, buckets)], min(0.01, 0.25 / buckets))
    return sorted(set(got))


def range_bucket(column: Column, splits: list[float]) -> Column:
    """Number of splits that are <= column, by binary search; null goes to bucket 0. Monotone in the column."""
    if not splits:
        return F.lit(0)
    depth = len(splits).bit_length()
    held = F.array(*[F.lit(float(s)) for s in splits])
    value = column.cast("double")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(depth))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: a lambda variable holds it, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column so called (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def salted(count: int, *columns: Column) -> Column:
    """A repeatable group number below count: a hash of key columns, so a retried task makes the same groups."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def release_memory() -> None:
    """Give freed memory of this Python worker back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches by bytes as well as by rows, so that very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
