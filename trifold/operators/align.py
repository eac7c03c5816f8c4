"""Three-way alignment of rows: one shuffle on the key, then one expression per row.

A row is an entity, its columns are its members: rows that both sides changed
merge when no column was changed differently by both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("base", "ours", "theirs")
CONFLICTS = ("conflict_both_added", "conflict_both_modified", "conflict_modify_delete_ours", "conflict_modify_delete_theirs")


def align(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, in_<side> flags and <side>_<value> columns: a full outer join of the three as a union and one aggregation."""
    tagged = reduce(DataFrame.unionByName, [df.select(*keys, *values, F.lit(s).alias("__side")) for s, df in zip(SIDES, (base, ours, theirs), strict=True)])
    aggregates = []
    for s in SIDES:
        here = F.col("__side") == s
        aggregates.append(F.max(here).alias(f"in_{s}"))
        aggregates += [F.max(F.when(here, F.col(v))).alias(f"{s}_{v}") for v in values]
    return tagged.groupBy(*keys).agg(*aggregates)


def hashed(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The columns replaced by 64-bit hashes, so that alignment for counting aggregates by hash and moves no text."""
    return df.select(*keys, *[F.xxhash64(v).alias(v) for v in values])


def changed(side: str, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"{side}_{v}").eqNullSafe(F.col(f"base_{v}")) for v in values])


def resolution(values: list[str]) -> Column:
    """The class of an aligned row."""
    b, o, t = (F.col(f"in_{s}") for s in SIDES)
    mine, other = changed("ours", values), changed("theirs", values)
    same = reduce(lambda x, y: x & y, [F.col(f"ours_{v}").eqNullSafe(F.col(f"theirs_{v}")) for v in values])
    clash = reduce(
        lambda x, y: x | y,
        [~F.col(f"ours_{v}").eqNullSafe(F.col(f"base_{v}")) & ~F.col(f"theirs_{v}").eqNullSafe(F.col(f"base_{v}")) & ~F.col(f"ours_{v}").eqNullSafe(F.col(f"theirs_{v}")) for v in values],
    )
    every = (
        F.when(~mine & ~other, "unchanged")
        .when(~other, "ours_only")
        .when(~mine, "theirs_only")
        .when(same, "both_same")
        .when(~clash, "field_merged")
        .otherwise("conflict_both_modified")
    )
    return (
        F.when(b & o & t, every)
        .when(b & o, F.when(mine, "conflict_modify_delete_ours").otherwise("deleted_by_theirs"))
        .when(b & t, F.when(other, "conflict_modify_delete_theirs").otherwise("deleted_by_ours"))
        .when(b, "deleted_both")
        .when(o & t, F.when(same, "added_same").otherwise("conflict_both_added"))
        .when(o, "added_ours")
        .otherwise("added_theirs")
    )


def resolved(aligned: DataFrame, values: list[str]) -> DataFrame:
    """aligned with `resolution` and, for rows that stay without conflict, the merged columns (else null)."""
    out = aligned.withColumn("resolution", resolution(values))
    kept = ~(F.startswith("resolution", F.lit("conflict")) | F.startswith("resolution", F.lit("deleted")))
    for v in values:
        o, t, b = (F.col(f"{s}_{v}") for s in ("ours", "theirs", "base"))
        one = F.when(F.col("in_ours") & F.col("in_theirs") & F.col("in_base"), F.when(o.eqNullSafe(b), t).otherwise(o)).otherwise(F.coalesce(o, t))
        out = out.withColumn(v, F.when(kept, one))
    return out


def counters(classes: Column) -> dict[str, Column]:
    """Merge counters, as aggregates over resolution classes."""
    n = lambda *names: F.count_if(classes.isin(*names))
    return {
        "unchanged": n("unchanged"),
        "ours_only": n("ours_only"),
        "theirs_only": n("theirs_only"),
        "both_changed_merged": n("both_same", "field_merged"),
        "added_ours": n("added_ours", "added_same"),
        "added_theirs": n("added_theirs"),
        "deleted": n("deleted_by_ours", "deleted_by_theirs", "deleted_both"),
        "conflicted": n(*CONFLICTS),
    }


def confidence(conflicted: Column, inner: Column, fallback: Column, line_merged: Column) -> Column:
    """conflict, then medium (member-wise merge or fallback), high (line merge), very_high."""
    return F.when(conflicted > 0, "conflict").when((inner > 0) | fallback, "medium").when(line_merged > 0, "high").otherwise("very_high")
