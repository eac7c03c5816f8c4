"""Summaries of merge comparisons: (case columns) ours_clean, line_clean, matches_human."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File endings that the comparison over real history looks at.
COMPARED_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".c", ".cpp", ".cc", ".h", ".hpp", ".rb", ".cs"]


def eligible(cases: DataFrame) -> DataFrame:
    """Rows of (file_path, base, ours, theirs) that a comparison uses."""
    ends = F.lit(False)
    for e in COMPARED_ENDINGS:
        ends = ends | F.endswith("file_path", F.lit(e))
    whole = F.concat("base", "ours", "theirs")
    return cases.filter(ends & (F.octet_length("base") <= 1_000_000) & (F.locate("\0", whole) == 0) & (F.col("ours") != F.col("theirs")))


def categories(cases: DataFrame) -> DataFrame:
    mine, line = F.col("ours_clean"), F.col("line_clean")
    kind = F.when(mine & line, "both_clean").when(mine, "win").when(line, "regression").otherwise("both_conflict")
    return cases.withColumn("category", kind)


def matrix(cases: DataFrame) -> DataFrame:
    """One row: tested, the four categories, human matches among wins, and both rates (0 where undefined)."""
    n = lambda k: F.count_if(F.col("category") == k)
    counts = categories(cases).agg(
        F.count(F.lit(1)).alias("tested"), n("both_clean").alias("both_clean"), n("win").alias("wins"), n("both_conflict").alias("both_conflict"),
        n("regression").alias("regressions"), F.count_if((F.col("category") == "win") & F.col("matches_human")).alias("matches_human"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({"resolution_rate": rate(F.col("wins"), F.col("wins") + F.col("both_conflict")), "human_match_rate": rate(F.col("matches_human"), F.col("wins"))})


def false_conflict_reduction(cases: DataFrame) -> DataFrame:
    """One row: clean merges of either kind and the share of line-merge conflicts that went away."""
    out = cases.agg(F.count(F.lit(1)).alias("scenarios"), F.count_if("ours_clean").alias("ours_clean"), F.count_if("line_clean").alias("line_clean"), F.count_if(F.col("ours_clean") & ~F.col("line_clean")).alias("gone"))
    return out.withColumn("reduction", F.coalesce(F.try_divide(F.col("gone"), F.col("scenarios") - F.col("line_clean")), F.lit(0.0))).drop("gone")
