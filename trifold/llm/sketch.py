"""Operator 8: threshold-scaled document fingerprints.

A fingerprint keeps every word-shingle hash below 1/scale of the hash range, the
same fixed fraction for all documents, and the least hash always, so that a
short document keeps one. Hashes are unsigned 32-bit numbers.

Fingerprints merge: the union of two, less those hashes that are neither below
the threshold nor the least, is the fingerprint of both documents together. Of
very unequal documents `containment` tells how much of the smaller lies in the
larger. Likeness is |A & B| / |A | B| of the hashes below the threshold, an
unbiased-to-O(1/n) estimate of the Jaccard similarity of the full sets; where no
hash lies below it, it is whether the least hashes are equal, and 1 for two
texts without words.

The next document in descending doc_id order is found without a global sort:
documents go to runs of doc_id by quantile borders, each run is one window
partition, and a copy of the next run's first document closes each run. Texts
move once; sketches are made where they land.

Only DataFrame functions are used. Defined results: null is the empty text; a
text of fewer words than a shingle has the whole sequence as its one shingle;
a text without words has no hash; rows that share a doc_id are ordered by text;
null doc_ids come last; a table of one row is its own next document; very long
texts are read whole; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trifold.llm.common import let, maybe_broadcast, quantile_splits, range_bucket
from trifold.storage import cut

#: One of so many hashes is kept.
SCALE = 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s]+"), lambda w: w != "")


def threshold(scale: int) -> int:
    return (1 << 32) // scale


def below(sketch: Column, scale: int) -> Column:
    return F.filter(sketch, lambda h: h < threshold(scale))


def sketch_of(words: Column, size: int = 5, scale: int = SCALE) -> Column:
    """Sorted distinct unsigned 32-bit hashes of the shingles that the threshold keeps, and the least."""
    runs = F.size(words) - (size - 1)
    each = F.transform(F.sequence(F.lit(0), F.greatest(runs - 1, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + j) for j in range(size)]), 32))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(words), 32))
    shingles = F.when(runs > 0, each).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<long>"))
    return let(shingles, lambda s: kept(s, scale))


def kept(hashes: Column, scale: int) -> Column:
    least = F.array_min(hashes)
    small = F.array_sort(F.array_distinct(below(hashes, scale)))
    return F.when(least >= threshold(scale), F.array(least)).otherwise(small)


def fingerprint(sketch: Column) -> Column:
    """8 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    x, y = below(a, scale), below(b, scale)
    every = F.size(F.array_union(x, y))
    shared = F.size(x) + F.size(y) - every
    return F.when(every > 0, shared / every).otherwise((a == b).cast("double"))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has."""
    x = below(a, scale)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, below(b, scale))) / F.size(x)).otherwise((a == b).cast("double"))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both documents' shingles together."""
    return kept(F.array_union(a, b), scale)


def runs_of(docs: DataFrame, run_rows: int, most: int) -> Column:
    """A number for each doc_id that grows with it, shared by about run_rows rows.

    Up to `most` quantile borders are held in the plan; where there are more rows, each
    stretch between borders is cut into equal steps of doc_id. Null comes first.
    """
    rows, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    buckets = max(1, min(most, rows // run_rows))
    splits = quantile_splits(docs, "doc_id", buckets)
    bucket = range_bucket(F.col("doc_id"), splits).cast("long")
    steps = max(1, rows // (buckets * run_rows))
    if steps == 1 or low is None:
        return bucket
    borders = [low, *map(int, splits), high + 1]
    begin, width = (F.get(F.array(*[F.lit(x) for x in held]), bucket.cast("int")) for held in (borders[:-1], [max(1, -(-(hi - lo) // steps)) for lo, hi in zip(borders, borders[1:])]))
    step = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((F.col("doc_id") - begin) / width))), F.lit(0))
    return bucket * steps + step


def with_next(docs: DataFrame, run_rows: int = 2000, most: int = 16384) -> DataFrame:
    """doc_id, text and sketch with next_text and next_sketch of the document before in doc_id."""
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    placed = plain.withColumn("run", runs_of(plain.select("doc_id"), run_rows, most))
    # first document of each run: one row of two numbers each, then their texts
    firsts = placed.groupBy("run").agg(F.max("doc_id").alias("doc_id"))
    order = Window.orderBy("run")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closes = firsts.select(F.col("doc_id").alias("first_id"), F.coalesce(F.lead("run").over(order), F.min("run").over(every)).alias("closed"))
    closes = cut(closes, "run-ends")
    ends = placed.join(maybe_broadcast(closes, closes.count()), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("closed").agg(F.min("text").alias("text"))
    ends = ends.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("closed").alias("run"), F.lit(True).alias("end"))
    rows = placed.withColumn("end", F.lit(False)).unionByName(ends)
    dealt = rows.repartition("run")  # before the sketches, which the window then finds in place
    sketched = dealt.withColumn("words", words_of(F.col("text"))).select("run", "end", "doc_id", "text", sketch_of(F.col("words")).alias("sketch"))
    follows = Window.partitionBy("run").orderBy("end", F.col("doc_id").desc_nulls_last(), "text")
    moved = sketched.withColumns({f"next_{c}": F.lead(c).over(follows) for c in ("text", "sketch")})
    return moved.filter(~F.col("end")).drop("end", "run")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_next.

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones of the next document.
    """
    new = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - new), F.substring("next_text", F.lit(1), new))
    edited = with_next(docs).withColumn("edited", edited)
    both = edited.withColumn("words", words_of(F.col("edited"))).select("*", sketch_of(F.col("words")).alias("edited_sketch"))
    c = F.col
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(c("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(c("sketch")).alias("fingerprint"),
        fingerprint(c("edited_sketch")).alias("edited_fingerprint"),
        likeness(c("sketch"), c("edited_sketch")).alias("near_edited"),
        likeness(c("sketch"), c("next_sketch")).alias("near_next"),
        containment(c("sketch"), c("next_sketch")).alias("in_next"),
    )
