"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search.

An item with n distinct word shingles is contained at `percent` if at least
need = ceil(percent * n / 100) of them occur in a document. Its signature is the
n - need + 1 least of its shingle hashes (bottom-k MinHash): by the pigeonhole
principle a document that contains the item holds one of those shingles, so the
search misses nothing.

Items are partitioned by size, in powers of two. A document is searched for the
partitions it is large enough to contain, and its own sketch is the shingle
hashes below the ceiling of those partitions (the largest signature hash in
any of them), so small documents carry less and no document carries
hashes that no signature can meet. Sketch hashes are looked up in the
signatures, and the (document, item) pairs found are verified on the exact
shingle strings of the whole text.

Only DataFrame functions are used. Words are runs of letters and digits in
lower case.

Defined results: null or empty texts, and items without words, match nothing; items that repeat a text are
reported each; rows that repeat a doc_id, or have a null one, are verified one by
one and reported once for the id; very long texts are searched whole; an empty table on either side gives no row; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import few_strings, fresh, let, maybe_broadcast
from trifold.storage import Scratch, cut


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hash of each run of `size` words, in order; none for fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<long>"))


def shingle_texts(words: Column, size: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<string>"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and words of the items that have any."""
    return benchmark.select("item_id", word_list(F.col("text")).alias("words")).filter(F.size("words") > 0)


def item_signatures(items: DataFrame, size: int, percent: int) -> DataFrame:
    """item_id, length (of its shingles, in words), n (distinct shingles), need, part (log2 of n), hash: one row per signature hash."""
    words = F.col("words")
    own = shingle_hashes(words, size)
    for k in range(1, size):
        own = F.when(F.size(words) == k, shingle_hashes(words, k)).otherwise(own)
    hashed = items.select("item_id", F.least(F.size(words), F.lit(size)).alias("length"), F.array_sort(F.array_distinct(own)).alias("hashes"))
    sized = hashed.withColumn("n", F.size("hashes")).withColumn("need", F.expr(f"cast((n * {percent} + 99) div 100 as int)"))
    return sized.select("item_id", "length", "n", "need", F.floor(F.log2("n")).cast("int").alias("part"), F.explode(F.slice("hashes", F.lit(1), F.col("n") - F.col("need") + 1)).alias("hash"))


def within(low: int, high: int):
    return lambda h: h.between(low, high)


def document_sketch(words: Column, ceiling: Column, parts: list, size: int) -> Column:
    """Hashes of a document's runs that signatures of items it is large enough for can meet."""
    short = [F.filter(shingle_hashes(words, p["length"]), within(p["floor"], p["ceiling"])) for p in parts if p["length"] < size]
    whole = [F.filter(shingle_hashes(words, size), lambda h: h <= ceiling)] if len(short) < len(parts) else []
    return F.concat(*whole, *short) if short else whole[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per (doc_id, item_id) with containment: n_shingles of the item, n_shared, containment."""
    with Scratch(docs.sparkSession) as hold:
        items = hold.cut(item_words(benchmark), "items")
        signatures = hold.cut(item_signatures(items, size, percent), "item-signatures")
        # one row per shingle length and size partition (at most 36): the fewest words a document needs, and the range of its signatures
        parts = signatures.groupBy("length", "part").agg(F.min("need").alias("need"), F.min("hash").alias("floor"), F.max("hash").alias("ceiling")).orderBy("length", "part").collect()
        if not parts:
            return docs.sparkSession.range(0).select("id", "id", "id", "id", F.lit(0.0)).toDF("doc_id", "item_id", "n_shingles", "n_shared", "containment")
        words = docs.select("doc_id", word_list(F.col("text")).alias("words"))
        held, lowest = F.size("words") - (size - 1), F.lit(-(1 << 63))
        ceiling = F.greatest(lowest, lowest, *[F.when(held >= p["need"], F.lit(p["ceiling"])) for p in parts if p["length"] == size])
        # the outer form, as the optimiser would else evaluate the array once more to filter out empty ones
        probes = words.withColumn("ceiling", ceiling).select("doc_id", F.explode_outer(document_sketch(F.col("words"), F.col("ceiling"), parts, size)).alias("hash"))
        found = probes.join(maybe_broadcast(signatures.select("item_id", "hash"), signatures.count()), "hash").select("doc_id", "item_id").distinct()
        candidates = hold.cut(found, "contained-candidates")

        ids = candidates.select(F.col("doc_id").alias("of")).distinct()
        texts = docs.select("doc_id", "text").join(maybe_broadcast(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
        runs = let(word_list(F.col("text")), lambda w: F.struct(F.array_distinct(shingle_texts(w, size)).alias("has"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("line")))
        whole = texts.select(F.col("doc_id").alias("of"), runs.alias("whole")).select("of", "whole.has", "whole.line")
        short = F.when(F.size("words") < size, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
        sought = items.select("item_id", F.array_distinct(shingle_texts(F.col("words"), size)).alias("shingles"), short.alias("short"))
        of_item = candidates.join(F.broadcast(sought) if few_strings(items.select(F.array_join("words", " ").alias("line")), "line") else sought, "item_id")
        # the items of a document together, so that its shingles move once however many items it may hold
        grouped = of_item.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shingles", "short")).alias("sought"))

        def count(item: Column) -> Column:
            whole_item = item["short"].isNull()
            n = F.when(whole_item, F.size(item["shingles"])).otherwise(1)
            shared = F.when(whole_item, F.size(F.array_intersect(item["shingles"], "has"))).otherwise(F.contains("line", item["short"]).cast("int"))
            return F.struct(item["item_id"].alias("item_id"), n.cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))

        pairs = grouped.join(whole, F.col("doc_id").eqNullSafe(F.col("of")))
        counted = pairs.select("doc_id", F.inline(F.transform("sought", count)))
        kept = counted.filter(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
        leaks = kept.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
        return hold.result(leaks.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6)), "contaminated")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that contain no benchmark item, with their columns."""
    (of,) = fresh(docs, "__gone")
    gone = cut(contaminated(docs, benchmark, size, percent).select(F.col("doc_id").alias(of)).distinct(), "leaks")
    return docs.join(maybe_broadcast(gone, gone.count()), docs["doc_id"].eqNullSafe(gone[of]), "left_anti")


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM item_words WHERE len(w) >= 5
), items AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM doc_words WHERE len(w) >= 5
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s) GROUP BY ALL
), short AS (
  SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM item_words WHERE len(w) BETWEEN 1 AND 4
)
SELECT doc_id, item_id, n AS n_shingles, n_shared, round(n_shared / n, 6) AS containment
FROM shared JOIN items USING (item_id) WHERE 100 * n_shared >= 80 * n
UNION ALL
SELECT DISTINCT doc_id, item_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS DOUBLE)
FROM doc_words JOIN short ON contains(' ' || array_to_string(doc_words.w, ' ') || ' ', short.s)
"""
