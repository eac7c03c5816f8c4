"""Word features that both classifiers share: hashed words, a frequency-pruned hash vocabulary, labelled rows and samples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import BROADCAST_ROWS

_WORD = re.compile(rb"[a-z\x80-\xff]+").findall


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, modulo folds, is `fold`; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-cased runs of letters, in order."""
    found = _WORD((text or "").lower().encode("utf-8"))
    return np.fromiter(map(crc32, found), np.uint32, len(found))


class Vocabulary:
    """Hashes that occur in at least `least` of the training documents, numbered from 1; 0 is any other word."""

    def __init__(self, documents: list[np.ndarray], least: int, most: int):
        each = np.concatenate([np.unique(d) for d in documents]) if documents else np.empty(0, np.uint32)
        hashes, counts = np.unique(each, return_counts=True)
        kept = np.flatnonzero(counts >= least)
        kept = kept[np.argsort(-counts[kept], kind="stable")[:most]]
        self.hashes = np.sort(hashes[kept])

    @classmethod
    def counted(cls, words: DataFrame, least: int, most: int) -> Vocabulary:
        """The vocabulary of all rows of `words`, whose binary column `words` holds a document's hashes, counted by Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [np.unique(np.frombuffer(w, np.uint32)) for w in batch["words"].to_pylist()]
                if each:
                    hashes, counts = np.unique(np.concatenate(each), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts)], ["hash", "n"])

        total = words.select("words").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        kept = total.filter(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(most).select("hash").toArrow()
        found = cls([], least, most)
        found.hashes = np.sort(kept["hash"].to_numpy().astype(np.uint32))
        return found

    def __len__(self) -> int:
        return len(self.hashes) + 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


#: Bits of the map that may_hold broadcasts, 4 MB, however many ids there are.
MAP_BITS = 1 << 25
_RUN = 1 << 15


def may_hold(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of the rows whose doc_id is not among ids, and with all others, by a bit map of hashes; docs are not moved."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    maps = ids.groupBy((bit / _RUN).cast("int").alias("__run")).agg(F.bitmap_construct_agg(bit % _RUN).alias("__bits"))
    at = (bit % _RUN).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = docs.withColumn("__of", (bit / _RUN).cast("int")).join(F.broadcast(maps), F.col("__of") == F.col("__run"))
    return joined.filter(F.getbit(byte, at % 8) == 1).drop("__of", "__run", "__bits")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, out: Column, keep: list[str]) -> tuple[DataFrame, int]:
    """All rows of docs with a label of 0 or 1 that are not held out: doc_id, text, label and `keep`; and the number of such labels.

    Beyond BROADCAST_ROWS labels, only the texts of documents that may have one move.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~out)
    ids = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = ids.count()
    texts = docs.select("doc_id", "text", *keep)
    few = n <= BROADCAST_ROWS
    return (texts if few else may_hold(texts, ids)).join(F.broadcast(ids) if few else ids, "doc_id"), n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, out: Column, limit: int, keep: list[str]) -> pa.Table:
    """At most `limit` labelled training documents of each label value, by the order of a hash of doc_id.

    The sample's ids are at most 2 * limit rows, so they are broadcast and only the sample's texts move.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~out)
    each = [usable.filter(F.col("label") == v).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for v in (0, 1)]
    ids = each[0].union(each[1]).withColumnRenamed("doc_id", "labelled")
    joined = docs.select("doc_id", "text", *keep).join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))
    # an id that repeats gives one row, so that the driver holds 2 * limit texts at most
    first = joined.groupBy("doc_id").agg(F.min(F.struct("text", "label", *keep)).alias("row"))
    return first.select("doc_id", "row.*").orderBy("doc_id").toArrow()


def prior_weights(labels: np.ndarray, share: float) -> np.ndarray:
    """Weights that give label 1 its share among all labelled rows, whatever the sample's."""
    have = labels.mean() if len(labels) else 0.5
    if not 0 < have < 1 or not 0 < share < 1:
        return np.ones(len(labels))
    return np.where(labels == 1, share / have, (1 - share) / (1 - have))


def share_of_ones(labels: DataFrame, label: str, out: Column) -> float:
    row = labels.filter(F.col(label).isin(0, 1) & ~out).agg(F.avg(F.col(label).cast("double"))).first()
    return row[0] if row[0] is not None else 0.5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
