"""Operator 7: token ids in fixed-width bit-packed files with block offsets.

One file ("segment") holds the ids of whole consecutive documents:

    header   7 little-endian int64: magic, version, width, block_ids, n_docs, n_ids, n_blocks
    doc_ids  n_docs int64
    starts   n_docs + 1 int64: place of each document's first id in the segment; the last is n_ids
    offsets  n_blocks + 1 int64: byte where each block of block_ids ids begins, from the payload's start
    payload  ids of `width` bits, lowest bit first, in little-endian 64-bit words

`width` is the fewest bits that hold the largest id of the vocabulary. 64 ids
fill exactly `width` words, so packing and unpacking are `width`-many shifts
over whole numpy columns, and any block can be unpacked alone.

Segments are written as the rows of a Parquet table in the shared folder (one
row, one file image), because executors share nothing but what Spark can write:
every store that Spark reaches can hold them, and a retried task leaves no half
file. `export_segments` copies the images out as plain files.

Defined results: null text is the empty text; an empty document holds the end
id alone; rows that share a doc_id are separate documents, ordered by a hash of
the text and then the text; a null doc_id comes first and is stored as the least
int64; a very long text makes one long segment; an empty table gives no segment;
further columns of the input are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trifold.llm.common import bound_batches, maybe_broadcast, release_memory
from trifold.llm.tokens import encoder, forget_encoder
from trifold.storage import cut, drop_shared, write_shared

MAGIC, VERSION, BLOCK_IDS = 0x54464249, 1, 4096
NO_ID = -(1 << 63)


def bit_width(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """ids -> uint64 words; the last group of 64 is padded with zeros."""
    groups = -(-len(ids) // 64)
    held = np.zeros(groups * 64, np.uint64)
    held[: len(ids)] = ids
    held = held.reshape(groups, 64)
    words = np.zeros((groups, width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= held[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= held[:, j] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """uint64 words -> the first `count` ids as uint32."""
    words = words.reshape(-1, width)
    ids = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        got = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            got = got | (words[:, at + 1] << np.uint64(64 - shift))
        ids[:, j] = got & mask
    return ids.reshape(-1)[:count]


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> bytes:
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
    blocks = -(-len(ids) // block_ids)
    words = pack_bits(ids, width)
    per_block = block_ids // 64 * width * 8
    offsets = np.minimum(np.arange(blocks + 1, dtype=np.int64) * per_block, words.nbytes).astype("<i8")
    header = np.array([MAGIC, VERSION, width, block_ids, len(doc_ids), len(ids), blocks], "<i8")
    return b"".join(x.tobytes() for x in (header, doc_ids.astype("<i8"), starts, offsets, words.astype("<u8")))


class Segment:
    """A reader of one file image."""

    def __init__(self, image: bytes):
        head = np.frombuffer(image, "<i8", 7)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a segment of this format")
        self.width, self.block_ids, docs, self.n_ids, blocks = (int(x) for x in head[2:])
        at = 56
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.starts = np.frombuffer(image, "<i8", docs + 1, at := at + 8 * docs)
        self.offsets = np.frombuffer(image, "<i8", blocks + 1, at := at + 8 * (docs + 1))
        self.payload = memoryview(image)[at + 8 * (blocks + 1) :]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids start to end, reading only the blocks that hold them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, -(-end // self.block_ids)
        words = np.frombuffer(self.payload[self.offsets[first] : self.offsets[last]], "<u8")
        base = first * self.block_ids
        return unpack_bits(words, self.width, min(self.n_ids, last * self.block_ids) - base)[start - base : end - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_segments(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = 1 << 19, run_docs: int = 12_500) -> str:
    """Encode docs and write segments in ascending doc_id order; returns the table's path.

    Texts are dealt by ranges of (doc_id, hash of the text), about run_docs rows
    each, so that no doc_id fills one task; each task sorts its range, encodes it
    and packs the ids at once. Ids never move. A segment closes when it holds
    segment_ids ids or its range ends.
    """
    from tokenizers import Tokenizer

    bound_batches(docs.sparkSession)
    width = bit_width(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id))
    runs = max(1, -(-docs.select("doc_id").count() // run_docs))
    made = pa.schema([("run", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        now, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, total = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ids, total, number
            lengths = np.array([len(x) for x in ids], np.int64) // 4
            image = write_segment(np.array(doc_ids, np.int64), lengths, np.frombuffer(b"".join(ids), "<u4"), width)
            out = pa.RecordBatch.from_pylist([{"run": now, "segment": number, "n_ids": total // 4, "n_docs": len(ids), "image": image}], schema=made)
            doc_ids, ids, total, number = [], [], 0, number + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                ids.append(code.encode(text or "") + end)
                total += len(ids[-1])
                if total >= 4 * segment_ids:
                    yield close()
        if ids:
            yield close()
        release_memory()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ordered = keyed.repartitionByRange(runs, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    images = ordered.select("doc_id", "text").mapInArrow(run, "run int, segment int, n_ids long, n_docs long, image binary")
    # packed bits neither compress nor repeat; small row groups keep few images in memory
    plain = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20)}
    return write_shared(images, "segments", **plain)


def read_segments(spark, path: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Offsets are summed per run (one row each meets in one task), then per segment within its run.
    """
    files = spark.read.parquet(path)
    sizes = files.select("run", "segment", "n_ids")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    of_run = sizes.groupBy("run").agg(F.sum("n_ids").alias("all")).select("run", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("run").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(of_run, "run").select("run", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            for number, segment, image in zip(batch["run"].to_pylist(), batch["segment"].to_pylist(), batch["image"], strict=True):
                one = Segment(image.as_buffer())
                flat = one.ids().astype("<u4", copy=False).tobytes()
                starts = one.starts.tolist()
                crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number, np.int32)),
                        pa.array(np.full(n, segment, np.int32)),
                        pa.array([None if x == NO_ID else x for x in one.doc_ids.tolist()], pa.int64()),
                        pa.array(starts[:-1], pa.int64()),
                        pa.array(np.diff(one.starts)),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["run", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )
        release_memory()

    read = files.select("run", "segment", "image").mapInArrow(run, "run int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(maybe_broadcast(offsets, files.count()), ["run", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export_segments(spark, path: str, folder: str) -> int:
    """Copy the file images to a local folder, one at a time; returns their number."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in spark.read.parquet(path).orderBy("run", "segment").toLocalIterator():
        with open(os.path.join(folder, f"{row.run:07d}-{row.segment:05d}.tfb"), "wb") as f:
            f.write(row.image)
        n += 1
    return n


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs as bit-packed segments and return what reading them gives."""
    spark = docs.sparkSession
    path = write_segments(docs, tokenizer, end_id)
    found = cut(read_segments(spark, path), "token-index")
    drop_shared(spark, path)
    return found
