"""Operator 4: vector best-fit packing of documents into fixed-length sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces go, longest first, into the feasible open bin
with the best score, and open a new bin where none is feasible:

* ``residual_norm``: the least weighted norm of what the bin would have left;
* ``dot_product``: the least weighted dot product of the piece's demand with
  the bin's residual, so that a demand meets the bin that is scarcest where the
  piece is large.

Pieces are dealt to groups by a hash of their key; each group is packed by one
task on its own. A group holds about `group_pieces` pieces, so memory is
bounded and the loss is at most the last unfilled bins of each group.

Defined results: null text is the empty text, which is one piece of the end id
alone; rows that share a doc_id are packed separately; a null doc_id is packed
as any other; a very long text gives many pieces; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import bound_batches, release_memory, salted
from trifold.llm.tokens import encoder, forget_encoder
from trifold.storage import cut


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights=(1.0, 0.05, 0.05), rule: str = "residual_norm"):
    """Pack pieces given longest first; returns (bin number, offset in the bin) of each."""
    n = len(lengths)
    caps = np.array([tokens, documents, attention], float)
    scale = np.asarray(weights, float) / (caps if rule == "dot_product" else caps * caps) / (caps if rule == "dot_product" else 1)
    left = np.zeros((3, 256))
    ids = np.zeros(256, np.int64)
    open_bins = made = 0
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    smallest = lengths.min() if n else 0
    # a piece that fills a bin has one of its own, and closes it
    whole = int(np.count_nonzero(lengths >= tokens))
    bins[:whole], offsets[:whole], made = np.arange(whole), 0, whole
    for k, length in enumerate(lengths[whole:].tolist(), whole):
        need = np.array([length, 1, length * length], float)
        rest = left[:, :open_bins] - need[:, None]
        fits = np.flatnonzero((rest >= 0).all(axis=0))
        if len(fits):
            rest = rest[:, fits]
            score = scale @ (rest * rest) if rule == "residual_norm" else (scale * need) @ (rest + need[:, None])
            at = fits[score.argmin()]
        else:
            if open_bins == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                ids = np.concatenate([ids, np.zeros_like(ids)])
            at, open_bins = open_bins, open_bins + 1
            left[:, at], ids[at] = caps, made
            made += 1
        bins[k], offsets[k] = ids[at], tokens - left[0, at]
        left[:, at] -= need
        if left[0, at] < smallest or left[1, at] < 1:  # closed: nothing more can enter
            open_bins -= 1
            left[:, at], ids[at] = left[:, open_bins], ids[open_bins]
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """Encode each text once; only texts above `tokens` are cut, with the short piece first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                flat = code.encode(text or "") + end
                total = len(flat) // 4
                start, stop = 0, total % tokens or tokens if total > tokens else total
                for piece in range(-(-total // tokens)):
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(flat[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start, stop = stop, stop + tokens
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release_memory()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, tokens: int, documents: int, attention: int, rule: str = "residual_norm", group_pieces: int = 8192) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length. `pieces` should be stored: it is read twice."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        forget_encoder()
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(group["length"].to_numpy(), tokens, documents, attention, rule=rule)
        return group.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = pieces.withColumn("bin_group", salted(groups, F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bin_group").applyInPandas(run, kind)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = 1024, documents: int = 512, attention: int | None = None, rule: str = "residual_norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `attention` bounds the sum of squared lengths in a sequence; by default it is
    tokens squared, what one full piece costs.
    """
    pieces = cut(cut_pieces(docs, tokenizer, end_id, tokens), "pieces")
    return pack(pieces, tokens, documents, attention or tokens * tokens, rule)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, an array in order of offset. Needs unique doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            ids = []
            for text, start, length in zip(batch["text"].to_pylist(), batch["start"].to_pylist(), batch["length"].to_pylist(), strict=True):
                flat = np.frombuffer(code.encode(text or "") + np.array([end_id], "<u4").tobytes(), "<u4")
                ids.append(flat[start : start + length].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], batch["offset"], pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    joined = packed.join(docs.select("doc_id", "text"), "doc_id").select("sequence_id", "offset", "text", "start", "length")
    parts = joined.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
