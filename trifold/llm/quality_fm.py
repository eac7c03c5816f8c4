"""Operator 1: a factorisation machine for text quality.

A document's features are its hashed words (frequency-pruned, with unit norm
together), binned structure statistics of the whole text, and metadata (the
recorded character count, binned). The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost time linear in the features. It is trained in
numpy with Adagrad on a sample of at most `sample` labelled documents per label
value; sample rows are weighted back to the labels' shares.

Defined results: null and empty texts have the structure features of an empty
text and are scored as any other; a null character count has a bin of its own;
rows that share a doc_id are scored one by one; a label that is null or not 0
or 1 is not used; without training rows of both labels every score is the share
of label 1; very long texts are read whole; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import bound_batches, fresh, maybe_broadcast
from trifold.llm.words import Vocabulary, held_out, labelled_sample, prior_weights, share_of_ones, sigmoid, word_hashes
from trifold.storage import cut

BINS = 12
_UPPER, _LOWER, _DIGIT = (np.arange(a, b) for a, b in ((65, 91), (97, 123), (48, 58)))


def structure(text: str | None, n_chars: int | None, hashes: np.ndarray) -> list[int]:
    """Bins of whole-text statistics and metadata, each below BINS."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    total = max(1, len(raw))
    upper, lower, digit = (int(seen[x].sum()) for x in (_UPPER, _LOWER, _DIGIT))
    spaces, lines = int(seen[32]), int(seen[10])
    high = int(seen[128:].sum())
    signs = total - upper - lower - digit - spaces - lines - high if len(raw) else 0
    log = lambda x: min(BINS - 1, int(math.log2(x + 1)))
    part = lambda x, of: min(BINS - 1, int(BINS * min(1.0, x / max(1, of))))
    fine = lambda x: min(BINS - 1, int(1.0 + math.log2(1 + 512 * x)) if x > 0 else 0)
    words = len(hashes)
    return [
        part(upper, upper + lower),
        fine(upper / total),
        fine(digit / total),
        fine(signs / total),
        fine(int(seen[33]) / total),
        fine(int(seen[35:39].sum()) / total),
        fine(int(seen[42]) / total),
        fine(int(seen[124]) / total),
        part(high, total),
        part(len(np.unique(hashes)), words),
        min(BINS - 1, int(len(raw) / max(1, words))),
        fine(lines / max(1, words)),
        fine(int(seen[46]) / max(1, words)),
        min(BINS - 1, log(words)),
        BINS - 1 if n_chars is None else min(BINS - 2, log(max(0, n_chars)) // 2),
    ]


STATISTICS = 15


def features(texts: list, counts: list, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, first place of each document); the first STATISTICS * BINS numbers are structure."""
    ids, values, starts, at = [], [], [], 0
    base = np.arange(STATISTICS) * BINS
    for text, n_chars in zip(texts, counts, strict=True):
        hashes = word_hashes(text)
        words = np.unique(vocabulary.ids(hashes)) + STATISTICS * BINS
        ids += [base + structure(text, n_chars, hashes), words]
        values += [np.full(STATISTICS, 0.5), np.full(len(words), 1 / math.sqrt(max(1, len(words))))]
        starts.append(at)
        at += STATISTICS + len(words)
    return np.concatenate(ids), np.concatenate(values), np.array(starts)


class FactorisationMachine:
    def __init__(self, size: int, rank: int = 8, seed: int = 7):
        self.w0 = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def margin(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray):
        """Margins and the per-document factor sums, by the sum-of-squares identity."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, ids, x, starts, labels, weights, epochs: int = 14, batch: int = 256, rate: float = 0.15, decay: float = 1e-4) -> None:
        ends = np.append(starts[1:], len(ids))
        seen_w, seen_v, seen_0 = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        order = np.random.default_rng(3)
        for _ in range(epochs):
            for rows in np.array_split(order.permutation(len(starts)), max(1, len(starts) // batch)):
                lengths = ends[rows] - starts[rows]
                firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                at = np.repeat(starts[rows] - firsts, lengths) + np.arange(lengths.sum())
                i, xi = ids[at], x[at]
                margin, sums = self.margin(i, xi, firsts)
                slope = (sigmoid(margin) - labels[rows]) * weights[rows] / len(rows)
                each = np.repeat(slope, lengths) * xi
                used, where = np.unique(i, return_inverse=True)
                grad_w = np.bincount(where, each, len(used)) + decay * self.w[used]
                pull = each[:, None] * (np.repeat(sums, lengths, axis=0) - self.v[i] * xi[:, None])
                grad_v = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(self.v.shape[1])], axis=1) + decay * self.v[used]
                seen_w[used] += grad_w**2
                seen_v[used] += grad_v**2
                seen_0 += slope.sum() ** 2
                self.w[used] -= rate * grad_w / np.sqrt(seen_w[used])
                self.v[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
                self.w0 -= rate * slope.sum() / math.sqrt(seen_0)


def fit(docs: DataFrame, labels: DataFrame, label: str, out, sample: int, folds_share: float) -> tuple[Vocabulary, FactorisationMachine] | None:
    rows = labelled_sample(docs, labels, label, out, sample, ["n_chars"] if "n_chars" in docs.columns else [])
    y = rows["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    texts = rows["text"].to_pylist()
    counts = rows["n_chars"].to_pylist() if "n_chars" in rows.column_names else [None] * len(texts)
    vocabulary = Vocabulary([word_hashes(t) for t in texts], least=5, most=50_000)
    ids, x, starts = features(texts, counts, vocabulary)
    machine = FactorisationMachine(STATISTICS * BINS + len(vocabulary))
    machine.fit(ids, x, starts, y, prior_weights(y, folds_share))
    return vocabulary, machine


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = 0.3, sample: int = 3000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    out = held_out(F.col("doc_id"), folds, fold)
    share = share_of_ones(labels, "quality", out)
    model = fit(docs, labels, "quality", out, sample, share)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                scores = np.full(n, share)
            else:
                vocabulary, machine = model
                counts = batch["n_chars"].to_pylist() if counted else [None] * n
                scores = sigmoid(machine.margin(*features(batch["text"].to_pylist(), counts, vocabulary))[0])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores)], ["doc_id", "held_out", "score"])

    taken = docs.select("doc_id", "text", out.alias("held_out"), *(["n_chars"] if counted else []))
    scored = taken.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs predicted to be good, with their columns; rows that share a doc_id go if any is rejected, rows without one stay."""
    (of,) = fresh(docs, "__bad")
    bad = cut(score_quality(docs, labels, **options).filter("predicted = 0").select(F.col("doc_id").alias(of)).distinct(), "rejected")
    return docs.join(maybe_broadcast(bad, bad.count()), docs["doc_id"] == bad[of], "left_anti")
