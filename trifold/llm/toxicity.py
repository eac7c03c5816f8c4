"""Operator 6: a convolutional text classifier for toxicity, trained in numpy.

Hashed word embeddings (a word keeps its 32-bit hash; hashes that fewer than
`least` training documents have share one embedding), filters of several widths
over the whole word sequence, max pooling, one dense layer. A filter's response
at a place is a sum of one term per word, so scoring looks the terms up in a
table of vocabulary x filters instead of multiplying embeddings again.

Max pooling passes gradients only through the winning places, which keeps
training linear in the filters once the forward pass is done.

It is trained on all labelled rows, in rounds: their hashed words lie in the shared
folder in shards of some thousand rows, each shard trains a copy of the network on
its rows, and the copies' mean starts the next round. The vocabulary's counts are
those of all labelled rows.

Thresholds are calibrated by language: on a fifth of the labelled rows, which is
not trained on, each language with enough rows of both labels gets the threshold
of the best F1 score, other languages the common one. Language is no input of the
score, and the contract's ``predicted`` uses its fixed threshold; the calibrated
one and its decision are columns of their own.

Defined results: a text without words (null and empty ones too) is scored by the
dense layer on filters that see nothing; rows that share a doc_id are learned and
scored one by one; labels other than 0 and 1 are not used; without training rows of both
labels every score is the share of label 1; an empty table gives no row; further
columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trifold.llm.common import bound_batches
from trifold.llm.words import Vocabulary, held_out, labelled_rows, share_of_ones, sigmoid, word_hashes
from trifold.storage import Scratch


class TextCNN:
    def __init__(self, vocabulary: int, dims: int = 12, widths=(1, 2, 3), filters: int = 8, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.embed = draw.normal(0, 0.3, (vocabulary, dims))
        self.embed[0] = 0
        self.kernels = [draw.normal(0, 0.4, (w, dims, filters)) for w in widths]
        self.bias = [np.full(filters, -0.2) for _ in widths]
        self.dense = draw.normal(0.3, 0.1, filters * len(widths))
        self.offset = -2.0
        self.prepare()

    def prepare(self, words: np.ndarray | None = None) -> None:
        """tables[w][j]: what a word at place j of a width-w filter adds, for the given words or all, and each filter."""
        embed = self.embed if words is None else self.embed[words]
        self.tables = [[(embed @ k[j]).astype(np.float32) for j in range(len(k))] for k in self.kernels]

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """Max-pooled rectified responses, and the winning place of each filter (-1: none above 0)."""
        out, places = np.zeros(self.filters * len(self.widths)), []
        for w, width in enumerate(self.widths):
            n = len(ids) - width + 1
            part = slice(w * self.filters, (w + 1) * self.filters)
            if n <= 0:
                places.append(np.full(self.filters, -1))
                continue
            response = self.tables[w][0][ids[:n]]
            for j in range(1, width):
                response = response + self.tables[w][j][ids[j : j + n]]
            at = response.argmax(axis=0)
            best = response[at, np.arange(self.filters)] + self.bias[w]
            out[part] = np.maximum(best, 0)
            places.append(np.where(best > 0, at, -1))
        return out, places

    def margins(self, documents: list[np.ndarray]) -> np.ndarray:
        return np.array([self.pooled(d)[0] @ self.dense + self.offset for d in documents])

    def start(self) -> None:
        """Sums of squared gradients, for Adagrad."""
        squares = {"e": np.full(self.embed.shape, 1e-4), "d": np.full(self.dense.shape, 1e-4), "o": 1e-4}
        squares |= {f"k{w}": np.full(k.shape, 1e-4) for w, k in enumerate(self.kernels)} | {f"b{w}": np.full(self.filters, 1e-4) for w in range(len(self.widths))}
        self.squares = squares

    def fit(self, documents: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.1) -> None:
        order = np.random.default_rng(5)
        self.start()
        for _ in range(epochs):
            self.learn(documents, labels, weights, order, batch, rate)
        self.prepare()

    def learn(self, documents: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, order: np.random.Generator, batch: int = 64, rate: float = 0.1) -> np.ndarray:
        """One pass over the documents; returns how often each word was moved. The tables are those of the last batch then."""
        squares, moves = self.squares, np.zeros(len(self.embed), np.int64)
        for rows in np.array_split(order.permutation(len(documents)), max(1, len(documents) // batch)):
            used, local = np.unique(np.concatenate([documents[r] for r in rows]), return_inverse=True)
            self.prepare(used)
            ends = np.cumsum([len(documents[r]) for r in rows])
            parts = np.split(local, ends[:-1])
            found = [self.pooled(ids) for ids in parts]
            hidden = np.stack([h for h, _ in found])
            slope = (sigmoid(hidden @ self.dense + self.offset) - labels[rows]) * weights[rows] / len(rows)
            grad_e = np.zeros((len(used), self.embed.shape[1]))
            grad_k, grad_b = [], []
            for w, width in enumerate(self.widths):
                place = np.stack([p[w] for _, p in found])
                doc, f = np.nonzero(place >= 0)
                back = slope[doc] * self.dense[w * self.filters + f]
                grad_b.append(np.bincount(f, back, self.filters))
                # the winning words: their place in `used`, for each place of the filter
                won = np.array([parts[d][at : at + width] for d, at in zip(doc, place[doc, f])], np.int64).reshape(len(doc), width)
                each = np.zeros((self.filters, len(doc)))
                each[f, np.arange(len(doc))] = back
                grad_k.append(np.stack([(each @ self.embed[used[won[:, j]]]).T for j in range(width)]))
                for j in range(width):
                    np.add.at(grad_e, won[:, j], back[:, None] * self.kernels[w][j][:, f].T)

            def step(key: str, value, grad):
                squares[key] = squares[key] + grad * grad
                return value - rate * grad / np.sqrt(squares[key])

            self.dense = step("d", self.dense, slope @ hidden + 1e-4 * self.dense)
            self.offset = step("o", self.offset, slope.sum())
            for w in range(len(self.widths)):
                self.kernels[w] = step(f"k{w}", self.kernels[w], grad_k[w] + 1e-4 * self.kernels[w])
                self.bias[w] = step(f"b{w}", self.bias[w], grad_b[w])
            moved = np.flatnonzero((used > 0) & grad_e.any(axis=1))  # word 0 stands for any other and stays 0
            words, grad = used[moved], grad_e[moved]
            squares["e"][words] += grad * grad
            self.embed[words] -= rate * grad / np.sqrt(squares["e"][words])
            moves[words] += 1
        return moves

    def blocks(self, moves: np.ndarray, documents: int) -> Iterator[tuple[int, np.ndarray]]:
        """The state as (block, lines) with lines of place in the block, weight, values: words by the times they were moved, all else by documents."""
        keys = ["d", "o", *(f"{x}{w}" for x in "kb" for w in range(len(self.widths)))]
        flat = np.concatenate([np.ravel(x) for x in (self.dense, self.offset, *self.kernels, *self.bias, *(self.squares[k] for k in keys))])
        wide = 2 * self.embed.shape[1]
        other = np.pad(flat, (0, -len(flat) % wide)).reshape(-1, wide)
        yield -1, np.column_stack([np.arange(len(other)), np.full(len(other), documents), other])
        words = np.flatnonzero(moves)
        for block in np.unique(words // BLOCK):
            mine = words[words // BLOCK == block]
            yield int(block), np.column_stack([mine % BLOCK, moves[mine], self.embed[mine], self.squares["e"][mine]])

    def take(self, block: int, lines: np.ndarray) -> None:
        """Set the state of a block, as `blocks` gives it."""
        at, values = lines[:, 0].astype(np.int64), lines[:, 2:]
        if block >= 0:
            self.embed[block * BLOCK + at], self.squares["e"][block * BLOCK + at] = np.hsplit(values, 2)
            return
        flat, read = np.ravel(values), 0

        def part(like):
            nonlocal read
            read += np.size(like)
            return flat[read - np.size(like) : read].reshape(np.shape(like))

        n = range(len(self.widths))
        self.dense, self.offset = part(self.dense), float(part(self.offset))
        self.kernels, self.bias = [part(x) for x in self.kernels], [part(x) for x in self.bias]
        for key in ["d", "o", *(f"k{w}" for w in n), *(f"b{w}" for w in n)]:
            self.squares[key] = part(self.squares[key])


#: Words of a block of the network's state.
BLOCK = 2048
#: Labelled rows of a shard, on average; more rows make more shards.
SHARD = 8192
#: Documents, and bytes of hashes, that a task holds at once while it trains.
WINDOW, WINDOW_BYTES = 512, 8 << 20


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """Successive rows of one shard, few enough to be held: shard, hashes, labels."""
    shard, words, labels, size = None, [], [], 0
    for batch in batches:
        for s, y, w in zip(batch["shard"].to_pylist(), batch["label"].to_pylist(), batch["words"].to_pylist(), strict=True):
            if words and (s != shard or len(words) == WINDOW or size >= WINDOW_BYTES):
                yield shard, words, labels
                words, labels, size = [], [], 0
            shard, size = s, size + len(w)
            words.append(w)
            labels.append(y)
    if words:
        yield shard, words, labels


def train_round(rows: DataFrame, network: TextCNN, vocabulary: Vocabulary, weights: tuple[float, float], number: int) -> None:
    """Each shard trains a copy of the network on its rows, once; the network becomes the copies' mean.

    A word's embedding is averaged over the shards that moved it, by how often they did, so that words
    that few shards have learn as fast as others. Shards hold fixed rows in a fixed order, and the means
    are made by executors, block by block: the driver gets one network's size, whatever the shards' number.
    """
    network.tables = []

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in groupby(windows(batches), key=lambda x: x[0]):
            mine = copy.deepcopy(network)
            moves, n = np.zeros(len(mine.embed), np.int64), 0
            for i, (_, words, labels) in enumerate(held):
                y = np.array(labels)
                moves += mine.learn([vocabulary.ids(np.frombuffer(w, np.uint32)) for w in words], y, np.where(y == 1, weights[1], weights[0]), np.random.default_rng((number, shard, i)))
                n += len(y)
            for block, lines in mine.blocks(moves, n):
                yield pa.RecordBatch.from_pydict({"block": [block], "shard": [shard], "lines": [lines.astype(np.float32).tobytes()]})

    wide = 2 + 2 * network.embed.shape[1]

    def lines_of(data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.float32).reshape(-1, wide).astype(np.float64)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((b, d) for batch in batches for b, d in zip(batch["block"].to_pylist(), batch["lines"].to_pylist(), strict=True))
        for block, held in groupby(each, key=lambda x: x[0]):
            sums = np.zeros((BLOCK, wide))
            for _, data in held:
                lines = lines_of(data)
                at = lines[:, 0].astype(np.int64)
                sums[at, 1] += lines[:, 1]
                sums[at, 2:] += lines[:, 1:2] * lines[:, 2:]
            at = np.flatnonzero(sums[:, 1])
            got = np.column_stack([at, sums[at, 1], sums[at, 2:] / sums[at, 1:2]]).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"block": [block], "lines": [got.tobytes()]})

    learned = rows.select("shard", "label", "words").mapInArrow(train, "block long, shard long, lines binary")
    merged = learned.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(mean, "block long, lines binary").toArrow()
    for block, data in zip(merged["block"].to_pylist(), merged["lines"].to_pylist(), strict=True):
        network.take(block, lines_of(data))


def best_thresholds(scored: DataFrame, by: list[str], least: int) -> list:
    """For each group with at least `least` rows of both labels, the threshold of the largest F1, halfway to the next lower score."""
    each = scored.groupBy(*by, "score").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
    down, whole = Window.partitionBy(*by).orderBy(F.desc("score")), Window.partitionBy(*by)
    hit, taken, ones, n = F.sum("ones").over(down), F.sum("n").over(down), F.sum("ones").over(whole), F.sum("n").over(whole)
    lower = F.coalesce(F.lead("score").over(down), F.lit(0.0))
    cuts = each.select(*by, "score", ((F.col("score") + lower) / 2).alias("threshold"), (2 * hit / (taken + ones)).alias("f1"), F.least(ones, n - ones).alias("fewer"))
    return cuts.filter(F.col("fewer") >= least).groupBy(*by).agg(F.max_by("threshold", F.struct("f1", "score")).alias("threshold")).collect()


def hashed_words(rows: DataFrame, shards: int) -> DataFrame:
    """label, lang, words (the hashes' bytes), shard, and whether the row is for calibration, dealt to shards in an order that hashes fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([word_hashes(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("doc_id", "label", "lang")), words], ["doc_id", "label", "lang", "words"])

    lang = F.col("lang").cast("string") if "lang" in rows.columns else F.lit(None).cast("string")
    hashed = rows.select(F.col("doc_id").cast("long"), "text", "label", lang.alias("lang")).mapInArrow(run, "doc_id long, label int, lang string, words binary")

    def dealt(salt: int, n: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n)).cast("int")

    placed = hashed.select("*", dealt(1, shards).alias("shard"), (dealt(2, 5) == 0).alias("calibrate"), F.xxhash64("doc_id", F.lit(3)).alias("place"))
    return placed.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "words").drop("doc_id", "place")


def fit(docs: DataFrame, labels: DataFrame, out, rounds: int = 10):
    """(vocabulary, network, common threshold, thresholds by language), or None without both labels."""
    rows, n = labelled_rows(docs, labels, "toxic", out, ["lang"] if "lang" in docs.columns else [])
    with Scratch(docs.sparkSession) as hold:
        table = hold.cut(hashed_words(rows, max(1, -(-n // SHARD))), "labelled")
        counts = {(r.calibrate, r.label): r["count"] for r in table.groupBy("calibrate", "label").count().collect()}
        if len({label for _, label in counts}) < 2:
            return None
        zeros, ones = counts.get((False, 0), 0), counts.get((False, 1), 0)
        training = table.filter("not calibrate")
        if not zeros or not ones:
            training, zeros, ones = table, *(sum(counts.get((c, y), 0) for c in (False, True)) for y in (0, 1))
        vocabulary = Vocabulary.counted(table, least=5, most=30_000)
        network = TextCNN(len(vocabulary))
        network.start()
        # label 1 halfway, by ratio, to a balance of both, which separates them more; margins are moved back below
        more = (zeros / ones) ** 0.5
        unit = (zeros + ones) / (zeros + more * ones)
        for number in range(rounds):
            train_round(training, network, vocabulary, (unit, more * unit), number)
        network.offset -= np.log(more)
        network.squares = None
        network.prepare()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = sigmoid(network.margins([vocabulary.ids(np.frombuffer(w, np.uint32)) for w in batch["words"].to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch["lang"], batch["label"], pa.array(scores, pa.float64())], ["lang", "label", "score"])

        if not counts.get((True, 1)):
            return vocabulary, network, 0.5, {}
        held = table.filter("calibrate").select("lang", "label", "words").mapInArrow(run, "lang string, label int, score double")
        held = hold.cut(held, "calibration")
        common = best_thresholds(held, [], 0)[0].threshold
        by = {r.lang: r.threshold for r in best_thresholds(held.filter("lang is not null"), ["lang"], 20)}
        return vocabulary, network, common, by


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, lang_threshold, toxic_in_lang.

    Every labelled row outside the fold is used, four of five for training and the others for calibration.
    """
    bound_batches(docs.sparkSession)
    out = held_out(F.col("doc_id"), folds, fold)
    share = share_of_ones(labels, "toxic", out)
    model = fit(docs, labels, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                scores = np.full(batch.num_rows, share)
            else:
                vocabulary, network = model[:2]
                scores = sigmoid(network.margins([vocabulary.ids(word_hashes(t)) for t in batch["text"].to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], batch["lang"], pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select("doc_id", "text", out.alias("held_out"), lang.alias("lang")).mapInArrow(run, "doc_id long, held_out boolean, lang string, score double")
    limit = F.lit(0.5 if model is None else model[2])
    for name, value in ({} if model is None else model[3]).items():
        limit = F.when(F.col("lang") == name, value).otherwise(limit)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).alias("toxic_in_lang"))
