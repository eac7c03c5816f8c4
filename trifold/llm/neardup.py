"""Operator 9: near duplicates by banded MinHash, sequential Bayesian pruning and exact verification.

1. One pass over the texts gives each document's shingle-set size, a 128-bit key
   of the set and a signature of `bands * rows` minima. Documents with one set
   are one class; classes, not doc_ids, are what is linked.
2. Every band of a signature is a bucket. In each bucket two members, the least
   class and one picked by a hash, are compared with all others (a star, never
   all pairs).
3. A candidate pair's signatures are compared in batches. With m of n minima
   equal and a uniform prior, the similarity has a Beta(m + 1, n - m + 1)
   posterior; the pair goes when P(similarity >= threshold) is below
   `miss_probability`.
4. Survivors are verified on their full shingle sets, and verified links are
   joined into components by large-star and small-star steps. A centre's data
   moves once for each salt of its members, not once for each pair.
5. A bucket whose members are still in several components may hide a link that
   no star showed. Its members are compared within the bucket, block by block,
   only across components and only in the first band that a pair shares. A first
   pass over signatures keeps the members that have any survivor; a second one
   has their sets as well, verifies survivors in the block's own task and skips
   pairs that earlier links have joined. Only spanning links leave a task, so no
   row is made for a pair that is not linked, and no bucket is capped. A link is
   missed only if no band holds it or the posterior bound errs (3e-6 and below
   1e-6 at a similarity of exactly 0.8, with 32 bands of 5).

Similarity is compared as 100 * intersection >= percent * union on integers.

Defined results: a document without words has no set, n_shingles 0, is its own
component and kept; with fewer words than a shingle the whole sequence is the
one shingle; equal texts are always linked; a null text is a document without
words; rows are treated one by one, also where they share a doc_id with
different texts; a row with null doc_id gets a null component unless a class
gives it one; very long texts are read whole (their sets grow with them); an
empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import bound_batches, fresh, maybe_broadcast
from trifold.storage import Scratch, cut

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Members of one block of a bucket, and the shingles that they may have on average; a task holds two blocks.
BLOCK = 1500
BLOCK_SHINGLES = 1_000_000
#: Pairs whose signatures are compared at once.
PAIRS = 50_000
#: Members that share one copy of their star's centre.
STAR = 2000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words end at ASCII white space."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(hashed))
    each = np.full(len(hashed) - size + 1, size, np.uint64)
    for j in range(size):
        each = mixed(each * _STEP + hashed[j : j + len(each)])
    return np.unique(each)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(shingles * _STEP).view(np.int64))


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


class MinHash:
    """`count` minima under multiply-add hashes with fixed multipliers."""

    def __init__(self, count: int):
        draw = np.random.default_rng(20240229)
        self.a = draw.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, count, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint64)
        for at in range(0, len(shingles), 512):
            part = shingles[at : at + 512, None] * self.a + self.b
            np.minimum(least, part.min(axis=0) >> np.uint64(32), out=least)
        return least.astype(np.uint32).view(np.int32)


def least_matches(batch: int, total: int, percent: int, miss_probability: float) -> list[int]:
    """After each batch, the fewest equal minima for which P(similarity >= percent/100) reaches miss_probability."""
    t = percent / 100
    out = []
    for n in range(batch, total + 1, batch):
        # P(S >= t) for Beta(m+1, n-m+1) is the chance of at most m successes in n + 1 trials at t
        mass, m = 0.0, -1
        while mass < miss_probability and m < n:
            m += 1
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, bounds: list[int], batch: int) -> np.ndarray:
    """Indices k for which the signatures a[left[k]] and b[right[k]] stay above every bound."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for k, bound in enumerate(bounds):
        part = slice(k * batch, (k + 1) * batch)
        equal = equal + (a[left[alive], part] == b[right[alive], part]).sum(axis=1)
        keep = equal >= bound
        alive, equal = alive[keep], equal[keep]
    return alive


def components(edges: DataFrame, hold: Scratch) -> DataFrame:
    """(a, b) links -> (node, label): the smallest id that each linked node reaches."""
    edges = hold.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        seen = tuple(state)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hold.cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def signed(docs: DataFrame, words: int, count: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key_a, key_b (of the set) and the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHash(count)
        for batch in batches:
            sizes, keys_a, keys_b, signatures = [], [], [], []
            for text in batch["text"].to_pylist():
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                key_a, key_b = set_key(shingles)
                keys_a.append(key_a)
                keys_b.append(key_b)
                signatures.append(minima(shingles))
            flat = pa.array(np.concatenate(signatures)) if signatures else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * count), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(keys_a, pa.int64()), pa.array(keys_b, pa.int64()), lists], ["doc_id", "text_hash", "n_shingles", "key_a", "key_b", "signature"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key_a long, key_b long, signature array<int>")


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, count)


def sets_of(wanted: DataFrame, docs: DataFrame, words: int, hold: Scratch) -> DataFrame:
    """cid and the shingle set (sorted, as bytes) of each wanted class, from one row that has it."""
    texts = docs.select(F.col("doc_id").alias("low"), F.xxhash64("text").alias("text_hash"), "text")
    found = texts.join(maybe_broadcast(wanted, wanted.count()), ["low", "text_hash"]).select("cid", "key_a", "key_b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sets = [], []
            for k, (text, key_a, key_b) in enumerate(zip(batch["text"].to_pylist(), batch["key_a"].to_pylist(), batch["key_b"].to_pylist(), strict=True)):
                shingles = shingle_set(text, words)
                if set_key(shingles) == (key_a, key_b):
                    kept.append(k)
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([batch["cid"].take(pa.array(kept, pa.int64())), pa.array(sets, pa.binary())], ["cid", "shingles"])

    sets = hold.cut(found.mapInArrow(run, "cid long, shingles binary"), "sets")
    # rows that repeat both doc_id and text give a set more than once
    return hold.cut(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets") if sets.count() > wanted.count() else sets


def stars(pairs: DataFrame, data: DataFrame, column: str, hold: Scratch) -> DataFrame:
    """Rows (centre, salt, member, n, column) in runs of (centre, salt): the centre's own row, whose member is null, then members.

    `data` has cid, n and the column.
    """
    most = pairs.groupBy("centre").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // STAR))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(salts)).cast("int"))
    members = salted.join(data.withColumnRenamed("cid", "member"), "member").select("centre", "salt", "member", "n", column)
    centres = salted.select("centre", "salt").distinct().join(data.withColumnRenamed("cid", "centre"), "centre")
    both = centres.select("centre", "salt", F.lit(None).cast("long").alias("member"), "n", column).union(members)
    return both.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())


def pruned(pairs: DataFrame, reps: DataFrame, count: int, bounds: list[int], batch: int, percent: int, hold: Scratch) -> DataFrame:
    """Candidate pairs (centre, member) that stay after the size bound and the sequential posterior bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None  # the last centre's row
        for rows in batches:
            if not rows.num_rows:
                continue
            table = pa.Table.from_batches([rows])
            if centre is not None:
                table = pa.concat_tables([centre, table]).combine_chunks()
            begins = np.flatnonzero(table["member"].is_null().to_numpy())
            centre = table.slice(begins[-1], 1)
            each = np.arange(table.num_rows)
            at = begins[np.searchsorted(begins, each, side="right") - 1]
            n = table["n"].to_numpy()
            each = np.flatnonzero((at < each) & (100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at])))
            sig = _matrix(table["signature"].combine_chunks(), count)
            kept = each[surviving(sig, sig, at[each], each, bounds, batch)]
            yield table.select(["centre", "member"]).take(pa.array(kept)).combine_chunks().to_batches()[0] if len(kept) else nothing

    nothing = pa.RecordBatch.from_pylist([], schema=pa.schema([("centre", pa.int64()), ("member", pa.int64())]))
    return stars(pairs, reps.select("cid", "n", "signature"), "signature", hold).mapInArrow(run, "centre long, member long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, hold: Scratch) -> DataFrame:
    """Links (a, b): pairs (centre, member) whose full shingle sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            kept = []
            for k, (member, shingles) in enumerate(zip(rows["member"].to_pylist(), rows["shingles"], strict=True)):
                own = np.frombuffer(shingles.as_buffer(), np.uint64)
                if member is None:
                    held = own.copy()
                elif near(held, own, percent):
                    kept.append(k)
            linked = rows.select(["centre", "member"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(linked.columns, ["a", "b"])

    data = sets.select("cid", F.octet_length("shingles").cast("long").alias("n"), "shingles")
    return stars(pairs, data, "shingles", hold).mapInArrow(run, "a long, b long")


class Joined:
    """A union-find over the components that a block has."""

    def __init__(self, labels: np.ndarray):
        self.known, self.place = np.unique(labels, return_inverse=True)
        self.parent = np.arange(len(self.known))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[max(x, y)] = min(x, y)

    def now(self) -> np.ndarray:
        """The component of every member."""
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up
        return self.parent[self.place]


def strips(block: np.ndarray, left: int, right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of the block pair, in strips of rows against the rest so that few are held at once."""
    ours = np.arange(len(block)) if left == right else np.flatnonzero(block == left)
    theirs = ours if left == right else np.flatnonzero(block == right)
    strip = max(1, PAIRS // max(1, len(theirs)))
    for at in range(0, len(ours), strip):
        i, j = (x.ravel() for x in np.meshgrid(ours[at : at + strip], theirs, indexing="ij"))
        if left == right:
            i, j = i[i < j], j[i < j]
        yield i, j


def open_pairs(i, j, comp, n, sig, band: int, rows: int, bounds: list[int], batch: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of different components that may be near and share no band before this one."""
    may = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[may], j[may]
    k = surviving(sig, sig, i, j, bounds, batch)
    i, j = i[k], j[k]
    if band and len(i):
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 4096):
            part = slice(at, at + 4096)
            same = sig[i[part], : band * rows] == sig[j[part], : band * rows]
            first[part] = ~same.reshape(len(same), band, rows).all(axis=2).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def by_blocks(members: DataFrame, one: Callable[[pa.Table], pa.RecordBatch], kind: str) -> DataFrame:
    """Run `one` over each (key, left, right) block pair of the members, as a stream of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for rows in batches:
            if not rows.num_rows:
                continue
            key = np.stack([rows[c].to_numpy() for c in ("key", "left", "right")], axis=1)
            begins = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *begins.tolist(), len(key)]
            table = pa.Table.from_batches([rows])
            for s, e in zip(edges, edges[1:]):
                if held and tuple(key[s]) != last:
                    yield one(pa.concat_tables(held).combine_chunks())
                    held = []
                last = tuple(key[s])
                held.append(table.slice(s, e - s))
        if held:
            yield one(pa.concat_tables(held).combine_chunks())

    dealt = members.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInArrow(run, kind)


def across(members: DataFrame, sets_for: Callable[[DataFrame], DataFrame], count: int, rows: int, bounds: list[int], batch: int, percent: int, hold: Scratch) -> DataFrame:
    """Spanning links (a, b) between components within the block pairs of buckets. `members` is what dealt_blocks gives."""
    none = {"key": pa.int64(), "left": pa.int32(), "right": pa.int32(), "cid": pa.int64()}

    def parts(table: pa.Table):
        left, right, band = (table[c][0].as_py() for c in ("left", "right", "band"))
        block, n, comp, ids = (table[c].to_numpy() for c in ("block", "n", "comp", "cid"))
        return left, right, band, block, n, comp, ids, _matrix(table["signature"].combine_chunks(), count)

    def hit(table: pa.Table) -> pa.RecordBatch:
        """Members that have a survivor."""
        left, right, band, block, n, comp, ids, sig = parts(table)
        found = np.zeros(len(ids), bool)
        for i, j in strips(block, left, right):
            fresh_pairs = ~(found[i] & found[j])
            i, j = open_pairs(i[fresh_pairs], j[fresh_pairs], comp, n, sig, band, rows, bounds, batch, percent)
            found[i] = found[j] = True
        at = np.flatnonzero(found)
        columns = [pa.array(np.full(len(at), table[c][0].as_py()), t) for c, t in list(none.items())[:3]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids[at])], list(none))

    def link(table: pa.Table) -> pa.RecordBatch:
        """Survivors are verified, those of components that are joined by now are left out."""
        left, right, band, block, n, comp, ids, sig = parts(table)
        sets = table["shingles"].combine_chunks()
        shingles = lambda k: np.frombuffer(sets[k].as_buffer(), np.uint64)
        joined, out_a, out_b = Joined(comp), [], []
        for i, j in strips(block, left, right):
            i, j = open_pairs(i, j, joined.now(), n, sig, band, rows, bounds, batch, percent)
            last, own = -1, None
            for x, y in zip(i.tolist(), j.tolist()):
                of_x, of_y = joined.find(joined.place[x]), joined.find(joined.place[y])
                if of_x == of_y:
                    continue
                if x != last:
                    last, own = x, shingles(x)
                if near(own, shingles(y), percent):
                    joined.join(of_x, of_y)
                    out_a.append(ids[x])
                    out_b.append(ids[y])
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    hits = hold.cut(by_blocks(members, hit, "key long, left int, right int, cid long"), "block-members")
    again = members.join(hits, ["key", "left", "right", "cid"], "left_semi")
    return by_blocks(again.join(sets_for(hits.select("cid").distinct()), "cid"), link, "a long, b long")


def dealt_blocks(held: DataFrame, reps: DataFrame, labels: DataFrame, hold: Scratch) -> DataFrame:
    """Members of buckets of three and more that the stars left in several components, once for each pair of blocks with theirs."""
    rows = held.filter("members > 2").join(labels, F.col("cid") == F.col("node"), "left")
    rows = rows.select("key", "band", "cid", "n", F.coalesce("label", "cid").alias("comp"))
    of_bucket = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    unresolved = hold.cut(of_bucket.filter("lo < hi").select("key", blocks.alias("blocks")), "unresolved")
    dealt = rows.join(maybe_broadcast(unresolved, unresolved.count()), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "cid", "n", "comp")
    return dealt.join(reps.select("cid", "signature"), "cid")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, miss_probability: float = 1e-6, batch: int = 32) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    count = bands * rows
    bounds = least_matches(batch, count, percent, miss_probability)
    with Scratch(docs.sparkSession) as hold:
        all_rows = hold.cut(signed(docs, words, count), "signatures")
        low = F.min(F.struct("doc_id", "text_hash")).alias("low")
        reps = all_rows.filter("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b").agg(low, F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
        reps = hold.cut(reps.select(F.monotonically_increasing_id().alias("cid"), "key_a", "key_b", "low.doc_id", "low.text_hash", "n", "signature"), "classes")
        classes = reps.select("cid", "key_a", "key_b", F.col("doc_id").alias("low"), "text_hash")

        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, *[F.get("signature", k * rows + j) for j in range(rows)]))
        banded = reps.select("cid", "n", F.posexplode(keys).alias("band", "key"))
        buckets = banded.groupBy("key").agg(F.min("cid").alias("p"), F.min_by("cid", F.xxhash64("cid")).alias("q"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        buckets = hold.cut(buckets, "buckets")
        held = hold.cut(banded.join(maybe_broadcast(buckets, buckets.count()), "key"), "members")

        star = held.select("cid", F.explode(F.array_distinct(F.array("p", "q"))).alias("centre")).filter("cid <> centre")
        star = star.select("centre", F.col("cid").alias("member")).distinct()
        candidates = hold.cut(pruned(hold.cut(star, "stars"), reps, count, bounds, batch, percent, hold), "candidates")

        def sets_for(ids: DataFrame) -> DataFrame:
            return sets_of(hold.cut(classes.join(ids, "cid"), "survivors"), docs, words, hold)

        sets = sets_for(candidates.select(F.col("centre").alias("cid")).union(candidates.select("member")).distinct())
        links = hold.cut(verified(candidates, sets, percent, hold), "links")
        labels = hold.cut(components(links, hold), "labels")

        members = hold.cut(dealt_blocks(held, reps, labels, hold), "blocks")
        more = hold.cut(across(members, sets_for, count, rows, bounds, batch, percent, hold), "links")
        if not more.isEmpty():
            labels = hold.cut(components(links.union(more), hold), "labels")

        of_label = labels.join(classes, F.col("node") == F.col("cid")).groupBy("label").agg(F.min("low").alias("component"))
        linked = labels.join(of_label, "label").select("node", "component")
        named = classes.join(linked, F.col("cid") == F.col("node"), "left").select("key_a", "key_b", F.coalesce("component", "low").alias("component"))
        found = all_rows.select("doc_id", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"], "left")
        component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
        found = found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
        return hold.result(found, "near-duplicates")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their columns; rows that share a doc_id go or stay together."""
    (of,) = fresh(docs, "__gone")
    gone = cut(near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(of)).distinct(), "dropped")
    return docs.join(maybe_broadcast(gone, gone.count()), docs["doc_id"] == gone[of], "left_anti")
