import hashlib
import random
import re

import pytest
import xxhash

from trifold.llm import decontam, neardup, sketch
from trifold.storage import Scratch

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for a, i in enumerate(order):
        for j in order[:a]:
            m = len(sets[i] & sets[j])
            if m and 100 * m >= percent * (len(sets[i]) + len(sets[j]) - m):
                x, y = sorted((find(i), find(j)), key=lambda z: rows[z][0])
                parent[y] = x
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def check(docs, k):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, k)
    got = neardup.near_duplicates(docs, words=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), 4)


def chains(seed, n=80):
    """A base text with ever more words changed, so that neighbours are near and ends are not, beside a group of near copies."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows, now = [], list(words)
    for i in range(n):
        rows.append(" ".join(now))
        now[(i * 7) % 120] = f"c{i}"
    rows += [" ".join(w if rng.random() > 0.03 else "z" for w in words) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_large_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)  # large buckets go by blocks
    check(spark.createDataFrame(list(enumerate(chains(seed))), "doc_id long, text string"), 4)


@pytest.mark.parametrize("star", [1, 2000])
def test_links_of_one_id_with_two_texts(spark, star, monkeypatch):
    monkeypatch.setattr(neardup, "STAR", star)  # every member in a run of its own
    first, second = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, first), (1, second), (2, first + " x"), (3, second + " y"), (4, "something else"), (1, first)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]


def test_one_id_for_all_rows_and_null_ids(spark):
    rows = [(None if i % 3 == 0 else 7, f"{'one text of more than five words' if i % 2 else 'and another text that many share too'}") for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 40 and {r.component_id for r in got} == {7}


def test_a_bucket_below_the_threshold(spark, monkeypatch):
    """Many texts at a similarity just below 0.8, and some pairs above it that no star has."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        own = [f"{w}_{i}" if rng.random() < 0.028 else w for w in words]
        rows.append(" ".join(own))
        if i % 6 == 0:
            rows.append(" ".join([*own[:-1], "end"]))
    check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 4)


def test_odd(odd, none):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert all(got[i].n_shingles == 0 and got[i].kept for i in (0, 1, 2))
    assert got[6].component_id == got[5].component_id == got[8].component_id == 5 and got[10].component_id == 9
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 9, 11, 12}
    assert neardup.near_duplicates(none).count() == 0


def test_bounds():
    bounds = neardup.least_matches(32, 160, 80, 1e-6)
    assert len(bounds) == 5 and bounds == sorted(bounds) and 5 <= bounds[0] <= 16 and bounds[-1] < 128


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    with Scratch(spark) as hold:
        got = {r.node: r.label for r in neardup.components(edges, hold).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_containment(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = {1: "x y " + item.upper() + "! z", 2: " ".join(words[:30]), 3: " ".join(words[:37]), 4: "a b c", 5: None, 6: "", 7: " ".join(f"q{i}" for i in range(30_000)) + " " + item, 8: "This is Too short,\nnow!", 9: "too short nowhere; too, short"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, "too short now"), (7, None), (6, "!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontam.contaminated(frame, bench).collect()}
    assert got == {(1, 9): (36, 36), (3, 9): (36, 33), (7, 9): (36, 36), (8, 8): (1, 1)}
    assert decontam.contaminated(frame, bench.filter("false")).count() == 0
    short = decontam.contaminated(frame, bench.filter("item_id = 8"))
    assert [(r.doc_id, r.item_id, r.containment) for r in short.collect()] == [(8, 8, 1.0)]
    assert {r.doc_id for r in decontam.without_benchmark(frame, bench).collect()} == {2, 4, 5, 6, 9}


def test_containment_odd(spark, odd, none):
    bench = odd.selectExpr("doc_id as item_id", "text")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()}
    assert {(5, 6), (6, 5), (7, 5), (5, 7), (10, 9), (3, 3), (4, 3), (4, 4)} <= got and not any(d in (0, 1, 2) for d, _ in got) and (3, 4) not in got
    assert decontam.contaminated(none, bench).count() == 0


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    exact = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    apart, next_apart = [], []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        s = lambda x: {tuple(x.split()[j : j + 5]) for j in range(len(x.split()) - 4)} if len(x.split()) >= 5 else {tuple(x.split())}
        if len(text.split()) >= 50:
            apart.append(abs(r.near_edited - exact(s(text), s(edited))))
            next_apart.append(abs(r.near_next - exact(s(text), s(after))))
            assert abs(r.in_next - len(s(text) & s(after)) / len(s(text))) < 0.25
    assert sum(apart) / len(apart) < 0.04 and max(apart) < 0.25 and sum(next_apart) / len(next_apart) < 0.02


def spark_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h >> 32


def test_fingerprint_contents(spark, odd):
    """All hashes below half the range, and the least one, by a second implementation."""
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, set()).add(r.text or "")
        for row in sketch.fingerprints(docs).collect():
            each = set()
            for text in texts[row.doc_id]:
                w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
                hashes = {spark_hash(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
                kept = sorted(h for h in hashes if h < 1 << 31) or sorted(hashes)[:1]
                each.add("".join(f"{h:08X}" for h in kept))
            assert row.fingerprint in each


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(400)]
    rows = [(" ".join(words[:250]), " ".join(words[100:])), ("a b c d e", "a b c d e f"), ("", "a b"), ("", "")]
    made = lambda c: sketch.sketch_of(sketch.words_of(F.col(c)))
    both = spark.createDataFrame(rows, "a string, b string").select(made("a").alias("x"), made("b").alias("y"))
    got = both.select("x", "y", sketch.merge(F.col("x"), F.col("y")).alias("m"), sketch.containment(F.col("x"), F.col("y")).alias("c"), sketch.likeness(F.col("x"), F.col("y")).alias("l")).collect()
    ceiling = 1 << 31
    for r in got:
        union = sorted(set(r.x) | set(r.y))
        assert r.m == ([h for h in union if h < ceiling] or union[:1])
    assert abs(got[0].c - 146 / 246) < 0.1 and abs(got[0].l - 146 / 396) < 0.1 and got[3].l == got[3].c == 1.0 and got[2].l == 0.0


def test_fingerprints_odd(odd, none, monkeypatch):
    rows = sketch.fingerprints(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].fingerprint == by[6][0].fingerprint and by[0][0].fingerprint == by[1][0].fingerprint == ""
    assert sketch.fingerprints(none).count() == 0


def test_runs_give_the_global_next(spark):
    docs = spark.createDataFrame([(i * 3, f"text {i}") for i in range(500)], "doc_id long, text string")
    for most in (4, 16384):  # runs cut further by steps of doc_id, and by quantiles alone
        got = {r.doc_id: r.next_text for r in sketch.with_next(docs, run_rows=20, most=most).collect()}
        assert got == {i * 3: f"text {i - 1 if i else 499}" for i in range(500)}
        runs = docs.groupBy(sketch.runs_of(docs, 20, most)).count().collect()
        assert len(runs) >= 20 and max(r["count"] for r in runs) <= 60
