import itertools
import re
import textwrap
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_duplicates import brute_components
from tests.llm.test_pii import PLAIN, brute_disclosing, ok
from tests.llm.test_tokens import check_packing
from tests.oracle import compare, connection
from trifold.llm import hilbert, licences, queries, quality_fm, toxicity, words
from trifold.llm.words import Vocabulary, held_out, word_hashes

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, n, shards=40):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert len(rows) == n and set(by) <= set(range(shards))
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in held) == list(range(len(held))) for held in by.values())
    order = [r.hilbert for s in range(shards) for r in sorted(by.get(s, []), key=lambda r: r.slot)]
    assert order == sorted(order)


def test_shards(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = hilbert.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_shards(rows, len(texts))
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
    check_shards(hilbert.shard_documents(odd).collect(), odd.count())
    assert hilbert.shard_documents(none).count() == 0


def test_sizes_prune(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spans = hilbert.shard_documents(docs).groupBy("shard").agg((F.max("size") - F.min("size")).alias("s")).agg(F.median("s")).first()[0]
    assert spans < 3000


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("name,label,least,false", [("op1_quality_machine", "quality", 0.99, 0.1), ("op6_toxicity_network", "toxic", 0.85, 0.005)])
def test_held_out_accuracy(spark, name, label, least, false):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    score, y, predicted = (np.array([r[c] for r in rows]) for c in ("score", label, "predicted"))
    assert auc(score, y) >= least and predicted[y == 0].mean() <= false
    assert all(0 <= r.score <= 1 for r in rows)


def test_sum_of_squares_identity():
    machine = quality_fm.FactorisationMachine(30, 4)
    rng = np.random.default_rng(0)
    machine.w, machine.v, machine.w0 = rng.normal(size=30), rng.normal(size=(30, 4)), 0.3
    ids, x = np.array([3, 7, 9, 20]), np.array([1.0, 0.5, 2.0, 1.5])
    pairs = sum(machine.v[a] @ machine.v[b] * x[i] * x[j] for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2))
    assert np.isclose(machine.margin(ids, x, np.array([0]))[0][0], 0.3 + machine.w[ids] @ x + pairs)


def test_network_gradient():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, n) for n in rng.integers(3, 20, 80)]
    labels = np.array([float(7 in d) for d in docs])
    network = toxicity.TextCNN(50, dims=6, filters=4)
    network.fit(docs, labels, np.ones(80), epochs=40, batch=16)
    assert auc(network.margins(docs), labels) > 0.95 and np.isfinite(network.margins([np.empty(0, np.int64)])).all()


def test_classifiers_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(13)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality_fm.score_quality, toxicity.score_toxicity):
        rows = f(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert f(none, labels).count() == 0
        assert len(f(odd, labels.filter("false")).collect()) == odd.count()
    assert quality_fm.good_documents(odd, labels).columns == odd.columns
    got = odd.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_vocabulary():
    v = Vocabulary([np.array([5, 9], np.uint32), np.array([9, 5, 1], np.uint32)], 2, 10)
    assert v.ids(np.array([5, 1, 9, 7], np.uint32)).tolist() == [1, 0, 2, 0]


def letters(n):
    return "".join(chr(97 + int(c)) for c in str(n))


def test_toxicity_learns_every_labelled_row(spark, monkeypatch):
    # more than 2,500 rows of either label; every fifth learned row shares a word of its own with four others
    monkeypatch.setattr(toxicity, "SHARD", 2500)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word" + letters(w) for w in rng.integers(0, 300, 12)] + (["spite" + letters(i % 7)] if i % 2 else []))) for i in range(9000)]
    learned = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    own = {i: "own" + letters(k // 5) for k, i in enumerate(learned)}
    rows = [(i, f"{t} {own.get(i, '')}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    out = held_out(F.col("doc_id"), 3, 1)
    vocabulary, network, common, by = toxicity.fit(docs, labels, out, rounds=3)
    texts = dict(rows)
    brute = Vocabulary([word_hashes(texts[i]) for i in learned], 5, 30_000)
    assert vocabulary.hashes.tolist() == brute.hashes.tolist() and len(brute) > len(learned) // 5
    rest = [i for i in range(9000) if i not in own]
    margins = network.margins([vocabulary.ids(word_hashes(texts[i])) for i in rest])
    assert auc(margins, np.array(rest) % 2) > 0.99 and 0 < common < 1 and by == {}
    again = toxicity.fit(docs.repartition(5), labels.repartition(3), out, rounds=3)
    assert np.allclose(again[1].embed, network.embed, atol=1e-5) and np.isclose(again[2], common, atol=1e-4)


def test_round_is_the_mean_of_shards(spark, tmp_path):
    rng = np.random.default_rng(2)
    hashes = [rng.integers(0, 40, n).astype(np.uint32) for n in rng.integers(0, 20, 300)]
    shard, y = np.arange(300) // 100, np.array([int(7 in h) for h in hashes])
    vocabulary = Vocabulary(hashes, 1, 100)
    spark.createDataFrame([(int(s), int(v), bytearray(h.tobytes())) for s, v, h in zip(shard, y, hashes)], "shard int, label int, words binary").coalesce(1).write.parquet(f"{tmp_path}/t")
    network, mine = toxicity.TextCNN(len(vocabulary), dims=6, filters=4), []
    network.start()
    for s in range(3):
        at = np.flatnonzero(shard == s)
        one = toxicity.TextCNN(len(vocabulary), dims=6, filters=4)
        one.start()
        moves = one.learn([vocabulary.ids(hashes[i]) for i in at], y[at], np.where(y[at] == 1, 2.0, 0.5), np.random.default_rng((0, s, 0)))
        mine.append((one, moves))
    toxicity.train_round(spark.read.parquet(f"{tmp_path}/t"), network, vocabulary, (0.5, 2.0), 0)
    total = sum(m for _, m in mine)
    mean = sum(o.embed * m[:, None] for o, m in mine)[total > 0] / total[total > 0, None]
    assert (total > 0).sum() > 10 and np.allclose(network.embed[total > 0], mean, atol=1e-5)
    for part in (lambda o: o.dense, lambda o: o.offset, lambda o: o.kernels[2], lambda o: o.bias[1], lambda o: o.squares["k1"], lambda o: o.squares["o"]):
        assert np.allclose(part(network), sum(part(o) for o, _ in mine) / 3, rtol=1e-4, atol=1e-5)


def test_labelled_rows_beyond_broadcast(spark, monkeypatch):
    docs = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(docs.filter("doc_id = 7")).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    labels = spark.range(-9000, 9000, 9).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("toxic")).union(spark.createDataFrame([(7, 1), (7, 0), (None, 1), (8, None), (10, 3)], "doc_id long, toxic int"))
    out = held_out(F.col("doc_id"), 3, 1)
    few = words.labelled_rows(docs, labels, "toxic", out, [])
    monkeypatch.setattr(words, "BROADCAST_ROWS", 0)
    many = words.labelled_rows(docs, labels, "toxic", out, [])
    assert few[1] == many[1] and sorted(few[0].collect()) == sorted(many[0].collect())
    ids = {i for i in range(-9000, 9000, 9) if zlib.crc32(str(i).encode()) % 3 != 1} | ({7} if zlib.crc32(b"7") % 3 != 1 else set())
    assert {r.doc_id for r in many[0].collect()} == {i for i in ids if -3000 <= i < 3000} and many[1] == len(ids)
    held = words.may_hold(docs, labels).select("doc_id")
    assert held.count() < 800 and held.join(labels, "doc_id", "left_semi").count() == docs.join(labels, "doc_id", "left_semi").count()


def test_thresholds(spark):
    rng = np.random.default_rng(3)
    rows = [(x, int(y), float(s)) for x, y, s in zip(rng.choice(["en", "de", "fr"], 900, p=[0.6, 0.38, 0.02]), rng.integers(0, 2, 900), rng.integers(0, 40, 900) / 40)]
    rows = [(x, y, min(1.0, s + 0.2 * y)) for x, y, s in rows]
    got = {r.lang: r.threshold for r in toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, label int, score double"), ["lang"], 20)}
    assert set(got) == {"en", "de"}
    for lang, threshold in got.items():
        y, s = (np.array([r[k] for r in rows if r[0] == lang]) for k in (1, 2))
        f1 = {t: 2 * y[s >= t].sum() / ((s >= t).sum() + y.sum()) for t in sorted(set(s))}
        assert np.isclose(2 * y[s >= threshold].sum() / ((s >= threshold).sum() + y.sum()), max(f1.values()))


TEXTS = {
    1: ("Some words.\nReleased under the MIT License.\nMore.", "MIT"),
    2: ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. x", "Apache-2.0"),
    3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    4: ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC,All-Rights-Reserved"),
    5: ("// SPDX-License-Identifier: MIT", "MIT"),
    6: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list.\n2. Redistributions in binary form must reproduce the above copyright notice, this list.\nThis software is provided by the authors \"as is\" and any express or implied warranties are disclaimed.", "BSD-2-Clause"),
    7: ("Words only.", ""),
    8: (None, ""),
    9: ("Released under the MIT License.\nReleased under the MIT License.", "MIT"),
}


def test_licences(spark, odd, none):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert {k: r.licences for k, r in rows.items()} == {k: x for k, (_, x) in TEXTS.items()}
    assert rows[6].sentence_ids == "bsdPerm,bsdSource,bsdBinary,bsdAsIs" and rows[6].n_unmatched == 0
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).count() == 0


GPL = """{0} This program is free software{1} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""


def wrapped(text, mark="", gap="\n", width=72):
    return gap.join("\n".join(mark + line for line in textwrap.wrap(p, width)) + "\n" for p in text.split("\n\n"))


def test_licences_of_wrapped_texts(spark):
    texts = {
        "GPL-2.0-or-later": GPL.format("", ";", ";", 2), "GPL-3.0-or-later": GPL.format("", ":", ",", 3), "MIT": MIT, "BSD-3-Clause": BSD,
    }
    rows = [(f"{name} {k}", name, make(t)) for name, t in texts.items() for k, make in enumerate([str, wrapped, lambda t: wrapped(t, " * ", " *\n"), lambda t: wrapped(t, "# ", "#\n", 60), lambda t: wrapped(t).replace("\n", "\r\n")])]
    mixed = {
        "MIT,GPL-3.0": "A title\nReleased under the MIT License\nmore words without an end\nThis work is licensed under the GNU General Public License,\nversion 3.",
        "Apache-2.0": "# Copyright 2020 The Authors\n# SPDX-License-Identifier: Apache-2.0\nimport os\n",
        "CC-BY": "Available under Creative Commons Attribution\n4.0 International.",
    }
    rows += [(name, name, t) for name, t in mixed.items()]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.licences for r in licences.scan(docs).collect()} == {k: name for k, name, _ in rows}


def scanned(text):
    """The scan of one text, sentence by sentence and rule by rule."""
    hint = regex.compile(licences.HINT)
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    of = lambda x: next((name for name, p in licences.SENTENCES if re.fullmatch(p, plain(x))), "unknown")
    ids = []
    if hint.search(text):
        lines = []
        for line in regex.sub(licences.VERSION, r"\1 \2", text).split("\n"):
            if hint.search(line) and re.fullmatch(licences.OWN, plain(line)):
                line = f"\n{line}\n"
            elif hint.search(line) and re.fullmatch(licences.BEGINS, plain(line)):
                line = f"\n{line}"
            lines.append(line)
        for sentence in regex.split(licences.ENDS, "\n".join(lines), flags=regex.V1):
            if not hint.search(sentence):
                continue
            found = [of(sentence)]
            if found == ["unknown"] and "\n" in sentence:
                found = [i for i in map(of, filter(hint.search, sentence.split("\n"))) if i not in ("unknown", "copyright")] or found
            ids += found
    rest, names = [i for i in ids if i != "unknown"], []
    for name, rule in licences.RULES:
        k = 0
        while k + len(rule) <= len(rest):
            if rest[k : k + len(rule)] == rule:
                del rest[k : k + len(rule)]
                names.append(name)
            else:
                k += 1
    return len(ids), ids.count("unknown"), ",".join(ids), ",".join(dict.fromkeys(names)), len(rest)


def test_licences_equal_a_plain_scan(spark):
    texts = [t for t, _ in TEXTS.values()] + [make(GPL.format("x", ";", ";", 2) + t) for t in (MIT, BSD, "") for make in (str, wrapped, lambda t: wrapped(t, "# ", "#\n", 50))]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for row in licences.scan(docs).collect():
        assert tuple(row)[1:] == scanned(texts[row.doc_id] or ""), texts[row.doc_id][:500]
        some += row.licences != ""
    assert some > 20


def test_strings_with_a_common_prefix_get_levels_of_their_own(spark):
    rows = [(i, f"https://example.org/{i % 20:02}" if i % 21 else None) for i in range(420)]
    splits = hilbert.string_splits(spark.createDataFrame(rows, "doc_id long, source string"), "source", 16)
    names = ["", *[f"https://example.org/{k:02}" for k in range(20)]]
    assert splits == [names[i * 21 // 16] for i in range(1, 16)]
    docs = spark.createDataFrame([(i, f"https://example.org/{i % 8}", "t") for i in range(400)], "doc_id long, source string, tie string")
    placed = hilbert.hilbert_shards(docs, ["source"], ["doc_id", "tie"], 8).select("shard", "source").distinct().collect()
    assert len(placed) == 8 and len({r.shard for r in placed}) == 8


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, connection("/root/testdata/sf0.001"), queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""


def test_pipeline(spark):
    """Every stage against a brute-force version of its decisions, on what the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            good = quality_fm.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("score >= 0.3")
            want = {r.doc_id for r in good.collect()}
        elif name == "near_duplicates":
            want = {k for k, (_, c) in brute_components(list(before.items()), 5).items() if k == c}
        elif name == "decontamination":
            want = {k for k, t in before.items() if not any(contains(t, item) for item in items)}
        else:
            want = set(before)
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        assert docs.columns == columns and set(after) == want and (name == "personal_data" or all(after[k][0] == before[k] for k in after)), name
    terms = brute_disclosing(before.values(), 0.95, 2)
    for k, (text, n) in after.items():
        assert text == sanitised(before[k], terms) and n == len(text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    bins, least = check_packing(packed, {k: t for k, (t, _) in after.items()})
    assert {r.doc_id for r in packed} == set(after) and bins <= 1.02 * least + 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]


def contains(text, item, size=5):
    words = lambda x: [w for w in regex.split(r"[^\p{L}\p{N}]+", (x or "").lower()) if w]
    w, own = words(text), words(item)
    k = min(size, len(own))
    runs = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    return k > 0 and 100 * len(runs(own) & runs(w)) >= 80 * len(runs(own))


def sanitised(text, terms):
    for kind, pattern in PLAIN.items():
        text = re.sub(pattern, lambda m, kind=kind: f"[{kind.upper()}]" if ok(kind, m[0]) else m[0], text)
    word = lambda m: m[0] if m[0][0] == "[" or m[0].lower() not in terms else "" if terms[m[0].lower()] else "[TERM]"
    return regex.sub(r"\[(?:EMAIL|IP|CARD|PHONE)\]|\p{L}+", word, text)


def test_pipeline_odd(spark, odd, none, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(13)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is in any text here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns
            docs = docs.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
