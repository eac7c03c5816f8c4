import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex

from trifold.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(kind, m[0])]
    return sorted(spans)


def check(rows, texts):
    for row in rows:
        spans = brute(texts[row.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (texts[row.doc_id][:300], base, row.spans)
        for kind in PLAIN:
            assert row[f"n_{kind}"] == sum(s[3] == kind for s in spans)
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))


ODD = [
    None,
    "",
    "a.b%c+d@e-f.g.h._x@y.z @a.b x@y",
    "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.256 001.002.003.0255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4 1 1 1  4111111111111111",
    "+1 (743) 555-3824 +1+2+3 +49.30.1234567 +123456789012345678",
    "é😀 a@b.co 😀 10.0.0.1 é +1 (743) 555-3824",
    "a" * 2_000,
    "1" * 2_000,
    "1-" * 500 + "a@b.c " + "." * 500,
    "+" + "(" * 1_000,
]
#: Texts on which the plain patterns take quadratic time, with their spans.
LONG = {
    "a" * 300_000: "",
    "1" * 300_000: "",
    "1-" * 100_000 + " a@b.c " + "." * 100_000: "email:200001:200006",
    "+" + "(" * 100_000: "",
}


def test_base_spans_equal_the_plain_patterns(spark):
    random.seed(5)
    texts = dict(enumerate(ODD + ["".join(random.choice("a1.@+ -(4é") for _ in range(60)) for _ in range(1500)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pii.detect(docs).collect(), texts)


def test_long_runs_take_linear_time(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    assert [r.spans for r in pii.detect(docs).orderBy("doc_id").collect()] == list(LONG.values())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.detect(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)


def test_terms_that_occur_with_an_entity_only(spark):
    rows = [(i, f"Filler sentence number with words {chr(97 + i % 20) * 4}. Other things here.", "x") for i in range(200)]
    rows += [(900, "Write to Zephyrine now at zq@mail.com please. Zephyrine was here.", "x"), (901, "Ask Zephyrine about zq@mail.com today. And words.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __of string")
    found = {r.doc_id: r.spans for r in pii.detect(docs, alpha=0.8).collect()}
    assert found[900].count("term:") == 2 and "email:26:37" in found[900]
    assert all(v == "" for k, v in found.items() if k < 900)
    clean = {r.doc_id: r for r in pii.sanitised(docs, alpha=0.8).collect()}
    assert clean[900].text == "Write to [TERM] now at [EMAIL] please. [TERM] was here." and clean[900]["__of"] == "x"
    assert all(clean[k].text == t for k, t, _ in rows if k < 900)


def test_terms_in_documents_without_the_entity(spark):
    rows = [(i, f"Filler sentence number with words {chr(97 + i % 20) * 4} {chr(97 + i // 20) * 4}. Other things here.") for i in range(200)]
    rows += [(900, "Write to Zephyrine now at zq@mail.com please."), (901, "Ask Zephyrine about zq@mail.com today."), (902, "Nobody but zephyrine was there."), (903, "Zephyrines came.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.detect(docs, alpha=0.8).collect()}
    assert found[902] == "term:11:20" and found[900] == "term:9:18,email:26:37" and all(found[k] == "" for k, _ in rows if k not in (900, 901, 902))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, alpha=0.8).collect()}
    assert clean[902] == "Nobody but [TERM] was there." and clean[901] == "Ask [TERM] about [EMAIL] today." and clean[903] == "Zephyrines came."


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.detect(docs).count() == 0 and pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).count() == 0


def brute_disclosing(texts, alpha, support):
    """term -> it occurs with one entity only, by counting over all pairs of distinct sentences."""
    sentences = {s for t in texts if t is not None for s in re.split(r"\n|(?<=[.!?]) ", t)}
    words_of = {s: set(regex.split(r"[^\p{L}]+", s.lower())) for s in sentences}
    n_t = Counter(w for words in words_of.values() for w in words)
    n_e, n_te = Counter(), Counter()
    for s in sentences:
        found = {s[a:b].lower() for a, _, b, _ in brute(s)}
        if not found:
            continue
        plain = s
        for pattern in PLAIN.values():
            plain = re.sub(pattern, " ", plain)
        terms = {w for w in regex.split(r"[^\p{L}]+", plain.lower()) if len(w) >= 3}
        n_e.update(found)
        n_te.update((e, t) for e in found for t in terms)
    out, n = {}, len(sentences)
    for (e, t), both in n_te.items():
        if both >= support and math.log2(both * n / (max(n_t[t], both) * n_e[e])) >= alpha * math.log2(max(n / n_e[e], 1 + 1e-9)):
            out[t] = out.get(t, False) or n_t[t] <= both
    return out


def check_terms(rows, texts, alpha=0.95):
    terms = brute_disclosing(texts.values(), alpha, 2)
    for row in rows:
        text = texts[row.doc_id] or ""
        base = brute(text)
        words = [(m.start(), 4, m.end(), "term") for m in regex.finditer(r"\p{L}+", text) if m[0].lower() in terms]
        spans = sorted(base + [w for w in words if not any(a < w[2] and w[0] < b for a, _, b, _ in base)])
        assert row.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans), text[:300]
    return terms


@pytest.mark.parametrize("alpha", [0.5, 0.95])
def test_terms_equal_brute_force(spark, alpha):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_terms(pii.detect(docs, alpha=alpha).collect(), texts, alpha)


def test_terms_of_made_texts_equal_brute_force(spark, monkeypatch):
    random.seed(8)
    people = [(f"Person{chr(97 + i) * 3}", f"u{i}@mail.com") for i in range(12)]
    texts = {}
    for k in range(300):
        name, mail = random.choice(people)
        said = [f"{random.choice(['Ask', 'Tell', 'Write to'])} {name} at {mail} {random.choice('xyz') * 4} now.", f"The {random.choice(['house', 'river', 'tree'])} of {name} stands {random.choice('pqr') * 5}.", "Words only."]
        texts[k] = " ".join(random.sample(said, 2)) + "\n" * (k % 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for few in (True, False):  # candidate terms broadcast, and too many for that
        monkeypatch.setattr(pii, "few_strings", lambda *_, few=few: few)
        assert check_terms(pii.detect(docs, alpha=0.7).collect(), texts, 0.7)
