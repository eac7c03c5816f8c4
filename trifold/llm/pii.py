"""Operator 3: personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers,
found by pattern and checked (parts of an address, Luhn digits, digit counts).

The information-theoretic part follows the idea that a term t discloses a
protected entity e as far as seeing t tells which entity is meant. Over the
distinct sentences of the corpus,

    PMI(t; e) = log2(n(t, e) * N / (n(t) * n(e))),   IC(e) = log2(N / n(e)),

and t discloses e if PMI >= alpha * IC, where n(t, e) is at least `support`
distinct sentences (one sentence alone, or copies of it, say nothing about a
relation). Such terms are protected in every document, whether it has the entity
or not: all their occurrences become spans of kind ``term``. In the sanitised text
a term that occurs with its entity only is removed, others become ``[TERM]``; base
spans become ``[EMAIL]``, ``[IP]``, ``[CARD]`` and ``[PHONE]``.

Counts cover all documents and are exact. Each distinct sentence moves once and
its words are counted where it lands, so that the shuffle follows the input. Only
candidate terms (those with enough support) are counted while they are few.

Only DataFrame functions are used. The patterns are written with possessive
quantifiers and a look-behind so that no text makes Java's matcher backtrack
or recurse deeply; they match exactly what the plain patterns match. Positions
are code points, end exclusive.

Defined results: null is the empty text, without spans; rows that share a doc_id
share their terms; a row with null doc_id has its base spans only; very long texts
are read whole; an empty table gives no row; further columns are not read by
the query and kept by `sanitised`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import few_strings, fresh, let
from trifold.storage import Scratch, cut

KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap conditions without which a kind can't occur.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
SENTENCE = r"\n|(?<=[.!?]) "
LETTERS = r"[\p{L}]++"
NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def holds(kind: str):
    return lambda match: valid(kind, match)


def located(text: Column, pattern: str, rank: int, kind: str, keep) -> Column:
    """Spans of the pattern's matches for which keep(match) holds, in order, by one fold over the pieces between matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        gap, match = pair["gap"], pair["match"]
        begin = state["at"] + F.length(gap)
        end = begin + F.coalesce(F.length(match), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        out = F.when(match.isNotNull() & keep(match), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step, lambda state: state["out"])


def base_spans(text: Column) -> dict[str, Column]:
    found = {}
    for rank, kind in enumerate(KINDS):
        possible = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        spans = located(text, PATTERNS[kind], rank, kind, holds(kind))
        found[kind] = F.when(possible, spans).otherwise(F.array().cast(NO_SPANS))
    return found


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def entities(text: Column) -> Column:
    """Lower-cased valid matches of all kinds."""
    each = [F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)), holds(k)) for k in KINDS]
    return F.array_distinct(F.transform(F.concat(*each), lambda m: F.lower(m)))


def terms_of(sentence: Column) -> Column:
    """Distinct lower-cased words of three letters or more, outside anything that a base pattern matches."""
    plain = sentence
    for kind in KINDS:
        plain = F.regexp_replace(plain, PATTERNS[kind], " ")
    return F.array_distinct(F.filter(F.split(F.lower(plain), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))


def based_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, the count of each kind, and base (all spans in order)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    return spans.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(F.concat(*KINDS)).alias("base"))


def disclosing_terms(docs: DataFrame, hold: Scratch, alpha: float = 0.95, support: int = 2) -> DataFrame:
    """entity, term, ratio (PMI / IC) and alone (the term occurs with this entity only), for terms at or above alpha."""
    based = hold.cut(based_rows(docs).filter(F.size("base") > 0).select("text"), "base-spans")
    held = based.select(F.explode(F.split("text", SENTENCE)).alias("sentence"))
    held = held.select("sentence", F.explode_outer(entities(F.col("sentence"))).alias("entity")).filter("entity is not null").distinct()
    of_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    together = held.select("entity", F.explode_outer(terms_of(F.col("sentence"))).alias("term")).filter("term is not null")
    together = together.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= support)
    together = hold.cut(together.join(of_entity, "entity"), "co-occurrence")

    # the empty term stands for every sentence once, so its count is N; sentences move once each, words are counted where they are
    sentences = docs.select(F.explode_outer(F.split("text", SENTENCE)).alias("sentence")).filter("sentence is not null").distinct()
    words = sentences.select(F.explode(F.array_union(F.split(F.lower("sentence"), r"[^\p{L}]+"), F.array(F.lit("")))).alias("term"))
    wanted = together.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    wanted = hold.cut(wanted, "candidate-terms")
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    if few_strings(wanted, "term"):
        counted = words.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counted = hold.cut(counted, "term-counts")
    row = counted.filter("term = ''").first()
    total = F.lit(row["n_t"] if row else 0)
    rated = together.join(counted, "term")
    pmi = F.log2(F.col("n_te") * total / (F.greatest("n_t", "n_te") * F.col("n_e")))
    ratio = pmi / F.log2(F.greatest(total / F.col("n_e"), F.lit(1.0 + 1e-9)))
    return rated.select("entity", "term", ratio.alias("ratio"), (F.col("n_t") <= F.col("n_te")).alias("alone")).filter(F.col("ratio") >= alpha)


def document_terms(docs: DataFrame, **options) -> DataFrame:
    """doc_id with terms (to generalise) and alone (to remove), for documents that have a term which discloses any entity."""
    with Scratch(docs.sparkSession) as hold:
        found = disclosing_terms(docs, hold, **options).groupBy("term").agg(F.max("alone").alias("alone"))
        found = hold.cut(found, "disclosing-terms")
        words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term"))
        each = words.join(F.broadcast(found) if few_strings(found, "term") else found, "term").groupBy("doc_id")
        return cut(each.agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("alone"), F.col("term"))).alias("alone")), "document-terms")


def detect(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    terms = document_terms(docs, **options)
    with_terms = based_rows(docs).join(terms.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
    found = located(F.col("text"), LETTERS, len(KINDS), "term", lambda m: F.array_contains("terms", F.lower(m)))
    clear = F.filter(found, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear)))
    out = with_terms.select("doc_id", *[f"n_{k}" for k in KINDS], joined(F.col("base")).alias("own"), joined(every).alias("spans"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("own", 256).alias("base_sha256"), "spans")


def replaced(text: Column, pattern: str, new) -> Column:
    """text with each match m of the pattern replaced by new(m), linear in its length."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.concat(gap, F.when(m.isNotNull(), new(m)).otherwise(F.lit(""))))
    return F.array_join(both, "")


def tagging(kind: str):
    """text -> text with the kind's valid matches replaced by its tag."""

    def body(text: Column) -> Column:
        possible = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        tagged = replaced(text, PATTERNS[kind], lambda m: F.when(valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m))
        return F.when(possible, tagged).otherwise(text)

    return body


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with its columns, personal data and disclosing terms replaced in text; n_chars follows where it is a column."""
    terms = document_terms(docs, **options)
    of, generalised, removed = fresh(docs, "__of", "__terms", "__alone")
    joined_terms = docs.join(terms.select(F.col("doc_id").alias(of), F.col("terms").alias(generalised), F.col("alone").alias(removed)), docs["doc_id"] == F.col(of), "left")
    text = F.col("text")
    for kind in KINDS:
        text = let(text, tagging(kind))
    # a tag's word is matched with its brackets, and so is no term
    word = lambda m: F.when(F.array_contains(removed, F.lower(m)), F.lit("")).when(F.array_contains(generalised, F.lower(m)), F.lit("[TERM]")).otherwise(m)
    whole = let(text, lambda t: F.when(F.col(generalised).isNull(), t).otherwise(replaced(t, r"\[(?:EMAIL|IP|CARD|PHONE)\]|[\p{L}]++", word)))
    out = joined_terms.withColumn("text", whole)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
