import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trifold.llm import packing, tokenbits
from trifold.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}
ODD = ["a  b\n\n c\t d\r\n", "I'm he's 'S they'LL", "", " ", "\n", "x y z　", "ﬁ Ⅳ ²³ ½ 12345 é é İ ß ẞ Σς ΑΣ", "<|endoftext|> hi", "a\x1cb", "日本語 テスト", "😀😀 a😀b", "' 's", "µ ª º ×÷", "\x85x", "a\n b"]


@pytest.mark.parametrize("name", FILES)
def test_equals_the_library(name):
    e = ENCODERS[name]
    for text in ODD:
        assert e.encode(text) == e.whole(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'É́ \n\t.1sS😀$ "), max_size=30), st.sampled_from(FILES))
def test_equals_the_library_on_any_text(text, name):
    assert ENCODERS[name].encode(text) == ENCODERS[name].whole(text)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 31), st.integers(0, 400), st.integers(0, 2**32))
def test_bits_round_trip(width, count, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, count).astype(np.uint32)
    assert (tokenbits.unpack_bits(tokenbits.pack_bits(ids, width), width, count) == ids).all()


def test_segment_reads_at_random():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 5, 9000, 1, 4096, 70])
    ids = rng.integers(0, 49408, lengths.sum()).astype(np.uint32)
    one = tokenbits.Segment(tokenbits.write_segment(np.arange(6), lengths, ids, 16))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for k in range(6):
        assert (one.document(k) == ids[starts[k] : starts[k + 1]]).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (one.ids(a, b) == ids[a:b]).all()


def ids_of(text, tokenizer):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_files_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    t, at = Tokenizer.from_file(path), 0
    rows = tokenbits.token_files(docs, path).orderBy("doc_id").collect()
    for row, doc in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = ids_of(doc.text, t)
        assert tuple(row) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def check_packing(rows, texts, tokens=1024):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids, at = ids_of(text, t), 0
        for k, r in enumerate(sorted(by[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == tokens or k == 0
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens
    return len(bins), sum(r.length for r in rows) / tokens


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_packing(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), rule=rule).collect()
    bins, least = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert bins <= 1.02 * least + 2


def test_every_capacity_holds():
    lengths = np.sort(np.random.default_rng(2).integers(1, 100, 500))[::-1]
    bins, _ = packing.best_fit(lengths, 100, 3, 4000)
    for b in np.unique(bins):
        held = lengths[bins == b]
        assert held.sum() <= 100 and len(held) <= 3 and (len(held) == 1 or (held**2).sum() <= 4000 or held.max() ** 2 > 4000)


def test_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count() and packing.pack_documents(none, path).count() == 0
    found = tokenbits.token_files(odd, path).collect()
    assert len(found) == odd.count() and tokenbits.token_files(none, path).count() == 0
    packed = packing.pack_documents(odd.dropDuplicates(["doc_id"]), path)
    made = packing.sequences(odd.dropDuplicates(["doc_id"]), packed, path).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in packed.collect())


def test_exported_files(spark, odd, tmp_path):
    path = tokenbits.write_segments(odd, public_tokenizers.path("byte_bpe_50k.json"), 2)
    n = tokenbits.export_segments(spark, path, str(tmp_path))
    images = [tokenbits.Segment((tmp_path / f).read_bytes()) for f in sorted(p.name for p in tmp_path.iterdir())]
    assert len(images) == n and sum(len(x.doc_ids) for x in images) == odd.count()


def test_one_block_of_a_stored_image(spark):
    """A document's ids come from the blocks that hold them alone: the rest of the query's own files may be destroyed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts, t = {r.doc_id: r.text for r in docs.collect()}, Tokenizer.from_file(path)
    stored = tokenbits.write_segments(docs, path, 2, segment_ids=40_000)
    images = spark.read.parquet(stored).orderBy("run", "segment").collect()
    assert len(images) > 1 and [i for r in images for i in tokenbits.Segment(r.image).doc_ids] == sorted(texts)
    for row in images:
        one = tokenbits.Segment(row.image)
        assert row.n_ids == one.n_ids and row.n_docs == len(one.doc_ids) and one.width == 16
        for k in range(0, row.n_docs, 7):
            first, last = int(one.starts[k]) // one.block_ids, -(-int(one.starts[k + 1]) // one.block_ids)
            begin = len(row.image) - len(one.payload)
            wiped = bytearray(b"\xff" * len(row.image))
            wiped[:begin] = row.image[:begin]
            kept = slice(begin + int(one.offsets[first]), begin + int(one.offsets[last]))
            wiped[kept] = row.image[kept]
            assert (tokenbits.Segment(bytes(wiped)).document(k) == ids_of(texts[one.doc_ids[k]], t)).all()


def test_memory_is_bounded_in_bytes():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.of_spaced.limit = 50_000
    for k in range(3000):
        text = f"see word{k:x}q a{'b' * 100}{k}"
        assert e.encode(text) == e.whole(text)
        assert e.of_spaced.size <= 50_000 and len(e.of_spaced) + len(e.of_spaced.old) < 700
    assert max(map(len, e.of_spaced)) <= 64
