import pytest


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty, repeated and long texts, ties, and columns whose names operators use."""
    long = " ".join(f"word{i}" for i in range(3000))
    base = " ".join(f"term{i}" for i in range(60))
    texts = [None, "", " \n ", "one", "one two three", base, base, base + " extra", base.upper(), long, long + " end", "Ünïcode 😀 text " * 30, "a@b.co 10.0.0.1"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None if t is None or i == 4 else len(t), 7, "x", 1.5, True) for i, t in enumerate(texts)]
    rows.append((5, base, "en", "s", len(base), 7, "x", 1.5, True))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, words string, score double, held_out boolean")


@pytest.fixture
def none(odd):
    return odd.filter("false")
