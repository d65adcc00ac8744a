import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(1, base), (2, base), (3, base + " today"), (4, None), (5, ""), (6, "   \n\t"), (7, "one two"), (None, base), (8, "x" * 50_000), (9, ("word%d " * 1) % 5 * 20_000), (2, base), (10, "ÀÉ ß 😀 <|endoftext|> \x0b mail a.b@c.de")]
    full = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"src{n % 2}", None) for n, (i, t) in enumerate(rows)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("score", "th", "cls", "words", "size", "key", "target", "s", "d", "h", "q_words", "__q", "tok", "hub", "tried", "n_tokens", "tree_chars", "start", "kind", "item_id", "comp", "label")})
