import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, to clash with.
EXTRA = ("fp", "chunk", "bucket", "toxic", "p_toxic", "n_words", "kept", "tokens", "name", "of_id", "kept_id", "shard", "n", "node", "source_key")


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with further columns whose names clash."""

    def make(rows, extra=EXTRA, source=lambda i: f"src{(i or 0) % 2}", lang=lambda i: "en"):
        full = [(i, t, lang(i), source(i), len(t or ""), *["x"] * len(extra)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENT + "".join(f", {c} string" for c in extra))

    return make


#: A null text, an empty one, white space, a repeated row, a null id, ties and a very long text.
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "a row without a name, idiot"),
    (None, None),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (6, "long " * 30_000 + "a.b@c.example.com"),
    (7, "漢字   é ▁ \x00 <|endoftext|> 10.0.0.1"),
]


@pytest.fixture
def odd(frame):
    return frame(ODD)


@pytest.fixture
def empty(frame):
    return frame([])
