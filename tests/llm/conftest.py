import pytest

EXTRA = "key string, row long, sha string, suspect boolean, words array<string>, node long, label string, place long, piece int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
CLASH = ("k", 3, "s", True, ["w"], 4, "l", 5, 6)


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns of clashing names."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *CLASH) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, repeated rows, ties and a very long text."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [
        (None, None), (None, "a b c"), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "a  b\tc"), (5, "a b c"),
        (5, "a b c"), (5, "another text"), (6, long), (7, long), (8, "é ü ß　x \x1c y z"), (9, "a b c "),
    ]
