import pytest


@pytest.fixture(scope="session")
def shared(spark):
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(shared):
    """Makes a documents table from (doc_id, text[, lang])."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s0" if i % 3 else None, len(r[1] or "")) for i, r in enumerate(rows)]
        return shared.createDataFrame(full, DOCS).repartition(3)

    return make


#: Nulls, empty texts, blanks, a very long text, ties and repeated rows.
LINE = "a line that many of the documents share"
PASSAGE = "".join(f"passage {i * i} of words, " for i in range(40))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\n"),
    (4, "héllo wörld ß İstanbul 日本語 \U0001f600 end"),
    (5, "x" * 5000),
    (6, " ".join(f"w{i}" for i in range(60_000))),
    (7, f"one\n{LINE}\n two\n{LINE.upper()} "),
    (8, f"{LINE}\nthree " + PASSAGE),
    (9, f"four\n  {LINE}\t\n" + PASSAGE + "tail"),
    (10, "ab " * 500),
    (11, PASSAGE + "alpha beta"),
    (12, PASSAGE + "alpha gamma"),
    (13, "mail a.b@c-d.org or +1 (212) 555-0187, 10.0.0.256 and 10.0.0.25 card 4111 1111 1111 1111"),
    (14, "the quick brown fox"),
    (15, "The quick BROWN fox"),
    (None, "no id but the text"),
]
