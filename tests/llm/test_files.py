"""Token files against the tokenizer itself, and their parts one by one."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import token_files
from chronofold.llm.queries import tokenizer_path

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def plain(tokenizer, rows):
    """(doc_id, start, n, crc, ids), in the order of the files."""
    out, start = [], 0
    made = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")) for d, t in rows]
    for d, ids in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].astype("<u2")), len(r[1]))):
        out.append((d, start, len(ids), zlib.crc32(ids), ids.tolist()))
        start += len(ids)
    return out


ROWS = [*AWKWARD, AWKWARD[10], (9, "a second text of one key"), (20, "<|endoftext|> is ordinary  text  \x1c x\t\n y  \n")]


@pytest.mark.parametrize("file_bytes", [1 << 23, 300])
def test_round_trip(docs, tokenizer, file_bytes):
    df = docs(ROWS).withColumnRenamed("source", "KEY_").withColumnRenamed("lang", "frame")
    files = token_files.write(df, tokenizer_path("byte_bpe_50k.json"), 0, file_bytes=file_bytes)
    got = sorted((tuple(r) for r in files.rows(ids=True).collect()), key=lambda r: r[1])
    assert got == plain(tokenizer, ROWS)
    assert [s for _, _, _, s in files.manifest] == np.cumsum([0, *(n for _, _, n, _ in files.manifest)])[:-1].tolist()
    assert len(files.manifest) > 1 or file_bytes > 300


def test_single_documents(docs, tokenizer):
    files = token_files.write(docs(ROWS), tokenizer_path("byte_bpe_50k.json"), 0)
    found = {}
    for uri, n, _, _ in files.manifest:
        reader = token_files.Reader(uri, files.dictionary)
        assert len(reader.index) == n
        for d in (9, 14, 999):
            found.setdefault(d, []).extend(ids.tolist() for ids in reader.of(d))
        with pytest.raises(ValueError):
            token_files.Reader(uri, files.dictionary + b"x")
    want = plain(tokenizer, ROWS)
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(r[4] for r in want if r[0] == d) for d in (9, 14, 999)}


def test_no_documents(docs):
    files = token_files.write(docs([]), tokenizer_path("byte_bpe_50k.json"), 0)
    assert files.manifest == [] and files.rows().count() == 0
    assert files.rows(ids=True).columns == ["key", "start", "n_ids", "ids_crc32", "ids"]


def test_dictionary_is_of_use(docs):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(60)]
    df = docs([(i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(3000)])
    path = tokenizer_path("byte_bpe_50k.json")
    found = token_files.train_dictionary(df, path, 0, "doc_id", "text", 1 << 14, 500)
    size = lambda d: token_files.compressed(df, path, 0, d, "doc_id", "text", 3).selectExpr("sum(octet_length(frame))").first()[0]
    assert 0 < len(found) <= 1 << 14 and size(found) < 0.8 * size(b"")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", " ", "a", "don't", "é", "Straße", "õx.", ".\n", ",", "Ł", "12", "!?", "日本", "\U0001f600", "<|endoftext|>", "\x85", "　"]), max_size=25))
def test_chunks_have_the_ids_of_the_text(tokenizer, parts):
    text = "".join(parts)
    got = token_files.encoder(tokenizer_path("byte_bpe_50k.json")).encode(text)
    assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
