"""Encoding and decoding against the sentencepiece library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from weekloom.llm import pieces
from weekloom.llm.pieces import PieceCoder, decoded, encoded, round_trip
from weekloom.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "  ", "\n", "\t\r\n", "▁", " ▁▁ x", "\0", " x", "ﬁ", "😀🜀", "a" * 500, "=" * 3000, "é中文" * 100, "<s>", "<unk>", "<0x0A>", "x" * 47, "x" * 48, "x" * 49]


@pytest.fixture(scope="module")
def coder():
    with open(MODEL, "rb") as f:
        return PieceCoder(f.read())


def test_ids_equal_the_librarys(coder):
    r = random.Random(7)
    alphabet = ["  ", " ", "▁", "\n", "the", "ing", "é", "中", "文", "ﬁ", "\0", "😀", "🜀", ".", ",", "12", "int ", "return", "x", "aa", "tt", "é"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    assert [x.tolist() for x in coder.encode_all(texts)] == [LIBRARY.encode(t) for t in texts]


def test_heap_and_rounds_agree(coder):
    r = random.Random(3)
    chunks = ["".join(r.choice("▁abcdehinorst中é🜀") for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    assert coder.short(chunks) == [coder.long(c) for c in chunks]


def test_long_text_and_forgetting(coder, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 50)
    text = " ".join(f"word{k} {'ab' * (k % 40)}" for k in range(5000))
    for _ in range(2):
        assert coder.encode(text).tolist() == LIBRARY.encode(text)
    assert len(coder.known) < 12000
    assert coder.encode("abcdefgh" * 20000).tolist() == LIBRARY.encode("abcdefgh" * 20000)


def test_repeated_chunks_are_looked_up_once(coder, monkeypatch):
    """A slice asks for each distinct chunk, not for each that it holds; texts in one slice don't join at their ends."""
    asked = []

    class Counting(dict):
        def get(self, chunk, default=None):
            asked.append(chunk)
            return super().get(chunk, default)

        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)

    monkeypatch.setattr(coder, "known", Counting())
    texts = ["one two three " * 700, "", "ab", "c", " ", "", "cd", "é🜀 中", "one two"]
    assert [x.tolist() for x in coder.encode_all(texts)] == [LIBRARY.encode(t) for t in texts]
    assert len(asked) < 40


def test_decoding_any_ids(coder):
    r = random.Random(5)
    n = LIBRARY.get_piece_size()
    for _ in range(5000):
        ids = [r.choice([r.randrange(n), r.randrange(0, 262), r.choice([0, 1, 2, 28705, 259])]) for _ in range(r.randrange(9))]
        assert coder.decode(ids) == LIBRARY.decode(ids), ids
    with pytest.raises(IndexError):
        coder.decode([n])
    with pytest.raises(IndexError):
        coder.decode([-1])


def test_decoding_a_slice(coder):
    r = random.Random(8)
    n = LIBRARY.get_piece_size()
    lists = [[], [0], [259], []] + [[r.choice([r.randrange(n), r.randrange(0, 262), r.choice([0, 1, 2, 28705, 259])]) for _ in range(r.randrange(9))] for _ in range(3000)]
    arrays = [np.array(x, np.int32) for x in lists]
    assert coder.decode_all(arrays) == [LIBRARY.decode(x) for x in lists]
    assert coder.decode_all([]) == [] and coder.decode_all(arrays[:1]) == [""]
    for bad in (n, -1):
        with pytest.raises(IndexError):
            coder.decode_all([np.array([5, bad], np.int32)])


def test_columns_nulls_and_clashes(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, None, None), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = round_trip(docs, MODEL).collect()
    assert len(out) == 4 and all(r["same_as_library"] for r in out)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in out) == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (3, 0, "")]
    assert encoded(docs.limit(0), MODEL).collect() == []
    ids = spark.createDataFrame([([264, None, 287],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in decoded(ids, MODEL).collect()] == [LIBRARY.decode([264, 287]), None, ""]


def test_other_types_of_model_are_refused():
    with pytest.raises(Exception):
        PieceCoder(b"no model")


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in QUERIES["op13_pieces"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "")
        r = found[d["doc_id"]]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
        assert r["same_as_library"]
