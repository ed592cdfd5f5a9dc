import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from sparquill.llm import bpe, queries

RANKS, PATTERN = queries.tokenizer()
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "a", "it's  two\n\n words", "é" * 50, "a" * 30_000, "日本 42 " * 100, "<|endoftext|>", "same", "same"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_merges_are_the_library_s(text):
    import regex

    assert [i for p in regex.findall(PATTERN, text) for i in bpe.merge(p.encode(), RANKS)] == LIBRARY.encode_ordinary(text)


def test_round_trip(spark, documents):
    docs = documents(TEXTS).withColumnsRenamed({"score": "ids"})
    rows = bpe.round_trip(docs, RANKS, PATTERN).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == [LIBRARY.encode_ordinary(t or "") for t in TEXTS]
    assert [bytes(r.decoded).decode() for r in rows] == [t or "" for t in TEXTS]
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_encode_then_decode(spark, documents):
    ids = bpe.encode(documents(TEXTS[:4]), RANKS, PATTERN)
    assert [bytes(r.decoded).decode() for r in bpe.decode(ids, RANKS).orderBy("doc_id").collect()] == [t or "" for t in TEXTS[:4]]


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(None,), ([],), ([72],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(df, RANKS).collect()][:2] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), RANKS).collect()


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    memo = bpe._Memo(RANKS)
    for w in ["a", "bcd", "efg", "hij", "a", "klm", "bcd"] * 2:
        assert memo[w] == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode_ordinary(w))
    assert len(memo) <= 3 and len(memo.old) <= 3


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, d).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_vocabulary_is_outside_the_repository():
    assert "sparquill" not in public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
