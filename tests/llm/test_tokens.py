import tiktoken
from tiktoken.load import load_tiktoken_bpe

from __spark_entry__ import queries
from siftlake.llm.tokens import TOKENIZERS, VOCABULARY, encode, load_vocabulary
from siftlake.plans.session import table

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def test_every_document_as_the_public_encoder_has_it(spark, small):
    public = tiktoken.Encoding("50k", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(f"{TOKENIZERS}/{VOCABULARY}"), special_tokens={})
    docs = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text").collect()
    got = queries()["p8_ids"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<bigint>")]
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert len(rows) == len(docs) and rows == {r.doc_id: public.encode_ordinary(r.text or "") for r in docs}
    assert any(not r.text for r in docs)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    public = tiktoken.Encoding("50k", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(f"{TOKENIZERS}/{VOCABULARY}"), special_tokens={})
    texts = [None, "", " ", "don't we'll\r\n\r\n  x", "naïve 検索 🙂 ​\x00", "ab" * 60_000, " " * 5_000 + "x", "1234567 <|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "k long, t string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = sorted(((r.k, r.ids) for r in encode(docs, "k", "t").collect()), key=str)
    assert got == sorted(((k, public.encode_ordinary(t or "")) for k, t in rows), key=str)
    assert {(r.k, r.n_tokens) for r in encode(docs, "k", "t", counts_only=True).collect()} == {(k, len(i)) for k, i in got}
    assert encode(docs.limit(0), "k", "t").count() == 0


def test_every_key_has_its_place():
    v = load_vocabulary()
    assert len(v.token) == len(set(v.token.tolist())) == sum(len(t) <= 16 for t in v.ranks)
