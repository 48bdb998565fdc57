import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from dagwright.llm import queries
from dagwright.llm.bpe import bpe_decode, bpe_encode, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_whole_table(spark, tokenizer):
    at = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = tokenizer.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_byte_bpe(spark, at).collect()}
    assert got == want


def test_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  ", "a   b", "a \n b\n  c", "\n\n x \t\n", "it's 'LL <|endoftext|> 12 3", "é́ \U0001f600\U0001f600 　 x  y", "x" * 3000 + " " * 50 + "z", "a\x1c b \x1fc", "%%% a.b,c  --", "The the The"]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS words")
    out = bpe_encode(df, PATH, PATTERN).withColumn("bytes", bpe_decode(F.col("ids"), PATH)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        t = texts[r.doc_id or 0] or ""
        assert r.ids == tokenizer.encode_ordinary(t) and bytes(r.bytes) == t.encode(), repr(t[:40])


def test_empty_table(spark):
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []
