import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from dagwright.llm.bpe import LONG, bpe_encode, encode_words, merged_by_heap, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_heap_and_fold_agree(spark):
    r, ranks = random.Random(5), read_ranks(PATH)
    words = ["".join(r.choice("theingaotnsßü é中") for _ in range(r.randint(1, 60))) for _ in range(60)] + ["a" * 200, "z"]
    df = spark.createDataFrame([([list(w.encode()) for w in words],)], "w array<array<smallint>>")
    got = df.select(encode_words(F.col("w"), ranks)).first()[0]
    assert got == [merged_by_heap(w.encode(), ranks) for w in words]


def test_runs_without_a_space(spark):
    r = random.Random(3)
    base64 = "".join(r.choice("ABCDEFGHabcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    texts = [base64, "学习" * 30_000, "x" * LONG, "x" * (LONG + 1), "on and " * 3 + "y" * 5000 + " on"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.ids for x in bpe_encode(df, PATH, PATTERN).collect()}
    own = tokenizer()
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]


def test_patterns_that_look_across_spaces(spark):
    pattern = r"\w+ \w+|\w+|\s+|[^\s\w]+"
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=read_ranks(PATH), special_tokens={})
    texts = ["one two three four", "a, b  c", ""]
    got = {x.doc_id: x.ids for x in bpe_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, pattern).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]
