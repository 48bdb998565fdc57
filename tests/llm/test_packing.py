import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dagwright.llm.packing import assign, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, pieces, room=2048, waste=None):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in rows}
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert len(own) == p.length and zlib.crc32(own.tobytes()) == p.ids_crc32
    assert set(docs) == set(ids)
    for d, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= room
    total = sum(map(len, ids.values()))
    assert len(seqs) == -(-total // room) or waste


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], pack(docs, PATH).collect())


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "A\x1cb  c d E\x85f"), (4, "<|endoftext|> it's I'LL é İ 12 34.5 \U0001f600 x" * 900), (5, " \n\t "), (6, "ΣΑΣ '' 's's")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "1 AS hash", "2 AS ids")
    check(rows, pack(df, PATH, room=64).collect(), 64)


def test_nulls_and_repeats(spark):
    rows = [(None, "a b"), (None, "a b"), (7, "c"), (7, "c")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sum(p.length for p in got) == 3 + 3 + 2 + 2 and len(got) == 4


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_balance_and_descending():
    g = np.random.default_rng(0)
    n = g.integers(1, 2048, 500)
    out = assign(n, 2048, 1.0, 1 / 1024)
    fill, cost = defaultdict(int), defaultdict(float)
    for _, _, m, s, _ in out:
        fill[s] += m
        cost[s] += m + m * m / 1024
    assert sum(fill.values()) == n.sum() and len(fill) == -(-n.sum() // 2048)
    assert len(out) < 500 * 1.4
    assert np.std(list(cost.values())) < 0.25 * np.mean(list(cost.values()))


def test_segments_have_the_tokenizers_ids():
    from dagwright.llm.packing import SegmentIds

    with open(PATH, "rb") as f:
        own = SegmentIds(f.read(), "<u4")
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = ["It's, I'LL. can't!? É,È; ẞ. İ, ΑΣ. x². a.,b é, ́. 3.5, '' 's, ...", "<|endoftext|>, Don't!! ., é.́  x"]
    for x, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_a_vocabulary_that_looks_across_white_space(spark, tmp_path):
    """Without the lower case that shared segments rest on, texts are encoded whole."""
    import json

    model = json.loads(open(PATH).read())
    model["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(model))
    rows = [(1, "The THE the, it's A B"), (2, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), str(other), keep_ids=True).collect()
    want = Tokenizer.from_file(str(other)).encode(rows[0][1], add_special_tokens=False).ids
    assert [np.frombuffer(p.ids, "<u4").tolist() for p in got if p.doc_id == 1] == [[*want, 1]]


def test_segments_agree_with_whole_texts():
    from dagwright.llm.packing import SegmentIds

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    s = SegmentIds(open(PATH, "rb").read(), "<u2")
    s.LIMIT = 50
    texts = ["Ärger, GRÜSSE. Straße! café", "don't I'LL 's s's x's.", "a|b | c || d", "12.5, x1. 1x; ½ ²", "ÿŸ İstanbul ĳ Ŀ ſ ŉ", "A\x85B\xa0C D", "… “Quoted,” said… €5.", "é combining é x", "...", "a...b ,;: x,y.z.", "ΑΣ ς. ΑΣ", "ª º µ"] * 3 + [f"Word{i}, word{i}." for i in range(200)]
    for i in range(0, len(texts), 7):
        for x, ids in zip(texts[i : i + 7], s.encode(texts[i : i + 7]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x
