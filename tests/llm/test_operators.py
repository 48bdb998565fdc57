"""Operators against brute force, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.llm import ann, chat, exact_topk, pii, queries, sharding, substring, toxicity

SF = "/root/testdata/sf0.001"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def vectors(spark, n=900, seed=0):
    g = np.random.default_rng(seed)
    rows = [(i, g.normal(size=8).tolist(), 1) for i in range(n)]
    rows += [(n + i, [0.5] * 8, 1) for i in range(300)]  # a common vector
    odd = [(n + 300, None, 1), (n + 301, [1.0, None] + [0.0] * 6, 1), (n + 302, [float("nan")] * 8, 1), (n + 303, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (n + 304, [], 1), (n + 305, [1.0], 1), (5000, [0.0] * 8, 1)]
    return rows, odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, shard int").withColumns({"v": F.lit(1), "block": F.lit(2)})


def test_exact_topk(spark):
    rows, _, df = vectors(spark)
    part = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows] + [(5000, np.zeros(8))]
    want = set()
    for q, a in part:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in part if i != q)[:5]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in exact_topk.exact_topk(df).collect()} == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert exact_topk.exact_topk(few).count() == 1
    assert exact_topk.exact_topk(few.limit(0)).collect() == [] == ann.nearest(few.limit(0)).collect()


def test_nearest(spark):
    rows, _, df = vectors(spark)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got, hit, total = ann.nearest(df).collect(), 0, 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert abs(r.score - np.linalg.norm(x[r.query_id] - x[r.vec_id])) < 1e-12 and r.vec_id != r.query_id
    assert set(by) == {i for i in ids.tolist() if i % 100 == 0}  # the zero vector takes no part
    for q, own in by.items():
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hit += len({r.vec_id for r in own} & set(np.lexsort((ids, d))[:10].tolist()))
        total += 10
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r.score, r.vec_id))
    assert hit / total >= 0.9


def test_chat_layouts(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n\\x \\", "<<SYS>>a<</SYS>><", "", "|im_end|> \U0001f600\n"]
    df = spark.createDataFrame([([(t, "assistant" if i % 2 else "user") for i, t in enumerate(texts)],), ([],), (None,)], "m array<struct<content: string, role: string>>").select(F.struct(F.col("m").alias("messages")).alias("record"), F.lit(1).alias("formatted"))
    out = chat.chat_format(df, "record").withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    full = next(r for r in out if r.turns)
    assert [t.text for t in full.turns] == texts and full.loss == texts[1] + texts[3]
    assert full.formatted.count("<|im_start|>") == 5 and sum(not r.turns for r in out) == 2
    pairs = spark.sql("select struct('p' as prompt, 'c' as completion) as r, struct('i' as instruction, 'x' as input, 'o' as output) as s, struct(array(struct('human' as from, 'h' as value)) as conversations) as t")
    for c, want in (("r", [("user", "p"), ("assistant", "c")]), ("s", [("user", "i\nx"), ("assistant", "o")]), ("t", [("user", "h")])):
        got = chat.chat_format(pairs, c).select(chat.read_back(F.col("formatted")).alias("t")).first().t
        assert [tuple(x) for x in got] == want
    with pytest.raises(ValueError):
        chat.chat_format(spark.sql("select struct(1 as odd) as r"), "r")
    assert chat.chat_format(pairs.limit(0), "r").collect() == []


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii(spark):
    texts = [None, "", "a@b.c_d@e.f x..y@z.com\U0001f600 q@r", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.255.0 999999999999.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111111", "+1 (555) 123-4567 x+12 3 +1234567890123456", "IBAN DE89 3704 0044 0532 0130 00 DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789" + " word" * 12 + " 987-65-4321", "1" * 30000 + " " + "a." * 20000 + "@", "x" * 5000 + "@y.zz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("x"))
    out = {r.doc_id: r for r in pii.find_pii(df).withColumn("m", pii.masked(F.col("text"), F.col("spans"))).collect()}
    for i, t in enumerate(texts):
        got = [(s.start, s["rank"], s.kind, s.end) for s in out[i].spans]
        assert [s for s in got if s[1] < 4] == base_spans(t or ""), i
    assert [s.kind for s in out[6].spans if s["rank"] > 3] == ["iban"] and [s.start for s in out[7].spans if s.kind == "ssn"] == [4, 20]
    assert out[9].m == "<email>" and out[7].m.startswith("ssn <ssn> and <ssn>") and out[0].m is None
    assert pii.find_pii(df.limit(0)).collect() == []


def brute_windows(texts, k):
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring(spark):
    g = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: " ".join(g.choice(vocab, n))
    shared, loop = make(60), make(5)
    texts = [make(50) + " " + shared + " " + make(20), shared + "\t\n" + make(40), make(30) + " " + shared[:-20], None, "", "one", " ".join([loop] * 20), make(4000), "same row " + make(50)]
    texts += [texts[-1]] * 3
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"chunk": F.lit(1), "kept_text": F.lit("x")})
    got = substring.substring_dedup(df, window=35, chunk_bytes=2000).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(brute_windows(texts, 35))
    one = next(r for r in got if r.row.doc_id == 1)
    assert [tuple(x) for x in one.removed] == [(0, 60)]
    assert substring.substring_dedup(df.limit(0)).collect() == []


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    ids = [*range(300), None, None, -1, -(1 << 63), (1 << 63) - 1, 7, 7]
    df = spark.createDataFrame([(i, None if k % 9 == 0 else "é" * (k % 5)) for k, i in enumerate(ids)], "doc_id long, text string").withColumns({"shard": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    rows = sharding.shard(df).collect()
    assert len(rows) == len(ids)
    slots = {}
    for r in rows:
        key = r.doc_id or 0
        assert r.shard == jump(key, 16) and r.grown_shard == jump(key, 17) and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r.doc_id: r for r in rows}
    t = "é" * (4 % 5)
    assert by[4].size == len(t.encode()) + 1 and by[4].text_crc32 == zlib.crc32(t.encode())
    assert sharding.shard(df.limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    g = np.random.default_rng(2)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 8 == 0
        w = list(g.choice(vocab, 40))
        if bad:
            w[3], w[20] = (("moron", "scum") if i % 16 else ("grimblax" + str(i % 7), "grimblaxor"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "idiot")], "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == dict(labels)[i] for i in held]) >= 0.97
    assert got[1000].score == got[1001].score < 0.7
    assert toxicity.toxicity(docs.limit(0), model).collect() == []
    toxicity.fit(docs, lab.limit(0))


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = cp.written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "toxicity":
            bad = re.compile(r"\b(idiot|moron|stupid|scum|trash|loser|clown|pathetic|worthless|disgusting)\b", re.I)
            assert all(bad.search(before[d].text) for d in set(before) - set(after))
        elif name == "near_dedup":
            from test_near_dedup import brute_force

            classes = brute_force([(d, r.text) for d, r in before.items()])
            assert set(after) == set(classes.values())
        elif name == "substring_dedup":
            want = dict(zip(before, brute_windows([r.text for r in before.values()], 35), strict=True))
            assert all(after[d].text == (want[d][2] if want[d][1] else before[d].text) for d in before)
        else:
            assert all(not base_spans(after[d].text) for d in after if base_spans(before[d].text)) and all(after[d].text == before[d].text for d in after if after[d].text.count("<") == before[d].text.count("<"))
    assert cp.STAGES[-1][1](spark, docs, SF).selectExpr("count(distinct doc_id)").first()[0] == len(after)


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_pii", "op8_exact_topk", "op9_substring_dedup", "op10_jump_sharding"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
