"""Odd rows: nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.llm import ann, chat, exact_topk, pii, toxicity
from dagwright.llm.common import shared_dir

LONG = "word " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns named like those of the operators."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "idiot moron scum"), (None, None), (4, LONG), (5, f"{passage} one"), (6, f"two {passage}"), (7, "mail me at a.b@example.org now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"own {c}") for c in ("score", "predicted", "spans", "row", "n_removed", "kept_text", "class_id", "tid", "chunk", "at", "votes", "n")})


def test_stages(spark, odd, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(3, 0), (5, 0), (100, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES:
        none = stage(spark, odd.limit(0), str(tmp_path))
        assert none.collect() == [], name
        got = stage(spark, odd, str(tmp_path))
        rows = got.collect()
        if name == "packing":
            assert sum(r.length for r in rows if r.doc_id is None) > 2
            continue
        assert got.columns == odd.columns and all(r[c] == f"own {c}" for r in rows for c in odd.columns[2:]), name
        if name == "near_dedup":
            assert sorted((r.text or "")[:5] for r in rows) == sorted(["", "a b c", "idiot", "word ", "p0 p1", "mail "])
        elif name == "substring_dedup":
            assert len(rows) == 10 and {r.text for r in rows if r.doc_id in (5, 6)} == {"one", "two"} and [r.text for r in rows if r.doc_id == 1] == [None]
        elif name == "pii":
            assert [r.text for r in rows if r.doc_id == 7] == ["mail me at <email> now"] and [r.text for r in rows if r.doc_id == 4] == [LONG]
        elif name == "toxicity":
            assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 5, 6, 7}


def test_account_numbers_have_the_length_of_their_country(spark):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000x", "DE88 3704 0044 0532 0130 00"]
    got = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans if s.kind == "iban"] for r in got] == [[("iban", 0, 27)], [("iban", 0, 27)], [], []]


def test_vectors_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (None, [0.2, 0.1]), (2, None), (3, [float("nan"), 1.0]), (100, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1)})
    near = ann.nearest(df)
    got = [(r.query_id, r["rank"], r.vec_id) for r in near.collect()]
    assert {v for _, _, v in got} <= {0, 1, 100} and all(q != v for q, _, v in got)
    assert ann.nearest(df.limit(0)).collect() == [] and exact_topk.exact_topk(df.limit(0)).collect() == []
    assert all(r.query_id != r.vec_id for r in exact_topk.exact_topk(df).collect())


def test_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", None), (1, None, None, ""), (1, 2, "assistant", LONG), (1, 2, "assistant", LONG), (2, 0, "gpt", "y")]
    df = chat.conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.chat_format(df, "record", roles={})
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    assert [(t.role, t.text) for t in got[None].t] == [("user", "x"), ("assistant", "")] and got[None].l == ""
    assert got[1].l == LONG * 2 and [(t.role, t.text) for t in got[2].t] == [("gpt", "y")]
    named = chat.chat_format(df, "record").select("conv_id", chat.read_back(F.col("formatted")).alias("t")).where("conv_id = 2").first()
    assert named.t[0].role == "assistant"


def test_records_of_several_layouts(spark):
    kind = "record struct<prompt: string, completion: string, instruction: string, input: string, output: string, messages: array<struct<role: string, content: string>>>"
    rows = [(("p", "c", None, None, None, None),), ((None, None, "i", "in", "o", None),), ((None, None, None, None, None, [("user", "u"), ("model", "m")]),), ((None,) * 6,), (None,)]
    out = chat.chat_format(spark.createDataFrame(rows, kind), "record").select(chat.read_back(F.col("formatted")).alias("t"))
    assert [[tuple(t) for t in r.t] for r in out.collect()] == [[("user", "p"), ("assistant", "c")], [("user", "i\nin"), ("assistant", "o")], [("user", "u"), ("assistant", "m")], [], []]
    with pytest.raises(Exception, match="no layout"):
        chat.chat_format(spark.createDataFrame([(("p", None, None, None, None, None),)], kind), "record").collect()
    with pytest.raises(ValueError):
        chat.chat_format(spark.createDataFrame([(("p",),)], "record struct<a: string>"), "record")


def planted(n=6000, seed=8):
    """Votes of ten independent voters and of one that copies the first, with the class of each document."""
    g = np.random.default_rng(seed)
    y = g.random(n) < 0.15
    toxic, clean = np.linspace(0.35, 0.8, 10), np.linspace(0.02, 0.12, 10)
    on = g.random((n, 10)) < np.where(y[:, None], toxic, clean)
    copy = np.where(g.random(n) < 0.9, on[:, 0], g.random(n) < 0.1)
    return y, np.column_stack([on, copy]), toxic, clean


def test_label_model_recovers_rates_and_correlation(spark):
    y, on, toxic, clean = planted()
    counts = Counter(tuple(np.flatnonzero(r).tolist()) for r in on)
    table = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    start1, start0 = np.full(11, 0.5), np.full(11, 0.1)
    model = toxicity.fit_label_model(table, 0.1, start1, start0, rounds=24)
    assert abs(model.rate - y.mean()) < 0.03
    assert np.abs(model.votes[1, 1:10] - toxic[1:]).max() < 0.08 and np.abs(model.votes[0, 1:10] - clean[1:]).max() < 0.04
    assert {model.parent[10], model.parent[0]} in ({0, -1}, {10, -1}) and (model.parent[1:10] == -1).all()
    child, up = (10, 0) if model.parent[10] == 0 else (0, 10)
    assert model.given[1, 1, child] > 0.8 and model.given[1, 1, child] > model.given[1, 0, child] + 0.5 and model.parent[child] == up
    # two that go together weigh little more than one: a model of independent voters would count them twice
    alone = model.log_odds([0, 5]) - model.log_odds([5])
    assert model.log_odds([0, 5, 10]) - model.log_odds([0, 5]) < alone
    called = np.array([model.posterior(np.flatnonzero(r)) for r in on]) > 0.5
    assert (called == y).mean() > 0.97


def test_gold_labels_are_no_votes(spark):
    """A wrong label does not change the score of its text: rows alike in text have one posterior."""
    g = np.random.default_rng(3)
    rows = [(i, " ".join([*g.choice(["tree", "house", "river"], 12), *(["vexor", "grund"] if i % 6 == 0 else [])]), int(i % 6 == 0)) for i in range(900)]
    rows += [(i, "tree house river stone", 1) for i in range(900, 903)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, model).collect()}
    assert [got[900], got[901], got[902]] == [0, 0, 0] and all(got[i] == int(i % 6 == 0) for i in range(900))


def test_repeated_ids_and_very_long_texts_are_learned_from_once(spark):
    rows = [(7, "idiot " * 5)] * 500 + [(i, "scum of it " + "word " * 20 if i % 4 == 0 else "fine " * 20) for i in range(100, 400)] + [(9, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (9, 0)] + [(i, int(i % 4 == 0)) for i in range(100, 400)], "doc_id long, toxic int")
    assert toxicity.sampled(df, labels, "doc_id", "text", 4000).where("t like 'idiot%'").count() <= 1
    model = toxicity.fit(df, labels)
    assert toxicity.toxicity(df.where("doc_id = 9"), model).first().predicted == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_margins_end_the_search_where_vectors_cluster():
    g = np.random.default_rng(2)
    centres = g.normal(size=(40, 16)) * 20
    x = np.repeat(centres, 100, axis=0) + g.normal(size=(4000, 16))
    rng = np.random.default_rng(1)
    forest = [ann.Tree(x, rng, 64) for _ in range(ann.TREES)]
    inspected = []
    for i in range(0, 4000, 400):
        margins = [(t.normal @ x[i] - t.offset).tolist() for t in forest]
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        rows = ann.candidates(forest, margins, len(x), 80, 3200, lambda r, d=d: float(np.sort(d[r])[10]))
        inspected.append(len(rows))
        assert set(np.argsort(d)[:11]) <= set(rows.tolist())
    assert max(inspected) < 1600
