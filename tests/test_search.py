import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.functions import distributions as dist
from dagwright.functions.regression import cox, logistic_batch, ols
from dagwright.operators import graph_frames as gf
from dagwright.operators.dataset import Data, npn
from dagwright.plans.graph import CPDAG, cpdag, from_frame, from_matrix, graph_of, moral, skeleton, v_structures
from dagwright.plans.mgm import Mgm, mgm, mgm_path
from dagwright.plans.resample import bootstrap, mgm_cv, stars, steps
from dagwright.plans.constraint import pc_stable
from dagwright.plans.score import boss, grasp, grow_shrink_mb
from dagwright.plans.simulate import random_dag, sim_random_dag
from dagwright.sources.graph_files import load_graph, save_graph


@pytest.fixture(scope="module")
def sim(spark):
    df, g = sim_random_dag(spark, n=1500, p=6, disc_frac=0.34, degree=2, seed=11)
    return Data(df.cache()), g


def test_tails_agree_with_commons_math(spark):
    m = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for x in (0.1, 1.0, 2.5, 7.0):
        for df in (1.0, 5.0, 120.0):
            assert abs(dist.t_two_sided(x, df) - 2 * m.TDistribution(df).cumulativeProbability(-x)) < 1e-9
            assert abs(dist.chi2_upper(x, df) - (1 - m.ChiSquaredDistribution(df).cumulativeProbability(x))) < 1e-9
            assert abs(dist.f_upper(x, 3.0, df) - (1 - m.FDistribution(3.0, df).cumulativeProbability(x))) < 1e-9
    assert 0 < dist.chi2_upper(400, 3) < 1e-80 and abs(dist.normal_quantile(0.975) - 1.959963985) < 1e-8


def test_regressions(sim):
    data, _ = sim
    x = data.local
    got = ols(data.gram(), data.n, 0, [1, 2])
    want = np.linalg.lstsq(np.hstack([np.ones((data.n, 1)), x[:, [1, 2]]]), x[:, 0], rcond=None)
    assert np.allclose(got.coef, want[0]) and abs(got.rss - want[1][0]) < 1e-6
    y = data.columns[next(v.name for v in data.variables if v.kind == "discrete")][0]
    beta, _ = logistic_batch(data, [(y, [0])])[0]
    z = np.hstack([np.ones((data.n, 1)), x[:, [0]]])
    assert np.abs(z.T @ (x[:, y] - 1 / (1 + np.exp(-z @ beta)))).max() < 1e-3
    t = np.array([1.0, 2, 2, 3, 4, 5]), np.array([1.0, 1, 1, 0, 1, 1])
    fit = cox(*t, np.array([[0.5], [1], [-1], [0], [2], [-2]]))
    assert np.isfinite(fit.coef).all() and 0 < fit.p[0] <= 1


def test_bad_data(spark):
    df = spark.createDataFrame([(float(i), 1.0, "a" if i % 2 else "b", None if i == 3 else 1.0 * i) for i in range(40)], "a double, b double, c string, `d e` double")
    with pytest.raises(ValueError, match="b has no variance"):
        Data(df)
    d = Data(df.drop("b"))
    assert d.n == 39 and d.names() == ["a", "c", "d.e"]
    with pytest.raises(TypeError):
        Data(df.select(F.array("a").alias("x")))


def test_npn(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 2, 9]], "x double")
    got = {r.x for r in npn(df, ["x"]).collect()}
    values = np.array([3.0, 1, 2, 2, 9])
    want = {values.mean() + values.std(ddof=1) * dist.normal_quantile(r / 6) for r in (1, 2.5, 4, 5)}
    assert np.allclose(sorted(got), sorted(want))


@pytest.mark.parametrize("seed", range(6))
def test_frames_agree_with_graphs(spark, seed):
    g = random_dag([f"V{i}" for i in range(7)], 3, random.Random(seed))
    f = g.frame(spark)
    assert from_frame(gf.skeleton(f), g.nodes, "").lines() == skeleton(g).lines()
    assert from_frame(gf.moral(f), g.nodes, "").lines() == moral(g).lines()
    assert {(r.a, r.c, r.b) for r in gf.v_structures(f).collect()} == set(v_structures(g))
    assert {r.node: r.blanket for r in gf.markov_blankets(f).collect()} == {v: b for v in g.nodes if (b := g.markov_blanket(v))}
    assert {(r.ancestor, r.node) for r in gf.ancestors(f).collect()} == {(a, v) for v in g.nodes for a in g.ancestors(v) - {v}}
    c = cpdag(g).frame(spark)
    assert gf.shd(c, c, CPDAG).first().SHD == 0 and gf.adjacency_metrics(c, f, 7).first().adjF1 == 1


def test_files(tmp_path):
    g = graph_of("abc", ["a --> b", "b <-> c"], CPDAG)
    g.algorithm, g.params = "x", {"alpha": 0.05, "lambda": [0.1, 0.2, 0.3]}
    g.ambiguous.add(("a", "b", "c"))
    back = load_graph(save_graph(g, str(tmp_path / "g")))
    assert (back.lines(), back.type, back.params, back.ambiguous) == (g.lines(), g.type, g.params, g.ambiguous)
    assert open(save_graph(g, str(tmp_path / "g.sif"))).read() == "a\tdir\tb\nb\tbidir\tc\n"
    assert from_matrix([[0, 1], [0, 0]], ["p", "q"], directed=True).lines() == ["q --> p"]


def test_score_searches(sim):
    data, g = sim
    want = set(skeleton(g).lines())
    for got in (boss(data, num_starts=1), grasp(data, num_starts=1)):
        assert got.type == CPDAG and len(want ^ set(skeleton(got).lines())) <= 2
    v = g.nodes[0]
    assert set(grow_shrink_mb(data, v)) & set(g.markov_blanket(v)) or not g.markov_blanket(v)


def test_mgm(sim):
    data, g = sim
    model = Mgm(data)
    rng = np.random.default_rng(0)
    v = model.first + 0.01 * rng.normal(size=model.size)
    a, b, B, th, ph, c = model.split(v)
    B[:], ph[:] = (B + B.T) / 2, (ph + ph.T) / 2
    np.fill_diagonal(B, 0)
    ph[model.own] = 0
    f, grad = model.smooth(v)
    for part in (0, 1, 3, 5):
        at = sum(math.prod(s) for s in model.shapes[:part])
        e = np.zeros_like(v)
        e[at] = 1e-6
        assert abs((model.smooth(v + e)[0] - f) / 1e-6 - grad[at]) < 1e-4
    assert not mgm(data, 10.0).marks
    path = mgm_path(data, n_lambda=6)
    assert len(path["rows"]) == 6 and set(skeleton(g).lines()) & set(path["bic"].lines())


def test_resampling(sim):
    data, _ = sim
    g, table = bootstrap(data, lambda d: pc_stable(d), number=3)
    rows = table.collect()
    assert all(abs(sum(r[3:]) - 1) < 1e-9 for r in rows) and set(g.lines())
    assert stars(data, [0.001, 0.05], number=2)["alpha"] in (0.001, 0.05)
    assert len(steps(data, [0.3, 0.1], number=2)["lambda"]) == 3
    assert len(mgm_cv(data, [0.4, 0.1], folds=2)["rows"]) == 2


def test_mixed_graphical_model_meets_its_optimality_conditions(sim):
    """Zero groups have gradients under the penalty, others gradients of just its size."""
    data, _ = sim
    m, lam = Mgm(data), 0.08
    got = m.learn((lam,) * 3)
    _, _, gB, gth, gph, _ = m.split(m.smooth(got.params)[1])
    _, _, B, th, ph, _ = m.split(got.params)
    (gm, gb), (nm, nb) = m.norms(gth, gph), m.norms(th, ph)
    up = np.triu_indices(m.p, 1)
    blocks = [(np.abs(gB)[up], np.abs(B)[up]), ((gm / np.outer(m.wx, m.wd)).ravel(), nm.ravel())]
    if len(m.ds) > 1:
        du = np.triu_indices(len(m.ds), 1)
        blocks.append(((gb / np.outer(m.wd, m.wd))[du], nb[du]))
    assert sum(int((size > 0).sum()) for _, size in blocks) == len(got.graph.edges()) > 0
    for slope, size in blocks:
        assert (slope[size == 0] <= lam * 1.01).all() and np.allclose(slope[size > 0], lam, rtol=0.02)
