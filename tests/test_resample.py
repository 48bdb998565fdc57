import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.operators import graph_frames as gf
from dagwright.operators.dataset import Data, draw_keys
from dagwright.operators.independence import DataTest, GraphTest
from dagwright.plans.constraint import adjacency_search, fci_stable, pag, pc_stable, rfci_prune
from dagwright.plans.graph import CPDAG, PAG, UNDIRECTED, cpdag, extension, graph_of
from dagwright.plans.mgm import mgm, mgm_path
from dagwright.plans.report import cv_text, path_text, stars_text, steps_text
from dagwright.plans.resample import bootstrap, draws, mgm_cv, poisson_cuts, random_points, search_cv, split, stars, steps
from dagwright.plans.score import DegenerateGaussian, Orders, backward, boss, grasp
from dagwright.plans.simulate import random_dag, sim_random_dag


@pytest.fixture(scope="module")
def frame(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 4))
    x[:, 1] += x[:, 0]
    rows = [(*map(float, r), "abc"[int(i % 43 == 0) + 2 * int(i % 3 == 0 and i % 43 != 0)]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, f string")


def test_keys_are_those_of_spark(spark):
    rows = spark.range(50).select(F.xxhash64("id").alias("k"), F.xxhash64(F.xxhash64("id"), F.lit(7).cast("long"), F.lit(-3).cast("long")).alias("h")).collect()
    assert [r.h for r in rows] == draw_keys(np.array([r.k for r in rows]), 7, -3).tolist()


def test_parts_do_not_depend_on_where_rows_are(frame):
    here, there = Data(frame), Data(frame.repartition(7), local_cells=0)
    assert there.local is None
    for a, b in zip(draws(here, 2, 90, seed=3), draws(there, 2, 90, seed=3), strict=True):
        assert a.n == b.n == 90 and np.allclose(a.gram(), b.gram())
    for (a, b), (c, d) in zip(split(here, 4, 1), split(there, 4, 1), strict=True):
        assert (a.n, b.n) == (c.n, d.n) == (225, 75) and np.allclose(b.gram(), d.gram()) and a.labels == b.labels == d.labels


def test_folds_and_leave_one_out(frame):
    d = Data(frame)
    whole = d.gram()
    assert np.allclose(sum(b.gram() for _, b in split(d, 7)), whole)
    assert all(np.allclose(a.gram() + b.gram(), whole) for a, b in split(d, 7))
    left = draws(d, 0, None, seed=0, leave_one_out=True)
    assert len(left) == d.n and {x.n for x in left} == {d.n - 1} and np.allclose(sum(x.gram() for x in left), (d.n - 1) * whole)
    middle = frame.approxQuantile("a", [0.5], 0.0)[0]
    assert [b.n for _, b in split(d, F.when(F.col("a") > middle, 1).otherwise(2))] == [150, 150]
    with pytest.raises(ValueError):
        split(d, F.when(F.col("a") > 1, 1).otherwise(2))
    with pytest.raises(ValueError):
        draws(d, 2, 300, seed=0)
    assert poisson_cuts(1.0)[-1] == pytest.approx(1) and len(poisson_cuts(30.0)) > 60
    assert 200 < draws(d, 1, 300, seed=0, replace=True)[0].n < 400


def test_a_rare_level_does_not_break_cross_validation(frame):
    got = mgm_cv(Data(frame), [0.4, 0.2], folds=4)
    assert len(got["rows"]) == 2 and "Minimum" in cv_text(got)


def test_noise_is_best_without_edges(spark):
    g = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in g.normal(size=(120, 8))], ", ".join(f"v{i} double" for i in range(8)))
    got = search_cv(Data(df), alphas=(0.001, 0.5), folds=5)
    small, large = sorted(got["rows"], key=lambda r: r["alpha"])
    assert small["mean"] < large["mean"] and len(got["min"].edges()) < 4


def test_random_search(frame):
    points = random_points(3, [0.1, 0.3], [0.01, 0.1], seed=2)
    assert all(0.1 <= lam <= 0.3 and 0.01 <= a <= 0.1 for lam, a in points)
    got = search_cv(Data(frame.drop("f")), alphas=(0.01, 0.1), lambdas=[0.1, 0.3], folds=3, number=3)
    assert {(r["lambda"], r["alpha"]) for r in got["rows"]} == set(random_points(3, [0.1, 0.3], [0.01, 0.1], seed=0))


def test_bootstrap_of_what_learned_a_graph(frame):
    d = Data(frame.drop("f"))
    for learn, g in ((lambda x: pc_stable(x, rule="maxp", alpha=0.02), pc_stable(d, rule="maxp", alpha=0.02)), (lambda x: mgm(x, 0.2), mgm(d, 0.2))):
        assert bootstrap(d, learn, 3)[1].collect() == bootstrap(d, g, 3)[1].collect()
    with pytest.raises(ValueError):
        bootstrap(d, graph_of("ab", []), 2)


def test_reports(frame):
    d = Data(frame.drop("f"))
    assert "Minimum BIC graph" in path_text(mgm_path(d, [0.4, 0.2]))
    only = graph_of(d.names(), ["a --- b"])
    got = stars(d, [0.01, 0.1], number=3, initial=only)
    assert "StARS" in stars_text(got) and all(set(e) <= {("a", "b"), ("b", "a")} for e in [got["graph"].marks])
    assert "StEPS" in steps_text(steps(d, [0.4, 0.2], number=3, size=100))


@pytest.mark.parametrize("seed", range(20))
def test_pruning_leaves_the_pag(seed):
    g = random_dag([f"V{i}" for i in range(9)], 3, random.Random(100 + seed))
    want = pag(g, ["V0", "V4"])
    got = fci_stable(GraphTest(g, want.nodes), rule="sepsets", complete_rules=True)
    assert got.lines() == want.lines()


def test_pruning_takes_what_separating_sets_tell():
    # the test finds a and b dependent on their own, but independent given the set that parts a and c
    class Test:
        def nodes(self):
            return ["a", "b", "c", "z"]

        def p_values(self, tests):
            return [1.0 if (min(x, y), max(x, y)) == ("a", "c") and set(z) >= {"z"} or {x, y} == {"a", "b"} and set(z) == {"z"} else 0.0 for x, y, z in tests]

    g, seps = adjacency_search(Test(), 0.05, depth=0)
    seps.offer("a", "c", ("z",), 1.0)
    g.remove("a", "c")
    rfci_prune(Test(), g, seps, 0.05)
    assert not g.adjacent("a", "b") and seps.of("a", "b") == {"z"} and g.adjacent("b", "c")


def test_a_pag_agrees_with_itself(spark):
    dag = graph_of("ab", ["a --> b"])
    p = graph_of("ab", ["a o-o b"], PAG)
    r = gf.compare(spark, p, p, dag).first()
    assert (r.orientPrecision, r.orientRecall, r.orientF1, r.orientMCC, r.SHD) == (1, 1, 1, 1, 0)
    with pytest.raises(ValueError):
        gf.compare(spark, p, p)
    with pytest.raises(ValueError):
        gf.compare(spark, p, graph_of("ab", [], CPDAG))
    with pytest.raises(ValueError):
        gf.compare(spark, p, graph_of("abc", [], PAG), dag)
    u = graph_of("ab", ["a --- b"], UNDIRECTED)
    assert np.isnan(gf.compare(spark, u, u).first().orientF1)


@pytest.mark.parametrize("seed", range(10))
def test_extensions_are_of_the_class(seed):
    g = cpdag(random_dag([f"V{i}" for i in range(7)], 3, random.Random(seed)))
    assert cpdag(extension(g)).lines() == g.lines()


def test_backward_sweep_and_orders(spark):
    df, g = sim_random_dag(spark, n=1500, p=6, disc_frac=0, degree=2, seed=7)
    d = Data(df)
    score = DegenerateGaussian(d, 2.0)
    full = graph_of(d.names(), [f"{a} --- {b}" for i, a in enumerate(d.names()) for b in d.names()[i + 1 :]], CPDAG)
    swept = backward(score, full)
    total = lambda x: sum(score.local(v, frozenset(extension(x).parents(v))) for v in x.nodes)
    assert total(swept) < total(full) and {frozenset(e) for e in g.marks} <= {frozenset(e) for e in swept.marks}
    assert total(boss(d)) <= total(swept) + 1e-6
    assert sorted(Orders(score).start(random.Random(1), min_degree=True)) == sorted(d.names())
    assert total(grasp(d, num_starts=1, min_degree=True)) <= total(full)


def test_batched_tests_are_those_of_single_fits(frame):
    from dagwright.functions.distributions import f_upper, t_two_sided
    from dagwright.functions.regression import nested_f, ols

    d = Data(frame)
    t = DataTest(d)
    got = t.p_values([("a", "b", ("c", "f")), ("a", "f", ("b", "d")), ("c", "f", ()), ("a", "d", ())])
    want = [ols(d.gram(), d.n, 0, [1, 2, 4, 5]).p[1], nested_f(d.gram(), d.n, 0, [4, 5], [1, 3])[1], nested_f(d.gram(), d.n, 2, [4, 5], [])[1], ols(d.gram(), d.n, 0, [3]).p[1]]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-12)
    from dagwright.functions.distributions import f_upper_all, t_two_sided_all

    for df in (1.0, 7.0, 298.0, 60000.0):
        x = np.array([0.01, 0.7, 2.0, 9.0, 40.0])
        assert np.allclose(t_two_sided_all(x, np.full(5, df)), [t_two_sided(v, df) for v in x], rtol=1e-9)
        assert np.allclose(f_upper_all(x, 3, np.full(5, df)), [f_upper(v, 3, df) for v in x], rtol=1e-9)
