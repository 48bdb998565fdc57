import random

import pytest

from dagwright.operators.dataset import Data
from dagwright.operators.independence import GraphTest
from dagwright.plans.constraint import fci_stable, pag, pc_stable
from dagwright.plans.graph import ARROW, cpdag, graph_of, moral, v_structures
from dagwright.plans.knowledge import Knowledge
from dagwright.plans.simulate import random_dag, sim_random_dag


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("rule", ["majority", "maxp", "conservative", "sepsets"])
def test_pc_on_separation_gives_the_class(seed, rule):
    g = random_dag([f"V{i}" for i in range(7)], 2.5, random.Random(seed))
    assert pc_stable(GraphTest(g), rule=rule).lines() == cpdag(g).lines()


@pytest.mark.parametrize("seed", range(12))
def test_fci_on_separation_gives_the_pag(seed):
    g = random_dag([f"V{i}" for i in range(8)], 2.5, random.Random(seed))
    latent = ["V0", "V5"]
    want = pag(g, latent)
    got = fci_stable(GraphTest(g, want.nodes), complete_rules=True)
    assert got.lines() == want.lines()
    for (a, b), mark in want.marks.items():
        if mark == ARROW:
            assert b not in g.ancestors(a)


def test_small_graphs():
    assert pc_stable(GraphTest(graph_of("abc", ["a --> b", "c --> b"]))).lines() == ["a --> b", "c --> b"]
    assert pc_stable(GraphTest(graph_of("abc", ["a --> b", "b --> c"]))).lines() == ["a --- b", "b --- c"]
    g = graph_of("abcd", ["a --> c", "b --> c", "c --> d"])
    assert v_structures(g) == [("a", "c", "b")] and moral(g).lines() == ["a --- b", "a --- c", "b --- c", "c --- d"]
    assert g.markov_blanket("a") == ["b", "c"]


def test_knowledge():
    g = graph_of("abc", ["a --> b", "b --> c"])
    k = Knowledge(tiers=[["c"], ["b"], ["a"]])
    assert pc_stable(GraphTest(g), knowledge=k).lines() == ["b --> a", "c --> b"]
    with pytest.raises(ValueError):
        Knowledge(forbidden={("a", "b")}, required={("a", "b")})
    with pytest.raises(ValueError):
        pc_stable(GraphTest(g), knowledge=Knowledge(tiers=[["a"]]))
    assert pc_stable(GraphTest(graph_of("ab", [])), knowledge=Knowledge(required={("a", "b")})).lines() == ["a --> b"]


def test_recovers_simulated_graph(spark):
    df, g = sim_random_dag(spark, n=4000, p=8, disc_frac=0.5, degree=2, seed=3)
    d = Data(df)
    got = pc_stable(d, alpha=0.01)
    true, found = {tuple(sorted(e)) for e in g.marks}, {tuple(sorted(e)) for e in got.marks}
    assert len(true & found) / max(1, len(found)) >= 0.8 and len(true & found) / len(true) >= 0.7


def test_passes_over_rows_agree_with_the_local_matrix(spark):
    df, _ = sim_random_dag(spark, n=600, p=5, disc_frac=0.6, degree=2, seed=5)
    a, b = Data(df), Data(df, local_cells=0)
    assert b.local is None and abs(a.gram() - b.gram()).max() < 1e-6
    assert pc_stable(a).lines() == pc_stable(b).lines()
    from dagwright.plans.mgm import Mgm

    one, two = Mgm(a), Mgm(b)
    (f, g), (h, k) = one.smooth(one.first), two.smooth(two.first)
    assert abs(f - h) < 1e-9 and abs(g - k).max() < 1e-9
