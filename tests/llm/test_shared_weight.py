import tracemalloc

import numpy as np

from dagwright.llm import near_dedup


def sets(texts, shingles):
    rng = np.random.default_rng(1)
    s = [np.sort(rng.choice(4 * shingles, shingles, replace=False)).astype(np.uint64) for _ in range(texts)]
    w = [rng.random(shingles).astype(np.float32) for _ in s]
    every, who, wt = np.concatenate(s), np.repeat(np.arange(texts), shingles), np.concatenate(w).astype(np.float64)
    order = np.argsort(every, kind="stable")
    return s, w, every[order], who[order], wt[order]


def test_shared_weights_by_hand(monkeypatch):
    s, w, *of = sets(7, 30)
    own = [dict(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(s, w, strict=True)]
    want = [sum(min(x, other[k]) for k, x in own[2].items() if k in other) for other in own]
    for most in (1, 20, 1 << 20):
        monkeypatch.setattr(near_dedup, "MET", most)
        assert np.allclose(near_dedup.shared(s[2], w[2], *of, 7), want)
    assert not near_dedup.shared(s[2][:0], w[2][:0], *of, 7).any()


def test_common_shingles_take_little_memory():
    texts, shingles = 512, 5000
    every = np.repeat(np.arange(shingles, dtype=np.uint64), texts)
    who, wt = np.tile(np.arange(texts), shingles), np.ones(texts * shingles)
    tracemalloc.start()
    got = near_dedup.shared(np.arange(shingles, dtype=np.uint64), np.ones(shingles, np.float32), every, who, wt, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == shingles).all() and peak < 20 << 20
