import math
import re
from collections import Counter

import pytest

from dagwright.llm.near_dedup import near_dedup

DATA = "/root/testdata/sf0.001/documents.parquet"


def brute_force(docs, k=5, least=0.8):
    """All pairs of distinct word sequences, by their weighted Jaccard similarity."""
    words = {d: tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs}
    sets = {d: Counter(w[i : i + k] for i in range(max(1, len(w) - k + 1))) if w else Counter() for d, w in words.items()}
    df, n = Counter(s for x in sets.values() for s in x), len(docs)
    idf = {s: 2 - round(8 * math.log2(c)) / 8 * math.log(2) / math.log(max(n, 2)) for s, c in df.items()}
    label = {d: d for d in words}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            low = sum(min(c, sets[b][s]) * idf[s] for s, c in sets[a].items() if s in sets[b])
            high = sum(max(sets[a][s], sets[b][s]) * idf[s] for s in sets[a].keys() | sets[b].keys())
            if words[a] == words[b] or high and low / high >= least:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_same_classes_as_brute_force(spark):
    docs = spark.read.parquet(DATA)
    assert classes(near_dedup(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_buckets_in_several_components(spark):
    """A bucket whose least text is unlike the others: they are still compared with one another."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        w = list(base)
        w[5 * i] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (0.8, 0.75):
        got = classes(near_dedup(df, similarity=least, bands=40, rows=1))
        assert got == brute_force(rows, least=least)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two", "c"), (4, "one  two", None), (5, long, "e"), (5, long, "e"), (6, long + " z", "f"), (None, "one two", "g"), (8, "alone here", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string").withColumnsRenamed({"chunk": "tid"})
    got = sorted(near_dedup(df).select("doc_id", "class_id", "kept").collect(), key=str)
    want = [(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True), (5, 5, True), (6, 5, False), (None, 3, False), (8, 8, True)]
    assert got == sorted(want, key=lambda r: str(spark.createDataFrame([r], "doc_id long, class_id long, kept boolean").first()))


def test_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("s", [0.5, 0.9])
def test_samples_agree_as_often_as_similarity(s):
    import numpy as np

    from dagwright.llm.near_dedup import sampled, similarity_of

    g = np.random.default_rng(1)
    hit = total = 0
    for _ in range(40):
        n = 300
        every = np.unique(g.integers(0, 1 << 48, n, dtype=np.uint64))
        cut = int(len(every) * (1 - s) / (1 + s))
        a, b = every[cut:], every[: len(every) - cut]
        wa, wb = (g.uniform(0.5, 3, len(x)).astype(np.float32) for x in (a, b))
        wb[np.isin(b, a)] = wa[np.isin(a, b)]
        want = similarity_of(a, wa, b, wb)
        hit += (sampled(a, wa, 64) == sampled(b, wb, 64)).mean() - want
        total += 1
    assert abs(hit / total) < 0.03
