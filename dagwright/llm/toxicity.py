"""Toxicity by weak supervision.

1. Voters are lexicons, patterns, and words and word beginnings that labelled training rows single
   out; each says "toxic" or "clean" of a text, or abstains.
2. All documents are voted on. A generative label model is fitted to the votes alone, by expectation
   maximisation over all documents: how often each voter votes on toxic and on clean ones, and which
   voters are correlated within a class; those are joined in a tree, each given its parent.
3. A logistic regression on word features learns the model's posteriors of labelled and unlabelled
   documents and scores every whole text. Gold labels find words, set where the label model starts
   from and what a small part of its counts is, and shift the scores so that the threshold fits them;
   they are never votes.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagwright.llm.common import FILE_ROWS, kept_by_worker, pieces, written

#: Insults of everyday English, German, French and Spanish.
LEXICON = {
    "en": "idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting imbecile jerk fool garbage vermin filth",
    "de": "idiot dumm trottel abschaum versager arschloch widerlich wertlos",
    "fr": "idiot imbécile connard salaud ordure minable abruti débile",
    "es": "idiota imbécil estúpido basura asqueroso inútil escoria payaso",
}
#: Words of civil talk, which vote "clean".
CIVIL = {
    "en": "please thanks thank sorry welcome kindly appreciate",
    "de": "bitte danke entschuldigung willkommen gerne",
    "fr": "merci pardon bienvenue volontiers",
    "es": "gracias perdón bienvenido favor",
}
#: Patterns over a whole text that vote "toxic", and that vote "clean": strings of which the text in lower case has one, and the pattern.
PATTERNS = {
    "insulting you": (("you are", "you're"), r"(?i)\byou(?:'re| are) (?:such )?an? \w+"),
    "get lost": (("shut up", "get lost", "go to hell"), r"(?i)\b(?:shut up|get lost|go to hell)\b"),
    "exclamations": (("!!!",), r"!{3,}"),
    "shouting": (("!",), r"(?:\b[A-Z]{3,}\b\W+){4}"),
}
CLEAN_PATTERNS = {
    "address": (("://", "www.", "@"), r"(?i)\bhttps?://|\bwww\.|[a-z0-9]@[a-z0-9]"),
    "licence": (("copyright", "licensed", "license", "rights reserved"), r"(?i)\b(?:copyright|licen[cs]ed? under|all rights reserved)\b"),
}
STRIPPED = ".,;:!?\"'()[]{}<>|*#$%&+=/\\-_~`^@0123456789…“”„«»¡¿"
PREFIXES = (4, 5, 6)
#: Labelled rows that voters are found on, and as many unlabelled ones with them that the classifier is fitted on,
#: at most; they bound the voters and features.
MOST_ROWS = 4000
#: Rounds of expectation maximisation, documents that the labelled rows' vote rates count as, and the correlation
#: within a class from which two voters are joined.
ROUNDS, ANCHOR, CORRELATED = 8, 50.0, 0.1


def words(text: str) -> set[str]:
    return {w.strip(STRIPPED) for w in set(text.lower().split())}


def features(word: str) -> list[str]:
    """A word, and its beginnings, which carry a trailing star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


class Finder:
    """Which of a list of features a text has."""

    LIMIT = 300_000

    def __init__(self, names: list[str]):
        self.at, self.known = {x: i for i, x in enumerate(names)}, {}

    def __call__(self, text: str) -> set[int]:
        out = set()
        for w in set(text.lower().split()):
            got = self.known.get(w)
            if got is None:
                if len(self.known) >= self.LIMIT:
                    self.known.clear()
                got = self.known[w] = tuple(self.at[f] for f in features(w.strip(STRIPPED)) if f in self.at)
            if got:
                out.update(got)
        return out


@dataclasses.dataclass
class Voters:
    """Fixed and found voters; each votes or abstains."""

    found: list[str]

    def names(self) -> list[str]:
        return [*LEXICON, *PATTERNS, *self.found, *(f"civil {x}" for x in CIVIL), *CLEAN_PATTERNS]

    def toxic(self) -> int:
        """Voters that vote "toxic"; they come first."""
        return len(LEXICON) + len(PATTERNS) + len(self.found)

    def bind(self):
        names, own = self.names(), defaultdict(list)
        for i, lang in enumerate(LEXICON):
            for w in LEXICON[lang].split():
                own[w].append(i)
        for i, f in enumerate(self.found, len(LEXICON) + len(PATTERNS)):
            own[f].append(i)
        for i, lang in enumerate(CIVIL, self.toxic()):
            for w in CIVIL[lang].split():
                own[w].append(i)
        finder = Finder(list(own))
        of = [own[f] for f in own]
        patterns = [(names.index(n), hints, re.compile(p)) for n, (hints, p) in (PATTERNS | CLEAN_PATTERNS).items()]

        def vote(text: str) -> list[int]:
            out = {v for f in finder(text) for v in of[f]}
            low = text.lower()
            out.update(i for i, hints, p in patterns if any(h in low for h in hints) and p.search(text))
            return sorted(out)

        return vote


def find_voters(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[str]]:
    """Features that toxic rows have more often than chance explains over all features, the surest first.

    n rows with a feature, of which a part p is toxic, pass if n * KL(p || base rate) exceeds the log
    of the number of features by 3; of features on nearly the same rows one is taken. Returns
    these, and all that passed.
    """
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return [], []
    rows = defaultdict(list)
    for i, t in enumerate(texts):
        for f in {f for w in words(t) for f in features(w)}:
            rows[f].append(i)
    least, scored = math.log(len(rows) + 1) + 3, []
    for f, at in rows.items():
        n = len(at)
        if n < 3 or (n1 := int(labels[at].sum())) < 0.9 * n:
            continue
        p = n1 / n
        kl = p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0)
        if n * kl >= least:
            scored.append((-n * kl, len(f), f))
    out, taken = [], []
    for _, _, f in sorted(scored):
        own = set(rows[f])
        if all(len(own & x) < 0.9 * len(own | x) for x in taken):
            out.append(f)
            taken.append(own)
    return out, [f for _, _, f in sorted(scored)]


def vote_table(docs: DataFrame, text: str, voters: Voters) -> DataFrame:
    """`votes` (which voters vote, sorted) and `n`, of how many documents: all of them, each counted once."""
    key = f"voters{hash(tuple(voters.found))}"

    def voted(batches):
        vote = kept_by_worker(key, "vote", voters.bind)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([vote(t or "") for t in b[0].to_pylist()], pa.list_(pa.int32()))], ["votes"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(voted, "votes array<int>")
    return written(found.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "votes", pieces(docs.count(), FILE_ROWS))


@dataclasses.dataclass
class LabelModel:
    """Rates of votes given the class (0 clean, 1 toxic), and for voters with a parent in the tree given its vote too."""

    rate: float
    #: [class, voter]
    votes: np.ndarray
    #: Parents, -1 of none, and [class, parent votes, voter].
    parent: np.ndarray
    given: np.ndarray

    def log_odds(self, votes) -> float:
        """Of toxic, given who votes; abstentions tell as well, by how often a voter votes on each class."""
        on = np.zeros(len(self.parent), int)
        on[list(votes)] = 1
        i, up = np.arange(len(on)), np.maximum(self.parent, 0)
        rates = np.where(self.parent >= 0, self.given[:, on[up], i], self.votes)
        each = np.where(on == 1, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])))
        return math.log(self.rate / (1 - self.rate)) + float(each.sum())

    def posterior(self, votes) -> float:
        """Probability of toxic, given who votes."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.log_odds(votes)))))


def expected(table: DataFrame, model: LabelModel) -> np.ndarray:
    """[class, voter, voter]: documents of a class on which both vote, by the model's posteriors, over all documents;
    the diagonal has one voter alone, and a last row and column of ones all documents."""
    k = len(model.parent)

    def counted(batches):
        total = np.zeros((2, k + 1, k + 1))
        for b in batches:
            for votes, n in zip(b["votes"].to_pylist(), b["n"].to_pylist(), strict=True):
                p, at = model.posterior(votes), [*votes, k]
                total[:, np.array(at)[:, None], at] += n * np.array([1 - p, p])[:, None, None]
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in at), pa.array(total[at], pa.float64())], ["c", "i", "j", "n"])

    out = np.zeros((2, k + 1, k + 1))
    for r in table.mapInArrow(counted, "c int, i int, j int, n double").groupBy("c", "i", "j").agg(F.sum("n").alias("n")).collect():  # voters squared at most
        out[r.c, r.i, r.j] = r.n
    return out


def fitted(counts: np.ndarray, start: LabelModel, parent: np.ndarray, anchor: float) -> LabelModel:
    """The model of expected counts and of `anchor` documents of each class that vote as `start` says."""
    k = len(parent)
    n = counts[:, k, k]
    votes = (np.stack([np.diag(c)[:k] for c in counts]) + anchor * start.votes) / (n + anchor)[:, None]
    up, i = np.maximum(parent, 0), np.arange(k)
    both = counts[:, up, i]
    with_parent = (both + anchor * start.votes * votes[:, up]) / (counts[:, up, up] + anchor * votes[:, up])
    without = (counts[:, i, i] - both + anchor * start.votes) / (n[:, None] - counts[:, up, up] + anchor)
    given = np.clip(np.stack([without, with_parent], axis=1), 1e-6, 1 - 1e-6)
    rate = (n[1] + anchor * start.rate) / (n.sum() + anchor)
    return LabelModel(float(np.clip(rate, 1e-4, 0.5)), np.clip(votes, 1e-6, 1 - 1e-6), parent, given)


def correlations(counts: np.ndarray) -> np.ndarray:
    """The larger of two voters' correlations within the classes; 0 where a class has too few votes to tell it from chance."""
    k = counts.shape[1] - 1
    out = np.zeros((k, k))
    for c in counts:
        n = max(c[k, k], 1e-9)
        mean = np.diag(c)[:k] / n
        cov = c[:k, :k] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 0))
        rho = cov / np.maximum(np.outer(sd, sd), 1e-12)
        out = np.maximum(out, np.where((np.minimum.outer(mean, mean) * n < 20) | (rho < 4 / math.sqrt(n)), 0, rho))
    np.fill_diagonal(out, 0)
    return out


def tree(weight: np.ndarray, least: float) -> np.ndarray:
    """Parents in a maximum spanning forest of the pairs of at least that weight; -1 of a root."""
    k = len(weight)
    parent, near = np.full(k, -1), [[] for _ in range(k)]
    group = list(range(k))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    pairs = np.argwhere(np.triu(weight, 1) >= least)
    for i, j in sorted(map(tuple, pairs), key=lambda p: (-weight[p], p)):
        if root(i) != root(j):
            group[root(j)] = root(i)
            near[i].append(j)
            near[j].append(i)
    seen: set[int] = set()
    for r in range(k):
        todo = [r] if r not in seen else []
        while todo:
            x = todo.pop()
            seen.add(x)
            for y in near[x]:
                if y not in seen:
                    parent[y] = x
                    todo.append(y)
    return parent


def fit_label_model(table: DataFrame, rate: float, toxic: np.ndarray, clean: np.ndarray, rounds: int = ROUNDS, anchor: float = ANCHOR, correlated: float = CORRELATED) -> LabelModel:
    """Expectation maximisation over a vote table, from given rates of votes on toxic and clean documents.

    The first rounds take voters as independent given the class; those that prove correlated are then
    joined in a tree for the other rounds. `anchor` documents of each class keep the given rates, so that
    the classes cannot change places.
    """
    votes = np.clip(np.stack([clean, toxic]), 1e-6, 1 - 1e-6)
    none = np.full(votes.shape[1], -1)
    start = model = LabelModel(rate, votes, none, np.stack([votes, votes], axis=1))
    for _ in range(rounds // 2):
        counts = expected(table, model)
        model = fitted(counts, start, none, anchor)
    parent = tree(correlations(expected(table, model)), correlated)
    for _ in range(rounds - rounds // 2):
        model = fitted(expected(table, model), start, parent, anchor)
    return model


@dataclasses.dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    intercept: float

    def score(self, text: Column) -> Column:
        names, weights, intercept, key = self.names, self.weights, self.intercept, f"finder{hash((tuple(self.names), self.intercept))}"

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            finder = kept_by_worker(key, "finder", lambda: Finder(names))  # the words of one model at a time
            z = np.array([intercept + sum(weights[i] for i in sorted(finder(t or ""))) for t in texts], float)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return scored(text)


def logistic(rows: list, target: np.ndarray, k: int, ridge: float = 0.02, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method on the cross-entropy with soft targets and a ridge penalty."""
    x = np.zeros((len(rows), k + 1), np.float32)
    x[:, k] = 1
    for i, r in enumerate(rows):
        x[i, list(r)] = 1
    w = np.zeros(k + 1)
    penalty = np.full(k + 1, ridge)
    penalty[k] = 1e-6
    rate = float(np.clip(target.mean() if len(target) else 0.1, 1e-3, 1 - 1e-3))
    w[k] = math.log(rate / (1 - rate))
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + penalty * w
        h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-12))
    return w[:k], float(w[k])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, most_rows: int) -> DataFrame:
    """`t` and `label` of at most most_rows labelled documents that are not held out, by the hash of their id.

    Of labels or documents of one id the least counts; null ids have no label.
    """
    named = labels.select(F.col(f"`{doc_id}`").alias("label_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and label_id is not null")
    named = named.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("label").alias("label"))
    chosen = named.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    own = docs.select(F.col(f"`{doc_id}`").alias("label_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    # most_rows ids are broadcast at most; repeated ids meet in partial minima
    return own.join(F.broadcast(chosen), "label_id").groupBy("label_id", "label").agg(F.min("t").alias("t")).select("t", "label")


def others(docs: DataFrame, doc_id: str, text: str, voters: Voters, names: list[str], most_rows: int) -> list[tuple[list[int], list[int]]]:
    """Votes and features of at most most_rows documents that are not held out, by the hash of id and text, with or without a label."""
    key = f"others{hash((tuple(voters.found), tuple(names)))}"
    own = docs.where(~held_out(F.col(f"`{doc_id}`"))).select(F.col(f"`{text}`").alias("t"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("h"))
    cut = own.select("h").orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]

    def made(batches):
        vote, finder = kept_by_worker(key, "both", lambda: (voters.bind(), Finder(names)))
        for b in batches:
            t = [x or "" for x in b["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f(x) for x in t], pa.list_(pa.int32())) for f in (vote, lambda x: sorted(finder(x)))), b["h"]], ["v", "f", "h"])

    if cut is None:
        return []
    got = own.where(F.col("h") <= cut).mapInArrow(made, "v array<int>, f array<int>, h long").dropDuplicates(["h"]).orderBy("h").limit(most_rows)
    return [(list(r.v), list(r.f)) for r in got.collect()]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, threshold: float = 0.7) -> Model:
    """Fits voters, label model and classifier.

    labels has doc_id and toxic (0 or 1). Words are found on at most most_rows labelled rows that are not
    held out, and the classifier is fitted on the posteriors of these and of as many other rows that are
    not held out; the label model is fitted on the votes on all documents. Labels that are null or
    neither 0 nor 1 count for none. Without labels of both kinds the fixed voters have weak given rates.
    """
    seen = {}
    for r in sampled(docs, labels, doc_id, text, most_rows).collect():
        seen.setdefault(r.t, r.label)
    texts, y = list(seen), np.array(list(seen.values()), float)
    found, passed = find_voters(texts, y)
    voters = Voters(found)
    vote = voters.bind()
    votes = [vote(t) for t in texts]
    k, rate = len(voters.names()), float(np.clip((y.sum() + 1) / (len(y) + 20), 0.01, 0.5))
    on = np.zeros((len(texts), k))
    for i, v in enumerate(votes):
        on[i, v] = 1
    # voters that labelled rows never show keep a weak prior
    says_toxic = np.arange(k) < voters.toxic()
    toxic = ((on * y[:, None]).sum(axis=0) + np.where(says_toxic, 0.05, 0.02)) / (y.sum() + 1)
    clean = ((on * (1 - y)[:, None]).sum(axis=0) + np.where(says_toxic, 0.005, 0.05)) / ((1 - y).sum() + 1)
    model = fit_label_model(vote_table(docs, text, voters), rate, toxic, clean)
    names = list(dict.fromkeys([*found, *sorted({w for x in LEXICON.values() for w in x.split()}), *passed]))
    finder = Finder(names)
    own = [finder(t) for t in texts]
    more = others(docs, doc_id, text, voters, names, most_rows)
    target = np.array([model.posterior(v) for v in [*votes, *(v for v, _ in more)]])
    w, b = logistic([*own, *(f for _, f in more)], target, len(names))
    return Model(names, w, b + shift([b + sum(w[i] for i in f) for f in own], y, threshold))


def shift(z: list[float], y: np.ndarray, threshold: float) -> float:
    """What scores are moved by so that the threshold parts labelled rows best: the middle of the range that does, 0 if any will do."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-np.array(z), kind="stable")
    z, y = np.array(z)[order], y[order]
    hits = np.cumsum(y)
    last = np.append(z[1:] < z[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), 0)
    i = int(f1.argmax())
    cut = (z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1
    return math.log(threshold / (1 - threshold)) - float(cut)


def toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (1 from threshold on) to the columns of docs, replacing columns of these names.

    Null and empty texts get the score of a text without any feature. Only the text is read, so
    repeated rows score alike; an empty table stays empty.
    """
    out = docs.withColumn("score", model.score(F.col(f"`{text}`")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
