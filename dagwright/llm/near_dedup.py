"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

1. Chunks of documents count their shingles; ranges of the shingle hash add up document
   frequencies over the corpus and send each chunk the frequencies of its own shingles, a byte each.
2. A document of which less than `similarity` of the TF-IDF weight lies in shingles that another
   document has too can have no near copy. All others are sampled: each of bands x rows samples is
   the shingle that improved consistent weighted sampling picks, with its quantised weight.
3. Texts (one for each word sequence) that agree in a whole band are verified, first against the
   least text of their bucket, then, in buckets that are still parted into several components,
   block by block against all others. Links make components, components classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagwright.llm.common import FILE_BYTES, FILE_ROWS, drop, kept_by_worker, pieces, stored, text_size, written
from dagwright.llm.components import components
from dagwright.llm.windows import bucket_edges, rolling, split_words, starts, texts_of

#: Bytes of text in a chunk, shingles in a range, and texts in a block of an exact comparison, about.
CHUNK_BYTES, RANGE_HASHES, BLOCK = 2 << 20, 1 << 20, 256
#: Shingles that are sampled at once, and bytes of weighted sets that one task compares, about.
SAMPLED, SET_BYTES = 8192, 4 << 20
#: Shingles of others that a text is compared with at once.
MET = 1 << 17
#: Keys that are broadcast at most: those of more than one row in so many.
MOST_HOT = 10_000
#: Shingle hashes are cut to 48 bits, six bytes each; a sampling table has 2**16 draws.
WIDTH, DRAWS, SEED = 6, 16, 20260101
#: Document frequencies are sent as 8 * log2, rounded, in one byte.
STEP = 8


def packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(blob, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").reshape(-1)


def shingled(texts: list[bytes], k: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Text ids (hash of the word sequence), and the distinct (document, shingle) with their term frequencies.

    A text of fewer than k words, but at least one, has itself as its only shingle.
    """
    words, lens, h = split_words(texts)
    ids = [xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) for w in words]
    at = starts(lens, k)
    own = np.repeat(np.arange(len(lens)), np.maximum(lens - k + 1, 0))
    s = rolling(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        own = np.concatenate([own, short])
        s = np.concatenate([s, np.array([ids[i] + (1 << 63) for i in short], np.uint64)])
    s = s >> np.uint64(64 - 8 * WIDTH)
    order = np.lexsort((s, own))
    own, s = own[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (s[1:] != s[:-1])))) if len(s) else np.zeros(0, np.int64)
    return ids, own[first], s[first], np.diff(np.append(first, len(s)))


def draws(samples: int) -> tuple[np.ndarray, ...]:
    """Per sample a hash factor and a table of draws: 1/r and r of Gamma(2, 1), log c of Gamma(2, 1), and beta."""

    def make():
        g = np.random.default_rng(SEED)
        n = (samples, 1 << DRAWS)
        r = g.gamma(2.0, 1.0, n).astype(np.float32)
        return g.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.float32(1) / r, r, np.log(g.gamma(2.0, 1.0, n)).astype(np.float32), g.random(n, np.float32)

    return kept_by_worker("windows", f"draws{samples}", make)


def sampled(s: np.ndarray, w: np.ndarray, samples: int) -> np.ndarray:
    """One hash of (shingle, quantised weight) for each sample of one weighted set, block by block of its shingles."""
    factor, inv, r, log_c, beta = draws(samples)
    col = np.arange(samples)[None, :]
    least, of, step = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.zeros(samples, np.float32)
    for at in range(0, len(s), SAMPLED):
        own = s[at : at + SAMPLED]
        slot = ((own[:, None] * factor[None, :]) >> np.uint64(64 - DRAWS)).astype(np.int64)
        rr, b = r[col, slot], beta[col, slot]
        t = np.floor(np.log(w[at : at + SAMPLED], dtype=np.float32)[:, None] * inv[col, slot] + b)
        log_a = log_c[col, slot] - rr * (t - b) - rr
        best = log_a.argmin(axis=0)
        found = log_a[best, col[0]]
        new = found < least
        least, of, step = np.where(new, found, least), np.where(new, own[best], of), np.where(new, t[best, col[0]], step)
    return (of * np.uint64(0x9E3779B97F4A7C15)) ^ (step.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def weights(code: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
    """tf * idf, idf = 1 + log(n / df) / log(n): from 1, of a shingle that all documents have, to 2."""
    return (tf * (2.0 - code / STEP * math.log(2) / math.log(max(n, 2)))).astype(np.float32)


def similarity_of(s1: np.ndarray, w1: np.ndarray, s2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard: the sum of minima by the sum of maxima. s1 and s2 are sorted."""
    at = np.minimum(np.searchsorted(s2, s1), len(s2) - 1)
    hit = s2[at] == s1
    low = float(np.minimum(w1[hit], w2[at[hit]]).sum(dtype=np.float64))
    return low / (float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - low)


def shared(s: np.ndarray, w: np.ndarray, every: np.ndarray, who: np.ndarray, wt: np.ndarray, texts: int) -> np.ndarray:
    """The weight that a set has in common with each of `texts` sets, whose shingles, owners and weights stand by shingle.

    Some shingles at a time, as a very common one meets all sets.
    """
    a, b = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
    ends, at, low = np.cumsum(b - a), 0, np.zeros(texts)
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - (b - a)[at] + MET, "right")))
        n = (b - a)[at:to]
        met = np.repeat(a[at:to] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        low += np.bincount(who[met], np.minimum(wt[met], np.repeat(w[at:to].astype(np.float64), n)), texts)
        at = to
    return low


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, similarity: float, bands: int, rows: int, chunk_bytes: int) -> DataFrame:
    """doc_id, tid (of its word sequence), and for texts that may have near copies, once a chunk, bands and weighted shingles."""
    n, size = text_size(docs, text)
    chunks = pieces(size + 64 * n, chunk_bytes)
    buckets = 1 << max(0, (size // 7 // RANGE_HASHES).bit_length())
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # the place of a row parts rows that are alike in all else
    base = base.select(F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    edges = bucket_edges(buckets) >> np.uint64(64 - 8 * WIDTH)

    def sent(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s, df = np.unique(shingled(texts_of(table["text"]), k)[2], return_counts=True)
        cuts = np.append(np.searchsorted(s, edges), len(s))
        full = np.flatnonzero(np.diff(cuts))
        df = df.astype(np.uint32)
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "shingles": pa.array([packed(s[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()), "df": pa.array([df[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())})

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = [unpacked(x) for x in table["shingles"].to_pylist()]
        every, where = np.unique(np.concatenate(own), return_inverse=True)
        df = np.bincount(where, np.concatenate([np.frombuffer(x, np.uint32) for x in table["df"].to_pylist()]))
        code = np.minimum(255, np.rint(np.log2(df) * STEP)).astype(np.uint8)[where]
        cuts = np.cumsum([len(x) for x in own])[:-1]
        return pa.table({"chunk": table["chunk"], "bucket": pa.array([key[0].as_py()] * len(own), pa.int64()), "codes": pa.array([x.tobytes() for x in np.split(code, cuts)], pa.binary())})

    def signed(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own, s, tf = shingled(texts_of(left["text"]), k)
        every = np.unique(s)
        code = np.frombuffer(b"".join(right.sort_by("bucket")["codes"].to_pylist()), np.uint8)[np.searchsorted(every, s)]
        w = weights(code, tf, n)
        out = {"band": [], "shingles": [], "w": []}
        cuts, seen = np.searchsorted(own, np.arange(len(ids) + 1)), set()
        for i, tid in enumerate(ids):
            a, b = cuts[i], cuts[i + 1]
            wi = w[a:b]
            if a == b or tid in seen or wi[code[a:b] > 0].sum(dtype=np.float64) < similarity * wi.sum(dtype=np.float64) * 0.9999:
                for x in out.values():
                    x.append(None)
                continue
            seen.add(tid)
            got = sampled(s[a:b], wi, bands * rows).reshape(bands, rows)
            out["band"].append([xxhash.xxh3_64_intdigest(x.tobytes(), seed=j) - (1 << 63) for j, x in enumerate(got)])
            out["shingles"].append(packed(s[a:b]))
            out["w"].append(wi.tobytes())
        return pa.table({"doc_id": left["doc_id"], "tid": pa.array(ids, pa.int64()), "band": pa.array(out["band"], pa.list_(pa.int64())), "shingles": pa.array(out["shingles"], pa.binary()), "w": pa.array(out["w"], pa.binary())})

    codes = base.groupBy("chunk").applyInArrow(sent, "bucket long, chunk long, shingles binary, df binary").groupBy("bucket").applyInArrow(counted, "chunk long, bucket long, codes binary")
    return base.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(signed, "doc_id long, tid long, band array<bigint>, shingles binary, w binary")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, bands: int = 12, rows: int = 3, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Near-duplicate classes: a row for each row of docs, `doc_id`, `class_id`, `tid` and `kept`.

    Two texts are linked if they agree in a band of samples and the weighted Jaccard similarity of
    their TF-IDF shingles of k words is `similarity` or more; texts of one word sequence (parted by
    ASCII white space) are always linked. Classes are connected components; class_id is the least
    doc_id of a class and kept marks the row that bears it. With the default 12 bands of 3 samples
    a pair at similarity 0.8 is a candidate with probability 0.9998.

    Null texts count as empty; texts without words form one class, texts of fewer than k words are
    compared whole. Rows with a null doc_id get the class of their text, whose class_id is null if
    all its ids are; `kept` is then true for none. Repeated rows share a class and are all kept if
    they bear its class_id. Extra columns are not read; an empty table gives an empty table.
    """
    t = written(signatures(docs, doc_id, text, k, similarity, bands, rows, chunk_bytes), "signatures")
    n = t.count()
    texts = t.where("band is not null")
    bands_ = written(texts.select("tid", F.explode("band").alias("key")).distinct(), "bands", pieces(n * bands, FILE_ROWS))
    banded = bands_.count()
    full = bands_.groupBy("key").agg(F.min("tid").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    bucket = written(with_values(bands_, full, "key", "m", banded).where("tid <> lead"), "buckets", pieces(banded, FILE_ROWS))
    pairs = written(bucket.select("lead", "tid").distinct(), "pairs", pieces(bucket.count(), FILE_ROWS))
    asked = pairs.select("tid").union(pairs.select("lead")).distinct()
    sets = written(texts.select("tid", "shingles", "w", (F.octet_length("shingles") + F.octet_length("w")).cast("long").alias("bytes")).join(asked, "tid", "left_semi").dropDuplicates(["tid"]), "sets", pieces(stored(t), FILE_BYTES))
    links = verified(pairs, sets, similarity)
    linked = links.count()
    comp = components(links, linked)
    more = rest(bucket, comp, sets, similarity)
    if not more.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more), 2 * linked + more.count())
    by_text = written(t.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).join(comp.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "first", "n", F.coalesce("comp", "tid").alias("comp")), "texts", pieces(n, FILE_ROWS))
    classes = by_text.groupBy("comp").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    named = written(with_values(by_text.select("tid", "n", "comp"), classes, "comp", "texts", by_text.count()).select("tid", "n", "class_id"), "classes", pieces(n, FILE_ROWS))
    drop(bands_, bucket, pairs, sets, links, more, by_text)
    ids = written(t.select("doc_id", "tid"), "ids")
    drop(t)
    out = with_values(ids, named, "tid", "n", n)
    return out.select("doc_id", "class_id", "tid", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def with_values(rows: DataFrame, values: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """rows joined with values, which has a row for each key and how many of the `total` rows bear it.

    Keys of more than one row in MOST_HOT are MOST_HOT at most, so they are broadcast; no task gets more
    rows of any other key than that.
    """
    often = max(BLOCK, total // MOST_HOT)
    hot = values.where(F.col(times) > often).select(F.col(key).alias("_key"), F.struct(*[c for c in values.columns if c != key]).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    own = [c for c in values.columns if c != key]
    there = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in own if c not in rows.columns])
    others = values.where(F.col(times) <= often).select(key, *[c for c in own if c not in rows.columns])
    return there.union(marked.where("_hot is null").select(*rows.columns).join(others, key).select(there.columns))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b): the pairs (lead, tid) whose similarity is enough.

    Pairs are dealt into chunks by bytes, whatever their lead; a chunk gets each of its leads' sets once.
    """
    size = lambda name: sets.select(F.col("tid").alias(name), F.col("bytes").alias(f"{name}_bytes"))
    total = pairs.join(size("tid"), "tid").join(size("lead"), "lead").agg(F.coalesce(F.sum(F.col("tid_bytes") + F.col("lead_bytes")), F.lit(0))).first()[0]
    chunks = pieces(total, SET_BYTES)
    dealt = pairs.select("lead", "tid", F.pmod(F.xxhash64("lead", "tid"), F.lit(chunks)).alias("chunk"))
    members = dealt.join(sets.select("tid", "shingles", "w"), "tid").select("chunk", "lead", "tid", "shingles", "w")
    asked = dealt.select(F.col("chunk").alias("to"), F.col("lead").alias("of")).distinct()
    leads = asked.join(sets.select(F.col("tid").alias("of"), F.col("shingles").alias("s"), F.col("w").alias("v")), "of").select("to", "of", "s", "v")

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        of = {a: (unpacked(s), np.frombuffer(w, np.float32)) for a, s, w in zip(*(right[c].to_pylist() for c in ("of", "s", "v")), strict=True)}
        hit = [similarity_of(*of[a], unpacked(s), np.frombuffer(w, np.float32)) >= similarity for a, s, w in zip(*(left[c].to_pylist() for c in ("lead", "shingles", "w")), strict=True)]
        return pa.table({"a": left["lead"], "b": left["tid"]}).filter(pa.array(hit, pa.bool_()))

    return written(members.groupBy("chunk").cogroup(leads.groupBy("to")).applyInArrow(alike, "a long, b long"), "links")


def rest(bucket: DataFrame, comp: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between texts of one bucket that the comparison with its least text has left in several components.

    That text itself needs no more. A bucket's other texts are dealt into blocks by number and bytes; each
    pair of blocks is compared in one task.
    """
    named = bucket.where("m > 2").select("key", "tid").join(comp.withColumnRenamed("node", "tid"), "tid", "left").select("key", "tid", F.coalesce("comp", "tid").alias("comp"))
    named = written(named.join(sets.select("tid", "bytes"), "tid"), "named", pieces(bucket.count(), FILE_ROWS))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / SET_BYTES)).cast("long")
    parted = named.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), blocks.alias("g"), F.count(F.lit(1)).alias("m")).where("c1 <> c2").select("key", "g", "m")
    left = with_values(named, parted, "key", "m", named.count()).withColumn("block", F.pmod(F.xxhash64("tid"), "g"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    left = left.select("tid", "comp", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    left = left.join(sets.select("tid", "shingles", "w"), "tid")

    def compared(table: pa.Table) -> pa.Table:
        tids, comps, block = (table[c].to_numpy() for c in ("tid", "comp", "block"))
        s, w = [unpacked(x) for x in table["shingles"].to_pylist()], [np.frombuffer(x, np.float32) for x in table["w"].to_pylist()]
        cross = table["lo"][0] != table["hi"][0]
        sizes = [len(x) for x in s]
        who, every, wt = np.repeat(np.arange(len(s)), sizes), np.concatenate(s), np.concatenate(w).astype(np.float64)
        order = np.argsort(every, kind="stable")
        every, who, wt = every[order], who[order], wt[order]
        total = np.array([x.sum(dtype=np.float64) for x in w])
        label, out = {}, []

        def root(x):
            while label.get(x, x) != x:
                x = label[x]
            return x

        for i in range(len(s)):
            low = shared(s[i], w[i], every, who, wt, len(s))
            hit = low >= similarity * (total + total[i] - low)
            hit[: i + 1] = False
            if cross:
                hit &= block != block[i]
            for j in np.flatnonzero(hit):
                x, y = root(int(comps[i])), root(int(comps[j]))
                if x != y:
                    label[max(x, y)] = min(x, y)
                    out.append((int(tids[i]), int(tids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return written(left.groupBy("key", "lo", "hi").applyInArrow(compared, "a long, b long"), "links")
