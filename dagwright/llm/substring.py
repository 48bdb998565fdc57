"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Documents are dealt into chunks. Each chunk hashes every window and sends its sorted distinct
hashes, twice if the chunk itself holds one more than once, to ranges of the hash; a range finds
the hashes that came at least twice and returns to each chunk a bit for each hash it sent; the chunk
merges the windows that bear them into maximal intervals. A hash crosses the network once for each
chunk, however often a window occurs in it, so a passage that a third of the corpus shares weighs
no more than any other. The chunks' exchange serves both passes over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagwright.llm.common import pieces, text_size
from dagwright.llm.windows import bucket_edges, mixed, rolling, split_words, starts, texts_of

#: Bytes of text in a chunk, and window hashes in a range, about.
CHUNK_BYTES, RANGE_HASHES = 2 << 20, 1 << 20


def substring_dedup(docs: DataFrame, window: int = 35, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Removes each word that a repeated window of `window` words covers.

    A window repeats if its word sequence starts anywhere else, in the same document or another;
    windows are judged on the input. Words are runs of other than ASCII white space, unchanged.

    Returns a row for each row of docs: `row` (struct of all its columns, so names cannot clash),
    `n_words`, `n_removed`, `kept_text` (kept words joined by one space) and `removed` (intervals
    of word positions, end exclusive, maximal and in order). Null texts have no words and an empty
    kept_text; texts shorter than a window lose nothing; repeated rows are judged like any others,
    so all copies of a long text go whole; an empty table gives an empty table.

    Windows are told apart by 80 bits of two rolling hashes of their words' 64-bit hashes.
    """
    n, size = text_size(docs, text)
    chunks = pieces(size + 64 * n, chunk_bytes)
    buckets = 1 << max(0, (size // 7 // RANGE_HASHES).bit_length())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the place of a row parts rows that are alike in all columns
    base = docs.select(F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk"), F.struct(*columns).alias("row"))

    def hashes(table: pa.Table) -> tuple:
        """Words and their number of each text; places of windows and their two hashes, sorted by these; and which begin a run of equal ones."""
        words, lens, h = split_words(texts_of(pa.chunked_array([c.field(text) for c in table["row"].chunks])))
        at = starts(lens, window)
        one, two = (rolling(x, window)[at] if len(at) else np.zeros(0, np.uint64) for x in (h, mixed(h)))
        two = two.astype(np.uint16)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        return words, lens, at[order], one, two, runs(one, two)

    def sent(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *_, one, two, first = hashes(table)
        # a run's first, and its second if it has one, which stands for all further ones
        kept = first | np.concatenate((np.zeros(min(1, len(first)), bool), first[:-1]))
        one, two = one[kept], two[kept]
        cuts = np.append(np.searchsorted(one, bucket_edges(buckets)), len(one))
        full = np.flatnonzero(np.diff(cuts))
        part = lambda x: pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int64()), "one": part(one), "two": part(two)})

    def repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table["one"].to_pylist()]
        one, two = np.concatenate(own), np.concatenate([np.frombuffer(x, np.uint16) for x in table["two"].to_pylist()])
        order = np.lexsort((two, one))
        first = runs(one[order], two[order])
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        again = np.empty(len(one), bool)
        again[order] = np.repeat(size > 1, size)
        cuts, n, bits = np.cumsum([0, *map(len, own)]), [], []
        for a, z in zip(cuts, cuts[1:], strict=False):
            mask = again[a:z][runs(one[a:z], two[a:z])]
            n.append(len(mask))
            bits.append(np.packbits(mask).tobytes() if mask.any() else b"")
        return pa.table({"chunk": table["chunk"], "bucket": pa.array([key[0].as_py()] * len(own), pa.int64()), "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary())})

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        words, lens, at, _, _, first = hashes(left)
        right = right.sort_by("bucket")
        told = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) if x else np.zeros(n, bool) for n, x in zip(right["n"].to_pylist(), right["bits"].to_pylist(), strict=True)]
        hit = at[np.concatenate([np.zeros(0, bool), *told])[np.cumsum(first) - 1]] if len(at) else at
        edge = np.zeros(int(lens.sum()) + 1, np.int32)
        edge[hit] += 1  # a place is the start of one window and the end of one
        edge[hit + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept, spans, counts, pos = [], [], [], 0
        for w in words:
            own = gone[pos : pos + len(w)]
            pos += len(w)
            if own.any():
                turn = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn])
                counts.append(int(own.sum()))
                kept.append(b" ".join([x for x, g in zip(w, own.tolist(), strict=True) if not g]))
            else:
                spans.append([])
                counts.append(0)
                kept.append(b" ".join(w))
        row = left["row"].combine_chunks()
        return pa.table({"row": row, "n_words": pa.array(lens, pa.int64()), "n_removed": pa.array(counts, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))})

    back = base.groupBy("chunk").applyInArrow(sent, "bucket long, chunk long, one binary, two binary").groupBy("bucket").applyInArrow(repeated, "chunk long, bucket long, n long, bits binary")
    out = T.StructType([base.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>").fields])
    return base.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(removed, out)


def runs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of sorted pairs differ from the one before."""
    return np.concatenate((np.ones(min(1, len(one)), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
