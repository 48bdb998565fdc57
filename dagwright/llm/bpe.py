"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words.

1. Batches of texts are taken apart into segments, words and their distinct words. Each batch is
   exchanged once, as numbers, not as text.
2. Ranges of a hash of the words gather the distinct words of all batches, so that each is encoded
   once for the corpus, by one expression that folds its merges. The ranks are a literal: a pair of
   ids (a, b) that may merge lies, with the rank of the merged piece, at one of two places of a
   table, A1[a] xor B1[b] or A2[a] xor B2[b].
3. Each range sends each batch the ids of its words, and the batch puts its texts together again.

Words of more than LONG bytes, for which a fold would take time by the square of their length, are
merged by the same ranks with a heap. Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagwright.llm.common import kept_by_worker, pieces, text_size

#: Text that makes one batch of words, text for each range of words, words that make one row, and bits of the pair table.
BATCH_CHARS, RANGE_BYTES, ROW_WORDS, TABLE_BITS, SEED = 16 << 20, 8 << 20, 4096, 18, 7
#: Bytes of a word that is folded at most; above, a heap merges it.
LONG = 256
#: Bits of an id and of a position in a word; the rank of an element's pair with the next is above them.
ID, PLACE = 16, 24
#: The rank of a pair that does not merge.
NONE = 1 << 16
#: Patterns that never join a character before a single space to it and tell runs of white space by what
#: follows them; texts of other patterns are not parted at spaces.
PARTED = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
#: Where a text cannot be parted at every single space, because white space runs on.
RUNS = re.compile(r"\s (?=\s|\Z)")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
WHITE = re.compile(r"[\s\x1c-\x1f]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Pairs of ids whose pieces make up another piece, and its rank, which is its id."""
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def pair_table(pairs: dict[tuple[int, int], int], ids: int) -> tuple[np.ndarray, ...]:
    """Cuckoo table: A1, B1, A2, B2 and slots of (a << 33 | b << 17 | flag << 16 | rank).

    The flag says that a pair whose first place this is lies at its second.
    """
    n, rng = 1 << max(TABLE_BITS, (2 * len(pairs)).bit_length()), np.random.default_rng(SEED)
    while True:
        a1, b1, a2, b2 = (rng.integers(0, n, ids) for _ in range(4))
        first = {p: int(a1[p[0]] ^ b1[p[1]]) for p in pairs}
        second = {p: int(a2[p[0]] ^ b2[p[1]]) for p in pairs}
        slots: dict[int, tuple[int, int]] = {}
        for pair in pairs:
            at, left = first[pair], 2000
            while pair is not None and left:
                pair, slots[at] = slots.get(at), pair
                left -= 1
                if pair is not None:
                    at = second[pair] if at == first[pair] else first[pair]
            if pair is not None:
                break
        else:
            table = np.zeros(n, np.int64)
            for at, p in slots.items():
                table[at] |= p[0] << 33 | p[1] << 17 | pairs[p]
                if first[p] != at:
                    table[first[p]] |= 1 << 16
            return a1, b1, a2, b2, table


def literal(x: np.ndarray, kind: str) -> Column:
    return F.split(F.lit(" ".join(map(str, x.tolist()))), " ").cast(f"array<{kind}>")


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<smallint>> of bytes, up to 2**PLACE a word, to array<array<int>> of ids.

    A word is an array of longs, one for each piece: the rank of its pair with the next piece, its
    first byte's position, and its id, so that the least element is the next merge. A merge takes two
    elements away and works out the ranks of two pairs.
    """
    if len(ranks) > 1 << ID:
        raise ValueError("the pair table holds ids of 16 bits")
    size = max(ranks.values()) + 1
    names = ("first_a", "first_b", "second_a", "second_b", "slots")
    tables = [literal(x, "bigint" if n == "slots" else "int").alias(n) for n, x in zip(names, pair_table(merges(ranks), size), strict=True)]
    byte = literal(np.array([ranks[bytes([i])] for i in range(256)]), "int").alias("byte")
    long = lambda x: F.lit(x).cast("bigint")
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    id_of = lambda x: x.bitwiseAND(long((1 << ID) - 1)).cast("int")

    def ranked(t: Column, a: Column, b: Column) -> Column:
        """The rank of a pair of ids, NONE if it does not merge or b is null."""

        def at(v: Column, otherwise: Column) -> Column:
            return F.when(F.shiftright(v, 17) == F.shiftleft(a.cast("bigint"), 16) + b, v.bitwiseAND(long(0xFFFF))).otherwise(otherwise)

        second = bind(F.get(t["slots"], F.get(t["second_a"], a).bitwiseXOR(F.get(t["second_b"], b))), lambda v: at(v, long(NONE)))
        return bind(F.get(t["slots"], F.get(t["first_a"], a).bitwiseXOR(F.get(t["first_b"], b))), lambda v: at(v, F.when(v.bitwiseAND(long(1 << 16)) != 0, second).otherwise(long(NONE))))

    def element(rank: Column, rest: Column) -> Column:
        return F.shiftleft(rank, ID + PLACE).bitwiseOR(rest)

    def encode(t: Column, word: Column) -> Column:
        own = F.transform(word, lambda b: F.get(t["byte"], b))
        start = bind(own, lambda ids: F.transform(ids, lambda a, i: element(ranked(t, a, F.get(ids, i + 1)), F.shiftleft(i.cast("bigint"), ID).bitwiseOR(a.cast("bigint")))))

        def merged(state: Column, best: Column, at: Column) -> Column:
            """state with its at-th element, counted from 1, and the next one as one piece."""
            new = F.shiftright(best, ID + PLACE)
            place = best.bitwiseAND(long(((1 << PLACE) - 1) << ID))
            one = element(ranked(t, new.cast("int"), id_of(F.get(state, at + 1))), place.bitwiseOR(new))
            rest = F.slice(state, at + 2, F.size(state))
            left = bind(F.get(state, at - 2), lambda x: element(ranked(t, id_of(x), new.cast("int")), x.bitwiseAND(long((1 << (ID + PLACE)) - 1))))
            return F.when(at == 1, F.concat(F.array(one), rest)).otherwise(F.concat(F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))), F.array(left, one), rest))

        def step(state: Column, _: Column) -> Column:
            return bind(F.array_min(state), lambda best: F.when(best >= long(NONE << (ID + PLACE)), state).otherwise(bind(F.array_position(state, best).cast("int"), lambda at: merged(state, best, at))))

        return F.aggregate(F.slice(word, 2, LONG), start, step, lambda state: F.transform(state, id_of))

    # the tables are bound, so that they stand in the plan once
    return bind(F.struct(*tables, byte), lambda t: F.transform(words, lambda word: encode(t, word)))


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length, in about n log n steps."""
    n = len(word)
    end, before, heap = list(range(1, n + 1)), list(range(-1, n)), []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if end[i] != middle or end[middle] != last:  # one of the two has merged meanwhile
            continue
        end[i], end[middle] = last, -1
        before[last] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Indexed(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the low bytes first and then each next plane of them."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unsqueezed(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).view(np.int32)


def news_out(numbers: np.ndarray) -> np.ndarray:
    """Numbers of things numbered as they come: 0 where one comes first, else its number plus 1."""
    top = np.maximum.accumulate(numbers) if len(numbers) else numbers
    return np.where(numbers > np.concatenate(([-1], top[:-1])), 0, numbers + 1)


def news_in(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.cumsum(x == 0) - 1, x - 1)


def split_all(segments: list[str], split) -> list[list[str]]:
    """The words of segments that each begin with their only space."""
    out: list[list[str]] = []
    for w in split("".join(segments)):
        if w[0] == " ":
            out.append([w])
        else:
            out[-1].append(w)
    return out


def taken_apart(texts: Iterator[tuple[int, str]], split, parted: bool, buckets: int) -> Iterator[dict]:
    """Batches: documents as segments, segments as words, distinct words as bytes, and each word's bucket.

    A segment is what stands between single spaces, with the space before it. Segments and words are
    numbered as they come.
    """

    def batch() -> dict:
        words, plain, per, flat = Indexed(), [], np.empty(len(segments), np.int64), [None] * len(segments)
        for (first, s), i in segments.items():
            if first or WHITE.search(s) or not s:
                flat[i] = split(s if first else " " + s)
            else:
                plain.append((i, " " + s))
        for a in range(0, len(plain), 50_000):
            some = plain[a : a + 50_000]
            for (i, _), found in zip(some, split_all([s for _, s in some], split), strict=True):
                flat[i] = found
        for i, found in enumerate(flat):
            per[i] = len(found)
        numbers = np.fromiter((words[w] for found in flat for w in found), np.int64, int(per.sum()))
        as_bytes = [w.encode() for w in words]
        return {
            "doc_ids": ids,
            "docs": squeezed(np.concatenate([np.zeros(0, np.int32), *docs])),
            "lens": squeezed(np.array([len(d) for d in docs], np.int64)),
            "segments": squeezed(news_out(numbers)),
            "sizes": squeezed(per),
            "words": zlib.compress(b"".join(as_bytes), 1),
            "word_sizes": squeezed(np.fromiter(map(len, as_bytes), np.int64, len(as_bytes))),
            "in_bucket": squeezed(np.fromiter(map(zlib.crc32, as_bytes), np.int64, len(as_bytes)) % buckets),
        }

    segments, known, ids, docs, chars = {}, {}, [], [], 0
    for doc, text in texts:
        parts = [text] if not parted else text.split(" ") if RUNS.search(text) is None else SINGLE.split(text)
        row = np.empty(len(parts), np.int32)
        row[0] = segments.setdefault((True, parts[0]), len(segments))
        for s in set(parts[1:]).difference(known):
            known[s] = segments[False, s] = len(segments)
        row[1:] = np.fromiter(map(known.__getitem__, parts[1:]), np.int32, len(parts) - 1)
        ids.append(doc)
        docs.append(row)
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield batch()
            segments, known, ids, docs, chars = {}, {}, [], [], 0
    if ids:
        yield batch()


def cut(blob: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = offsets_of(sizes).tolist()
    return [blob[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows one after another, and the rows' lengths."""
    n = offsets[rows + 1] - offsets[rows]
    at = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(rows) else np.zeros(0, np.int64)
    return values[at], n


def offsets_of(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n, dtype=np.int64)))


def distinct_words(table: pa.Table) -> tuple[dict[bytes, int], list[list[bytes]]]:
    """The words of one bucket, by their first batch and place, and the words of each of the table's rows."""
    own = [cut(zlib.decompress(w), unsqueezed(n)) for w, n in zip(table["words"].to_pylist(), table["word_sizes"].to_pylist(), strict=True)]
    every = Indexed()
    for words in own:
        for w in words:
            every[w]
    return every, own


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id` and `ids` (array of int) for each row: pattern's matches in the text, each merged by rank.

    Ranks are a `tiktoken` file, read by the driver. There are no special tokens: their strings are
    text. Null texts count as empty and have no ids; null and repeated doc_ids are rows like any
    others; texts and words may be of any length; extra columns are not read; an empty table gives none.
    """
    ranks = read_ranks(vocabulary)
    buckets = pieces(text_size(docs, text)[1], RANGE_BYTES)
    sent_ranks = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary of at most 2**16 pieces
    batch_type = "batch long, doc_ids array<bigint>, docs binary, lens binary, segments binary, sizes binary, words binary, word_sizes binary, in_bucket binary"

    def apart(batches):
        import regex
        from pyspark import TaskContext

        split = kept_by_worker("bpe", f"pattern{pattern}", lambda: regex.compile(pattern)).findall
        rows = ((d, t or "") for b in batches for d, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True))
        part = TaskContext.get().partitionId() << 32
        for i, x in enumerate(taken_apart(rows, split, pattern in PARTED, buckets)):
            own = [pa.array([part + i], pa.int64()), pa.array([x.pop("doc_ids")], pa.list_(pa.int64())), *(pa.array([v], pa.binary()) for v in x.values())]
            yield pa.RecordBatch.from_arrays(own, ["batch", "doc_ids", *x])

    def dealt(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, words = unsqueezed(table["in_bucket"][0].as_py()), cut(zlib.decompress(table["words"][0].as_py()), unsqueezed(table["word_sizes"][0].as_py()))
        order, n = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
        full, of, words = np.flatnonzero(n), offsets_of(n), [words[i] for i in order.tolist()]
        own = [words[of[b] : of[b + 1]] for b in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "batch": pa.array([key[0].as_py()] * len(full), pa.int64()), "words": pa.array([zlib.compress(b"".join(x), 1) for x in own], pa.binary()), "word_sizes": pa.array([squeezed(np.fromiter(map(len, x), np.int64, len(x))) for x in own], pa.binary())})

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        short = [w for w in distinct_words(table.sort_by("batch"))[0] if len(w) <= LONG]
        rows = []
        for i in range(0, len(short), ROW_WORDS):
            some = short[i : i + ROW_WORDS]
            inner = pa.ListArray.from_arrays(pa.array(offsets_of(np.fromiter(map(len, some), np.int64, len(some))), pa.int32()), pa.array(np.frombuffer(b"".join(some), np.uint8).astype(np.int16)))
            rows.append(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), inner))
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array(range(len(rows)), pa.int32()), "words": pa.chunked_array(rows, pa.list_(pa.list_(pa.int16())))})

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("batch"), right.sort_by("part")
        every, own = distinct_words(left)
        folded, n_folded = (right[c].combine_chunks().flatten().to_numpy() if len(right) else np.zeros(0, np.int64) for c in ("ids", "n"))
        long = np.fromiter((len(w) > LONG for w in every), bool, len(every))
        n = np.zeros(len(every), np.int64)
        n[~long] = n_folded
        more = [merged_by_heap(w, sent_ranks.value) for w in every if len(w) > LONG]
        n[long] = [len(x) for x in more]
        ids, of = np.empty(int(n.sum()), np.int64), np.repeat(long, n)
        ids[~of] = folded
        ids[of] = np.concatenate([np.zeros(0, np.int64), *map(np.array, more)])
        at, out = offsets_of(n), {"ids": [], "n": []}
        for words in own:
            found, sizes = ragged(ids, at, np.fromiter(map(every.__getitem__, words), np.int64, len(words)))
            out["ids"].append(squeezed(found))
            out["n"].append(squeezed(sizes))
        return pa.table({"batch": left["batch"], "bucket": left["bucket"], "ids": pa.array(out["ids"], pa.binary()), "n": pa.array(out["n"], pa.binary())})

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        right, row = right.sort_by("bucket"), left.slice(0, 1).to_pylist()[0]
        ids, n = (np.concatenate([np.zeros(0, np.int64), *map(unsqueezed, right[c].to_pylist())]) for c in ("ids", "n"))
        place = np.argsort(np.argsort(unsqueezed(row["in_bucket"]), kind="stable"), kind="stable")  # ids come bucket by bucket
        by_segment, n = ragged(ids.astype(np.int32), offsets_of(n), place[news_in(unsqueezed(row["segments"]))])
        tokens = offsets_of(n)[offsets_of(unsqueezed(row["sizes"]))]
        cuts, segs, doc_ids, out = offsets_of(unsqueezed(row["lens"])), unsqueezed(row["docs"]), row["doc_ids"], []
        for a in range(0, len(doc_ids), 256):
            z = min(a + 256, len(doc_ids))
            flat, per = ragged(by_segment, tokens, segs[cuts[a] : cuts[z]])
            ends = offsets_of(per)[cuts[a : z + 1] - cuts[a]].astype(np.int32)
            out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids[a:z], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["doc_id", "ids"]))
        return pa.Table.from_batches(out)

    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    batches = read.mapInArrow(apart, batch_type).groupBy("batch")  # one exchange serves both uses
    by_word = batches.applyInArrow(dealt, "bucket long, batch long, words binary, word_sizes binary").groupBy("bucket")
    coded = by_word.applyInArrow(distinct, "bucket long, part int, words array<array<smallint>>").withColumn("words", encode_words(F.col("words"), ranks))
    coded = coded.select("bucket", "part", F.flatten("words").alias("ids"), F.transform("words", F.size).alias("n"))
    back = by_word.cogroup(coded.groupBy("bucket")).applyInArrow(answered, "batch long, bucket long, ids binary, n binary")
    return batches.cogroup(back.groupBy("batch")).applyInArrow(together, "doc_id long, ids array<int>")


def bpe_decode(ids: Column, vocabulary: str) -> Column:
    """The bytes of an array of ids, its binary pieces in a row; null ids or unknown ones are an error, a null array is null."""
    ranks = read_ranks(vocabulary)
    at = [""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        at[i] = piece.hex()
    hexes = F.split(F.lit(" ".join(at)), " ")

    def piece(i: Column) -> Column:
        own = F.get(hexes, i)
        return F.when(own != "", own).otherwise(F.raise_error(F.lit("an id that the vocabulary lacks")))

    return F.unhex(F.array_join(F.transform(ids, piece), ""))
