"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs linear * n + quadratic * n**2, as attention within a document does.
Documents are cut at the sequence length; pieces that fill a sequence are one, the rest of each
document goes, longest first, to the sequence of least cost with room for it, and is cut only where
no sequence has room. Shards of about SHARD_TOKENS tokens, dealt by hash, are packed on their own,
so each shard leaves one sequence unfilled at most.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dagwright.llm.common import kept_by_worker, pieces, text_size

SHARD_TOKENS = 1 << 20
#: Text that a worker splits at once.
SLICE_CHARS = 2 << 20


#: What a vocabulary file says of itself if texts may be taken apart at white space (fixed values, of the file's format).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Letters up to U+012F, punctuation and common white space: composed already, of one lower-case letter each whatever stands beside it.
UNSAFE = re.compile("[^\t-\r -\u012f\u2010-\u2027\u2030-\u205e\u20ac]")
#: Stands between words that are encoded together; no word has it.
BETWEEN = "|"


def drops_white_space(model: dict) -> bool:
    """Whether a vocabulary's ids of a text are those of its words in a row, case being dropped."""
    kinds = [(model.get(k) or {}).get(f"{k.replace('_', '')}s") for k in ("normalizer", "pre_tokenizer")]
    return kinds == [NORMALIZERS, PRETOKENIZERS] and model.get("post_processor") is None and all(x["special"] for x in model["added_tokens"])


class SegmentIds:
    """Ids of texts by the tokenizer, each white-space-parted segment encoded once.

    That holds for vocabularies whose normalizer and pre-tokenizer never look across white space and
    drop it; texts of others are encoded whole. Segments are looked up in lower case, and closing
    punctuation after a letter or digit, a token group of its own, apart. Words of letters alone go
    through the model without the normalizer, many at once. Of segments seen, the last LIMIT to twice
    as many are kept.
    """

    LIMIT, TOGETHER = 300_000, 2000
    CLOSING = ".,;:!?"

    def __init__(self, vocabulary: bytes, kind: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = True
        self.parted = drops_white_space(json.loads(vocabulary))
        self.code, self.ids, self.old = {"<u2": "H", "<u4": "I"}[kind], {}, {}
        if self.parted:
            self.plain = Tokenizer.from_str(json.dumps(json.loads(vocabulary) | {"normalizer": None, "pre_tokenizer": None}))
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.between = self.plain.encode(BETWEEN).ids
            self.parted = len(self.between) == 1

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.parted:
            return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words = {i: self.unsafe(t) for i, t in enumerate(texts) if UNSAFE.search(t)}
        parts = [words[i] if i in words else t.lower().split() for i, t in enumerate(texts)]
        if len(self.ids) > self.LIMIT:
            self.ids, self.old = {}, self.ids
        self.add(set().union(*parts).difference(self.ids), not words)
        get = self.ids.__getitem__
        return [b"".join(map(get, w)) for w in parts]

    @staticmethod
    def unsafe(text: str) -> list[str]:
        # the separators \x1c to \x1f are white space to str.split() only
        return [text] if re.search("[\x1c-\x1f]", text) else [w if UNSAFE.search(w) else w.lower() for w in text.split()]

    def add(self, new: set[str], safe: bool) -> None:
        """Ids of new segments; safe says that none of them is unsafe."""
        ids, old, closing = self.ids, self.old, self.CLOSING
        for w in new.intersection(old):
            ids[w] = old[w]
        new = new.difference(old)
        ended = [(w, core) for w in new if w[-1:] in closing and (core := w.rstrip(closing)) and core[-1].isalnum() and (safe or not UNSAFE.search(w))]
        new = new.difference([w for w, _ in ended]).union([c for _, c in ended], [w[len(c) :] for w, c in ended]).difference(ids)
        self.encode_new(list(new), safe)
        for w, core in ended:
            ids[w] = ids[core] + ids[w[len(core) :]]

    def encode_new(self, new: list[str], safe: bool) -> None:
        ids = self.ids
        letters = [w for w in new if w.isalpha() and (safe or not UNSAFE.search(w))]
        groups = [letters[i : i + self.TOGETHER] for i in range(0, len(letters), self.TOGETHER)]
        kind = "<u2" if self.code == "H" else "<u4"
        for i in range(0, len(groups), 8):
            some = groups[i : i + 8]
            for group, e in zip(some, self.plain.encode_batch_fast([f" {BETWEEN} ".join(g) for g in some], add_special_tokens=False), strict=True):
                found = np.array(e.ids, kind)
                cuts = np.flatnonzero(found == self.between[0])
                blob, size = found.tobytes(), found.itemsize
                starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(blob)]
                ids.update(zip(group, [blob[a:z] for a, z in zip(starts, ends, strict=True)], strict=True))
        others = list(set(new).difference(letters))
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids[w] = array(self.code, e.ids).tobytes()


def assign(lengths: np.ndarray, room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Packs pieces, descending, into the fewest sequences: (piece, start in it, length, sequence, offset)."""
    total = int(lengths.sum())
    k = -(-total // room)
    cost, left = np.zeros(k), np.full(k, room, np.int64)
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        start, n = 0, int(lengths[i])
        while n:
            fits = np.where(left >= n, cost, np.inf)
            j = int(fits.argmin())
            if fits[j] == np.inf:  # no sequence has room for it whole
                j = int(np.where(left > 0, cost, np.inf).argmin())
            m = min(n, int(left[j]))
            out.append((int(i), start, m, j, room - int(left[j])))
            left[j] -= m
            cost[j] += linear * m + quadratic * m * m
            start, n = start + m, n - m
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, room: int = 2048, doc_id: str = "doc_id", text: str = "text", linear: float = 1.0, quadratic: float = 1 / 1024, keep_ids: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packs every document, its ids and then end_id, into sequences of `room` tokens.

    Returns a row for each piece: `doc_id, start` (its document's ids before it), `length, ids_crc32`
    (of little-endian unsigned 32-bit ids), `doc_tokens, sequence_id, offset`, and with keep_ids
    `ids`, those bytes. Each id lies in one piece; offsets are gapless from 0; every sequence but
    one of each shard is full. Null texts count as empty and are one end_id; null and repeated
    doc_ids are packed like any others; extra columns are not read; an empty table gives none.

    vocabulary is the path of a `tokenizers` file; the driver reads it and sends its bytes.
    """
    with open(vocabulary, "rb") as f:
        model = f.read()
    model = docs.sparkSession.sparkContext.broadcast(model)  # a file of fixed size
    n, size = text_size(docs, text)
    shards = pieces(size // 4 + n, shard_tokens)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("hash"))

    def tokenized(batches):
        from tokenizers import Tokenizer

        small = Tokenizer.from_str(model.value.decode()).get_vocab_size() <= 1 << 16
        kind = "<u2" if small else "<u4"
        segments = kept_by_worker("packing", f"segments{zlib.crc32(model.value)}", lambda: SegmentIds(model.value, kind))
        last = np.array([end_id], kind).tobytes()
        for batch in batches:
            cuts, chars = [0], 0
            for i, n in enumerate(pc.utf8_length(batch["text"]).to_pylist()):
                chars += n
                if chars > SLICE_CHARS:
                    cuts.append(i + 1)
                    chars = 0
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                rows = {"doc_id": [], "start": [], "length": [], "crc": [], "doc_tokens": [], "shard": [], "part": [], "ids": []}
                for d, h, ids in zip(batch["doc_id"][a:b].to_pylist(), batch["hash"][a:b].to_pylist(), segments.encode(batch["text"][a:b].to_pylist()), strict=True):
                    ids = np.frombuffer(ids + last, kind)
                    for part, start in enumerate(range(0, len(ids), room)):
                        own = ids[start : start + room]
                        whole = len(own) == room
                        values = (d, start, len(own), zlib.crc32(own.astype("<u4").tobytes()) if whole else None, len(ids), h % shards, part, own.astype("<u4").tobytes() if whole and keep_ids else None if whole else own.tobytes())
                        for x, v in zip(rows.values(), values, strict=True):
                            x.append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending")])
        length, crc = table["length"].to_numpy(), table["crc"].to_pylist()
        doc, start, tokens, blobs = (table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        shard = table["shard"][0].as_py()
        rows = []
        whole = [i for i, c in enumerate(crc) if c is not None]
        for s, i in enumerate(whole):
            rows.append((doc[i], start[i], room, crc[i], tokens[i], s, 0, blobs[i]))
        rest = [i for i, c in enumerate(crc) if c is None]
        for i, a, m, s, at in assign(length[rest], room, linear, quadratic):
            i = rest[i]
            ids = np.frombuffer(blobs[i], f"<u{len(blobs[i]) // int(length[i])}")[a : a + m].astype("<u4").tobytes()
            rows.append((doc[i], start[i] + a, m, zlib.crc32(ids), tokens[i], len(whole) + s, at, ids))
        cols = list(zip(*rows, strict=True))
        out = {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), cols, strict=False)}
        out["sequence_id"] = pa.array([(shard << 32) + s for s in cols[5]], pa.int64())
        out["offset"] = pa.array(cols[6], pa.int64())
        return pa.table(out | ({"ids": pa.array(cols[7], pa.binary())} if keep_ids else {}))

    schema = T.StructType.fromDDL("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids)
    found = base.mapInArrow(tokenized, "doc_id long, start long, length long, crc long, doc_tokens long, shard long, part long, ids binary")
    return found.drop("part").groupBy("shard").applyInArrow(packed, schema)
