"""Sharding by jump consistent hashing (Lamping and Veach), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagwright.llm.common import pieces, written

#: The multiplier of the published algorithm's generator, key = key * MULTIPLIER + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757
#: Rows that one task numbers, about.
BLOCK_ROWS = 200_000


def next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, by limbs of 16 bits, so that nothing overflows under ANSI rules."""
    low = F.lit(0xFFFF).cast("long")
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(low) for i in range(4)]
    m = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    carry, out = F.lit(1).cast("long"), F.lit(0).cast("long")
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + k[j] * F.lit(m[i - j]).cast("long")
        out = out.bitwiseOR(F.shiftleft(total.bitwiseAND(low), 16 * i))
        carry = F.shiftrightunsigned(total, 16)
    return out


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long key: as many steps as there are shards bound the loop, since every jump goes up."""
    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jumped(acc: Column, key: Column) -> Column:
        to = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + 1).cast("double")))
        return F.struct(key.alias("key"), acc["j"].alias("b"), to.cast("long").alias("j"))

    def step(acc: Column, _: Column) -> Column:
        # transform over one element binds the new key, so that it is worked out once
        return F.when(acc["j"] < shards, F.transform(F.array(next_key(acc["key"])), lambda key: jumped(acc, key))[0]).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["b"]).cast("int")


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into a shard by its key: `doc_id, size, text_crc32, law, shard, slot, grown_shard`.

    The law is `key`: a long doc_id and the shard count alone decide, and one more shard (grown_shard)
    takes rows only into itself. A null doc_id has key 0 and so all such rows share a shard, as do
    repeated rows; `size` is the text's UTF-8 bytes plus 1, a null text counts as empty. Slots
    number a shard's rows from 0 without gaps, by doc_id (nulls first), size and checksum; rows alike
    in all three may take each other's slots. Extra columns are not read; an empty table gives none.

    Texts stay where they are read; what is sorted is four numbers a row, ranged over all tasks.
    """
    row = F.col(f"`{doc_id}`").cast("long")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(row.alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    key = F.coalesce("doc_id", F.lit(0).cast("long"))
    keyed = written(keyed.select("*", jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard")), "keyed")
    rows = keyed.count()
    tasks = max(pieces(rows, BLOCK_ROWS), int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", "doc_id", "size", "text_crc32"]
    tie = F.monotonically_increasing_id().alias("tie")  # parts equal rows among tasks; any order of them will do
    at = keyed.select("*", tie).repartitionByRange(tasks, *order, "tie").sortWithinPartitions(*order, "tie")
    at = written(at.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "ranged")
    counts = at.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    offset = counts.select("shard", "part", (F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("offset"))
    # one row for each task and each shard that begins in it: fewer than tasks + shards rows
    out = at.join(F.broadcast(offset) if tasks + shards <= 100_000 else offset, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("pos") + F.col("offset")).alias("slot"), "grown_shard")
