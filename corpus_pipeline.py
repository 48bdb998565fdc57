"""A corpus pipeline over documents; each stage's table is written and read again by the next.

Of documents, doc_id and text are read, and n_chars follows the text where there is such a column; other
columns, whatever their names, are handed on as they are. Null texts count as empty. No stage fails on
null or repeated doc_ids, repeated rows or an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagwright.llm import near_dedup, packing, pii, substring, toxicity
from dagwright.llm.common import FILE_BYTES, FILE_ROWS, pieces, stored, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these and their labels, doesn't call toxic.

    Rows are judged by their text alone: repeated rows go or stay together, and null, empty and very long
    texts are scored like all others; without any labels only words of the lexicons count.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    rows = docs.select(F.struct(*each(docs)).alias("row"), "text")
    return toxicity.toxicity(rows, model).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id if there is one, of each class of near copies.

    Texts without words are one class, so one null or empty text stays. Of rows that are alike in id and
    class, as repeated rows are, any one stays.
    """
    keyed = written(docs.select(F.struct(*each(docs)).alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    classes = near_dedup.near_dedup(keyed.select("at", "row.text"), doc_id="at").select(F.col("doc_id").alias("at"), "class_id")
    classes = written(classes.join(keyed.select("at", "row.doc_id"), "at"), "classes", pieces(keyed.count(), FILE_ROWS))
    kept = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at"))["at"].alias("at"))
    gone = classes.join(kept, "at", "left_anti").select("at")
    return keyed.join(gone, "at", "left_anti").select("row.*").coalesce(pieces(stored(keyed), FILE_BYTES))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words in repeated windows; texts that have none stay as they are, null ones null.

    A text of which all words go stays as an empty one: no row is dropped here, repeated ones neither.
    """
    out = substring.substring_dedup(docs, window=35)
    return out.select(with_text(docs, F.when(F.col("n_removed") > 0, F.col("kept_text"))))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind of each span of personal data in its place; texts without any, null ones too, stay as they are."""
    out = pii.find_pii(docs.select(F.struct(*each(docs)).alias("row"), "text"))
    return out.select(with_text(docs, F.when(F.size("spans") > 0, pii.masked(F.col("text"), F.col("spans")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids; a null or empty text is one end id, each repeated row packed."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


def each(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def with_text(docs: DataFrame, new: Column) -> list[Column]:
    """The columns of docs from a struct `row`, with a new text, and its length in n_chars, where new is not null."""
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce(new, columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length(new).cast(docs.schema["n_chars"].dataType), columns["n_chars"])
    return [x.alias(c) for c, x in columns.items()]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot train the classifier, sample sets or encode texts; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
