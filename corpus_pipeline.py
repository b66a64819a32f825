"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as
the next one's documents. Language and quality reject documents, near-duplicates leave one document
of a group, decontamination cuts passages of test items, and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexline.llm import decontaminate, language, neardup, packing, quality
from lexline.llm.common import bounded_batches, remainder, table
from lexline.llm.registry import tokenizer_file
from lexline.session import bucketed, durable

#: Columns that operators add to documents; a document's own column of such a name is set aside.
_MADE = {
    "lang_pred", "lang_score", "base_failed", "kept", "longest", "spans", "items", "_at",
    "_words", "_lines", "_counts", "_limits", *quality.COUNTS,
}


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with clashing names replaced by their place, to be sent to Python in small batches."""
    bounded_batches(docs.sparkSession)
    return docs.toDF(*[f"_own_{i}" if c.lower() in _MADE else c for i, c in enumerate(docs.columns)])


def _back(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return result.select(
        *[F.col(f"`{new}`").alias(old) for new, old in zip(_aside(docs).columns, docs.columns, strict=True)]
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can name; null texts and texts without a letter go.
    Without any row to learn from, all texts with a letter stay."""
    rows = _aside(docs)
    model = language.fit(rows.where(remainder("doc_id", 4) != 2))
    if model is None:
        return _back(rows.where(F.col("text").rlike("\\p{L}")), docs)
    return _back(language.predict(rows, model).where(F.col("lang_pred") != language.UNKNOWN), docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the cutoffs fitted to ``labels`` keep. The counts are written
    with the texts, as the rules are fitted to them and then applied."""
    counted = durable(quality.with_counts(_aside(docs)))
    limits = quality.fit(counted, table(spark, sf_dir, "labels"))
    return _back(quality.judge(counted, limits).where("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates, the one with the smallest id. Each row is judged by
    its own text: rows that share an id, or have none, are linked like others, and a row without an id
    goes if its group has one with an id. Of equal ids any one row stays. Rows are dealt by their number
    once; neither the texts to compare nor the rows that stay are shuffled again."""
    numbered = bucketed(_aside(docs).withColumn("_at", F.monotonically_increasing_id()), "_at")
    linked = durable(neardup.near_duplicates(numbered, key="_at").select("_at", "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_at"))
    stay = linked.join(numbered.select("_at", "doc_id"), "_at").groupBy("component_id").agg(first.alias("first"))
    gone = linked.select("_at").join(stay.select("first._at"), "_at", "left_anti")
    return _back(numbered.join(gone, "_at", "left_anti"), docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with ``benchmark``; those that are mostly such go.
    ``n_chars`` follows a text that was cut."""
    left = decontaminate.remove_passages(_aside(docs), table(spark, sf_dir, "benchmark"))
    if "n_chars" in left.columns:
        kind = left.schema["n_chars"].dataType
        cut = F.size("spans") > 0
        left = left.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _back(left, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 1,024 tokens."""
    bounded_batches(spark)
    packed = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: Kernels, registers and tokens have no SQL: the stages are tested one by one and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
