"""Queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexline.llm import (
    codebooks,
    conversations,
    decontaminate,
    language,
    licenses,
    mixture,
    neardup,
    ngram_lm,
    packing,
    quality,
    sharding,
    toxicity,
    unigram,
)
from lexline.llm.common import remainder, table
from lexline.session import durable


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_sharding(spark, sf_dir):
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("text").cast("binary")
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, lexicon)
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_licenses(spark, sf_dir):
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_max(F.transform("licenses", lambda x: x["containment"])).alias("containment"),
    )


@query
def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.token_counts(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens")


@query
def op8_packing(spark, sf_dir):
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op4_decontamination(spark, sf_dir):
    found = decontaminate.find_spans(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder("doc_id", 4) != 2))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


@query
def op9_language_model(spark, sf_dir):
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.score(docs, ~held_out).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        F.col("lm_score").alias("score"),
    )


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counted = durable(quality.with_counts(docs).drop("text"))
    limits = quality.fit(counted, table(spark, sf_dir, "labels"))
    return quality.judge(counted, limits).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op11_vector_codes(spark, sf_dir):
    """Codes of 16 parts and 64 entries after two rounds; see ``codebooks.compress`` for odd rows."""
    return codebooks.compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def _op11_sql() -> str:
    """The same by a full comparison of parts and entries in each round."""

    def assigned(n: int) -> str:
        return f"""
        a{n} AS (
            SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x,
                min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + e)
                    AS best
            FROM parts JOIN c{n} USING (p) GROUP BY vec_id, p
        )"""

    def means(n: int) -> str:
        return f"""
        c{n} AS (
            SELECT c{n - 1}.p, c{n - 1}.e, coalesce(m.c, c{n - 1}.c) AS c
            FROM c{n - 1} LEFT JOIN (
                SELECT p, e, list(CAST(floor(total / members) AS BIGINT) ORDER BY i) AS c
                FROM (
                    SELECT p, best % 64 AS e, i, CAST(sum(x[i]) AS DOUBLE) AS total, count(*) AS members
                    FROM a{n - 1} CROSS JOIN unnest(range(1, len(x) + 1)) AS places(i) GROUP BY ALL
                ) GROUP BY p, e
            ) AS m USING (p, e)
        )"""

    steps = ",".join([assigned(0), means(1), assigned(1), means(2), assigned(2)])
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    parts AS (
        SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x
        FROM kept CROSS JOIN range(16) AS positions(p)
    ),
    c0 AS (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
        FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
    ),
    {steps},
    coded AS (
        SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code,
            CAST(sum(best // 64) AS BIGINT) AS error
        FROM a2 GROUP BY vec_id
    ),
    entries AS (
        SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM c2
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded CROSS JOIN entries
    """


ORACLES["op11_vector_codes"] = _op11_sql()


@query
def op12_mixture(spark, sf_dir):
    """A mix of one and a half times all words, weights 3, 1, 2; see ``mixture.mix`` for odd rows."""
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_conversations(spark, sf_dir):
    """Cheapest edits of every conversation; see ``conversations.repair`` for odd rows."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
