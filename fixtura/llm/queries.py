"""The opN_ queries over the whole tables, with production parameters, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.llm import exact_dedup, language_id, lattice_lm, mixing, ngram_join, packing, quality_rules, repeat_spans, secrets, toxicity
from fixtura.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), n=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read_table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op8_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lattice_lm,
        op2_ngram_jaccard,
        op3_secret_scan,
        op4_quality_rules,
        op5_toxic_segments,
        op6_best_fit_packing,
        op7_source_mix,
        op8_repeat_spans,
        op9_language_id,
        op10_exact_dedup,
    )
}

ORACLES = {
    "op2_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS gram FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.at = l.x
        )
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.at) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        ), g AS (
            SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """,
}
