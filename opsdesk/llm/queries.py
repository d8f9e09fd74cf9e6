"""One query for each operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lexsearch, linededup, mixing, neardup, quotes, secrets, simhash, tokencount, toxicity, vafile, whitening
from .common import crc_mod, read


def _held_out(n: int, remainder: int):
    return F.coalesce(crc_mod(F.col("doc_id"), n) == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.fit(documents, read(spark, sf_dir, "labels"), learn=crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.score(documents, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(read(spark, sf_dir, "conversations"), scope="conv_id", turn="turn", min_chars=12)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = langid.fit(documents, learn=crc_mod(F.col("doc_id"), 4) != 2)
    return langid.predict(documents, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_findings(spark))
    return secrets.scan(read(spark, sf_dir, "documents"), model, path="source", min_chars=16, min_named=6, threshold=0.5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), max_repeats=2.0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(read(spark, sf_dir, "documents"), max_edits=1, min_chars=2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000, components=16)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, max_bits=4)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_vector_search": op2_vector_search, "op3_decontamination": op3_decontamination, "op4_quotation_linking": op4_quotation_linking, "op5_language_id": op5_language_id, "op6_token_counts": op6_token_counts, "op7_near_dedup": op7_near_dedup, "op8_secret_scan": op8_secret_scan, "op9_mixing": op9_mixing, "op10_line_dedup": op10_line_dedup, "op11_whitening": op11_whitening, "op12_lexical_search": op12_lexical_search, "op13_simhash": op13_simhash}
ORACLE_SQL = {
    "op2_vector_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id, e FROM v WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(e), e) = 1),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
        s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
        x AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM p JOIN q USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
        k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
