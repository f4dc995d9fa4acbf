"""The queries op1_ to op10_ over whole tables, and the SQL that DuckDB can run for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import tokens
from quarrylight.llm.bpe import encode_and_decode
from quarrylight.llm.common import shared_path
from quarrylight.llm.embedding_dedup import embedding_dedup
from quarrylight.llm.exact_dedup import exact_dedup
from quarrylight.llm.jaccard_join import jaccard_classes
from quarrylight.llm.language_id import language_ids
from quarrylight.llm.packing import pack
from quarrylight.llm.quality import quality_scores
from quarrylight.llm.sstable import token_table
from quarrylight.llm.suffix_dedup import suffix_dedup
from quarrylight.llm.token_counts import token_counts

END_ID = 2


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; they aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir), n=3, num=90, den=100).drop("set_sha")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir), width=100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return token_table(_documents(spark, sf_dir), lambda: tokens.word_bpe(path), END_ID, vocabulary=49_408)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(_documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one in the shared folder, so that each call does the whole job."""
    return token_counts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), shared_path(spark, "token-cache"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return pack(_documents(spark, sf_dir), lambda: tokens.byte_bpe(path), END_ID, capacity=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_sorted_shards": op5_sorted_shards,
    "op6_language_id": op6_language_id,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SHINGLES = f"""
        w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM w WHERE len(w) > 0)"""

SQL: dict[str, str] = {
    "op1_jaccard_join": f"""
        WITH RECURSIVE {_SHINGLES},
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(r.v)) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.u = d.doc_id GROUP BY d.doc_id, n.n""",
    "op3_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM b)),
        r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        g AS (SELECT doc_id, i, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100)::INT, 0) AS g FROM r),
        n AS (SELECT doc_id, i, sum(g) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
        p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM n GROUP BY doc_id, k),
        q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM p),
        k AS (SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS spans, max(z) AS z, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS head FROM q JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT b.doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * z + 1) END)) AS kept_sha256
        FROM b LEFT JOIN k ON k.doc_id = b.doc_id""",
    "op7_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
        l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u), c AS (SELECT u, min(v) AS c FROM r GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, c) AS component_id, vec_id = least(vec_id, c) AS kept
        FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id""",
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
}
