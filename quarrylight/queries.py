"""Registered queries over whole tables, each with SQL that DuckDB runs on the same tables where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import chunkers
from quarrylight.functions import columns as C
from quarrylight.operators import fulltext, fusion, indexing, ranking, search, vectors
from quarrylight.plans.query import SearchOptions, intent, prepared_match, snippet_match, strategy
from quarrylight.sources import corpus
from quarrylight.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words of the test corpus, so that queries find something; camel case and protocol names exercise the boosts.
TEXTS = {"q1": "the and with", "q2": "para que", "q3": "Codable und", "q4": "thing", "q5": "what implements Codable"}
SNIPPET_TEXTS = {"s1": "please help", "s2": "the", "s3": "user"}
HYBRID = SearchOptions(limit=10)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vectors of the table stand for the embedded queries."""
    rows = corpus.vectors(spark, sf_dir).filter(F.col("id").isin([str(i) for i in range(len(TEXTS))]))
    return rows.select(F.concat(F.lit("q"), (F.col("id").cast("int") + 1).cast("string")).alias("query_id"), F.col("embedding").alias("vector"))


def every_20th_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row whose id is divisible by 20 is a query, against all rows."""
    rows = corpus.vectors(spark, sf_dir).filter(F.col("id").cast("long") % 20 == 0)
    return rows.select(F.concat(F.lit("q"), "id").alias("query_id"), F.col("embedding").alias("vector"))


# --- SQL parts -------------------------------------------------------------------------------

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
CHUNKS_SQL = rf"""
    d AS (SELECT doc_id, source, coalesce(text, '') AS content, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
    chunks AS (SELECT doc_id::VARCHAR AS id,
        '/project/' || {_LIST(corpus.FOLDERS)}[doc_id % 4 + 1] || '/' || source || '/doc' || doc_id || '.' || {_LIST(corpus.EXTENSIONS)}[doc_id % 3 + 1] AS path,
        content, 1 AS start_line, {_LIST(corpus.KINDS)}[doc_id % 5 + 1] AS kind, t[1:2] AS symbols, t[3:4] AS refs,
        (CASE WHEN doc_id % 3 = 0 THEN 'public ' ELSE '' END) || coalesce(t[1], '') AS signature,
        CASE WHEN doc_id % 6 = 0 THEN ['Codable', 'ChunkStore'] WHEN doc_id % 6 = 3 THEN ['Store' || (doc_id % 7)] ELSE []::VARCHAR[] END AS conformances,
        doc_id % 2 = 0 AS is_type_declaration, sha256(content) AS content_hash, len(string_split(content, chr(10))) AS end_line, t FROM d)"""

_CHUNK_TEXT = "t, symbols, []::VARCHAR[], []::VARCHAR[], regexp_extract_all(lower(array_to_string(conformances, ' ')), '[\\p{L}\\p{N}]+')"


# What each query string asks for, written out by hand, so that the SQL doesn't come from the parser that it checks. A star marks a prefix,
# a space a phrase of neighbouring tokens; all phrases are required ("all") or one is enough ("any").
_ASKED = {"q1": ("all", "the*", "and*", "with*"), "q2": ("all", "para*", "que*"), "q3": ("all", "codable", "und*"), "q4": ("all", "thing*"), "q5": ("all", "what*", "implements*", "codable")}
_ASKED_PHRASES = {"p1": ("all", "de", "la"), "p2": ("all", "of the*"), "p3": ("any", "foo the*")}
_ASKED_SNIPPETS = {"s1": ("any", "please*", "help*"), "s2": ("any", "the*"), "s3": ("any", "user*")}
_ASKED_EXPANDED = {"q1": ("all", "the*", "and*", "with*", "of"), "q2": ("all", "para*", "que*", "la"), "q4": ("all", "thing*", "that*")}
#: For the boosts: terms that aren't stop words, camel-case ones of them, and whether the query is a question.
_BOOSTED = {"q1": (["and"], [], False), "q2": (["para", "que"], [], False), "q3": (["Codable", "und"], ["Codable"], False), "q4": (["thing"], [], False), "q5": (["Codable"], ["Codable"], True)}


def bm25_sql(asked: dict[str, tuple[str, ...]], source: str = "chunks", fields: str = _CHUNK_TEXT, name: str = "scored") -> str:
    """CTEs that end in `name`(query_id, id, score)."""
    values = ", ".join(
        f"('{q}', {i}, {j}, '{t.rstrip('*')}', {str(t.endswith('*')).lower()}, {len(phrase.split())}, {len(phrases)}, {str(how == 'all').lower()})"
        for q, (how, *phrases) in asked.items() for i, phrase in enumerate(phrases) for j, t in enumerate(phrase.split())
    )
    return f"""
    terms(query_id, phrase, place, key, prefix, tokens, phrases, every_) AS (VALUES {values}),
    fielded AS (SELECT id, [{fields}] AS f FROM {source}),
    sized AS (SELECT id, f, list_sum([len(x) FOR x IN f]) AS dl FROM fielded),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
    field_rows AS (SELECT id, dl, unnest(f) AS terms_, unnest(range(len(f))) AS field FROM sized),
    tokens_ AS (SELECT id, dl, field, unnest(terms_) AS term, unnest(range(len(terms_))) AS pos FROM field_rows),
    hits AS (SELECT q.*, id, dl, field, pos FROM tokens_ JOIN terms q ON term = key OR (prefix AND starts_with(term, key))),
    starts AS (SELECT query_id, phrase, id, field, pos - place AS start, count(DISTINCT place) AS found, any_value(tokens) AS tokens, any_value(dl) AS dl, any_value(phrases) AS phrases, any_value(every_) AS every_ FROM hits GROUP BY 1, 2, 3, 4, 5),
    freq AS (SELECT query_id, phrase, id, count(*) AS f, any_value(dl) AS dl, any_value(phrases) AS phrases, any_value(every_) AS every_ FROM starts WHERE found = tokens GROUP BY 1, 2, 3),
    spread AS (SELECT query_id, phrase, count(*) AS d FROM freq GROUP BY 1, 2),
    {name} AS (SELECT query_id, id, sum(w) AS score FROM (
        SELECT query_id, id, phrases, every_, (CASE WHEN ln((n - d + 0.5) / (d + 0.5)) > 0 THEN ln((n - d + 0.5) / (d + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w
        FROM freq JOIN spread USING (query_id, phrase) CROSS JOIN stats) GROUP BY query_id, id HAVING NOT any_value(every_) OR count(*) = any_value(phrases))"""


def _top_sql(source: str, k: int, by: str = "score") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({by}, 9) DESC, id)::INT AS rank FROM {source} QUALIFY rank <= {k})"


_KNN = f"""asked AS (SELECT 'q' || (vec_id + 1) AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < {len(TEXTS)}),
    near AS (SELECT query_id, vec_id::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, asked)"""

_KNN_ALL = """asked AS (SELECT 'q' || vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
    near AS (SELECT query_id, vec_id::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, asked)"""

_MATCHES = {q: prepared_match(t) for q, t in TEXTS.items()}  # for the queries; the SQL has its own
_PHRASES = {"p1": prepared_match("de la", False), "p2": prepared_match("of-the", False), "p3": prepared_match("foo_the and")}

# --- full text ---------------------------------------------------------------------------------


@query(f"WITH {CHUNKS_SQL}, {bm25_sql(_ASKED)} SELECT query_id, id, round(score, 6) AS score, rank FROM {_top_sql('scored', 20)}")
def bm25_top_k(spark, sf_dir):
    return _rounded(fulltext.top_k(fulltext.bm25(corpus.index(spark, sf_dir), _MATCHES), 20), "score")


@query(f"WITH {CHUNKS_SQL}, {bm25_sql(_ASKED_PHRASES)} SELECT query_id, id, round(score, 6) AS score FROM scored")
def bm25_phrases(spark, sf_dir):
    """From the texts themselves, without an index."""
    return _rounded(fulltext.bm25(corpus.chunks(spark, sf_dir), _PHRASES), "score")


@query(rf"""WITH {CHUNKS_SQL}, {bm25_sql(_ASKED)}, best AS {_top_sql('scored', 40)},
    kept AS (SELECT query_id, id, score, rank FROM best JOIN chunks USING (id) WHERE regexp_matches(path, '^(?:.*/)?Sources/[^/]*/[^/]*\.swift$'))
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM kept) WHERE n <= 20""")
def bm25_filtered_search(spark, sf_dir):
    return _rounded(search.bm25_search(corpus.index(spark, sf_dir), TEXTS, SearchOptions(limit=20, path_filter="**/Sources/*/*.swift", extensions=("swift",))), "score")


_SNIPPETS = r"""snip AS (SELECT conv_id || '-' || turn AS id, '/docs/c' || conv_id || (CASE WHEN turn % 2 = 0 THEN '.md' ELSE '.txt' END) AS path,
    regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(coalesce(role, '')), '[\p{L}\p{N}]+') AS b FROM conversations)"""
_SNIPPET_MATCHES = {q: snippet_match(t) for q, t in SNIPPET_TEXTS.items()}


@query(rf"""WITH {_SNIPPETS}, {bm25_sql(_ASKED_SNIPPETS, 'snip', 'a, b')}, best AS {_top_sql('scored', 20)},
    kept AS (SELECT query_id, id, path, score FROM best JOIN snip USING (id) WHERE regexp_matches(path, '^(?:.*/)?docs/[^/]*\.md$'))
    SELECT query_id, id, path, round(score, 6) AS score, floor(least(score / 25, 1) * 100)::INT AS relevance_percent
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM kept) WHERE n <= 10""")
def docs_search(spark, sf_dir):
    return _rounded(fulltext.search_snippets(corpus.snippets(spark, sf_dir), _SNIPPET_MATCHES, 10, "**/docs/*.md"), "score")


_TERMS = ["the", "codable", "und", "QUE", "thing"]


@query("WITH " + CHUNKS_SQL + ", q(term) AS (VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + ") SELECT term, count(*) FILTER (list_contains(symbols, lower(term)) OR contains(lower(content), lower(term))) AS n FROM q, chunks GROUP BY term")
def term_counts(spark, sf_dir):
    return fulltext.term_counts(corpus.chunks(spark, sf_dir), _TERMS)


@query(rf"WITH {CHUNKS_SQL}, {bm25_sql(_ASKED)} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return _rounded(fulltext.corpus_stats(corpus.chunks(spark, sf_dir), fulltext.CHUNK_FIELDS), "avgdl")


@query(rf"WITH {CHUNKS_SQL}, {bm25_sql(_ASKED)} SELECT term, count(DISTINCT id) AS chunks, count(*) AS places, sum(pos * (field + 1))::BIGINT AS spread, max(dl)::BIGINT AS longest FROM tokens_ GROUP BY term")
def index_postings(spark, sf_dir):
    """What the index that the searches read holds of each term."""
    return fulltext.term_summary(corpus.index(spark, sf_dir))


# --- vectors -----------------------------------------------------------------------------------


@query(f"WITH {_KNN_ALL} SELECT query_id, id, round(score, 6) AS score, rank FROM {_top_sql('near', 10)}")
def knn_cosine(spark, sf_dir):
    return _rounded(vectors.nearest(corpus.vectors(spark, sf_dir), every_20th_vector(spark, sf_dir), 10), "score")


@query(f"WITH {_KNN_ALL} SELECT query_id, id, round(score, 6) AS score, rank FROM {_top_sql('near', 10)} WHERE score >= 0.5")
def knn_threshold(spark, sf_dir):
    return _rounded(vectors.nearest(corpus.vectors(spark, sf_dir), every_20th_vector(spark, sf_dir), 10, 0.5), "score")


@query()
def knn_bucketed(spark, sf_dir):
    return _rounded(vectors.bucketed_nearest(corpus.vectors(spark, sf_dir), every_20th_vector(spark, sf_dir), 10), "score")


@query()
def hash_embeddings(spark, sf_dir):
    """tests/test_retrieval.py compares the digests with a plain version."""
    from quarrylight.session import ship

    ship(spark)
    rows = vectors.embed(corpus.snippets(spark, sf_dir).filter("content <> ''"))
    digest = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))), 256)
    return rows.select("id", F.size("embedding").alias("dimension"), F.round(vectors.dot("embedding", "embedding"), 4).alias("norm"), digest.alias("digest"))


#: Only q5 ("what implements Codable") asks for implementations, of the type named.
_INTENT_SQL = """CASE WHEN query_id = 'q5' THEN
        (CASE WHEN len(list_filter(conformances, lambda c: contains(lower(c), 'codable'))) > 0 THEN 1.5 WHEN len(list_filter(symbols, lambda s: contains(lower(s), 'codable'))) > 0 THEN 1.2 ELSE 1.0 END)
        * (CASE WHEN kind <> 'protocol' AND len(conformances) > 0 THEN 1.2 ELSE 1.0 END) ELSE 1.0 END"""


def semantic_sql(limit: int, name: str = "semantic") -> str:
    return f"""sem_raw AS {_top_sql('near', 2 * limit)},
    sem_boosted AS (SELECT query_id, id, score * coalesce({_INTENT_SQL}, 1.0) AS score FROM sem_raw LEFT JOIN chunks USING (id)),
    {name} AS {_top_sql('sem_boosted', limit)}"""


@query(f"WITH {CHUNKS_SQL}, {_KNN}, {semantic_sql(15)} SELECT query_id, id, round(score, 6) AS score, rank FROM semantic")
def semantic_intent_search(spark, sf_dir):
    return _rounded(vectors.semantic_search(corpus.index(spark, sf_dir).docs, corpus.vectors(spark, sf_dir), query_vectors(spark, sf_dir), {q: intent(t) for q, t in TEXTS.items()}, 15), "score")


@query(f"WITH {CHUNKS_SQL}, {_KNN}, best AS {_top_sql('near', 20)}, kept AS (SELECT query_id, id, score, rank FROM best JOIN chunks USING (id) WHERE path LIKE '%.md') SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM kept) WHERE n <= 10")
def semantic_only_search(spark, sf_dir):
    return _rounded(search.semantic_only(corpus.index(spark, sf_dir).docs, corpus.vectors(spark, sf_dir), query_vectors(spark, sf_dir), SearchOptions(limit=10, extensions=("md",))), "score")


# --- fusion ------------------------------------------------------------------------------------

_TWO = f"{CHUNKS_SQL}, {bm25_sql(_ASKED)}, {_KNN}, lex AS {_top_sql('scored', 30)}, sem AS {_top_sql('near', 30)}"


def _two_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return fulltext.top_k(fulltext.bm25(corpus.index(spark, sf_dir), _MATCHES), 30), vectors.nearest(corpus.vectors(spark, sf_dir), query_vectors(spark, sf_dir), 30)


@query(f"WITH {_TWO}, two AS (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM sem) SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score, count(*) AS lists FROM two GROUP BY 1, 2")
def rrf_fusion(spark, sf_dir):
    return _rounded(fusion.rrf(fusion.stack(list(_two_lists(spark, sf_dir)))).select("query_id", "id", "score", F.size("ranks").cast("long").alias("lists")), "score")


@query(f"""WITH {_TWO}, two AS (SELECT query_id, id, rank, score, 0.3 AS w, 0 AS l FROM lex UNION ALL SELECT query_id, id, rank, score, 0.7, 1 FROM sem),
    m AS (SELECT *, max(score) OVER (PARTITION BY query_id, l) AS best FROM two)
    SELECT query_id, id, round(sum(w * (0.7 / (60 + rank) + 0.3 * score / CASE WHEN best > 0 THEN best ELSE 1 END)), 6) AS score FROM m GROUP BY 1, 2""")
def weighted_fusion(spark, sf_dir):
    return _rounded(fusion.weighted(fusion.stack(list(_two_lists(spark, sf_dir))), [0.3, 0.7]), "score")


@query(f"WITH {_TWO} SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.id, s.id) AS id, round(coalesce(0.3 / (60 + l.rank), 0) + coalesce(0.7 / (60 + s.rank), 0), 6) AS score FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.id = s.id")
def simple_hybrid(spark, sf_dir):
    return _rounded(fusion.simple_hybrid(*_two_lists(spark, sf_dir)), "score")


# --- ranking and engine --------------------------------------------------------------------------


@query(f"""WITH {CHUNKS_SQL}, c AS (SELECT id, path, start_line, unnest(list_distinct(conformances)) AS p FROM chunks WHERE is_type_declaration)
    SELECT 'q5' AS query_id, id, rank, (51.0 - rank)::DOUBLE AS score FROM (SELECT id, row_number() OVER (ORDER BY path, start_line, id)::INT AS rank FROM c WHERE lower(p) = 'codable') WHERE rank <= 50""")
def conformance_lookup(spark, sf_dir):
    return ranking.conforming_types(corpus.index(spark, sf_dir).docs, {"q5": "Codable"}, 50)


@query(f"WITH {CHUNKS_SQL} SELECT DISTINCT id AS chunk_id, unnest(conformances) AS protocol_name FROM chunks")
def conformance_index(spark, sf_dir):
    return ranking.conformance_index(corpus.chunks(spark, sf_dir))


#: Fixed values.
_STANDARD = ["Comparable", "Equatable", "Hashable", "Codable", "Sendable", "CustomStringConvertible", "CustomDebugStringConvertible", "Encodable", "Decodable", "Identifiable", "CaseIterable"]


def boost_sql(terms: list[str], camel: list[str], question: bool) -> str:
    """The ranking's boosts for one query, with counts from cnt(term, n)."""
    rare = lambda t: f"(SELECT n FROM cnt WHERE term = '{t}') < 10"
    sym = " ".join(f"WHEN list_contains(symbols, '{t.lower()}') THEN {rare(t)}" for t in terms)
    con = " ".join(f"WHEN contains(content, '{t}') THEN {rare(t)}" for t in camel)
    symbol = f"coalesce(CASE {sym} ELSE false END, false)" if sym else "false"
    content = f"coalesce(CASE {con} ELSE false END, false)" if con else "false"
    path = "(CASE WHEN contains(path, '/Sources/') THEN 1.25 WHEN contains(path, '/Tests/') THEN 0.8 WHEN contains(path, '/benchmarks/') OR contains(path, '/archive/') THEN 0.5 WHEN contains(path, '/docs/') OR contains(path, '/openspec/') THEN 0.9 ELSE 1.0 END)"
    out = f"(CASE WHEN {symbol} THEN 2.5 WHEN {content} THEN 2.0 ELSE 1.0 END) * {path} * (CASE WHEN starts_with(signature, 'public ') THEN 1.1 ELSE 1.0 END)"
    if question:
        out += f" * (CASE WHEN kind = 'extension' AND list_has_any(conformances, {_LIST(_STANDARD)}) THEN 0.5 ELSE 1.0 END)"
    if camel:
        held = " OR ".join(f"list_contains(symbols, '{t}') OR contains(content, '{t}') OR list_contains(refs, '{t}')" for t in camel)
        out += f" * (CASE WHEN {held} THEN 1.0 ELSE 0.3 END)"
    return out


def _counts_sql() -> str:
    terms = sorted({t for found, *_ in _BOOSTED.values() for t in found})
    return "cnt AS (SELECT term, count(*) FILTER (list_contains(symbols, lower(term)) OR contains(lower(content), lower(term))) AS n FROM (VALUES " + ", ".join(f"('{t}')" for t in terms) + ") v(term), chunks GROUP BY term)"


_BOOST_CASES = " ".join(f"WHEN query_id = '{q}' THEN {boost_sql(*spec)}" for q, spec in _BOOSTED.items())


@query(f"WITH {CHUNKS_SQL}, {_counts_sql()}, q(query_id) AS (VALUES {', '.join(f'({q!r})' for q in TEXTS)}) SELECT query_id, id, round(CASE {_BOOST_CASES} END, 6) AS boost FROM q, chunks")
def rank_boosts(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir)
    asked = ranking.query_table(rows, TEXTS)
    return rows.crossJoin(F.broadcast(asked)).select("query_id", "id", F.round(ranking.rank_boost(), 6).alias("boost"))  # each chunk for each of the five queries, which are what the report is of


def hybrid_sql(limit: int, tail: str, w: float = 0.7, asked: dict = _ASKED) -> str:
    fetch = 5 * limit
    return f"""WITH {CHUNKS_SQL}, {bm25_sql(asked)}, {_KNN}, lex AS {_top_sql('scored', fetch)}, {semantic_sql(fetch, 'sem')}, {_counts_sql()},
    conf_all AS (SELECT DISTINCT 'q5' AS query_id, id, path, start_line FROM (SELECT id, path, start_line, unnest(conformances) AS p FROM chunks WHERE is_type_declaration) WHERE lower(p) = 'codable'),
    conf AS (SELECT query_id, id, {fetch + 1}.0 - rank AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, start_line, id) AS rank FROM conf_all) WHERE rank <= {fetch}),
    lists AS (SELECT query_id, id, rank, score, {1 - w:.2f} AS w, 0 AS l FROM lex UNION ALL SELECT query_id, id, rank, score, {w}, 1 FROM sem UNION ALL SELECT query_id, id, rank, score, 3.0, 2 FROM conf),
    best AS (SELECT *, max(score) OVER (PARTITION BY query_id, l) AS best FROM lists),
    fused AS (SELECT query_id, id, sum(w * (0.7 / (60 + rank) + 0.3 * score / CASE WHEN best > 0 THEN best ELSE 1 END)) AS fused FROM best GROUP BY 1, 2),
    rows AS (SELECT f.*, c.* EXCLUDE (id), lex.score AS bm25_score, lex.rank AS bm25_rank, sem.score AS semantic_score, sem.rank AS semantic_rank, row_number() OVER (PARTITION BY f.query_id ORDER BY round(fused, 9) DESC, f.id) AS n
        FROM fused f JOIN chunks c ON c.id = f.id LEFT JOIN lex ON lex.query_id = f.query_id AND lex.id = f.id LEFT JOIN sem ON sem.query_id = f.query_id AND sem.id = f.id),
    boosted AS (SELECT *, fused * (CASE {_BOOST_CASES} END) AS score FROM rows WHERE n <= {2 * limit}),
    final AS (SELECT query_id, id AS chunk_id, path, kind, score, bm25_rank, semantic_rank, semantic_score, refs, symbols FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {limit})
    {tail}"""


def _hybrid(spark, sf_dir, **options) -> DataFrame:
    return search.hybrid_search(corpus.index(spark, sf_dir), corpus.vectors(spark, sf_dir), TEXTS, query_vectors(spark, sf_dir), SearchOptions(limit=10, **options))


@query(hybrid_sql(10, "SELECT query_id, chunk_id, path, kind, round(score, 6) AS score, coalesce(bm25_rank, 0)::INT AS bm25_rank, coalesce(semantic_rank, 0)::INT AS semantic_rank, CASE WHEN semantic_score IS NOT NULL THEN floor(semantic_score * 100) ELSE floor(least(score / 0.0164, 1) * 100) END::INT AS relevance_percent FROM final"))
def hybrid_search(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir).select("query_id", "chunk_id", "path", "kind", "score", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("semantic_rank", F.lit(0)).alias("semantic_rank"), "relevance_percent"), "score")


@query()
def multi_hop_search(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir, multi_hop=2).select("query_id", "chunk_id", "score", "is_multi_hop", "hop_depth"), "score")


@query(hybrid_sql(10, "SELECT query_id, kind, count(*) AS n FROM final GROUP BY 1, 2"))
def research_kinds(spark, sf_dir):
    return search.research(_hybrid(spark, sf_dir), corpus.index(spark, sf_dir).docs)["kinds"]


@query(hybrid_sql(10, "SELECT query_id, topic FROM (SELECT DISTINCT query_id, unnest(refs) AS topic FROM final) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY topic) <= 10"))
def research_topics(spark, sf_dir):
    return search.research(_hybrid(spark, sf_dir), corpus.index(spark, sf_dir).docs)["topics"]


_HITS = "SELECT query_id, chunk_id, round(score, 6) AS score FROM final"


def _hits(df: DataFrame) -> DataFrame:
    return _rounded(df.select("query_id", "chunk_id", "score"), "score")


@query(hybrid_sql(10, _HITS, 0.0))
def bm25_only_strategy(spark, sf_dir):
    return _hits(_hybrid(spark, sf_dir, semantic_weight=strategy("bm25Only")))


@query(hybrid_sql(10, _HITS, 1.0))
def semantic_only_strategy(spark, sf_dir):
    return _hits(_hybrid(spark, sf_dir, semantic_weight=strategy("semanticOnly")))


_EXPANDED = {"q1": "the and with of", "q2": "para que la", "q4": "thing that"}


@query(hybrid_sql(10, _HITS, 0.7, _ASKED | _ASKED_EXPANDED))
def expanded_search(spark, sf_dir):
    rows = search.hybrid_search(corpus.index(spark, sf_dir), corpus.vectors(spark, sf_dir), TEXTS, query_vectors(spark, sf_dir), HYBRID, TEXTS | _EXPANDED)
    return _hits(rows)


@query(hybrid_sql(10, "SELECT query_id, path FROM (SELECT DISTINCT query_id, path FROM final) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY path) <= 10"))
def research_files(spark, sf_dir):
    return search.research(_hybrid(spark, sf_dir), corpus.index(spark, sf_dir).docs)["files"]


@query(hybrid_sql(10, "SELECT query_id, symbol FROM (SELECT DISTINCT query_id, unnest(symbols) AS symbol FROM final) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY symbol) <= 10"))
def research_symbols(spark, sf_dir):
    return search.research(_hybrid(spark, sf_dir), corpus.index(spark, sf_dir).docs)["symbols"]


@query(hybrid_sql(10, """, names AS (SELECT query_id, path, score, unnest(symbols) AS name, 'symbol' AS role FROM final UNION ALL SELECT query_id, path, score, unnest(refs), 'reference' FROM final)
    SELECT query_id, path, name, role FROM names QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, role DESC, name) <= 50""".lstrip()))
def research_references(spark, sf_dir):
    return search.research(_hybrid(spark, sf_dir), corpus.index(spark, sf_dir).docs)["references"].drop("n")


@query(rf"WITH {CHUNKS_SQL} SELECT id, len(t) AS n, len(list_distinct(t)) AS n_distinct, coalesce(t[1], '') AS first FROM chunks")
def tokenized(spark, sf_dir):
    t = C.tokens(F.col("content"))
    return corpus.chunks(spark, sf_dir).select("id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first"))


@query(f"WITH {CHUNKS_SQL} SELECT vec_id::VARCHAR AS id, len(embedding) AS dimension FROM embeddings WHERE vec_id::VARCHAR IN (SELECT id FROM chunks WHERE id::INT % 2 = 0)")
def repaired_vectors(spark, sf_dir):
    even = corpus.chunks(spark, sf_dir).filter(F.col("id").cast("int") % 2 == 0)
    return indexing.repair(even, corpus.vectors(spark, sf_dir)).select("id", F.size("embedding").cast("long").alias("dimension"))


@query(f"WITH {CHUNKS_SQL} SELECT id, path FROM chunks WHERE id IN (SELECT item_id::VARCHAR FROM benchmark)")
def chunks_by_ids(spark, sf_dir):
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return indexing.by_ids(corpus.chunks(spark, sf_dir), asked).select("id", "path")


_OVERLAY = f"""WITH {_KNN}, l AS (SELECT query_id, id, '/p/' || (id::INT % 40) AS path, score, rank FROM {_top_sql('near', 20)}),
    r AS (SELECT query_id, 'r' || id AS id, '/p/' || (id::INT % 60) AS path, score * 0.9 AS score, rank FROM {_top_sql('near', 20)}),
    k AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.query_id = r.query_id AND l.path = r.path)),
    a AS (SELECT *, 0 AS o FROM l UNION ALL SELECT *, 1 FROM k), m AS (SELECT *, max(score) OVER (PARTITION BY query_id, o) AS best FROM a)
    SELECT query_id, id, path, round(score, 6) AS score, o AS origin, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 / (60 + rank) + 0.3 * score / CASE WHEN best > 0 THEN best ELSE 1 END, 9) DESC, id, o)::INT AS place FROM m"""


@query(_OVERLAY)
def overlay_merge(spark, sf_dir):
    best = vectors.nearest(corpus.vectors(spark, sf_dir), query_vectors(spark, sf_dir), 20)
    path = lambda n: F.concat(F.lit("/p/"), (F.col("id").cast("int") % n).cast("string"))
    local = best.withColumn("path", path(40))
    remote = best.withColumn("path", path(60)).withColumns({"id": F.concat(F.lit("r"), "id"), "score": F.col("score") * 0.9})
    return _rounded(fusion.overlay(local, remote), "score")


@query(rf"""WITH {CHUNKS_SQL} SELECT id, path, regexp_matches(path, '^(?:.*/)?Sources/(?:.*/)?doc[^/][^/]\.swift$') AS deep, regexp_matches(path, '^(?:.*/)?[^/]*\.md$') AS base,
    lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'swift' THEN 'swift' WHEN 'md' THEN 'markdown' ELSE 'json' END AS language FROM chunks""")
def path_filters(spark, sf_dir):
    p = F.col("path")
    return corpus.chunks(spark, sf_dir).select("id", "path", C.matches_glob(p, "**/Sources/**/doc??.swift").alias("deep"), C.matches_glob(p, "*.md").alias("base"), C.extension(p).alias("ext"), C.language(p).alias("language"))


# --- index life cycle ----------------------------------------------------------------------------

_FILES = "files AS (SELECT path, content_hash AS hash FROM chunks), stored AS (SELECT path, CASE WHEN id::INT % 5 = 0 THEN 'old' ELSE content_hash END AS hash FROM chunks WHERE id::INT % 7 <> 0)"


@query(f"WITH {CHUNKS_SQL}, {_FILES} SELECT f.path, f.hash FROM files f LEFT JOIN stored s ON s.path = f.path WHERE s.hash IS NULL OR s.hash <> f.hash")
def changed_files(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir)
    number = F.col("id").cast("int")
    stored = rows.filter(number % 7 != 0).select("path", F.when(number % 5 == 0, "old").otherwise(F.col("content_hash")).alias("hash"))
    return indexing.changed_files(rows.select("path", F.col("content_hash").alias("hash")), stored)


def _edited(rows: DataFrame) -> DataFrame:
    """The chunks as they are after every fourth was edited."""
    return rows.withColumn("content_hash", F.when(F.col("id").cast("int") % 4 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))


@query(f"""WITH {CHUNKS_SQL}, r AS (SELECT c.id, c.id::INT % 4 <> 0 AND e.vec_id IS NOT NULL AS reused FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id::BIGINT)
    SELECT count(*) AS chunks, count(*) FILTER (reused) AS reused, count(*) FILTER (NOT reused) AS embedded, round(count(*) FILTER (reused) * 100.0 / count(*), 6) AS reuse_percent FROM r""")
def chunk_reuse(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir).select("id", "path", "content_hash")
    return _rounded(indexing.reuse_counts(indexing.reuse_vectors(_edited(rows), rows, corpus.vectors(spark, sf_dir))), "reuse_percent")


@query(f"WITH {CHUNKS_SQL} SELECT CASE WHEN id::INT % 10 = 0 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM chunks WHERE id::INT % 10 <> 1 GROUP BY 1")
def upsert_and_delete(spark, sf_dir):
    old = corpus.chunks(spark, sf_dir).select("id", "path", F.lit("old").alias("version"))
    new = old.filter(F.col("id").cast("int") % 10 == 0).withColumn("version", F.lit("new"))
    rows = indexing.delete(indexing.upsert(old, new), old.filter(F.col("id").cast("int") % 10 == 1))
    return rows.groupBy("version").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS_SQL} SELECT id, path FROM chunks WHERE id::INT % 3 = 0")
def prune_deleted(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir).select("id", "path")
    return indexing.prune(rows, rows.filter(F.col("id").cast("int") % 3 == 0))


@query(f"WITH {CHUNKS_SQL}, v AS (SELECT (vec_id + 100)::VARCHAR AS id FROM embeddings) SELECT id, 'missing_vector' AS problem FROM chunks WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'orphaned_vector' FROM v WHERE id NOT IN (SELECT id FROM chunks)")
def consistency(spark, sf_dir):
    moved = corpus.vectors(spark, sf_dir).withColumn("id", (F.col("id").cast("int") + 100).cast("string"))
    return indexing.consistency(corpus.chunks(spark, sf_dir), moved)


@query(f"WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT path) FROM chunks) AS files, count(*) AS vectors, max(len(embedding))::INT AS dimension, (SELECT count(*) FROM conversations) AS snippets, (SELECT count(*) FROM chunks) = count(*) AS consistent FROM embeddings")
def index_statistics(spark, sf_dir):
    return indexing.statistics(corpus.chunks(spark, sf_dir), corpus.vectors(spark, sf_dir), corpus.snippets(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL} SELECT content_hash, max(id) AS id FROM chunks WHERE content_hash < '2' GROUP BY 1")
def by_content_hash(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir).select("id", "content_hash")
    return indexing.by_content_hash(rows, rows.filter("content_hash < '2'")).select("content_hash", "id")


@query("WITH r AS (SELECT p_name || p_partkey AS name, p_size AS size, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_brand END AS checksum FROM part), l AS (SELECT p_name || p_partkey AS name, p_brand AS checksum FROM part WHERE p_partkey % 11 <> 0) SELECT r.name, r.checksum FROM r LEFT JOIN l ON l.name = r.name WHERE l.checksum IS NULL OR l.checksum <> r.checksum")
def delta_sync(spark, sf_dir):
    part = corpus.table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    remote = part.select("name", F.when(F.col("p_partkey") % 9 == 0, "x").otherwise(F.col("p_brand")).alias("checksum"))
    return indexing.delta(part.filter("p_partkey % 11 <> 0").select("name", F.col("p_brand").alias("checksum")), remote)


@query("SELECT CASE WHEN a.v > b.v THEN 'remote_newer' WHEN a.v = b.v THEN 'equal' ELSE 'local_newer' END AS status FROM (SELECT max(p_partkey) AS v FROM part) a, (SELECT max(p_size) AS v FROM part) b")
def remote_status(spark, sf_dir):
    part = corpus.table(spark, sf_dir, "part")
    return indexing.remote_status(part.agg(F.max("p_size").alias("version")), part.agg(F.max("p_partkey").alias("version")))


# --- changes ---------------------------------------------------------------------------------------

_EVENTS = "ev AS (SELECT user_id::VARCHAR AS path, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return corpus.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts", "event_id", kind.alias("event"))


@query(f"WITH {_EVENTS} SELECT path, event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ev QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(spark, sf_dir):
    return watch.latest(_events(spark, sf_dir), order=("ts", "event_id")).select("path", "event", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"""WITH {_EVENTS}, t AS (SELECT DISTINCT ts FROM ev), g AS (SELECT ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) >= 60000000 THEN 1 ELSE 0 END AS g FROM t),
    s AS (SELECT ts, sum(g) OVER (ORDER BY ts) AS session FROM g)
    SELECT session::BIGINT AS session, path, event FROM ev JOIN s USING (ts) QUALIFY row_number() OVER (PARTITION BY session, path ORDER BY ts DESC, event_id DESC) = 1""")
def debounced_events(spark, sf_dir):
    return watch.debounce_batch(_events(spark, sf_dir), 60_000, order=("ts", "event_id")).select(F.col("session").cast("long").alias("session"), "path", "event")


@query(f"WITH {_EVENTS}, c AS (SELECT path, event FROM ev QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1) SELECT count(*) FILTER (event = 'created') AS created, count(*) FILTER (event = 'modified') AS modified, count(*) FILTER (event = 'deleted') AS deleted FROM c")
def change_counts(spark, sf_dir):
    return watch.change_counts(watch.latest(_events(spark, sf_dir), order=("ts", "event_id")))


@query(f"WITH {_EVENTS}, c AS (SELECT path, event FROM ev QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1), old AS (SELECT c_custkey::VARCHAR AS path, 'old' AS version FROM customer) SELECT path, version FROM old WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, 'new' FROM c WHERE event <> 'deleted'")
def apply_changes(spark, sf_dir):
    old = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("old").alias("version"))
    changes = watch.latest(_events(spark, sf_dir), order=("ts", "event_id"))
    return watch.apply_changes(old, changes, changes.select("path", F.lit("new").alias("version")))


# --- texts -----------------------------------------------------------------------------------------


@query("SELECT item_id, CASE WHEN regexp_matches(text, '(?i)how|usage|example') THEN 'howTo' WHEN regexp_matches(text, '(?i)why|reason') THEN 'deeperUnderstanding' WHEN regexp_matches(text, '(?i)test|spec') THEN 'testing' WHEN regexp_matches(text, '(?i)similar|related|like') THEN 'relatedCode' WHEN regexp_matches(text, '(?i)config|setup|init') THEN 'configuration' ELSE 'exploration' END AS category FROM benchmark")
def follow_up_categories(spark, sf_dir):
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", C.follow_up(F.col("text")).alias("category"))


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^(This code |This function |This method |This class |This struct |This enum |This protocol |Description: |Summary: )', '') AS b FROM conversations),
    c AS (SELECT conv_id, turn, upper(left(b, 1)) || substr(b, 2) AS b FROM a), e AS (SELECT conv_id, turn, CASE WHEN regexp_matches(b, '[.!?]$') THEN b ELSE b || '.' END AS b FROM c)
    SELECT conv_id, turn, CASE WHEN length(b) <= 250 THEN b WHEN contains(left(b, 250), '.') THEN regexp_extract(left(b, 250), '(?s)^(.*\.)', 1) WHEN contains(left(b, 250), ' ') THEN regexp_extract(left(b, 250), '(?s)^(.*) ', 1) || '...' ELSE b END AS description FROM e""")
def clean_descriptions(spark, sf_dir):
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.clean_description(F.coalesce("text", F.lit(""))).alias("description"))


@query("SELECT doc_id, floor(length(coalesce(text, '')) / 4)::INT AS token_count, CASE WHEN length(coalesce(text, '')) > 400 THEN left(text, 400) || '...' ELSE coalesce(text, '') END AS short, round(1 + (least(doc_id % 14 + 1, 10) - 1) / 9, 6) AS recall, left(sha256(source || ':' || doc_id), 32) AS id FROM documents")
def scalar_functions(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", C.token_estimate(t).alias("token_count"), C.truncate_tokens(t, 100).alias("short"), F.round(C.recall_boost(F.col("doc_id") % 14 + 1), 6).alias("recall"), C.identifier(F.col("source"), F.col("doc_id")).alias("id"))


_MD = "f AS (SELECT doc_id::VARCHAR AS path, '# ' || source || chr(10) || '## ' || lang || chr(10) || coalesce(text, '') || chr(10) || '## end' || chr(10) || 'done' AS content FROM documents)"


@query(f"""WITH {_MD}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS place FROM f),
    n AS (SELECT *, sum(starts_with(line, '#')::INT) OVER (PARTITION BY path ORDER BY place) AS section FROM l),
    s AS (SELECT path, section, arg_min(line, place) AS head, min(place) + 1 AS start_line, max(place) + 1 AS end_line, string_agg(line, chr(10) ORDER BY place) AS content FROM n GROUP BY 1, 2),
    t AS (SELECT *, trim(regexp_replace(head, '^#+', '')) AS title, length(regexp_extract(head, '^(#+)', 1)) AS level FROM s)
    SELECT path, section::BIGINT AS section, title, level::INT AS level, CASE WHEN level = 1 THEN title ELSE first(title) OVER (PARTITION BY path ORDER BY section) || ' > ' || title END AS breadcrumb, sha256(content) AS content, start_line::INT AS start_line, end_line::INT AS end_line FROM t""")
def markdown_sections(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "documents")
    files = rows.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## end\ndone")).alias("content"))
    return chunkers.markdown_sections(files).withColumn("content", F.sha2("content", 256))


@query(f"""WITH {_MD}, n AS (SELECT split_part(path, '.', 1)::BIGINT AS id, 1 + len(list_filter(string_split(content, chr(10))[2:], lambda l: starts_with(l, '#'))) AS sections FROM f),
    c AS (SELECT * FROM n WHERE id % 4 = 0 AND id % 5 <> 0)
    SELECT count(*) AS files, (SELECT count(*) FROM n WHERE id % 5 = 0) AS removed, (sum(sections) + count(*))::BIGINT AS chunks, sum(sections)::BIGINT AS reused, count(*) AS embedded, 0::BIGINT AS errors,
        ((SELECT sum(sections) FROM n WHERE id % 5 <> 0) + count(*))::BIGINT AS stored_chunks, ((SELECT sum(sections) FROM n WHERE id % 5 <> 0) + count(*))::BIGINT AS stored_vectors FROM c""")
def index_life_cycle(spark, sf_dir):
    """Index all documents as markdown files, then the state after every fifth was removed and every fourth of the others got one section more."""
    from quarrylight.session import shared_dir, until_exit
    from quarrylight.sources.store import Store

    n = F.col("doc_id")
    head = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## end\ndone"))
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", F.concat(n.cast("string"), F.lit(".md")).alias("path"), head.alias("content"))
    hashed = lambda d: d.select("path", "content", F.sha2("content", 256).alias("hash"))
    edited = rows.filter(n % 5 != 0).withColumn("content", F.when(n % 4 == 0, F.concat("content", F.lit("\n## more\nx"))).otherwise(F.col("content")))
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    until_exit(spark, root)
    store = Store(spark, root)
    store.index_files(hashed(rows), dimension=16)
    counts = store.index_files(hashed(edited), dimension=16)
    chunks, vectors_ = store.read("chunks"), store.read("vectors")
    return counts.crossJoin(chunks.agg(F.count("*").alias("stored_chunks"))).crossJoin(vectors_.join(chunks.select("id"), "id", "left_semi").agg(F.count("*").alias("stored_vectors")))  # one row each


@query(r"""SELECT event_id::VARCHAR || '.json' AS path, array_to_string(regexp_extract_all(props, '(?m)^\s*"(\w+)"\s*:', 1)[1:20], ',') AS symbols FROM (SELECT event_id, replace(props, '{', '{' || chr(10)) AS props FROM events)""")
def json_keys(spark, sf_dir):
    files = corpus.table(spark, sf_dir, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.replace("props", F.lit("{"), F.lit("{\n")).alias("content"))
    return chunkers.key_documents(files).select("path", F.array_join("symbols", ",").alias("symbols"))


@query()
def plain_text_chunks(spark, sf_dir):
    files = corpus.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return chunkers.parse_files(files).select("path", "start_line", "end_line", "kind", F.length("content").alias("n_chars"), "error")
