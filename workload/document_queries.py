"""Queries over summary documents, retrieval, evaluation, metrics, cost and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bomatlas.functions import documents as doc
from bomatlas.functions.numbers import rate_pct, round_half_up
from bomatlas.operators import cost, evaluation, ingest_stats, lexical_index, metrics, results, retrieval, vector_index
from bomatlas.operators.ranking import percentiles
from bomatlas.plans.index import open_index
from bomatlas.session import run_path
from bomatlas.sources import documents as store
from bomatlas.sources import sbom, summary_store, tables
from bomatlas.streaming import metrics as stream_metrics
from bomatlas.streaming import snapshots as stream_snapshots
from workload import fixture as fx
from workload.fixture import for_duckdb, oracle
from workload.registry import query

_DOCS = "WITH docs AS (" + for_duckdb(fx.DOCUMENTS_SQL) + ") "
_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# ---- stored documents ---------------------------------------------------------------

_REQUESTS = """SELECT page_id AS position, concat('src', CAST(page_id % 20 AS STRING)) AS org,
  concat('doc', CAST(page_id AS STRING)) AS repo FROM {pages}"""


@query(
    "src_documents_lookup",
    _DOCS + "SELECT r.position, r.org, r.repo, d.text FROM (" + for_duckdb(_REQUESTS) + ") r LEFT JOIN docs d USING (org, repo)",
)
def _(spark, d):
    return store.lookup(fx.derive(spark, d, _REQUESTS), fx.documents(spark, d))


# Labelled documents come in again, those of low quality with a new push time, and the
# benchmark texts are new.
_INCOMING = """SELECT org, repo, text, url, CASE WHEN quality = 0 THEN '2025-03-01' ELSE pushed_at END AS pushed_at,
    '2025-03-02' AS processed_at, lang, n_chars FROM {docs} JOIN {labels} ON labels.doc_id = docs.doc_id
  UNION ALL SELECT 'bench' AS org, concat('item', CAST(item_id AS STRING)) AS repo, text, NULL AS url,
    '2025-03-01' AS pushed_at, '2025-03-02' AS processed_at, 'en' AS lang, CAST(length(text) AS BIGINT) AS n_chars FROM {benchmark}"""


def _incoming(spark, d):
    text = _INCOMING.replace("{docs}", "{docs} docs").replace("{labels}", "{labels} labels")
    return fx.derive(spark, d, text, docs=fx.documents(spark, d))


_INCOMING_CTE = "incoming AS (" + _INCOMING.replace("{docs}", "docs").replace("{labels}", "labels").replace("{benchmark}", "benchmark") + ")"
_PLAN = (
    _DOCS + ", " + _INCOMING_CTE + ", plan AS (SELECT coalesce(o.org, n.org) AS org, coalesce(o.repo, n.repo) AS repo, "
    "CASE WHEN n.org IS NULL THEN 'kept' WHEN o.org IS NULL THEN 'created' WHEN o.pushed_at = n.pushed_at THEN 'skipped' "
    "ELSE 'updated' END AS action, o.text AS old_text, n.text AS new_text, o.pushed_at AS old_pushed, n.pushed_at AS new_pushed "
    "FROM docs o FULL JOIN incoming n ON o.org = n.org AND o.repo = n.repo) "
)


@query(
    "upsert_plan",
    _PLAN + "SELECT action, count(*) AS n FROM plan GROUP BY 1",
)
def _(spark, d):
    plan = store.upsert_plan(fx.documents(spark, d).drop("doc_id"), _incoming(spark, d))
    return plan.groupBy("action").agg(F.count("*").alias("n"))


@query(
    "sink_summary_upsert",
    _PLAN + "SELECT org, repo, CASE WHEN action IN ('created', 'updated') THEN new_text ELSE old_text END AS text, "
    "CASE WHEN action IN ('created', 'updated') THEN new_pushed ELSE old_pushed END AS pushed_at FROM plan",
)
def _(spark, d):
    """Two merges: the stored documents into an empty store, then what comes in."""
    path = run_path(spark, "summaries")
    first = fx.documents(spark, d).drop("doc_id")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)
    summary_store.create(spark, path, columns, buckets=16)
    for documents in (first, _incoming(spark, d)):
        summary_store.merge(spark, path, documents)
    return summary_store.read(spark, path).select("org", "repo", "text", "pushed_at")


def _state(spark, d):
    return fx.documents(spark, d).select(
        "org", "repo", F.nullif("pushed_at", F.lit("")).alias("pushed_at"),
        F.nullif("processed_at", F.lit("")).alias("processed_at"), F.lit("complete").alias("status"),
    )


_CLASSIFIED = (
    _DOCS + ", " + _INCOMING_CTE + ", classified AS (SELECT i.org, i.repo, CASE WHEN s.org IS NULL THEN 'cache-miss' "
    "WHEN s.pushed_at = i.pushed_at THEN 'cache-hit' ELSE 'stale-cache' END AS reason FROM incoming i LEFT JOIN "
    "(SELECT * FROM docs WHERE pushed_at <> '' AND processed_at <> '') s ON s.org = i.org AND s.repo = i.repo) "
)


@query("incremental_classify", _CLASSIFIED + "SELECT org, repo, reason, reason <> 'cache-hit' AS needs_processing FROM classified")
def _(spark, d):
    return store.classify(_incoming(spark, d), _state(spark, d)).select("org", "repo", "reason", "needs_processing")


@query(
    "incremental_stats",
    _CLASSIFIED + "SELECT count(*) AS total_checks, count(*) FILTER (reason = 'cache-hit') AS hits, "
    "count(*) FILTER (reason <> 'cache-hit') AS misses, round(count(*) FILTER (reason = 'cache-hit') / count(*) * 100.0, 6) AS hit_rate "
    "FROM classified",
)
def _(spark, d):
    stats = store.classify_stats(store.classify(_incoming(spark, d), _state(spark, d)))
    return stats.withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "sink_jsonl_struct_docs",
    _DOCS + "SELECT concat(org, '/', repo, '/', sha1(concat(org, '/', repo, '/', coalesce(nullif(pushed_at, ''), processed_at)))) AS id, "
    "text AS content, org, repo, coalesce(url, concat('https://github.com/', org, '/', repo)) AS url, pushed_at AS \"pushedAt\", "
    "CAST(length(text) AS BIGINT) AS size FROM docs",
)
def _(spark, d):
    path = run_path(spark, "struct-documents")
    documents = fx.documents(spark, d)
    store.write_struct_documents(documents, path)
    back = spark.read.schema(store.as_struct_documents(documents).schema).json(path)
    return back.select("id", "content", *[f"structData.{c}" for c in ("org", "repo", "url", "pushedAt", "size")])


@query(
    "doc_id_sha1",
    _DOCS + "SELECT doc_id, sha1(concat(org, '/', repo, '/', coalesce(nullif(pushed_at, ''), processed_at))) AS id FROM docs",
)
def _(spark, d):
    return fx.documents(spark, d).select(
        "doc_id", doc.document_id(F.col("org"), F.col("repo"), F.col("pushed_at"), F.col("processed_at")).alias("id")
    )


@query(
    "last_updated",
    _DOCS + "SELECT doc_id, coalesce(nullif(pushed_at, ''), nullif(processed_at, ''), '2000-06-01') AS last_updated FROM docs",
)
def _(spark, d):
    value = doc.last_updated(F.col("pushed_at"), F.col("processed_at"), F.lit(fx.AS_OF))
    return fx.documents(spark, d).select("doc_id", value.alias("last_updated"))


_LINKS = """SELECT concat('page', CAST(page_id AS STRING)) AS id, concat(url, CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '/abc123.txt' ELSE '' END) AS link FROM {pages}
  UNION ALL SELECT concat('doc', CAST(doc_id AS STRING)) AS id, concat('gs://summaries/', source, '/doc', CAST(doc_id AS STRING),
    CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '/0fe3.txt' ELSE '.html' END) AS link FROM {documents}"""


@query(
    "doc_path_parse",
    "SELECT id, coalesce(nullif(regexp_extract(link, '/([^/]+)/([^/]+?)(?:/[a-f0-9]+)?[.](?:md|txt)$', 1), ''), 'unknown') AS org, "
    "coalesce(nullif(regexp_extract(link, '/([^/]+)/([^/]+?)(?:/[a-f0-9]+)?[.](?:md|txt)$', 2), ''), 'unknown') AS repo FROM ("
    + for_duckdb(_LINKS) + ") l",
)
def _(spark, d):
    return fx.derive(spark, d, _LINKS).select("id", doc.document_path(F.col("link")).alias("p")).select("id", "p.*")


_LEGACY = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('gitingest/', source, '/doc%20', CAST(doc_id AS STRING), '/summary.txt')
    WHEN 1 THEN concat(source, '/doc', CAST(doc_id AS STRING), '/summary.txt') WHEN 2 THEN concat('gitingest//doc', CAST(doc_id AS STRING), '/summary.txt')
    WHEN 3 THEN concat('gitingest/', source, '%/doc/summary.txt') WHEN 4 THEN '' WHEN 5 THEN concat('gitingest/', source, '/a/b/summary.txt')
    ELSE concat('gitingest/', source, '/doc', CAST(doc_id AS STRING), '/summary.txt') END AS path, text AS content, doc_id % 10 / 10.0 AS score FROM {documents}"""
_LEGACY_PARSED = (
    "SELECT doc_id, path, CASE WHEN path = '' THEN 'path must be a non-empty string' "
    "WHEN NOT regexp_full_match(path, 'gitingest/[^/]*/[^/]*/summary[.]txt') THEN 'Invalid path format' "
    "WHEN split_part(path, '/', 2) = '' OR split_part(path, '/', 3) = '' THEN 'Invalid path: org or repo is empty' "
    "WHEN contains(path, '%/') THEN 'Failed to decode path' END AS error, content, score FROM (" + for_duckdb(_LEGACY) + ") p"
)


@query(
    "doc_path_parse_legacy",
    "SELECT doc_id, CASE WHEN error IS NULL THEN url_decode(split_part(path, '/', 2)) ELSE '' END AS org, "
    "CASE WHEN error IS NULL THEN url_decode(split_part(path, '/', 3)) ELSE '' END AS repo, error IS NULL AS valid, error FROM ("
    + _LEGACY_PARSED + ") x",
)
def _(spark, d):
    return fx.derive(spark, d, _LEGACY).select("doc_id", doc.legacy_document_path(F.col("path")).alias("p")).select("doc_id", "p.*")


@query(
    "enrich_hits",
    _DOCS + ", parsed AS (" + _LEGACY_PARSED + "), named AS (SELECT *, CASE WHEN error IS NULL THEN url_decode(split_part(path, '/', 2)) END AS o, "
    "CASE WHEN error IS NULL THEN url_decode(split_part(path, '/', 3)) END AS r FROM parsed) "
    "SELECT n.doc_id, n.content, coalesce(n.o, 'unknown') AS org, coalesce(n.r, 'unknown') AS repo, "
    "concat(coalesce(n.o, 'unknown'), '/', coalesce(n.r, 'unknown')) AS full_name, "
    "CASE WHEN n.o IS NULL THEN '' ELSE concat('https://github.com/', url_encode(n.o), '/', url_encode(n.r)) END AS github_link, "
    "CASE WHEN n.o IS NULL THEN '' ELSE concat('https://github.dev/', url_encode(n.o), '/', url_encode(n.r)) END AS codespaces_link, "
    "CASE WHEN n.o IS NULL THEN '' ELSE concat('https://gitpod.io/#https://github.com/', url_encode(n.o), '/', url_encode(n.r)) END AS gitpod_link, "
    "d.pushed_at FROM named n LEFT JOIN docs d ON d.org = n.o AND d.repo = n.r",
)
def _(spark, d):
    enriched = results.enrich_hits(fx.derive(spark, d, _LEGACY), fx.documents(spark, d))
    return enriched.select(
        "doc_id", "content", "org", "repo", "full_name", "github_link", "codespaces_link", "gitpod_link", "pushed_at"
    )


@query(
    "url_encode_links",
    "SELECT p_partkey, concat('https://github.com/', url_encode(p_brand), '/', url_encode(p_name)) AS github, "
    "concat('https://github.dev/', url_encode(p_brand), '/', url_encode(p_name)) AS dev, "
    "concat('https://gitpod.io/#https://github.com/', url_encode(p_brand), '/', url_encode(p_name)) AS gitpod FROM part",
)
def _(spark, d):
    pair = F.col("p_brand"), F.col("p_name")
    return fx.table(spark, d, "part").select(
        "p_partkey", doc.github_url(*pair).alias("github"), doc.dev_url(*pair).alias("dev"), doc.gitpod_url(*pair).alias("gitpod")
    )


# ---- excerpts -----------------------------------------------------------------------


@query(
    "snippet_truncate",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents",
)
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", doc.snippet(F.col("text")).alias("snippet"))


# Summaries with the sections the extractors look for, around the whole text.
_SUMMARY = r"""SELECT doc_id, source AS org, concat('doc', CAST(doc_id AS STRING)) AS repo,
  concat('# Repository', chr(10), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('Contributors: ', CAST(n_chars AS STRING), chr(10)) END,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Commits (last month): ', CAST(doc_id % 50 AS STRING), chr(10)) END,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Open Issues: ', CAST(doc_id % 7 AS STRING), chr(10), 'Last Commit: 2025-01-', CAST(10 + doc_id % 20 AS STRING), chr(10)) END,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('## README of it', chr(10), chr(10), text, chr(10), '## Usage', chr(10)) END,
    '```json package.json', chr(10), '{"dependencies": {"', source, '": "^1.', CAST(doc_id AS STRING), '", "left-pad": "1.0"}, "devDependencies": {"vitest": "',
    CAST(doc_id % 9 AS STRING), '.0"}}', chr(10), '```', chr(10),
    '```requirements.txt', chr(10), 'flask', chr(10), lang, '==1.', CAST(doc_id % 9 AS STRING), chr(10), '```', chr(10),
    '```go.mod', chr(10), 'module example.org/m', chr(10), 'go 1.21', chr(10), 'require (', chr(10), '  example.org/', source, ' v1.2.', CAST(doc_id % 9 AS STRING), chr(10), ')', chr(10), '```') AS text
FROM {documents}"""


def _summaries(spark, d):
    return fx.derive(spark, d, _SUMMARY)


@query(
    "readme_excerpt",
    "WITH cut AS (SELECT doc_id, trim(regexp_split_to_array(ltrim(text, chr(10)) || chr(10) || '## Usage', '\\n#{1,3}\\s+|\\n---')[1], "
    + _STRIP + ") AS body FROM documents), para AS (SELECT doc_id, trim(split_part(body, chr(10) || chr(10), 1), " + _STRIP + ") AS p FROM cut) "
    "SELECT d.doc_id, CASE WHEN d.doc_id % 6 <> 0 THEN CASE WHEN length(p) > 500 THEN left(p, 500) || '...' ELSE p END END AS excerpt "
    "FROM documents d JOIN para USING (doc_id)",
)
def _(spark, d):
    return _summaries(spark, d).select("doc_id", doc.readme_excerpt(F.col("text")).alias("excerpt"))


@query(
    "repo_stats_extract",
    "SELECT doc_id, CASE WHEN known THEN CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END END AS contributors, "
    "CASE WHEN known THEN CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END END AS commits_last_month, "
    "CASE WHEN known THEN CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 7 END END AS open_issues, "
    "CASE WHEN doc_id % 5 <> 0 THEN '2025-01-' || (10 + doc_id % 20) END AS last_commit "
    "FROM (SELECT *, NOT (doc_id % 60 = 0) AS known FROM documents) d",
)
def _(spark, d):
    return _summaries(spark, d).select("doc_id", doc.repository_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(
    "deps_from_text",
    "SELECT doc_id, name, version, type FROM (SELECT doc_id, unnest([{'name': source, 'version': '^1.' || doc_id, 'type': 'runtime'}, "
    "{'name': 'left-pad', 'version': '1.0', 'type': 'runtime'}, {'name': 'vitest', 'version': (doc_id % 9) || '.0', 'type': 'dev'}, "
    "{'name': 'flask', 'version': '*', 'type': 'runtime'}, {'name': lang, 'version': '==1.' || (doc_id % 9), 'type': 'runtime'}, "
    "{'name': 'example.org/' || source, 'version': '1.2.' || (doc_id % 9), 'type': 'runtime'}], recursive := true) FROM documents) d",
)
def _(spark, d):
    found = doc.declared_dependencies(F.col("text"))
    return _summaries(spark, d).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


@query(
    "truncate_512k",
    "SELECT doc_id, CAST(length(cut) AS BIGINT) AS size, md5(cut) AS digest FROM (SELECT doc_id, CASE WHEN length(long) > 524288 THEN "
    "left(long, 524288) || chr(10) || chr(10) || '[... Summary truncated at 512KB limit ...]' ELSE long END AS cut "
    "FROM (SELECT doc_id, repeat(text, 20) AS long FROM documents) r) c",
)
def _(spark, d):
    cut = fx.table(spark, d, "documents").select("doc_id", doc.truncate_summary(F.repeat("text", 20)).alias("cut"))
    return cut.select("doc_id", F.length("cut").cast("bigint").alias("size"), F.md5("cut").alias("digest"))


@query(
    "chunk_documents",
    "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS words FROM documents), "
    "n AS (SELECT *, greatest(1, CAST(ceil((len(words) - 384) / 327.0) AS INT) + 1) AS chunks FROM t) "
    "SELECT doc_id, CAST(k AS BIGINT) AS chunk_no, array_to_string(words[k * 327 + 1 : k * 327 + 384], ' ') AS chunk "
    "FROM (SELECT doc_id, words, unnest(range(0, chunks)) AS k FROM n) x",
)
def _(spark, d):
    exploded = fx.table(spark, d, "documents").select("doc_id", F.posexplode(doc.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return exploded.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


# ---- retrieval ----------------------------------------------------------------------

_RANKED = """WITH tok AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM documents),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS word FROM benchmark),
occ AS (SELECT doc_id, len(words) AS length, unnest(words) AS word FROM tok),
postings AS MATERIALIZED (SELECT doc_id, length, word, CAST(count(*) AS DOUBLE) AS tf FROM occ WHERE word IN (SELECT word FROM asked) GROUP BY ALL),
corpus AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(len(words)) AS average FROM tok),
weights AS (SELECT a.query_id, a.word, ln(1::DOUBLE + ((SELECT total FROM corpus) - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) AS idf
  FROM asked a JOIN (SELECT word, CAST(count(*) AS DOUBLE) AS df FROM postings GROUP BY word) f USING (word)),
scored AS (SELECT w.query_id, p.doc_id, CAST(sum(CAST(floor(w.idf * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE *
  (p.length / (SELECT average FROM corpus)))) * 1000000 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS score FROM postings p JOIN weights w USING (word) GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM scored)
"""


def _queries(spark, d):
    return fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(spark, d, hits=20):
    """Out of the stored index, built once a session."""
    return lexical_index.search(fx.lexical_index(spark, d), _queries(spark, d), hits).withColumn("pos", F.col("rank").cast("bigint"))


_TOP = _RANKED + "SELECT query_id, doc_id, score, pos FROM ranked WHERE pos <= 100"


@query("retrieve_lexical", _TOP)
def _(spark, d):
    return _hits(spark, d, 100).drop("rank")


@query("retrieve_lexical_unindexed", _TOP)
def _(spark, d):
    """The same from raw texts, for a set of queries that is asked once."""
    found = retrieval.retrieve_lexical(fx.table(spark, d, "documents"), _queries(spark, d), 100)
    return found.withColumn("pos", F.col("rank").cast("bigint")).drop("rank")


def _raw_hits(spark, d):
    documents = fx.documents(spark, d)
    return _hits(spark, d).join(documents.withColumn("snippet", F.col("text")).drop("text"), "doc_id")


_BASE_COLUMNS = (
    "r.query_id, r.pos, d.url AS repo_url, d.org AS repo_org, d.repo AS repo_name, 'Unknown' AS language, "
    "coalesce(nullif(d.pushed_at, ''), nullif(d.processed_at, ''), '2000-06-01') AS last_updated, 0.85::DOUBLE AS similarity_score, "
    "concat('https://github.com/', d.org, '/', d.repo) AS github_link, "
    "concat('https://sbom.example.org/', d.org, '/', d.repo, '.json.gz') AS sbom_url"
)
_SNIPPET_COLUMNS = (
    ", CASE WHEN length(d.text) > 200 THEN left(d.text, 200) || '...' ELSE d.text END AS snippet, 'src/example.ts' AS snippet_file_path, "
    "'1-5' AS snippet_line_range, 2 AS context_lines_before, 2 AS context_lines_after, concat('https://github.dev/', d.org, '/', d.repo) AS codespaces_link"
)
_SHAPED = _RANKED + ", docs AS (" + for_duckdb(fx.DOCUMENTS_SQL) + ") SELECT "
_SHAPED_FROM = " FROM ranked r JOIN docs d USING (doc_id) WHERE r.pos <= 20"


def _shaped(spark, d, mode, documents=None):
    return results.shape(_raw_hits(spark, d), fx.SBOM_BASE_URL, F.lit(fx.AS_OF), mode, documents, ["query_id", "pos"])


@query("shape_minimal", _SHAPED + _BASE_COLUMNS + _SHAPED_FROM)
def _(spark, d):
    return _shaped(spark, d, "minimal")


@query("shape_snippets", _SHAPED + _BASE_COLUMNS + _SNIPPET_COLUMNS + _SHAPED_FROM)
def _(spark, d):
    return _shaped(spark, d, None)


@query(
    "shape_full",
    _SHAPED + _BASE_COLUMNS + _SNIPPET_COLUMNS + ", x.text AS summary, CASE WHEN r.doc_id % 60 <> 0 THEN CASE WHEN r.doc_id % 4 = 0 THEN 0 ELSE d.n_chars END END AS contributors, "
    "6::BIGINT AS dependency_count FROM ranked r JOIN docs d USING (doc_id) JOIN (" + for_duckdb(_SUMMARY) + ") x USING (doc_id) WHERE r.pos <= 20",
)
def _(spark, d):
    full = _shaped(spark, d, "full", _summaries(spark, d))
    return full.withColumns(
        {"contributors": F.col("repository_stats.contributors"), "dependency_count": F.size("dependencies").cast("bigint")}
    ).drop("repository_stats", "dependencies", "readme_excerpt")


@query("search_code", _SHAPED + "r.score, " + _BASE_COLUMNS + _SNIPPET_COLUMNS + _SHAPED_FROM)
def _(spark, d):
    return results.shape(_raw_hits(spark, d), fx.SBOM_BASE_URL, F.lit(fx.AS_OF), keep=["query_id", "pos", "score"])


@query("join_documents", _RANKED + "SELECT r.query_id, r.pos, d.text FROM ranked r LEFT JOIN documents d USING (doc_id) WHERE r.pos <= 20")
def _(spark, d):
    documents = fx.documents(spark, d)
    hits = _hits(spark, d).join(documents.select("doc_id", "org", "repo"), "doc_id")
    return store.lookup(hits, documents).select("query_id", "pos", "text")


def _centroids(spark, d):
    parts = fx.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"))
    return ordered.select(F.col("label").cast("bigint").alias("query_id"), F.col("v.m").alias("embedding"))


_NEAREST = (
    "WITH p AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings), "
    "e AS MATERIALIZED (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM p), "
    "q AS MATERIALIZED (SELECT label AS query_id, i, avg(x) AS m FROM e GROUP BY ALL), "
    "en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(m * m)) AS n FROM q GROUP BY 1), "
    "s AS (SELECT q.query_id, e.vec_id, sum(e.x * q.m) AS dot FROM e JOIN q USING (i) GROUP BY ALL), "
    "c AS (SELECT s.query_id, s.vec_id, s.dot / en.n / qn.n AS cosine FROM s JOIN en USING (vec_id) JOIN qn USING (query_id)) "
    "SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos "
    "FROM (SELECT query_id, vec_id, CAST(floor(cosine * 1000000 + 0.5) AS BIGINT) AS score FROM c WHERE cosine >= 0.4) f) r WHERE pos <= 10"
)


@query("retrieve_vector", _NEAREST)
def _(spark, d):
    found = retrieval.retrieve_vector(fx.table(spark, d, "embeddings"), _centroids(spark, d))
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("pos"))


def _asking(spark, d):
    """Every vector whose id is divisible by 100."""
    vectors = fx.table(spark, d, "embeddings").where("vec_id % 100 = 0")
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))


_NEAREST_TO_SOME = _NEAREST.replace(
    "q AS MATERIALIZED (SELECT label AS query_id, i, avg(x) AS m FROM e GROUP BY ALL)",
    "q AS MATERIALIZED (SELECT vec_id AS query_id, i, x AS m FROM e WHERE vec_id % 100 = 0)",
)


@query("retrieve_vector_indexed", _NEAREST_TO_SOME)
def _(spark, d):
    found = vector_index.search(fx.vector_index(spark, d), _asking(spark, d), 10, retrieval.VECTOR_THRESHOLD)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("pos"))


# ---- evaluation ---------------------------------------------------------------------

_JUDGED = (
    _RANKED + ", judged AS (SELECT r.query_id, r.doc_id, r.pos, CASE WHEN d.source = 'src' || (r.query_id % 20) THEN 3 "
    "WHEN r.score / 100000000.0::DOUBLE > 0.7 THEN 2 WHEN r.score / 100000000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS relevance, "
    "length(d.text) >= 100 AND contains(d.text, chr(10)) AS adequate_context FROM ranked r JOIN documents d USING (doc_id) WHERE r.pos <= 5), "
    "relevance AS (SELECT query_id, count(*) FILTER (relevance >= 2) AS relevant_count, bool_and(adequate_context) AS context_adequate, "
    "count(*) FILTER (relevance >= 2) / 5.0::DOUBLE * 100.0::DOUBLE AS relevance_rate, "
    "count(*) FILTER (relevance >= 2) / 5.0::DOUBLE * 100.0::DOUBLE >= 80 AS passes FROM judged GROUP BY query_id) "
)


def _judged_input(spark, d):
    documents = fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("org"), F.col("text").alias("content"))
    hits = _hits(spark, d).withColumn("score", F.col("score") / F.lit(100_000_000.0)).join(documents, "doc_id")
    expected = _queries(spark, d).select(
        "query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("org")
    )
    return hits, expected


@query("eval_judge_hits", _JUDGED + "SELECT query_id, doc_id, relevance, adequate_context FROM judged")
def _(spark, d):
    return evaluation.judge_hits(*_judged_input(spark, d)).select("query_id", "doc_id", "relevance", "adequate_context")


@query("eval_relevance", _JUDGED + "SELECT * FROM relevance")
def _(spark, d):
    return evaluation.relevance(*_judged_input(spark, d))


_CALLS = "calls AS MATERIALIZED (" + for_duckdb(fx.CALLS_SQL) + ") "


def _floor_sql(source, column, points=(50, 95, 99)):
    return ", ".join(
        f"(SELECT {column} FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n FROM {source}) v "
        f"WHERE i = least(floor(n * {p} / 100.0), n - 1)) AS p{p}" for p in points
    )


@query("agg_eval_percentiles", "WITH " + _CALLS + "SELECT " + _floor_sql("calls", "duration_ms"))
def _(spark, d):
    return evaluation.latency_percentiles(fx.calls(spark, d), "duration_ms")


@query(
    "eval_percentiles_by_type",
    "SELECT event_type, p50, p95, p99 FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) g, "
    "LATERAL (SELECT v[CAST(least(floor(n * 50 / 100.0), n - 1) AS INT) + 1] AS p50, v[CAST(least(floor(n * 95 / 100.0), n - 1) AS INT) + 1] AS p95, "
    "v[CAST(least(floor(n * 99 / 100.0), n - 1) AS INT) + 1] AS p99) x",
)
def _(spark, d):
    points = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    return percentiles(fx.table(spark, d, "events"), ["event_type"], "value", points, "floor")


@query(
    "eval_decision",
    _JUDGED + ", " + _CALLS + ", t AS (SELECT " + _floor_sql("calls", "duration_ms") + "), s AS (SELECT "
    + _floor_sql("(SELECT duration_ms / 4 AS search_ms FROM calls)", "search_ms", (95,)) + "), "
    "r AS (SELECT avg(relevance_rate) AS rel, count(*) FILTER (passes) AS queries_passing, bool_and(context_adequate) AS ctx FROM relevance) "
    "SELECT t.p50, t.p95, t.p99, s.p95 AS search_p95, round(r.rel, 6) AS avg_relevance, r.queries_passing, r.ctx AS context_adequate, "
    "CASE WHEN t.p95 < 2000 AND r.rel >= 80 THEN 'GO' ELSE 'NO-GO' END AS decision, "
    "(CASE WHEN t.p95 < 2000 THEN 0 ELSE 1 END + CASE WHEN s.p95 < 800 THEN 0 ELSE 1 END + CASE WHEN r.rel >= 80 THEN 0 ELSE 1 END "
    "+ CASE WHEN r.ctx THEN 0 ELSE 1 END)::BIGINT AS advice FROM t, s, r",
)
def _(spark, d):
    runs = fx.calls(spark, d).select(
        F.col("duration_ms").alias("total_ms"), (F.col("duration_ms") / 4).alias("search_ms")
    )
    row = evaluation.decide(runs, evaluation.relevance(*_judged_input(spark, d)), 120_000)
    return row.select(
        "p50", "p95", "p99", "search_p95", F.round("avg_relevance", 6).alias("avg_relevance"), "queries_passing",
        "context_adequate", "decision", F.size("recommendations").cast("bigint").alias("advice"),
    )


# ---- service metrics and cost -------------------------------------------------------

_COUNTS = (
    "CAST(ts AS DATE) AS period, count(*) AS query_volume, count(*) FILTER (is_error) AS errors, count(*) FILTER (cache_hit) AS cache_hits, "
    "count(cache_hit) AS cache_checks, count(*) FILTER (result_count = 0) AS empty_results, count(*) FILTER (duration_ms > 2000) AS slow_queries"
)
_RATES = (
    "errors / query_volume::DOUBLE * 100 AS error_rate, cache_hits / cache_checks::DOUBLE * 100 AS cache_hit_rate, "
    "empty_results / query_volume::DOUBLE * 100 AS empty_result_rate, slow_queries / query_volume::DOUBLE * 100 AS slow_query_rate"
)
_DAILY = (
    "WITH " + _CALLS + f", daily AS (SELECT *, {_RATES} FROM (SELECT {_COUNTS}, quantile_cont(duration_ms, 0.5) AS response_time_p50, "
    "quantile_cont(duration_ms, 0.95) AS response_time_p95, quantile_cont(duration_ms, 0.99) AS response_time_p99 FROM calls GROUP BY 1) c) "
)
_P = ("response_time_p50", "response_time_p95", "response_time_p99")
_R = ("error_rate", "cache_hit_rate", "empty_result_rate", "slow_query_rate")


def _rounded(df):
    names = [c for c in df.columns if c in _R or c in _P]
    return df.withColumns(
        {"period": F.col("period").cast("string"), **{c: F.round(c, 6 if c in _R else 3) for c in names}}
    )


_ROUNDED_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in _R)
_ROUNDED_P = ", ".join(f"round({c}, 3) AS {c}" for c in _P)
_COUNT_NAMES = "query_volume, errors, cache_hits, cache_checks, empty_results, slow_queries"


@query("metrics_daily", _DAILY + f"SELECT CAST(period AS VARCHAR) AS period, {_COUNT_NAMES}, {_ROUNDED_RATES}, {_ROUNDED_P} FROM daily")
def _(spark, d):
    return _rounded(metrics.daily(fx.calls(spark, d)))


@query("metrics_rates", _DAILY + f"SELECT CAST(period AS VARCHAR) AS period, {_COUNT_NAMES}, {_ROUNDED_RATES} FROM daily")
def _(spark, d):
    return _rounded(metrics.daily_counts(fx.calls(spark, d)))


@query(
    "metrics_errors_by_type",
    "WITH " + _CALLS + "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, error_type, count(*) AS errors FROM calls WHERE is_error GROUP BY ALL",
)
def _(spark, d):
    return metrics.errors_by_type(fx.calls(spark, d)).withColumn("period", F.col("period").cast("string"))


_WEEKLY = (
    "weekly AS (SELECT *, CASE WHEN previous_week_queries > 0 THEN CASE WHEN (weekly_queries - previous_week_queries) / previous_week_queries::DOUBLE * 100 > 5 "
    "THEN 'increasing' WHEN (weekly_queries - previous_week_queries) / previous_week_queries::DOUBLE * 100 < -5 THEN 'decreasing' ELSE 'stable' END END AS adoption_trend "
    "FROM (SELECT week, weekly_queries, lag(weekly_queries) OVER (ORDER BY week) AS previous_week_queries FROM "
    "(SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS weekly_queries FROM calls GROUP BY 1) w) l) "
)


@query("win_adoption_trend", "WITH " + _CALLS + ", " + _WEEKLY + "SELECT CAST(week AS VARCHAR) AS week, weekly_queries, previous_week_queries, adoption_trend FROM weekly")
def _(spark, d):
    return metrics.weekly_trend(fx.calls(spark, d)).withColumn("week", F.col("week").cast("string"))


@query(
    "metrics_compliance",
    _DAILY + ", " + _WEEKLY + "SELECT CAST(d.period AS VARCHAR) AS period, response_time_p95 < 2000 AS performance_compliance, "
    "error_rate < 1 AS reliability_compliance, cache_hit_rate > 90 AS cache_efficiency_compliance, "
    "coalesce(response_time_p95 < 2000 AND error_rate < 1 AND cache_hit_rate > 90 AND w.weekly_queries >= 200 AND w.adoption_trend <> 'decreasing', FALSE) AS success "
    "FROM daily d LEFT JOIN weekly w ON w.week = CAST(date_trunc('week', d.period) AS DATE)",
)
def _(spark, d):
    calls = fx.calls(spark, d)
    checked = metrics.compliance(metrics.daily(calls), metrics.weekly_trend(calls))
    return checked.select(
        F.col("period").cast("string").alias("period"), "performance_compliance", "reliability_compliance",
        "cache_efficiency_compliance", "success",
    )


@query(
    "sink_metrics_csv_json",
    _DAILY + "SELECT CAST(period AS VARCHAR) AS date, CAST(query_volume AS VARCHAR) AS query_volume, format('{:.2f}', floor(error_rate * 100 + 0.5) / 100) AS error_rate, "
    "format('{:.1f}', floor(cache_hit_rate * 10 + 0.5) / 10) AS cache_hit_rate, format('{:.1f}', floor(empty_result_rate * 10 + 0.5) / 10) AS empty_result_rate, "
    "format('{:.1f}', floor(slow_query_rate * 10 + 0.5) / 10) AS slow_query_rate FROM daily",
)
def _(spark, d):
    path = run_path(spark, "metrics-csv")
    metrics.write_export(metrics.daily(fx.calls(spark, d)), path, "csv", "1970-01-01", "2100-01-01")
    back = spark.read.csv(path, header=True)
    return back.select("date", "query_volume", *_R)


@query(
    "sink_metrics_json",
    _DAILY + "SELECT 'monthly' AS name, '2024-01-01' AS start_date, CAST(period AS VARCHAR) AS period, query_volume FROM daily WHERE period <= DATE '2024-01-31'",
)
def _(spark, d):
    path = run_path(spark, "metrics-json")
    daily = metrics.daily(fx.calls(spark, d))
    metrics.write_export(daily, path, "json", "2024-01-01", "2024-01-31")
    back = spark.read.schema("period string, start_date string, metrics struct<period:string,query_volume:bigint>").json(path)
    return back.select(F.col("period").alias("name"), "start_date", "metrics.period", "metrics.query_volume")


_COSTS = (
    "costs AS (SELECT *, workers_cost + 0.5::DOUBLE + ai_search_cost + 0.2::DOUBLE + 0.1::DOUBLE AS total_daily FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS requests, "
    "count(*) / 1000000::DOUBLE * 0.5 AS workers_cost, 0.5::DOUBLE AS r2_cost, count(*) / 1000::DOUBLE * 0.01 AS ai_search_cost, 0.2::DOUBLE AS kv_cost, 0.1::DOUBLE AS vectorize_cost "
    "FROM calls GROUP BY 1) c) "
)
_PROJECTED = (
    "projected AS (SELECT *, floor(cumulative_month / 50 * 100 * 100 + 0.5) / 100 AS budget_utilization FROM (SELECT *, total_daily * day(date) AS cumulative_month, "
    "total_daily * day(last_day(date)) AS projection_month_end FROM costs) p) "
)
_COST_WITH = "WITH " + _CALLS + ", " + _COSTS


def _money(df, *names):
    return df.withColumns({"date": F.col("date").cast("string"), **{n: F.round(n, 8) for n in names}})


@query(
    "cost_daily",
    _COST_WITH + "SELECT CAST(date AS VARCHAR) AS date, requests, round(workers_cost, 8) AS workers_cost, r2_cost, round(ai_search_cost, 8) AS ai_search_cost, kv_cost, "
    "vectorize_cost, round(total_daily, 8) AS total_daily FROM costs",
)
def _(spark, d):
    return _money(cost.daily_costs(fx.calls(spark, d)), "workers_cost", "ai_search_cost", "total_daily")


def _projection(spark, d):
    return cost.with_projection(cost.daily_costs(fx.calls(spark, d)))


@query(
    "cost_projection",
    _COST_WITH + ", " + _PROJECTED + "SELECT CAST(date AS VARCHAR) AS date, round(cumulative_month, 8) AS cumulative_month, round(projection_month_end, 8) AS projection_month_end FROM projected",
)
def _(spark, d):
    money = ("cumulative_month", "projection_month_end")
    return _money(_projection(spark, d).select("date", *money), *money)


@query("cost_utilization", _COST_WITH + ", " + _PROJECTED + "SELECT CAST(date AS VARCHAR) AS date, budget_utilization FROM projected")
def _(spark, d):
    return _money(_projection(spark, d).select("date", "budget_utilization"))


@query(
    "win_month_to_date",
    _COST_WITH + "SELECT CAST(date AS VARCHAR) AS date, round(sum(total_daily) OVER w, 8) AS spent, round(sum(total_daily) OVER w / count(*) OVER w * day(last_day(date)), 8) AS projected "
    "FROM costs WINDOW w AS (PARTITION BY date_trunc('month', date) ORDER BY date ROWS UNBOUNDED PRECEDING)",
)
def _(spark, d):
    return _money(cost.month_to_date(cost.daily_costs(fx.calls(spark, d))).select("date", "spent", "projected"), "spent", "projected")


@query(
    "cost_recommend",
    _COST_WITH + ", " + _PROJECTED + "SELECT CAST(date AS VARCHAR) AS date, concat_ws('|', CASE WHEN r2_cost > total_daily * 0.3 THEN 'storage takes over 30% of the day' END, "
    "'under 90% of calls are cached', CASE WHEN ai_search_cost > total_daily * 0.4 THEN 'search takes over 40% of the day' END, "
    "CASE WHEN workers_cost > total_daily * 0.2 THEN 'requests take over 20% of the day' END, CASE WHEN budget_utilization < 80 THEN 'under 80% of the budget is used' END) AS advice FROM projected",
)
def _(spark, d):
    advice = F.array_join(cost.recommendations(F.lit(85.0)), "|")
    return _projection(spark, d).select(F.col("date").cast("string").alias("date"), advice.alias("advice"))


@query(
    "cost_alert",
    _COST_WITH + "SELECT CAST(date AS VARCHAR) AS date, 10.0::DOUBLE AS budget_threshold, round(total_daily * day(date), 8) AS current_spend, "
    "round(total_daily * day(last_day(date)), 8) AS projection FROM costs WHERE total_daily * day(date) >= 8",
)
def _(spark, d):
    raised = cost.alerts(cost.with_projection(cost.daily_costs(fx.calls(spark, d)), 10.0), 10.0)
    return _money(raised.drop("recommendations", "utilization"), "current_spend", "projection")


@query(
    "agg_ingest_stats",
    "WITH " + _CALLS + "SELECT user_id AS batch, count(*) AS total, count(*) FILTER (NOT is_error) AS successful, count(*) FILTER (is_error) AS failed, "
    "floor(coalesce(sum(CAST(round(duration_ms) AS BIGINT)) FILTER (NOT is_error), 0)::DOUBLE * 100 + 0.5) / 100 AS total_time_seconds, "
    "CASE WHEN count(*) FILTER (NOT is_error) > 0 THEN floor(sum(CAST(round(duration_ms) AS BIGINT)) FILTER (NOT is_error)::DOUBLE / count(*) FILTER (NOT is_error) * 100 + 0.5) / 100 "
    "ELSE 0 END AS average_time_seconds FROM calls GROUP BY 1",
)
def _(spark, d):
    runs = fx.calls(spark, d).select(
        F.col("user_id").alias("batch"), (~F.col("is_error")).alias("success"), F.round("duration_ms").alias("duration")
    )
    return ingest_stats.ingest_stats(runs)


@query(
    "agg_upload_stats",
    "SELECT count(*) FILTER (n_chars > 50) AS total_uploaded, count(*) FILTER (n_chars <= 50) AS total_failed, CAST(sum(n_chars) FILTER (n_chars > 50) AS BIGINT) AS total_bytes, "
    "floor(sum(n_chars) FILTER (n_chars > 50)::DOUBLE / 1048576 * 100 + 0.5) / 100 AS total_mb, "
    "floor(count(*) FILTER (n_chars > 50)::DOUBLE / count(*) * 100 * 100 + 0.5) / 100 AS success_rate FROM documents",
)
def _(spark, d):
    uploads = fx.table(spark, d, "documents").select((F.col("n_chars") > 50).alias("success"), F.col("n_chars").alias("bytes"))
    return ingest_stats.upload_stats(uploads)


@query("rate_pct", "SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN turn::DOUBLE / length(text)::DOUBLE * 100 ELSE 0 END AS rate FROM conversations")
def _(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", rate_pct(F.col("turn"), F.length("text")).alias("rate"))


@query("round_js", "SELECT s_suppkey, floor(s_acctbal / 7 * 100::DOUBLE + 0.5) / 100 AS rounded FROM supplier")
def _(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", round_half_up(F.col("s_acctbal") / 7).alias("rounded"))


# ---- sources and sinks --------------------------------------------------------------

_FACT_OUT = ["repo_full_name", "repo_url", "purl", "ecosystem", "package_key", "version_raw", "version_kind", "version_sort_key", "license_id"]
_FACT_SELECT = f"SELECT {', '.join(_FACT_OUT)}, CAST(ingested_date AS VARCHAR) AS ingested_date FROM fact"


def _shown(fact):
    return fact.select(*_FACT_OUT, F.col("ingested_date").cast("string").alias("ingested_date"))


@query("sink_partition_overwrite", oracle(_FACT_SELECT))
def _(spark, d):
    """Load everything, then load one snapshot again: nothing is doubled or lost."""
    path = run_path(spark, "overwrite")
    fact = fx.index(spark, d).fact
    tables.write_snapshot(fact, path)
    tables.write_snapshot(fx.index(spark, d).current, path)
    return _shown(tables.read_fact(spark, path))


@query("sink_layout_clustered", oracle("SELECT ecosystem, package_key, count(*) AS n, 0 AS overlapping_files FROM cur GROUP BY ALL"))
def _(spark, d):
    """Beside the rows: how many files begin before the file with the next smaller start ends."""
    path = run_path(spark, "clustered")
    tables.write_snapshot(fx.index(spark, d).current, path)
    rows = tables.read_fact(spark, path)
    place = F.struct("ecosystem", "package_key", "repo_full_name")
    files = rows.groupBy(F.input_file_name().alias("file")).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    ends = F.max("high").over(Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    overlapping = files.select((F.col("low") < ends).alias("early")).agg(F.count_if("early")).first()[0]
    return rows.groupBy("ecosystem", "package_key").agg(F.count("*").alias("n")).withColumn("overlapping_files", F.lit(overlapping))


@query(
    "sink_retention_90d",
    oracle(_FACT_SELECT + " WHERE ingested_date >= (SELECT max(ingested_date) FROM fact) - INTERVAL 400 DAY"),
)
def _(spark, d):
    path = run_path(spark, "retention")
    ix = fx.index(spark, d)
    tables.write_snapshot(ix.fact, path, dates=tables.dates_at_once(ix.fact))
    tables.drop_expired(spark, path, ix.date, days=400)
    return _shown(tables.read_fact(spark, path))


@query("retained_snapshots", oracle(_FACT_SELECT + " WHERE ingested_date >= (SELECT max(ingested_date) FROM fact) - INTERVAL 800 DAY"))
def _(spark, d):
    ix = fx.index(spark, d)
    return _shown(tables.retained(ix.fact, ix.date, 800))


@query("sink_current_swap", oracle("SELECT ecosystem, version_kind, count(*) AS n FROM cur GROUP BY ALL"))
def _(spark, d):
    # Another session, which knows nothing but the folder, reads the snapshot served last.
    current = open_index(spark.newSession(), fx.index_base(spark, d)).current
    return current.groupBy("ecosystem", "version_kind").agg(F.count("*").alias("n"))


@query("sink_ndjson_gz", oracle(_FACT_SELECT))
def _(spark, d):
    path = run_path(spark, "ndjson")
    tables.write_ndjson(fx.index(spark, d).fact, path)
    return _shown(spark.read.schema(tables.FACT_SCHEMA).option("mode", "FAILFAST").json(path))


_LINES = "WITH lines AS (" + for_duckdb(fx.LINES_SQL) + ") "


def _landed_components(spark, d, path):
    for _ in fx.passes(spark, d):
        nested = fx.components(spark, d).select("name", "externalReferences", "components", "ingested_date")
        nested.write.mode("append").partitionBy("ingested_date").option("compression", "gzip").json(path)
    return path


@query("src_sbom_aggregate", _LINES + "SELECT repo_full_name AS name, purl, nullif(version_field, '') AS version, license_id FROM lines")
def _(spark, d):
    path = _landed_components(spark, d, run_path(spark, "aggregate"))
    read = sbom.read_aggregate(spark, path, "lines").select("name", F.explode("components").alias("lib"))
    return read.select(
        "name", "lib.purl", F.nullif("lib.version", F.lit("")).alias("version"), sbom.first_license(F.col("lib.licenses")).alias("license_id")
    )


@query("src_sbom_integrity", oracle("SELECT CAST(ingested_date AS VARCHAR) AS ingested_date, TRUE AS all_gzip, "
       "bool_and(year(ingested_date) % 2 = 1) AS all_complete FROM fact GROUP BY 1 UNION ALL SELECT 'plain', FALSE, TRUE"))
def _(spark, d):
    """Files of even years are declared longer than they are; one folder is not compressed."""
    path = _landed_components(spark, d, run_path(spark, "integrity"))
    spark.range(3).select(F.lit("{}").alias("value")).write.text(f"{path}/ingested_date=plain")
    files = f"{path}/*/part-*"
    date = F.regexp_extract("path", r"ingested_date=([0-9a-z-]+)/", 1)
    cut = F.substring(date, 1, 4).try_cast("int") % 2 == 0
    sizes = spark.read.format("binaryFile").load(files).select("path", "length")
    declared = sizes.select("path", (F.col("length") + F.when(cut, 7).otherwise(0)).alias("declared_length"))
    checked = sbom.check_integrity(spark, files, declared)
    return checked.groupBy(date.alias("ingested_date")).agg(
        F.bool_and("is_gzip").alias("all_gzip"), F.bool_and("is_complete").alias("all_complete")
    )


def _spdx(spark, d):
    """SPDX documents, one per order, with the package of the repository in front."""
    no_ref = F.array().cast("array<struct<referenceType:string,referenceLocator:string>>")
    reference = F.array(
        F.struct(F.lit("cpe").alias("referenceType"), F.lit("cpe:x").alias("referenceLocator")),
        F.struct(F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")),
    )
    package = F.struct(
        F.col("name_enc").alias("name"),
        F.col("version_enc").alias("versionInfo"),
        F.col("license_id").alias("licenseConcluded"),
        F.when(F.col("l_linenumber") == 1, no_ref).otherwise(reference).alias("externalRefs"),
    )
    root = F.array(
        F.struct(
            F.concat(F.lit("com.github."), F.col("repo")), F.lit("1"), F.lit("NONE"), no_ref
        ).cast("struct<name:string,versionInfo:string,licenseConcluded:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>")
    )
    grouped = fx.lines(spark, d).groupBy(
        F.substring_index("repo_full_name", "/", 1).alias("org"), F.col("o_orderkey").cast("string").alias("repo")
    ).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", package.alias("p")))).alias("ps"))
    return grouped.select("org", "repo", F.concat(root, F.col("ps.p")).alias("packages"))


_SPDX = _LINES + ", packages AS (SELECT split_part(repo_full_name, '/', 1) AS org, CAST(o_orderkey AS VARCHAR) AS repo, name_enc AS name, version_enc AS version, " \
    "coalesce(license_id, '') AS license_id, CASE WHEN l_linenumber = 1 THEN '' ELSE purl END AS purl, l_linenumber FROM lines) "


@query("src_sbom_spdx", _SPDX + "SELECT org, repo, name, version, license_id, purl FROM packages")
def _(spark, d):
    return sbom.spdx_packages(_spdx(spark, d)).drop("position")


_MD_LINE = (
    "concat('- ', name_enc, CASE WHEN version_enc <> '' THEN ' (' || version_enc || ')' ELSE '' END, CASE WHEN coalesce(license_id, '') NOT IN ('', 'NOASSERTION') "
    "THEN ' [' || license_id || ']' ELSE '' END, ' `', purl, '`')"
)


@query(
    "sink_sbom_markdown",
    _LINES + "SELECT org, repo, concat(chr(10), chr(10), '## SBOM Dependencies (', n, ' packages)', chr(10), chr(10), 'Source: [SPDX 2.3 SBOM](https://sbom.example.org/', org, '/', repo, "
    "'.json.gz)', chr(10), chr(10), body, CASE WHEN n > 100 THEN chr(10) || chr(10) || '... and ' || (n - 100) || ' more (see full SBOM)' ELSE '' END) AS markdown FROM ("
    "SELECT org, repo, any_value(n) AS n, string_agg(line, chr(10) ORDER BY r) AS body FROM (SELECT split_part(repo_full_name, '/', 1) AS org, ecosystem AS repo, "
    + _MD_LINE + " AS line, row_number() OVER (PARTITION BY split_part(repo_full_name, '/', 1), ecosystem ORDER BY o_orderkey, l_linenumber, purl, version_enc, license_id NULLS FIRST) AS r, "
    "count(*) OVER (PARTITION BY split_part(repo_full_name, '/', 1), ecosystem) AS n FROM lines) x WHERE r <= 100 GROUP BY org, repo) y",
)
def _(spark, d):
    """Packages per organisation and ecosystem, which are more than one section lists."""
    packages = fx.lines(spark, d).select(
        F.substring_index("repo_full_name", "/", 1).alias("org"),
        F.col("ecosystem").alias("repo"),
        F.struct("o_orderkey", "l_linenumber", "purl", "version_enc", "license_id").alias("position"),
        F.col("name_enc").alias("name"),
        F.col("version_enc").alias("version"),
        F.coalesce("license_id", F.lit("")).alias("license_id"),
        "purl",
    )
    url = F.concat(F.lit("https://sbom.example.org/"), "org", F.lit("/"), "repo", F.lit(".json.gz"))
    return sbom.sbom_markdown(packages, url)


# ---- streams ------------------------------------------------------------------------


# A day has fewer calls than a sketch holds, so the stream's percentiles are exact here.
_STREAM_P = ", ".join(f"round(sorted[CAST(ceil({q} * len(sorted)) AS INT)], 3) AS {p}" for p, q in metrics.POINTS.items())


@query(
    "stream_metrics_tumbling",
    "WITH " + _CALLS + f"SELECT CAST(period AS VARCHAR) AS period, {_COUNT_NAMES}, {_ROUNDED_RATES}, {_STREAM_P} "
    f"FROM (SELECT *, {_RATES} FROM (SELECT {_COUNTS}, list_sort(list(duration_ms)) AS sorted FROM calls GROUP BY 1) c) r "
    "WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM calls)",
)
def _(spark, d):
    """The closed days, as the stream writes them."""
    base = run_path(spark, "stream-metrics")
    schema = fx.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    calls = spark.sql(fx.CALLS_SQL, events=events)
    stream_metrics.write_available(stream_metrics.tumbling(calls), f"{base}/out", f"{base}/checkpoint")
    return _rounded(spark.read.parquet(f"{base}/out").drop("until"))


@query("stream_ingest_snapshots", oracle("SELECT repo_full_name, purl, version_raw, version_sort_key, license_id, CAST(ingested_date AS VARCHAR) AS ingested_date FROM fact"))
def _(spark, d):
    base = run_path(spark, "stream-snapshots")
    landing = _landed_components(spark, d, f"{base}/landing")
    stream_snapshots.ingest(spark, landing, f"{base}/index", f"{base}/checkpoint")
    return open_index(spark, f"{base}/index").fact.select(
        "repo_full_name", "purl", "version_raw", "version_sort_key", "license_id", F.col("ingested_date").cast("string").alias("ingested_date")
    )
