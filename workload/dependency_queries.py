"""Queries over the dependency index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomatlas.functions import sql
from bomatlas.functions.licences import is_copyleft
from bomatlas.functions.purl import package_key, with_purl_columns
from bomatlas.functions.ranges import range_comparators
from bomatlas.functions.text import percent_decode
from bomatlas.functions.versions import is_range_or_wildcard, is_sha, with_version_columns
from bomatlas.operators import compare, eol, exposure, landscape, listing, pages, repo_sets, search, summaries, trends
from bomatlas.operators.ranking import top_per_group
from bomatlas.session import run_path
from bomatlas.sources import refdata, sbom
from bomatlas.sources.feed import normalise_feed, valid_entries, validation_stats
from bomatlas.sources.sbom import first_license, to_fact, vcs_url
from workload import fixture as fx
from workload.fixture import POPULARITY_SQL, oracle
from workload.registry import query

def as_of():
    return F.to_timestamp(F.lit(fx.AS_OF))
KEYS = "ecosystem, package_key"


def big(*names):
    return {n: F.col(n).cast("bigint") for n in names}


# ---- sources and projections -------------------------------------------------------


@query(
    "explode_sbom",
    oracle(
        "SELECT repo_full_name, org, repo, repo_url, purl, ecosystem, package_name, package_key, version_raw, "
        "version_kind, version_sort_key, license_id, is_self_ref, is_action, "
        "CAST(ingested_date AS VARCHAR) AS ingested_date FROM fact"
    ),
)
def _(spark, d):
    return fx.exploded_fact(spark, d).select(
        "repo_full_name", "org", "repo", "repo_url", "purl", "ecosystem", "package_name", "package_key",
        "version_raw", "version_kind", "version_sort_key", "license_id", "is_self_ref", "is_action",
        F.col("ingested_date").cast("string").alias("ingested_date"),
    )


@query(
    "src_sbom_aggregate_document",
    "WITH lines AS (" + fx.for_duckdb(fx.LINES_SQL) + ") SELECT repo_full_name, purl, version_field AS version_raw, license_id, "
    "vcs_url IS NULL AS github, count(*) AS n FROM lines GROUP BY ALL",
)
def _(spark, d):
    path = fx.published_document(spark, d)
    found = sbom.explode_libraries(sbom.read_aggregate(spark, path, "document", range_bytes=1 << 20))
    github = F.startswith("repo_url", F.lit("https://github.com/")).alias("github")
    return found.groupBy("repo_full_name", "purl", "version_raw", "license_id", github).agg(F.count("*").alias("n"))


@query(
    "src_repos_feed",
    oracle("SELECT repo_key, full_name, feed_pushed AS pushed_on, feed_url AS repo_url FROM feed"),
)
def _(spark, d):
    return normalise_feed(fx.feed(spark, d)).select(
        "repo_key", "full_name", F.to_date("pushed_at").cast("string").alias("pushed_on"), "repo_url"
    )


_RAW_FEED = """SELECT CASE WHEN position % 7 <> 0 THEN url END AS html_url, "pushedAt" AS pushed_at,
  CASE WHEN name = '' THEN org ELSE concat(coalesce(owner, org), '/', name) END AS full_name FROM ({feed}) f"""


def _raw_feed(spark, d):
    return spark.sql(
        _RAW_FEED.replace('"pushedAt"', "pushedAt").replace("({feed})", "{feed}"), feed=fx.feed(spark, d)
    )


@query(
    "src_repos_feed_validate",
    "WITH r AS (" + _RAW_FEED.replace("{feed}", fx.for_duckdb(fx.FEED_SQL)) + ") SELECT count(*) AS total, "
    "count(*) FILTER (html_url <> '' AND pushed_at <> '' AND regexp_full_match(full_name, '[^/]+/[^/]+')) AS valid, "
    "count(*) FILTER (NOT coalesce(html_url <> '' AND pushed_at <> '' AND regexp_full_match(full_name, '[^/]+/[^/]+'), FALSE)) "
    "AS invalid FROM r",
)
def _(spark, d):
    return validation_stats(_raw_feed(spark, d))


@query(
    "src_repos_feed_valid_rows",
    "WITH r AS (" + _RAW_FEED.replace("{feed}", fx.for_duckdb(fx.FEED_SQL)) + ") SELECT html_url AS url, "
    "pushed_at AS \"pushedAt\", split_part(full_name, '/', 1) AS org, split_part(full_name, '/', 2) AS name FROM r "
    "WHERE html_url <> '' AND pushed_at <> '' AND regexp_full_match(full_name, '[^/]+/[^/]+')",
)
def _(spark, d):
    return valid_entries(_raw_feed(spark, d))


@query(
    "src_repos_meta_join",
    oracle("SELECT repo_full_name, repo_url, strftime(pushed_at, '%Y-%m-%d') AS pushed_on, count(*) AS n FROM fact GROUP BY ALL"),
)
def _(spark, d):
    return fx.index(spark, d).fact.groupBy(
        "repo_full_name", "repo_url", F.to_date("pushed_at").cast("string").alias("pushed_on")
    ).agg(F.count("*").alias("n"))


@query(
    "derive_repo_identity",
    oracle("SELECT DISTINCT repo_full_name, org, repo, 'https://github.com/' || repo_full_name AS default_url FROM fact"),
)
def _(spark, d):
    return fx.index(spark, d).fact.select(
        "repo_full_name", "org", "repo", F.concat(F.lit("https://github.com/"), "repo_full_name").alias("default_url")
    ).distinct()


@query("vcs_url_pick", "WITH lines AS (" + fx.for_duckdb(fx.LINES_SQL) + ") SELECT DISTINCT o_orderkey, vcs_url FROM lines")
def _(spark, d):
    return fx.components(spark, d).select("o_orderkey", vcs_url(F.col("externalReferences")).alias("vcs_url")).distinct()


@query(
    "license_pick",
    "WITH lines AS (" + fx.for_duckdb(fx.LINES_SQL) + ") SELECT license_id, count(*) AS n FROM lines GROUP BY ALL",
)
def _(spark, d):
    libraries = fx.components(spark, d).select(F.explode("components").alias("lib"))
    return libraries.groupBy(first_license(F.col("lib.licenses")).alias("license_id")).agg(F.count("*").alias("n"))


@query(
    "purl_parse",
    "WITH lines AS (" + fx.for_duckdb(fx.LINES_SQL) + ") SELECT purl, ecosystem, url_decode(name_enc) AS package_name, "
    "url_decode(version_enc) AS purl_version FROM lines",
)
def _(spark, d):
    raw = fx.lines(spark, d).select("purl")
    return with_purl_columns(raw).select("purl", "ecosystem", "package_name", "purl_version")


@query("package_key", oracle("SELECT ecosystem, package_name, package_key, count(*) AS n FROM fact GROUP BY ALL"))
def _(spark, d):
    named = fx.index(spark, d).fact.select("ecosystem", "package_name")
    return named.groupBy(
        "ecosystem", "package_name", package_key(F.col("ecosystem"), F.col("package_name")).alias("package_key")
    ).agg(F.count("*").alias("n"))


@query(
    "truncate_cols",
    "SELECT 'o/r' || doc_id AS repo_full_name, left('pkg:npm/x@' || text, 2048) AS purl, left(text, 512) AS version_raw FROM documents",
)
def _(spark, d):
    """Texts in the place of package URLs and versions."""
    name = F.concat(F.lit("o/r"), F.col("doc_id"))
    libraries = fx.table(spark, d, "documents").select(
        name.alias("repo_full_name"), F.lit("o").alias("org"), name.alias("repo"), F.lit(None).cast("string").alias("repo_url"),
        F.lit(None).cast("timestamp").alias("pushed_at"), F.concat(F.lit("pkg:npm/x@"), "text").alias("purl"),
        F.col("text").alias("version_raw"), F.lit(None).cast("string").alias("license_id"),
    )
    return to_fact(libraries, F.lit("2025-01-01").cast("date")).select("repo_full_name", "purl", "version_raw")


@query(
    "fact_whole_columns",
    "SELECT 'o/r' || doc_id AS repo_full_name, octet_length(encode('pkg:npm/x@' || text)) AS purl_bytes, md5(text) AS version_md5 FROM documents "
    "WHERE text IS NOT NULL AND length(trim(text)) > 0",
)
def _(spark, d):
    """The same texts without the published widths."""
    name = F.concat(F.lit("o/r"), F.col("doc_id"))
    libraries = fx.table(spark, d, "documents").where("length(trim(text)) > 0").select(
        name.alias("repo_full_name"), F.lit("o").alias("org"), name.alias("repo"), F.lit(None).cast("string").alias("repo_url"),
        F.lit(None).cast("timestamp").alias("pushed_at"), F.concat(F.lit("pkg:npm/x@"), "text").alias("purl"),
        F.col("text").alias("version_raw"), F.lit(None).cast("string").alias("license_id"),
    )
    whole = to_fact(libraries, F.lit("2025-01-01").cast("date"), purl_chars=None, version_chars=None)
    return whole.select("repo_full_name", F.octet_length("purl").cast("bigint").alias("purl_bytes"), F.md5("version_raw").alias("version_md5"))


@query("flag_self_action", oracle("SELECT ecosystem, is_self_ref, is_action, count(*) AS n FROM fact GROUP BY ALL"))
def _(spark, d):
    return fx.index(spark, d).fact.groupBy("ecosystem", "is_self_ref", "is_action").agg(F.count("*").alias("n"))


# ---- filters ------------------------------------------------------------------------

_ROW = "repo_full_name, ecosystem, package_key, version_raw, license_id"
_ROW_COLUMNS = _ROW.split(", ")


@query("filter_real_packages", oracle(f"SELECT {_ROW} FROM fact WHERE ecosystem NOT IN ('github', 'githubactions')"))
def _(spark, d):
    return summaries.real_packages(fx.index(spark, d).fact).select(*_ROW_COLUMNS)


@query("filter_concrete", oracle(f"SELECT {_ROW} FROM fact WHERE version_kind IN ('release', 'prerelease')"))
def _(spark, d):
    return search.concrete(fx.index(spark, d).fact).select(*_ROW_COLUMNS)


@query("filter_package", oracle(f"SELECT {_ROW} FROM fact WHERE ecosystem = 'pypi' AND package_key = 'django'"))
def _(spark, d):
    return search.of_package(fx.index(spark, d).fact, "pypi", "Django").select(*_ROW_COLUMNS)


@query("filter_org_prefix", oracle(f"SELECT {_ROW} FROM cur WHERE split_part(repo_full_name, '/', 1) = 'nation_1'"))
def _(spark, d):
    return search.of_org(fx.index(spark, d).by_repo, "nation_1").select(*_ROW_COLUMNS)


@query(
    "filter_name_contains",
    oracle(POPULARITY_SQL + " SELECT ecosystem, package_key, repo_count FROM popularity WHERE contains(package_key, 'ring')"),
)
def _(spark, d):
    return search.name_contains(fx.index(spark, d).popularity, " Ring ").select("ecosystem", "package_key", "repo_count")


_KEY_SET = " WHERE package_key IN (SELECT package_key FROM popularity WHERE repo_count >= 3)"


@query("filter_key_set", oracle(POPULARITY_SQL + f" SELECT {_ROW} FROM fact" + _KEY_SET))
def _(spark, d):
    ix = fx.index(spark, d)
    keys = ix.popularity.where("repo_count >= 3").select("package_key").distinct()
    return ix.fact.join(keys, "package_key", "left_semi").select(*_ROW_COLUMNS)


@query(
    "semi_key_set",
    oracle(POPULARITY_SQL + f" SELECT {_ROW} FROM fact WHERE (ecosystem, package_key) IN "
           "(SELECT (ecosystem, package_key) FROM popularity WHERE version_count >= 5)"),
)
def _(spark, d):
    ix = fx.index(spark, d)
    return search.of_packages(ix.fact, ix.popularity.where("version_count >= 5")).select(*_ROW_COLUMNS)


# Bounds of the ranges in the watch list, written out by hand.
_WATCH = POPULARITY_SQL + ", watch AS (" + fx.WATCH_SQL.replace("{packages}", "popularity") + """),
bounds(version_range, op, key) AS (VALUES
  ('<2', '<', '0000!0000000002.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('>=4 <5', '>=', '0000!0000000004.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('>=4 <5', '<', '0000!0000000005.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('^3.17.0', '>=', '0000!0000000003.0000000017.0000000000.0000000000.0000000000.0000000000.~'),
  ('^3.17.0', '<', '0000!0000000004.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('~2.10', '>=', '0000!0000000002.0000000010.0000000000.0000000000.0000000000.0000000000.~'),
  ('~2.10', '<', '0000!0000000002.0000000011.0000000000.0000000000.0000000000.0000000000.~'),
  ('4.x', '>=', '0000!0000000004.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('4.x', '<', '0000!0000000005.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('=3.8.2', '=', '0000!0000000003.0000000008.0000000002.0000000000.0000000000.0000000000.~'),
  ('>1, <=6.30', '>', '0000!0000000001.0000000000.0000000000.0000000000.0000000000.0000000000.~'),
  ('>1, <=6.30', '<=', '0000!0000000006.0000000030.0000000000.0000000000.0000000000.0000000000.~'),
  ('1.2.3.4', '=', '0000!0000000001.0000000002.0000000003.0000000004.0000000000.0000000000.~')),
watched AS (
  SELECT f.*, w.version_range,
    f.version_sort_key IS NOT NULL AND (w.include_prereleases OR NOT f.is_prerelease) AND
    (SELECT bool_and(CASE b.op WHEN '<' THEN f.version_sort_key < b.key WHEN '<=' THEN f.version_sort_key <= b.key
       WHEN '>' THEN f.version_sort_key > b.key WHEN '>=' THEN f.version_sort_key >= b.key
       ELSE f.version_sort_key = b.key END) FROM bounds b WHERE b.version_range = w.version_range) AS hit
  FROM cur f JOIN watch w USING (ecosystem, package_key)),
rep AS (
  SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY ecosystem, package_key, repo_full_name
    ORDER BY version_sort_key DESC NULLS LAST, version_raw DESC, version_kind DESC) = 1),
best AS (
  SELECT * FROM watched WHERE hit QUALIFY row_number() OVER (PARTITION BY ecosystem, package_key, repo_full_name
    ORDER BY version_sort_key DESC, version_raw DESC, version_kind DESC) = 1)
"""


def _watch(spark, ix):
    return fx.watch_list(spark, ix.popularity)


@query(
    "satisfies_sql",
    oracle(_WATCH + "SELECT k.ecosystem, k.package_key, k.version_sort_key FROM (SELECT DISTINCT ecosystem, package_key, version_sort_key FROM cur "
           "WHERE version_sort_key IS NOT NULL) k JOIN watch w USING (ecosystem, package_key) WHERE (SELECT bool_and(CASE b.op "
           "WHEN '<' THEN k.version_sort_key < b.key WHEN '<=' THEN k.version_sort_key <= b.key WHEN '>' THEN k.version_sort_key > b.key "
           "WHEN '>=' THEN k.version_sort_key >= b.key ELSE k.version_sort_key = b.key END) FROM bounds b WHERE b.version_range = w.version_range)"),
)
def _(spark, d):
    """Distinct versions inside the watched ranges, by the SQL function."""
    sql.register(spark)
    ix = fx.index(spark, d)
    keys = ix.current.select("ecosystem", "package_key", "version_sort_key").distinct()
    watched = keys.join(_watch(spark, ix).select("ecosystem", "package_key", "version_range"), ["ecosystem", "package_key"])
    return watched.where(F.expr("satisfies(version_sort_key, version_range)")).drop("version_range")


@query(
    "parse_version_range",
    oracle(_WATCH + "SELECT w.ecosystem, w.package_key, b.op, b.key FROM watch w JOIN bounds b USING (version_range)"),
)
def _(spark, d):
    watch = _watch(spark, fx.index(spark, d))
    return watch.select(
        "ecosystem", "package_key", F.explode(range_comparators(F.col("version_range"))).alias("c")
    ).select("ecosystem", "package_key", "c.op", "c.key")


@query("filter_version_range", oracle(_WATCH + f"SELECT {_ROW}, version_range FROM watched WHERE hit"))
def _(spark, d):
    ix = fx.index(spark, d)
    return search._matched(ix.current, _watch(spark, ix)).where("hit").select(*_ROW_COLUMNS, "version_range")


@query(
    "filter_version_range_literal",
    oracle(f"SELECT {_ROW} FROM fact WHERE version_sort_key >= '0000!0000000002.' AND NOT is_prerelease AND "
           "version_sort_key < '0000!0000000005.0000000010.0000000000.0000000000.0000000000.0000000000.~'"),
)
def _(spark, d):
    return search.in_range(fx.index(spark, d).fact, ">=2 <5.10").select(*_ROW_COLUMNS)


# ---- version functions --------------------------------------------------------------


@query(
    "percent_decode",
    "WITH lines AS (" + fx.for_duckdb(fx.LINES_SQL) + ") SELECT version_enc, url_decode(version_enc) AS decoded, "
    "url_decode(concat(name_enc, '%zz+')) AS name FROM lines",
)
def _(spark, d):
    return fx.lines(spark, d).select(
        "version_enc",
        percent_decode(F.col("version_enc")).alias("decoded"),
        percent_decode(F.concat("name_enc", F.lit("%zz+"))).alias("name"),
    )


@query("is_range_or_wildcard", oracle("SELECT version_raw, is_range, count(*) AS n FROM kinded GROUP BY ALL"))
def _(spark, d):
    text = F.btrim(percent_decode(F.col("version_raw")))
    return fx.index(spark, d).fact.groupBy("version_raw", is_range_or_wildcard(text).alias("is_range")).agg(
        F.count("*").alias("n")
    )


@query(
    "is_sha",
    "SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 1 + CAST(event_id % 12 AS INT)) AS v, "
    "regexp_full_match(substr(md5(CAST(event_id AS VARCHAR)), 1, 1 + CAST(event_id % 12 AS INT)), '[0-9a-f]{7,40}') AND NOT "
    "regexp_full_match(substr(md5(CAST(event_id AS VARCHAR)), 1, 1 + CAST(event_id % 12 AS INT)), '[0-9]+') AS hash FROM events",
)
def _(spark, d):
    text = F.substring(F.md5(F.col("event_id").cast("string")), F.lit(1), (F.col("event_id") % 12 + 1).cast("int"))
    return fx.table(spark, d, "events").select("event_id", text.alias("v")).withColumn("hash", is_sha(F.col("v")))


_VERSIONED = "ecosystem, version_raw, version_kind, comparable, exact_scheme, version_sort_key, epoch, is_prerelease"


@query("normalize_version", oracle(f"SELECT {_VERSIONED}, count(*) AS n FROM fact GROUP BY ALL"))
def _(spark, d):
    """Classified from the raw text again, not read from the stored columns."""
    raw = fx.index(spark, d).fact.groupBy("ecosystem", "version_raw").agg(F.count("*").alias("n"))
    return with_version_columns(raw).select(*_VERSIONED.split(", "), "n")


def _scheme_query(name, ecosystems):
    listed = ", ".join(f"'{e}'" for e in ecosystems)

    @query(
        name,
        oracle(f"SELECT version_raw, version_kind, is_prerelease, epoch, version_sort_key, count(*) AS n FROM fact "
               f"WHERE ecosystem IN ({listed}) GROUP BY ALL"),
    )
    def _(spark, d):
        raw = fx.index(spark, d).fact.where(F.col("ecosystem").isin(*ecosystems))
        counted = raw.groupBy("ecosystem", "version_raw").agg(F.count("*").alias("m"))
        return (
            with_version_columns(counted)
            .groupBy("version_raw", "version_kind", "is_prerelease", "epoch", "version_sort_key")
            .agg(F.sum("m").alias("n"))
        )


_scheme_query("parse_semver", ("npm", "nuget", "golang"))
_scheme_query("parse_pypi", ("pypi",))
_scheme_query("parse_gem", ("gem",))
_scheme_query("parse_maven", ("maven",))


@query(
    "version_sort_key",
    oracle("SELECT ecosystem, package_key, version_raw, version_sort_key, rank() OVER (PARTITION BY ecosystem, package_key "
           "ORDER BY version_sort_key) AS pos FROM (SELECT DISTINCT ecosystem, package_key, version_raw, version_sort_key "
           "FROM fact WHERE comparable) v"),
)
def _(spark, d):
    versions = fx.index(spark, d).fact.where("comparable").select(
        "ecosystem", "package_key", "version_raw", "version_sort_key"
    ).distinct()
    order = Window.partitionBy("ecosystem", "package_key").orderBy("version_sort_key")
    return versions.withColumn("pos", F.rank().over(order).cast("bigint"))


# ---- search -------------------------------------------------------------------------

_REP = "ecosystem, package_key, repo_full_name, version_raw, version_kind, version_sort_key"


@query("win_rep_version", oracle(_WATCH + f"SELECT {_REP} FROM rep"))
def _(spark, d):
    return search.representative_versions(fx.index(spark, d).current)


@query("win_best_match", oracle(_WATCH + f"SELECT {_REP} FROM best"))
def _(spark, d):
    ix = fx.index(spark, d)
    return search.best_matches(ix.current, _watch(spark, ix))


_TOP_VERSIONS = (
    "SELECT ecosystem, package_key, version_raw, repos, pos FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, "
    "package_key ORDER BY repos DESC, version_raw DESC) AS pos FROM (SELECT ecosystem, package_key, version_raw, "
    "count(DISTINCT repo_full_name) AS repos FROM fact GROUP BY ALL) g) r WHERE pos <= 10"
)


@query("agg_top_versions", oracle(_TOP_VERSIONS))
def _(spark, d):
    return search.top_versions(fx.index(spark, d).fact).withColumnRenamed("rank", "pos").withColumns(big("pos"))


_EXCLUDED = (
    "count(*) FILTER (version_sort_key IS NULL AND version_kind = 'range') AS declared_range, "
    "count(*) FILTER (version_sort_key IS NULL AND version_kind = 'empty') AS empty_version, "
    "count(*) FILTER (version_sort_key IS NULL AND version_kind NOT IN ('range', 'empty')) AS other_noncomparable"
)


@query("agg_excluded_kinds", oracle(_WATCH + f"SELECT ecosystem, package_key, {_EXCLUDED} FROM rep GROUP BY ALL"))
def _(spark, d):
    return search.excluded_kinds(fx.index(spark, d).current)


@query(
    "agg_total_repos",
    oracle("SELECT ecosystem, package_key, count(DISTINCT repo_full_name) AS total_repo_count FROM fact GROUP BY ALL"),
)
def _(spark, d):
    return search.total_repos(fx.index(spark, d).fact)


@query(
    "agg_ecosystem_breakdown",
    oracle(POPULARITY_SQL + " SELECT ecosystem, package_name, repo_count FROM popularity WHERE package_key = 'express'"),
)
def _(spark, d):
    return search.ecosystem_breakdown(fx.index(spark, d).popularity, "Express")


_SUMMARY = (
    _WATCH + f", totals AS (SELECT ecosystem, package_key, count(*) AS total_repo_count, {_EXCLUDED} FROM rep GROUP BY ALL), "
    "matched AS (SELECT ecosystem, package_key, count(*) AS m FROM best GROUP BY ALL) "
    "SELECT w.ecosystem, w.package_key, w.version_range, "
    "CASE WHEN w.version_range NOT IN (SELECT version_range FROM bounds) THEN 'unreadable version range' END AS error, "
    "coalesce(t.total_repo_count, 0) AS total_repo_count, "
    "CASE WHEN w.version_range IN (SELECT version_range FROM bounds) THEN coalesce(m.m, 0) END AS matched_repo_count, "
    "coalesce(t.declared_range, 0) AS declared_range, coalesce(t.empty_version, 0) AS empty_version, "
    "coalesce(t.other_noncomparable, 0) AS other_noncomparable, "
    "w.ecosystem NOT IN ('maven', 'github', 'githubactions') AS range_exact "
    "FROM watch w LEFT JOIN totals t USING (ecosystem, package_key) LEFT JOIN matched m USING (ecosystem, package_key)"
)


@query("search_dependency", oracle(_SUMMARY))
def search_dependency(spark, d):
    ix = fx.index(spark, d)
    return search.search_summary(ix.current, _watch(spark, ix))


def _page_sql(source, offset, limit):
    return (
        f"SELECT ecosystem, package_key, repo_full_name, split_part(repo_full_name, '/', 1) AS org, "
        "split_part(repo_full_name, '/', 2) AS repo, 'https://github.com/' || repo_full_name AS repo_url, "
        f"version_raw AS version, version_kind, pos, CASE WHEN n > {offset + limit} THEN {offset + limit} END::BIGINT AS next_offset "
        "FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, package_key ORDER BY version_sort_key DESC NULLS LAST, "
        f"repo_full_name) AS pos, count(*) OVER (PARTITION BY ecosystem, package_key) AS n FROM {source}) p "
        f"WHERE pos > {offset} AND pos <= {offset + limit}"
    )


@query("search_dependency_page", oracle(_WATCH + _page_sql("best", 0, 200)))
def _(spark, d):
    ix = fx.index(spark, d)
    best = search.best_matches(ix.current, _watch(spark, ix))
    return search.page(best).withColumnRenamed("rank", "pos").withColumns(big("pos"))


@query("page_offset_limit", oracle(_WATCH + _page_sql("rep", 2, 3)))
def _(spark, d):
    rep = search.representative_versions(fx.index(spark, d).current)
    return search.page(rep, limit=3, offset=2).withColumnRenamed("rank", "pos").withColumns(big("pos"))


@query(
    "sort_nulls_last",
    oracle(_WATCH + "SELECT repo_full_name, version_raw, row_number() OVER (ORDER BY version_sort_key DESC NULLS LAST, "
           "repo_full_name) AS pos FROM rep WHERE ecosystem = 'npm' AND package_key = 'express' ORDER BY pos LIMIT 500"),
)
def _(spark, d):
    rows = search.of_package(fx.index(spark, d).current, "npm", "express")
    page = search.page_one(search.representative_versions(rows), limit=500)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("version_sort_key"), "repo_full_name")
    return page.select("repo_full_name", "version_raw", F.row_number().over(order).cast("bigint").alias("pos"))


# Repository names as people write them: some in capitals, some with an accent.
_WRITTEN = "CASE ascii(right(repo_full_name, 1)) % 3 WHEN 0 THEN upper(repo_full_name) WHEN 1 THEN replace(repo_full_name, 'a', 'ä') ELSE repo_full_name END"


@query(
    "page_collated",
    oracle(_WATCH + "SELECT ecosystem, package_key, repo_full_name, version, pos FROM (SELECT ecosystem, package_key, repo_full_name, "
           "version_raw AS version, row_number() OVER (PARTITION BY ecosystem, package_key ORDER BY version_sort_key DESC NULLS LAST, "
           f"repo_full_name COLLATE en, repo_full_name) AS pos FROM (SELECT * REPLACE ({_WRITTEN} AS repo_full_name) FROM rep) w) p WHERE pos <= 50"),
)
def _(spark, d):
    rep = search.representative_versions(fx.index(spark, d).current).withColumn("repo_full_name", F.expr(_WRITTEN))
    page = search.page(rep, limit=50, collation="UNICODE").withColumnRenamed("rank", "pos")
    return page.select("ecosystem", "package_key", "repo_full_name", "version", F.col("pos").cast("bigint").alias("pos"))


@query(
    "page_keyset",
    oracle(_WATCH + "SELECT repo_full_name, version_raw, pos - 5 AS pos FROM (SELECT *, row_number() OVER (ORDER BY version_sort_key "
           "DESC NULLS LAST, repo_full_name) AS pos FROM rep SEMI JOIN (SELECT ecosystem, package_key FROM popularity "
           "ORDER BY repo_count DESC, ecosystem, package_key LIMIT 1) most USING (ecosystem, package_key)) r WHERE pos > 5 AND pos <= 25"),
)
def _(spark, d):
    """The second page of the most used package."""
    ix, path = fx.index(spark, d), run_path(spark, "pages")
    pages.write_order(search.representative_versions(ix.current), path)
    most = ix.popularity.orderBy(F.desc("repo_count"), "ecosystem", "package_key").select("ecosystem", "package_key").first()
    first = pages.page_after(spark, path, *most, limit=5)
    second = pages.page_after(spark, path, *most, pages.cursor_of(first), limit=20)
    order = Window.partitionBy(F.lit(1)).orderBy(*search.page_order())  # 20 rows
    return second.select("repo_full_name", "version_raw", F.row_number().over(order).cast("bigint").alias("pos"))


# ---- summaries and lists ------------------------------------------------------------


@query("agg_pkg_popularity", oracle(POPULARITY_SQL + " SELECT * FROM popularity"))
def _(spark, d):
    return summaries.pkg_popularity(fx.index(spark, d).current)


@query(
    "agg_pkg_popularity_all_snapshots",
    oracle("SELECT ecosystem, package_key, min(package_name) AS package_name, count(DISTINCT repo_full_name) AS repo_count, "
           "count(DISTINCT version_raw) AS version_count FROM fact WHERE NOT is_self_ref AND NOT is_action GROUP BY ALL"),
)
def _(spark, d):
    return summaries.pkg_popularity(fx.index(spark, d).fact)


_ROLLUP = (
    "SELECT ecosystem, coalesce(license_id, 'UNKNOWN') AS license_id, count(DISTINCT repo_full_name) AS repo_count, "
    "count(*) AS occurrence_count FROM {} WHERE NOT is_self_ref AND NOT is_action GROUP BY 1, 2"
)


@query("agg_license_rollup", oracle(_ROLLUP.format("fact")))
def _(spark, d):
    return summaries.license_rollup(fx.index(spark, d).fact)


@query(
    "agg_repo_rollup",
    oracle("SELECT repo_full_name, min(org) AS org, min(repo) AS repo, min(repo_url) AS repo_url, "
           "strftime(max(pushed_at), '%Y-%m-%d') AS pushed_on, count(*) AS dep_count FROM fact GROUP BY repo_full_name"),
)
def _(spark, d):
    rolled = summaries.repo_rollup(fx.index(spark, d).fact)
    return rolled.withColumn("pushed_on", F.to_date("pushed_at").cast("string")).drop("pushed_at")


@query(
    "dependencies_by_repo",
    oracle("SELECT repo_full_name, ecosystem, package_name, package_key, version_raw, version_kind, license_id FROM cur"),
)
def _(spark, d):
    return fx.index(spark, d).by_repo.drop("version_sort_key", "is_prerelease")


@query(
    "sink_build_stats",
    oracle('SELECT count(*) AS "rows", count(DISTINCT repo_full_name) AS repos, count(*) FILTER (comparable) AS comparable, '
           "floor(count(*) FILTER (comparable) * 1000.0 / count(*) + 0.5) / 10 AS comparable_pct, "
           + ", ".join(f"(SELECT string_agg(name || ':' || n, ',' ORDER BY n DESC, name) FROM (SELECT {c} AS name, count(*) AS n FROM fact "
                       f"GROUP BY 1 ORDER BY 2 DESC, 1{cut}) x) AS {o}" for c, cut, o in (
                           ("ecosystem", "", "ecosystems"), ("version_kind", "", "kinds"), ("ecosystem", " LIMIT 8", "top_ecosystems")))
           + " FROM fact"),
)
def _(spark, d):
    stats = summaries.build_stats(fx.index(spark, d).fact)
    listed = {c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit(":"), e["rows"])), ",") for c in ("ecosystems", "kinds", "top_ecosystems")}
    return stats.withColumns(listed)


@query(
    "build_stats_top_ecosystems",
    oracle('SELECT ecosystem, count(*) AS "rows" FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8'),
)
def _(spark, d):
    return summaries.rows_per(fx.index(spark, d).fact, "ecosystem", top=8)


@query("build_stats_kinds", oracle('SELECT version_kind, count(*) AS "rows" FROM fact GROUP BY 1'))
def _(spark, d):
    return summaries.rows_per(fx.index(spark, d).fact, "version_kind")


@query(
    "topk_popularity",
    oracle(POPULARITY_SQL + " SELECT * FROM popularity ORDER BY repo_count DESC, package_key, ecosystem LIMIT 50"),
)
def _(spark, d):
    return listing.top_packages(fx.index(spark, d).popularity)


@query(
    "topk_license",
    oracle(f"SELECT * FROM ({_ROLLUP.format('cur')}) r WHERE license_id = 'MIT' ORDER BY repo_count DESC, ecosystem LIMIT 50"),
)
def _(spark, d):
    return listing.top_licenses(fx.index(spark, d).license_rollup, "MIT")


@query(
    "package_popularity",
    oracle(POPULARITY_SQL + " SELECT * FROM popularity WHERE ecosystem = 'npm' AND contains(package_key, 'bolt') "
           "ORDER BY repo_count DESC, package_key, ecosystem LIMIT 999"),
)
def _(spark, d):
    ix = fx.index(spark, d)
    return listing.package_popularity(ix.popularity, ix.license_rollup, ecosystem="npm", contains="Bolt", top=999)


def _listing_sql(limit, where="TRUE"):
    return (
        "SELECT repo_full_name, ecosystem, package_name, version_raw, version_kind, license_id, pos, "
        f"n AS dependency_count, least(n, {limit}) AS returned, n > {limit} AS truncated FROM (SELECT *, row_number() OVER "
        "(PARTITION BY repo_full_name ORDER BY ecosystem, package_name, version_raw, license_id NULLS FIRST) AS pos, "
        f"count(*) OVER (PARTITION BY repo_full_name) AS n FROM cur WHERE {where}) l WHERE pos <= {limit}"
    )


# Rows that agree in everything listed may swap places, which the listing cannot show.
@query("list_repo_dependencies", oracle(_listing_sql(5)))
def _(spark, d):
    listed = listing.repo_dependencies(fx.index(spark, d).by_repo, limit=5)
    return listed.withColumnRenamed("rank", "pos").withColumns(big("pos"))


@query("repo_dependencies", oracle(_listing_sql(500, "ecosystem = 'npm'")))
def _(spark, d):
    listed = listing.repo_dependencies(fx.index(spark, d).by_repo, ecosystem="npm")
    return listed.withColumnRenamed("rank", "pos").withColumns(big("pos"))


@query(
    "sbom_export",
    oracle("SELECT repo_full_name, ecosystem, package_name, version_raw, version_kind, license_id, "
           "count(*) OVER (PARTITION BY repo_full_name) AS dependency_count, count(*) OVER (PARTITION BY repo_full_name) AS returned, "
           "FALSE AS truncated, 'https://sbom.example.org/' || repo_full_name || '.json.gz' AS sbom_source_url FROM cur"),
)
def _(spark, d):
    return listing.sbom_export(fx.index(spark, d).by_repo, fx.SBOM_BASE_URL)


@query(
    "agg_by_ecosystem_counts",
    oracle(f"SELECT repo_full_name, ecosystem, count(*) AS dependencies FROM ({_listing_sql(5)}) l GROUP BY ALL"),
)
def _(spark, d):
    return listing.counts_by_ecosystem(listing.repo_dependencies(fx.index(spark, d).by_repo, limit=5))


@query(
    "win_total_over",
    oracle("SELECT DISTINCT repo_full_name, count(*) OVER (PARTITION BY repo_full_name) AS total FROM cur"),
)
def _(spark, d):
    listed = listing.repo_dependencies(fx.index(spark, d).by_repo, limit=1)
    return listed.select("repo_full_name", F.col("dependency_count").alias("total"))


@query(
    "sbom_url",
    oracle("SELECT DISTINCT repo_full_name, 'https://sbom.example.org/' || org || '/' || repo || '.json.gz' AS sbom_url FROM fact"),
)
def _(spark, d):
    url = listing.sbom_source_url(fx.SBOM_BASE_URL, F.col("org"), F.col("repo"))
    return fx.index(spark, d).fact.select("repo_full_name", url.alias("sbom_url")).distinct()


# ---- exposure -----------------------------------------------------------------------

_ADVISED = ", adv AS MATERIALIZED (" + fx.for_duckdb(fx.ADVISORIES_SQL) + """),
affected AS (
  SELECT *, CASE advisory_ecosystem WHEN 'npm' THEN 'npm' WHEN 'PyPI' THEN 'pypi' WHEN 'RubyGems' THEN 'gem'
      WHEN 'Maven' THEN 'maven' WHEN 'NuGet' THEN 'nuget' WHEN 'Go' THEN 'golang' END AS ecosystem,
    CASE introduced WHEN '1.5' THEN '0000!0000000001.0000000005.0000000000.0000000000.0000000000.0000000000.~' END AS lo,
    CASE WHEN fixed = '4.20.1' THEN '0000!0000000004.0000000020.0000000001.0000000000.0000000000.0000000000.~'
         WHEN fixed IS NOT NULL THEN '0000!' || lpad(split_part(fixed, '.', 1), 10, '0') ||
           '.0000000000.0000000000.0000000000.0000000000.0000000000.~' END AS hi
  FROM adv),
keyed AS (
  SELECT *, CASE ecosystem WHEN 'pypi' THEN lower(regexp_replace(advisory_package, '[-_.]+', '-', 'g'))
    WHEN 'maven' THEN lower(replace(advisory_package, ':', '/')) ELSE lower(advisory_package) END AS package_key
  FROM affected WHERE ecosystem IS NOT NULL),
ids AS MATERIALIZED (
  SELECT DISTINCT ecosystem, package_key, version_raw, version_sort_key FROM cur
  WHERE version_kind IN ('release', 'prerelease')),
hits AS MATERIALIZED (
  SELECT DISTINCT i.ecosystem, i.package_key, i.version_raw, k.id FROM ids i JOIN keyed k USING (ecosystem, package_key)
  WHERE i.version_raw = k.exact_version
    OR (k.fixed IS NOT NULL AND (k.lo IS NULL OR i.version_sort_key >= k.lo) AND i.version_sort_key < k.hi)
    OR (k.last_affected IS NOT NULL
      AND i.version_sort_key >= '0000!0000000006.0000000002.0000000000.0000000000.0000000000.0000000000.~'
      AND i.version_sort_key <= '0000!0000000006.0000000040.0000000000.0000000000.0000000000.0000000000.~')),
details AS (
  SELECT id, cve_alias AS cve, left(coalesce(nullif(summary, ''), details), 200) AS summary,
    coalesce(upper(own_severity), score, 'UNKNOWN') AS severity, 'https://osv.dev/vulnerability/' || id AS url FROM adv)
"""


def _scope_sql(by):
    lead = "".join(f"{c}, " for c in by)
    n = "1::BIGINT" if "repo_full_name" in by else "count(DISTINCT repo_full_name)"
    return (
        f"SELECT {lead}ecosystem, package_key, version_raw, min(package_name) AS package_name, {n} AS n FROM cur "
        f"WHERE version_kind IN ('release', 'prerelease') GROUP BY {lead}ecosystem, package_key, version_raw"
    )


def _scoped(name, by):
    @query(name, oracle(_scope_sql(by)))
    def _(spark, d):
        return exposure.scope(_with_org(fx.index(spark, d).current), by).drop("version_sort_key")


def _with_org(fact):
    return fact.withColumn("org", exposure.org_of())


_scoped("agg_vuln_scope_package", [])
_scoped("agg_vuln_scope_repo", ["repo_full_name"])
_scoped("agg_vuln_scope_org", ["org"])


@query("dedup_identities", oracle(_ADVISED + "SELECT ecosystem, package_key, version_raw FROM ids"))
def _(spark, d):
    return exposure.identities(exposure.scope(fx.index(spark, d).current)).drop("version_sort_key")


@query("join_vuln_exposure", oracle(_ADVISED + "SELECT * FROM hits"))
def _(spark, d):
    ids = exposure.identities(exposure.scope(fx.index(spark, d).current))
    return exposure.exposed(ids, fx.advisories(spark, d))


@query("join_vuln_details", "WITH adv AS (" + fx.for_duckdb(fx.ADVISORIES_SQL) + ") SELECT id, cve_alias AS cve, "
       "left(coalesce(nullif(summary, ''), details), 200) AS summary, coalesce(upper(own_severity), score, 'UNKNOWN') AS severity, "
       "'https://osv.dev/vulnerability/' || id AS url FROM adv")
def _(spark, d):
    return refdata.advisory_details(fx.advisories(spark, d))


@query(
    "src_refdata_advisories",
    "WITH " + fx.FACT_SQL + _ADVISED + "SELECT id, ecosystem, package_key, introduced, fixed, NULL AS last_affected, NULL AS exact_version "
    "FROM keyed WHERE fixed IS NOT NULL UNION ALL SELECT id, ecosystem, package_key, introduced_again, NULL, last_affected, NULL FROM keyed "
    "WHERE last_affected IS NOT NULL UNION ALL SELECT id, ecosystem, package_key, NULL, NULL, NULL, exact_version FROM keyed WHERE exact_version IS NOT NULL",
)
def _(spark, d):
    advisories = fx.advisories(spark, d)
    exact = refdata.affected_versions(advisories).withColumnRenamed("version_raw", "exact_version")
    return refdata.affected_spans(advisories).unionByName(exact, allowMissingColumns=True)


@query(
    "src_refdata_unmapped",
    "WITH adv AS (" + fx.for_duckdb(fx.ADVISORIES_SQL) + ") SELECT advisory_ecosystem, count(*) AS entries FROM adv "
    "WHERE advisory_ecosystem = 'Elsewhere' GROUP BY 1",
)
def _(spark, d):
    return refdata.unmapped_packages(fx.advisories(spark, d))


def _exposure(name, by):
    lead = "".join(f"s.{c}, " for c in by)

    @query(
        name,
        oracle(_ADVISED + f"SELECT {lead}s.ecosystem, s.package_key, s.package_name AS package, s.version_raw AS version, "
               "s.n AS affected_repo_count, h.id, e.cve, e.severity, e.summary, e.url FROM ("
               + _scope_sql(by) + ") s JOIN hits h USING (ecosystem, package_key, version_raw) JOIN details e ON e.id = h.id"),
    )
    def _(spark, d):
        return exposure.findings(_with_org(fx.index(spark, d).current), fx.advisories(spark, d), by)


_exposure("vulnerability_exposure", [])
_exposure("vulnerability_exposure_repo", ["repo_full_name"])
_exposure("vulnerability_exposure_org", ["org"])


@query(
    "cap_findings",
    oracle(_ADVISED + ", vulnerable AS (SELECT s.*, h.advisory_count, h.first_id FROM (" + _scope_sql(["org"]) + ") s JOIN "
           "(SELECT ecosystem, package_key, version_raw, count(*) AS advisory_count, min(id) AS first_id FROM hits GROUP BY ALL) h "
           "USING (ecosystem, package_key, version_raw)), pairs AS (SELECT DISTINCT org, ecosystem, package_key, version_raw, "
           "repo_full_name FROM cur WHERE version_kind IN ('release', 'prerelease')), samples AS (SELECT org, ecosystem, "
           "package_key, version_raw, string_agg(repo_full_name, ',' ORDER BY repo_full_name) AS repos FROM (SELECT *, "
           "row_number() OVER (PARTITION BY org, ecosystem, package_key, version_raw ORDER BY repo_full_name) AS r FROM pairs) p "
           "WHERE r <= 25 GROUP BY ALL) SELECT v.org, v.ecosystem, v.package_key, v.version_raw, v.package_name, "
           "v.n AS affected_repo_count, v.advisory_count, v.first_id, v.vulnerable_versions, s.repos FROM (SELECT *, count(*) OVER "
           "(PARTITION BY org) AS vulnerable_versions, row_number() OVER (PARTITION BY org ORDER BY n DESC, ecosystem, package_key, "
           "version_raw) AS r FROM vulnerable) v JOIN samples s USING (org, ecosystem, package_key, version_raw) WHERE r <= 200"),
)
def _(spark, d):
    report = exposure.exposure_report(_with_org(fx.index(spark, d).current), fx.advisories(spark, d), ["org"])
    return report.withColumn("repos", F.array_join("repos_sample", ",")).drop("repos_sample")


# ---- end of life and landscape ------------------------------------------------------

_EOL = ", cycles AS MATERIALIZED (" + fx.for_duckdb(fx.EOL_SQL) + """),
products(ecosystem, package_key, product) AS (VALUES ('pypi', 'django', 'django'), ('gem', 'rails', 'rails'),
  ('npm', '@angular/core', 'angular'), ('npm', 'vue', 'vue'), ('npm', 'express', 'express'), ('npm', 'next', 'nextjs'),
  ('maven', 'org.springframework/spring-core', 'spring-framework')),
versions AS MATERIALIZED (SELECT DISTINCT p.product, f.ecosystem, f.package_key, f.version_raw FROM fact f JOIN products p USING (ecosystem, package_key)
  WHERE f.version_raw <> ''),
matched AS MATERIALIZED (SELECT v.*, c.cycle, c.eol,
    CASE WHEN c.cycle IS NULL THEN NULL WHEN c.eol = 'true' THEN TRUE WHEN c.eol IS NULL OR c.eol = 'false' THEN FALSE
      ELSE TRY_CAST(c.eol AS TIMESTAMP) < TIMESTAMP '2000-06-01' END AS is_eol
  FROM versions v LEFT JOIN cycles c ON c.product = v.product
    AND (v.version_raw = c.cycle OR starts_with(v.version_raw, c.cycle || '.'))
  QUALIFY row_number() OVER (PARTITION BY v.product, v.version_raw ORDER BY length(c.cycle) DESC NULLS LAST, c.cycle DESC) = 1)
"""


@query("join_eol_prefix", oracle(_EOL + "SELECT product, version_raw, cycle, eol, is_eol FROM matched"))
def _(spark, d):
    versions = fx.index(spark, d).fact.select("ecosystem", "package_key", "version_raw").distinct()
    status = eol.eol_status(versions, fx.eol_cycles(spark, d), as_of())
    return status.select("product", "version_raw", "cycle", "eol", "is_eol")


@query(
    "eol_product",
    oracle(_EOL + "SELECT p.product, count(*) AS n FROM fact f JOIN products p USING (ecosystem, package_key) GROUP BY 1"),
)
def _(spark, d):
    product = refdata.eol_product(F.col("ecosystem"), F.col("package_key"))
    return fx.index(spark, d).fact.select(product.alias("product")).where("product IS NOT NULL").groupBy("product").agg(
        F.count("*").alias("n")
    )


@query(
    "is_eol",
    "SELECT product, cycle, eol, CASE WHEN eol = 'true' THEN TRUE WHEN eol IS NULL OR eol = 'false' THEN FALSE "
    "ELSE TRY_CAST(eol AS TIMESTAMP) < TIMESTAMP '2000-06-01' END AS is_eol FROM (" + fx.for_duckdb(fx.EOL_SQL) + ") c",
)
def _(spark, d):
    return fx.eol_cycles(spark, d).select("product", "cycle", "eol", eol.is_eol(F.col("eol"), as_of()).alias("is_eol"))


@query(
    "src_refdata_eol",
    "SELECT product, cycle, eol, latest FROM (" + fx.for_duckdb(fx.EOL_SQL) + ") c",
)
def _(spark, d):
    return fx.eol_cycles(spark, d)


@query(
    "agg_landscape_eol",
    oracle(_EOL + "SELECT f.org, min(f.package_name) AS package, f.version_raw AS version, "
           "count(DISTINCT f.repo_full_name) AS repos, m.eol AS eol_date, m.product FROM cur f JOIN products p USING (ecosystem, package_key) "
           "JOIN matched m ON m.product = p.product AND m.version_raw = f.version_raw WHERE f.version_kind = 'release' AND m.is_eol "
           "GROUP BY f.org, f.ecosystem, f.package_key, f.version_raw, m.eol, m.product"),
)
def _(spark, d):
    return landscape.org_eol_frameworks(fx.index(spark, d).by_repo, fx.eol_cycles(spark, d), as_of())


@query(
    "agg_landscape_ecosystems",
    oracle("SELECT org, ecosystem, count(DISTINCT repo_full_name) AS repos, count(*) AS dependencies FROM cur GROUP BY ALL"),
)
def _(spark, d):
    return landscape.org_ecosystems(fx.index(spark, d).by_repo)


@query("agg_landscape_repo_count", oracle("SELECT org, count(DISTINCT repo_full_name) AS repo_count FROM cur GROUP BY ALL"))
def _(spark, d):
    return landscape.org_repo_count(fx.index(spark, d).by_repo)


@query(
    "agg_landscape_top_packages",
    oracle("SELECT org, ecosystem, package_name, repos, pos FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY repos DESC, "
           "ecosystem, package_name) AS pos FROM (SELECT org, ecosystem, package_name, count(DISTINCT repo_full_name) AS repos "
           "FROM cur WHERE ecosystem NOT IN ('github', 'githubactions') GROUP BY ALL) g) r WHERE pos <= 25"),
)
def _(spark, d):
    top = landscape.org_top_packages(fx.index(spark, d).by_repo)
    return top.withColumnRenamed("rank", "pos").withColumns(big("pos"))


_COPYLEFT = "regexp_matches(license_id, '(?i)^(a?gpl|lgpl|mpl|epl|cddl|eupl|osl|cecill)')"


@query(
    "agg_landscape_licences",
    oracle(f"SELECT org, count(*) FILTER ({_COPYLEFT}) AS copyleft_occurrences, "
           "count(*) FILTER (license_id IS NULL OR license_id IN ('NONE', 'NOASSERTION')) AS unknown_or_missing FROM cur GROUP BY org"),
)
def _(spark, d):
    return landscape.org_licence_summary(fx.index(spark, d).by_repo)


@query(
    "agg_landscape_top_licences",
    oracle("SELECT org, licence, occurrences, pos FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY occurrences DESC, licence) "
           "AS pos FROM (SELECT org, coalesce(license_id, 'NONE') AS licence, count(*) AS occurrences FROM cur GROUP BY 1, 2) g) r "
           "WHERE pos <= 8"),
)
def _(spark, d):
    top = landscape.org_top_licences(fx.index(spark, d).by_repo)
    return top.withColumnRenamed("rank", "pos").withColumns(big("pos"))


@query("is_copyleft", oracle(f"SELECT license_id, {_COPYLEFT} AS copyleft, count(*) AS n FROM fact GROUP BY ALL"))
def _(spark, d):
    return fx.index(spark, d).fact.groupBy("license_id", is_copyleft(F.col("license_id")).alias("copyleft")).agg(
        F.count("*").alias("n")
    )


@query(
    "dependency_landscape",
    oracle("SELECT org, repo_count, copyleft_occurrences, unknown_or_missing, ecosystems, dependencies FROM (SELECT org, "
           f"count(DISTINCT repo_full_name) AS repo_count, count(*) FILTER ({_COPYLEFT}) AS copyleft_occurrences, "
           "count(*) FILTER (license_id IS NULL OR license_id IN ('NONE', 'NOASSERTION')) AS unknown_or_missing, "
           "count(DISTINCT ecosystem) AS ecosystems, count(*) AS dependencies FROM cur GROUP BY org) o"),
)
def _(spark, d):
    rows = fx.index(spark, d).by_repo
    ecosystems = landscape.org_ecosystems(rows).groupBy("org").agg(
        F.count("*").alias("ecosystems"), F.sum("dependencies").alias("dependencies")
    )
    return landscape.org_repo_count(rows).join(landscape.org_licence_summary(rows), "org").join(ecosystems, "org")


_LARGEST = "SELECT org FROM cur GROUP BY org ORDER BY count(*) DESC, org LIMIT 1"


@query(
    "dependency_landscape_org",
    oracle(_EOL + f", own AS (SELECT * FROM cur WHERE org = ({_LARGEST})) "
           "SELECT 'repo_count' AS part, min(org) AS name, count(DISTINCT repo_full_name) AS n, NULL::BIGINT AS pos FROM own "
           "UNION ALL SELECT 'ecosystems', ecosystem, count(*), NULL FROM own GROUP BY ecosystem "
           "UNION ALL SELECT 'top_packages', ecosystem || ':' || package_name, repos, pos FROM (SELECT *, row_number() OVER (ORDER BY repos DESC, "
           "ecosystem, package_name) AS pos FROM (SELECT ecosystem, package_name, count(DISTINCT repo_full_name) AS repos FROM own "
           "WHERE ecosystem NOT IN ('github', 'githubactions') GROUP BY ALL) g) r WHERE pos <= 25 "
           f"UNION ALL SELECT 'licence_summary', 'copyleft', count(*) FILTER ({_COPYLEFT}), NULL FROM own "
           "UNION ALL SELECT 'licence_summary', 'unknown', count(*) FILTER (license_id IS NULL OR license_id IN ('NONE', 'NOASSERTION')), NULL FROM own "
           "UNION ALL SELECT 'top_licences', licence, occurrences, pos FROM (SELECT *, row_number() OVER (ORDER BY occurrences DESC, licence) AS pos "
           "FROM (SELECT coalesce(license_id, 'NONE') AS licence, count(*) AS occurrences FROM own GROUP BY 1) g) r WHERE pos <= 8 "
           "UNION ALL SELECT 'eol_frameworks', min(f.package_name) || '@' || f.version_raw, count(DISTINCT f.repo_full_name), NULL FROM own f "
           "JOIN products p USING (ecosystem, package_key) JOIN matched m ON m.product = p.product AND m.version_raw = f.version_raw "
           "WHERE f.version_kind = 'release' AND m.is_eol GROUP BY f.ecosystem, f.package_key, f.version_raw, m.eol, m.product"),
)
def _(spark, d):
    """All parts of the profile of the organisation with most dependencies."""
    ix = fx.index(spark, d)
    org = ix.by_repo.groupBy(F.split_part("repo_full_name", F.lit("/"), F.lit(1)).alias("org")).count().orderBy(F.desc("count"), "org").first()["org"]
    parts = landscape.dependency_landscape(ix.by_repo, org, fx.eol_cycles(spark, d), as_of())
    none = F.lit(None).cast("bigint")

    def part(name, label, n, pos=none):
        return parts[name].select(F.lit(name).alias("part"), label.alias("name"), F.col(n).cast("bigint").alias("n"), pos.cast("bigint").alias("pos"))

    pieces = [
        part("repo_count", F.col("org"), "repo_count"),
        part("ecosystems", F.col("ecosystem"), "dependencies"),
        part("top_packages", F.concat_ws(":", "ecosystem", "package_name"), "repos", F.col("rank")),
        part("licence_summary", F.lit("copyleft"), "copyleft_occurrences"),
        part("licence_summary", F.lit("unknown"), "unknown_or_missing"),
        part("top_licences", F.col("licence"), "occurrences", F.col("rank")),
        part("eol_frameworks", F.concat_ws("@", "package", "version"), "repos"),
    ]
    return reduce(DataFrame.unionByName, pieces)


# ---- compare and trends -------------------------------------------------------------

# Every repository against the next one of its organisation.
_PAIRS = """, repos AS (SELECT DISTINCT repo_full_name, org FROM cur),
pairs AS (SELECT repo_full_name AS repo_a, lead(repo_full_name) OVER (PARTITION BY org ORDER BY repo_full_name) AS repo_b FROM repos
  QUALIFY repo_b IS NOT NULL),
sets AS MATERIALIZED (SELECT repo_full_name, ecosystem, package_key, min(package_name) AS package_name FROM cur GROUP BY ALL),
sides AS (SELECT p.repo_a, p.repo_b, s.ecosystem, s.package_key, s.package_name, 'a' AS side FROM pairs p JOIN sets s ON s.repo_full_name = p.repo_a
  UNION ALL SELECT p.repo_a, p.repo_b, s.ecosystem, s.package_key, s.package_name, 'b' FROM pairs p JOIN sets s ON s.repo_full_name = p.repo_b),
matched AS MATERIALIZED (SELECT repo_a, repo_b, ecosystem, package_key, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b,
    ecosystem || ':' || arg_min(package_name, side) AS label FROM sides GROUP BY repo_a, repo_b, ecosystem, package_key)
"""


def _pairs(ix):
    order = Window.partitionBy("org").orderBy("repo_full_name")
    return (
        ix.repos.select("org", F.col("repo_full_name").alias("repo_a"), F.lead("repo_full_name").over(order).alias("repo_b"))
        .where("repo_b IS NOT NULL")
        .drop("org")
    )


@query(
    "join_compare_outer",
    oracle(_PAIRS + "SELECT repo_a, repo_b, ecosystem, package_key, in_a, in_b, label FROM matched"),
)
def _(spark, d):
    ix = fx.index(spark, d)
    return compare.matched_packages(ix.by_repo, _pairs(ix))


_COMPARE = (
    "SELECT repo_a, repo_b, count(*) FILTER (in_a) AS deps_a, count(*) FILTER (in_b) AS deps_b, "
    "count(*) FILTER (in_a AND in_b) AS shared_count, count(*) AS union_count, "
    "floor(count(*) FILTER (in_a AND in_b) / count(*) * 1000.0 + 0.5) / 10.0 AS overlap_pct FROM matched GROUP BY ALL"
)


@query("dependency_compare", oracle(_PAIRS + _COMPARE))
def _(spark, d):
    ix = fx.index(spark, d)
    return compare.dependency_compare(ix.by_repo, _pairs(ix))


@query("agg_overlap_pct", oracle(_PAIRS + f"SELECT overlap_pct, count(*) AS pairs FROM ({_COMPARE}) c GROUP BY 1"))
def _(spark, d):
    ix = fx.index(spark, d)
    return compare.dependency_compare(ix.by_repo, _pairs(ix)).groupBy("overlap_pct").agg(F.count("*").alias("pairs"))


for _name, _rows, _where in (
    ("set_shared", compare.shared, "in_a AND in_b"),
    ("set_only_a", compare.only_in_a, "in_a AND NOT in_b"),
    ("set_only_b", compare.only_in_b, "in_b AND NOT in_a"),
):

    @query(_name, oracle(_PAIRS + f"SELECT repo_a, repo_b, label FROM matched WHERE {_where}"))
    def _(spark, d, rows=_rows):
        ix = fx.index(spark, d)
        return rows(ix.by_repo, _pairs(ix))


@query("set_union_size", oracle(_PAIRS + "SELECT repo_a, repo_b, count(*) AS union_count FROM matched GROUP BY ALL"))
def _(spark, d):
    ix = fx.index(spark, d)
    return compare.dependency_compare(ix.by_repo, _pairs(ix)).select("repo_a", "repo_b", "union_count")


def _joined(condition):
    return (
        f"coalesce((SELECT string_agg(label, ',' ORDER BY label, package_key) FROM (SELECT label, package_key FROM matched x WHERE x.repo_a = m.repo_a "
        f"AND x.repo_b = m.repo_b AND {condition} ORDER BY label, package_key LIMIT 100) t), '')"
    )


@query(
    "cap_arrays_100",
    oracle(_PAIRS + f"SELECT repo_a, repo_b, {_joined('in_a AND in_b')} AS shared, {_joined('in_a AND NOT in_b')} AS only_in_a, "
           f"{_joined('in_b AND NOT in_a')} AS only_in_b FROM (SELECT DISTINCT repo_a, repo_b FROM matched) m"),
)
def _(spark, d):
    ix = fx.index(spark, d)
    labels = compare.listed_labels(ix.by_repo, _pairs(ix))
    return labels.select("repo_a", "repo_b", *[F.array_join(c, ",").alias(c) for c in ("shared", "only_in_a", "only_in_b")])


_SNAPSHOTS = "SELECT ecosystem, package_key, ingested_date, count(DISTINCT repo_full_name) AS repo_count FROM fact GROUP BY ALL"


@query(
    "agg_trend_snapshots",
    oracle(f"SELECT ecosystem, package_key, CAST(ingested_date AS VARCHAR) AS ingested_date, repo_count, repo_count - lag(repo_count) OVER "
           f"(PARTITION BY ecosystem, package_key ORDER BY ingested_date) AS change FROM ({_SNAPSHOTS}) s"),
)
def _(spark, d):
    changes = trends.with_changes(trends.snapshots(fx.index(spark, d).fact))
    return changes.withColumn("ingested_date", F.col("ingested_date").cast("string"))


def _repo_sets(spark, d):
    """A store that got its last snapshot after the others."""
    base, fact = run_path(spark, "repo_sets"), fx.index(spark, d).fact
    newest = fact.agg(F.max("ingested_date")).scalar()
    repo_sets.create(spark, base)
    repo_sets.add_snapshots(spark, base, fact.where(F.col("ingested_date") < newest))
    repo_sets.add_snapshots(spark, base, fact.where(F.col("ingested_date") == newest))
    return repo_sets.read(spark, base)


@query(
    "agg_trend_snapshots_stored",
    oracle(f"SELECT ecosystem, package_key, CAST(ingested_date AS VARCHAR) AS ingested_date, repo_count, repo_count - lag(repo_count) OVER "
           f"(PARTITION BY ecosystem, package_key ORDER BY ingested_date) AS change FROM ({_SNAPSHOTS}) s"),
)
def _(spark, d):
    changes = trends.with_changes(repo_sets.snapshots(_repo_sets(spark, d)))
    return changes.withColumn("ingested_date", F.col("ingested_date").cast("string"))


@query(
    "agg_total_repos_stored",
    oracle("SELECT ecosystem, package_key, count(DISTINCT repo_full_name) AS repo_count FROM fact GROUP BY ALL"),
)
def _(spark, d):
    return repo_sets.distinct_repos(_repo_sets(spark, d), repo_sets.PACKAGE)


@query(
    "agg_repos_per_snapshot_stored",
    oracle("SELECT ecosystem, CAST(ingested_date AS VARCHAR) AS ingested_date, count(DISTINCT repo_full_name) AS repo_count FROM fact GROUP BY ALL"),
)
def _(spark, d):
    counted = repo_sets.distinct_repos(_repo_sets(spark, d), ["ecosystem", "ingested_date"])
    return counted.withColumn("ingested_date", F.col("ingested_date").cast("string"))


@query(
    "dependency_trends",
    oracle("SELECT ecosystem, package_key, snapshots, first_count, last_count, delta, CASE WHEN snapshots < 2 "
           "THEN 'Only one snapshot retained so far.' ELSE CASE WHEN delta >= 0 THEN '+' ELSE '' END || delta || ' repos over ' || "
           "snapshots || ' snapshots.' END AS note FROM (SELECT ecosystem, package_key, count(*) AS snapshots, "
           "arg_min(repo_count, ingested_date) AS first_count, arg_max(repo_count, ingested_date) AS last_count, "
           f"arg_max(repo_count, ingested_date) - arg_min(repo_count, ingested_date) AS delta FROM ({_SNAPSHOTS}) s GROUP BY 1, 2) t"),
)
def _(spark, d):
    return trends.dependency_trends(fx.index(spark, d).fact)


@query(
    "limit_first_n_repos",
    "SELECT repo_full_name AS name, count(*) AS libraries FROM (" + fx.for_duckdb(fx.LINES_SQL) + ") l "
    "GROUP BY o_orderkey, ingested_date, repo_full_name, vcs_url ORDER BY o_orderkey, ingested_date LIMIT 100",
)
def _(spark, d):
    path = run_path(spark, "limited")
    for part in fx.passes(spark, d):
        ordered = fx.components(spark, d).orderBy("o_orderkey", "ingested_date")
        # A folder for each part and a file for each range of the order, and their names follow it.
        ordered.select("name", "externalReferences", "components").write.option("compression", "gzip").json(f"{path}/{part:05}")
    first = sbom.read_aggregate(spark, f"{path}/*", "lines", limit=100)
    return first.select("name", F.size("components").cast("bigint").alias("libraries"))


@query(
    "top_per_group_sliced",
    oracle("SELECT ecosystem, repo_full_name, package_key, version_raw, pos FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem "
           "ORDER BY repo_full_name, package_key, version_raw, purl) AS pos FROM fact) r WHERE pos <= 1500"),
)
def _(spark, d):
    columns = ["ecosystem", "repo_full_name", "package_key", "version_raw"]
    order = [F.col(c) for c in ("repo_full_name", "package_key", "version_raw", "purl")]
    ranked = top_per_group(fx.index(spark, d).fact.select(*columns, "purl"), ["ecosystem"], order, 1500)
    return ranked.select(*columns, F.col("rank").cast("bigint").alias("pos"))
