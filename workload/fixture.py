"""Dependency data derived from the driver's tables, for Spark and for the SQL check.

``LINES_SQL`` and the other texts below run unchanged on both engines: they turn order
lines into libraries of a repository. Everything after that (package URLs, version
keys, joins with the feed) is the library's work on one side and the plain SQL of
``FACT_SQL`` on the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomatlas.operators import lexical_index as lexical
from bomatlas.operators import vector_index as vectors
from bomatlas.plans.index import DependencyIndex, open_index, publish
from bomatlas.session import apply_settings, delete_path, run_path
from bomatlas.sources import refdata, tables
from bomatlas.sources.feed import normalise_feed
from bomatlas.functions.text import split_once
from bomatlas.sources.sbom import explode_libraries, join_repo_metadata, to_fact

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

AS_OF = "2000-06-01"
SBOM_BASE_URL = "https://sbom.example.org"

# One row per order line: the repository, the library and its version as published.
LINES_SQL = r"""
SELECT o_orderkey, l_linenumber, repo_full_name, vcs_url, pushed_at, ingested_date, license_id,
       ecosystem, name_enc, version_enc,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE version_enc END AS version_field,
       concat('pkg:', ecosystem, '/', name_enc,
              CASE WHEN version_enc = '' THEN '' ELSE concat('@', version_enc) END,
              CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '?type=jar' ELSE '#sub/path' END) AS purl
FROM (
  SELECT o_orderkey, l_linenumber, repo_full_name, pushed_at, ingested_date, license_id, ecosystem,
    CASE WHEN o_orderkey % 2 = 0 THEN concat('https://git.example.org/', repo_full_name) END AS vcs_url,
    CASE WHEN p_partkey % 130 = 0 THEN 'express'
         WHEN p_partkey % 130 = 1 THEN 'vue'
         WHEN p_partkey % 130 = 2 THEN 'next'
         WHEN p_partkey % 130 = 3 THEN '%40angular/core'
         WHEN p_partkey % 130 = 6 THEN 'Django'
         WHEN p_partkey % 130 = 7 THEN 'rails'
         WHEN p_partkey % 130 = 8 THEN 'org.springframework/spring-core'
         WHEN ecosystem = 'maven' THEN concat('org.acme/', plain_name)
         WHEN ecosystem = 'npm' AND p_partkey % 3 = 0 THEN concat('%40acme/', plain_name)
         ELSE plain_name END AS name_enc,
    CASE o_orderkey % 40
      WHEN 0 THEN ''
      WHEN 1 THEN concat('%5E', a, '.', b, '.', c)
      WHEN 2 THEN concat(a, '.', b, '.0-rc.', d)
      WHEN 3 THEN substr(md5(concat('k', CAST(o_orderkey AS STRING))), 1, 12)
      WHEN 4 THEN concat('v', a, '.', b, '.0')
      WHEN 5 THEN concat(a, '.x')
      WHEN 6 THEN 'latest'
      WHEN 7 THEN concat(a, '.', b, '.', c, '.Final')
      WHEN 8 THEN concat('1!', a, '.', b, '.', c)
      WHEN 9 THEN concat(a, '.', b, 'rc', c)
      WHEN 10 THEN concat(a, '.', b, '.', c, '-M', c)
      WHEN 11 THEN concat('=', a, '.', b, '.', c)
      WHEN 12 THEN concat('%20', a, '.', b, '.', c, '%20')
      WHEN 13 THEN concat(a, '.', b, '.', c, '.post1')
      WHEN 14 THEN concat('201608', CAST(10 + l_linenumber AS STRING))
      WHEN 15 THEN concat(a, '.', b)
      WHEN 16 THEN concat(a, '.', b, '.', c, '+build.7')
      WHEN 17 THEN concat('%3E=', a, '.', b, ',%3C9')
      WHEN 18 THEN concat(a, '.', b, '.', c, '.', d, '.1.2.3')
      WHEN 19 THEN concat('v0.0.0-20210101000000-', substr(md5(concat('k', CAST(o_orderkey AS STRING))), 1, 12))
      ELSE concat(a, '.', b, '.', c) END AS version_enc
  FROM (
    SELECT o.o_orderkey, l.l_linenumber, p.p_partkey,
      concat(lower(n.n_name), '/r', CAST(c.c_custkey AS STRING)) AS repo_full_name,
      o.o_orderdate AS pushed_at,
      CAST(date_trunc('year', l.l_shipdate) AS DATE) AS ingested_date,
      CASE p.p_size % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0-only'
        WHEN 3 THEN 'LGPL-2.1' WHEN 4 THEN 'MPL-2.0' WHEN 5 THEN 'NOASSERTION'
        WHEN 6 THEN 'BSD-3-Clause' END AS license_id,
      CASE WHEN p.p_partkey % 13 <= 5 THEN 'npm' WHEN p.p_partkey % 13 = 6 THEN 'pypi'
        WHEN p.p_partkey % 13 = 7 THEN 'gem' WHEN p.p_partkey % 13 = 8 THEN 'maven'
        WHEN p.p_partkey % 13 = 9 THEN 'nuget' WHEN p.p_partkey % 13 = 10 THEN 'golang'
        WHEN p.p_partkey % 13 = 11 THEN 'githubactions' ELSE 'github' END AS ecosystem,
      concat(replace(p.p_name, ' ', '_'), '.', CAST(p.p_partkey % 50 AS STRING)) AS plain_name,
      CAST(l.l_linenumber AS STRING) AS a,
      CAST(CAST(floor(l.l_quantity) AS INT) AS STRING) AS b,
      CAST(CAST(round(l.l_discount * 100) AS INT) AS STRING) AS c,
      CAST(CAST(round(l.l_tax * 100) AS INT) AS STRING) AS d
    FROM {lineitem} l
    JOIN {orders} o ON o.o_orderkey = l.l_orderkey
    JOIN {customer} c ON c.c_custkey = o.o_custkey
    JOIN {nation} n ON n.n_nationkey = c.c_nationkey
    JOIN {part} p ON p.p_partkey = l.l_partkey
  ) lines
) named
"""

# The same rows for Spark, which joins in the order written: orders get their names before the
# lines meet them, so that lines are moved twice and not three times.
_NAMED_LATE = """FROM {lineitem} l
    JOIN {orders} o ON o.o_orderkey = l.l_orderkey
    JOIN {customer} c ON c.c_custkey = o.o_custkey
    JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""
_NAMED_EARLY = """FROM {lineitem} l
    JOIN ({orders} o
      JOIN {customer} c ON c.c_custkey = o.o_custkey
      JOIN {nation} n ON n.n_nationkey = c.c_nationkey
    ) ON o.o_orderkey = l.l_orderkey
"""
_LANDING_SQL = LINES_SQL.replace(_NAMED_LATE, _NAMED_EARLY)
#: Lines that are joined at a time; what is on disk for the joins grows no further.
LINES_AT_ONCE = 40_000_000

# The repository feed: one entry per order, so a repository occurs several times.
FEED_SQL = r"""
SELECT o.o_orderkey AS position,
  CASE WHEN o.o_orderkey % 2 = 0 THEN n.n_name END AS owner,
  CASE WHEN o.o_orderkey % 2 = 0 THEN '' ELSE lower(n.n_name) END AS org,
  CASE WHEN o.o_orderkey % 17 = 0 THEN '' ELSE concat('r', CAST(c.c_custkey AS STRING)) END AS name,
  CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS "pushedAt",
  CASE WHEN o.o_orderkey % 4 = 0 THEN ''
       ELSE concat('https://code.example.org/', lower(n.n_name), '/r', CAST(c.c_custkey AS STRING)) END AS url
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

# Advisories about parts: an affected range, or one exact version.
ADVISORIES_SQL = r"""
SELECT concat('ADV-', CAST(p_partkey AS STRING)) AS id,
  CASE WHEN p_partkey % 13 <= 5 THEN 'npm' WHEN p_partkey % 13 = 6 THEN 'PyPI'
    WHEN p_partkey % 13 = 7 THEN 'RubyGems' WHEN p_partkey % 13 = 8 THEN 'Maven'
    WHEN p_partkey % 13 = 9 THEN 'NuGet' WHEN p_partkey % 13 = 10 THEN 'Go'
    ELSE 'Elsewhere' END AS advisory_ecosystem,
  CASE WHEN p_partkey % 130 = 0 THEN 'express'
    WHEN p_partkey % 13 = 8 THEN concat('org.acme:', replace(p_name, ' ', '_'), '.', CAST(p_partkey % 50 AS STRING))
    WHEN p_partkey % 13 <= 5 AND p_partkey % 3 = 0
      THEN concat('@acme/', replace(p_name, ' ', '_'), '.', CAST(p_partkey % 50 AS STRING))
    ELSE concat(replace(p_name, ' ', '_'), '.', CAST(p_partkey % 50 AS STRING)) END AS advisory_package,
  CASE p_size % 3 WHEN 0 THEN '0' WHEN 1 THEN '1.5' END AS introduced,
  CASE p_size % 3 WHEN 0 THEN concat(CAST(2 + p_partkey % 4 AS STRING), '.0.0')
    WHEN 1 THEN '4.20.1' END AS fixed,
  CASE WHEN p_size % 3 = 2 THEN concat(CAST(1 + p_partkey % 7 AS STRING), '.',
    CAST(1 + p_size AS STRING), '.0') END AS exact_version,
  CASE WHEN p_partkey % 7 = 0 THEN '6.2' END AS introduced_again,
  CASE WHEN p_partkey % 7 = 0 THEN '6.40.0' END AS last_affected,
  CASE WHEN p_partkey % 2 = 0 THEN concat('CVE-2020-', CAST(p_partkey AS STRING)) END AS cve_alias,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Problem in ', p_name) END AS summary,
  concat('Details of ', p_name, repeat(' more', 50)) AS details,
  CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'Moderate' END AS own_severity,
  CASE WHEN p_partkey % 4 = 2 THEN 'CVSS:3.1/AV:N' END AS score
FROM {part}
"""

# End-of-life cycles: whole majors, and minors of the first two majors.
EOL_SQL = r"""
SELECT product, cycle,
  CASE size % 6 WHEN 0 THEN 'true' WHEN 1 THEN '1999-01-01' WHEN 2 THEN '2099-01-01'
    WHEN 3 THEN 'false' WHEN 4 THEN 'unknown' END AS eol,
  concat(cycle, '.9') AS latest
FROM (
  SELECT explode_products AS product, cycle, size FROM (
    SELECT DISTINCT CAST(l_linenumber AS STRING) AS cycle, l_linenumber AS size FROM {lineitem}
    UNION ALL
    SELECT DISTINCT concat(CAST(l_linenumber AS STRING), '.', CAST(CAST(floor(l_quantity) AS INT) AS STRING)) AS cycle,
      l_linenumber + CAST(floor(l_quantity) AS INT) AS size
    FROM {lineitem} WHERE l_linenumber <= 2
  ) numbers
) cycles
"""
_PRODUCTS = "'express', 'vue', 'nextjs', 'angular', 'django', 'rails', 'spring-framework'"


# Calls of the search service out of the event log.
CALLS_SQL = r"""
SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, value * 10 AS duration_ms, event_type = 'error' AS is_error,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'VALIDATION_ERROR'
    WHEN 1 THEN 'SEARCH_TIMEOUT' ELSE 'SERVICE_ERROR' END END AS error_type,
  CASE WHEN event_type <> 'signup' THEN event_id % 20 <> 0 END AS cache_hit,
  event_id % 9 AS result_count
FROM {events}
"""

# One range per package of the index.
WATCH_SQL = r"""
SELECT ecosystem, package_key,
  CASE WHEN length(package_key) % 19 = 0 THEN 'latest' ELSE CASE length(package_key) % 8
    WHEN 0 THEN '<2' WHEN 1 THEN '>=4 <5' WHEN 2 THEN '^3.17.0'
    WHEN 3 THEN '~2.10' WHEN 4 THEN '4.x' WHEN 5 THEN '=3.8.2' WHEN 6 THEN '>1, <=6.30'
    ELSE '1.2.3.4' END END AS version_range,
  length(package_key) % 3 = 0 AS include_prereleases
FROM {packages}
UNION ALL
SELECT ecosystem, concat(package_key, '-unused'), '<2', FALSE FROM {packages} WHERE length(package_key) % 16 = 1
"""

# Summary documents: one per text, addressed by source and number.
DOCUMENTS_SQL = r"""
SELECT doc_id, source AS org, concat('doc', CAST(doc_id AS STRING)) AS repo, text,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('https://github.com/', source, '/doc', CAST(doc_id AS STRING)) END AS url,
  CASE doc_id % 3 WHEN 0 THEN '' ELSE concat('2025-01-', CAST(10 + doc_id % 18 AS STRING)) END AS pushed_at,
  CASE doc_id % 5 WHEN 0 THEN '' ELSE concat('2025-02-', CAST(10 + doc_id % 18 AS STRING)) END AS processed_at,
  lang, n_chars
FROM {documents}
"""


# Tables whose rows cost much to process.
_HEAVY = {"documents", "embeddings", "lineitem", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables.

    A heavy table that comes as fewer splits than there are cores is spread out. At scale
    the splits outnumber the cores and nothing is shuffled.
    """
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _HEAVY and len(frame.inputFiles()) < cores and frame.rdd.getNumPartitions() < cores:
        return frame.repartition(cores)
    return frame


def derive(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run one of the texts above over the driver's tables."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    text = text.replace('"pushedAt"', "pushedAt").replace("{", "{{").replace("}", "}}")
    for name in (*named, *frames):
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(text, **named, **frames)


def for_duckdb(text: str) -> str:
    text = text.replace("explode_products", f"unnest([{_PRODUCTS}])")
    for name in (*TABLES, "packages"):
        text = text.replace("{" + name + "}", name)
    return text


_LANDED: dict[tuple[str, str], str] = {}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines, landed once as Parquet like any delivered source."""
    apply_settings(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED and (passing := _PASSES.get(key)):
        if not passing.path:
            if passing.cuts is None:
                passing.cuts = _cuts(spark, sf_dir)
            path = run_path(spark, "passing")
            _land(spark, sf_dir, path, passing.cuts, passing.at)
            passing.path = path
        return spark.read.parquet(passing.path)
    if key not in _LANDED:
        path, cuts = run_path(spark, "landed"), _cuts(spark, sf_dir)
        for at in range(len(cuts) + 1):
            _land(spark, sf_dir, path, cuts, at)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def _cuts(spark: SparkSession, sf_dir: str) -> list[int]:
    """Order keys that cut the orders in parts of about ``LINES_AT_ONCE`` lines; none if they are fewer."""
    parts = -(-derive(spark, sf_dir, "SELECT l_orderkey FROM {lineitem}").count() // LINES_AT_ONCE)
    if parts <= 1:
        return []
    places = ", ".join(str(i / parts) for i in range(1, parts))
    cuts = derive(spark, sf_dir, f"SELECT percentile_approx(o_orderkey, array({places})) AS cuts FROM {{orders}}").first()["cuts"]
    return sorted(set(cuts or []))


def _land(spark: SparkSession, sf_dir: str, path: str, cuts: list[int], at: int) -> None:
    """Write the lines of the orders between two cuts."""
    text = _LANDING_SQL
    low, high = (cuts[at - 1] if at else None), (cuts[at] if at < len(cuts) else None)
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        bounds = [f"{key} > {low}"] * (low is not None) + [f"{key} <= {high}"] * (high is not None)
        if bounds:
            text = text.replace("{" + name + "}", f"(SELECT * FROM {{{name}}} WHERE {' AND '.join(bounds)})")
    # As many files as the joins have tasks: dealing the rows again would sort and move all of them.
    derive(spark, sf_dir, text).write.mode("append").option("compression", "zstd").parquet(path)


@dataclass
class _Pass:
    """Which part of the orders is passing, between which cuts, and where its lines are."""

    at: int = 0
    cuts: list[int] | None = None
    path: str | None = None


_PASSES: dict[tuple[str, str], _Pass] = {}


def passes(spark: SparkSession, sf_dir: str) -> Iterator[int]:
    """In each pass :func:`lines` has some of the orders with all their lines, a later pass later orders.

    They are deleted after the pass, so one part is on disk at a time. Lines delivered before
    come whole, in one pass.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    passing = _PASSES[key] = _Pass()
    try:
        while passing.at <= len(passing.cuts or []):
            yield passing.at
            if passing.path:
                delete_path(spark, passing.path)
            passing.at, passing.path = passing.at + 1, None
    finally:
        _PASSES.pop(key, None)
        if passing.path:
            delete_path(spark, passing.path)


@contextmanager
def passing_lines(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Lines that land in here are deleted at the end; those delivered before stay."""
    key = (spark.sparkContext.applicationId, sf_dir)
    delivered = key in _LANDED
    try:
        yield
    finally:
        if not delivered and key in _LANDED:
            delete_path(spark, _LANDED.pop(key))


def _landed_json(rows: DataFrame, sf_dir: str, name: str) -> str:
    """A folder of JSON lines, written once a session as any delivered source."""
    spark = rows.sparkSession
    key = (spark.sparkContext.applicationId, f"{name} {sf_dir}")
    if key not in _LANDED:
        path = run_path(spark, name)
        rows.write.json(path)
        _LANDED[key] = path
    return _LANDED[key]


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested bills of materials: one per order and snapshot, of at most a dozen libraries."""
    library = F.struct(
        F.col("purl"),
        F.col("version_field").alias("version"),
        F.when(
            F.col("license_id").isNotNull(),
            F.array(F.struct(F.struct(F.col("license_id").alias("id")).alias("license"))),
        ).alias("licenses"),
    )
    link = F.struct(F.lit("vcs").alias("type"), F.col("vcs_url").alias("url"))
    site = F.struct(F.lit("website").alias("type"), F.lit("https://example.org").alias("url"))
    return (
        lines(spark, sf_dir)
        # Dealt by ranges of the order, so that a sort by it afterwards moves nothing again.
        .repartitionByRange("o_orderkey", "ingested_date")
        .groupBy("o_orderkey", "ingested_date", F.col("repo_full_name").alias("name"), "vcs_url")
        .agg(F.collect_list(library).alias("components"))
        .withColumn("externalReferences", F.array(site, link))
        .drop("vcs_url")
    )


#: Text that looks like structure, put into every published component.
_TRAP = 'a "quoted" { brace and "components": [{ \\\\'


def published_document(spark: SparkSession, sf_dir: str) -> str:
    """JSON documents with all bills of materials, compressed as exports are published: one for each task, a single one if they are few."""
    key = (spark.sparkContext.applicationId, f"document {sf_dir}")
    if key not in _LANDED:
        path = run_path(spark, "document")

        def rows():
            text = F.to_json(F.struct(F.lit(_TRAP).alias("description"), "name", "externalReferences", "components"))
            return components(spark, sf_dir).select(text.alias("value"))

        def joined(batches):
            import pyarrow as pa

            yield pa.record_batch([pa.array(['{"bomFormat": "CycloneDX", "metadata": {"component": {"name": "all"}}, "components": ['])], names=["value"])
            first = True
            for batch in batches:
                texts = [("" if first and not i else ",") + t for i, t in enumerate(batch.column(0).to_pylist())]
                first = first and not texts
                yield pa.record_batch([pa.array(texts, pa.string())], names=["value"])
            yield pa.record_batch([pa.array(['], "dependencies": [{"ref": "all"}]}'])], names=["value"])

        # A task writes a whole document; it streams and holds a batch at a time.
        for _ in passes(spark, sf_dir):
            rows().mapInArrow(joined, "value string").write.mode("append").option("compression", "gzip").text(path)
        _LANDED[key] = path
    return _LANDED[key]


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FEED_SQL)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CALLS_SQL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, DOCUMENTS_SQL)


def eol_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, EOL_SQL.replace("explode_products", f"explode(array({_PRODUCTS}))"))
    return refdata.read_eol_cycles(spark, _landed_json(rows, sf_dir, "eol"))


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rows as a published advisory dump: written as JSON lines, read back by the library."""

    def span(begin: str, end: str):
        """A range of two events, or nothing."""
        none = F.lit(None).cast("string")
        events = [
            F.struct(F.col(begin).alias("introduced"), none.alias("fixed"), none.alias("last_affected")),
            F.struct(none.alias("introduced"), *[(F.col(end) if c == end else none).alias(c) for c in ("fixed", "last_affected")]),
        ]
        return F.when(F.col(begin).isNotNull(), F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(*events).alias("events")))

    dump = derive(spark, sf_dir, ADVISORIES_SQL).select(
        "id",
        F.array_compact(F.array(F.concat(F.lit("GHSA-"), "id"), "cve_alias")).alias("aliases"),
        "summary",
        "details",
        F.when(
            F.col("score").isNotNull(), F.array(F.struct(F.lit("CVSS_V3").alias("type"), "score"))
        ).alias("severity"),
        F.struct(F.col("own_severity").alias("severity")).alias("database_specific"),
        F.array(
            F.struct(
                F.struct(
                    F.col("advisory_ecosystem").alias("ecosystem"), F.col("advisory_package").alias("name")
                ).alias("package"),
                F.array_compact(F.array(span("introduced", "fixed"), span("introduced_again", "last_affected"))).alias("ranges"),
                F.array_compact(F.array("exact_version")).alias("versions"),
            )
        ).alias("affected"),
    )
    return refdata.read_advisories(spark, _landed_json(dump, sf_dir, "advisories"))


def exploded_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table by way of the nested bills of materials."""
    looked_up = normalise_feed(feed(spark, sf_dir))
    exploded = explode_libraries(components(spark, sf_dir), looked_up, ("ingested_date",))
    return to_fact(exploded, F.col("ingested_date"))


def libraries(spark: SparkSession, sf_dir: str, looked_up: DataFrame) -> DataFrame:
    """The flat lines, which already are one library each, with a feed looked up."""
    org, repo = split_once(F.col("repo_full_name"), "/")
    named = lines(spark, sf_dir).select(
        "repo_full_name",
        F.coalesce("vcs_url", F.concat(F.lit("https://github.com/"), "repo_full_name")).alias("_vcs"),
        "purl",
        F.col("version_field").alias("version_raw"),
        "license_id",
        "ingested_date",
    )
    # The parts of the name are cut out after the lookup, which would move them as well.
    return join_repo_metadata(named, looked_up).withColumns({"org": org, "repo": repo})


_INDEXES: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> DependencyIndex:
    """The index over one set of tables, built and stored once per application."""
    apply_settings(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        base = run_path(spark, "index")
        newest = derive(
            spark, sf_dir, "SELECT CAST(CAST(date_trunc('year', max(l_shipdate)) AS DATE) AS STRING) AS d FROM {lineitem}"
        ).first()["d"]
        with passing_lines(spark, sf_dir):
            dates = tables.dates_at_once(lines(spark, sf_dir))
            # Written, since each group of dates reads it.
            entries, found = run_path(spark, "feed"), normalise_feed(feed(spark, sf_dir))
            found.write.option("compression", "zstd").parquet(entries)
            looked_up = spark.read.schema(found.schema).parquet(entries)
            publish(spark, libraries(spark, sf_dir, looked_up), F.col("ingested_date"), base, newest, dates=dates)
            delete_path(spark, entries)
        _INDEXES[key] = base
    return open_index(spark, _INDEXES[key])


def index_base(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the stored index."""
    index(spark, sf_dir)
    return _INDEXES[(spark.sparkContext.applicationId, sf_dir)]


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """The word index over the documents, built and stored once per application."""
    key = (spark.sparkContext.applicationId, f"lexical {sf_dir}")
    if key not in _LANDED:
        path = run_path(spark, "lexical")
        lexical.build(table(spark, sf_dir, "documents"), path)
        _LANDED[key] = path
    return lexical.open_index(spark, _LANDED[key])


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The vector index over the embeddings, built and stored once per application."""
    key = (spark.sparkContext.applicationId, f"vectors {sf_dir}")
    if key not in _LANDED:
        path = run_path(spark, "vectors")
        vectors.build(table(spark, sf_dir, "embeddings"), path)
        _LANDED[key] = path
    return vectors.open_index(spark, _LANDED[key])


def watch_list(spark: SparkSession, popularity: DataFrame) -> DataFrame:
    return spark.sql(WATCH_SQL, packages=popularity)


# The fact table in plain SQL, written from the rules and without the library's patterns.
FACT_SQL = (
    "feed AS MATERIALIZED (SELECT lower(concat(coalesce(nullif(owner, ''), org), '/', name)) AS repo_key, "
    "concat(coalesce(nullif(owner, ''), org), '/', name) AS full_name, \"pushedAt\" AS feed_pushed, "
    "coalesce(nullif(url, ''), concat('https://github.com/', coalesce(nullif(owner, ''), org), '/', name)) AS feed_url "
    "FROM (" + for_duckdb(FEED_SQL) + ") f "
    "WHERE coalesce(nullif(owner, ''), nullif(org, '')) IS NOT NULL AND name <> '' "
    "QUALIFY row_number() OVER (PARTITION BY lower(concat(coalesce(nullif(owner, ''), org), '/', name)) "
    "ORDER BY position DESC) = 1), "
    "lines AS (" + for_duckdb(LINES_SQL) + "), "
    + r"""
named AS (
  SELECT l.repo_full_name, split_part(l.repo_full_name, '/', 1) AS org, split_part(l.repo_full_name, '/', 2) AS repo,
    coalesce(f.feed_url, l.vcs_url, 'https://github.com/' || l.repo_full_name) AS repo_url,
    f.feed_pushed, l.purl, l.ecosystem, url_decode(l.name_enc) AS package_name,
    CASE WHEN l.ecosystem = 'pypi' THEN lower(regexp_replace(url_decode(l.name_enc), '[-_.]+', '-', 'g'))
         ELSE lower(url_decode(l.name_enc)) END AS package_key,
    CASE WHEN l.version_field <> '' THEN l.version_field ELSE url_decode(l.version_enc) END AS version_raw,
    l.license_id, l.ingested_date
  FROM lines l LEFT JOIN feed f ON f.repo_key = lower(l.repo_full_name)),
texts AS (
  SELECT *, trim(url_decode(version_raw)) AS t FROM named),
classed AS (
  SELECT *, trim(CASE WHEN starts_with(t, '=') THEN t[2:] ELSE t END) AS s,
    CASE WHEN regexp_matches(t, '^[vV][0-9]') THEN t[2:] WHEN starts_with(t, '=') THEN trim(t[2:]) ELSE t END AS b
  FROM texts),
kinded AS (
  SELECT *, s <> '' AND (s[1] IN ('^', '~', '>', '<') OR contains(t, '||') OR contains(t, ',') OR contains(t, ' - ')
      OR contains(s, '*')
      OR list_has_any(regexp_split_to_array(s, '[.\-_]'), ['x', 'X'])) AS is_range,
    regexp_matches(b, '-[0-9]{12,14}-[0-9a-f]{12}$')
      OR (regexp_full_match(b, '[0-9a-fA-F]{7,40}') AND NOT regexp_full_match(b, '[0-9]+')) AS is_hash
  FROM classed),
read AS (
  SELECT *,
    CASE WHEN t = '' THEN 'empty' WHEN ecosystem = 'github' THEN 'branch'
      WHEN ecosystem = 'githubactions' THEN CASE WHEN is_range THEN 'wildcard' ELSE 'branch' END
      WHEN is_range THEN 'range' WHEN is_hash THEN 'sha' END AS early,
    CASE WHEN ecosystem IN ('npm', 'golang', 'nuget') THEN
           CASE WHEN regexp_full_match(split_part(split_part(b, '+', 1), '-', 1), '[0-9]+([.][0-9]+)*')
                THEN split_part(split_part(b, '+', 1), '-', 1) END
         WHEN ecosystem = 'gem' THEN
           nullif(rtrim(regexp_extract(b || '.', '^(([0-9]+[.])*)', 1), '.'), '')
         ELSE nullif(regexp_extract(CASE WHEN ecosystem = 'pypi' THEN regexp_replace(lower(b), '^[^!]*!', '') ELSE b END,
                     '^([0-9]+([.][0-9]+)*)', 1), '') END AS rel
  FROM kinded),
rested AS (
  SELECT *,
    CASE WHEN ecosystem IN ('npm', 'golang', 'nuget') THEN
           CASE WHEN contains(split_part(b, '+', 1), '-') THEN split_part(b, '+', 1)[length(rel) + 2:] ELSE '' END
         WHEN ecosystem = 'gem' THEN CASE WHEN length(rel) < length(b) THEN b[length(rel) + 2:] ELSE '' END
         WHEN ecosystem = 'pypi' THEN split_part(regexp_replace(lower(b), '^[^!]*!', ''), '+', 1)[length(rel) + 1:]
         ELSE lower(b)[length(rel) + 1:] END AS rest,
    CASE WHEN ecosystem = 'pypi' AND regexp_matches(b, '^[0-9]+!') THEN CAST(split_part(b, '!', 1) AS BIGINT) ELSE 0 END AS ep
  FROM read),
judged AS (
  SELECT *, early IS NULL AND rel IS NOT NULL AS comparable,
    coalesce(early IS NULL AND rel IS NOT NULL AND CASE
      WHEN ecosystem IN ('npm', 'golang', 'nuget') THEN rest <> ''
      WHEN ecosystem = 'gem' THEN length(rel) < length(b)
      WHEN ecosystem = 'pypi' THEN regexp_matches(rest, '^[._-]?(a|b|c|rc|alpha|beta|pre|preview|dev)')
      ELSE regexp_matches(rest, '(alpha|beta|rc|m[0-9]|snapshot|cr[0-9]|milestone|preview)') END, FALSE) AS is_prerelease
  FROM rested),
fact AS MATERIALIZED (
  SELECT repo_full_name, org, repo, repo_url, CAST(feed_pushed AS TIMESTAMP) AS pushed_at, left(purl, 2048) AS purl, ecosystem, package_name,
    package_key, left(version_raw, 512) AS version_raw,
    coalesce(early, CASE WHEN NOT comparable THEN 'unparseable' WHEN is_prerelease THEN 'prerelease' ELSE 'release' END) AS version_kind,
    comparable, ecosystem NOT IN ('maven', 'github', 'githubactions') AS exact_scheme,
    CASE WHEN comparable THEN
      lpad(CAST(least(ep, 9999) AS VARCHAR), 4, '0') || '!' ||
      array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN length(string_split(rel, '.')[i]) > 10
        THEN '9999999999' ELSE lpad(coalesce(string_split(rel, '.')[i], '0'), 10, '0') END), '.') || '.' ||
      CASE WHEN NOT is_prerelease THEN '~' ELSE '-' || array_to_string(list_transform(
        list_filter(regexp_split_to_array(lower(rest), '[.\-_]'), lambda g: g <> ''),
        lambda g: CASE WHEN regexp_full_match(g, '[0-9]+') THEN '0' || lpad(g, 12, '0') ELSE '1' || g END), '.') END
    END AS version_sort_key,
    CASE WHEN comparable THEN ep ELSE 0 END AS epoch, is_prerelease, license_id,
    ecosystem = 'github' AS is_self_ref, ecosystem = 'githubactions' AS is_action, ingested_date
  FROM judged),
cur AS MATERIALIZED (SELECT * FROM fact WHERE ingested_date = (SELECT max(ingested_date) FROM fact))
"""
)


def oracle(body: str) -> str:
    """A check query over ``fact`` (all snapshots) and ``cur`` (the served one)."""
    return "WITH " + FACT_SQL + body


POPULARITY_SQL = """, popularity AS (
  SELECT ecosystem, package_key, min(package_name) AS package_name,
    count(DISTINCT repo_full_name) AS repo_count, count(DISTINCT version_raw) AS version_count
  FROM cur WHERE NOT is_self_ref AND NOT is_action GROUP BY ALL)"""
