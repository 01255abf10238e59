"""Reference data: security advisories and end-of-life cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomatlas.functions.purl import package_key
from bomatlas.functions.text import blank_to_null
from bomatlas.functions.versions import with_version_columns

ADVISORY_SCHEMA = (
    "id string, aliases array<string>, summary string, details string, "
    "severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,"
    "ranges:array<struct<type:string,"
    "events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,"
    "versions:array<string>>>"
)
EOL_SCHEMA = "product string, cycle string, eol string, latest string"

# Purl type and the name the advisory database uses for it.
ADVISORY_ECOSYSTEMS = {
    "npm": "npm",
    "pypi": "PyPI",
    "gem": "RubyGems",
    "maven": "Maven",
    "nuget": "NuGet",
    "golang": "Go",
    "cargo": "crates.io",
    "composer": "Packagist",
    "pub": "Pub",
}
# ecosystem|package_key and the product it belongs to.
EOL_PRODUCTS = {
    "pypi|django": "django",
    "pypi|flask": "flask",
    "pypi|fastapi": "fastapi",
    "gem|rails": "rails",
    "npm|@angular/core": "angular",
    "npm|vue": "vue",
    "npm|express": "express",
    "npm|next": "nextjs",
    "maven|org.springframework/spring-core": "spring-framework",
    "maven|org.springframework.boot/spring-boot": "spring-boot",
    "composer|laravel/framework": "laravel",
    "composer|symfony/symfony": "symfony",
}
# Fixed value: length of a summary in a report.
SUMMARY_CHARS = 200


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for item in table.items() for text in item]
    return F.try_element_at(F.create_map(*pairs), key)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """An advisory dump in the published format, one advisory a line."""
    return spark.read.schema(ADVISORY_SCHEMA).json(path)


def read_eol_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Cycles as JSON lines; ``eol`` may be a date, true, false or null in the source."""
    return spark.read.schema(EOL_SCHEMA).json(path)


def advisory_ecosystem(ecosystem: Column) -> Column:
    """Name in the advisory database; NULL when it does not cover the ecosystem."""
    return _lookup(ADVISORY_ECOSYSTEMS, ecosystem)


def own_ecosystem(name: Column) -> Column:
    return _lookup({theirs: ours for ours, theirs in ADVISORY_ECOSYSTEMS.items()}, name)


def advisory_package_name(ecosystem: Column, name: Column) -> Column:
    """Maven writes group:artifact where a purl has group/artifact."""
    return F.when(ecosystem == "maven", F.regexp_replace(name, r"^([^/]*)/", "$1:")).otherwise(name)


def eol_product(ecosystem: Column, key: Column) -> Column:
    return _lookup(EOL_PRODUCTS, F.concat(ecosystem, F.lit("|"), key))


def _affected(advisories: DataFrame) -> DataFrame:
    """One row per affected entry, with our ecosystem where there is one."""
    return advisories.select("id", F.explode("affected").alias("a")).select(
        "id",
        F.col("a.package.ecosystem").alias("advisory_ecosystem"),
        own_ecosystem(F.col("a.package.ecosystem")).alias("ecosystem"),
        F.col("a.package.name").alias("name"),
        F.col("a.ranges").alias("ranges"),
        F.col("a.versions").alias("versions"),
    )


def unmapped_packages(advisories: DataFrame) -> DataFrame:
    """(advisory_ecosystem, entries) of what no package here can match: other ecosystems, no name."""
    lost = F.col("ecosystem").isNull() | F.col("name").isNull()
    return _affected(advisories).where(lost).groupBy("advisory_ecosystem").agg(F.count("*").alias("entries"))


def affected_packages(advisories: DataFrame) -> DataFrame:
    """(id, ecosystem, package_key, ranges, versions) with our package keys."""
    named = _affected(advisories).where("ecosystem is not null and name is not null")
    name = F.when(F.col("ecosystem") == "maven", F.regexp_replace("name", r"^([^:]*):", "$1/")).otherwise(F.col("name"))
    return named.select("id", "ecosystem", package_key(F.col("ecosystem"), name).alias("package_key"), "ranges", "versions")


def affected_spans(advisories: DataFrame) -> DataFrame:
    """(id, ecosystem, package_key, introduced, fixed, last_affected): one row per span of a range.

    A span runs from an ``introduced`` event to the next event that ends it, the first version
    that is fixed or the last that is affected; without one it is open above. A range that
    only says where it ends is open below. Ranges of commits are left out: versions have none.
    """
    ranges = affected_packages(advisories).select("id", "ecosystem", "package_key", F.explode("ranges").alias("r"))
    events = ranges.where("r.type is null or r.type <> 'GIT'").select("id", "ecosystem", "package_key", F.col("r.events").alias("events"))
    begun = F.exists("events", lambda e: e["introduced"].isNotNull())
    beginning = F.transform(F.array(F.lit("0")), lambda zero: F.struct(zero.alias("introduced"), F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected")))
    events = events.withColumn("events", F.when(begun, F.col("events")).otherwise(F.concat(beginning, "events")))
    starts = events.select("*", F.posexplode("events").alias("at", "event")).where("event.introduced is not null")
    later = F.slice("events", F.col("at") + 2, F.size("events"))
    end = F.get(F.filter(later, lambda e: e["fixed"].isNotNull() | e["last_affected"].isNotNull()), F.lit(0))
    return starts.select("id", "ecosystem", "package_key", F.col("event.introduced").alias("introduced"), end["fixed"].alias("fixed"), end["last_affected"].alias("last_affected"))


_BOUNDS = ("introduced", "fixed", "last_affected")


def affected_ranges(advisories: DataFrame) -> DataFrame:
    """Spans on the sort key; ``introduced`` 0 is open below. Equal spans are one.

    The bounds of all spans are classified in one column, then put back beside each other.
    """
    spans = affected_spans(advisories).withColumn("introduced", F.nullif(F.col("introduced"), F.lit("0")))
    bound = F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(b).alias("text")) for b in _BOUNDS]))
    read = with_version_columns(spans.select("*", bound.alias("_b")).select("*", "_b.*").drop("_b"), "ecosystem", "text")
    keys = [F.max(F.when(F.col("bound") == b, F.col("version_sort_key"))).alias(f"{b}_key") for b in _BOUNDS]
    # A bound that was given but cannot be read must not open the range.
    unread = F.col("text").isNotNull() & F.col("version_sort_key").isNull()
    return read.groupBy("id", "ecosystem", "package_key", *_BOUNDS).agg(*keys, F.count_if(unread).alias("_unread")).where("_unread = 0").drop("_unread")


def affected_versions(advisories: DataFrame) -> DataFrame:
    """Advisories that list exact versions, one row per version."""
    return affected_packages(advisories).select(
        "id", "ecosystem", "package_key", F.explode("versions").alias("version_raw")
    )


def advisory_details(advisories: DataFrame, summary_chars: int | None = SUMMARY_CHARS) -> DataFrame:
    """(id, cve, summary, severity, url) per advisory; ``summary_chars=None`` keeps whole summaries."""
    cves = F.filter("aliases", lambda alias: F.coalesce(alias.rlike(r"(?i)^CVE-"), F.lit(False)))
    summary = F.coalesce(blank_to_null(F.col("summary")), F.col("details"), F.lit(""))
    first_score = F.get(F.col("severity"), F.lit(0))["score"]
    return advisories.select(
        "id",
        F.get(cves, F.lit(0)).alias("cve"),
        (summary if summary_chars is None else F.substring(summary, 1, summary_chars)).alias("summary"),
        F.coalesce(
            F.upper(blank_to_null(F.col("database_specific.severity"))), first_score, F.lit("UNKNOWN")
        ).alias("severity"),
        F.concat(F.lit("https://osv.dev/vulnerability/"), "id").alias("url"),
    )
