"""Software bills of materials: aggregate CycloneDX exports and per-repository SPDX files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomatlas.functions.purl import with_purl_columns
from bomatlas.functions.text import blank_to_null, split_once
from bomatlas.functions.versions import with_version_columns
from bomatlas.sources.files import look_at
from bomatlas.sources.json_document import RANGE_BYTES, document_elements

# Column widths of the index.
MAX_PURL_CHARS = 2048
MAX_VERSION_CHARS = 512
# Fixed value: prefix of the package that stands for the repository itself.
SPDX_ROOT_PREFIX = "com.github."
# Fixed value: packages listed in a summary before "... and N more".
MAX_LISTED_PACKAGES = 100

_LIBRARY = T.StructType(
    [
        T.StructField("purl", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField(
            "licenses",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "license", T.StructType([T.StructField("id", T.StringType())])
                        )
                    ]
                )
            ),
        ),
    ]
)
COMPONENT_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField(
            "externalReferences",
            T.ArrayType(
                T.StructType(
                    [T.StructField("type", T.StringType()), T.StructField("url", T.StringType())]
                )
            ),
        ),
        T.StructField("components", T.ArrayType(_LIBRARY)),
    ]
)
_SPDX_PACKAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("versionInfo", T.StringType()),
            T.StructField("licenseConcluded", T.StringType()),
            T.StructField(
                "externalRefs",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("referenceType", T.StringType()),
                            T.StructField("referenceLocator", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    )
)
SPDX_SCHEMA = T.StructType(
    [
        T.StructField("sbom", T.StructType([T.StructField("packages", _SPDX_PACKAGES)])),
        T.StructField("packages", _SPDX_PACKAGES),
    ]
)


def check_integrity(spark: SparkSession, path: str, declared: DataFrame | None = None) -> DataFrame:
    """One row per file: path, length, is_gzip, unpacks, is_complete.

    ``declared`` (path, declared_length) marks a file of another size as incomplete, and so
    does a gzip stream that breaks off or fails its checksum (``unpacks``; null for files that
    don't begin as gzip). Names and sizes come from the listing, which leaves out empty files;
    one of them, or an absent one, has a row of length 0 if it is declared. A task streams one
    gzip file in pieces, and reads two bytes of any other, so files may have any size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    looked = files.select("path").repartition(max(1, files.count())).mapInArrow(look_at, "path string, is_gzip boolean, unpacks boolean")
    checked = files.join(looked, "path")
    sound = F.coalesce("unpacks", F.lit(True))
    if declared is None:
        return checked.withColumn("is_complete", sound)
    whole = F.coalesce(F.col("declared_length") == F.col("length"), F.lit(True))
    found = checked.join(declared, "path", "full_outer").withColumns(
        {"length": F.coalesce("length", F.lit(0)), "is_gzip": F.coalesce("is_gzip", F.lit(False))}
    )
    return found.withColumn("is_complete", sound & whole)


def read_aggregate(
    spark: SparkSession, path: str, layout: str = "lines", limit: int | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Repository components of an aggregate export.

    ``layout="lines"`` reads one component per line, which Spark splits across tasks.
    ``layout="document"`` reads whole JSON documents, the form exports are published in, by
    byte ranges of ``range_bytes``: a document of any size is read by as many tasks as it has
    ranges (see :mod:`bomatlas.sources.json_document`). ``limit`` keeps the first components of
    all files together, in the order of files' names and of places in a file.
    """
    if layout == "lines":
        components = spark.read.schema(COMPONENT_SCHEMA).json(path)
        if limit is not None:
            # Within a file the id follows the rows; a file's parts are read in any order.
            place = ["_metadata.file_path", "_metadata.file_block_start"]
            components = (
                components.select("*", *[F.col(p).alias(f"_{i}") for i, p in enumerate(place)], F.monotonically_increasing_id().alias("_at"))
                .orderBy("_0", "_1", "_at")
                .limit(limit)
                .drop("_0", "_1", "_at")
            )
    elif layout == "document":
        elements = document_elements(spark, path, "components", range_bytes)
        if limit is not None:
            # The first places are settled among (file, at) alone; texts meet them afterwards.
            elements = elements.join(elements.select("file", "at").orderBy("file", "at").limit(limit), ["file", "at"], "left_semi")
        components = elements.select(F.from_json("element", COMPONENT_SCHEMA).alias("c")).select("c.*")
    else:
        raise ValueError("layout must be 'lines' or 'document'")
    return components


def vcs_url(references: Column) -> Column:
    """URL of the first version-control reference that has one."""
    hits = F.filter(references, lambda r: (r["type"] == "vcs") & (r["url"] != ""))
    return F.get(hits, F.lit(0))["url"]


def first_license(licenses: Column) -> Column:
    return blank_to_null(F.get(licenses, F.lit(0))["license"]["id"])


def explode_libraries(
    components: DataFrame, feed: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per (repository, library) with a package URL, before any parsing.

    Columns: repo_full_name, org, repo, repo_url, pushed_at, purl, version_raw, license_id,
    and the component columns named in ``keep``.
    The repository is joined before the explode, so the lookup touches one row per
    repository rather than one per library.
    """
    org, repo = split_once(F.col("repo_full_name"), "/")
    named = (
        components.where(F.contains(F.col("name"), F.lit("/")))
        .withColumnRenamed("name", "repo_full_name")
        .withColumns(
            {
                "org": org,
                "repo": repo,
                "_vcs": F.coalesce(
                    vcs_url(F.col("externalReferences")),
                    F.concat(F.lit("https://github.com/"), F.col("repo_full_name")),
                ),
            }
        )
        .drop("externalReferences")
    )
    if feed is not None:
        named = join_repo_metadata(named, feed)
    else:
        named = named.withColumns(
            {"repo_url": F.col("_vcs"), "pushed_at": F.lit(None).cast("timestamp")}
        )
    return (
        named.select(
            "repo_full_name",
            "org",
            "repo",
            "repo_url",
            "pushed_at",
            *keep,
            F.explode("components").alias("lib"),
        )
        .where(F.startswith(F.col("lib.purl"), F.lit("pkg:")))
        .select(
            "repo_full_name",
            "org",
            "repo",
            "repo_url",
            "pushed_at",
            F.col("lib.purl").alias("purl"),
            F.col("lib.version").alias("version_raw"),
            first_license(F.col("lib.licenses")).alias("license_id"),
            *keep,
        )
    )


def join_repo_metadata(named: DataFrame, feed: DataFrame) -> DataFrame:
    """Left lookup of the feed by lower-case full name for pushed_at and repo_url.

    No broadcast hint: Spark broadcasts the feed when its size is below the threshold.
    """
    lookup = feed.select(
        F.col("repo_key").alias("_key"), F.col("pushed_at"), F.col("repo_url").alias("_feed_url")
    )
    return (
        named.join(lookup, F.lower("repo_full_name") == F.col("_key"), "left")
        .withColumn("repo_url", F.coalesce("_feed_url", "_vcs"))
        .drop("_key", "_feed_url", "_vcs")
    )


FACT_COLUMNS = (
    "repo_full_name",
    "org",
    "repo",
    "repo_url",
    "pushed_at",
    "purl",
    "ecosystem",
    "package_name",
    "package_key",
    "version_raw",
    "version_kind",
    "comparable",
    "exact_scheme",
    "version_sort_key",
    "epoch",
    "is_prerelease",
    "license_id",
    "is_self_ref",
    "is_action",
    "ingested_date",
)


def to_fact(
    libraries: DataFrame,
    ingested_date: Column,
    layout: Callable[[DataFrame], DataFrame] | None = None,
    purl_chars: int | None = MAX_PURL_CHARS,
    version_chars: int | None = MAX_VERSION_CHARS,
) -> DataFrame:
    """The 20 columns of the fact table out of :func:`explode_libraries` rows.

    The component's own version wins over the one inside the purl, and is classified
    whole before it is cut to the column width. The widths are those of the published table;
    versions that differ only behind them count as one there. None keeps whole texts.

    ``layout`` arranges the rows once the package columns are there and before versions
    are classified. A range layout reads its input twice, first for a sample, and moves
    all columns; at this point both are cheaper than on the finished rows.
    """
    parsed = with_purl_columns(libraries).withColumns(
        {
            "version_raw": F.coalesce(
                blank_to_null(F.col("version_raw")), F.col("purl_version"), F.lit("")
            ),
            "ingested_date": ingested_date,
        }
    )
    if layout is not None:
        parsed = layout(parsed.drop("purl_version"))
    return (
        with_version_columns(parsed)
        .withColumns(
            {
                c: F.substring(c, 1, chars)
                for c, chars in (("purl", purl_chars), ("version_raw", version_chars))
                if chars is not None
            }
        )
        .select(*FACT_COLUMNS)
    )


def read_spdx(spark: SparkSession, path: str) -> DataFrame:
    """Per-repository SPDX files as (org, repo, packages); org/repo from the file path."""
    where = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([^/]+?)\.json(?:\.gz)?$"
    return (
        spark.read.schema(SPDX_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .select(
            F.regexp_extract(where, pattern, 1).alias("org"),
            F.regexp_extract(where, pattern, 2).alias("repo"),
            F.coalesce("sbom.packages", "packages").alias("packages"),
        )
    )


def spdx_packages(documents: DataFrame) -> DataFrame:
    """One row per package, without the one that stands for the repository.

    Columns: org, repo, position, name, version, license_id, purl (first purl reference).
    """
    exploded = documents.select("org", "repo", F.posexplode("packages").alias("position", "p"))
    refs = F.filter(F.col("p.externalRefs"), lambda r: r["referenceType"] == "purl")
    return exploded.where(
        ~F.startswith(F.coalesce(F.col("p.name"), F.lit("")), F.lit(SPDX_ROOT_PREFIX))
    ).select(
        "org",
        "repo",
        "position",
        F.coalesce("p.name", F.lit("unknown")).alias("name"),
        F.coalesce("p.versionInfo", F.lit("")).alias("version"),
        F.coalesce("p.licenseConcluded", F.lit("")).alias("license_id"),
        F.coalesce(F.get(refs, F.lit(0))["referenceLocator"], F.lit("")).alias("purl"),
    )


def sbom_markdown(packages: DataFrame, source_url: Column) -> DataFrame:
    """Dependency section of a summary, one row per (org, repo).

    The first 100 packages are chosen by rank before they are collected, so an array
    never holds more than that however large the bill of materials is.
    """
    from bomatlas.operators.ranking import top_per_group

    line = F.concat(
        F.lit("- "),
        F.col("name"),
        F.when(F.col("version") != "", F.concat(F.lit(" ("), "version", F.lit(")"))).otherwise(""),
        F.when(
            ~F.col("license_id").isin("", "NOASSERTION"),
            F.concat(F.lit(" ["), "license_id", F.lit("]")),
        ).otherwise(""),
        F.when(F.col("purl") != "", F.concat(F.lit(" `"), "purl", F.lit("`"))).otherwise(""),
    )
    totals = packages.groupBy("org", "repo").agg(F.count("*").alias("n"))
    listed = (
        top_per_group(
            packages.select("org", "repo", "position", line.alias("line")),
            ["org", "repo"],
            [F.col("position")],
            MAX_LISTED_PACKAGES,
        )
        .groupBy("org", "repo")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    )
    more = F.col("n") - F.lit(MAX_LISTED_PACKAGES)
    return totals.join(listed, ["org", "repo"]).select(
        "org",
        "repo",
        F.concat(
            F.lit("\n\n## SBOM Dependencies ("),
            F.col("n").cast("string"),
            F.lit(" packages)\n\nSource: [SPDX 2.3 SBOM]("),
            source_url,
            F.lit(")\n\n"),
            F.array_join("lines.line", "\n"),
            F.when(
                more > 0,
                F.concat(F.lit("\n\n... and "), more.cast("string"), F.lit(" more (see full SBOM)")),
            ).otherwise(""),
        ).alias("markdown"),
    )
