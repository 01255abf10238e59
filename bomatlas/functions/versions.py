"""Version classification and the order-preserving sort key.

A sort key is an ASCII string whose plain string order is the order of versions::

    epoch(4) ! six segments(10 each, joined by '.') . discriminator

The discriminator is ``~`` for a release and ``-`` plus the tags for a prerelease, so a
release follows all of its prereleases. Because the key is a string, a version range is
a pair of string comparisons, which Parquet min/max statistics can prune.

The work is laid out as a chain of projections. Each step reads a column of the step
before it, so no regular expression is evaluated twice and every step stays inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.functions.text import percent_decode, strip

# Fixed values of the key format.
SEGMENTS = 6
SEGMENT_WIDTH = 10
EPOCH_WIDTH = 4
NUMERIC_TAG_WIDTH = 12

# Fixed value: ecosystems whose dotted releases the key orders exactly.
EXACT_SCHEMES = ("npm", "pypi", "gem", "cargo", "golang", "nuget", "composer", "pub", "swift")
# Fixed value: ecosystems that follow semantic versioning.
SEMVER_FAMILY = ("npm", "cargo", "golang", "nuget", "composer", "pub", "swift")
# The kinds a version string can have.
VERSION_KINDS = (
    "release",
    "prerelease",
    "range",
    "sha",
    "branch",
    "wildcard",
    "empty",
    "unparseable",
)
CONCRETE_KINDS = ("release", "prerelease")

# Patterns that decide the kind.
GO_PSEUDO_VERSION = r"-[0-9]{12,14}-[0-9a-f]{12}$"
COMMIT_HASH = r"^[0-9a-fA-F]{7,40}$"
PYPI_PRERELEASE = r"^[._-]?(a|b|c|rc|alpha|beta|pre|preview|dev)"
MAVEN_PRERELEASE = r"(alpha|beta|rc|m[0-9]|snapshot|cr[0-9]|milestone|preview)"

# One pattern for "declares more than one version": a comparison prefix (after an
# optional '='), an alternative, a list, a hyphen span, a star, or an x segment.
_RANGE_PATTERN = (
    r"^=?\s*[\^~><]"
    r"|\|\||,| - |\*"
    r"|(?:^(?:=\s*)?|[.\-_])[xX](?:[.\-_]|$)"
)
# Most versions are plain dotted digits. Every scheme reads them the same way, so they
# skip the other patterns.
_PLAIN_PATTERN = r"^[0-9]+(?:\.[0-9]+)*$"
_SEMVER_PATTERN = r"^([0-9]+(?:\.[0-9]+)*)(?:-([^+]*))?(?:\+[\s\S]*)?$"
_PYPI_PATTERN = r"^(?:([^!]*)!|(?![\s\S]*!))([0-9]+(?:\.[0-9]+)*)([^+]*)"
_GEM_PATTERN = r"^([0-9]+(?:\.[0-9]+)*)(?:\.([\s\S]*))?$"
_MAVEN_PATTERN = r"^([0-9]+(?:\.[0-9]+)*)([\s\S]*)$"


def is_range_or_wildcard(version: Column) -> Column:
    """True for ranges and wildcards; expects a stripped string."""
    return version.rlike(_RANGE_PATTERN)


def is_sha(version: Column) -> Column:
    """True for commit hashes and Go pseudo-versions; plain digits are a calendar version."""
    return version.rlike(GO_PSEUDO_VERSION) | (
        version.rlike(COMMIT_HASH) & ~version.rlike(r"^[0-9]+$")
    )


def clamp_pad(digits: Column, width: int) -> Column:
    """Zero-pad digits to ``width``; a value that does not fit becomes all nines.

    ``lpad`` alone would cut over-long input.
    """
    significant = F.ltrim(digits, F.lit("0"))
    return (
        F.when(F.length(digits) <= width, F.lpad(digits, width, "0"))
        .when(F.length(significant) <= width, F.lpad(significant, width, "0"))
        .otherwise(F.lit("9" * width))
    )


def _release_part(parts: Column) -> Column:
    """Six padded segments out of an array of digit strings; missing ones are zero."""
    return F.concat_ws(
        ".",
        *[
            F.when(F.size(parts) > i, clamp_pad(F.get(parts, F.lit(i)), SEGMENT_WIDTH)).otherwise(
                "0" * SEGMENT_WIDTH
            )
            for i in range(SEGMENTS)
        ],
    )


def _tag_part(rest: Column) -> Column:
    """Prerelease tags: numbers padded behind ``0``, words lower-cased behind ``1``.

    Written as replacements over the joined tags, because array lambdas would take the
    projection out of whole-stage code generation.
    """
    mark = "\u0001"
    tags = F.regexp_replace(F.lower(rest), r"[.\-_]+", ".")
    tags = F.regexp_replace(tags, r"^\.|\.$", "")
    tags = F.regexp_replace(tags, r"(?<![^.])(?=[^.]*[^0-9.])", "1")
    tags = F.regexp_replace(tags, r"(?<![^.])([0-9]{%d,})(?![^.])" % NUMERIC_TAG_WIDTH, "0$1")
    tags = F.regexp_replace(
        tags,
        r"(?<![^.])([0-9]{1,%d})(?![^.])" % (NUMERIC_TAG_WIDTH - 1),
        mark + "0" * NUMERIC_TAG_WIDTH + "$1",
    )
    return F.regexp_replace(tags, mark + r"[0-9]*([0-9]{%d})(?![^.])" % NUMERIC_TAG_WIDTH, "0$1")


def _by_scheme(
    plain: Column, semver: Column, pypi: Column, gem: Column, maven: Column
) -> Column:
    """Choose the reading that fits the scheme worked out in ``_scheme``."""
    scheme = F.col("_scheme")
    return (
        F.when(scheme == "plain", plain)
        .when(scheme == "semver", semver)
        .when(scheme == "pypi", pypi)
        .when(scheme == "gem", gem)
        .when(scheme == "maven", maven)
    )


def with_version_columns(
    df: DataFrame, ecosystem: str = "ecosystem", raw: str = "version_raw"
) -> DataFrame:
    """Add version_kind, comparable, exact_scheme, is_prerelease, epoch, version_sort_key."""
    eco = F.col("_eco")
    text = F.col("_text")
    bare = F.col("_bare")
    plain = F.col("_plain")

    df = df.withColumns(
        {
            "_eco": F.lower(F.coalesce(F.col(ecosystem), F.lit(""))),
            "_text": strip(percent_decode(F.coalesce(F.col(raw), F.lit("")))),
        }
    )
    df = df.withColumn("_plain", ~eco.isin("github", "githubactions") & text.rlike(_PLAIN_PATTERN))
    unprefixed = F.when(text.rlike(r"^[vV][0-9]"), F.substring(text, 2, 1 << 30)).otherwise(text)
    df = df.withColumns(
        {
            "_early": F.when(plain, F.lit(None))
            .when(text == "", "empty")
            .when(eco == "github", "branch")
            .when(
                eco == "githubactions",
                F.when(is_range_or_wildcard(text), "wildcard").otherwise("branch"),
            )
            .when(is_range_or_wildcard(text), "range"),
            "_bare": F.when(plain, text).otherwise(F.regexp_replace(unprefixed, r"^=\s*", "")),
        }
    )
    # The scheme decides which pattern reads the version. It is NULL when nothing is to
    # be parsed; an ecosystem without a scheme of its own tries semver, then pypi.
    df = df.withColumn(
        "_scheme",
        F.when(plain, "plain")
        .when(F.col("_early").isNotNull() | is_sha(bare), F.lit(None).cast("string"))
        .when(eco.isin(*SEMVER_FAMILY), "semver")
        .when(eco.isin("pypi", "gem", "maven"), eco)
        .when(bare.rlike(_SEMVER_PATTERN), "semver")
        .otherwise("pypi"),
    )
    lowered = strip(F.lower(bare))
    df = df.withColumns(
        {
            "_epoch": F.when(F.col("_scheme") == "pypi", F.regexp_extract(lowered, _PYPI_PATTERN, 1)),
            "_release": _by_scheme(
                plain=bare,
                semver=F.regexp_extract(bare, _SEMVER_PATTERN, 1),
                pypi=F.regexp_extract(lowered, _PYPI_PATTERN, 2),
                gem=F.regexp_extract(bare, _GEM_PATTERN, 1),
                maven=F.regexp_extract(bare, _MAVEN_PATTERN, 1),
            ),
            "_rest": _by_scheme(
                plain=F.lit(""),
                semver=F.regexp_extract(bare, _SEMVER_PATTERN, 2),
                pypi=F.regexp_extract(lowered, _PYPI_PATTERN, 3),
                gem=F.regexp_extract(bare, _GEM_PATTERN, 2),
                maven=F.lower(F.regexp_extract(bare, _MAVEN_PATTERN, 2)),
            ),
        }
    )
    df = df.withColumns(
        {
            "comparable": F.coalesce(F.col("_release") != "", F.lit(False)),
            "_pre": F.coalesce(
                (F.col("_release") != "")
                & _by_scheme(
                    plain=F.lit(False),
                    semver=F.col("_rest") != "",
                    pypi=F.col("_rest").rlike(PYPI_PRERELEASE),
                    gem=F.length("_release") < F.length(bare),
                    maven=F.col("_rest").rlike(MAVEN_PRERELEASE),
                ),
                F.lit(False),
            ),
            "_parts": F.split(F.col("_release"), r"\."),
            "_epoch": F.when(F.col("_epoch").rlike(r"^[0-9]+$"), F.col("_epoch")).otherwise("0"),
        }
    )
    outputs = {
        "comparable": F.col("comparable"),
        "version_kind": F.coalesce(
            F.col("_early"),
            F.when(F.col("_scheme").isNull(), "sha")
            .when(~F.col("comparable"), "unparseable")
            .when(F.col("_pre"), "prerelease")
            .otherwise("release"),
        ),
        "exact_scheme": eco.isin(*EXACT_SCHEMES),
        "is_prerelease": F.col("_pre"),
        "epoch": F.when(
            F.col("comparable"),
            F.coalesce(F.col("_epoch").try_cast("bigint"), F.lit((1 << 63) - 1)),
        ).otherwise(F.lit(0).cast("bigint")),
        "version_sort_key": F.when(
            F.col("comparable"),
            F.concat(
                clamp_pad(F.col("_epoch"), EPOCH_WIDTH),
                F.lit("!"),
                _release_part(F.col("_parts")),
                F.lit("."),
                F.when(F.col("_pre"), F.concat(F.lit("-"), _tag_part(F.col("_rest")))).otherwise(
                    "~"
                ),
            ),
        ),
    }
    scratch = {"_eco", "_text", "_plain", "_early", "_bare", "_scheme", "_epoch", "_release"}
    kept = [c for c in df.columns if c not in scratch | {"_parts", "_rest", "_pre", *outputs}]
    df = df.select(*kept, *[value.alias(f"_{name}") for name, value in outputs.items()])
    # The columns leave through a one-row generator. Without it the optimizer would push a
    # later filter on, say, version_kind down through every projection above, writing out
    # each of their expressions again at each use.
    row = F.struct(*[F.col(f"_{name}").alias(name) for name in outputs])
    return df.select(*kept, F.inline(F.array(row)))
