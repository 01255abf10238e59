"""Package URLs: ``pkg:<type>/<namespace>/<name>@<version>?<qualifiers>#<subpath>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.functions.text import percent_decode, split_once

# Fixed value: the ecosystems the index knows.
KNOWN_ECOSYSTEMS = (
    "npm",
    "pypi",
    "gem",
    "maven",
    "nuget",
    "golang",
    "cargo",
    "composer",
    "pub",
    "swift",
    "apk",
    "githubactions",
    "github",
)
# Fixed value: types that name a repository or a CI step rather than a package.
SELF_REF_ECOSYSTEM = "github"
ACTION_ECOSYSTEM = "githubactions"


def package_key(ecosystem: Column, name: Column) -> Column:
    """Match key of a package: lower case, and for pypi runs of ``-_.`` become ``-``."""
    name = F.coalesce(name, F.lit(""))
    return F.lower(
        F.when(
            F.lower(ecosystem) == "pypi", F.regexp_replace(name, r"[-_.]+", "-")
        ).otherwise(name)
    )


def package_key_text(ecosystem: str, name: str) -> str:
    """The same key for one literal, used to build pushed-down equality filters."""
    import re

    return (re.sub(r"[-_.]+", "-", name) if ecosystem.lower() == "pypi" else name).lower()


def package_keys_any_ecosystem(name: str) -> list[str]:
    """Every key one name can have, whatever its ecosystem."""
    return sorted({package_key_text(eco, name) for eco in KNOWN_ECOSYSTEMS} | {name.lower()})


def with_purl_columns(df: DataFrame, purl: str = "purl") -> DataFrame:
    """Add ecosystem, package_name, package_key, purl_version and the two type flags.

    Rows whose purl is missing or not a package URL are dropped. The version follows the
    last ``@`` (an encoded scope has no literal one) and is ``''`` when absent; the type
    ends at the first ``/``.
    """
    version = F.col("purl_version")
    bodies = df.where(F.startswith(F.col(purl), F.lit("pkg:"))).withColumn(
        "_body",
        F.substring_index(F.substring_index(F.substring(F.col(purl), 5, 1 << 30), "#", 1), "?", 1),
    )
    # Each step reads columns of the step before, so that nothing is cut out twice.
    split_up = bodies.withColumn(
        "purl_version",
        F.when(F.contains("_body", F.lit("@")), F.substring_index("_body", "@", -1)),
    ).withColumn(
        "_named",
        F.when(version.isNull(), F.col("_body")).otherwise(
            F.left("_body", F.length("_body") - F.length(version) - F.lit(1))
        ),
    )
    ecosystem, name = split_once(F.col("_named"), "/")
    decoded = (
        split_up.withColumns({"ecosystem": ecosystem, "package_name": name})
        .withColumns(
            {
                "ecosystem": F.lower(percent_decode(F.col("ecosystem"))),
                "package_name": percent_decode(F.col("package_name")),
                "purl_version": percent_decode(F.coalesce(version, F.lit(""))),
            }
        )
        .drop("_body", "_named")
    )
    return decoded.withColumns(
        {
            "package_key": package_key(F.col("ecosystem"), F.col("package_name")),
            "is_self_ref": F.col("ecosystem") == SELF_REF_ECOSYSTEM,
            "is_action": F.col("ecosystem") == ACTION_ECOSYSTEM,
        }
    )
