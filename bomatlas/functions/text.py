"""String helpers shared by the package-URL, version and document code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove leading and trailing white space (Spark's ``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def split_once(text: Column, mark: str) -> tuple[Column, Column]:
    """What comes before and after the first ``mark``; nothing after if there is none."""
    before = F.substring_index(text, mark, 1)
    return before, F.substring(text, F.length(before) + F.lit(1 + len(mark)), F.lit(1 << 30))


def percent_decode(text: Column) -> Column:
    """Lenient ``%XX`` decoding: ``+`` stays a plus, a bad escape stays as written.

    ``url_decode`` follows the form rules (``+`` is a space, ``%zz`` is an error), so
    both cases are escaped first. Strings without ``%`` skip the work altogether.
    """
    escaped = F.regexp_replace(
        F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
    )
    return F.when(F.contains(text, F.lit("%")), F.url_decode(escaped)).otherwise(text)


def percent_encode(text: Column) -> Column:
    """Encode one path component; a space becomes ``%20``."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def ellipsis(text: Column, limit: int) -> Column:
    """Cut text beyond ``limit`` characters and mark the cut with three dots."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)
