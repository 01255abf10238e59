"""Functions under SQL names, as expressions the optimizer sees through.

``satisfies(version_sort_key, range)`` tests a key against a range, and the table function
``parse_version_range(range)`` gives a range's comparators: the rules of
:mod:`bomatlas.functions.ranges`, for queries written in SQL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from bomatlas.functions.licences import COPYLEFT
from bomatlas.functions.versions import EPOCH_WIDTH, SEGMENT_WIDTH, SEGMENTS

_BIGGEST = f"{10**SEGMENT_WIDTH - 1}L"


def _part(index: int) -> str:
    """A token's number at ``index``, 0 where it has none, at most what a key holds."""
    text = f"coalesce(get(t.digits, {index}), '0')"
    return f"least(coalesce(try_cast({text} AS BIGINT), {_BIGGEST}), {_BIGGEST})"


def _bound(op: str, *parts: str) -> str:
    digits = ", ".join(f"CAST({part} AS STRING)" for part in parts)
    return f"named_struct('op', '{op}', 'digits', array({digits}))"


def _comparators(text: str) -> str:
    """``ARRAY<STRUCT<op, key>>`` of a range; NULL for one that can't be read.

    Tokens are split up, then bounded, then keyed; a token without bounds makes the whole NULL.
    """
    tokens = f"filter(split({text}, r'[\\s,]+'), t -> t <> '')"
    split_up = (
        f"transform({tokens}, t -> named_struct('op', regexp_extract(t, r'^([<>]=?|=)', 1), 'prefix', regexp_extract(t, r'^([\\^~])', 1), "
        "'wild', t RLIKE '[xX*]', 'digits', filter(split(regexp_extract(t, "
        r"r'^(?:[<>]=?|=|[\^~])?((?:[0-9]+(?:\.|$))*)', 1), r'\.'), d -> d <> '')))"
    ).replace("\\\\", "\\")
    a, b, c = (_part(i) for i in range(3))
    low = _bound(">=", a, b, c)
    to_major, to_minor, to_patch = _bound("<", f"{a} + 1"), _bound("<", a, f"{b} + 1"), _bound("<", a, b, f"{c} + 1")
    high = (
        f"CASE WHEN t.prefix = '^' AND {a} = 0 AND size(t.digits) > 1 THEN CASE WHEN {b} > 0 OR size(t.digits) = 2 THEN {to_minor} ELSE {to_patch} END "
        f"WHEN t.prefix <> '^' AND size(t.digits) > 1 THEN {to_minor} ELSE {to_major} END"
    )
    bounded = (
        f"transform({split_up}, t -> CASE WHEN size(t.digits) = 0 THEN NULL "
        "WHEN t.op <> '' THEN array(named_struct('op', t.op, 'digits', t.digits)) "
        "WHEN t.prefix = '' AND size(t.digits) > 2 THEN CASE WHEN NOT t.wild THEN array(named_struct('op', '=', 'digits', t.digits)) END "
        f"ELSE array({low}, {high}) END)"
    )
    padded = f"slice(concat(c.digits, array_repeat('0', {SEGMENTS})), 1, {SEGMENTS})"
    short = "trim(LEADING '0' FROM d)"
    clamped = f"CASE WHEN length({short}) > {SEGMENT_WIDTH} THEN repeat('9', {SEGMENT_WIDTH}) ELSE lpad({short}, {SEGMENT_WIDTH}, '0') END"
    key = f"concat('{'0' * EPOCH_WIDTH}!', array_join(transform({padded}, d -> {clamped}), '.'), '.~')"
    return (
        f"CASE WHEN {text} RLIKE r'[^\\s,]' AND NOT contains({text}, '||') "
        f"THEN transform(flatten({bounded}), c -> named_struct('op', c.op, 'key', {key})) END"
    )

# name, parameters, result type, body
_FUNCTIONS = (
    (
        "package_key",
        "ecosystem STRING, name STRING",
        "STRING",
        "lower(CASE WHEN lower(ecosystem) = 'pypi' "
        "THEN regexp_replace(coalesce(name, ''), '[-_.]+', '-') ELSE coalesce(name, '') END)",
    ),
    ("is_copyleft", "license_id STRING", "BOOLEAN", f"license_id RLIKE '{COPYLEFT}'"),
    (
        "rate_pct",
        "part DOUBLE, total DOUBLE",
        "DOUBLE",
        "CASE WHEN total > 0 THEN part / total * 100.0D ELSE 0.0D END",
    ),
    (
        "satisfies",
        "version_sort_key STRING, version_range STRING",
        "BOOLEAN",
        f"version_sort_key IS NOT NULL AND forall({_comparators('version_range')}, c -> CASE c.op WHEN '>=' THEN version_sort_key >= c.key "
        "WHEN '>' THEN version_sort_key > c.key WHEN '<=' THEN version_sort_key <= c.key WHEN '<' THEN version_sort_key < c.key "
        "ELSE version_sort_key = c.key END)",
    ),
    (
        "parse_version_range",
        "version_range STRING",
        "TABLE (op STRING, key STRING)",
        f"SELECT c.op, c.key FROM (SELECT explode(coalesce({_comparators('version_range')}, "
        "raise_error(concat('unreadable version range: ', coalesce(version_range, 'NULL'))))) AS c)",
    ),
    ("round_half_up", "x DOUBLE", "DOUBLE", "floor(x * 100.0D + 0.5D) / 100.0D"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, parameters, result, body in _FUNCTIONS:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}"
        )
    return [f[0] for f in _FUNCTIONS]
