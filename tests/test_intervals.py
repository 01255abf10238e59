"""Points in spans against brute force, and how many rows the join makes."""

import random

import pytest
from pyspark.sql import functions as F

from bomatlas.operators import exposure, intervals

SPAN = "g int, id int, low string, below string, upto string"


def brute(points, spans):
    return {
        (g, k, i)
        for g, k in points
        if k is not None
        for h, i, low, below, upto in spans
        if g == h and (low is None or k >= low) and (below is None or k < below) and (upto is None or k <= upto)
    }


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    key = lambda: None if draw.random() < 0.2 else f"{draw.randrange(40):02}"
    points = [(draw.randrange(3), key()) for _ in range(90)] + [(7, "05")]
    spans = [(draw.randrange(4), i, key(), *((key(), None) if draw.random() < 0.5 else (None, key()))) for i in range(60)]
    spans += [(0, 100, None, None, None), (0, 101, "10", "10", None), (0, 102, "10", None, "10"), (0, 103, "30", "05", "20")]
    found = intervals.stabbed(
        spark.createDataFrame(points, "g int, k string"), spark.createDataFrame(spans, SPAN), ["g"], "k", "low", "below", "upto"
    )
    rows = [(r.g, r.k, r.id) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(points, spans)


def test_ten_thousand_versions_and_spans(spark):
    """The join makes the matches and no other pair; both sides grow by a logarithm."""
    n = 10_000
    points = spark.range(n).select(F.lit(1).alias("g"), F.format_string("%06d", "id").alias("k"))
    low, end = F.format_string("%06d", "id"), F.format_string("%06d", F.col("id") + 1 + F.col("id") % 5)
    spans = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("id"), low.alias("low"), end.alias("below"), F.lit(None).cast("string").alias("upto"))
    ranked = intervals.ranked_points(points, ["g"], "k")
    covered = intervals.covered_ranks(ranked, spans, ["g"], "k", "low", "below", "upto")
    assert intervals.point_nodes(ranked, ["g"]).count() <= n * 14
    assert intervals.span_nodes(covered).count() <= n * 4
    matches = intervals.stabbed(points, spans, ["g"], "k", "low", "below", "upto").count()
    assert matches == sum(min(n, i + 1 + i % 5) - i for i in range(n))


def test_exposure_of_a_crowded_package(spark):
    """A package with more spans than are compared one by one has the same findings, whatever the limit."""
    event = "struct<introduced: string, fixed: string, last_affected: string>"
    schema = (
        "id string, aliases array<string>, affected array<struct<package: struct<ecosystem: string, name: string>, "
        f"ranges array<struct<type: string, events: array<{event}>>>, versions: array<string>>>"
    ).replace("ranges array", "ranges: array")
    draw = random.Random(2)

    def advisory(i, name):
        begin = (str(draw.randrange(9)), None, None) if draw.random() < 0.8 else ("0", None, None)
        end = (None, f"{draw.randrange(12)}.{draw.randrange(5)}", None) if draw.random() < 0.6 else (None, None, f"{draw.randrange(12)}.1")
        return (f"A{i}", [], [(("npm", name), [("SEMVER", [begin, end]), ("SEMVER", [(None, "0.5.0", None)])], ["3.1.0"])])

    advisories = spark.createDataFrame([advisory(i, "busy" if i % 3 else f"p{i % 5}") for i in range(60)], schema)
    from bomatlas.functions.versions import with_version_columns

    used = [("npm", name, f"{a}.{b}.0") for name in ("busy", "p0", "p3", "other") for a in range(10) for b in range(3)] + [("npm", "busy", "v1.0.0"), ("npm", "busy", "latest")]
    ids = with_version_columns(spark.createDataFrame(used, "ecosystem string, package_key string, version_raw string")).select(*exposure.IDENTITY, "version_sort_key")
    all_direct = {tuple(r) for r in exposure.exposed(ids, advisories, direct=1000).collect()}
    assert all_direct and ("npm", "busy", "v1.0.0") in {r[:3] for r in all_direct}
    for direct in (0, 10):
        rows = [tuple(r) for r in exposure.exposed(ids, advisories, direct=direct).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == all_direct


ADVISORY = (
    "id string, aliases array<string>, summary string, details string, severity array<struct<type: string, score: string>>, database_specific struct<severity: string>, "
    "affected array<struct<package: struct<ecosystem: string, name: string>, ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>, versions: array<string>>>"
)


def test_merged_ranks(spark):
    rows = [(1, 0, 3), (1, 2, 5), (1, 5, 6), (1, 8, 9), (1, 0, 3), (1, 1, 2), (2, 4, 5), (None, 1, 2), (None, 0, 4)]
    found = intervals.merged(spark.createDataFrame(rows, "g int, _from long, _to long"), ["g"]).collect()
    assert {tuple(r) for r in found} == {(1, 0, 6), (1, 8, 9), (2, 4, 5), (None, 0, 4)} and len(found) == 4


def test_many_advisories_of_many_versions_are_paired_last(spark):
    """Every advisory affects every version: the join makes the pairs, what it reads is far less and no place is large."""
    n = 600
    ids = spark.range(n).select(
        F.lit("npm").alias("ecosystem"), F.lit("busy").alias("package_key"), F.concat(F.lit("1."), F.col("id").cast("string")).alias("version_raw"),
        F.format_string("%06d", "id").alias("version_sort_key"),
    )
    ids = ids.unionByName(ids.limit(3)).unionByName(spark.createDataFrame([("npm", "busy", "listed", None)], "ecosystem string, package_key string, version_raw string, version_sort_key string"))
    # Open ranges twice over, and a listed version without a key.
    events = [[("0", None, None)], [("0", None, None), (None, "9999999999.0.0", None)]]
    schema_rows = [(f"A{i}", [], "s", "d", None, None, [(("npm", "busy"), [("SEMVER", e) for e in events], ["listed", "1.7", "unused"])]) for i in range(n)]
    advisories = spark.createDataFrame(schema_rows, ADVISORY)
    for direct in (0, 64):
        versions, spans = exposure.meetings(ids, advisories, direct)
        assert versions.count() + spans.count() < 60 * n
        assert spans.groupBy(*exposure.PLACE).count().agg(F.max("count")).first()[0] <= 2 * exposure.SPANS_AT_ONCE
        hits = exposure.exposed(ids, advisories, direct)
        assert hits.count() == hits.distinct().count() == n * (n + 1)


def test_advisories_are_counted_without_pairs(spark):
    """Each of a package's versions has all its advisories; the counts read a few places, and no join makes the pairs."""
    n = 500
    ids = spark.range(n).select(
        F.lit("npm").alias("ecosystem"), F.lit("busy").alias("package_key"), F.concat(F.lit("1."), F.col("id").cast("string")).alias("version_raw"),
        F.format_string("%06d", "id").alias("version_sort_key"),
    )
    ids = ids.unionByName(ids.limit(2)).unionByName(spark.createDataFrame([("npm", "busy", "listed", None), ("npm", "idle", "1.1", "1")], "ecosystem string, package_key string, version_raw string, version_sort_key string"))
    events = [[("0", None, None)], [("0", None, None), (None, "9999999999.0.0", None)]]
    rows = [(f"A{i}", [], "s", "d", None, None, [(("npm", "busy"), [("SEMVER", e) for e in events], ["listed"] if i % 2 else ["1.3"])]) for i in range(n)]
    advisories = spark.createDataFrame(rows + rows[:5], ADVISORY)
    for direct in (0, 64):
        found = exposure.advisory_counts(ids, advisories, direct)
        got = sorted(map(tuple, found.collect()))
        pairs = exposure.exposed(ids, advisories, direct).groupBy(*exposure.IDENTITY).agg(F.count("*"), F.min("id"))
        assert got == sorted(map(tuple, pairs.collect())) and len(got) == n + 1
        points, nodes = exposure._places(ids, advisories, direct)
        assert nodes.select("_level", "_node").distinct().count() < 100
        assert exposure.point_nodes(points, ["ecosystem", "package_key"]).count() < 12 * n


def test_findings_move_no_pair(spark):
    """Nothing is dealt again above the join that makes the findings."""
    fact = spark.createDataFrame(
        [(f"o/r{i % 4}", "npm", "busy", "Busy", f"{i % 9}.0.0", f"{i % 9}", "release") for i in range(40)],
        "repo_full_name string, ecosystem string, package_key string, package_name string, version_raw string, version_sort_key string, version_kind string",
    )
    advisories = spark.createDataFrame(
        [("A1", [], "s", "d", None, None, [(("npm", "busy"), [("SEMVER", [("0", None, None)])], ["3.0.0"])])] * 2, ADVISORY
    )
    found = exposure.findings(fact, advisories, ["repo_full_name"])
    assert found.count() == 2 * fact.select("repo_full_name", "version_raw").distinct().count()
    lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert not [line for line in lines[: joins[0]] if "Exchange" in line or "Aggregate" in line]
    assert "_slice" in lines[joins[0]]
