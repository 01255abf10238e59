"""What the physical plans must and must not contain."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bomatlas.functions import sql
from bomatlas.functions.numbers import round_half_up
from bomatlas.functions.purl import package_key
from bomatlas.functions.ranges import VersionRangeError, _key, parse_version_range
from bomatlas.operators import search
from workload import fixture as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return fx.index(spark, sf_dir)


def test_package_filter_reaches_the_scan(index):
    text = plan(search.of_package(index.current, "npm", "express").select("repo_full_name", "version_raw"))
    assert "EqualTo(ecosystem,npm)" in text and "EqualTo(package_key,express)" in text
    assert "ReadSchema: struct<repo_full_name:string,ecosystem:string,package_key:string,version_raw:string>" in text
    assert f"ingested_date#" in text.split("PartitionFilters:")[1].split("]")[0]


def test_org_prefix_and_range_reach_the_scan(index):
    assert "StringStartsWith(repo_full_name,nation_1/)" in plan(search.of_org(index.by_repo, "nation_1"))
    text = plan(search.in_range(index.current, ">=2 <3"))
    assert "GreaterThanOrEqual(version_sort_key," in text and "LessThan(version_sort_key," in text


def test_top_k_is_cut_before_the_shuffle(index):
    text = plan(search.top_versions(index.fact))
    first, last = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert first < text.index("Exchange hashpartitioning(ecosystem", first) < last


def test_snapshots_are_sorted_by_package(spark, index):
    files = index.current.select(
        F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "ecosystem", "package_key"
    ).collect()
    by_file = {}
    for r in sorted(files, key=lambda r: r.i):
        by_file.setdefault(r.f, []).append((r.ecosystem, r.package_key))
    assert by_file and all(keys == sorted(keys) for keys in by_file.values())


@pytest.mark.parametrize("name", ["search_dependency", "vulnerability_exposure_org", "cap_findings", "dependency_compare",
                                  "dependency_landscape", "agg_landscape_eol", "eval_decision", "metrics_compliance"])
def test_no_cross_products_and_no_row_udf(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_sql_ranges_agree_with_the_grammar(spark):
    """Every range of a small alphabet, read by the SQL functions and by the grammar."""
    sql.register(spark)
    draw = random.Random(1)
    texts = ["<2", ">=4 <5", "^3.17.0", "~2.10", "4.x", "=3.8.2", ">1, <=6.30", "1.2.3.4", "^0.0.3", "^0.1", "^0", "~1", "*", "1.2.3.x", "<2 || >3"]
    texts += ["", " ", ",", "==1", ">^1", "99999999999999999999", "^99999999999.2", "1.0.0-beta", "v1", "00012.1", None, "1.2 <"]
    texts += ["".join(draw.choice("0123.^~<>=x ,|") for _ in range(draw.randint(1, 9))) for _ in range(400)]

    def grammar(text):
        try:
            return parse_version_range(text)
        except VersionRangeError:
            return None

    keys = [_key(v) for v in ([2], [4, 0, 1], [0, 0, 3], [0, 1, 7], [3, 17, 2], [12, 1], [1, 2, 3, 4])]
    want = {t: grammar(t) for t in texts}
    rows = [(t, k) for t in want for k in keys]
    frame = spark.createDataFrame(rows, "version_range string, version_sort_key string")
    compare = {">=": str.__ge__, ">": str.__gt__, "<=": str.__le__, "<": str.__lt__, "=": str.__eq__}
    for text, key, hit in frame.selectExpr("*", "satisfies(version_sort_key, version_range)").collect():
        bounds = want[text]
        assert hit == (None if bounds is None else all(compare[op](key, bound) for op, bound in bounds)), (text, key)
    assert spark.sql("SELECT satisfies(NULL, '<2')").first()[0] is False
    for text in ("<2", ">=4 <5", "~2.10", "4.x"):
        found = spark.sql("SELECT * FROM parse_version_range(:text)", {"text": text}).collect()
        assert [tuple(r) for r in found] == want[text]
    with pytest.raises(Exception, match="unreadable version range"):
        spark.sql("SELECT * FROM parse_version_range('<2 || >3')").collect()


def test_sql_functions_agree_with_columns(spark):
    assert sql.register(spark) == ["package_key", "is_copyleft", "rate_pct", "satisfies", "parse_version_range", "round_half_up"]
    df = spark.createDataFrame(
        [("pypi", "A_.b", "AGPL-3.0", 1.005), ("npm", "A_b", "MIT", 2.5), ("npm", None, None, 0.0)],
        "ecosystem string, name string, lic string, x double",
    )
    row = df.select(
        F.bool_and(F.expr("package_key(ecosystem, name)") == package_key(F.col("ecosystem"), F.col("name"))).alias("k"),
        F.bool_and(F.expr("round_half_up(x)") == round_half_up(F.col("x"))).alias("r"),
        F.count_if(F.expr("is_copyleft(lic)")).alias("c"),
        F.max(F.expr("rate_pct(x, 0)")).alias("z"),
    ).first()
    assert tuple(row) == (True, True, 1, 0.0)
