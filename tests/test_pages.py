"""Keyset pages against the sorted list, and what they read; repositories in a locale's order."""

import random

import pytest
from pyspark.sql import functions as F

from bomatlas.operators import pages, search
from bomatlas.session import run_path

SCHEMA = "ecosystem string, package_key string, repo_full_name string, version_sort_key string, version_raw string, version_kind string"


def entries(n, package="express"):
    draw = random.Random(n)
    keys = [draw.choice([None, *(f"k{i:03d}" for i in range(40))]) for _ in range(n)]
    return [("npm", package, f"o/{i:05d}", key, key, "semver") for i, key in enumerate(keys)]


def in_order(rows):
    rows = sorted(rows, key=lambda r: r[2])
    rows = sorted(rows, key=lambda r: r[3] or "", reverse=True)
    return [r[2] for r in rows]


def scanned(page):
    """Rows that the page's scan gave to the plan."""
    page.collect()
    plan = page._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.mark.parametrize("files", [1, 7])
def test_pages_one_after_the_other(spark, files):
    rows = entries(3000) + entries(5, "a") + entries(2100, "z")
    path = run_path(spark, "pages")
    pages.write_order(spark.createDataFrame(rows, SCHEMA).repartition(5), path, files)
    for package, limit in (("express", 700), ("a", 2), ("z", 2100), ("z", 5000)):
        seen, cursor = [], None
        while True:
            page = pages.page_after(spark, path, "npm", package, cursor, limit)
            got = [r.repo_full_name for r in page.collect()]
            seen += got
            cursor = pages.cursor_of(page)
            if len(got) < limit:
                break
        assert seen == in_order([r for r in rows if r[1] == package])
    assert pages.page_after(spark, path, "npm", "none").count() == 0
    assert pages.cursor_of(pages.page_after(spark, path, "npm", "none")) is None
    # A row that is gone is a cursor still, one with and one without a sort key.
    want = in_order([r for r in rows if r[1] == "express"])
    keyed = {r[2]: r[3] for r in rows if r[1] == "express"}
    for at in (100, 2999):
        gone = pages.Cursor(keyed[want[at]], want[at] + "-gone")
        assert [r.repo_full_name for r in pages.page_after(spark, path, "npm", "express", gone, 3).collect()] == want[at + 1 : at + 4]


def test_a_late_page_reads_its_own_rows(spark):
    path = run_path(spark, "pages")
    many = spark.range(150_000).select(
        F.lit("npm").alias("ecosystem"),
        F.lit("express").alias("package_key"),
        F.format_string("o/%06d", "id").alias("repo_full_name"),
        F.lit("k").alias("version_sort_key"),
        F.lit("1").alias("version_raw"),
        F.lit("semver").alias("version_kind"),
    )
    pages.write_order(many, path, 3)
    page = pages.page_after(spark, path, "npm", "express", pages.Cursor("k", "o/100000"), 50)
    assert [r.repo_full_name for r in page.collect()] == [f"o/{i:06d}" for i in range(100_001, 100_051)]
    assert scanned(page) <= 5 * pages.BLOCK


def test_empty_order(spark):
    path = run_path(spark, "pages")
    pages.write_order(spark.createDataFrame([], SCHEMA), path)
    assert pages.page_after(spark, path, "npm", "express").count() == 0
    with pytest.raises(ValueError):
        pages.page_after(spark, path, "npm", "express", limit=0)


def test_repositories_in_locale_order(spark):
    names = ["b/x", "B/x", "é/x", "e/y", "E/x", "a-b/x", "a_b/x", "ab/x", "Z/x"]
    frame = spark.createDataFrame([("npm", "p", n, "k", "1", "semver") for n in names], SCHEMA)
    want = ["a_b/x", "a-b/x", "ab/x", "b/x", "B/x", "E/x", "é/x", "e/y", "Z/x"]
    assert [r.repo_full_name for r in search.page(frame, collation="UNICODE").orderBy("rank").collect()] == want
    assert [r.repo_full_name for r in search.page_one(frame, collation="UNICODE").collect()] == want
    assert [r.repo_full_name for r in search.page(frame).orderBy("rank").collect()] == sorted(names)
