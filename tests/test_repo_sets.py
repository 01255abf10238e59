"""Stored sets of repositories against counts over the facts."""

import datetime as dt
import random

import pytest

from bomatlas.operators import repo_sets
from bomatlas.session import run_path

SCHEMA = "ecosystem string, package_key string, ingested_date date, repo_full_name string"


def rows_of(date, seed, repos, packages):
    draw = random.Random(seed)
    out = []
    for p in range(packages):
        n = repos if p == 0 else draw.randint(1, 12)  # one package is used nearly everywhere
        out += [("npm" if p % 2 else "pypi", f"p{p}", date, f"o/{draw.randrange(repos)}") for _ in range(n)]
    return out


def partition_files(base, date):
    from pathlib import Path

    return {(f.name, f.stat().st_mtime_ns) for f in Path(base, "sets", f"ingested_date={date}").glob("*.parquet")}


@pytest.mark.parametrize("list_most", [0, 5, 10_000])
def test_sets_equal_counts_over_the_facts(spark, list_most):
    days = [dt.date(2025, 1, d) for d in (1, 2, 3)]
    rows = [r for i, day in enumerate(days) for r in rows_of(day, i, 40 + 30 * i, 12)]
    rows += [("npm", None, days[0], "o/1"), ("npm", "p1", days[0], None), *rows[:20]]
    base = run_path(spark, "sets")
    repo_sets.create(spark, base)
    for day in days:  # one after the other, the last twice
        repo_sets.add_snapshots(spark, base, spark.createDataFrame([r for r in rows if r[2] == day], SCHEMA), list_most)
    before = repo_sets.numbers(spark, base).collect()
    untouched = partition_files(base, days[0])
    repo_sets.add_snapshots(spark, base, spark.createDataFrame([r for r in rows if r[2] == days[2]], SCHEMA), list_most)
    assert partition_files(base, days[0]) == untouched
    assert sorted(repo_sets.numbers(spark, base).collect()) == sorted(before)
    assert len({r.number for r in before}) == len(before) == len({r[3] for r in rows if r[3]})
    sets = repo_sets.read(spark, base)
    whole = [r for r in rows if None not in r]

    def want(*at):
        groups = {}
        for r in whole:
            groups.setdefault(tuple(r[i] for i in at), set()).add(r[3])
        return {(*key, len(repos)) for key, repos in groups.items()}

    assert {tuple(r) for r in repo_sets.snapshots(sets).collect()} == want(0, 1, 2)
    for keys, at in ((["ecosystem", "package_key"], (0, 1)), (["ingested_date"], (2,)), (["ecosystem", "ingested_date"], (0, 2)), ([], ())):
        assert {tuple(r) for r in repo_sets.distinct_repos(sets, keys, list_most).collect()} == want(*at)
    two = repo_sets.distinct_repos(sets.where("ingested_date <= '2025-01-02'"), ["package_key"], 5)
    assert two.where("package_key = 'p0'").first().repo_count == len({r[3] for r in whole if r[1] == "p0" and r[2] < days[2]})


def test_lists_and_bitmaps_of_one_block_meet(spark):
    """The same package is a bitmap on one date and a list on another."""
    base = run_path(spark, "sets")
    repo_sets.create(spark, base)
    many = [("npm", "p", dt.date(2025, 1, 1), f"o/{i}") for i in range(300)]
    few = [("npm", "p", dt.date(2025, 1, 2), f"o/{i}") for i in (7, 8, 900)]
    repo_sets.add_snapshots(spark, base, spark.createDataFrame(many + few, SCHEMA).coalesce(1), 20)
    assert repo_sets.read(spark, base).where("bits is null").count() and repo_sets.read(spark, base).where("spots is null").count()
    assert repo_sets.distinct_repos(repo_sets.read(spark, base), repo_sets.PACKAGE, 20).first().repo_count == 301


def test_empty_store(spark):
    base = run_path(spark, "sets")
    repo_sets.create(spark, base)
    repo_sets.add_snapshots(spark, base, spark.createDataFrame([], SCHEMA))
    assert repo_sets.snapshots(repo_sets.read(spark, base)).count() == 0
    assert repo_sets.distinct_repos(repo_sets.read(spark, base), []).first().repo_count == 0


def test_counts_read_no_bitmaps(spark):
    base = run_path(spark, "sets")
    repo_sets.create(spark, base)
    plan = repo_sets.snapshots(repo_sets.read(spark, base))._jdf.queryExecution().executedPlan().toString()
    assert "bits" not in plan and "spots" not in plan
