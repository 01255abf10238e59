"""Small hand-made frames with known answers, and brute-force comparisons."""

import datetime as dt
import json
import math
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomatlas.operators import compare, cost, evaluation, exposure, ingest_stats, landscape, listing, metrics, results
from bomatlas.operators import retrieval, search, trends
from bomatlas.operators.eol import eol_status
from bomatlas.operators.ranking import percentiles, top_per_group
from bomatlas.sources import refdata
from bomatlas.sources.refdata import ADVISORY_SCHEMA, advisory_package_name
from tests.test_sources import fact_row


def npm(spark, pairs, name="express"):
    return fact_row(spark, [(repo, f"pkg:npm/{name}@{v}", "2025-01-01") for repo, v in pairs])


def test_search_counts_declared_ranges(spark):
    fact = npm(spark, [("a/1", "4.18.2"), ("a/2", "5.2.1"), ("a/3", "4.17.1"), ("a/4", "%5E4.14.0")])
    summary = search.search_dependency(fact, None, "express", "npm", "<2")["summary"].first()
    assert (summary.total_repo_count, summary.matched_repo_count, summary.declared_range) == (4, 0, 1)
    assert summary.range_exact


def test_repo_matches_with_any_of_its_versions(spark):
    fact = npm(spark, [("mono/repo", "1.5.0"), ("mono/repo", "4.18.2"), ("other/repo", "4.18.2")])
    answer = search.search_dependency(fact, None, "Express", "npm", "<2")
    assert answer["summary"].first().matched_repo_count == 1
    assert [(r.repo_full_name, r.version) for r in answer["repos"].collect()] == [("mono/repo", "1.5.0")]
    assert [(r.version_raw, r.repos) for r in answer["top_versions"].collect()] == [("4.18.2", 2), ("1.5.0", 1)]


def test_pages_are_as_large_as_asked(spark):
    fact = npm(spark, [(f"o/r{i:03}", "1.0.0") for i in range(600)])
    first = search.search_dependency(fact, None, "express", "npm", limit=500)["repos"].collect()
    assert len(first) == 500 and {r.next_offset for r in first} == {500}
    rest = search.search_dependency(fact, None, "express", "npm", limit=500, offset=500)["repos"].collect()
    assert len(rest) == 100 and {r.next_offset for r in rest} == {None}
    assert search.search_dependency(fact, None, "express", "npm", limit=999_999)["repos"].count() == 600
    for bad in ({"limit": 0}, {"offset": -5}):
        with pytest.raises(ValueError):
            search.search_dependency(fact, None, "express", "npm", **bad)


def test_pages_reach_the_last_entry(spark):
    entries = spark.range(100_700).select(
        F.lit("npm").alias("ecosystem"), F.lit("x").alias("package_key"),
        F.format_string("o/r%06d", "id").alias("repo_full_name"), F.lit("k").alias("version_sort_key"),
        F.lit("1").alias("version_raw"), F.lit("release").alias("version_kind"),
    )
    seen, offset = 0, 0
    while offset is not None:
        row = search.page(entries, 50_000, offset).agg(
            F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("next_offset").alias("more")
        ).first()
        assert (row.low, row.high) == (offset + 1, offset + row.n)
        seen, offset = seen + row.n, row.more
    assert seen == 100_700


def test_summary_answers_every_watched_package(spark):
    fact = npm(spark, [("a/1", "4.18.2"), ("a/2", "1.0.0")])
    watch = spark.createDataFrame(
        [("npm", "express", "<2", False), ("npm", "no-such-package", "<2", False), ("npm", "left-pad", "latest", False)],
        "ecosystem string, package_key string, version_range string, include_prereleases boolean",
    )
    got = {r.package_key: (r.total_repo_count, r.matched_repo_count, r.error) for r in search.search_summary(fact, watch).collect()}
    assert got == {"express": (2, 1, None), "no-such-package": (0, 0, None), "left-pad": (0, None, "unreadable version range")}


def test_argument_checks(spark):
    with pytest.raises(ValueError, match="ecosystem"):
        search.search_dependency(None, None, "x", version_range="<2")
    with pytest.raises(ValueError, match="unknown ecosystem"):
        search.search_dependency(None, None, "x", "cobol")
    with pytest.raises(ValueError):
        exposure.vulnerability_exposure(None, None, None)
    with pytest.raises(ValueError, match="ecosystem"):
        exposure.vulnerability_exposure(None, None, None, package="x")
    with pytest.raises(ValueError):
        results.shape(None, "u", F.lit(""), "everything")


def test_prereleases(spark):
    fact = npm(spark, [("o/pre", "2.0.0-rc.1"), ("o/rel", "2.0.0")])
    names = lambda df: sorted(r.repo_full_name for r in df.collect())
    assert names(search.in_range(fact, "<2", True)) == ["o/pre"]
    assert names(search.in_range(fact, "<2")) == []
    assert names(search.in_range(fact, ">=2.0.0", True)) == ["o/rel"]


def by_repo(spark, rows):
    return spark.createDataFrame(
        rows, "repo_full_name string, ecosystem string, package_name string, package_key string, version_raw string, "
        "version_kind string, license_id string"
    )


def test_compare(spark):
    rows = [("o/a", "npm", "express"), ("o/a", "npm", "lodash"), ("o/b", "npm", "express"), ("o/b", "npm", "axios")]
    listing_rows = by_repo(spark, [(r, e, n, n, "1.0.0", "release", None) for r, e, n in rows])
    pairs = spark.createDataFrame([("o/a", "o/b"), ("o/x", "o/y")], "repo_a string, repo_b string")
    got = {r.repo_a: r for r in compare.dependency_compare(listing_rows, pairs).collect()}
    assert (got["o/a"].shared_count, got["o/a"].overlap_pct) == (1, 33.3)
    assert (got["o/x"].deps_a, got["o/x"].overlap_pct) == (0, 0.0)
    labels = compare.listed_labels(listing_rows, pairs).first()
    assert (labels.shared, labels.only_in_a, labels.only_in_b) == (["npm:express"], ["npm:lodash"], ["npm:axios"])


def test_exposure(spark):
    fact = npm(spark, [(f"o/r{i}", "2.5.11") for i in range(5)] + [("o/z", "4.18.2")])
    advisories = spark.createDataFrame(
        [("GHSA-1", ["x", "cve-2020-1"], "", "d" * 300, None, None,
          [(("npm", "express"), [("SEMVER", [("0", None, None), (None, "3.0.0", None)])], None),
           (("npm", "express"), None, ["2.5.11"])]),
         ("GHSA-2", None, "s", "d", [("CVSS", "CVSS:3.1")], ("low",),
          [(("Elsewhere", "express"), [("SEMVER", [("0", None, None), (None, "9", None)])], None)])],
        ADVISORY_SCHEMA,
    )
    rows = exposure.findings(fact, advisories).collect()
    assert [(r.version, r.affected_repo_count, r.id, r.cve, r.severity, len(r.summary)) for r in rows] == [
        ("2.5.11", 5, "GHSA-1", "cve-2020-1", "UNKNOWN", 200)
    ]
    report = exposure.vulnerability_exposure(fact, None, advisories, package="express", ecosystem="npm").collect()
    assert len(report) == 1 and len(report[0].repos_sample) == 5 and report[0].vulnerable_versions == 1
    name = spark.createDataFrame([("maven", "g/a/b")], "e string, n string")
    assert name.select(advisory_package_name(F.col("e"), F.col("n")).alias("n")).first().n == "g:a/b"


def test_advisory_spans(spark, tmp_path):
    """The published format: several spans in a range, last_affected, open ends, commits, unknown ecosystems."""
    events = lambda *pairs: [{k: v} for k, v in pairs]
    dump = [
        {"id": "A", "affected": [{"package": {"ecosystem": "npm", "name": "express"}, "ranges": [
            {"type": "SEMVER", "events": events(("introduced", "1.0.0"), ("fixed", "1.5.0"), ("introduced", "2.0.0"), ("last_affected", "2.3.0"))},
            {"type": "GIT", "events": events(("introduced", "0"))}]}]},
        {"id": "B", "affected": [{"package": {"ecosystem": "npm", "name": "express"}, "ranges": [{"type": "SEMVER", "events": events(("introduced", "5"))}]}]},
        {"id": "C", "affected": [{"package": {"ecosystem": "npm", "name": "express"}, "ranges": [{"type": "SEMVER", "events": events(("fixed", "0.5"))}]}]},
        {"id": "D", "affected": [{"package": {"ecosystem": "Elsewhere", "name": "x"}}, {"package": {"ecosystem": "PyPI", "name": "Flask"}, "versions": ["1.0"]}]},
        {"id": "E", "affected": [{"package": {"ecosystem": "npm", "name": "express"}, "ranges": [{"type": "SEMVER", "events": events(("introduced", "0"), ("fixed", "unreadable"))}]}]},
    ]
    (tmp_path / "dump.json").write_text("\n".join(json.dumps(a) for a in dump))
    advisories = refdata.read_advisories(spark, str(tmp_path))
    used = [f"{v}.0" for v in ("0.4", "0.5", "0.9", "1.0", "1.4", "1.5", "2.0", "2.3", "2.4", "5.0", "9.0")]
    fact = npm(spark, [(f"o/r{i}", v) for i, v in enumerate(used)]).unionByName(fact_row(spark, [("o/p", "pkg:pypi/flask@1.0", "2025-01-01")]))
    hits = exposure.exposed(exposure.identities(exposure.scope(fact)), advisories).collect()
    got = sorted((r.id, r.version_raw) for r in hits)
    assert got == [("A", "1.0.0"), ("A", "1.4.0"), ("A", "2.0.0"), ("A", "2.3.0"), ("B", "5.0.0"), ("B", "9.0.0"), ("C", "0.4.0"), ("D", "1.0")]
    assert [tuple(r) for r in refdata.unmapped_packages(advisories).collect()] == [("Elsewhere", 1)]


def test_eol(spark):
    cycles = spark.createDataFrame(
        [("django", "5.2", "2099-01-01", ""), ("django", "1.11", "2020-04-01", ""), ("django", "1.1", "true", ""),
         ("django", "2", "soon", ""), ("django", "3", None, "")],
        "product string, cycle string, eol string, latest string",
    )
    used = spark.createDataFrame(
        [("pypi", "django", v) for v in ("1.11.5", "5.2", "1.1.0", "2.0", "3.1", "9.9", "1.111")] + [("npm", "left-pad", "1.0")],
        "ecosystem string, package_key string, version_raw string",
    )
    got = {r.version_raw: (r.cycle, r.is_eol) for r in eol_status(used, cycles, F.lit(dt.datetime(2025, 1, 1))).collect()}
    assert got == {
        "1.11.5": ("1.11", True), "5.2": ("5.2", False), "1.1.0": ("1.1", True), "2.0": ("2", None),
        "3.1": ("3", False), "9.9": (None, None), "1.111": (None, None),
    }


def test_landscape_licences(spark):
    rows = [("MIT", 100), ("GPL-3.0-only", 12), (None, 30), ("LGPL-2.1", 1), ("NOASSERTION", 2)]
    frame = by_repo(spark, [("o/r", "npm", f"p{i}", f"p{i}", "1", "release", lic) for lic, n in rows for i in range(n)])
    summary = landscape.org_licence_summary(frame).first()
    assert (summary.copyleft_occurrences, summary.unknown_or_missing) == (13, 32)
    top = landscape.org_top_licences(frame).orderBy("rank").first()
    assert (top.licence, top.occurrences) == ("MIT", 100)


def test_trends(spark):
    rows = [(f"o/r{i}", "pkg:npm/x@1.0.0", d) for d, n in (("2026-05-29", 18), ("2026-05-30", 21)) for i in range(n)]
    got = trends.dependency_trends(fact_row(spark, rows)).first()
    assert (got.delta, got.note) == (3, "+3 repos over 2 snapshots.")
    one = trends.dependency_trends(fact_row(spark, rows[:1])).first()
    assert one.snapshots == 1 and one.note.startswith("Only one snapshot")


def test_export_totals(spark):
    frame = by_repo(spark, [("o/r", e, n, n, "1", "release", None) for e, n in (("npm", "a"), ("npm", "b"), ("gem", "c"))])
    exported = listing.sbom_export(frame, "https://x/", limit=2)
    rows = exported.orderBy("ecosystem", "package_name").collect()
    assert [(r.ecosystem, r.package_name) for r in rows] == [("gem", "c"), ("npm", "a")]
    assert (rows[0].dependency_count, rows[0].returned, rows[0].truncated) == (3, 2, True)
    assert rows[0].sbom_source_url == "https://x/o/r.json.gz"
    counts = {r.ecosystem: r.dependencies for r in listing.counts_by_ecosystem(exported).collect()}
    assert counts == {"gem": 1, "npm": 1}


def test_top_per_group_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.randrange(1000), i) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((v, i))
    for limit, offset in ((5, 0), (3, 2), (1500, 0), (700, 600)):
        got = top_per_group(df, ["g"], [F.col("v"), F.col("i")], limit, offset)
        found = {}
        for r in got.collect():
            found.setdefault(r.g, []).append((r["rank"], r.v, r.i))
        for g, members in groups.items():
            best = sorted(members)[offset : offset + limit]
            expected = [(offset + n + 1, v, i) for n, (v, i) in enumerate(best)]
            assert sorted(found.get(g, [])) == expected


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"hot": np.round(rng.lognormal(3, 1, 4000), 1), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, values in data.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for buckets in (2, 64):
        linear = {r.g: r for r in percentiles(df, ["g"], "v", points, "linear", buckets).collect()}
        floor = {r.g: r for r in percentiles(df, ["g"], "v", points, "floor", buckets).collect()}
        for g, values in data.items():
            ordered, n = np.sort(values), len(values)
            for name, p in points.items():
                assert math.isclose(linear[g][name], np.percentile(values, p * 100), rel_tol=1e-9)
                assert floor[g][name] == ordered[min(n * round(p * 100) // 100, n - 1)]


def test_percentiles_spread_values_of_any_scale(spark):
    """Values that would share a bucket of fixed width fall into many, and no window holds a group."""
    df = spark.range(20_000).select((F.col("id") / 10_000.0).alias("v"))
    got = percentiles(df, [], "v", {"p50": 0.5, "p99": 0.99}, "floor")
    assert tuple(got.first()) == (1.0, 1.98)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert all("_bucket" in line for line in text.splitlines() if "sum(_n" in line and "Window" in line)


def test_upsert_stores_a_key_once(spark):
    from bomatlas.sources.documents import DOCUMENT_SCHEMA, upsert_plan

    row = lambda text, at: ("o", "r", text, None, at, at, 1)
    empty = spark.createDataFrame([], DOCUMENT_SCHEMA)
    incoming = spark.createDataFrame([row("old", "2025-01-01"), row("new", "2025-02-01"), row("older", "")], DOCUMENT_SCHEMA)
    stored = upsert_plan(empty, incoming)
    assert [(r.text, r.action) for r in stored.collect()] == [("new", "created")]
    assert [(r.text, r.action) for r in upsert_plan(stored.drop("action"), incoming).collect()] == [("new", "skipped")]


def test_lexical_retrieval_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randrange(1, 60)))) for i in range(150)]
    queries = [(i, " ".join(rng.sample(vocabulary, 5)) + " unseen") for i in range(12)]
    n, average = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    expected = {}
    for q, text in queries:
        scores = {}
        for w in set(text.split()):
            df = sum(w in t.split() for _, t in docs)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for i, t in docs:
                tf = t.split().count(w)
                if tf:
                    part = idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (len(t.split()) / average)))
                    scores[i] = scores.get(i, 0) + math.floor(part * 1e6 + 0.5)
        expected[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:7]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    rows = retrieval.retrieve_lexical(documents, asked, 7).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == expected


def test_vector_retrieval_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors, queries = rng.normal(size=(300, 8)), rng.normal(size=(9, 8))
    vectors[10] = vectors[11]
    cosine = (vectors @ queries.T) / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(queries, axis=1)
    expected = {}
    for q in range(len(queries)):
        hits = [(i, int(math.floor(c * 1e6 + 0.5))) for i, c in enumerate(cosine[:, q]) if c >= 0.4]
        expected[q] = sorted(hits, key=lambda h: (-h[1], h[0]))[:10]
    frame = lambda x, name: spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} bigint, embedding array<double>"
    ).repartition(4)
    for per_block in (1000, 4):
        rows = retrieval.retrieve_vector(
            frame(vectors, "vec_id"), frame(queries, "query_id"), vectors_per_block=30 * per_block, queries_per_block=per_block
        )
        got = {q: [] for q in expected}
        for r in rows.orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert got == expected


def test_retrieval_plan_does_not_grow_with_the_queries(spark):
    documents = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common") for i in range(50)], "doc_id bigint, text string")

    def plan(n):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id") % 11).alias("text"))
        found = retrieval.retrieve_lexical(documents, asked)
        return found._jdf.queryExecution().optimizedPlan().toString().count("Join"), found.count()

    (few, a), (many, b) = plan(40), plan(4000)
    assert few == many and b > 50 * a


def test_retrieval_from_another_folder(tmp_path):
    """With only the entry module on the path, tasks must find what they run."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {str(root / '__spark_entry__.py')!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("retrieve_vector", "retrieve_lexical"):
    print("rows", entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.count("rows True") == 2, done.stderr[-2000:]


def test_evaluation(spark):
    hits = spark.createDataFrame(
        [("q1", 1, "nice", 0.1, "x" * 100 + "\n"), ("q1", 2, "o", 0.71, "short\n"), ("q1", 3, "o", 0.7, "y" * 200 + "\n"),
         ("q1", 4, "o", 0.5, "z" * 200), ("q1", 6, "nice", 0.9, "")],
        "query_id string, rank int, org string, score double, content string",
    )
    expected = spark.createDataFrame([("q1", "nice")], "query_id string, org string")
    judged = {r["rank"]: (r.relevance, r.adequate_context) for r in evaluation.judge_hits(hits, expected).collect()}
    assert judged == {1: (3, True), 2: (2, False), 3: (1, True), 4: (0, False)}
    summary = evaluation.relevance(hits, expected).first()
    assert (summary.relevant_count, summary.relevance_rate, summary.passes) == (2, 40.0, False)
    runs = spark.createDataFrame([(float(i), float(i) / 4) for i in range(1, 101)], "total_ms double, search_ms double")
    good = spark.createDataFrame([("q", 100.0, True, True)], "query_id string, relevance_rate double, passes boolean, context_adequate boolean")
    decided = evaluation.decide(runs, good, 1000).first()
    assert (decided.p50, decided.p95, decided.p99, decided.decision) == (51.0, 96.0, 100.0, "GO")
    assert decided.recommendations == ["all figures are within their limits"]
    late = evaluation.decide(runs, good, -1).first()
    assert late.decision == "NO-GO" and late.recommendations == ["index: a new document was never seen"]


def test_metric_rules(spark):
    row = spark.range(1).select(
        metrics.adoption_trend(F.lit(250), F.lit(200)).alias("up"),
        metrics.adoption_trend(F.lit(180), F.lit(200)).alias("down"),
        metrics.adoption_trend(F.lit(202), F.lit(200)).alias("flat"),
        metrics.period_name(F.to_date(F.lit("2025-11-08")), F.to_date(F.lit("2025-11-15"))).alias("week"),
        metrics.period_name(F.to_date(F.lit("2025-01-01")), F.to_date(F.lit("2025-03-15"))).alias("long"),
        cost.utilization(F.lit(33.333)).alias("used"),
    ).first()
    assert tuple(row) == ("increasing", "decreasing", "stable", "weekly", "custom", 66.67)
    with pytest.raises(ValueError):
        metrics.between(None, "2025-02-01", "2025-01-01")


def test_costs(spark):
    calls = spark.range(10_000).select(F.lit(dt.datetime(2025, 4, 20)).alias("ts"))
    row = cost.with_projection(cost.daily_costs(calls)).first()
    assert math.isclose(row.total_daily, 0.005 + 0.5 + 0.1 + 0.2 + 0.1)
    assert math.isclose(row.cumulative_month, row.total_daily * 20)
    assert math.isclose(row.projection_month_end, row.total_daily * 30)
    frame = cost.with_projection(cost.daily_costs(calls), 10.0)
    assert cost.alerts(frame, 10.0).count() == 1 and cost.alerts(frame).count() == 0


def test_ingest_statistics(spark):
    runs = spark.createDataFrame([("b", True, 1.0), ("b", True, 2.005), ("b", False, 9.0), ("c", False, 1.0)], "batch string, success boolean, duration double")
    got = {r.batch: r for r in ingest_stats.ingest_stats(runs).collect()}
    assert (got["b"].successful, got["b"].failed, got["b"].average_time_seconds) == (2, 1, 1.5)
    assert got["c"].average_time_seconds == 0.0
    none = ingest_stats.upload_stats(spark.createDataFrame([], "success boolean, bytes bigint")).first()
    assert (none.total_uploaded, none.total_bytes, none.success_rate) == (0, 0, 0.0)


def test_build_stats_name_ecosystems_and_kinds(spark):
    """Everything a build reports: rows per ecosystem and version kind beside the totals, the eight largest ecosystems first."""
    from bomatlas.operators import summaries

    rows = [(f"o/r{i % 4}", f"eco{k}", "release" if i % 3 else "range", i % 3 > 0) for k in range(10) for i in range(1 + (k * 7) % 10)]
    fact = spark.createDataFrame(rows, "repo_full_name string, ecosystem string, version_kind string, comparable boolean")
    stats = summaries.build_stats(fact).collect()
    assert len(stats) == 1
    row = stats[0]

    def listed(at):
        counts = {}
        for r in rows:
            counts[r[at]] = counts.get(r[at], 0) + 1
        return sorted(((name, n) for name, n in counts.items()), key=lambda p: (-p[1], p[0]))

    good = sum(r[3] for r in rows)
    assert (row.rows, row.repos, row.comparable) == (len(rows), 4, good) and abs(row.comparable_pct - 100 * good / len(rows)) <= 0.05
    assert [tuple(e) for e in row.ecosystems] == listed(1) and len(row.ecosystems) == 10
    assert [tuple(e) for e in row.kinds] == listed(2)
    assert [tuple(e) for e in row.top_ecosystems] == listed(1)[:8]
