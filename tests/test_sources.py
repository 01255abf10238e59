"""Readers, writers and the rules of exploding a bill of materials."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from bomatlas.functions.purl import package_key_text, with_purl_columns
from bomatlas.operators import summaries
from bomatlas.sources import documents, feed, sbom, tables

COMPONENTS = [
    {
        "name": "org/one/deep",
        "externalReferences": [{"type": "website", "url": "w"}, {"type": "vcs", "url": ""}, {"type": "vcs", "url": "https://v"}],
        "components": [
            {"purl": "pkg:npm/%40Scope/Name@1.2.3?x=1#sub", "version": "", "licenses": [{"license": {"id": "MIT"}}]},
            {"purl": "pkg:pypi/My_Pkg.Name@2.0", "version": "%5E2.0", "licenses": []},
            {"purl": "pkg:gem/rails", "version": "1." + "0" * 600, "licenses": [{"license": {"id": ""}}]},
            {"purl": "pkg:npm/" + "a" * 3000 + "@1.0.0"},
            {"purl": "cpe:/a:b", "version": "1"},
            {"version": "1"},
        ],
    },
    {"name": "Org/Two", "components": [{"purl": "pkg:github/o/r@main"}, {"purl": "pkg:githubactions/a/b@4.*.*"}]},
    {"name": "noslash", "components": [{"purl": "pkg:npm/x@1.0.0"}]},
    {"name": "org/empty"},
]
FEED = [
    {"owner": "org", "name": "two", "pushedAt": "2024-01-01T00:00:00Z", "url": "https://first"},
    {"owner": "", "org": "ORG", "name": "Two", "pushedAt": "2024-02-01T00:00:00Z", "url": ""},
    {"owner": "", "org": "", "name": "lost"},
    {"owner": "org"},
]


@pytest.fixture()
def landed(tmp_path):
    whole = tmp_path / "sbom.json.gz"
    with gzip.open(whole, "wt") as f:
        json.dump({"bomFormat": "CycloneDX", "components": COMPONENTS}, f)
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "part.json").write_text("\n".join(json.dumps(c) for c in COMPONENTS))
    (tmp_path / "feed.json").write_text(json.dumps(FEED))
    return tmp_path


def test_explode_rules(spark, landed):
    looked_up = feed.normalise_feed(feed.read_feed(spark, str(landed / "feed.json")))
    entry = looked_up.collect()
    assert [(r.repo_key, r.full_name, r.repo_url) for r in entry] == [
        ("org/two", "ORG/Two", "https://github.com/ORG/Two")
    ]
    for layout, path in (("document", "sbom.json.gz"), ("lines", "lines")):
        components = sbom.read_aggregate(spark, str(landed / path), layout)
        libraries = sbom.explode_libraries(components, looked_up)
        fact = sbom.to_fact(libraries, F.lit(dt.date(2025, 1, 2)))
        rows = {r.package_name[:12]: r for r in fact.collect()}
        assert len(rows) == 6
        scoped = rows["@Scope/Name"]
        assert (scoped.package_key, scoped.version_raw, scoped.license_id) == ("@scope/name", "1.2.3", "MIT")
        assert (scoped.org, scoped.repo, scoped.repo_url, scoped.pushed_at) == ("org", "one/deep", "https://v", None)
        pypi = rows["My_Pkg.Name"]
        assert (pypi.package_key, pypi.version_raw, pypi.version_kind) == ("my-pkg-name", "%5E2.0", "range")
        assert rows["rails"].license_id is None and len(rows["rails"].version_raw) == 512
        assert len(rows["a" * 12].purl) == 2048
        assert rows["o/r"].is_self_ref and rows["o/r"].version_kind == "branch"
        assert rows["a/b"].is_action and rows["a/b"].version_kind == "wildcard"
        assert rows["a/b"].repo_url == "https://github.com/ORG/Two"
        assert str(rows["a/b"].pushed_at) == "2024-02-01 00:00:00"


def test_limit_and_layout_argument(spark, landed):
    for layout, path in (("document", "sbom.json.gz"), ("lines", "lines")):
        first = sbom.read_aggregate(spark, str(landed / path), layout, limit=2)
        assert sorted(r.name for r in first.collect()) == ["Org/Two", "org/one/deep"]
    with pytest.raises(ValueError):
        sbom.read_aggregate(spark, "x", "other")


def test_integrity(spark, landed):
    size = (landed / "sbom.json.gz").stat().st_size
    (landed / "plain.json.gz").write_text("{}")
    declared = spark.createDataFrame(
        [(f"file:{landed}/sbom.json.gz", size + 1)], "path string, declared_length bigint"
    )
    got = {r.path.rsplit("/", 1)[1]: r for r in sbom.check_integrity(spark, f"{landed}/*.json.gz", declared).collect()}
    assert got["sbom.json.gz"].is_gzip and not got["sbom.json.gz"].is_complete
    assert not got["plain.json.gz"].is_gzip and got["plain.json.gz"].is_complete


def test_integrity_of_damaged_files(spark, tmp_path):
    """Only a stream that unpacks to its end is complete; plans read no contents."""
    whole = gzip.compress(bytes(range(256)) * 400)
    damaged = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]
    files = {"good": whole, "cut": whole[:-9], "damaged": damaged, "two": whole + whole, "padded": whole + b"\0" * 9, "tail": whole + b"xx", "empty": b"", "plain": b"{}"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    checked = sbom.check_integrity(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.is_gzip, r.unpacks, r.is_complete) for r in checked.collect()}
    good, bad = (True, True, True), (True, False, False)
    assert got == {"good": good, "cut": bad, "damaged": bad, "two": good, "padded": good, "tail": bad, "plain": (False, None, True)}
    sizes = spark.createDataFrame([(f"file:{tmp_path}/{n}", s) for n, s in (("empty", 0), ("gone", 5))], "path string, declared_length bigint")
    told = {r.path.rsplit("/", 1)[1]: (r.length, r.is_complete) for r in sbom.check_integrity(spark, str(tmp_path), sizes).collect()}
    assert told["empty"] == (0, True) and told["gone"] == (0, False) and told["plain"] == (2, True)
    assert "content" not in checked._jdf.queryExecution().executedPlan().toString()


def test_spdx_files_and_markdown(spark, tmp_path):
    def package(i):
        return {"name": f"p{i:03}", "versionInfo": "1.0" if i % 2 else "", "licenseConcluded": ["MIT", "NOASSERTION"][i % 2],
                "externalRefs": [{"referenceType": "cpe", "referenceLocator": "c"},
                                 {"referenceType": "purl", "referenceLocator": f"pkg:npm/p{i}"}]}

    root = {"name": "com.github.org/many"}
    (tmp_path / "org").mkdir()
    (tmp_path / "org" / "many.json").write_text(json.dumps({"sbom": {"packages": [root] + [package(i) for i in range(130)]}}))
    (tmp_path / "org" / "few.json").write_text(json.dumps({"packages": [package(0), package(1)]}))
    packages = sbom.spdx_packages(sbom.read_spdx(spark, f"{tmp_path}/org"))
    assert packages.count() == 132
    text = {r.repo: r.markdown for r in sbom.sbom_markdown(packages, F.lit("URL")).collect()}
    assert text["few"] == (
        "\n\n## SBOM Dependencies (2 packages)\n\nSource: [SPDX 2.3 SBOM](URL)\n\n"
        "- p000 [MIT] `pkg:npm/p0`\n- p001 (1.0) `pkg:npm/p1`"
    )
    assert text["many"].count("\n- ") == 100 and text["many"].endswith("\n\n... and 30 more (see full SBOM)")


def test_purl_cases(spark):
    cases = {
        "pkg:npm/express@4.18.2": ("npm", "express", "4.18.2"),
        "pkg:NPM/express": ("npm", "express", ""),
        "pkg:npm/%40a/b@c@1.0": ("npm", "@a/b@c", "1.0"),
        "pkg:maven/g/a@1%2B2?type=jar": ("maven", "g/a", "1+2"),
        "pkg:golang/x/y@v1#sub@9?q": ("golang", "x/y", "v1"),
        "pkg:npm": ("npm", "", ""),
    }
    df = spark.createDataFrame([(p,) for p in [*cases, "cpe:x", ""]], "purl string")
    got = {r.purl: (r.ecosystem, r.package_name, r.purl_version) for r in with_purl_columns(df).collect()}
    assert got == cases
    assert package_key_text("pypi", "A_.-b") == "a-b" and package_key_text("npm", "A_b") == "a_b"


def fact_row(spark, rows):
    """Fact rows out of (repo, purl, date)."""
    df = spark.createDataFrame(rows, "repo_full_name string, purl string, d string").selectExpr(
        "repo_full_name", "split(repo_full_name, '/')[0] AS org", "split(repo_full_name, '/')[1] AS repo",
        "'u' AS repo_url", "CAST(NULL AS TIMESTAMP) AS pushed_at", "purl", "'' AS version_raw",
        "CAST(NULL AS STRING) AS license_id", "d",
    )
    return sbom.to_fact(df, F.to_date("d"))


def test_partition_replacement_and_retention(spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_snapshot(fact_row(spark, [("o/a", "pkg:npm/x@1.0.0", "2025-01-01"), ("o/a", "pkg:npm/x@1.0.0", "2025-06-01")]), path)
    again = fact_row(spark, [("o/b", "pkg:npm/y@2.0.0", "2025-06-01"), ("o/c", "pkg:npm/y@2.0.0", "2025-06-01")])
    for _ in range(2):
        tables.write_snapshot(again, path)
    rows = sorted((str(r.ingested_date), r.repo_full_name) for r in tables.read_fact(spark, path).collect())
    assert rows == [("2025-01-01", "o/a"), ("2025-06-01", "o/b"), ("2025-06-01", "o/c")]
    base = str(tmp_path / "base")
    for date in ("2025-01-01", "2025-06-01"):
        tables.serve(spark, base, date)
        assert tables.served_date(spark.newSession(), base) == date
    plan = tables.snapshot(spark, path, "2025-06-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingested_date" in plan
    assert tables.drop_expired(spark, path, "2025-06-01") == ["2025-01-01"]
    spark.catalog.refreshByPath(path)
    assert tables.read_fact(spark, path).count() == 2


def test_snapshots_are_written_some_at_a_time(spark, tmp_path):
    rows = [(f"o/{d}{i}", "pkg:npm/x@1.0.0", f"2025-0{d}-01") for d, n in ((1, 3), (2, 1), (3, 1), (4, 5), (5, 1)) for i in range(n)]
    fact = fact_row(spark, rows)
    groups = tables.dates_at_once(fact, 3)
    assert [[str(d) for d in g] for g in groups] == [["2025-01-01"], ["2025-02-01", "2025-03-01"], ["2025-04-01"], ["2025-05-01"]]
    assert len(tables.dates_at_once(fact)) == 1 and tables.dates_at_once(fact.where("false")) == []
    assert [len(g) for g in tables.dates_at_once(fact, 100, F.sum(F.lit(50)))] == [1, 2, 1, 1]
    for _ in range(2):
        tables.write_snapshot(fact, str(tmp_path / "some"), dates=groups)
    tables.write_snapshot(fact, str(tmp_path / "all"))
    some, whole = (sorted(map(tuple, tables.read_fact(spark, str(tmp_path / n)).collect())) for n in ("some", "all"))
    assert len(some) == 11 and some == whole
    # Rows without a date are not passed over: the table refuses them.
    dateless = fact.withColumn("ingested_date", F.when(F.col("repo") != "40", F.col("ingested_date")))
    groups = tables.dates_at_once(dateless, 3)
    assert groups[0][0] is None
    with pytest.raises(Exception, match="NULL in a required column"):
        tables.write_snapshot(dateless, str(tmp_path / "none"), dates=groups)


def test_schema_is_enforced(spark, tmp_path):
    fact = fact_row(spark, [("o/a", "pkg:npm/x@1.0.0", "2025-01-01")])
    with pytest.raises(ValueError):
        tables.write_snapshot(fact.withColumn("extra", F.lit(1)), str(tmp_path / "a"))
    with pytest.raises(Exception, match="NULL in a required column"):
        tables.write_snapshot(fact.withColumn("org", F.lit(None).cast("string")), str(tmp_path / "b"))


def test_license_rollup_has_one_unknown_row(spark):
    df = spark.createDataFrame(
        [("npm", None, "o/a"), ("npm", "UNKNOWN", "o/a"), ("npm", "MIT", "o/b"), ("npm", None, "o/c")],
        "ecosystem string, license_id string, repo_full_name string",
    ).withColumns({"is_self_ref": F.lit(False), "is_action": F.lit(False)})
    rows = sorted((r.license_id, r.repo_count, r.occurrence_count) for r in summaries.license_rollup(df).collect())
    assert rows == [("MIT", 1, 1), ("UNKNOWN", 2, 3)]


def test_upsert_and_classification(spark, tmp_path):
    columns = "org string, repo string, text string, pushed_at string"
    stored = spark.createDataFrame([("o", "same", "old", "1"), ("o", "changed", "old", "1"), ("o", "kept", "old", "1")], columns)
    new = spark.createDataFrame([("o", "same", "new", "1"), ("o", "changed", "new", "2"), ("o", "fresh", "new", "1")], columns)
    plan = {r.repo: (r.action, r.text) for r in documents.upsert_plan(stored, new).collect()}
    assert plan == {"same": ("skipped", "old"), "changed": ("updated", "new"), "kept": ("kept", "old"), "fresh": ("created", "new")}
    forced = {r.repo: r.action for r in documents.upsert_plan(stored, new, force=True).collect()}
    assert forced["same"] == "updated"
    documents.upsert(stored, new, str(tmp_path / "v2"))
    assert spark.read.parquet(str(tmp_path / "v2")).count() == 4

    state = spark.createDataFrame(
        [("o", "hit", "1", "p", "complete"), ("o", "stale", "0", "p", "complete"), ("o", "broken", "1", None, None)],
        "org string, repo string, pushed_at string, processed_at string, status string",
    )
    repos = spark.createDataFrame([("o", r, "1") for r in ("hit", "stale", "broken", "gone")], "org string, repo string, pushed_at string")
    classified = documents.classify(repos, state)
    assert {r.repo: r.reason for r in classified.collect()} == {
        "hit": "cache-hit", "stale": "stale-cache", "broken": "cache-miss", "gone": "cache-miss"
    }
    stats = documents.classify_stats(classified).first()
    assert (stats.total_checks, stats.hits, stats.misses, stats.hit_rate) == (4, 1, 3, 25.0)


def test_feed_validation(spark):
    raw = spark.createDataFrame(
        [("https://g/a/b", "2025", "a/b"), (None, "2025", "a/b"), ("https://g", None, "a/b"), ("https://g", "2025", "invalid-format")],
        feed.RAW_FEED_SCHEMA,
    )
    assert feed.validation_stats(raw).first().asDict() == {"total": 4, "valid": 1, "invalid": 3}
    assert feed.valid_entries(raw).first().asDict() == {"url": "https://g/a/b", "pushedAt": "2025", "org": "a", "name": "b"}
