"""Steps that hold no whole table in one task, on rows made here."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bomatlas.sources import sbom
from workload import fixture as fx


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as those of a large table do."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(key, "1b")
    yield spark
    spark.conf.unset(key)


def _components(spark, n):
    library = "struct(concat('pkg:npm/p', id) AS purl, '1.0' AS version, CAST(NULL AS array<struct<license:struct<id:string>>>) AS licenses)"
    return spark.range(0, n, 1, 6).selectExpr(
        f"(id * 37) % {n} AS o_orderkey",
        "DATE'1998-01-01' AS ingested_date",
        f"concat('org/r', (id * 37) % {n}) AS name",
        "array(struct('vcs' AS type, 'https://x' AS url)) AS externalReferences",
        f"array_repeat({library}, CAST(1 + (id * 37) % {n} % 3 AS int)) AS components",
    )


def test_first_repositories_come_from_many_files(uncoalesced, monkeypatch):
    monkeypatch.setattr(fx, "components", lambda spark, d: _components(spark, 400))
    found = entry.queries()["limit_first_n_repos"](uncoalesced, "none")
    assert len(found.inputFiles()) > 1
    assert [tuple(r) for r in found.collect()] == [(f"org/r{i}", 1 + i % 3) for i in range(100)]


def test_repositories_are_looked_up_without_sorting(spark):
    from bomatlas.session import apply_settings
    from bomatlas.sources.sbom import join_repo_metadata

    apply_settings(spark)
    named = spark.range(0, 5000, 1, 4).selectExpr("concat('Org/R', id % 70) AS repo_full_name", "CAST(NULL AS string) AS _vcs")
    feed = spark.range(60).selectExpr("concat('org/r', id) AS repo_key", "timestamp_seconds(id) AS pushed_at", "concat('u', id) AS repo_url")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = join_repo_metadata(named, feed)
        counts = found.groupBy().agg(F.count("*").alias("n"), F.count("repo_url").alias("known"))
        assert tuple(counts.collect()[0]) == (5000, sum(i % 70 < 60 for i in range(5000)))
        final = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_land_where_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(fx, "derive", lambda spark, d, text: spark.range(0, 3000, 1, 3))
    landed = fx.lines(spark, "made here")
    assert len(landed.inputFiles()) == 3 and landed.count() == 3000


def test_documents_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(fx, "components", lambda spark, d: _components(spark, 300))
    path = fx.published_document(spark, "made here")
    files = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    assert len(files) == 6 and all(json.loads(text)["bomFormat"] == "CycloneDX" for text in files)
    found = sbom.read_aggregate(spark, path, "document", range_bytes=1000).select("name", F.size("components"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"org/r{i}", 1 + i % 3) for i in range(300))


def test_words_are_counted_some_at_a_time(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from bomatlas.operators import lexical_index

    monkeypatch.setattr(lexical_index, "WORDS_AT_ONCE", 50, raising=False)
    texts = [["a", "b", "a"], [], ["b"] * 120 + ["c"], [], *[[f"w{i % 5}"] * 7 for i in range(40)], []]
    whole = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "words"])
    # Cut out of a larger batch, as they come.
    found = list(lexical_index._count_words([whole.slice(1), whole.slice(0, 1)]))
    assert max(sum(b.column("tf").to_pylist()) for b in found if b.num_rows > 2) <= 50
    got = sorted((r["doc_id"], r["word"], r["tf"], r["length"]) for b in found for r in b.to_pylist())
    assert got == sorted((i, w, n, len(t)) for i, t in enumerate(texts) for w, n in Counter(t).items())


def _tables(spark, folder, orders=60):
    """Three lines an order, one of them without a part; some keys come twice or are null."""
    made = {
        "nation": spark.range(3).selectExpr("CAST(id AS int) AS n_nationkey", "concat('NATION_', id) AS n_name"),
        "customer": spark.range(7).selectExpr("id AS c_custkey", "CAST(id % 3 AS int) AS c_nationkey"),
        "part": spark.range(40).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CAST(id AS int) AS p_size"),
        "orders": spark.range(orders).selectExpr("nullif(id, 5) AS o_orderkey", "id % 7 AS o_custkey", "TIMESTAMP'1995-01-01' + make_interval(0, 0, 0, CAST(id AS int)) AS o_orderdate"),
        "lineitem": spark.range(orders * 3).selectExpr(
            "nullif(id DIV 3, 8) AS l_orderkey", "CAST(id % 3 + 1 AS int) AS l_linenumber", "CASE WHEN id % 3 < 2 THEN id % 40 ELSE 99 END AS l_partkey",
            "CAST(id % 9 AS double) AS l_quantity", "0.05D AS l_discount", "0.02D AS l_tax",
            "TIMESTAMP'1995-06-01' + make_interval(CAST(id % 4 AS int)) AS l_shipdate",
        ),
    }
    made["orders"] = made["orders"].unionByName(made["orders"].where("o_orderkey = 3"))
    for name, frame in made.items():
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_orders_pass_in_parts(spark, tmp_path, monkeypatch):
    d = _tables(spark, tmp_path)
    want = sorted(map(tuple, fx.derive(spark, d, fx.LINES_SQL).collect()), key=str)
    monkeypatch.setattr(fx, "LINES_AT_ONCE", 50)
    found, folders, last = [], [], -1
    for _ in fx.passes(spark, d):
        frame = fx.lines(spark, d)
        folders.append(fx._PASSES[(spark.sparkContext.applicationId, d)].path)
        assert frame.count() == fx.lines(spark, d).count() < len(want)
        rows = list(map(tuple, frame.collect()))
        assert last < min(r[0] for r in rows)
        last = max(r[0] for r in rows)
        found += rows
    assert len(folders) == 4 and sorted(found, key=str) == want
    assert not any(os.path.exists(f) for f in folders) and not fx._PASSES
    # Delivered lines come whole, in one pass, and stay.
    assert sorted(map(tuple, fx.lines(spark, d).collect()), key=str) == want
    assert [fx.lines(spark, d).count() for _ in fx.passes(spark, d)] == [len(want)] == [fx.lines(spark, d).count()]


def test_documents_and_first_repositories_of_parts(spark, tmp_path, monkeypatch):
    d = _tables(spark, tmp_path)
    monkeypatch.setattr(fx, "LINES_AT_ONCE", 50)
    rows = fx.derive(spark, d, fx.LINES_SQL)
    groups = rows.groupBy("o_orderkey", "ingested_date", "repo_full_name", "vcs_url").count().orderBy("o_orderkey", "ingested_date").collect()
    assert len(groups) > 100
    first = entry.queries()["limit_first_n_repos"](spark, d)
    assert all(f.endswith(".json.gz") for f in first.inputFiles()) and len(first.inputFiles()) >= 4
    assert [tuple(r) for r in first.collect()] == [(g.repo_full_name, g["count"]) for g in groups[:100]]
    path = fx.published_document(spark, d)
    assert all(f.endswith(".gz") for f in spark.read.text(path).inputFiles())
    libraries = sbom.read_aggregate(spark, path, "document").select("name", F.explode("components.purl"))
    assert sorted(map(tuple, libraries.collect())) == sorted((r.repo_full_name, r.purl) for r in rows.collect())
    assert (spark.sparkContext.applicationId, d) not in fx._LANDED


def test_lines_are_gone_after_the_index(spark, tmp_path, monkeypatch):
    from bomatlas.sources import tables

    d = _tables(spark, tmp_path)
    monkeypatch.setattr(tables, "ROWS_AT_ONCE", 30)
    index = fx.index(spark, d)
    assert (spark.sparkContext.applicationId, d) not in fx._LANDED
    want = fx.derive(spark, d, fx.LINES_SQL).groupBy("ingested_date").count().collect()
    assert len(want) > 2 and sorted(map(tuple, index.fact.groupBy("ingested_date").count().collect())) == sorted(map(tuple, want))


def test_shuffles_are_deleted_when_an_action_ends(spark, tmp_path):
    from bomatlas.session import apply_settings

    apply_settings(spark)
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 900).alias("k")).count().write.parquet(str(tmp_path / "out"))
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
