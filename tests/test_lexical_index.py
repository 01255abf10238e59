"""The stored word index against ranking from raw texts."""

import random

import pytest
from pyspark.sql import functions as F

from bomatlas.functions.documents import tokens
from bomatlas.operators import lexical_index, retrieval

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        # Neighbours share a topic, as pages of a site do; everyone uses the first words.
        topic = WORDS[10 + (i // 40) % 40 :][:10]
        rows.append((i * 3 - 50, " ".join(draw.choice(WORDS[:6] if draw.random() < 0.6 else topic) for _ in range(draw.randrange(1, 60)))))
    return rows + [(10_001, None), (10_002, ""), (10_003, "..."), (10_004, "W1 w1, É-w2")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(texts(900), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, documents, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/two"
    lexical_index.build(documents, path, range_ids=16, buckets=5)
    return lexical_index.open_index(spark, path)


@pytest.fixture(scope="module")
def queries(spark):
    draw = random.Random(9)
    asked = [(i, " ".join(draw.choices(WORDS, k=draw.randrange(1, 8)))) for i in range(25)]
    return spark.createDataFrame(asked + [(100, ""), (101, None), (102, "unknown words"), (103, "w1 W1 é")], "query_id long, text string")


@pytest.mark.parametrize("hits", [1, 7, 50])
@pytest.mark.parametrize("few", [0, 10**9])
def test_same_hits_as_from_texts(spark, documents, index, queries, hits, few):
    found = lexical_index.search(index, queries, hits, few_pairs=few)
    plain = retrieval.retrieve_lexical(documents, queries, hits)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_ranges_are_skipped(spark, index, documents, monkeypatch):
    """A query with a rare topic scores few of the ranges that hold its common words."""
    asked = spark.createDataFrame([(1, "w1 w30 w31 w32 w33")], "query_id long, text string")
    counts = []
    whole = lexical_index._sums

    def counted(average, hits):
        run = whole(average, hits)
        seen = spark.sparkContext.accumulator(0)
        counts.append(seen)

        def score(postings, queries):
            seen.add(queries.num_rows)
            return run(postings, queries)

        return score

    monkeypatch.setattr(lexical_index, "_sums", counted)
    lexical_index.search(index, asked, 5, few_pairs=0).collect()
    assert 0 < sum(c.value for c in counts) < index.blocks.where("word = 'w1'").count() / 2


def test_search_reads_no_texts_and_few_folders(spark, index):
    asked = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    plan = lexical_index.search(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "bucket" in plan
    bucket = asked.select(F.pmod(F.xxhash64(F.lit("w1")), F.lit(index.buckets))).first()[0]
    files = index.blocks.where(F.col("bucket") == bucket).select(F.input_file_name()).distinct().count()
    assert files < len(index.blocks.inputFiles())


def test_empty_corpus_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    empty = lexical_index.build(none, f"{tmp_path}/empty")
    asked = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert lexical_index.search(empty, asked, 5).count() == 0
    assert lexical_index.search(empty, asked.limit(0), 5).count() == 0


def test_common_word_is_spread(spark, index):
    """No block is larger than a range, however common its word."""
    sizes = index.blocks.select("word", F.size("postings").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 16
    assert sizes.where("word = 'w1'").count() > 20


def test_raw_texts_add_up_where_their_words_stand(spark, monkeypatch):
    """Repeated and null ids, several blocks of everything: the sums of an outright join; no pair of query and document moves."""
    for name, size in (("DOCUMENTS_PER_BLOCK", 7), ("QUERIES_PER_BLOCK", 3), ("WORDS_PER_BLOCK", 4)):
        monkeypatch.setattr(retrieval, name, size)
    texts = [" ".join(f"w{(i * k + k) % 23}" for k in range(1 + i % 9)) + " the" * (i % 4) for i in range(60)]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "the other"), (6, None), (7, ""), (80, texts[8]), (81, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(i if i else None, f"the w{i} w{i + 1} w{i * 2}") for i in range(9)] + [(4, "the w9"), (9, "unknown"), (10, None)], "query_id long, text string")
    found = retrieval.retrieve_lexical(docs, queries, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(query_id" in line and "doc_id" in line.split("hashpartitioning")[1].split(")")[0]]

    corpus = docs.where("text is not null").select("doc_id", tokens(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    total, average = corpus.agg(F.count("*").cast("double"), F.avg("length")).first()
    postings = corpus.select("doc_id", "length", F.explode("words").alias("word")).groupBy("word", "doc_id", "length").agg(F.count("*").alias("tf"))
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    share = lexical_index.part(lexical_index.rarity(F.lit(total), F.col("df")), F.col("tf"), F.col("length"), F.lit(average))
    sums = asked.join(postings, "word").join(df, "word").groupBy("query_id", "doc_id").agg(F.sum(share).cast("long").alias("score")).where("score > 0").collect()
    expected = set()
    for query in {r.query_id for r in sums}:
        best = sorted((r for r in sums if r.query_id == query), key=lambda r: (-r.score, r.doc_id is not None, r.doc_id))[:6]
        expected |= {(query, r.doc_id, r.score, i + 1) for i, r in enumerate(best)}
    got = [(r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_index_from_packages_is_that_of_plain_rows(spark, tmp_path, monkeypatch):
    """Everything cut small: words as `tokens` splits them, blocks as an aggregation over single postings gives them."""
    for name, size in (("DOCUMENTS_PER_SLICE", 5), ("POSTINGS_AT_ONCE", 9), ("BLOCKS_AT_ONCE", 2), ("TEXT_AT_ONCE", 40), ("WORDS_AT_ONCE", 8)):
        monkeypatch.setattr(lexical_index, name, size)
    odd = ["İstanbul ΣΑΣ ς ﬁ ß ǅ", "é ẍy ٠١ Ⅷ ² ½ ①", "漢字かな 한글 𝔘𝟘 😀a😀b", "a\x00b c‍d_e-f", "naïve", "naïve", "x" * 300 + " é", " ﻿", "", "A9 a9 A"]
    rows = [(i * 7 - 30, t) for i, t in enumerate(odd * 2)] + [(40, "a9 naïve"), (41, None), (None, "a9")]
    raw = spark.createDataFrame([(500, bytearray(b"caf\xe9 au lait")), (501, bytearray(b"\xe9\xa0")), (502, bytearray(b"\xa0b"))], "doc_id long, text binary")
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(raw.withColumn("text", F.col("text").cast("string"))).repartition(3)
    index = lexical_index.build(docs, f"{tmp_path}/small", range_ids=16, buckets=3)

    words = docs.where("text is not null and doc_id is not null").select("doc_id", tokens("text").alias("words")).withColumn("length", F.size("words"))
    total, average = words.agg(F.count("*"), F.avg("length")).first()
    assert (index.total, index.average) == (total, pytest.approx(average))
    postings = words.select("doc_id", "length", F.explode("words").alias("word")).groupBy("word", "doc_id", "length").agg(F.count("*").alias("tf"))
    expected = postings.groupBy("word", F.floor(F.col("doc_id") / 16).alias("range")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("postings"))
    plain = {(r.word, r.range): [tuple(p) for p in r.postings] for r in expected.collect()}
    found = index.blocks.collect()
    assert len(found) == len(plain) and {(r.word, r.range): [tuple(p) for p in r.postings] for r in found} == plain
    for r in found:
        weights = [tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) for _, tf, length in r.postings]
        assert r.peak == pytest.approx(max(weights))
    df = {r.word: r.df for r in index.words.collect()}
    assert df == {w: sum(len(p) for (v, _), p in plain.items() if v == w) for w, _ in plain}
    # Each word is in the bucket that a search looks it up in.
    assert index.words.where(F.col("bucket") != lexical_index._bucket(3)).count() == index.blocks.where(F.col("bucket") != lexical_index._bucket(3)).count() == 0


def test_index_of_another_hash_is_refused(spark, tmp_path):
    spark.createDataFrame([(1.0, 1.0, 3)], "total double, average double, buckets int").write.parquet(f"{tmp_path}/old/totals")
    with pytest.raises(ValueError, match="build it again"):
        lexical_index.open_index(spark, f"{tmp_path}/old")
