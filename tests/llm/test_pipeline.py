"""The pipeline on planted documents: each stage drops what it must and keeps the rest."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bomatlas.llm import queries
from tests.llm.helpers import CLASHING, awkward, documents, empty, prose
from tests.llm.test_text import groups_by_hand

LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies, near copies and leaks, each in a range of ids of its own."""
    path = str(tmp_path_factory.mktemp("tables"))
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(i, 60).split()
        for _ in range(4 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["vile", "nasty", "foul"]))
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    rows += [(1000 + i, r[1].upper(), "en", "s1", 1) for i, r in enumerate(clean[:40])]  # copies, larger ids stay
    near = [r[1].split() for r in clean[100:140]]
    rows += [(2000 + i, " ".join([*w[:-1], "changed"]), "en", "s2", 1) for i, w in enumerate(near)]
    items = [(i, prose(5000 + i, 30)) for i in range(10)]
    rows += [(3000 + i, f"{prose(6000 + i, 40)} {t} {prose(7000 + i, 40)}", "en", "s3", 1) for i, t in items]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, set(ids(docs))
    out = STAGES["toxicity"](spark, docs, folder)
    toxic = {i for i in range(0, 600, 6)}
    assert out.columns == columns and len(left - set(ids(out)) - toxic) == 0 and len(toxic & set(ids(out))) <= 2
    docs, left = out, set(ids(out))
    out = STAGES["exact_dedup"](spark, docs, folder)
    clean = [i for i in range(600) if i % 6]
    assert out.columns == columns and left - set(ids(out)) == set(clean[:40])
    docs, left = out, set(ids(out))
    out = STAGES["jaccard_join"](spark, docs, folder)
    by_hand = groups_by_hand([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert out.columns == columns and set(ids(out)) == {doc for doc, _, group in by_hand if doc == group}
    assert left - set(ids(out)) == set(range(2000, 2040))
    docs, left = out, set(ids(out))
    out = STAGES["decontamination"](spark, docs, folder)
    assert out.columns == columns and left - set(ids(out)) == set(range(3000, 3010))
    mix = STAGES["source_mix"](spark, out, folder)
    total = out.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert mix.agg(F.sum("words")).first()[0] == pytest.approx(total, abs=4) and set(ids(mix)) <= set(ids(out))


def test_run_gives_the_last_stage(spark, folder):
    first, again = (corpus_pipeline.run(spark, folder).select("doc_id", "epoch", "words") for _ in range(2))
    assert sorted(first.collect()) == sorted(again.collect()) and first.count() > 400


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_awkward_rows(spark, folder, name):
    frame = awkward(spark)
    out = STAGES[name](spark, frame, folder)
    if name != "source_mix":
        assert out.columns == frame.columns
    assert out.count() <= 2 * frame.count()
    assert STAGES[name](spark, empty(spark), folder).count() == 0


def test_stages_take_empty_tables_beside_them(spark, tmp_path):
    for name, schema in (("labels", LABELS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frame = documents(spark, [prose(i, 20) for i in range(5)], CLASHING)
    for name in ("toxicity", "decontamination"):
        assert STAGES[name](spark, frame, str(tmp_path)).count() == 5


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))
