"""Importance resampling against plain Python over the definition."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from bomatlas.llm import importance_resampling as resampling

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def features(text, most):
    found = words(text)
    return [" ".join(found[i : i + n]) for n in range(1, most + 1) for i in range(len(found) - n + 1)]


def brute(documents, target, most, buckets, least, percent, seed):
    def counts(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in features(t, most))

    own, aim = counts([t for _, t in documents]), counts(target)
    s, t = sum(own.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))

    rows = []
    for doc_id, text in documents:
        found = [gain(crc32(f.encode()) % buckets) for f in features(text, most)]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(found) // len(found) if found else 0
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))])
    eligible = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): i + 1 for i, r in enumerate(eligible[: percent * len(eligible) // 100])}
    return [(*r[:4], place.get(id(r))) for r in rows]


def frames(spark, documents, target):
    return (
        spark.createDataFrame(documents, "doc_id long, text string").repartition(3),
        spark.createDataFrame([(t,) for t in target], "text string"),
    )


TEXTS = ["Alpha beta GAMMA, delta!", "Été été x 12\x00\x01ab \U0001f600 z", "", None, "...", "a " * 40, "beta beta alpha " * 9]


@pytest.mark.parametrize("most,percent,least", [(1, 10, 20), (2, 50, 3), (3, 100, 0), (2, 1, 1)])
def test_brute_force(spark, most, percent, least):
    documents = [(i, TEXTS[i % len(TEXTS)] and TEXTS[i % len(TEXTS)] + f" w{i % 11} q{i % 3}") for i in range(150)]
    target = ["beta delta alpha", None, "w3 w3 w4 q1", ""]
    out = resampling.resampled(*frames(spark, documents, target), most=most, buckets=97, least_words=least, percent=percent, seed=5)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(documents, target, most, 97, least, percent, 5), key=str)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_pieces(monkeypatch, most):
    """Texts cut into pieces have the runs of whole ones, also where a word is longer than a piece."""
    text = ("ab cde " * 20 + "x" * 90 + " f gh" * 9).encode()
    whole = [s for _, found in resampling.run_sums(text, most) for s in found]
    monkeypatch.setattr(resampling, "PIECE", 16)
    cut = list(resampling.run_sums(text, most))
    assert len(cut) > 5 and sum(n for n, _ in cut) == len(text.split())
    assert Counter(s for _, found in cut for s in found) == Counter(whole) == Counter(crc32(f.encode()) for f in features(text.decode(), most))


def test_null_and_repeated_ids(spark):
    """Equal scores rank by id, null last; rows of one id keep all ranks apart."""
    text = " ".join(f"w{i}" for i in range(25))
    documents = [(None, text)] * 40 + [(7, text)] * 30 + [(i, text) for i in range(100, 130)]
    out = resampling.resampled(*frames(spark, documents, ["w1 w2"]), percent=100, least_words=20).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 101))
    ordered = sorted(out, key=lambda r: r["rank"])
    assert [r.score for r in ordered] == sorted((r.score for r in out), reverse=True)


def test_empty_tables_and_sample(spark):
    documents, target = frames(spark, [(i, f"common word{i % 5} " * 15) for i in range(60)] + [(None, None)], ["word3 word3"])
    assert resampling.resampled(documents.limit(0), target).count() == 0
    assert resampling.resampled(documents, target.limit(0)).where("rank is not null").count() == 6
    wide = documents.selectExpr("*", "'x' as score", "1 as rank", "2 as weight")
    drawn = resampling.sample(wide, target)
    assert drawn.columns == wide.columns and drawn.count() == 6
    assert set(r.doc_id for r in drawn.collect()) == {r.doc_id for r in resampling.resampled(wide, target).where("rank is not null").collect()}


def test_prefers_the_target(spark):
    """With much to choose from, most of what is drawn looks like the target."""
    documents = [(i, ("near " if i % 10 == 0 else "far ") * 30 + f"w{i % 4}") for i in range(400)]
    out = resampling.resampled(*frames(spark, documents, ["near " * 50])).where("rank is not null").collect()
    assert len(out) == 40 and sum(r.doc_id % 10 == 0 for r in out) >= 30
