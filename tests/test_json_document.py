"""Elements of a JSON array by byte ranges, against Python's own JSON reader."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from bomatlas.sources import json_document, sbom

TEXTS = ['plain', 'quote " brace { bracket [ ]', "back\\slash", 'end \\"', "\\\\\\", 'a "components": [{', "é \U0001f600", ""]


def component(draw, deep=2):
    found = {"name": draw.choice(TEXTS), draw.choice(TEXTS): draw.choice([None, 1.5, True, [1, [2, {}]], {}])}
    if deep and draw.random() < 0.7:
        found["components"] = [component(draw, deep - 1) for _ in range(draw.randrange(4))]
        found[draw.choice(TEXTS)] = {"components": [{"name": "inner"}]}
    return found


def document(draw, n):
    others = {"metadata": {"component": component(draw), "components": [{"name": "not this"}]}, "bomFormat": draw.choice(TEXTS), "services": [component(draw)]}
    keys = [*others, "components"]
    draw.shuffle(keys)
    return {k: others[k] if k in others else [component(draw) for _ in range(n)] for k in keys}


@pytest.mark.parametrize("size,chunk", [(7, 5), (64, 17), (1000, 64), (1 << 20, 1 << 20)])
def test_ranges_against_a_parser(size, chunk, tmp_path, monkeypatch):
    """All steps without Spark: every range size and chunk size gives the parser's elements."""
    monkeypatch.setattr(json_document, "CHUNK_BYTES", chunk)
    draw = random.Random(size)
    for turn in range(12):
        whole = document(draw, draw.choice([0, 1, 5]))
        text = json.dumps(whole, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])).encode()
        path = tmp_path / f"{turn}.json"
        path.write_bytes(text)
        inside = depth = 0
        active, found = None, []
        for start in range(0, len(text), size):
            end = min(start + size, len(text))
            effects, odd = [json_document._Effect(False), json_document._Effect(True)], 0
            with json_document.opened_text(f"file:{path}") as source:
                for piece in json_document._chunks(source, start, end):
                    odd += len(piece.quotes)
                    for effect in effects:
                        effect.add(piece)
            row = {"file": f"file:{path}", "start": start, "end": end, "inside": inside, "depth": depth, "active": active}
            found += json_document._elements(row, b"[components")
            effect = effects[inside]
            active = effect.opened[1 - depth].decode() if 1 - depth in effect.opened else active
            inside, depth = (inside + odd) % 2, depth + effect.depth
        assert [json.loads(t) for _, t in found] == whole["components"]
        assert all(text[at : at + len(t)] == t for at, t in found)


def test_files_in_spark(spark, tmp_path):
    """Several documents, one of them compressed, one broken off, one empty; more than one task reads a file."""
    draw = random.Random(4)
    wholes = [document(draw, 60) for _ in range(3)]
    for i, whole in enumerate(wholes[:2]):
        (tmp_path / f"{i}.json").write_text(json.dumps(whole))
    with gzip.open(tmp_path / "2.json.gz", "wt") as f:
        json.dump(wholes[2], f)
    broken = json.dumps({"components": [{"name": "a"}, {"name": "b"}]})
    (tmp_path / "3.json").write_text(broken[:-6])
    (tmp_path / "4.json").write_text("")
    rows = json_document.document_elements(spark, str(tmp_path), range_bytes=997)
    found = rows.withColumn("task", F.spark_partition_id()).orderBy("file", "at").collect()
    for i, whole in enumerate([*wholes, {"components": [{"name": "a"}]}, {"components": []}]):
        own = [r for r in found if f"/{i}.json" in r.file]
        assert [json.loads(r.element) for r in own] == whole["components"]
    assert len({r.task for r in found if r.file.endswith("/0.json")}) > 3
    (tmp_path / "none").mkdir()
    assert json_document.document_elements(spark, str(tmp_path / "none")).count() == 0


def test_limit_takes_the_first(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"components": [{"name": f"{i}/{j}"} for j in range(30)]}))
    first = sbom.read_aggregate(spark, str(tmp_path), "document", limit=35, range_bytes=100)
    assert sorted(r.name for r in first.collect()) == sorted([f"0/{j}" for j in range(30)] + [f"1/{j}" for j in range(5)])
