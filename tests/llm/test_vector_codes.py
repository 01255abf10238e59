"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomatlas.llm import vector_codes as codes


def brute(rows, parts, entries, rounds, scale):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    longest = max((len(r[1]) for r in kept), default=0)
    length = parts * max(1, -(-longest // parts))
    width = length // parts
    whole = [[math.floor(scale * c) for c in r[1]] + [0] * (length - len(r[1])) for r in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(own, book):
        d = [sum((a - b) ** 2 for a, b in zip(own, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[0], []).append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(v) // len(members) for v in zip(*members)]
    out, sums = [], {}
    for r, c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append([r[0], "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), r[2]])
        sums[r[2]] = sums.get(r[2], 0) + out[-1][2]
    text = ",".join(str(v) for p in books for e in p for v in e)
    return sorted(((i, c, d, sums[label]) for i, c, d, label in out), key=str), text


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out, books = codes.compressed(frame, **options)
    return sorted(map(tuple, out.collect()), key=str), books.text()


def random_rows(n, length, seed=1, spread=1.0):
    draw = random.Random(seed)
    return [(i, [float(np.float32(draw.gauss(0, spread))) for _ in range(length)], draw.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("parts,entries,length,spread", [(4, 8, 8, 1.0), (2, 5, 6, 1e5), (3, 16, 7, 0.01), (1, 3, 2, 1.0)])
def test_brute_force(spark, parts, entries, length, spread):
    rows = random_rows(60, length, spread=spread)
    rows += [(60, None, 1), (61, [1.0, None] + [0.0] * (length - 2), 1), (62, [float("nan")] * length, 2), (63, [float("inf")] * length, None)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (64, rows[5][1][:1], 2), (65, [], 1)]
    options = dict(parts=parts, entries=entries, rounds=3, scale=1024)
    assert run(spark, rows, **options) == brute(rows, **options)


def test_ties_take_the_first_entry(spark):
    """Every vector as often as others, half of them equal: equal entries lose their parts to the first."""
    rows = [(i, [float(i % 2)] * 4, i % 3) for i in range(40)]
    options = dict(parts=2, entries=6, rounds=2, scale=1024)
    found, text = run(spark, rows, **options)
    assert (found, text) == brute(rows, **options)
    assert {c for _, c, _, _ in found} == {"0000", "0101"}


def test_fewer_vectors_than_entries_and_none(spark):
    rows = random_rows(3, 4)
    found, _ = run(spark, rows, entries=256)
    assert [d for *_, d, _ in found] == [0, 0, 0]
    assert run(spark, [(1, None, 1)])[0] == []
    assert run(spark, [])[0] == []


def test_components_beyond_the_limit_are_held(spark):
    most = codes.limit_of(4)
    rows = [(0, [3e38, -3e38, 0.0, 1.0], 1), (1, [0.0] * 4, 1)]
    found, text = run(spark, rows, entries=2, rounds=1)
    assert text.split(",")[0] == str(most) and [d for *_, d, _ in found] == [0, 0]


def test_clashing_columns_and_decoding(spark):
    rows = random_rows(30, 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as code", "1 as error", "2 as _id")
    out, books = codes.compressed(frame, entries=30, rounds=0)
    assert out.columns == ["vec_id", "code", "error", "label_error"]
    values = {r.vec_id: r.decoded for r in codes.decode(out, books).collect()}
    assert all(values[i] == [math.floor(1024 * c) / 1024 for c in v] for i, v, _ in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.randoms(use_true_random=False))
def test_products_are_exact(depth, bits, draw):
    """Limbs give the products of Python's integers, whatever the size."""
    most = min(1 << bits, codes.limit_of(depth))
    left = np.array([[draw.randint(-most, most) for _ in range(depth)] for _ in range(5)], np.int64)
    right = np.array([[draw.randint(-most, most) for _ in range(depth)] for _ in range(4)], np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]
    assert codes.exact_products(left, right).tolist() == exact
    first, apart = codes.nearest(left, right)
    for x, at, d in zip(left, first, apart):
        all_ = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in right]
        assert all_.index(min(all_)) == at and min(all_) == d


def test_limbs_stay_exact_in_doubles():
    for depth in (1, 2, 15, 16, 17, 192, 4096):
        bits = codes.limb_bits(depth)
        assert depth * ((1 << bits) - 1) ** 2 < 1 << 53


def test_digest_is_of_all_entries(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()]
    out, books = codes.compressed(frame, entries=16, rounds=2)
    found, text = brute(rows, 4, 16, 2, 1024)
    assert hashlib.sha256(books.text().encode()).digest() == hashlib.sha256(text.encode()).digest()
    assert sorted(map(tuple, out.collect()), key=str) == found
