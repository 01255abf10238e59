"""Golden vectors for the version key, and agreement with slow independent readers."""

import itertools
import random
import re

from pyspark.sql import functions as F

from bomatlas.functions.ranges import (
    VersionRangeError,
    parse_version_range,
    range_comparators,
    satisfies,
    satisfies_all,
)
from bomatlas.functions.versions import with_version_columns

import pytest

# Ecosystem, version, kind, comparable, exact scheme, epoch, unpadded key.
VECTORS = """
npm|0.9.2|release|T|T|0|0!0.9.2.0.0.0 ~
npm|0.10.0|release|T|T|0|0!0.10.0.0.0.0 ~
npm|1.0.0|release|T|T|0|0!1.0.0.0.0.0 ~
npm|2.5.11|release|T|T|0|0!2.5.11.0.0.0 ~
npm|4.16.3|release|T|T|0|0!4.16.3.0.0.0 ~
npm|4.17.1|release|T|T|0|0!4.17.1.0.0.0 ~
npm|4.18.2|release|T|T|0|0!4.18.2.0.0.0 ~
npm|4.22.1|release|T|T|0|0!4.22.1.0.0.0 ~
npm|5.0.0-alpha.9|prerelease|T|T|0|0!5.0.0.0.0.0 -1alpha.0000000000009
npm|5.0.0-beta.1|prerelease|T|T|0|0!5.0.0.0.0.0 -1beta.0000000000001
npm|5.0.0-rc.1|prerelease|T|T|0|0!5.0.0.0.0.0 -1rc.0000000000001
npm|5.0.0|release|T|T|0|0!5.0.0.0.0.0 ~
npm|5.1.0|release|T|T|0|0!5.1.0.0.0.0 ~
npm|5.2.1|release|T|T|0|0!5.2.1.0.0.0 ~
npm|^4.14.0|range|F|T|0|NULL
npm|~4.17.1|range|F|T|0|NULL
npm|4.x|range|F|T|0|NULL
npm|*|range|F|T|0|NULL
npm|latest|unparseable|F|T|0|NULL
npm||empty|F|T|0|NULL
npm|v1.2.3|release|T|T|0|0!1.2.3.0.0.0 ~
npm|@babel/core@7.0.0|unparseable|F|T|0|NULL
pypi|0.9|release|T|T|0|0!0.9.0.0.0.0 ~
pypi|0.10|release|T|T|0|0!0.10.0.0.0.0 ~
pypi|1.2.3|release|T|T|0|0!1.2.3.0.0.0 ~
pypi|1.2.3a1|prerelease|T|T|0|0!1.2.3.0.0.0 -1a1
pypi|1.0.0rc1|prerelease|T|T|0|0!1.0.0.0.0.0 -1rc1
pypi|2.0|release|T|T|0|0!2.0.0.0.0.0 ~
pypi|1!1.0|release|T|T|1|1!1.0.0.0.0.0 ~
pypi|>= 2.11.1|range|F|T|0|NULL
pypi|~> 2.9.9|range|F|T|0|NULL
gem|0.9.2|release|T|T|0|0!0.9.2.0.0.0 ~
gem|0.10.0|release|T|T|0|0!0.10.0.0.0.0 ~
gem|1.0.0|release|T|T|0|0!1.0.0.0.0.0 ~
gem|1.0.0.beta|prerelease|T|T|0|0!1.0.0.0.0.0 -1beta
maven|1.0.0|release|T|F|0|0!1.0.0.0.0.0 ~
maven|2.0.7.RELEASE|release|T|F|0|0!2.0.7.0.0.0 ~
maven|3.0.0-M1|prerelease|T|F|0|0!3.0.0.0.0.0 -1m1
maven|Edgware.RELEASE|unparseable|F|F|0|NULL
maven|20160810|release|T|F|0|0!20160810.0.0.0.0.0 ~
maven|4.1.133.Final|release|T|F|0|0!4.1.133.0.0.0 ~
nuget|1.0.0.0|release|T|T|0|0!1.0.0.0.0.0 ~
nuget|1.0.0-beta|prerelease|T|T|0|0!1.0.0.0.0.0 -1beta
golang|v1.2.3|release|T|T|0|0!1.2.3.0.0.0 ~
golang|v0.0.0-20210101000000-abcdef123456|sha|F|T|0|NULL
cargo|0.11.0+wasi-snapshot-preview1|release|T|T|0|0!0.11.0.0.0.0 ~
githubactions|4.*.*|wildcard|F|F|0|NULL
githubactions|v4|branch|F|F|0|NULL
github|master|branch|F|F|0|NULL
github|idt-develop|branch|F|F|0|NULL
npm|NOASSERTION|unparseable|F|T|0|NULL
npm|deadbeefdeadbeefdeadbeefdeadbeefdeadbeef|sha|F|T|0|NULL
npm|abcdef1|sha|F|T|0|NULL
""".strip().splitlines()

# Further cases worked out by hand from the rules.
EXTRA = """
npm|1.2.|unparseable|F|T|0|NULL
npm|=1.2.3|release|T|T|0|0!1.2.3.0.0.0 ~
npm|= 1.2.3|release|T|T|0|0!1.2.3.0.0.0 ~
npm|%5E1.2|range|F|T|0|NULL
npm|1.2.3-x.7|range|F|T|0|NULL
npm|1.2.3-|release|T|T|0|0!1.2.3.0.0.0 ~
npm|1.2.3-+build|release|T|T|0|0!1.2.3.0.0.0 ~
npm|1000000000000.1|release|T|T|0|0!9999999999.1.0.0.0.0 ~
npm|0000000000012.1|release|T|T|0|0!12.1.0.0.0.0 ~
npm|1.2.3.4.5.6.7|release|T|T|0|0!1.2.3.4.5.6 ~
npm|1.0.0-1234567890123456|prerelease|T|T|0|0!1.0.0.0.0.0 -01234567890123456
npm|12345678|release|T|T|0|0!12345678.0.0.0.0.0 ~
pypi|1.0.post2|release|T|T|0|0!1.0.0.0.0.0 ~
pypi|1.0+local.1|release|T|T|0|0!1.0.0.0.0.0 ~
pypi|1!abc|unparseable|F|T|0|NULL
pypi|x!1.0|release|T|T|0|0!1.0.0.0.0.0 ~
pypi|123456!1.0|release|T|T|123456|9999!1.0.0.0.0.0 ~
pypi|1.0.DEV3|prerelease|T|T|0|0!1.0.0.0.0.0 -1dev3
gem|1.|prerelease|T|T|0|0!1.0.0.0.0.0 -
gem|1.10beta|prerelease|T|T|0|0!1.0.0.0.0.0 -110beta
gem|1..2|prerelease|T|T|0|0!1.0.0.0.0.0 -0000000000002
maven|1.0-SNAPSHOT|prerelease|T|F|0|0!1.0.0.0.0.0 -1snapshot
apk|1.2.3-r4|prerelease|T|F|0|0!1.2.3.0.0.0 -1r4
apk|1.2_git|release|T|F|0|0!1.2.0.0.0.0 ~
apk|edge|unparseable|F|F|0|NULL
NPM|V2.0.0|release|T|T|0|0!2.0.0.0.0.0 ~
github||empty|F|F|0|NULL
""".strip().splitlines()


def padded(key):
    if key == "NULL":
        return None
    epoch, rest = key.split("!")
    release, tail = rest.split(" ")
    return epoch.zfill(4) + "!" + ".".join(s.zfill(10) for s in release.split(".")) + "." + tail


def test_golden_vectors(spark):
    rows = [line.split("|") for line in VECTORS + EXTRA]
    df = spark.createDataFrame(
        [(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, ecosystem string, version_raw string"
    )
    got = {r.i: r for r in with_version_columns(df).collect()}
    for i, (eco, version, kind, comparable, exact, epoch, key) in enumerate(rows):
        r = got[i]
        actual = (
            r.version_kind, r.comparable, r.exact_scheme, r.is_prerelease, r.epoch, r.version_sort_key,
        )
        expected = (
            kind, comparable == "T", exact == "T", kind == "prerelease", int(epoch), padded(key),
        )
        assert actual == expected, (eco, version)


def test_null_inputs(spark):
    df = spark.createDataFrame([(None, None)], "ecosystem string, version_raw string")
    row = with_version_columns(df).first()
    assert (row.version_kind, row.comparable, row.version_sort_key) == ("empty", False, None)


ASCENDING = [
    ("npm", "0.9.2 0.10.0 1.0.0 2.5.11 4.16.3 4.17.1 4.18.2 4.22.1 5.0.0-alpha.9 5.0.0-beta.1 "
            "5.0.0-rc.1 5.0.0 5.1.0 5.2.1"),
    ("pypi", "0.9 0.10 1.2.3 2.0 1!1.0"),
]


def test_ordering(spark):
    for eco, versions in ASCENDING:
        rows = [(i, eco, v) for i, v in enumerate(versions.split())]
        df = spark.createDataFrame(rows, "i int, ecosystem string, version_raw string")
        keys = [r.version_sort_key for r in with_version_columns(df).orderBy("i").collect()]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)


# Predicate, candidates, matches.
RANGES = [
    ("<2", "1.0.0 1.99.99 2.0.0 2.5.11 4.18.2", "1.0.0 1.99.99"),
    (">=4 <5", "3.9.9 4.0.0 4.18.2 4.22.1 5.0.0", "4.0.0 4.18.2 4.22.1"),
    ("^4.17.0", "4.16.0 4.17.0 4.18.2 4.22.1 5.0.0", "4.17.0 4.18.2 4.22.1"),
    ("~4.17.1", "4.17.0 4.17.1 4.17.9 4.18.0", "4.17.1 4.17.9"),
    ("4.x", "3.9.9 4.0.0 4.22.1 5.0.0", "4.0.0 4.22.1"),
    ("=4.18.2", "4.18.1 4.18.2 4.18.3", "4.18.2"),
    ("<2", "0.9.2 0.10.0", "0.9.2 0.10.0"),
    # Consequences of the grammar.
    (">1", "1.0.0 1.0.1 2.0.0", "1.0.1 2.0.0"),
    ("<=2.1", "2.1.0 2.1.1", "2.1.0"),
    ("=1.2.3-rc1", "1.2.0 1.2.3", "1.2.0"),
    ("^0.0.3", "0.0.2 0.0.3 0.0.4", "0.0.3"),
    ("^0.2", "0.1.9 0.2.0 0.2.9 0.3.0", "0.2.0 0.2.9"),
    ("^0", "0.0.1 0.9.0 1.0.0", "0.0.1 0.9.0"),
    ("~1", "1.0.0 1.9.0 2.0.0", "1.0.0 1.9.0"),
    ("1.2.3.4", "1.2.3.4 1.2.3", "1.2.3.4"),
    (">=1,<3", "0.1.0 1.0.0 2.0.0 3.0.0", "1.0.0 2.0.0"),
    ("<2", "2.0.0-rc.1 2.0.0", "2.0.0-rc.1"),
]
BAD_RANGES = ["", "1 || 2", "*", "latest", "v1", "- ", ">= 2", "~> 2", "1.2.3.x", "^x", ">", ">=^1"]


def test_ranges_literal_and_column_form(spark):
    rows = [
        (i, r, v, v in m.split()) for i, (r, c, m) in enumerate(RANGES) for v in c.split()
    ]
    df = with_version_columns(
        spark.createDataFrame(rows, "i int, rng string, version_raw string, expected boolean")
        .withColumn("ecosystem", F.lit("npm"))
    ).withColumn("got", satisfies_all(F.col("version_sort_key"), range_comparators(F.col("rng"))))
    assert df.where(~F.col("got").eqNullSafe(F.col("expected"))).count() == 0
    keyed = spark.createDataFrame(
        [(r.i, r.version_raw, r.version_sort_key) for r in df.collect()], "i int, v string, k string"
    )
    hits = None
    for i, (text, _, _) in enumerate(RANGES):
        hit = keyed.where(F.col("i") == i).where(satisfies(F.col("k"), parse_version_range(text)))
        hits = hit if hits is None else hits.union(hit)
    got = [(r.i, r.v) for r in hits.collect()]
    assert sorted(got) == sorted((i, v) for i, (_, _, m) in enumerate(RANGES) for v in m.split())


def test_bad_ranges(spark):
    for text in BAD_RANGES:
        with pytest.raises(VersionRangeError):
            parse_version_range(text)
    df = spark.createDataFrame([(t,) for t in BAD_RANGES], "rng string")
    assert df.where(range_comparators(F.col("rng")).isNotNull()).count() == 0


def test_long_ranges(spark):
    text = " ".join(["<2"] * 400)
    assert len(parse_version_range(text)) == 400
    column = spark.createDataFrame([(text,)], "rng string").select(F.size(range_comparators(F.col("rng"))).alias("n"))
    assert column.first().n == 400


def slow_match(version, token):
    """Independent evaluator on integer tuples for simple tokens."""
    v = tuple((list(map(int, version.split("."))) + [0] * 6)[:6])
    op = re.match(r"[<>=^~]*", token).group()
    nums = [int(x) for x in token[len(op):].split(".")]
    t = tuple((nums + [0] * 6)[:6])
    if op in ("<", "<=", ">", ">=", "="):
        return {"<": v < t, "<=": v <= t, ">": v > t, ">=": v >= t, "=": v == t}[op]
    if op == "^":
        fixed = next((i for i, n in enumerate(nums) if n), len(nums) - 1)
        return v >= t and v[: fixed + 1] == t[: fixed + 1]
    width = min(len(nums), 2) if op == "~" else len(nums)
    if op == "" and len(nums) >= 3:
        return v == t
    return v >= t and v[:width] == t[:width]


def test_random_ranges_agree_with_slow_evaluator(spark):
    rng = random.Random(7)
    version = lambda k: ".".join(str(rng.choice([0, 0, 1, 2, 3, 10, 11])) for _ in range(k))
    versions = sorted({version(3) for _ in range(80)})
    tokens = sorted({rng.choice(["<", "<=", ">", ">=", "=", "^", "~", ""]) + version(rng.choice([1, 2, 3]))
                     for _ in range(120)})
    rows = [(t, v, slow_match(v, t)) for t, v in itertools.product(tokens, versions)]
    df = with_version_columns(
        spark.createDataFrame(rows, "rng string, version_raw string, expected boolean")
        .withColumn("ecosystem", F.lit("npm"))
    ).withColumn("got", satisfies_all(F.col("version_sort_key"), range_comparators(F.col("rng"))))
    assert df.where(~F.col("got").eqNullSafe(F.col("expected"))).take(5) == []
    keyed = {r.version_raw: r.version_sort_key for r in df.collect()}
    by_key = sorted(versions, key=lambda v: keyed[v])
    assert by_key == sorted(versions, key=lambda v: tuple(map(int, v.split("."))))
    for token in tokens:
        comps = parse_version_range(token)
        ops = {"<": str.__lt__, "<=": str.__le__, ">": str.__gt__, ">=": str.__ge__, "=": str.__eq__}
        for v in versions:
            assert all(ops[o](keyed[v], k) for o, k in comps) == slow_match(v, token), (token, v)
