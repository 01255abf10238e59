"""Version ranges: ``<2``, ``>=4 <5``, ``^1.2``, ``~1.2``, ``1.x``, ``=1.0.0``, ``1.2.3``.

Tokens are separated by white space or commas and are ANDed. A range becomes a list of
``(op, key)`` comparators on ``version_sort_key``; bounds are release keys with epoch 0.

Two forms: :func:`parse_version_range` for one literal range (gives plain string
comparisons that reach the Parquet scan) and :func:`range_comparators` for a column of
ranges (a watch list joined to the index).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomatlas.functions.text import strip
from bomatlas.functions.versions import EPOCH_WIDTH, SEGMENT_WIDTH, SEGMENTS, clamp_pad

_NUMBERS = r"^((?:[0-9]+(?:\.|$))*)"
_BIGGEST = 10**SEGMENT_WIDTH - 1


class VersionRangeError(ValueError):
    """The range text does not follow the grammar."""


def _numbers(text: str) -> list[int]:
    return [int(n) for n in re.match(_NUMBERS, text).group(1).split(".") if n]


def _key(numbers: list[int]) -> str:
    padded = (numbers + [0] * SEGMENTS)[:SEGMENTS]
    body = ".".join(str(min(n, _BIGGEST)).zfill(SEGMENT_WIDTH) for n in padded)
    return f"{'0' * EPOCH_WIDTH}!{body}.~"


def _bump_at(prefix: str, numbers: list[int]) -> int:
    """Index of the segment whose increase ends the span."""
    if prefix == "^":
        nonzero = [i for i, n in enumerate(numbers[:3]) if n > 0]
        return nonzero[0] if nonzero else min(len(numbers), 3) - 1
    return 1 if len(numbers) >= 2 else 0


_TOKEN = re.compile(r"(?P<op>[<>]=?|=)?(?P<prefix>[\^~])?(?P<rest>.*)", re.DOTALL)


def _comparators(token: str) -> list[tuple[str, str]]:
    """One token: an operator and a version, a whole version, or a span of versions."""
    op, prefix, rest = _TOKEN.fullmatch(token).group("op", "prefix", "rest")
    # After an operator a prefix has no meaning, so the version must begin at once.
    numbers = _numbers((prefix or "") + rest if op else rest)
    if not numbers:
        raise VersionRangeError(f"no version number in {token!r}")
    if op:
        return [(op, _key(numbers))]
    if prefix or len(numbers) < 3:
        at = _bump_at(prefix or "", numbers)
        low = (numbers + [0, 0, 0])[:3]
        return [(">=", _key(low)), ("<", _key([*low[:at], low[at] + 1]))]
    if set("xX*") & set(token):
        raise VersionRangeError(f"a wildcard after three numbers: {token!r}")
    return [("=", _key(numbers))]


def parse_version_range(text: str) -> list[tuple[str, str]]:
    """Comparators of one range; raises :class:`VersionRangeError` on a bad one."""
    if "||" in (text or ""):
        raise VersionRangeError("a range is one span; alternatives need a range each")
    tokens = re.findall(r"[^\s,]+", text or "")
    if not tokens:
        raise VersionRangeError("a range without any version")
    return [comparator for token in tokens for comparator in _comparators(token)]


def satisfies(key: Column, comparators: list[tuple[str, str]]) -> Column:
    """AND of string comparisons; a NULL key satisfies nothing."""
    compare = {
        ">=": lambda bound: key >= bound,
        ">": lambda bound: key > bound,
        "<=": lambda bound: key <= bound,
        "<": lambda bound: key < bound,
        "=": lambda bound: key == bound,
    }
    return reduce(lambda a, b: a & b, [compare[op](F.lit(bound)) for op, bound in comparators])


def _number(digits: Column, index: int) -> Column:
    biggest = F.lit(_BIGGEST).cast("bigint")
    text = F.coalesce(F.get(digits, F.lit(index)), F.lit("0"))
    return F.least(F.coalesce(text.try_cast("bigint"), biggest), biggest)


def _bound(op: Column | str, *numbers: Column) -> Column:
    op = F.lit(op) if isinstance(op, str) else op
    return F.struct(op.alias("op"), F.array(*[n.cast("string") for n in numbers]).alias("parts"))


def _bounds(t: Column) -> Column:
    """One or two ``struct<op,parts>`` for a token; NULL when the token is invalid."""
    a, b, c, count = t["a"], t["b"], t["c"], t["count"]
    exact = F.struct(
        F.when(t["op"] != "", t["op"]).otherwise("=").alias("op"), t["digits"].alias("parts")
    )
    low = _bound(">=", a, b, c)
    to_major, to_minor = _bound("<", a + 1), _bound("<", a, b + 1)
    high = F.when(
        t["prefix"] == "^",
        F.when((a > 0) | (count == 1), to_major)
        .when((b > 0) | (count == 2), to_minor)
        .otherwise(_bound("<", a, b, c + 1)),
    ).otherwise(F.when(count >= 2, to_minor).otherwise(to_major))
    return (
        F.when(count == 0, F.lit(None))
        .when(t["op"] != "", F.array(exact))
        .when((t["prefix"] == "") & (count >= 3), F.when(~t["wild"], F.array(exact)))
        .otherwise(F.array(low, high))
    )


def _keyed(bound: Column) -> Column:
    padded = F.slice(
        F.concat(bound["parts"], F.array_repeat(F.lit("0"), SEGMENTS)), 1, SEGMENTS
    )
    body = F.array_join(F.transform(padded, lambda part: clamp_pad(part, SEGMENT_WIDTH)), ".")
    return F.struct(
        bound["op"].alias("op"), F.concat(F.lit("0" * EPOCH_WIDTH + "!"), body, F.lit(".~")).alias("key")
    )


def range_comparators(text: Column) -> Column:
    """``array<struct<op,key>>`` for a column of ranges; NULL where the range is invalid.

    Each ``transform`` binds the fields the next one reads, so nothing is worked out
    twice. This runs over watch lists, not over the index.
    """
    text = strip(text)
    tokens = F.filter(F.split(text, r"[\s,]+"), lambda t: t != "")
    split_up = F.transform(
        tokens,
        lambda t: F.struct(
            F.regexp_extract(t, r"^(>=|<=|>|<|=)", 1).alias("op"),
            F.regexp_extract(t, r"^([\^~])", 1).alias("prefix"),
            F.rlike(t, F.lit("[xX*]")).alias("wild"),
            F.filter(
                F.split(
                    F.regexp_extract(
                        F.regexp_replace(t, r"^(>=|<=|>|<|=|\^|~)", ""), _NUMBERS, 1
                    ),
                    r"\.",
                ),
                lambda n: n != "",
            ).alias("digits"),
        ),
    )
    numbered = F.transform(
        split_up,
        lambda t: F.struct(
            t["op"].alias("op"),
            t["prefix"].alias("prefix"),
            t["wild"].alias("wild"),
            t["digits"].alias("digits"),
            F.size(t["digits"]).alias("count"),
            *[_number(t["digits"], i).alias(name) for i, name in enumerate("abc")],
        ),
    )
    bounds = F.transform(numbered, _bounds)
    valid = ~F.contains(text, F.lit("||")) & (F.size(tokens) > 0)
    # flatten() of an array that holds a NULL is NULL, which carries an invalid token up.
    return F.when(valid, F.transform(F.flatten(bounds), _keyed))


def satisfies_all(key: Column, comparators: Column) -> Column:
    """Row-wise :func:`satisfies` for comparators held in a column."""
    return F.coalesce(
        key.isNotNull()
        & F.forall(
            comparators,
            lambda c: F.when(c["op"] == ">=", key >= c["key"])
            .when(c["op"] == ">", key > c["key"])
            .when(c["op"] == "<=", key <= c["key"])
            .when(c["op"] == "<", key < c["key"])
            .otherwise(key == c["key"]),
        ),
        F.lit(False),
    )
