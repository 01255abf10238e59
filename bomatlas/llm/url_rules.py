"""URL filters: pattern rules indexed by their rarest literal token.

A rule names literal tokens (runs of a-z and 0-9) that every URL it matches contains. It is
filed under the one of them that the fewest URLs have. A URL's tokens fetch candidate rules
by an equi join, and only those run their regular expression. A rule without a literal token
is filed under the empty token, which every URL has, so nothing is missed.

Site rules (host and path prefix) beat pattern rules; among site rules the longest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomatlas.llm.common import LOWER, UPPER, whole_rows

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``literals``: tokens, lower case, that every matching URL holds as whole tokens."""

    name: str
    pattern: str
    action: str
    literals: list[str] = field(default_factory=list)
    site: bool = False


def site_rule(rule: str, action: str) -> Rule:
    """A host with its subdomains and a path prefix, written ``host/path``."""
    host, slash, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+", host)
    # The last run of the path may be the start of a longer token.
    whole += re.findall(r"[a-z0-9]+(?=[^a-z0-9])", (slash + path).lower())
    return Rule(rule, rf"^(?:[^/]*\.)?{re.escape(host + slash + path)}", action, whole, True)


def token_rule(word: str, action: str = BLOCK) -> Rule:
    """URLs with this token, or tokens joined by other characters, anywhere in host or path."""
    return Rule(word, rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", action, re.findall(r"[a-z0-9]+", word))


#: Patterns of hosts that a text corpus leaves out.
PATTERN_RULES = [
    token_rule(word)
    for word in ("casino-win", "casino", "free-bets", "betting", "poker", "spam-farm", "link-farm", "payday-loans", "porn", "warez")
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/ ? #``, A-Z lower-cased, and the path up to ``? #``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, shape, 1), UPPER, LOWER), F.regexp_extract(text, shape, 2)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(F.concat(F.translate(subject, UPPER, LOWER), F.lit("/")), "[^a-z0-9]+"))


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("pattern", T.StringType()),
            T.StructField("action", T.StringType()),
            T.StructField("literals", T.ArrayType(T.StringType())),
            T.StructField("site", T.BooleanType()),
        ]
    )
    return spark.createDataFrame([(r.name, r.pattern, r.action, r.literals, r.site) for r in rules], schema)


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with the ``token`` it is filed under: the rarest of its literals among ``tokens``."""
    literal = rules.select("*", F.explode_outer("literals").alias("token"))
    wanted = literal.select("token").where("token is not null").distinct()
    seen = tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarity = F.struct(F.coalesce("urls", F.lit(0)), F.coalesce("token", F.lit("")).alias("token"))
    return (
        literal.join(seen, "token", "left")
        .groupBy("name", "pattern", "action", "site")
        .agg(F.min(rarity).alias("rarest"))
        .select("name", "pattern", "action", "site", F.col("rarest.token").alias("token"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Every row of ``pages`` (all columns but those added) with ``host, path, rule, verdict, pattern``.

    ``rule`` is the site rule that decided, ``pattern`` the pattern rule; both are null where
    nothing matched, and the verdict is then ``allow``. A null URL, or one without ``://``, has
    empty host and path. Repeated URLs are judged once and every row gets its answer. Columns
    of ``pages`` named like an added one are replaced.
    """
    added = ["host", "path", "rule", "verdict", "pattern"]
    host, path = host_and_path(F.col("_url"))
    rows = whole_rows(pages, _url=url).select("_row", host.alias("_host"), path.alias("_path"), F.concat(host, path).alias("_subject"))
    subjects = rows.select("_subject").distinct()
    tokens = subjects.select("_subject", F.explode(_tokens(F.col("_subject"))).alias("token"))
    best = (
        tokens.where("token <> ''")
        .unionByName(subjects.select("_subject", F.lit("").alias("token")))
        .join(indexed(rules, tokens), "token")
        .where(F.regexp_like("_subject", F.col("pattern")))
        .groupBy("_subject")
        .agg(F.max(F.struct("site", F.length("name").alias("size"), "name", "action")).alias("_best"))
    )
    return rows.join(best, "_subject", "left").select(
        *[F.col("_row")[c].alias(c) for c in pages.columns if c not in added],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best.site"), F.col("_best.name")).alias("rule"),
        F.coalesce("_best.action", F.lit(ALLOW)).alias("verdict"),
        F.when(~F.col("_best.site"), F.col("_best.name")).alias("pattern"),
    )
