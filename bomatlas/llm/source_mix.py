"""Mixing sources to target weights, cut at each source's exact budget of words.

Every row gets a hash-random key. Within a source, rows are ordered by key: the key's first
digits are ranges of equal width, so sums per range, a running sum over the ranges of a
source and a running sum inside each range give the prefix sum of words without ever putting
a source in one task. A source that needs more words than it has repeats whole epochs; the
rest of its budget is cut from the front of the order, the last row in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomatlas.llm.common import WORD, probably_in, stored, whole_rows, word_count

#: By the order of the sources' names, again and again.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its words.
MOST_EPOCHS = 3
#: Digits (base 16) of the key that name a range: 4,096 ranges a source.
RANGE_DIGITS = 3

_SOURCE = ["_no_source", "_source"]


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words of each source, from ``_no_source, _source, source_size``.

    Weights share the sum of all sizes. A source stops at ``most`` times its size, and what it
    can't give goes to the others by weight. Sources stop in the order of size over weight, so
    one running sum over the sources (one row each) finds the level where the sharing ends.
    """
    by_name = Window.orderBy(*_SOURCE)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int")))
    limit = (F.col("source_size") * most).alias("_limit")
    weighed = weighed.select("*", limit)
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), *_SOURCE)
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    sharers = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = weighed.select("*", (left / sharers).alias("_level"), F.row_number().over(order).alias("_at"))
    open_ = F.col("_level") * F.col("_weight") < F.col("_limit")
    shared = level.select("*", F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.col("_at"))).over(every).alias("_share"))
    return shared.select(
        *_SOURCE,
        "source_size",
        F.coalesce(F.least(F.col("_limit").cast("double"), F.col("_share") * F.col("_weight")), F.col("_limit").cast("double")).alias("target"),
    )


def mixed(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 7,
    range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, text_hash`` for every row of ``documents``.

    ``taken`` counts words, repeats included. Null texts have size 0; a null source is a source
    of its own, after the others. Rows that agree in ``doc_id`` are ordered by size and text
    digest, so reruns agree. An empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(
        documents.select(
            "doc_id",
            "source",
            F.col("source").isNull().alias("_no_source"),
            F.coalesce("source", F.lit("")).alias("_source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("_digest"),
            key.alias("_key"),
        ).withColumn("_range", F.substring("_key", 1, range_digits)),
        "mix",
    )
    ranges = sized.groupBy(*_SOURCE, "_range").agg(F.sum("size").alias("_in_range"))
    sums = ranges.groupBy(*_SOURCE).agg(F.sum("_in_range").alias("source_size"))
    along = Window.partitionBy(*_SOURCE).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*_SOURCE, "_range", F.coalesce(F.sum("_in_range").over(along), F.lit(0)).alias("_start"))
    starts = starts.join(targets(sums, weights, most), _SOURCE)
    inside = (
        Window.partitionBy(*_SOURCE, "_range")
        .orderBy("_key", "doc_id", "size", "_digest")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    return (
        sized.join(starts, [*_SOURCE, "_range"])
        .select("*", before.alias("_before"))
        .select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))).cast("long").alias("taken"),
            F.col("_digest").alias("text_hash"),
        )
    )


def mixture(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each time a document is used, with its ``epoch`` and ``words``.

    The row where a budget ends holds its first words only, white space kept. Rows equal in
    id, source and text are one document here, used as often as all of them together.
    Columns named ``epoch`` and ``words`` are replaced.
    """
    plan = mixed(documents, **options).where("taken > 0")
    uses = stored(
        plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("text_hash").alias("_hash"))
        .agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count("*").alias("_rows")),
        "uses",
    )
    body = whole_rows(documents, _doc="doc_id", _origin="source").withColumn("_digest", F.xxhash64(F.col("_row")["text"]))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_origin").eqNullSafe(F.col("_from")) & (F.col("_digest") == F.col("_hash"))
    several = uses.where("_rows > 1")
    used = body.join(uses.where("_rows = 1"), same).unionByName(
        probably_in(body, "_doc", several.select("_id")).join(several, same).dropDuplicates(["_id", "_from", "_hash"])
    )
    used = used.withColumn("_epoch", F.explode(F.expr("sequence(0L, (_taken - 1) div _size)")))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_epoch") * F.col("_size"))
    text = F.col("_row")["text"]
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(words < F.col("_size"), F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(text)
    kept = [c for c in documents.columns if c not in ("epoch", "words")]
    return used.select(*[cut.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in kept], F.col("_epoch").alias("epoch"), words.alias("words"))
