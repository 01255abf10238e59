"""Quality classifier: interpolated modified Kneser-Ney model of word n-grams.

Runs of words are counted over the whole of every trusted text, first inside each task, then
per run across tasks. Counts, continuation counts, context totals and probabilities are tables
keyed by 64-bit hashes of runs; they grow with the trusted texts and meet in equi joins only.

A document's log probability is a sum with one term for each run in it: with p(w | v) =
share(v, w) + gamma(v) p(w), an unseen run adds log gamma(v) + log p(w), and a seen one differs
from that by a number that depends on the run alone. So a document's runs, counted per text,
are joined with one table of runs and numbers, and summed.

Perplexity is judged within its language: above the highest or below the lowest quantile of
the trusted texts, a document reads unlike them (noise, or endless repetition) and is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.llm.common import probably_in, stored, word_count
from bomatlas.llm.tokens import Powers, bytes_and_offsets, mix, slices, words_of

#: Words of the longest run.
ORDER = 2
#: Quantiles of the trusted texts' perplexity between which a document is kept.
LOWEST, HIGHEST = 0.01, 0.99
#: One in so many trusted texts is not learned from.
HELD_OUT = 10
#: A discount is never less, so that every context leaves room for other words.
LEAST_DISCOUNT = 0.1
#: Runs counted in a task before they leave it.
FLUSH = 2_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: What stands before the first word and after the last.
_BEGIN, _END = np.uint64(0xB0B0B0B0B0B0B0B1), np.uint64(0xE0E0E0E0E0E0E0E3)


def _keys(data: np.ndarray, at: np.ndarray, powers: Powers, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each word and text end: the keys of the runs of 1 to ``order`` words that end there, those of the runs before it, and its text."""
    words = words_of(data, at, powers)
    pad, counts = order - 1, words.counts
    # Each text: beginnings, words, end.
    sizes = counts + pad + 1
    line = np.full(int(sizes.sum()), _BEGIN, np.uint64)
    starts = np.cumsum(sizes) - sizes
    own = np.arange(len(words.hashes)) + np.repeat(starts + pad - words.first[:-1], counts)
    line[own] = words.hashes
    line[starts + sizes - 1] = _END
    event = np.ones(len(line), bool)
    for i in range(pad):
        event[starts + i] = False
    place = np.flatnonzero(event)
    runs, ends = np.zeros(len(line), np.uint64), []
    for k in range(order):
        # The run of k + 1 words that ends at each place; texts don't touch, for beginnings lie between.
        runs = runs + np.roll(line, k) * np.uint64(pow(int(_FACTOR), k, 1 << 64))
        ends.append(mix(runs + np.uint64(k + 1)))
    text = np.repeat(np.arange(len(counts)), counts + 1)
    return [e[place] for e in ends], [e[place - 1] for e in ends[:-1]], text


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _names(order: int) -> list[str]:
    """``run1 .. runN``: suffixes of an n-gram; ``before2 .. beforeN``: their contexts."""
    return [f"run{k}" for k in range(1, order + 1)] + [f"before{k}" for k in range(2, order + 1)]


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            _, first, n = np.unique(columns[order - 1], return_index=True, return_counts=True)
            return pa.record_batch([*[_signed(c[first]) for c in columns], pa.array(n)], names=[*_names(order), "n"])

        for batch in batches:
            data, at = bytes_and_offsets(batch.column("text"))
            for low, high in slices(at):
                ends, before, _ = _keys(data, at[low : high + 1], powers, order)
                held.append([*ends, *before])
                size += len(ends[0])
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
        if size:
            yield flush()

    return count


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k - (k + 1) * y * above / own if own else 0.0 for k, own, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, LEAST_DISCOUNT), float(k)) for k, d in enumerate(found, 1)]


@dataclass(frozen=True)
class Model:
    """``values``: ``key, value``, what a run adds to a text's log probability beside ``unknown`` for each word and end."""

    values: DataFrame
    unknown: float
    order: int


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """Count runs over every whole text of ``trusted`` (column ``text``; null is empty) and smooth them.

    An end counts as a word, so that repeated, empty and very long texts need no rule of their
    own. Without any text the model knows no run. Two runs with one 64-bit hash count as one.
    """
    names = _names(order)
    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    counted = trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(order), schema)
    tables = [stored(counted.groupBy(*names).agg(F.sum("n").alias("n")), "runs")]
    for k in range(order - 1, 0, -1):
        # How many words a shorter run was seen after.
        kept = _names(k)
        tables.insert(0, stored(tables[0].groupBy(*kept).agg(F.count("*").alias("n")), f"runs{k}"))

    def discounted(table: DataFrame) -> DataFrame:
        d1, d2, d3 = _discounts(table)
        return table.withColumn("off", F.least(F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3), F.col("n")))

    single = discounted(tables[0])
    total, offs, size = single.agg(F.sum("n"), F.sum("off"), F.count("*")).first()
    if not total:
        return Model(tables[0].select(F.col("run1").alias("key"), F.lit(0.0).alias("value")), 0.0, order)
    # One word more than was seen stands for all others.
    unknown = offs / total / (size + 1)
    lower = stored(single.select("run1", ((F.col("n") - F.col("off")) / total + unknown).alias("p")), "p1")
    values = [lower.select(F.col("run1").alias("key"), (F.log("p") - F.log(F.lit(unknown))).alias("value"))]
    for k in range(2, order + 1):
        runs, before = f"run{k}", f"before{k}"
        grams = discounted(tables[k - 1])
        contexts = stored(grams.groupBy(before).agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("gamma")), f"contexts{k}")
        rest = F.col("gamma") * F.col("p")
        share = (F.col("n") - F.col("off")) / F.col("total")
        seen = grams.join(contexts, before).join(lower, f"run{k - 1}")
        higher = stored(seen.select(runs, (share + rest).alias("q"), F.log((share + rest) / rest).alias("value")), f"p{k}")
        values.append(higher.select(F.col(runs).alias("key"), "value"))
        values.append(contexts.select(F.col(before).alias("key"), F.log("gamma").alias("value")))
        lower = higher.select(runs, F.col("q").alias("p"))
    table = values[0]
    for more in values[1:]:
        table = table.unionByName(more)
    return Model(table, float(np.log(unknown)), order)


def _asker(order: int):
    """Function that counts the runs of each text."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            data, at = bytes_and_offsets(batch.column("text"))
            ids = [batch.column(c).to_numpy() for c in ("t1", "t2")]
            for low, high in slices(at):
                ends, _, text = _keys(data, at[low : high + 1], powers, order)
                texts, keys = np.tile(text, order), np.concatenate(ends)
                # Runs of beginnings alone are contexts of a first word.
                line, run = 0, []
                for k in range(order - 1):
                    line += int(_BEGIN) * pow(int(_FACTOR), k, 1 << 64)
                    run.append(mix(np.array([(line + k + 1) % (1 << 64)], np.uint64))[0])
                every = np.arange(high - low)
                texts = np.concatenate([texts, np.repeat(every, len(run))])
                keys = np.concatenate([keys, np.tile(np.array(run, np.uint64), len(every))])
                sort = np.lexsort((keys, texts))
                texts, keys = texts[sort], keys[sort]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(keys)))
                of = texts[first] + low
                yield pa.record_batch(
                    [pa.array(ids[0][of]), pa.array(ids[1][of]), _signed(keys[first]), pa.array(n.astype(np.int32))], names=["t1", "t2", "key", "n"]
                )

    return ask


def perplexities(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang, perplexity, text_hash``: perplexity per word (the end counted) of every row's whole text; null for a text without words.

    Equal texts add up to the same quotient, so they need not be told apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = documents.select(
        "doc_id", "lang", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), (word_count(text) + 1).alias("events")
    )
    asked = named.where("events > 1").select("t1", "t2", "text").mapInArrow(_asker(model.order), "t1 long, t2 long, key long, n int")
    sums = asked.join(model.values, "key").groupBy("t1", "t2").agg(F.sum(F.col("n") * F.col("value")).alias("sum"))
    # Copies of a text were each counted.
    copies = named.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    found = copies.join(sums, ["t1", "t2"], "left").select("t1", "t2", (F.coalesce("sum", F.lit(0.0)) / F.col("copies")).alias("sum"))
    log = F.lit(model.unknown) + F.col("sum") / F.col("events")
    return named.drop("text").join(found, ["t1", "t2"]).select(
        "doc_id", "lang", F.when(F.col("events") > 1, F.exp(-log)).alias("perplexity"), F.col("t1").alias("text_hash")
    )


def _held_out(text_hash: Column) -> Column:
    return F.pmod(text_hash, F.lit(HELD_OUT)) == 0


def judged(documents: DataFrame, labels: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST, order: int = ORDER) -> DataFrame:
    """``doc_id, lang, perplexity, low, high, trusted, kept`` for every row of ``documents``.

    Trusted are the documents that any row of ``labels`` gives quality 1. A text that a model
    has seen is likelier to it than any other, so one in ``HELD_OUT`` trusted texts (by hash, so
    copies go together) is not learned from: ``high`` is the upper quantile of these, or of all
    trusted texts where none was held out. ``low`` is the lower quantile of all trusted texts.
    Both are of the document's language, or of all languages where it has none; a null language
    is one of its own. Texts without words are not kept. Without any trusted text there is
    nothing to measure by, and every other text is kept. Repeated rows each have their row; a
    text of any length is read whole.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    known = stored(good.withColumn("trusted", F.lit(True)), "trusted")
    # A bitmap of fixed size settles most rows, so that few texts meet the ids in the exact join.
    texts = probably_in(documents.select("doc_id", "text"), "doc_id", known.select("doc_id")).join(known, "doc_id", "left_semi")
    model = train(texts.where(~_held_out(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))), order)
    scored = stored(perplexities(documents, model), "perplexities").join(known, "doc_id", "left")

    def bounds() -> list[Column]:
        # A sketch of bounded size for each language and set.
        low = F.percentile_approx("perplexity", lowest, 10_000).alias("low")
        new = F.when(_held_out(F.col("text_hash")), F.col("perplexity"))
        return [low, F.percentile_approx(new, highest, 10_000).alias("new"), F.percentile_approx("perplexity", highest, 10_000).alias("old")]

    trusted = scored.where("trusted and perplexity is not null")
    by_lang = trusted.groupBy("lang").agg(*bounds()).withColumnsRenamed({"lang": "_lang"})
    all_ = trusted.agg(*bounds()).first()  # three numbers
    low = F.coalesce("low", F.lit(all_["low"]).cast("double"))
    high = F.coalesce("new", F.lit(all_["new"]).cast("double"), "old", F.lit(all_["old"]).cast("double"))
    judged_ = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return judged_.select(
        "doc_id",
        "lang",
        "perplexity",
        low.alias("low"),
        high.alias("high"),
        F.coalesce("trusted", F.lit(False)).alias("trusted"),
        (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(low, high), F.lit(True))).alias("kept"),
    )
