"""The operators that read texts in Arrow batches, against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bomatlas.llm import components, decontamination, jaccard_join, quality_lm, suffix_dedup, tokens, toxicity
from tests.llm.helpers import CLASHING, awkward, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Words


def test_words_and_shingles():
    texts = ["a b  c", "", None, "A B\tc d e a b c", " x ", "É zé É", "a", "\n"]
    data, at = tokens.bytes_and_offsets(pa.array(texts)[0:])
    words = tokens.words_of(data, at, tokens.Powers())
    assert list(words.counts) == [len(WORD.findall(t or "")) for t in texts]
    names = [w for t in texts for w in WORD.findall(lowered(t))]
    assert len(set(words.hashes.tolist())) == len(set(names))
    for n in (1, 2, 4):
        grams, first = tokens.sets_of(words, n)
        want = []
        for t in texts:
            w = WORD.findall(lowered(t))
            want.append(len({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}) if w else 0)
        assert np.diff(first).tolist() == want


def test_offset_slices_of_a_column():
    column = pa.array(["skip", "one two", None, "three"]).slice(1)
    data, at = tokens.bytes_and_offsets(column)
    assert list(tokens.words_of(data, at, tokens.Powers()).counts) == [2, 0, 1]
    assert list(tokens.slices(np.array([0, 5, 5, 9]), 5)) == [(0, 2), (2, 3)]


# Components


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000, i) for i in range(5001, 5200)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert {r.node: r.component for r in components.components(frame).collect()} == {n: c for n, c in label.items() if n not in alone}
    assert components.components(frame.limit(0)).count() == 0


def test_components_finish_small_graphs_at_once(spark, monkeypatch):
    frame = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 500)], "u long, v long").repartition(16)
    want = {i: 0 for i in range(301)} | {500: 500, 501: 500}
    written, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda rows, name: written.append(name) or stored(rows, name))
    found = lambda: {r.node: r.component for r in components.components(frame).collect()}
    assert found() == want
    assert len(written) == 2  # no round of shuffles
    # More edges than one task may hold are joined in rounds.
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 100)
    assert found() == want
    assert len(written) > 4


# Decontamination


def test_leaks(spark):
    items = [(i, prose(1000 + i, 16 + i).capitalize()) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    rows, want = [], set()
    for i, item in items[:12]:
        words = item.split()
        rows.append(f"{prose(i, 50)} {item.upper()}, {prose(i + 50, 50)}")
        want.add((len(rows) - 1, i))
        for k in (3, 7):  # replace single words
            words[k] = "other"
        rows.append(" ".join(words))
        want.add((len(rows) - 1, i))
        rows.append(prose(i + 99, 20) + " " + " ".join(item.split()[: len(item.split()) // 2]))  # half of it
        rows.append(prose(i + 2000, 60))
    rows += [None, "", " ".join(t for _, t in items[:3]), "É " * 200]
    want |= {(len(rows) - 2, i) for i in range(3)}
    frame = documents(spark, rows, CLASHING)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    found = decontamination.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert all(r.share >= 0.8 and r.matched <= r.item_words for r in found)
    assert decontamination.leaks(empty(spark), bench).count() == 0
    assert decontamination.leaks(frame, bench.limit(0)).count() == 0
    kept = decontamination.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(rows))) - {d for d, _ in want}


def test_leaks_in_awkward_rows(spark):
    bench = spark.createDataFrame([(1, prose(2, 40)), (1, prose(2, 40)), (None, prose(3, 40))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(awkward(spark), bench).collect()}
    assert found == {(8, 1), (9, 1), (None, None)}


def test_leaks_at_exactly_the_share_that_counts(spark):
    """Items of any length with as many words replaced as may be, against brute force."""
    draw = random.Random(5)
    items = [(n, prose(300 + n, n).split()) for n in [*range(1, 31), 100, 400]]
    rows = []
    for n, words in items:
        for extra in (0, 1):  # one more than may be, too
            for evenly in (True, False):
                k = min(n, n // 5 + extra)
                at = [min(n - 1, 5 * j + 4) for j in range(k)] if evenly else draw.sample(range(n), k)
                rows.append(" ".join(["before", *(f"other{i}" if i in at else w for i, w in enumerate(words)), "after"]))
    want = {}
    for doc, text in enumerate(rows):
        there = text.split()
        for n, words in items:
            most = max(sum(0 <= s + i < len(there) and there[s + i] == w for i, w in enumerate(words)) for s in range(-n, len(there)))
            if 5 * most >= 4 * n:
                want[doc, n] = most
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched for r in decontamination.leaks(documents(spark, rows), bench).collect()}
    assert len(want) >= 64 and {k: found.get(k) for k in want} == want


def test_masks_hit_whichever_words_are_replaced():
    """Every pattern of replaced words, one by one, against what the search over states proves."""
    for n in range(1, 18):
        masks = decontamination.masks_for(n, 0.8)
        assert n < 5 or all("0" in m for m in masks)
        needed = decontamination.needed_words(n, 0.8)
        for size in range(needed, n + 1):
            may = min(size - needed, size // 5)
            for gone in itertools.combinations(range(size), may):
                there = [i not in gone for i in range(size)]
                assert any(
                    all(there[s + j] for j, c in enumerate(m) if c == "1") for m in masks for s in range(size - len(m) + 1)
                ), (n, size, gone)
    for masks in decontamination.MASKS:
        fewest = decontamination.least_misses(masks, 11)
        for size in range(12):
            without = (
                k
                for k in range(size + 1)
                for gone in itertools.combinations(range(size), k)
                if not any(all(s + j not in gone for j, c in enumerate(m) if c == "1") for m in masks for s in range(size - len(m) + 1))
            )
            assert next(without) == fewest[size]


@pytest.mark.parametrize("agree, least", [(0.5, 6), (0.9, 12)])
def test_leaks_equal_brute_force(spark, agree, least):
    """Replaced words, shares and least lengths of all kinds: the same pairs as every way to line up gives, no more."""
    draw = random.Random(3)
    items = [(n, [draw.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(n)]) for n in (3, 5, 9, 14, 21, 40)]
    rows = [[w if draw.random() < share else "zz" for w in words] for _, words in items for share in (0.4, 0.6, 0.8, 0.85, 0.95) for _ in range(6)]
    want = {}
    for doc, there in enumerate(rows):
        for n, words in items:
            needed = decontamination.needed_words(n, agree, least)
            most = 0
            for shift in range(-n, len(there)):
                same = [0 <= shift + i < len(there) and there[shift + i] == w for i, w in enumerate(words)]
                for a in range(n):
                    for b in range(a + 1, n + 1):
                        if sum(same[a:b]) >= agree * (b - a) - 1e-9:
                            most = max(most, sum(same[a:b]))
            if most >= needed:
                want[doc, n] = most
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    frame = documents(spark, [" ".join(r) for r in rows])
    found = {(r.doc_id, r.item_id): r.matched for r in decontamination.leaks(frame, bench, agree, least, near_shift=0).collect()}
    assert found == want and len(want) > 20


def test_leaks_without_bounds_on_shifts(spark):
    long = prose(100, 100).split()
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    rows = [" ".join([*long[:50], *(f"new{i}" for i in range(12)), *long[50:]]), " ".join(["same"] * 300)]
    assert [r.matched for r in decontamination.leaks(documents(spark, rows), bench).collect()] == [50]
    free = decontamination.leaks(documents(spark, rows), bench, near_shift=None, window=None)
    assert [(r.doc_id, r.matched) for r in free.collect()] == [(0, 100)]


def test_a_long_item_does_not_lengthen_other_hits(spark, monkeypatch):
    """Rows of hits carry words for the items that were hit, not for the longest of all."""
    items = [(1, prose(1, 20)), (2, prose(2, 4000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, [prose(3, 3000) + " " + items[0][1] + " " + prose(4, 3000)])
    tables, write = {}, decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda table, name: tables.setdefault(name, write(table, name)))
    pairs = decontamination.leaks(frame, bench).collect()
    assert [(r.item_id, r.matched, r.start_word) for r in pairs] == [(1, 20, 3000)]
    assert tables["hits"].selectExpr("max(size(words))").first()[0] <= 120


def test_leaks_of_parts_and_shifted_words(spark):
    bench = spark.createDataFrame([(n, prose(n, n)) for n in (20, 100)], "item_id long, text string")
    short, long = prose(20, 20).split(), prose(100, 100).split()
    rows = [
        [*"a b c".split(), *long[20:70], *"d e".split()],  # half, word for word
        [*long[:50], "inserted", *long[50:]],
        [*long[:50], *long[51:]],
        [*short[:10], "inserted", *short[10:]],
        ["x", *short[:9], *short[10:]],
        [*short[:6], "one", *short[6:12], "two", *short[12:]],
        long[30:46],
        long[30:45],  # too little
        [*short[:8], *"a b c d e f g".split(), *short[8:]],  # too much between
        [w if i % 3 else "other" for i, w in enumerate(long)],
    ]
    found = {(r.doc_id, r.item_id): (r.matched, r.start_word) for r in decontamination.leaks(documents(spark, [" ".join(r) for r in rows]), bench).collect()}
    assert found == {(0, 100): (50, 3), (1, 100): (100, 0), (2, 100): (99, 0), (3, 20): (20, 0), (4, 20): (19, 1), (5, 20): (20, 0), (6, 100): (16, 0)}


def test_only_leaking_rows_of_an_id_go(spark):
    item = prose(1, 40)
    rows = [(None, prose(2, 50), "en", "s", 0), (None, item, "en", "s", 0), (7, item, "en", "s", 0), (7, prose(3, 50), "en", "s", 0), (7, None, "en", "s", 0)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontamination.clean(documents(spark, rows, CLASHING), bench)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(r[0]), str(r[1])) for r in rows if r[1] != item)


# Quality model


def padded(text, order):
    """Beginnings, lower-cased words, an end."""
    return ["<s>"] * (order - 1) + WORD.findall(lowered(text)) + ["</s>"]


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney straight from its definition, on dictionaries of words."""
    lines = [padded(t, order) for t in texts]
    counts = {order: Counter(tuple(w[i : i + order]) for w in lines for i in range(len(w) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        raw = [k - (k + 1) * y * up / own if own else 0.0 for k, own, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off[n] = [min(max(d, quality_lm.LEAST_DISCOUNT), k) for k, d in enumerate(raw, 1)]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        back = sum(off[n][min(c, 3) - 1] for c in same.values()) / total
        c = same.get(gram, 0)
        return max(c - (off[n][min(c, 3) - 1] if c else 0), 0) / total + back * p(gram[1:])

    return p, {g[0] for g in counts[1]}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_the_definition(spark, order):
    texts = ["the cat sat on the mat", "The cat ran", "", None, "a dog sat on a mat on a mat", "the the the", "Été  là\u2003bas", "the cat sat"]
    model = quality_lm.train(documents(spark, texts).repartition(3), order)
    p, known = kneser_ney(texts, order)
    judged = ["the cat sat on a mat", "zzz", "the the zzz cat", "THE cat sat on a mat", "mat", "", None, "  ", "the cat sat on a mat"]
    rows = quality_lm.perplexities(documents(spark, judged), model).collect()
    assert len(rows) == len(judged)
    for row in rows:
        words = padded(judged[row.doc_id], order)
        if len(words) == order:
            assert row.perplexity is None
            continue
        logs = [math.log(p(tuple(words[i : i + order]))) for i in range(len(words) - order + 1)]
        assert row.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9)
    # Every context's probabilities add up to one: the known words, the end, and one for all others.
    for context in (("the",), ("on", "a"), ("zzz", "cat"), ("<s>",) * (order - 1)):
        context = context[-(order - 1) :] if order > 1 else ()
        assert sum(p((*context, w)) for w in [*known, "unseen"]) == pytest.approx(1)


def test_model_grows_and_is_flushed_in_parts(spark, monkeypatch):
    """What is gathered has a row for each distinct run, whatever leaves a task at once."""
    texts = [prose(i, 30) for i in range(40)]
    pairs = {tuple(w[i : i + 2]) for t in texts for w in [padded(t, 2)] for i in range(len(w) - 1)}
    words = {w for t in texts for w in padded(t, 1)}
    rows = lambda: sorted((r.key, round(r.value, 9)) for r in quality_lm.train(documents(spark, texts)).values.collect())
    whole = rows()
    # A value for each word and pair, and one for each context: all words but the end, and the beginning.
    assert len(whole) == len(pairs) + len(words) + len(words)
    monkeypatch.setattr(quality_lm, "FLUSH", 50)
    assert rows() == whole


def test_word_order_matters(spark):
    """Shuffled words of a good text are less likely than the text."""
    draw = random.Random(4)
    lines = ["the cat sat on the mat and then it slept", "a dog ran in the park and then it barked at the cat"]
    good = [" ".join(draw.choice(lines) for _ in range(6)) + f" {i}" for i in range(240)]
    mixed = [" ".join(draw.sample(t.split(), len(t.split()))) for t in good[200:]]
    frame = documents(spark, good + mixed)
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_lm.judged(frame, labels).collect()}
    assert sum(kept[i] for i in range(200, 240)) >= 34 and not any(kept[i] for i in range(240, 280))


def test_quality(spark):
    good = [(i, prose(i, 60).capitalize() + ".", "en" if i % 2 else None, "s", None) for i in range(200)]
    noise = random.Random(1)
    bad = [(1000 + i, "".join(noise.choice("#$%&*|@~^!") for _ in range(300)), "en", "s", None) for i in range(20)]
    other = [(2000, prose(9999, 60), "xx", "s", None), (2001, None, "en", "s", None), (None, "", None, None, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(5, 0), (5, 1), (None, 1), (1000, 0)], "doc_id long, quality int")
    frame = documents(spark, good + bad + other, [c for c in CLASHING if c != "kept"])
    out = {r.doc_id: r for r in quality_lm.judged(frame, labels).collect()}
    assert len(out) == 223 and not any(out[i].kept for i in range(1000, 1020))
    assert sum(out[i].kept for i in range(200)) >= 185
    # A language without trusted texts is measured by all of them: no set of its own has that upper bound.
    assert out[2000].low < out[2000].perplexity < 1.2 * out[2000].high and out[2000].high == max(r.high for r in out.values())
    assert not out[2001].kept and not out[None].kept
    untrained = quality_lm.judged(frame, labels.limit(0))
    assert untrained.where("kept").count() == 221
    assert quality_lm.judged(empty(spark), labels).count() == 0


# Jaccard join


def groups_by_hand(rows, words, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(lowered(text))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted(((doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=str)


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("words, percent, part", [(4, 85, 4096), (5, 80, 8)])
def test_groups(spark, monkeypatch, words, percent, part):
    monkeypatch.setattr(jaccard_join, "LIST_PART", part)  # 8: long lists are cut
    monkeypatch.setattr(jaccard_join, "GROUP_GRAMS", 1 << 21 if part > 8 else 500)  # 500: fragments are cut finer
    draw = random.Random(words)
    base = prose(7, 150).split()
    texts = [edited(base, draw, draw.randrange(6)) for _ in range(60)]  # around the threshold
    shared = prose(8, 60)
    texts += [f"{prose(100 + i, 60)} {shared}" for i in range(20)]
    texts += [prose(300 + i % 5, 80 + i) for i in range(20)]  # each holds the ones before
    texts += ["one two", "ONE  two", "one", "", None, " \t", prose(9, 5000), prose(9, 5000) + " more"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (7, texts[70])]
    draw.shuffle(rows)
    frame = documents(spark, [(i, t, "en", "s", None) for i, t in rows], CLASHING).repartition(3)
    assert sorted(map(tuple, jaccard_join.near_groups(frame, words, percent).collect()), key=str) == groups_by_hand(rows, words, percent)


def test_groups_of_awkward_rows(spark):
    frame = awkward(spark)
    out = jaccard_join.near_groups(frame)
    assert sorted(map(tuple, out.collect()), key=str) == groups_by_hand([(r.doc_id, r.text) for r in frame.collect()], 4, 85)
    assert jaccard_join.near_groups(empty(spark)).count() == 0
    left = jaccard_join.one_of_each(frame, 4, 85)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {None, 1, 2, 3, 4, 5, 8, 10}


# Suffix dedup


def spans_by_hand(rows):
    """Each 100-byte string looked up among all that start earlier."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw, gone = (text or "").encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        out.append((doc, len(raw), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, part", [(2_000, 1 << 20), (1, 700)])
def test_repeats(spark, monkeypatch, hot, part):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTENTS", hot)
    monkeypatch.setattr(suffix_dedup, "PART", part)  # 700: long texts come in parts
    draw = random.Random(hot)
    passages = [prose(400 + i, n) for i, n in enumerate((15, 30, 60, 13))]
    texts = []
    for i in range(60):
        texts.append(" ".join(draw.choice([prose(draw.randrange(10**6), draw.randrange(25)), draw.choice(passages), passages[0][: draw.randrange(len(passages[0]))]]) for _ in range(4)))
    texts += [texts[5], "ab" * 300, "ab" * 130, "x" * 99, "x" * 100, "x" * 101, "", None, "é" * 200, "\0" * 150 + "a", "\0" * 150, "a" + "\0" * 120, prose(77, 2000), "b" + prose(77, 2000)]
    rows = list(enumerate(texts))
    frame = documents(spark, [(i, t, "en", "s", None) for i, t in rows], CLASHING).repartition(5)
    out = suffix_dedup.without_repeats(frame)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect())
    assert got == spans_by_hand(rows)


def test_repeats_in_awkward_rows(spark):
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(awkward(spark)).collect()), key=str)
    by_id = defaultdict(list)
    for doc, n, gone in out:
        by_id[doc].append((n, gone))
    assert len(out) == 13 and by_id[3] == [(3, 0), (3, 0)]
    size = len(prose(1, 9000))
    assert by_id[5] == by_id[6] == [(size, 0)] and by_id[7] == [(size + 5, size)]
    assert by_id[8] == [(len(prose(2, 40)), 0)] and by_id[9] == [(len(prose(2, 40)),) * 2]
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


# Toxicity


def test_toxicity_learns_and_holds_out(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = prose(i, draw.randrange(20, 80)).split()
        for _ in range(3 if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["vile", "nasty", "Foul,"]))
        rows.append(" ".join(words))
        labels.append((i, int(bad)))
    frame = documents(spark, rows, [c for c in CLASHING if c != "score"])
    truth = dict(labels)
    out = toxicity.judged(frame, spark.createDataFrame([*labels, (None, 1), (0, None), (10**6, 1)], "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 900 and 200 < len(held) < 400
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_toxicity_without_labels_and_of_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.judged(awkward(spark), labels).collect()
    assert len(out) == 13 and {r.score for r in out} == {0.5}
    assert toxicity.judged(empty(spark), labels).count() == 0
    scored = toxicity.score(awkward(spark), np.empty(0, np.int32), np.empty(0))
    assert set(scored.columns) == set(awkward(spark).columns)


def test_scores_see_no_other_column(spark):
    rows = [(i, "vile text" if i % 2 else "plain text", "en", "s", None) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    slots, weights = toxicity.train(documents(spark, rows), labels)
    other = [(i + 7, "vile text", lang, source, i) for i, (lang, source) in enumerate([("de", "a"), (None, None), ("en", "s")])]
    scores = {r.score for r in toxicity.score(documents(spark, other), slots, weights).collect()}
    assert len(scores) == 1 and scores.pop() > 0.7
