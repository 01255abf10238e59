"""Exact dedup, chat trees, source mixing, licence scan and URL rules on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bomatlas.llm import chat_trees, chunk_dedup, licence_scan, source_mix, url_rules
from bomatlas.llm.common import without_ids
from tests.llm.helpers import CLASHING, awkward, documents, empty, prose


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Exact dedup


def copies_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r.text), []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[lowered(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(lowered(r.text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_copies(spark):
    frame = awkward(spark)
    assert sorted(map(tuple, chunk_dedup.exact_copies(frame).collect()), key=str) == copies_by_hand(frame.collect())
    assert chunk_dedup.exact_copies(empty(spark)).count() == 0


def test_copies_when_fingerprints_clash(spark, monkeypatch):
    """With one fingerprint for all chunks of a length, the identifiers must still tell texts apart."""
    monkeypatch.setattr(chunk_dedup, "_fingerprint", lambda chunk: F.char_length(chunk).cast("long"))
    rows = ["aaaa", "AAAA", "bbbb", "cc", "cc", "dd", "bbbb"]
    frame = documents(spark, rows)
    assert sorted(map(tuple, chunk_dedup.exact_copies(frame).collect()), key=str) == copies_by_hand(frame.collect())


def test_chunks_put_together_are_the_text(spark):
    texts = ["", "x", "a" * 20_000, prose(4, 3000).replace(" ", ". "), "l\n" * 5000, "é" * 9000 + "\n" + "ß" * 10]
    pieces = documents(spark, texts).select("text", F.regexp_extract_all("text", F.lit(chunk_dedup.CHUNK), F.lit(0)).alias("c")).collect()
    for row in pieces:
        assert "".join(row.c) == row.text
        assert all(len(c) <= chunk_dedup.LONGEST + 2 for c in row.c)


def test_deduplicated_keeps_columns_and_one_row(spark):
    frame = awkward(spark)
    out = chunk_dedup.deduplicated(frame)
    assert out.columns == frame.columns
    kept = {(r.doc_id, lowered(r.text)) for r in out.collect()}
    assert len(kept) == out.count() == len({lowered(r.text) for r in frame.collect()})
    assert (6, lowered(prose(1, 9000))) in kept and (9, prose(2, 40)) in kept


def test_without_ids(spark):
    frame = awkward(spark)
    gone = spark.createDataFrame([(3,), (None,)], "x long")
    out = without_ids(frame, gone)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert without_ids(frame, gone.limit(0)).count() == frame.count()


# Chat trees

MESSAGE = "tree_id long, message_id long, parent_id long, role string, text string, score double"


def paths_by_hand(rows, paths):
    """Every root-to-leaf path by walking up from each leaf, ranked."""
    out = {}
    trees = {}
    for r in rows:
        trees.setdefault(r[0], {})[r[1]] = r
    for tree, nodes in trees.items():
        parent = {n: (r[2] if r[2] in nodes and r[2] != n else None) for n, r in nodes.items()}
        found = []
        for leaf in set(nodes) - {p for p in parent.values() if p is not None}:
            path, at = [], leaf
            while at is not None and at not in path:
                path.insert(0, at)
                at = parent[at]
            if at is None:
                mean = sum(nodes[n][5] or 0.0 for n in path) / len(path)
                found.append((-round(mean, 9), -len(path), leaf, path))
        for rank, (_, _, _, path) in enumerate(sorted(found)[:paths], 1):
            out[tree, rank] = [(nodes[n][3] or "", nodes[n][4] or "") for n in path]
    return out


@pytest.mark.parametrize("paths", [1, 3])
def test_trees_against_a_walk(spark, paths):
    draw = random.Random(5)
    rows = []
    for tree in range(12):
        for node in range(draw.randrange(1, 30)):
            parent = draw.randrange(node) if node and draw.random() > 0.05 else draw.choice([None, 999, node])
            rows.append((tree, node, parent, draw.choice(["user", "assistant", None]), draw.choice([None, "", "<|im_end|>", "a<||b", prose(node, 3)]), draw.choice([None, 0.25, 0.5, 1.0])))
    rows.append((None, 0, None, "user", "null tree", 0.0))
    rows += [(50, i, i - 1, "user", str(i), 0.0) for i in range(1, 70)]  # a long branch
    rows += [(60, 1, 2, "user", "circle", 0.0), (60, 2, 1, "user", "circle", 0.0), (60, 3, 2, "user", "under a circle", 0.0)]
    out = chat_trees.format_trees(spark.createDataFrame(rows, MESSAGE), paths)
    got = {(r.tree_id, r.path_rank): [(t.role, t.text) for t in r.turns] for r in out.withColumn("turns", chat_trees.read_back(F.col("formatted"))).collect()}
    assert got == paths_by_hand(rows, paths)


def test_control_strings_come_back(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<", "<|", "<||", "<|||x<|", "a\nb\n", "", "<|n|>", "\\<|", "|<|im_end|>\n"]
    rows = [(1, i, i - 1, "assistant" if i % 2 else "us\ner<|n|>", t, 0.0) for i, t in enumerate(nasty)]
    out = chat_trees.format_trees(spark.createDataFrame(rows, MESSAGE)).withColumn("turns", chat_trees.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.turns] == [(r[3], r[4]) for r in rows]
    assert out.formatted.count(chat_trees.START) == out.n_turns == len(rows)
    learned = [s.text for s in out.segments if s.loss]
    assert [re.sub(r"<\|(\|+)", r"<\1", t) for t in learned] == nasty[1::2]


def test_no_messages(spark):
    assert chat_trees.format_trees(spark.createDataFrame([], MESSAGE)).count() == 0


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, "user", "hi", 0.0)] * 2 + [(1, 2, 1, "assistant", "b", 0.0), (1, 2, 1, "assistant", "a", 0.0), (1, None, 1, "user", "no id", 0.0)]
    out = chat_trees.format_trees(spark.createDataFrame(rows, MESSAGE)).first()
    assert out.n_turns == 2 and "a" in out.formatted


# Source mix


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the limit and share the rest again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in full]
        left = total - sum(full.values())
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] >= most * sizes[n]]
        if not over:
            return full | share
        full |= {n: float(most * sizes[n]) for n in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    rows = [(i, prose(i, draw.choice([0, 1, 5, 200])), "en", draw.choice(["a", "B", "é", "z", "zz", None, "hot", "hot", "hot"]), None) for i in range(120)]
    out = source_mix.mixed(documents(spark, rows)).collect()
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets_by_hand(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == round(want[s]) for s in sizes)
    assert sorted(out, key=str) == sorted(source_mix.mixed(documents(spark, rows[::-1])).collect(), key=str)


def test_mix_of_awkward_rows(spark):
    frame = awkward(spark)
    out = source_mix.mixed(frame)
    assert out.count() == frame.count() and source_mix.mixed(empty(spark)).count() == 0
    used = source_mix.mixture(frame)
    assert used.columns == [c for c in frame.columns if c not in ("epoch", "words")] + ["epoch", "words"]
    assert used.agg(F.sum("words")).first()[0] == out.agg(F.sum("taken")).first()[0]
    words = re.compile(r"[^\x20\x09-\x0D]+")
    texts = {(r.doc_id, r.source): r.text for r in frame.collect()}
    for r in used.collect():
        assert len(words.findall(r.text)) == r.words and texts[r.doc_id, r.source].startswith(r.text)


# Licence scan


def test_licences(spark):
    rows = [prose(i, 30) + "\n" + prose(i + 500, 12) for i in range(60)]
    rows += [
        prose(70, 20) + "\nReleased under the MIT License.\n" + prose(71, 9000),
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: GPL-3.0",
        "Licensed under our terms of use.",
        "A driving licence is needed to drive.",
        None,
        "",
        "THIS WORK IS LICENSED UNDER THE GNU AFFERO GENERAL PUBLIC LICENSE, VERSION 3",
    ]
    frame = documents(spark, rows, CLASHING)
    out = {r.doc_id: r for r in licence_scan.scan(frame).collect()}
    assert len(out) == len(rows) and all(out[i].family == "unknown" and not out[i].notices for i in [*range(60), 63, 64, 65, 66])
    assert [out[i].family for i in (60, 61, 67)] == ["MIT", "Apache", "AGPL"]
    assert out[60].notices[0].paragraph == 1 and {n.family for n in out[62].notices} == {"CC-BY-NC", "GPL"}


def test_licence_identifiers_and_texts(spark):
    wrapped = (
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\n'
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
        "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    )
    bsd = (
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    )
    isc = (
        "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n"
        "# copyright notice and this permission notice appear in all copies."
    )
    known = [
        ("MIT", 0, "SPDX-License-Identifier: MIT"),
        ("ISC", 0, "SPDX-License-Identifier: ISC"),
        ("BSD", 0, "// SPDX-License-Identifier: BSD-2-Clause"),
        ("MIT", 0, "The MIT License (MIT)"),
        ("MIT", 0, "MIT License"),
        ("MPL", 0, "Mozilla Public License Version 2.0"),
        ("BSD", 0, "Use of this source code is governed by a BSD-style license that can be"),
        ("MIT", 2, f"{prose(1, 30)}\n\n{wrapped}\n\n{prose(2, 30)}"),
        ("BSD", 2, f"{prose(3, 30)}\n *\n{bsd}\n *\n{prose(4, 30)}"),
        ("ISC", 0, isc),
    ]
    other = ["Permission is hereby granted to park here, subject to the following conditions:", "He drove mit dem Auto", "The house is free software\nof a kind"]
    frame = documents(spark, [t for _, _, t in known] + [prose(i, 30) for i in range(60)] + other, CLASHING)
    out = {r.doc_id: r for r in licence_scan.scan(frame).collect()}
    assert [(out[i].family, out[i].notices[0].paragraph if out[i].notices else None) for i in range(len(known))] == [k[:2] for k in known]
    assert all(len(out[i].notices) == 1 for i in range(len(known)))
    assert all(out[i].family == "unknown" for i in range(len(known), frame.count()))


def test_licence_shortcut_is_exact(spark, monkeypatch):
    """Scoring every paragraph gives the same answer as scoring those with a needed n-gram."""
    rows = [prose(i, 30) + "\nunder the licence of the public domain\nby nc 4 0" for i in range(30)]
    rows += [p.format(n) for p in licence_scan.PHRASES[:4] for f in ("MIT", "GPL", "BSD") for n in licence_scan.NAMES[f]]
    frame = documents(spark, rows)
    classifier = licence_scan.train(frame)
    some = sorted(map(str, licence_scan.scan(frame, classifier).collect()))
    monkeypatch.setattr(licence_scan.Classifier, "needed", lambda self: [])
    assert some == sorted(map(str, licence_scan.scan(frame, classifier).collect()))


def test_licences_of_nothing(spark):
    frame = awkward(spark)
    assert licence_scan.scan(frame).count() == frame.count()
    assert licence_scan.scan(empty(spark)).count() == 0


# URL rules

SITES = [url_rules.site_rule(r, a) for r, a in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]


def judge_by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lowered(m[1]), m[2]) if m else ("", "")
    best = None
    for r in SITES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    spam = any(re.search(r.pattern, host + path) for r in url_rules.PATTERN_RULES)
    return host, path, best and best.name, best.action if best else "block" if spam else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://NET/x", "http://a.net", "http://a.net/", "http://net.example.com/de/", "x://EXAMPLE.net/en/a?b://c#d", "http://example.net/enx", "http://myexample.net/en/", "http://s.org/fr/", "http://s.org/FR/", "http://casino.example.org/fr/", "http://a.com/Casino-Win/x", "http://a.com/casinos", "https://example.com/de/?x", "http://a.com://b.net/", "http://a.net:80/x"]
    draw = random.Random(2)
    urls += [f"http://{draw.choice(['', 'm.', 'a.b.'])}{draw.choice(['example', 'poker', 'x'])}.{draw.choice(['net', 'com', 'org', 'ORG'])}{draw.choice(['', '/', '/en/', '/de/', '/fr/', '/en', '/porn.html'])}" for _ in range(200)]
    schema = "page_id long, url string, _subject string, host string, verdict string"
    pages = spark.createDataFrame([(i, u, "keep", "old", "old") for i, u in enumerate(urls)], schema)
    out = url_rules.filter_urls(pages, url_rules.rule_table(spark, [*SITES, *url_rules.PATTERN_RULES])).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: judge_by_hand(u) for i, u in enumerate(urls)}
    assert len(out) == len(urls) and all(r["_subject"] == "keep" for r in out)
    none = url_rules.filter_urls(pages.limit(0), url_rules.rule_table(spark, SITES))
    assert none.count() == 0


def test_rule_without_a_literal_token_is_found(spark):
    rules = url_rules.rule_table(spark, [url_rules.Rule("digits", r"\d{4}", "block"), url_rules.Rule("rare", "(?:^|/)zeta/", "block", ["zeta"])])
    pages = spark.createDataFrame([(1, "http://a.b/2024"), (2, "http://a.b/c"), (3, "http://a.b/zeta/")], "page_id long, url string")
    assert {r.page_id: r.pattern for r in url_rules.filter_urls(pages, rules).collect()} == {1: "digits", 2: None, 3: "rare"}


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("net",)] * 5 + [("example",)] * 3 + [("en",)] * 2, "token string")
    filed = {r.name: r.token for r in url_rules.indexed(url_rules.rule_table(spark, SITES), tokens).collect()}
    assert filed["example.net/en/"] == "en" and filed["net/"] == "net" and filed["example.com/de/"] in ("com", "de")
