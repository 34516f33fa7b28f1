"""Quality rules, decontamination and licences against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkwell.llm import decontaminate as D
from sparkwell.llm import license_scan as LS
from sparkwell.llm import quality_rules as Q

from .conftest import WORDS, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    n, seen, dup = len(w), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    cover = np.zeros(n, bool)
    for i, x in enumerate(windows):
        if often[x] > 1:
            cover[i : i + 3] = True
    repeat = int(cover.sum())
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, n < 50 or 100 * repeat > 50 * n


def texts():
    r = random.Random(13)
    out = [sentence(r, r.randrange(0, 120)) for _ in range(20)]
    out += ["a b c a b c a b c", "x\nx\n\n x\nx", "a a a a", "a a", "# $ | <>", "  no break   é", " ".join(["spam eggs ham"] * 40), "one\ttwo\x0bthree\x0cfour\rfive"]
    return out


def test_counts(spark, odd_docs):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r[0]: tuple(r)[1:] for r in Q.base_counts(df).select("doc_id", *columns).collect()}
    assert got == {i: counts(t) for i, t in rows}
    odd = Q.base_counts(odd_docs.select("doc_id", "text")).select("text", *columns).collect()
    assert all(tuple(r)[1:] == counts(r["text"]) for r in odd)


def test_ratio_matches_plain_python(spark):
    r = random.Random(14)
    good = [" ".join(r.choice(WORDS) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(r.choice(WORDS) + "%%%" for _ in range(80)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(65, 80)], "doc_id long, quality int")
    trusted, others = Q.labelled_ids(labels, 1000)
    assert {r["doc_id"] for r in others.collect()}.isdisjoint(r["doc_id"] for r in trusted.collect())
    weights = {r["bucket"]: r["weight"] for r in Q.gram_weights(df, trusted).collect()}
    assert len(weights) == Q.N_BUCKETS
    rows = {r["doc_id"]: r for r in Q.quality(df, labels).collect()}
    assert sorted(i for i in rows if rows[i]["kept"]) == list(range(60))
    buckets = Q._grams(Q.base_counts(df), "doc_id").collect()
    for i in (0, 70):
        b = [x for r in buckets if r["doc_id"] == i for x in (r["b1"], r["b2"]) if x is not None]
        assert rows[i]["score"] == int(sum(weights[x] for x in b) / len(b))


def plain_quality(docs, trusted, held):
    """Verdicts from the definitions alone: buckets, ratios, scores, threshold."""

    def grams(text):
        w = [x.encode() for x in WORD.findall(text or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [h % Q.N_BUCKETS for h in one] + [xxhash.xxh64_intdigest(x, h) % Q.N_BUCKETS for h, x in zip(one, w[1:])]

    raw, good = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        good.update(grams(t) if i in trusted else [])
    n_raw, n_good = raw.total() + Q.N_BUCKETS, good.total() + Q.N_BUCKETS
    weight = lambda b: round((np.log((good[b] + 1) / n_good) - np.log((raw[b] + 1) / n_raw)) * Q.MICRO)
    scores = {}
    for i, t in docs:
        g = grams(t)
        scores[i] = int(sum(map(weight, g)) / len(g)) if g else 0
    cut = Q.best_threshold([(scores[i], held[i]) for i, t in docs if i in held and not counts(t)[5]])
    return {i: (scores[i], not counts(t)[5] and scores[i] >= cut) for i, t in docs}


def test_verdicts_match_brute_force(spark):
    r = random.Random(15)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    ours, theirs = [word(4) for _ in range(60)], [word(5) for _ in range(60)]
    # the share of raw words runs from none to all, so that scores lie on both sides of the threshold
    mixed = [" ".join(r.choice(theirs if r.random() < i / 120 else ours) for _ in range(r.randrange(40, 200))) for i in range(120)]
    docs = list(enumerate([*mixed, *texts(), None]))
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    trusted, others = Q.labelled_ids(labels, 1000)
    want = plain_quality(docs, {x["doc_id"] for x in trusted.collect()}, {x["doc_id"]: x["good"] for x in others.collect()})
    got = {x["doc_id"]: (x["score"], x["kept"]) for x in Q.quality(df, labels).collect()}
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}
    assert all(abs(got[i][0] - want[i][0]) <= 1 for i in want)
    assert 20 < sum(v[1] for v in got.values()) < 100


def test_threshold():
    assert Q.best_threshold([]) == Q.THRESHOLD and Q.best_threshold([(5, True)]) == Q.THRESHOLD
    assert Q.best_threshold([(0, False), (2, False), (10, True), (11, True)]) == 6
    assert Q.best_threshold([(0, False), (1, True), (2, False), (20, True), (21, True)]) == 11
    assert Q.best_threshold([(3, True), (3, False)]) == Q.THRESHOLD


def test_quality_odd_rows(odd_docs, no_docs, no_labels):
    got = Q.quality(odd_docs, no_labels).collect()
    assert len(got) == odd_docs.count() and all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] != 3)
    assert Q.quality(no_docs, no_labels).count() == 0


def plain_leaks(docs, items):
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, t in items:
            v = (t or "").lower().split()
            b, best = Counter(shingles(v)), None
            if not b:
                continue
            for s in range(max(0, len(w) - len(v)) + 1):
                a = Counter(shingles(w[s : s + len(v)]))
                both = sum((a & b).values())
                size = sum(a.values()) + sum(b.values()) - both
                if both / size >= 0.8 and (best is None or both / size > best[0] + 1e-12):
                    best = both / size, s
            if best:
                out[d, i] = best
    return out


@pytest.mark.parametrize("most_sent", [D.MOST_SENT, 0])
def test_leaks_match_brute_force(spark, monkeypatch, most_sent):
    monkeypatch.setattr(D, "MOST_SENT", most_sent)
    r = random.Random(15)
    items = [(i, sentence(r, r.choice([5, 20, 40, 300]))) for i in range(12)] + [(50, "too short"), (51, None), (52, " ".join(["ha ha ho"] * 12))]
    docs = []
    for i in range(60):
        w = sentence(r, r.randrange(0, 80)).split()
        if i % 2:
            p = r.choice(items[:12] + items[-1:])[1].split()
            for _ in range(r.randrange(0, 3)):
                p[r.choice([0, len(p) // 2, len(p) - 1])] = "other"
            if r.random() < 0.3:
                p = p[: int(len(p) * 0.9)]
            k = r.randrange(len(w) + 1)
            w = w[:k] + p + w[k:]
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["window_start"]) for r in D.leaks(df, bench).collect()}
    want = plain_leaks(docs, items)
    assert got.keys() == want.keys() and len(want) > 5
    for k in want:
        assert got[k] == (pytest.approx(want[k][0]), want[k][1])
    kept = {r["doc_id"] for r in D.clean(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {d for d, _ in want}


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "no id but some words to read here"), (2, None), (3, "same row twice with a few words"), (3, "same row twice with a few words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in D.leaks(odd_docs, bench).collect()}
    assert got == {(None, 1, 1.0), (4, 3, 1.0)} and D.leaks(odd_docs, bench).count() == 2
    assert D.clean(odd_docs, bench).count() == odd_docs.count() - 3
    assert D.leaks(no_docs, bench).count() == 0 and D.leaks(odd_docs, bench.limit(0)).count() == 0
    assert D.clean(odd_docs, bench.limit(0)).columns == odd_docs.columns


def test_clean_keeps_other_texts_under_an_id(spark):
    r = random.Random(22)
    item, texts = sentence(r, 30), [sentence(r, 60) for _ in range(6)]
    rows = [(None, texts[0]), (None, f"{texts[1]} {item}"), (None, None), (4, f"{item} {texts[2]}"), (4, texts[3]), (5, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {tuple(x) for x in D.clean(df, bench).collect()} == {rows[0], rows[2], rows[4], rows[5]}
    assert {(x["doc_id"], x["item_id"]) for x in D.leaks(df, bench).collect()} == {(None, 1), (4, 1)}


def test_items_as_long_as_books(spark):
    book = " ".join(f"w{i}" for i in range(70_000))
    bench = spark.createDataFrame([(1, book), (2, "one item of six short words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"two more {book}"), (2, "nothing of it is in here"), (3, "and one item of six short words")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"], r["window_start"]) for r in D.leaks(docs, bench).collect()}
    assert got == {(1, 1, 1.0, 2), (3, 2, 1.0, 1)}
    assert [r["doc_id"] for r in D.clean(docs, bench).collect()] == [2]


def test_every_block_pair_within_the_radius_is_found():
    near = set(D._near_values())
    r = random.Random(16)
    for _ in range(2000):
        bits = r.sample(range(64), r.randrange(0, D.RADIUS + 1))
        x = sum(1 << b for b in bits)
        assert any((x >> (D.BLOCK_BITS * i) & ((1 << D.BLOCK_BITS) - 1)) in near for i in range(D.BLOCKS))


def test_licences(spark):
    filler = sentence(random.Random(17), 30)
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/one.txt", filler),
        (3, "a/b/COPYING.md", f"{filler}\nLicensed under the Apache License, Version 2.0.\n{filler}"),
        (4, "a/b/c/d/two.txt", filler),
        (5, "a/x/three.txt", f"{filler}\nSPDX-License-Identifier: GPL-3.0-only"),
        (6, "z/four.txt", filler),
        (7, "root.txt", None),
        (8, None, "All rights reserved."),
        (9, "z/LICENSE", "Permission to speak of many things without a notice"),
        (10, "a/b/one.txt", ""),
    ]
    df = spark.createDataFrame(files, "file_id long, path string, text string").withColumn("licence", LS.F.lit("clash"))
    got = {r["file_id"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in LS.licences(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b"), 5: ("GPL-3.0", "GPL-3.0", None),
        6: (None, None, None), 7: (None, None, None), 8: ("proprietary", "proprietary", None), 9: (None, None, None), 10: (None, "Apache-2.0", "a/b"),
    }
    root = df.union(df.sparkSession.createDataFrame([(20, "LICENSE", "Licensed under CC BY-NC 4.0.", "clash")], df.schema))
    assert {r["file_id"]: r["licence"] for r in LS.licences(root).collect()}[6] == "CC-BY-NC-4.0"
    assert LS.licences(df.limit(0)).count() == 0


def plain_words(text):
    words = (re.sub(r"^[.+-]+|[.+-]+$", "", w) for w in re.split(r"[^a-z0-9.+-]+", text.lower()))
    return [w for w in words if w]


def test_licence_words(spark):
    r = random.Random(18)
    texts = ["".join(r.choice("ab1.+- ,\n*") for _ in range(r.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("t", LS._tokens(LS.F.col("t")).alias("w"))
    assert all(r["w"] == plain_words(r["t"]) for r in df.collect())


def own(spark, texts, path="a/x.py", corpus=200):
    """Own licences of texts among files of words that all of them share."""
    r = random.Random(20)
    rows = [(i, path, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, "b/y.txt", f"{sentence(r, 30)}\nThis file is part of the project, see the module and this is of the") for i in range(corpus)]
    got = {x["file_id"]: x["own_licence"] for x in LS.licences(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert all(got[i] is None for i in got if i >= 1000)
    return [got[i] for i in range(len(texts))]


def plain_own(texts, templates, threshold):
    """Own licences and similarities by the cosine of every part with every template."""
    df = Counter(w for t in texts for w in set(plain_words(t)))
    idf = lambda w: np.log((len(texts) + 1) / (df[w] + 1)) + 1

    def vector(words):
        v = {w: c * idf(w) for w, c in Counter(words).items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    notices = [(name, vector(plain_words(t))) for name, t in templates]
    most = 2 * max(len(t.split()) for _, t in templates)
    out = {}
    for k, text in enumerate(texts):
        found = []
        for block in re.split(LS.BREAK, text.lower()):
            lines = [w for w in map(plain_words, block.split("\n")) if w]
            for i in range(len(lines)):
                for j in range(i + 1, len(lines) + 1):
                    part = [w for line in lines[i:j] for w in line]
                    if len(part) > most and j > i + 1 and j - i < len(lines):
                        continue
                    v = vector(part)
                    found += [(-round(sum(x * t.get(w, 0) for w, x in v.items()), 9), name) for name, t in notices]
        if found and min(found)[0] <= -threshold:
            out[k] = min(found)
    return out


def test_licence_cosines_match_brute_force(spark):
    r = random.Random(22)

    def text():
        words = r.choice(LS.TEMPLATES)[1].split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice([*WORDS, "the", "license", "GNU"])
        notice = "".join(w + r.choice([" ", " ", " ", " ", "\n# "]) for w in words)
        return "\n".join([sentence(r, r.randrange(8)), r.choice(["", sentence(r, 4)]), notice, r.choice(["", "--", sentence(r, 3)]), sentence(r, 20)])

    texts = [text() for _ in range(150)] + ["", "\n\n", LS.TEMPLATES[3][1] + "\n" + LS.TEMPLATES[3][1]]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    got = {x["file_id"]: (x["licence"], x["similarity"]) for x in LS.own_licences(files, full=[]).collect()}
    want = plain_own(texts, LS.TEMPLATES, LS.THRESHOLD)
    assert 30 < len(want) < 150
    sure = {k for k in range(len(texts)) if abs(-want.get(k, (0,))[0] - LS.THRESHOLD) > 1e-8}
    assert {k for k in got if k in sure} == {k for k in want if k in sure}
    for k in got:
        assert got[k][1] == pytest.approx(-want[k][0], abs=2e-9) and got[k][0] == want[k][1], (k, got[k], want[k])


def test_licence_document_frequencies_of_all_words(spark):
    texts = ["This file is licensed under the MIT License.", "This project is part of the file licensed under the MIT License"]
    assert own(spark, texts) == ["MIT", "MIT"]


def test_licence_headers_over_lines(spark):
    r = random.Random(21)
    bsd = "# Copyright (c) 2020 The Authors\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n"
    gpl = (
        "/*\n * Frobnicator of things\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\n"
    )
    texts = [bsd + sentence(r, 50), gpl + sentence(r, 50), sentence(r, 200) + "\n" + bsd, "Apache License\nVersion 2.0, January 2004\n\n" + sentence(r, 20)]
    assert own(spark, texts) == ["BSD-3-Clause", "GPL-3.0", "BSD-3-Clause", "Apache-2.0"]


def test_whole_licence_files(spark):
    texts = dict(LS.full_texts())
    names = sorted(texts)
    assert own(spark, [texts[n] for n in names], "c/LICENSE.md") == names
    # without title and notices only the whole text is near
    bare = texts["MPL-2.0"].split("Exhibit A -")[0].split("1. Definitions")[1]
    assert own(spark, [bare], "c/COPYING") == ["MPL-2.0"] and own(spark, [bare], "c/other.txt") == [None]
