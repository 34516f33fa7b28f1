from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkwell.llm import suffix_dedup as S

from .conftest import sentence

L = S.LENGTH


def brute(texts):
    """n_bytes, n_removed, n_spans, hash of what is left, for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + L] for b in data for i in range(len(b) - L + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - L + 1):
            if seen[b[i : i + L]] > 1:
                gone[i : i + L] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus():
    r = random.Random(8)
    passages = [sentence(r, 60) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [sentence(r, r.randrange(5, 60)) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(0, 60)
            parts.insert(r.randrange(len(parts) + 1), p[a : a + r.randrange(150, 420)])
        texts.append(" ".join(parts))
    near = sentence(r, 300)
    for _ in range(8):
        k = r.randrange(len(near))
        texts.append(near[:k] + "#" + near[k + 1 :])
    texts += [texts[0], texts[3], "ab" * 400, "a" * 500, "a" * 199, "b" * 200, "", sentence(r, 2000) + passages[0]]
    return texts


@pytest.mark.parametrize("most", [S.MOST_CONTEXTS, 1, 3])
def test_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_CONTEXTS", most)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.repeat_digest(S.without_repeats(df)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_chunks_of_long_texts(monkeypatch):
    text = sentence(random.Random(9), 900).encode()
    whole = S.anchors(text)
    monkeypatch.setattr(S, "CHUNK", 1024)
    parts = S.anchors(text)

    def windows(found):
        return {s: (h, int(p) - 0) for h, a, b, p in zip(*(x.tolist() for x in found), strict=True) for s in range(a, b + 1)}

    assert windows(whole) == windows(parts)
    assert len(windows(parts)) == len(text) - L + 1


def test_index_alone():
    r = random.Random(10)
    base = sentence(r, 80)
    contexts = [base[r.randrange(30) :][: r.randrange(200, 380)].encode() for _ in range(30)] + [sentence(r, 40).encode()[:250], b"x" * 300, b"short"]
    seen = Counter(c[i : i + L] for c in contexts for i in range(len(c) - L + 1))
    want = [[i for i in range(len(c) - L + 1) if seen[c[i : i + L]] > 1] for c in contexts]
    assert [x.tolist() for x in S.repeated_windows(contexts)] == want


def test_odd_rows(odd_docs, no_docs):
    got = S.repeat_digest(S.without_repeats(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    want = Counter((r["doc_id"], *b) for r, b in zip(odd_docs.collect(), brute([r["text"] for r in odd_docs.collect()]), strict=True) if r["doc_id"] != 3)
    assert Counter(tuple(r) for r in got if r["doc_id"] != 3) == want
    assert S.without_repeats(no_docs).count() == 0 and S.cleaned(no_docs).count() == 0


def test_repeated_rows_lose_everything(spark):
    t = sentence(random.Random(11), 60)
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert {(r["n_removed"], r["n_spans"]) for r in S.without_repeats(df).collect()} == {(len(t), 1)}
    assert [r["text"] for r in S.cleaned(df).collect()] == ["", "", ""]


def test_cleaned_keeps_columns_and_whole_characters(spark):
    shared = "é" * 120 + sentence(random.Random(12), 30)
    df = spark.createDataFrame([(1, "ü" + shared, 5, "k"), (2, "ö" + shared, 6, "k"), (3, "alone", 5, None)], "doc_id long, text string, n_chars int, h string")
    out = {r["doc_id"]: r for r in S.cleaned(df).collect()}
    assert S.cleaned(df).columns == df.columns
    assert out[1]["text"] == "ü" and out[1]["n_chars"] == 1 and out[3]["text"] == "alone"


def test_a_row_that_is_repeated_sends_its_contexts_once(spark, monkeypatch):
    """A third of all rows are one row without an id."""
    from sparkwell.llm import suffix_dedup

    counts = {}
    plain = suffix_dedup.staged

    def counted(df, tag):
        out = plain(df, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "staged", counted)
    shared = "".join(chr(97 + i * i % 23) for i in range(500))
    other = [(i, f"{i} only here " * 30) for i in range(20)]

    def contexts(copies):
        rows = [(None, "left " + shared + " right")] * copies + [(99, "begin " + shared + " end")] + other
        got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        removed = sorted({r["n_removed"] for r in got if r["doc_id"] is None or r["doc_id"] == 99})
        return counts["context-bytes"], removed

    one, removed = contexts(1)
    assert contexts(12)[0] == one and min(removed) >= 500
