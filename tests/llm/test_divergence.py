from __future__ import annotations

import re
from collections import Counter, defaultdict

from sparkwell.llm import source_divergence as sd

from .conftest import sentence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    """Every pair with every kept term, one after the other."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    held = defaultdict(Counter)
    for lang, _, words in docs:
        held[lang].update(set(words))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        counts = {s: Counter() for lg, s, _ in docs if lg == lang}
        for lg, s, words in docs:
            if lg == lang:
                counts[s].update(w for w in words if held[lang][w] >= least)
        every = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // n for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(every)
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x[2], -x[0], i) for i, x in enumerate(found, 1)]
    return sorted(out)


def result(df, **kw):
    return sorted(tuple(r) for r in sd.divergence(df, **kw).collect())


def test_against_every_term(spark, rng):
    rows = [(sentence(rng, rng.randrange(60)), rng.choice("xy"), rng.choice(("a", "b", "c", "d", None))) for _ in range(400)]
    rows += [("Only Here ÀÉ x É", "z", "one"), (None, "z", "two"), ("", None, None), ("a_b\x00c-d[e", "x", "a")] + [("copy of a row Copy", "x", "é")] * 40
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert result(df, least=5, top=7) == brute(rows, 5, 7)
    assert result(df) == brute(rows, 30)


def test_edges(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert result(odd_docs, least=2) == brute(rows, 2)
    assert result(no_docs) == []
    # one source and no kept term: no pairs; two sources without terms: value 0
    assert result(odd_docs.where("doc_id = 1")) == []
    two = spark.createDataFrame([("a", "l", "s"), ("b", "l", "t")], "text string, lang string, source string")
    assert result(two) == [("l", "s", "pair", "t", 0, 1), ("l", "t", "pair", "s", 0, 1)]


def test_long_counts_are_exact(spark):
    columns = spark.createDataFrame([("l", "w", [("s", 4 * 10**12), ("t", 10**13)], 14 * 10**12), ("l", "v", [("t", 3)], 3)], "lang string, term string, vec array<struct<source string, n long>>, total long")
    docs = spark.createDataFrame([("", "l", "s"), ("", "l", "t")], "text string, lang string, source string")
    groups = sd.source_totals(docs, columns)
    p = {s: [1 + 10**9 * (c + 5) // (sum(n) + 10) for c in n] for s, n in (("s", (4 * 10**12, 0)), ("t", (10**13, 3)))}
    want = sum(abs(a - b) for a, b in zip(p["s"], p["t"], strict=True))
    assert [r.value for r in sd.pair_values(columns, groups).collect()] == [want]


def test_pieces_and_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 10)
    text = b"abc defgh ijklmnop qrstuvwxyzabcdef gh"
    assert b" ".join(sd._pieces(text)).split() == text.split() and len([*sd._pieces(text)]) > 2


def test_stages_do_not_grow_with_copies(spark):
    """One text a third of all rows leaves as many counted terms as once."""
    rows = [("same words here", "l", "s")] * 500 + [(f"w{i % 40}", "l", "t") for i in range(1000)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    counted = df.select("lang", "source", "text").mapInArrow(sd._counted, sd._COUNTS)
    assert counted.count() == 3 + 1  # w0 to w39 are one term
    assert {r.term: r.docs for r in counted.collect()} == {"same": 500, "words": 500, "here": 500, "w": 1000}
