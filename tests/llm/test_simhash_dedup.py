from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwell.llm import graph, simhash_dedup as S

from .conftest import sentence


def plain_fingerprint(text):
    words = (text or "").encode().lower().decode().split()  # bytes: A-Z alone
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", ["", "   ", "one", "One two", "a b c", "a b c d a b c", "Ä B c\td\ne", None])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_fingerprint_counts_in_turns(monkeypatch):
    text = sentence(random.Random(1), 500)
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "TURN", 7)
    assert S.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("pair_group", [1, 3, 64])
def test_links_connect_all_close_fingerprints(spark, pair_group):
    r = random.Random(2)
    prints = set()
    for _ in range(60):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.randrange(12)):
            x ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 4)))
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = S.near_links(spark.createDataFrame(signed, "fp long"), pair_group=pair_group)
    roots = {r["u"]: r["root"] for r in graph.components(links).collect()}
    want = plain_components(prints)
    groups, expected = {}, {}
    for x in prints:
        s = x - (1 << 64) if x >> 63 else x
        groups.setdefault(roots.get(s, s), set()).add(x)
        expected.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_groups_match_brute_force(spark):
    r = random.Random(4)
    texts = []
    for i in range(40):
        base = sentence(r, r.choice([2, 30, 300])).split()
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            if r.random() < 0.6:
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect()}
    prints = {100 - i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(prints.values())
    least = {}
    for i, f in prints.items():
        least[want[f]] = min(i, least.get(want[f], i))
    assert got == {i: (f"{f:016x}", least[want[f]]) for i, f in prints.items()}


def test_odd_rows(odd_docs, no_docs):
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {1, 2, 5} and {r["component_id"] for r in zero} == {1}
    kept = [r["doc_id"] for r in S.one_of_each(odd_docs).collect()]
    assert kept.count(4) == 1 and kept.count(None) == 1 and 2 not in kept
    assert S.one_of_each(odd_docs).columns == odd_docs.columns
    assert S.near_duplicates(no_docs).count() == 0 and S.one_of_each(no_docs).count() == 0


def test_one_of_each_keeps_other_texts_under_an_id(spark):
    r = random.Random(23)
    a, b, c = (sentence(r, 80) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (3, c), (None, a)]
    kept = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (1, b), (3, c), (None, a)], key=repr)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    star = spark.range(1001, 1300).select(F.col("id").alias("u"), F.lit(1000).cast("long").alias("v"))
    got = {r["u"]: r["root"] for r in graph.components(chain.union(star).union(star)).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {i: 1000 for i in range(1001, 1300)}
    assert graph.components(chain.limit(0)).count() == 0


def test_bits_are_counted_without_overflow():
    text = " ".join(["same words here"] * 400).encode()
    assert S.fingerprint(text) == plain_fingerprint(text.decode())
    assert np.iinfo(np.int64).max > 1 << 40
