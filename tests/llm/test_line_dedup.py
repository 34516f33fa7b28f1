from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from sparkwell.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted((tuple(r) for r in ld.line_digest(df).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def made(rng, n, first=0):
    pool = [f"a line that comes again, number {i} of the pool" for i in range(60)] + ["short", "", "ÄÖÜ ä line with ÄÄÄÄÄ letters", "x" * 19, "X" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"only in document {first + i}: {rng.random()}" for _ in range(rng.randrange(12))]
        rows.append((first + i, "\n".join(rng.choice(("", " \t", "\x0b")) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(("", " ", "\r")) for x in lines)))
    return rows


def test_against_brute_force(spark, rng):
    rows = made(rng, 200) + [(500, None), (501, ""), (502, "\n\n"), (None, "a line that comes again, number 1 of the pool\nb")]
    assert digest(ld.dedup(frame(spark, rows))) == brute(rows)


def test_edges(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert digest(ld.dedup(odd_docs)) == brute(rows)
    assert digest(ld.dedup(no_docs)) == []
    # rows of one id are one document; the largest of equals keeps its line, repeats included
    line = "A line of more than twenty characters"
    rows = [(1, line), (1, f"{line}\nother"), (2, line), (3, f"{line}\n{line.lower()} "), (4, "x")]
    got = digest(ld.dedup(frame(spark, rows)))
    assert got == brute(rows) and sorted((r[0], r[2]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    rows[3] = (2, "now in two documents")
    assert [r[2] for r in digest(ld.dedup(frame(spark, rows)))] == [0] * 5


def content(index):
    tables = (index.postings, index.refs)
    return [sorted(map(repr, (tuple(r) for r in t.collect()))) for t in tables]


def held(index):
    """Fingerprints that each shard's filter holds, wherever they lie in it."""
    out = {}
    for r in index.filters.collect():
        cells = ld.Cuckoo(r.buckets, bytes(r.cells)).cells
        if cells.any():
            out[r.shard] = sorted(cells[cells > 0].tolist())
    return out


def test_insertions_and_deletions_are_reversible(spark, rng, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 8)
    first, second = made(rng, 60), made(rng, 60, 60)
    a, b = frame(spark, first), frame(spark, second)
    one = ld.LineIndex.empty(spark).insert(a)
    assert one.shards > 1
    both = one.insert(b)
    assert digest(both.clean(a.union(b))) == brute(first + second)
    assert content(both) == content(ld.LineIndex.empty(spark).insert(a.union(b)))
    assert content(both.insert(b)) == content(both) and held(both.insert(b)) == held(both)
    back = both.delete(b)
    assert content(back) == content(one) and held(back) == held(one)
    assert digest(back.clean(a)) == brute(first)
    # the document that keeps a line goes: the next largest takes its place
    last = max(d for d, t in first if "number" in t)
    left = [r for r in first if r[0] != last]
    less = one.delete(frame(spark, [(last, None), (None, None)]))
    assert digest(less.clean(frame(spark, left))) == brute(left)
    none = less.delete(a)
    assert none.postings.count() == 0 and held(none) == {}
    assert held(none.insert(a)) == held(one)


def test_filter_has_no_false_negatives_and_gives_up_what_is_deleted():
    keys = [hashlib.sha256(str(i).encode()).digest()[:16] for i in range(3000)]
    made_ = ld._built(keys)
    places = ld._places(keys, made_.buckets)
    inside = lambda fp, at: any(fp in made_.cells[b] for b in (at, at ^ ld._moved(fp, made_.buckets)))
    assert all(inside(*p) for p in places)
    assert all(made_.delete(*p) for p in places[:2000])
    assert all(inside(*p) for p in places[2000:])
    assert all(made_.delete(*p) for p in places[2000:]) and not made_.cells.any()
    tiny = ld.Cuckoo(1)
    assert [tiny.insert(7, 0) for _ in range(5)] == [True] * 4 + [False]


def test_columns_and_tasks_look_in_the_same_places(spark):
    keys = [hashlib.sha256(str(i).encode()).digest()[:16] for i in range(400)]
    made_ = ld._built(keys[:200])
    df = spark.createDataFrame([(bytearray(k), made_.buckets, bytearray(made_.cells.tobytes())) for k in keys], "key binary, buckets int, cells binary")
    hit = [r[0] for r in df.select(ld.in_filter(F.col("key"), F.col("buckets"), F.col("cells"))).collect()]
    assert all(hit[:200]) and sum(hit[200:]) < 5
    lost = spark.createDataFrame([(bytearray(keys[0]), None, None)], "key binary, buckets int, cells binary")
    assert lost.select(ld.in_filter(F.col("key"), F.col("buckets"), F.col("cells"))).first()[0] is False


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_common_keys_and_rare_ones_end_alike(spark, rng, monkeypatch, share):
    """Whether keys are looked up by themselves or through the filters."""
    monkeypatch.setattr(ld, "HOT_SHARE", share)
    rows = made(rng, 80)
    assert digest(ld.dedup(frame(spark, rows))) == brute(rows)
