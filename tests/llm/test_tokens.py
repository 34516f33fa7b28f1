from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwell.llm import packing as P
from sparkwell.llm import rans_tokens as R
from sparkwell.llm import word_cache

from .conftest import sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def libraries():
    return {f: library(f) for f in FILES}


def ids(raw):
    return np.frombuffer(raw, "<u2").tolist()


@pytest.mark.parametrize("name", FILES)
def test_chunks_give_the_library_ids(libraries, name):
    texts = ["", " ", "  a", " a b", "a\n\nb", "\n", "a \n b", "x" * 100 + " y", "don't we've 12 3.5 «é» ñandú\tq z w", "ÀÉ ß Straße! I'LL", "İstanbul ΣΑΣ", "a b ", "<|endoftext|> hi", "\x1ca b\x85c", "hello,world a.b.c ... !!! a,,", "tail\n", "́ é"]
    assert [ids(x) for x in word_cache.tokenizer(name).ids(texts)] == [libraries[name].encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ éßñ'.,!?\n\t 09-_#%&«» İσ")), max_size=60))
def test_any_text_gives_the_library_ids(text):
    for name in FILES:
        got = ids(word_cache.tokenizer(name).ids([text])[0])
        cache = library(name)
        assert got == cache.encode(text, add_special_tokens=False).ids


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "\r\n", "\u0301", "\u200d", "\u00a0", "\u2028", "\x1c", "\x85", "\u1100\u1161", "\u0345", "ſ", "K", "ﬁ", "'ll", "’s"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(SPECIAL), st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x2FF), max_size=8), st.sampled_from([" ", "\n", "'", "a"])), max_size=12).map("".join))
def test_all_of_unicode_gives_the_library_ids(text):
    for name in FILES:
        cache = library(name)
        assert ids(word_cache.tokenizer(name).ids([text])[0]) == cache.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text(libraries):
    text = "a <|endoftext|> b" * 30
    assert 50256 in ids(word_cache.tokenizer(FILES[0]).ids([text])[0]) and 49407 in ids(word_cache.tokenizer(FILES[1]).ids([text])[0])


@pytest.mark.parametrize("n", [1, 5, 2048, 2049, 140_000, 300_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.geometric(0.02, n), 50_000).astype(np.uint16)
    counts = np.bincount(x)
    seen = np.nonzero(counts)[0]
    table = R.Frequencies(seen, counts[seen])
    assert int(table.f.sum()) == 1 << R.SCALE and (table.f[seen] > 0).all()
    block = R.encode_block([9, -4], [n - 1, 1], x, 77, table)
    docs, lengths, back, first = R.decode_block(block, table)
    assert docs.tolist() == [9, -4] and lengths.tolist() == [n - 1, 1] and first == 77 and (back == x).all()
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        R.decode_block(bytes(damaged), table)


def test_parts_decode_alone():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 300, 300_000).astype(np.uint16)
    counts = np.bincount(x)
    table = R.Frequencies(np.arange(300), counts)
    marks, payload = R.encode_ids(x, table)
    assert len(marks) == 3
    for i, m in enumerate(marks):
        n = min(R.CHECKPOINT_TOKENS, len(x) - i * R.CHECKPOINT_TOKENS)
        assert (R.decode_ids(n, m, payload, table) == x[i * R.CHECKPOINT_TOKENS :][:n]).all()


def test_one_id_and_rare_ids():
    table = R.Frequencies(np.array([5]), np.array([10]))
    x = np.full(10, 5, np.uint16)
    assert (R.decode_block(R.encode_block([1], [10], x, 0, table), table)[2] == x).all()
    many = R.Frequencies(np.arange(60_000), np.r_[10**12, np.ones(59_999, np.int64)])
    assert int(many.f.sum()) == 1 << R.SCALE and many.f.min() == 1


def test_table_round_trip(spark, libraries, odd_docs, no_docs):
    rows = odd_docs.where("doc_id IS NOT NULL OR doc_id IS NULL").collect()
    got = R.token_digest(R.round_trip(odd_docs.repartition(3))).collect()
    t = libraries[FILES[0]]
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        x = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r["doc_id"], at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert R.token_digest(R.round_trip(no_docs)).count() == 0


def windows_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    return by


def check_packing(rows, want):
    """Every id once, windows gapless, lengths 4096 or a power of two."""
    back = {}
    for r in rows:
        back.setdefault(r["doc_id"], []).append(r)
    for doc, parts in back.items():
        parts.sort(key=lambda r: (r["start"], r["length"]))
        at = 0
        for r in parts:
            assert r["start"] == at and r["doc_tokens"] == len(want[doc])
            assert r["ids_crc32"] == zlib.crc32(np.array(want[doc][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want[doc])
    for parts in windows_of(rows).values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0


def test_packing(spark, libraries):
    r = random.Random(5)
    texts = {i: sentence(r, r.choice([0, 3, 200, 1500, 9000])) for i in range(60)}
    df = spark.createDataFrame([*texts.items(), (1000, None)], "doc_id long, text string").repartition(3)
    want = {i: libraries[FILES[1]].encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()} | {1000: [2]}
    rows = P.piece_digest(P.pack(df)).collect()
    assert {x["doc_id"] for x in rows} == want.keys()
    check_packing(rows, want)


def test_packing_odd_rows(odd_docs, no_docs):
    rows = P.piece_digest(P.pack(odd_docs)).collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert P.pack(no_docs).count() == 0


def test_sum_of_squares_choice():
    """Each piece goes where the sum of squared level counts becomes smallest; cuts
    too, when no window more may be opened and none has room."""
    r = random.Random(6)
    p = P.SumOfSquares(16, most_open=20, closed_per_open=3)
    cuts = news = 0
    for i in range(2000):
        n = r.choice((1, 2, 7, 9, 9, 11, 13, 16)) if i % 400 > 200 else r.randrange(1, 17)
        counts, new = p.count.copy(), p.may_open()

        def after(*steps, counts=counts):
            c = counts.copy()
            for level, step in steps:
                if 0 < level < 16:
                    c[level] += step
            return int((c**2).sum())

        whole = {h: after((h, -1), (h + n, 1)) for h in range(16 - n + 1) if counts[h] or h == 0 and new}
        if whole:
            assert whole[p.level(n, new)] == min(whole.values())
            news += p.level(n, new) == 0
        else:
            cuts += 1
            cut = {h: after((h, -1), (h + n - 16, 1)) for h in range(16 - n + 1, 16) if counts[h]}
            assert cut[p.cut_level(n)] == min(cut.values())
        p.place((i, 0, np.arange(n)))
        assert p.n_open == p.count.sum() <= 20
    assert cuts > 10 and news > 10


@pytest.mark.parametrize("n_docs", [40, 400, 4000])
def test_little_is_left_for_the_end(n_docs):
    r = np.random.default_rng(n_docs)
    p = P.SumOfSquares(256)
    lengths = np.minimum(256, r.lognormal(4, 1, n_docs).astype(int) + 1)
    out = []
    for i, n in enumerate(lengths):
        out += p.place((i, 0, np.arange(n)))
    assert all(sum(len(x[2]) for x in w) == 256 for w in out)
    left = sum(len(x[2]) for w in p.finish() for x in w)
    assert left <= (2 + len(out) // P.CLOSED_PER_OPEN) * 256 and left + 256 * len(out) == lengths.sum()


def test_bounded_open_windows():
    p = P.SumOfSquares(16, most_open=5)
    out = []
    for i in range(100):
        out += p.place((i, 0, np.arange(9)))
        assert p.n_open <= 5
    out += p.finish()
    assert sum(len(x[2]) for w in out for x in w) == 900
    sizes = [sum(len(x[2]) for x in w) for w in out]
    assert all(s & (s - 1) == 0 for s in sizes)
