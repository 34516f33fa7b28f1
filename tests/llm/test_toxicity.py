from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkwell.llm import toxicity as T

from .conftest import sentence


def reader(**words):
    return T.Reader(T.Lexicon({w: float(v) for w, v in words.items()}, {"grum": 2.0}))


def test_grammar_reads_clauses():
    r = reader(oaf=3)
    event = lambda text: dict(zip(T.EVENTS, r.events(text), strict=True))
    assert event("nothing at all") == dict.fromkeys(T.EVENTS, 0.0)
    assert event("an oaf")["insult"] == 3 and event("an oaf")["aimed"] == 0
    assert event("you oaf")["aimed"] == 3 and event("oaf, that is what you are")["aimed"] == 3
    assert event("not an oaf") == dict.fromkeys(T.EVENTS, 0.0) | {"denied": 3.0}
    assert event("not so very much of an oaf")["insult"] == 3  # beyond the negation's scope
    assert event("it never ends. oaf")["insult"] == 3  # another clause
    assert event("she wrote oaf")["reported"] == 3
    assert event('she said "the oaf. an oaf" again')["reported"] == 6
    assert event("grumbler")["insult"] == 2 and event("oaf oaf. oaf")["insult"] == 6
    assert event("i will kill you")["threat"] == 1 and event("i will not kill you")["softened_threat"] == 1
    assert event("kill the lights")["threat"] == 0


def test_composition_is_a_machine():
    assert len(T.ARCS) == (T.NEGATION_SCOPE + 1) * 3 * 8
    assert all(0 <= n < len(T.ARCS) for row in T.ARCS for n in row)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(18)
    rows, labels = [], []
    for i in range(900):
        w = sentence(r, r.randrange(20, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["oaf", "lout", "cretin"]) if i % 12 else "grobx" + r.choice("abcdefgh")
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    out = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] > 100
    assert T.without_toxic(docs, labels).columns == docs.columns
    clash = docs.withColumn("Toxicity", F.lit("x")).withColumn("label", F.lit(1))
    assert T.without_toxic(clash, labels).columns == clash.columns
    assert T.without_toxic(clash, labels).count() == T.without_toxic(docs, labels).count()


def test_scores_use_nothing_but_text(labelled):
    docs, labels = labelled
    model = T.train(docs, labels)
    a = T.score(docs, model).select("doc_id", "toxicity")
    b = T.score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model).select("doc_id", "toxicity")
    assert a.exceptAll(b).count() == 0
    # labels of held-out rows do not matter
    flipped = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.train(docs, flipped) == model


def test_bounded_training_rows(labelled):
    docs, labels = labelled
    n = T.training_rows(docs, labels, 200).count()
    assert 120 < n < 300


def test_odd_rows(odd_docs, no_docs, no_labels, labelled):
    got = T.toxicity(odd_docs, no_labels).collect()
    assert len(got) == odd_docs.count() and {r["score"] for r in got} == {0.0}
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    labels = labelled[1].withColumn("toxic", F.lit(1))
    assert {r["predicted"] for r in T.toxicity(odd_docs, labels).collect()} == {1}
    assert T.toxicity(no_docs, no_labels).count() == 0
    assert T.without_toxic(odd_docs, no_labels).count() == odd_docs.count()
    nulls = labelled[1].select("doc_id", "quality", F.lit(None).cast("int").alias("toxic"))
    assert T.toxicity(odd_docs, nulls).count() == odd_docs.count()


def by_hand(text: str, insults: dict, hints: dict) -> list[float]:
    """Events of a text clause by clause, without machines."""
    clauses, clause, said, quoted, left = [], [], False, False, 0
    for w in T._TOKEN.findall(text.lower()):
        if w in ".!?;:\n":
            clauses.append(clause)
            clause, said, left = [], False, 0
        elif w == '"':
            said, quoted = (False, False) if quoted else (False, said)
        else:
            covered = left > 0
            left = T.NEGATION_SCOPE if w in T.NEGATIONS else max(0, left - 1)
            clause.append((w, covered, said or quoted))
            said = said or (w in T.REPORTS and not quoted)
    clauses.append(clause)
    total, found = [0.0] * len(T.EVENTS), set()
    for c in clauses:
        best = [0.0] * len(T.EVENTS)
        aimed = lambda bare, i: any(w in T.TARGETS for w, *_ in c[:i]) or any(
            w in T.TARGETS and not any(bare(x) for x in c[i + 1 : j]) for j, (w, *_) in enumerate(c) if j > i
        )
        for i, (w, denied, reported) in enumerate(c):
            bare = not (denied or reported)
            if w in insults:
                k = 1 if denied else 2 if reported else 0
                best[k] = max(best[k], insults[w])
                if bare and aimed(lambda x: x[0] in insults and not (x[1] or x[2]), i):
                    best[3] = max(best[3], insults[w])
            elif w in T.THREATS:
                if not bare:
                    best[5] = 1.0
                elif any(x in T.TARGETS for x, *_ in c):
                    best[4] = 1.0
            elif w in hints and bare:
                found.add(w)
        total = [a + b for a, b in zip(total, best, strict=True)]
    total[6] = sum(hints[w] for w in found)
    total[7] = 100 * total[6] / max(1, len(set(T._TOKEN.findall(text.lower()))))
    return total


def test_events_by_hand():
    r = random.Random(19)
    insults, hints = {"oaf": 2.0}, {"grim": 1.6, "dull": 1.7, "sour": 2.0}
    machine = T.Reader(T.Lexicon(insults), T.Lexicon(hints))
    pool = ["oaf", "kill", "you", "not", "said", '"', ".", "\n", *hints, *["plain", "word", "tree"] * 3]
    for _ in range(5000):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(0, 14)))
        assert machine.events(text) == pytest.approx(by_hand(text, insults, hints)), text


def test_weak_words_add_up(spark):
    """No word marks the texts by itself; three of six do."""
    r = random.Random(20)
    weak = ["zorbax", "melvun", "tiprok", "quandel", "fustip", "gralmo"]
    rows, labels = [], []
    for i in range(1500):
        w = sentence(r, 40).split()
        toxic = i % 5 == 0
        for x in r.sample(weak, 3 if toxic else r.choice([0, 0, 0, 1])):
            w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, known)
    assert set(weak) & (model.hints.words.keys() | {w for w in weak if model.hints.weight(w)}) == set(weak)
    out = T.toxicity(docs, known).join(known, "doc_id").where("held_out")
    wrong = out.where("predicted <> toxic").count()
    assert wrong <= 0.05 * out.count()
    # scores come from the events alone
    got = {x["doc_id"]: x["toxicity"] for x in T.score(docs, model).where("doc_id < 50").collect()}
    reader = T.Reader(model.lexicon, model.hints)
    for i, text in rows[:50]:
        assert got[i] == pytest.approx(model.probability(reader.events(text)))


def test_arcs_by_definition():
    pos = {"louts": 30, "lout*": 31, "louts*": 30, "even": 40, "some": 6, "rare": 5}
    neg = {"lout*": 2, "even": 160, "some": 4, "louts*": 1}
    found = T.arcs(pos, neg, 60, 300, 1.5, 1e-8)
    assert found.words.keys() == {"louts"} and found.prefixes == {}  # prefixes are covered by the word
    assert T.arcs(pos, neg, 60, 300, 1.5, 1e-2).words.keys() == {"louts", "some", "rare"}
    assert T.arcs({}, {}, 1, 1, 1.5, 1e-8) == T.Lexicon()
