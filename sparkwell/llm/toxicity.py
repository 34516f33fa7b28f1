"""Toxicity by a weighted finite-state grammar over clauses.

A text is read as a string of word classes.  Five transducers are composed into
one: insult and threat words, the targets they are aimed at, negation and
reported speech.  The composed machine reads a clause and writes what it found
there, so that an insult that is denied, quoted or aimed at someone is a
different event from the bare word; a logistic layer weighs the events.  Words
that tell little by themselves are hints: they pass the same machine, and what
the different ones of a text weigh is added up.

The insult lexicon, its weights and the weights of the events are learned from
labelled rows; only the closed-class words below are given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import narrow_batches, staged, tidy

# Closed-class words of English, German, French and Spanish.
TARGETS = """you your yours yourself he him she her they them people everyone those these
du dich dir dein deine ihr euch sie ihn ihm er leute alle
tu te toi ton ta tes vous votre vos il lui elle ils elles gens tous
tú ti tu usted ustedes vosotros él ella ellos ellas gente todos""".split()
NEGATIONS = """not no never neither nor isn aren wasn weren don doesn didn
nicht kein keine keinen niemals nie weder
ne pas jamais aucun aucune ni
no nunca jamás tampoco ningún ninguna""".split()
REPORTS = """said says wrote writes claimed claims quoted reported reports called calls alleged
sagte sagt schrieb schreibt behauptete behauptet zitierte nannte
dit disait écrit écrivait affirme affirmait rapporte rapportait
dijo dice escribió escribe afirmó afirma citó informó""".split()
THREATS = """kill hurt destroy beat stab shoot burn hang murder
töten umbringen schlagen erschießen verbrennen ermorden
tuer frapper brûler égorger assassiner poignarder
matar golpear quemar asesinar apuñalar disparar""".split()

OTHER, BREAK, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, HINT = range(9)
N_CLASSES = 9
#: What the composed machine writes.  ``AIMED`` comes on top of an insult.
#: ``hint_rate`` is what ``hint`` comes to for a hundred different words.
EVENTS = ["insult", "denied", "reported", "aimed", "threat", "softened_threat", "hint", "hint_rate"]
_TOKEN = re.compile(r"[^\W_]+|[.!?;:\n\"«»„“”]")
_MARKS = dict.fromkeys(".!?;:\n", BREAK) | dict.fromkeys("\"«»„“”", QUOTE)
_GIVEN = {
    w: kind
    for kind, words in ((REPORT, REPORTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (THREAT, THREATS))
    for w in words
}
#: Words after a negation that it still covers.
NEGATION_SCOPE = 3
#: Letters of the prefixes tried as lexicon arcs.
PREFIXES = range(4, 12)
#: Words whose class a worker remembers.
MOST_WORDS = 100_000


class Transducer:
    """States from zero on; ``step(state, symbol)`` gives the next state and the
    symbols written.  ``then`` feeds one machine's output to another."""

    def __init__(self, n_states: int, step) -> None:
        self.n_states = n_states
        self.step = step

    def then(self, other: Transducer) -> Transducer:
        def step(state: int, symbol):
            mine, theirs = divmod(state, other.n_states)
            mine, written = self.step(mine, symbol)
            out: list = []
            for x in written:
                theirs, more = other.step(theirs, x)
                out += more
            return mine * other.n_states + theirs, out

        return Transducer(self.n_states * other.n_states, step)

    def table(self, symbols: range) -> tuple[list[list[int]], list[list[tuple]]]:
        """The machine's arcs as plain lists."""
        both = [[self.step(s, x) for x in symbols] for s in range(self.n_states)]
        return [[n for n, _ in row] for row in both], [[tuple(w) for _, w in row] for row in both]


# A symbol between the machines is (class, denied, reported).


def _negation() -> Transducer:
    """Marks insults, threats and hints up to NEGATION_SCOPE words after a negation."""

    def step(left: int, x: int):
        out = [(x, left > 0 and x in (INSULT, THREAT, HINT), False)]
        if x == NEGATION:
            return NEGATION_SCOPE, out
        return 0 if x == BREAK else max(0, left - (x != QUOTE)), out

    return Transducer(NEGATION_SCOPE + 1, step)


def _reported() -> Transducer:
    """State 1: a verb of saying came before in the clause; 2: a quotation that
    follows one is open."""

    def step(state: int, x):
        kind, denied, _ = x
        out = [(kind, denied, state > 0 and kind in (INSULT, THREAT, HINT))]
        if kind == REPORT:
            return max(state, 1), out
        if kind == QUOTE:
            return {0: 0, 1: 2, 2: 0}[state], out
        return (0 if kind == BREAK and state == 1 else state), out

    return Transducer(3, step)


def _clause() -> Transducer:
    """Writes event numbers.  State: a target was seen (1), an insult was seen
    that no target has met yet (2), a threat was seen likewise (4)."""

    def step(state: int, x):
        kind, denied, reported = x
        out: list[int] = []
        if kind == BREAK:
            return 0, out
        if kind == INSULT:
            out.append(1 if denied else 2 if reported else 0)
            if not (denied or reported):
                if state & 1:
                    out.append(3)
                else:
                    state |= 2
        elif kind == THREAT:
            if denied or reported:
                out.append(5)
            elif state & 1:
                out.append(4)
            else:
                state |= 4
        elif kind == HINT:
            out += [] if denied or reported else [6]
        elif kind == TARGET:
            out += [3] * (state >> 1 & 1) + [4] * (state >> 2 & 1)
            state = 1
        return state, out

    return Transducer(8, step)


ARCS, WRITES = _negation().then(_reported()).then(_clause()).table(range(N_CLASSES))


@dataclass
class Lexicon:
    """Weighted arcs of the insult transducer: whole words, and prefixes that
    stand for all words that begin with them."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if self.prefixes:
            found = max([found, *(self.prefixes.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k)])
        return found


class Reader:
    """Reads texts with a lexicon of insults and one of hints; remembers the
    classes of words it has met."""

    def __init__(self, lexicon: Lexicon, hints: Lexicon | None = None) -> None:
        self.lexicon = lexicon
        self.hints = hints or Lexicon()
        self._known: dict[str, int] = dict(_MARKS)

    def _class(self, word: str) -> int:
        kind = INSULT if self.lexicon.weight(word) else _GIVEN.get(word, OTHER)
        if kind == OTHER and self.hints.weight(word):
            kind = HINT
        if len(self._known) < MOST_WORDS and len(word) < 64:
            self._known[word] = kind
        return kind

    def events(self, text: str) -> list[float]:
        """For each kind of event, the weight of its occurrences; each clause
        counts once with its heaviest.  A word is a hint once in a text."""
        total = [0.0] * len(EVENTS)
        words = _TOKEN.findall(text.lower())
        known = self._known
        kinds = [known[w] if w in known else self._class(w) for w in words]
        if INSULT not in kinds and THREAT not in kinds and HINT not in kinds:
            return total
        hints: set[str] = set()
        state, last = 0, 0.0
        clause = [0.0] * len(EVENTS)
        for word, kind in zip(words, kinds, strict=True):
            if kind == INSULT:
                last = self.lexicon.weight(word)
            for e in WRITES[state][kind]:
                if e == 6:
                    hints.add(word)
                    continue
                clause[e] = max(clause[e], last if e < 4 else 1.0)
            state = ARCS[state][kind]
            if kind == BREAK and any(clause):
                total = [a + b for a, b in zip(total, clause, strict=True)]
                clause = [0.0] * len(EVENTS)
        total = [a + b for a, b in zip(total, clause, strict=True)]
        if hints:
            total[6] = sum(self.hints.weight(w) for w in sorted(hints))
            total[7] = 100 * total[6] / len(set(words))
        return total


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]  # one for each event, then the constant
    hints: Lexicon = field(default_factory=Lexicon)

    def probability(self, events: list[float]) -> float:
        z = self.weights[-1] + sum(w * math.log1p(e) for w, e in zip(self.weights, events, strict=False))
        if abs(z) > 500:
            return float(z > 0)
        return 1 / (1 + math.exp(-z))


def patterns(text: str) -> set[str]:
    """Words of a text, and their prefixes with ``*``."""
    words = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2 and w not in _GIVEN}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int, label_col: str = "toxic") -> DataFrame:
    """``text`` and ``label`` of the labelled rows that may be learned from.

    If there are more than ``most`` of them, those with the smallest hashes are
    taken, about ``most`` in number.  A document with several labels has the
    largest.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label_col).alias("label"))
        .where(fold(F.col("doc_id")) != 0)
    )
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # at most about `most` rows of two numbers: small enough to send everywhere
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "label")


def arcs(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, lift: float, chance: float) -> Lexicon:
    """The patterns with log-odds of ``lift`` or more whose counts would come
    about by chance with a probability below ``chance`` (Chernoff's bound).  A
    prefix goes if a longer pattern covers nine tenths of its texts."""
    base = n_pos / (n_pos + n_neg)
    weight: dict[str, float] = {}
    for p, k in pos.items():
        m = neg.get(p, 0)
        odds = math.log((k + 0.5) / (n_pos + 1)) - math.log((m + 0.5) / (n_neg + 1))
        q = k / (k + m)
        far = k * math.log(q / base) + (m * math.log((1 - q) / (1 - base)) if m else 0)
        if odds >= lift and far > -math.log(chance):
            weight[p] = odds
    covered: set[str] = set()
    for p in weight:
        word = p.rstrip("*")
        covered.update(
            c
            for k in PREFIXES
            if k < len(word) or (k == len(word) and not p.endswith("*"))
            if (c := word[:k] + "*") in weight and pos[p] >= 0.9 * pos[c]
        )
    kept = {p: w for p, w in weight.items() if p not in covered}
    return Lexicon(
        {p: w for p, w in kept.items() if not p.endswith("*")}, {p[:-1]: w for p, w in kept.items() if p.endswith("*")}
    )


def learn_lexicon(
    rows: DataFrame, least: int = 5, lift: float = 3.0, hint_lift: float = 1.5, chance: float = 1e-8
) -> tuple[Lexicon, Lexicon]:
    """Words and prefixes that mark texts with label 1: those of insults
    (log-odds of ``lift`` or more) and hints (``hint_lift`` or more).

    Positive texts with the same smallest word hash, near copies for the most
    part, count as one, so that the words of a text that was copied often do
    not look like insults.  All patterns in ``least`` or more positive texts
    are held against the negative texts.
    """

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = patterns(text)
                group = min((xxhash.xxh64_intdigest(w) for w in found if not w.endswith("*")), default=0) >> 1
                found.add("")  # the text itself
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([group] * len(found), pa.int64())], ["pattern", "grp"]
                )

    groups = rows.where("label > 0").select("text").mapInArrow(tidy(positive), "pattern string, grp long").distinct()
    counts = groups.groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {least} OR pattern = ''")
    pos = {r["pattern"]: r["n"] for r in counts.orderBy(F.desc("n"), "pattern").collect()}

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(patterns(text) & pos.keys())
                n[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["pattern", "n"])

    sums = rows.where("label <= 0").select("text").mapInArrow(tidy(negative), "pattern string, n long").groupBy("pattern")
    neg = {r["pattern"]: r["n"] for r in sums.agg(F.sum("n").alias("n")).collect()}
    n_pos, n_neg = pos.pop("", 0), neg.pop("", 0)
    if not n_pos or not n_neg:
        return Lexicon(), Lexicon()
    return arcs(pos, neg, n_pos, n_neg, lift, chance), arcs(pos, neg, n_pos, n_neg, hint_lift, chance)


def fit_events(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Ridge logistic weights of ``log1p`` events by Newton steps; the constant
    comes last."""
    a = np.column_stack([np.log1p(x), np.ones(len(x))])
    beta = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * (a.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model:
    """Lexicon and event weights from at most about ``most_rows`` labelled rows
    outside fold 0.  Without labels of both kinds every score is the share of
    positive labels (0 if there are none)."""
    narrow_batches(docs.sparkSession)
    rows = staged(training_rows(docs, labels, most_rows), "training")
    lexicon, hints = learn_lexicon(rows)

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon, hints)
        for batch in batches:
            found = [reader.events(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = rows.select("text", F.col("label").cast("double")).mapInArrow(tidy(events), "x array<double>, y double").toPandas()
    if got.empty or got["y"].min() > 0:
        return Model(lexicon, [0.0] * len(EVENTS) + [math.inf if len(got) else -math.inf], hints)
    if got["y"].max() <= 0:
        return Model(lexicon, [0.0] * len(EVENTS) + [-math.inf], hints)
    return Model(lexicon, fit_events(np.array(got["x"].tolist()), (got["y"] > 0).to_numpy(float)), hints)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with column ``name`` (0 to 1) added; null text counts as empty.  One
    narrow pass; nothing is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon, model.hints)
        for batch in batches:
            found = [model.probability(reader.events(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    narrow_batches(docs.sparkSession)
    kind = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(tidy(rows), f"{kind}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    Learns from ``labels`` outside fold 0 and scores every whole text.  Null and
    empty texts, and texts in which the grammar finds nothing, get the score of
    no event.  Rows without a ``doc_id`` are scored and not held out; repeated
    rows get equal scores; an empty table gives no rows.  Other columns are
    ignored.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, most_rows))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    name = "toxicity"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return score(docs, train(docs, labels, most_rows), name).where(F.col(name) < 0.5).select(*docs.columns)
