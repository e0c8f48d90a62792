"""Toxicity by a weighted finite-state pattern grammar.

A lexicon gives each word of a clause a class, and the learned insults a weight. Small transducers rewrite that
stream one behind the other: threat turns a violent verb behind an intention into a threat, negation marks what it
negates, reported speech marks what is quoted, target marks what is aimed at someone, before it or behind it. They
are composed into one machine, whose arcs carry weights in logarithms of odds. A clause is scored by the weights on
its path; a text by its best clause, the sum of its clauses and how many of them match.

Everything is learned from a bounded sample of at most about ``MAX_ROWS`` labelled rows: the insults, as words and
as word beginnings, with their weights; the weights of the contexts, which begin at ``PRIOR`` and move as far as
the sample speaks; and how the clauses of a text add up.

Defined results: null and empty texts get the score of a text in which nothing matches; without
usable labels that is near 0; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import map_texts, table
from strideframe.llm.langid import held_out
from strideframe.llm.words import alnum_words, hashes, mix

MAX_ROWS = 16_000
#: An insult must be in so many toxic rows and this share of them, and so many times likelier there.
MIN_TOXIC, MIN_SHARE, MIN_LIFT = 10, 0.01, 25.0
#: A hint is a word beginning in this share of the toxic rows that makes up so many times more of their words.
HINT_SHARE, HINT_LIFT = 0.02, 4.0
PREFIXES = (4, 5, 6, 7, 8)
#: Closed classes of the grammar, in the four languages of the data.
TARGETS = "you your yours he she they him her them we us tu te vous toi il elle ils usted ustedes ella ellos du dich ihr euch sie er".split()
NEGATIONS = "not no never without isn't aren't wasn't weren't don't doesn't didn't won't ain't ne pas jamais sans nunca jamás sin nicht kein keine nie ohne".split()
SPEECH = "said says say told wrote writes claimed reported quoted dit dite dijo dice escribió sagte sagt schrieb".split()
INTENTS = "will shall gonna i'll we'll i'm want vais veux voy quiero werde werden will".split()
VIOLENCE = "kill killing hurt destroy murder beat tuer frapper matar golpear töten schlagen".split()
_CLOSED = {w: c for c, words in (("target", TARGETS), ("negation", NEGATIONS), ("speech", SPEECH), ("intent", INTENTS), ("violence", VIOLENCE)) for w in words}
CLASSES = ("insult", "hint", "violence", "intent", "target", "negation", "speech", "other")
#: What contexts can mark, and the odds that contexts add before anything is learned.
MARKED = ("insult", "hint", "violence", "threat")
PRIOR = {"violence": 0.5, "threat": 2.0, "negated": -6.5, "reported": -5.5, "aimed": 1.0, "addressed": 4.0}
#: Rows of the sample that weigh as much as a prior, and bounds of a weight.
TRUST, MOST = 50, 7.0
#: Odds of a text beyond which more of them say no more.
ENOUGH = 10.0
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W_]+(?:['\u2019][^\W_]+)*")


class Transducer:
    """States from 0; arcs (state, symbol) -> (state, emitted symbol, weight)."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds what this one emits to ``after``; weights add up."""
        arcs: dict = {}
        number = {(0, 0): 0}
        todo = [(0, 0)]
        symbols = sorted({s for _, s in self.arcs})
        while todo:
            a, b = todo.pop()
            for s in symbols:
                na, mid, wa = self.arcs[a, s]
                nb, out, wb = after.arcs[b, mid]
                if (na, nb) not in number:
                    number[na, nb] = len(number)
                    todo.append((na, nb))
                arcs[number[a, b], s] = (number[na, nb], out, wa + wb)
        return Transducer(arcs)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for s in symbols:
            state, o, w = self.arcs[state, s]
            out.append((o, w))
        return out


def _kind(symbol: str) -> str:
    return symbol.split("+")[0]


def emitted(machine: Transducer) -> list[str]:
    """All symbols that a machine can emit."""
    return sorted({out for _, out, _ in machine.arcs.values()})


def threat(alphabet: list[str], weights: dict[str, float], span: int = 4) -> Transducer:
    """Within ``span`` words behind an intention a violent verb is a threat."""
    arcs = {}
    for state, s in product(range(span + 1), alphabet):
        left = span if s == "intent" else max(0, state - 1)
        out = "threat" if s == "violence" and state else s
        arcs[state, s] = (left, out, weights.get(out, 0.0) if s == "violence" else 0.0)
    return Transducer(arcs)


def marker(cause: str, span: int, mark: str, alphabet: list[str], weights: dict[str, float]) -> Transducer:
    """Within ``span`` words behind ``cause``, what can be marked carries ``mark`` and its weight."""
    arcs = {}
    for state, s in product(range(span + 1), alphabet):
        if _kind(s) == cause:
            arcs[state, s] = (span, s, 0.0)
        else:
            hit = bool(state) and _kind(s) in MARKED
            arcs[state, s] = (max(0, state - 1), f"{s}+{mark}" if hit else s, weights[mark] if hit else 0.0)
    return Transducer(arcs)


def target(alphabet: list[str], weights: dict[str, float], before: int = 4, behind: int = 3) -> Transducer:
    """What can be marked is aimed if someone stands before it; someone is addressed if it stands before them, unless negated or reported."""
    arcs = {}
    states = list(product(range(before + 1), range(behind + 1)))
    for (i, (a, b)), s in product(enumerate(states), alphabet):
        na, nb, out, weight = max(0, a - 1), max(0, b - 1), s, 0.0
        if _kind(s) in MARKED:
            if a:
                out, weight = f"{s}+aimed", weights["aimed"]
            nb = behind if "+" not in s else 0
        elif s == "target":
            if b:
                out, weight, nb = "target+addressed", weights["addressed"], 0
            na = before
        arcs[i, s] = (states.index((na, nb)), out, weight)
    return Transducer(arcs)


def grammar(weights: dict[str, float] = PRIOR) -> Transducer:
    """The composed machine with the weights of its contexts on its arcs."""
    machine = threat(list(CLASSES), weights)
    machine = machine.compose(marker("negation", 3, "negated", emitted(machine), weights))
    machine = machine.compose(marker("speech", 8, "reported", emitted(machine), weights))
    return machine.compose(target(emitted(machine), weights))


class Grammar:
    """The learned lexicon, the weighted machine, and how clauses add up to a text."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], hints: dict[str, float], other: float = 0.0, contexts: dict[str, float] = PRIOR, coefficients: tuple = (1.0, 0.0, 0.0), bias: float = -4.0):
        import ahocorasick

        self.words, self.beginnings, self.hints, self.other, self.contexts = dict(words), dict(beginnings), dict(hints), other, dict(contexts)
        self.coefficients, self.bias = np.array(coefficients), bias
        self.machine = grammar(self.contexts)
        self._beginnings, self._hints = tuple(beginnings), tuple(hints)
        self._finder = ahocorasick.Automaton()
        for t in [f" {w} " for w in {*words, *VIOLENCE}] + [f" {p}" for p in (*beginnings, *hints)]:
            self._finder.add_word(t, t)
        self._finder.make_automaton()

    def __reduce__(self):
        return Grammar, (self.words, self.beginnings, self.hints, self.other, self.contexts, tuple(self.coefficients.tolist()), self.bias)

    def arc(self, word: str) -> tuple[str, float]:
        """The lexicon's arc for a word: its class and weight."""
        if word in self.words:
            return "insult", self.words[word]
        for kind, prefixes, of in (("insult", self._beginnings, self.beginnings), ("hint", self._hints, self.hints)):
            if word.startswith(prefixes):
                return kind, max(w for p, w in of.items() if word.startswith(p))
        return _CLOSED.get(word, "other"), 0.0

    def clauses(self, text: str) -> list[list[tuple[str, float]]]:
        """For each clause with a match: what the machine emits, with the weights of the path."""
        out = []
        for clause in CLAUSE.split(text.lower().replace("\u2019", "'")):
            words: list[str] = []
            for w in WORD.findall(clause):
                words += [w] if w in _CLOSED else w.split("'")
            arcs = [self.arc(w) for w in words]
            if any(c in MARKED for c, _ in arcs):
                out.append([(o, w + v) for (_, v), (o, w) in zip(arcs, self.machine.run([c for c, _ in arcs]))])
        return out

    def features(self, text: str | None) -> np.ndarray:
        """The best clause, the sum over all words, both within bounds, and the logarithm of how many clauses speak against the text."""
        words = alnum_words(text)
        joined = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
        paths = self.clauses(text) if next(self._finder.iter(joined), None) is not None else []
        matched = [[(o, w) for o, w in path if w] for path in paths]
        scores = [sum(w for _, w in path) for path in matched]
        plain = max(0, len(words) - sum(map(len, matched)))
        total = sum(scores) + self.other * plain
        against = sum(s > 0 for s in scores)
        return np.array([min(ENOUGH, max([0.0, *scores])), max(-ENOUGH, min(ENOUGH, total)), np.log1p(against)])

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.coefficients + self.bias)
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 3000, rate: float = 0.05, ridge: float = 1e-3) -> None:
        """Logistic regression on features of one scale, with coefficients that cannot be negative: a match never speaks for a text."""
        scale = np.maximum(np.abs(x).max(0), 1e-9)
        w, b = np.ones(x.shape[1]), -2.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for t in range(1, steps + 1):
            e = (1 / (1 + np.exp(-np.clip(x / scale @ w + b, -60, 60))) - y) * balance
            g = np.append((x / scale).T @ e + ridge * w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = np.maximum(w - step[:-1], 0), b - step[-1]
        self.coefficients, self.bias = w / scale, float(b)


def context_weights(toxic: Counter, clean: Counter) -> dict[str, float]:
    """The odds that each context adds: from how often what can be marked stands in it, drawn to the prior."""
    out = dict(PRIOR)
    n_toxic, n_clean = (sum(c for s, c in seen.items() if _kind(s) in MARKED) for seen in (toxic, clean))
    for mark in ("negated", "reported", "aimed"):
        t, c = (sum(k for s, k in seen.items() if mark in s.split("+")) for seen in (toxic, clean))
        odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        out[mark] = float(np.clip((odds * (t + c) + PRIOR[mark] * TRUST) / (t + c + TRUST), -MOST, MOST))
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of at most about ``max_rows`` labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for kind, n in counts.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, max_rows / 2 / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = usable.where(drawn < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # bounded by max_rows, so it may go to every executor
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")

    def sign(batches):
        for batch in batches:
            signs = []
            for text in batch.column("text").to_pylist():
                h = hashes(alnum_words(text))
                signs.append(int(mix(h[:-2] * np.uint64(3) + mix(h[1:-1] * np.uint64(5) + h[2:])).min().astype(np.int64)) if len(h) > 2 else int(h.sum(dtype=np.uint64).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(signs, pa.int64())], ["text", "toxic", "sign"])

    # copies and near copies of one text, which share their least shingle hash, count once
    return rows.mapInArrow(sign, "text string, toxic int, sign long").groupBy("sign", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Grammar:
    """A grammar from the labelled sample."""
    sample = sample_rows(docs, labels, max_rows)

    def count(batches):
        seen = [Counter() for _ in range(4)]  # rows with a term, toxic and clean; words with it, toxic and clean
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n = Counter(w.decode("utf-8", "replace") for w in alnum_words(text))
                for w, c in list(n.items()):
                    for k in PREFIXES:
                        if len(w) > k:
                            n[w[:k] + "*"] += c
                n[""] = sum(c for w, c in n.items() if not w.endswith("*"))
                seen[0 if y else 1].update(n.keys())
                seen[2 if y else 3].update(n)
        terms = sorted({*seen[0], *seen[1]})
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], ["term", "toxic", "clean", "in_toxic", "in_clean"])

    sums = [F.sum(c).alias(c) for c in ("toxic", "clean", "in_toxic", "in_clean")]
    counted = sample.mapInArrow(count, "term string, toxic long, clean long, in_toxic long, in_clean long").groupBy("term").agg(*sums)
    rows = counted.where((F.col("term") == "") | (F.col("toxic") >= MIN_TOXIC)).collect()
    total = next((r for r in rows if r["term"] == ""), None) or {"toxic": 0, "clean": 0, "in_toxic": 0, "in_clean": 0}

    def lift(r, a: str, b: str) -> float:
        return (r[a] + 0.5) / (total[a] + 1) / ((r[b] + 0.5) / (total[b] + 1))

    of = {r["term"]: r for r in rows}
    strong = {t for t, r in of.items() if t and r["toxic"] >= MIN_SHARE * total["toxic"] and lift(r, "toxic", "clean") >= MIN_LIFT}
    words = {t for t in strong if not t.endswith("*")}
    beginnings: list[str] = []
    for p in sorted((t[:-1] for t in strong if t.endswith("*")), key=lambda t: (len(t), t)):
        if not p.startswith(tuple(beginnings)) and sum(w.startswith(p) for w in words) != 1:
            beginnings.append(p)
    words = {w for w in words if not w.startswith(tuple(beginnings))}
    weak = {t[:-1] for t, r in of.items() if t.endswith("*") and r["toxic"] >= HINT_SHARE * total["toxic"] and lift(r, "in_toxic", "in_clean") >= HINT_LIFT}
    hints: list[str] = []
    for p in sorted(weak, key=lambda t: (len(t), t)):
        if not p.startswith((*hints, *beginnings)):
            hints.append(p)

    def odds(terms, suffix: str = "") -> dict[str, float]:
        return {t: float(min(MOST, np.log(lift(of[t + suffix], "in_toxic", "in_clean")))) for t in sorted(terms)}

    lexicon = odds(words), odds(beginnings, "*"), odds(hints, "*")
    share = [sum(of[t][k] for t in [*words, *(p + "*" for p in [*beginnings, *hints])]) / max(total[k], 1) for k in ("in_toxic", "in_clean")]
    other = float(np.log1p(-min(share[0], 0.5)) - np.log1p(-min(share[1], 0.5)))
    learned = Grammar(*lexicon, other)

    def marks(batches):
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                n = Counter(o for path in learned.clauses(text or "") for o, _ in path if _kind(o) in MARKED)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([y] * len(n), pa.int32())], ["symbol", "n", "toxic"])

    # at most as many rows as the machine has symbols
    symbols = sample.mapInArrow(marks, "symbol string, n long, toxic int").groupBy("symbol", "toxic").agg(F.sum("n").alias("n")).collect()
    seen = [Counter({r["symbol"]: r["n"] for r in symbols if r["toxic"] == y}) for y in (1, 0)]
    learned = Grammar(*lexicon, other, context_weights(*seen))

    def features(batches):
        for batch in batches:
            got = [learned.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g.tolist() for g in got], pa.list_(pa.float64()))], ["toxic", "x"])

    # what reaches the driver are three numbers for each row of a bounded sample
    rows = sample.mapInArrow(features, "toxic int, x array<double>").groupBy("toxic", "x").count().orderBy("toxic", "x").collect()
    if rows and total["toxic"]:
        x = np.repeat(np.array([r["x"] for r in rows]), [r["count"] for r in rows], 0)
        learned.fit(x, np.repeat(np.array([r["toxic"] for r in rows], float), [r["count"] for r in rows]))
    return learned


def score_toxicity(docs: DataFrame, learned: Grammar) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""

    def rows():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = [learned.score(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

        return step

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows_in, rows, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
