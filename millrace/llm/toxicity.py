"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, scores normalised by length.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full width) and digit substitutions to Latin letters, and treats
i, l and 1 as one letter; what is no letter then parts words, by one blank. The lexicon is learned from labelled rows: letter
sequences, with the blanks at a word's ends if they are part of them (so stems, endings and short whole words too), that are
far likelier in toxic documents and seen in many contexts, weighted by their log odds. Words, and pairs of words, that hold a
hit and recur in clean documents only become exceptions. A hit inside an exception does not count. The sum of weights over a power of the number of words (the power
with the least logistic loss) goes through a fitted logistic curve.

Null and empty texts get the score of no hits. Without labelled rows of both classes the score is the toxic share (0 if
there are none). Rows keep all their columns; repeated rows get equal scores; null labels and null ids teach nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, lean, stratified, table, with_field, without

# Look-alike letters and the digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɩ": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
THRESHOLD = 0.7
LENGTH_POWERS = (0.1, 0.25, 0.5, 1.0)
WORD = re.compile(r"[^\W\d_]+")


def _fold_table() -> dict[int, str]:
    out = {ord(a): b for a, b in LOOKALIKES.items()}
    for c in range(0xFF01, 0xFF5F):  # full width
        plain = unicodedata.normalize("NFKC", chr(c)).lower()
        out[c] = LOOKALIKES.get(plain, plain)
    out |= {ord(c): "" for c in "­​‌‍⁠﻿"}
    return {a: b.replace("l", "i") for a, b in out.items()} | {ord("l"): "i"}


FOLD = _fold_table()


def fold(text: str) -> str:
    """Folded words, each between blanks."""
    return f" {' '.join(WORD.findall(text.lower().translate(FOLD)))} "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.25
    slope: float = 0.0
    intercept: float = -20.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for p, w in self.weights.items():
            out.add_word(p, (len(p), w))
        for p in self.exceptions:
            out.add_word(f" {p} ", (len(p) + 2, None))
        out.make_automaton()
        return out

    def raw(self, automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
        """Summed weights of the hits outside exceptions, an overlapped hit counting once, and the number of words."""
        if not text or not len(automaton):
            return 0.0, 1
        found = list(automaton.iter(fold(text)))
        if not found:
            return 0.0, 1
        spared = sorted((end - n + 1, end) for end, (n, w) in found if w is None)
        total, last, at, reach = 0.0, -1, 0, -1
        for begin, end, w in sorted((end - n + 1, end, w) for end, (n, w) in found if w is not None):
            while at < len(spared) and spared[at][0] <= begin:
                reach = max(reach, spared[at][1])
                at += 1
            if begin > last and end > reach:
                total, last = total + w, end
        return total, max(1, len(text.split()))

    def score(self, total: float, words: int) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * total / words**self.power + self.intercept))))


def learn(rows: list[tuple[str, int]], least_share: float = 0.02, ratio: float = 75.0, shortest: int = 4, longest: int = 9) -> Model:
    """Fit lexicon, exceptions and curve to (text, label) rows."""
    n_toxic, n_clean = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, len(rows))
        return Model(intercept=math.log(share / (1 - share)) if 0 < share < 1 else 500.0 if share else -500.0)
    docs, before, clean_docs = defaultdict(set), defaultdict(set), defaultdict(set)
    texts = [fold(t) for t, _ in rows]
    for i, (t, (_, y)) in enumerate(zip(texts, rows)):
        words = [f" {w} " for w in t.split()]
        if y:
            for a, w in zip(["", *words], words):
                docs[w].add(i)
                before[w].add(a)
        else:
            for w in set(words):
                clean_docs[w].add(i)
    grams = defaultdict(list)
    for w in docs:
        for n in range(shortest, min(longest, len(w)) + 1):
            for g in {w[i : i + n] for i in range(len(w) - n + 1)}:
                grams[g].append(w)
    least = max(3, math.ceil(least_share * n_toxic))
    union = lambda ws: set().union(*(docs[w] for w in ws))
    grams = {g: ws for g, ws in grams.items() if sum(len(docs[w]) for w in ws) >= least and len(union(ws)) >= least}
    clean = defaultdict(set)
    for w, ids in clean_docs.items():
        for n in range(shortest, min(longest, len(w)) + 1):
            for i in range(len(w) - n + 1):
                if w[i : i + n] in grams:
                    clean[w[i : i + n]] |= ids
    odds = lambda g, k: math.log(((k + 0.5) / (n_toxic + 1)) / ((len(clean[g]) + 0.5) / (n_clean + 1)))
    support = {g: len(union(ws)) for g, ws in grams.items()}
    telling = lambda g: odds(g, support[g]) >= math.log(ratio) or not clean[g] and support[g] >= 0.05 * n_toxic
    live = {g for g in support if telling(g)}
    model, gone = Model(), set()
    while live:
        g = max(live, key=lambda x: (support[x] - 20 * len(clean[x]), len(x), x))
        live.discard(g)
        ws = [w for w in grams[g] if w not in gone]
        contexts = len(set().union(*(before[w] for w in ws))) if ws else 0
        if support[g] < least or contexts < 0.3 * support[g] or not telling(g):
            continue
        model.weights[g] = odds(g, support[g])
        gone.update(ws)
        for x in {w[i : i + n] for w in ws for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)} & live:
            support[x] = len(union(w for w in grams[x] if w not in gone))
            if support[x] < least:
                live.discard(x)
    _exceptions(model, texts, [y for _, y in rows])
    _calibrate(model, [(t, y) for t, y in rows])
    return model


def _exceptions(model: Model, texts: list[str], labels: list[int], least: int = 2) -> None:
    """Words with a hit, and such words with a neighbour, that recur in clean documents and are in no toxic one; a pair only where the word alone is none."""
    finder, seen = model.automaton(), {0: defaultdict(int), 1: defaultdict(int)}
    held: dict[str, bool] = {}
    for t, y in zip(texts, labels):
        if len(finder) and next(finder.iter(t), None):
            words = t.split()
            for w in set(words) - held.keys():
                held[w] = next(finder.iter(f" {w} "), None) is not None
            hit = [held[w] for w in words]
            for phrase in {w for w, h in zip(words, hit) if h} | {f"{a} {b}" for a, b, g, h in zip(words, words[1:], hit, hit[1:]) if g or h}:
                seen[y][phrase] += 1
    found = {p for p, n in seen[0].items() if n >= least and not seen[1][p]}
    model.exceptions = sorted(p for p in found if " " not in p or not found.issuperset(w for w in p.split() if held[w]))


def _calibrate(model: Model, rows: list[tuple[str, int]]) -> None:
    """Logistic curve by Newton steps with smoothed targets, for each power of the length; the least loss wins."""
    finder = model.automaton()
    raw = [model.raw(finder, t) for t, _ in rows]
    total, words = np.array([a for a, _ in raw]), np.array([b for _, b in raw], float)
    y = np.array([y for _, y in rows], float)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    best = math.inf
    for power in LENGTH_POWERS:
        x = total / words**power
        scale = max(x.max(), 1e-9)
        a, coef = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ coef, -50, 50)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (p - target) + 1e-4 * coef)
            coef -= np.clip(step, -5, 5)
        p = np.clip(1 / (1 + np.exp(-np.clip(a @ coef, -50, 50))), 1e-12, 1 - 1e-12)
        loss = -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()
        if loss < best:
            best, model.power, model.slope, model.intercept = loss, power, float(coef[0] / scale), float(coef[1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = 600) -> Model:
    """Learn from a bounded sample: about ``per_class`` labelled rows of each class, one text for an id, of those ``allowed``."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if allowed is not None:
        known = known.where(allowed)
    drawn = stratified(known, "toxic", F.col("doc_id"), per_class, F.lit(""))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x")).select("x.text", "x.toxic").collect()
    return learn(sorted((r[0], int(r[1])) for r in rows))


def score(df: DataFrame, model: Model, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Add ``output`` (double from 0 to 1) for every whole text."""
    df = without(df, output)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.automaton()
        for batch in batches:
            made = pa.array([model.score(*model.raw(finder, t.as_py())) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, output])

    return df.mapInArrow(lean(run), with_field(df.schema, T.StructField(output, T.DoubleType())))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return score(docs.select("doc_id", "text"), model, output="score").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
