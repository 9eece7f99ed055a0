"""Language identification in two levels: the language family first, then one-versus-one linear SVMs inside it.

Texts become unit vectors of hashed byte 1- to 3-grams of their lower-cased letters, counted over the whole text and
damped by square roots. A linear SVM per pair of families chooses the family, and inside a family a linear SVM per pair
of languages votes for the language; margins break ties. All SVMs are trained by dual coordinate descent on a bounded,
documented sample: about ``per_language`` rows of each language.

Texts that are null or have no letter give ``und`` with score 0. If only one language is learned, it is predicted with
score 1; if none, every text is ``und``. Repeated rows get equal results; extra columns stay.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, stratified, table, with_field, without

# Language codes by family; a code that is in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
#: Hash buckets of the features.
WIDTH = 1 << 14
HAS_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters become blanks; bytes of other scripts stay.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SQUEEZE = re.compile(rb" {2,}")


def features(text: str) -> np.ndarray:
    """Damped counts of hashed byte 1-, 2- and 3-grams of a whole text, as a unit vector."""
    raw = SQUEEZE.sub(b" ", b" " + text.lower().encode().translate(LETTERS) + b" ")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    mix = lambda x, salt: ((x + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    out = np.sqrt(np.bincount(np.concatenate([mix(b, 1), mix(two, 7 << 24), mix(three, 13 << 24)]), minlength=WIDTH)).astype(np.float32)
    return out / max(float(np.sqrt((out * out).sum())), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """L2-loss linear SVM (y is 1 or -1) by dual coordinate descent; the bias is one more constant feature."""
    x = np.concatenate([x, np.full((len(x), 1), 0.3, np.float32)], 1)
    norm = (x * x).sum(1) + 0.5 / cost
    alpha, w, order = np.zeros(len(x)), np.zeros(x.shape[1], np.float32), np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            grad = y[i] * float(x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - grad / norm[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], 0.3 * float(w[-1])


@dataclass
class Duel:
    """One-versus-one machines between classes; votes first, then summed margins."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, names: list[str]) -> Duel:
        classes = sorted(set(names))
        at, pairs, w, b = np.array([classes.index(n) for n in names]), [], [], []
        for i, j in itertools.combinations(range(len(classes)), 2):
            some = (at == i) | (at == j)
            one, two = linear_svm(x[some], np.where(at[some] == i, 1.0, -1.0))
            pairs.append((i, j))
            w.append(one)
            b.append(two)
        return cls(classes, pairs, np.array(w, np.float32).reshape(len(pairs), x.shape[1]), np.array(b))

    def choose(self, v: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (i, j), m in zip(self.pairs, self.weights @ v + self.bias):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        best = int(np.lexsort((sums, votes))[-1])
        e = np.exp(np.clip(2 * (sums - sums[best]) / max(1, len(self.classes) - 1), -50, 0))
        return self.classes[best], float(1 / e.sum())


@dataclass
class Model:
    family: Duel | None
    inside: dict[str, Duel]

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.family is None or not text or not HAS_LETTER.search(text):
            return UNKNOWN, 0.0
        v = features(text)
        name, a = self.family.choose(v)
        lang, b = self.inside[name].choose(v)
        return lang, min(1.0, a * b)


def learn(rows: list[tuple[str, str]]) -> Model:
    """Fit both levels to (text, language) rows; rows without a letter teach nothing."""
    rows = [(t, g) for t, g in rows if HAS_LETTER.search(t)]
    if not rows:
        return Model(None, {})
    x, langs = np.stack([features(t) for t, _ in rows]), [g for _, g in rows]
    families = [FAMILY_OF.get(g.split("-")[0].lower(), f"language {g}") for g in langs]
    inside = {}
    for name in set(families):
        own = [i for i, f in enumerate(families) if f == name]
        inside[name] = Duel.fit(x[own], [langs[i] for i in own])
    return Model(Duel.fit(x, families), inside)


def train(df: DataFrame, allowed: Column | None = None, per_language: int = 300) -> Model:
    """Learn from about ``per_language`` rows of each language, drawn by hash from all ``allowed`` rows."""
    known = df.select("text", "lang", "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    drawn = stratified(known, "lang", F.col("doc_id"), per_language, F.lit("")).select("text", "lang").distinct()
    return learn(sorted((r[0], r[1]) for r in drawn.collect()))


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score for every whole text."""
    df = without(df, lang, score)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            made = [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, lang, score])

    return df.mapInArrow(run, with_field(df.schema, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod(F.col("doc_id"), 5) != 0)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )
