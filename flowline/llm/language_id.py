"""Hierarchical language identification.

A text's letters are hashed as character 1-, 2- and 3-grams.  First the language family is
predicted, then linear support vector machines, one for each pair of languages in the
family, vote.  Families are a parameter; languages outside it form families by
themselves.  Both levels use the same one-versus-one machines.

The machines are fitted on a bounded sample of labelled documents (``PER_LANGUAGE`` rows of
each language, chosen by hash); features of the sample are made on the executors, so only
fixed-size vectors reach the driver, however long the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"),
    "baltic": ("lt", "lv"),
    "finnic": ("fi", "et"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he"),
}
UNKNOWN = "und"
#: Width of the hashed vectors, and labelled rows per language to fit on: 8 KB * 600 a language reach the driver.
WIDTH, PER_LANGUAGE = 2048, 600
#: Rows of the whole sample.  Every language is learned; where there are more than 64, each has fewer rows.
SAMPLE_ROWS = 64 * PER_LANGUAGE
#: Code points that are hashed at once.
BLOCK = 1 << 20


def vector(text: str | None, width: int = WIDTH) -> np.ndarray | None:
    """Hashed n-gram counts of the letters of a text, as square roots of shares, of length 1; None without letters.

    Letters are what ``str.isalpha`` says; runs of anything else count as one blank.
    """
    if not text:
        return None
    out = np.zeros(width)
    letters = False
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[max(0, at - 2) : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _is_letter(codes)
        codes = np.where(alpha, codes, 32)
        keep = alpha | np.concatenate([[True], alpha[:-1]])
        codes = codes[keep].astype(np.uint64)
        letters = letters or bool(alpha.any())
        for n in (1, 2, 3):
            if len(codes) >= n:
                h = codes[: len(codes) - n + 1].copy()
                for k in range(1, n):
                    h = h * np.uint64(0x9E3779B1) + codes[k : len(codes) - n + 1 + k]
                h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                out += np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width)
    if not letters:
        return None
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent (Hsieh et al. 2008); y is +1 or -1.

    The last weight is the bias; rows of the rarer class cost more so that both weigh alike.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = {s: cost * len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    diag = np.array([0.5 / weight[s] for s in y])
    norm = (x * x).sum(1) + diag
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class OneVersusOne:
    """Votes of the machines of all pairs of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH + 1)))

    @staticmethod
    def fit(x: np.ndarray, y: list[str]) -> OneVersusOne:
        classes = sorted(set(y))
        label = np.array([classes.index(c) for c in y])
        pairs = list(combinations(range(len(classes)), 2))
        weights = [fit_svm(x[(m := (label == a) | (label == b))], np.where(label[m] == a, 1, -1)) for a, b in pairs]
        return OneVersusOne(classes, pairs, np.array(weights).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number of each row and a score in (0, 1]: the winner's mean share over its machines' logistic margins."""
        votes = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = 1 / (1 + np.exp(-np.clip(4 * (x @ self.weights[:, :-1].T + self.weights[:, -1]), -30, 30)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margins[:, k]
            votes[:, b] += 1 - margins[:, k]
        return votes.argmax(1), votes.max(1) / max(1, len(self.classes) - 1)


@dataclass
class Model:
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, score = self.families.predict(x)
        out, scores = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(which == k)
            if len(rows):
                lang, inner = self.within[name].predict(x[rows])
                out[rows] = [self.within[name].classes[i] for i in lang]
                scores[rows] = score[rows] * inner
        return out.tolist(), scores


def fit(train: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on ``train`` (text, lang); None if it has no labelled text with letters.

    The sample is the ``per_language`` rows of each language whose texts hash lowest (fewer if that is over
    ``sample_rows`` in all, never none), so it doesn't depend on row order; copies of a text count once.
    """
    rows = train.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    scale = 1 << 30
    rank = F.pmod(F.xxhash64("text"), F.lit(scale))
    # distinct texts that have letters, counted with an error of 2 %: the limit must not depend on how often a text is copied
    sizes = lettered.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()
    per_language = max(1, min(per_language, sample_rows // max(1, len(sizes))))
    # texts under a hash limit per language, half as many again as needed; the rest is cut after the features are made
    limits = [(r["lang"], min(scale, math.ceil(scale * (1.5 * per_language + 20) / max(1, r["n"])))) for r in sizes]
    limits = F.broadcast(train.sparkSession.createDataFrame(limits, "lang string, most long"))
    chosen = lettered.withColumn("rank", rank).join(limits, "lang").where(F.col("rank") < F.col("most")).select("lang", "text", "rank").dropDuplicates(["lang", "rank"])  # copies of a text count once

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [vector(t.as_py()) for t in b.column(0)]
            keep = [i for i, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), b.column(2).take(pa.array(keep, pa.int64())), pa.array([found[i].astype(np.float32).tobytes() for i in keep], pa.binary())], names=["lang", "rank", "v"])

    vectors = chosen.select("text", "lang", "rank").mapInArrow(features, "lang string, rank long, v binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "v"))
    taken = vectors.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "v").collect()
    if not taken:
        return None
    x = np.array([np.frombuffer(r["v"], np.float32) for r in taken], np.float64)
    langs = [r["lang"] for r in taken]
    of = {code: name for name, codes in families.items() for code in codes}
    family = [of.get(c, c) for c in langs]
    within = {name: OneVersusOne.fit(x[(m := np.array([f == name for f in family]))], [c for c, k in zip(langs, m) if k]) for name in sorted(set(family))}
    return Model(OneVersusOne.fit(x, family), within)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, **how) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, from its text alone.

    Null texts, texts without letters, and all texts if nothing could be learned: ``und`` with score 0.
    Ties go to the class first in order; repeated rows get equal predictions; an empty table gives no rows; other
    columns are ignored.
    """
    model = fit(train, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 512):
                found = [vector(t.as_py()) for t in b.column(1)[at : at + 512]]
                rows = [i for i, v in enumerate(found) if v is not None]
                if rows and model is not None:
                    names, s = model.predict(np.array([found[i] for i in rows]))
                    for i, name, value in zip(rows, names, s):
                        langs[at + i], scores[at + i] = name, value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
