"""Importance resampling towards a target distribution by hashed word features.

Identical texts are collapsed by grouping the full text; features and weights are computed once for each different
text and counted with its number of copies.  Weights are joined back to the documents, and only
then does each document get noise of its own (Gumbel noise of a hash of its id), so that the
highest scores are a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise, running, small

#: Buckets of the features' hash, words of the longest feature, words that a document needs to be drawn, share drawn in per cent, seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: From this many copies on, a text's weight is looked up without a shuffle, as its documents would all meet in one task.
HOT = 1000
#: Buckets whose counts tasks hand on as one row.
STRETCH = 4096
#: Different words whose buckets a task keeps.
KNOWN = 1 << 18

# A-Z in lower case; every other ASCII character but digits and letters parts words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; null: none."""
    return text.translate(_LOWER).split() if text else []


def _bucketed(found: list[bytes], buckets: int, longest: int, known: dict[bytes, int]) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` words, repeats included."""
    out = []
    for n in range(1, longest + 1):
        runs = found if n == 1 else [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
        for run in runs:
            at = known.get(run)
            if at is None:
                if len(known) >= KNOWN:
                    known.clear()
                at = known[run] = crc32(run) % buckets
            out.append(at)
    return np.array(out, np.uint32)


def featured(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(digest, copies, n_words, n_features, features): one row for each different ``text``, null being empty; features are bucket numbers as 4 bytes each.

    Partial aggregates collapse copies before the shuffle, so a text with very many is no burden.
    """
    different = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    rows = different.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            n_words, packed = [], []
            for t in b.column(2):
                found = words(t.as_py())
                n_words.append(len(found))
                packed.append(_bucketed(found, buckets, longest, known).tobytes())
            n_features = [len(p) // 4 for p in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())], names=["digest", "copies", "n_words", "n_features", "features"])

    return rows.mapInArrow(run, "digest binary, copies bigint, n_words bigint, n_features bigint, features binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and how many each row has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint32), np.array([len(p) // 4 for p in parts], np.int64)


def counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs, copies counted.

    A task adds its texts up to one vector, which it hands on in stretches of STRETCH buckets; the stretches are added as they come.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-buckets // STRETCH) * STRETCH, np.int64)
        for b in batches:
            found, sizes = _unpacked(b.column(0))
            np.add.at(total, found, np.repeat(b.column(1).to_numpy(zero_copy_only=False), sizes))
        parts = total.reshape(-1, STRETCH)
        held = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([parts[k].tobytes() for k in held], pa.binary())], names=["stretch", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["stretch", "counts"])

    schema = "stretch bigint, counts binary"
    out = np.zeros(-(-buckets // STRETCH) * STRETCH, np.int64)
    for row in features.select("features", "copies").mapInArrow(added, schema).repartition("stretch").mapInArrow(summed, schema).collect():  # a row for each stretch
        out[row["stretch"] * STRETCH : (row["stretch"] + 1) * STRETCH] = np.frombuffer(row["counts"], np.int64)
    return out[:buckets]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat that a feature of each bucket speaks for the target, one being added to every count."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + n) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(source, target)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight): the sum of the gains of a text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = _unpacked(b.column(4))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums[ends] - sums[ends - sizes], pa.int64())], names=["digest", "copies", "n_words", "n_features", "weight"])

    return features.select("digest", "copies", "n_words", "n_features", "features").mapInArrow(run, "digest binary, copies bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of SHA-256 of ``seed:id``; a null id counts as the text ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def score(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text), towards the texts of ``target`` (text).

    Null and empty texts have no features and weight 0; repeated rows and rows that share an id get a row each; an empty
    corpus gives no rows, an empty target is one without features; other columns don't matter, whatever
    their names.  Weights of texts with very many copies are joined by broadcast where their measured size allows, and the others'
    documents are dealt by the text's digest.
    """
    features = materialise(featured(docs.select("text"), buckets, longest), "features")
    gain = gains(counts(features, buckets), counts(featured(target.select("text"), buckets, longest), buckets))
    weights = materialise(weighed(features, gain), "weights")
    facts = ("n_words", "n_features", "weight")
    many = weights.where(F.col("copies") >= HOT).select("digest", *[F.col(c).alias(f"hot_{c}") for c in facts])
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), noise(F.col("doc_id"), seed).alias("noise"))
    rows = rows.join(small(many), "digest", "left")
    # documents that have their weight already are dealt anyhow: eight bytes of their id, which no digest equals
    key = F.when(F.col("hot_weight").isNull(), F.col("digest")).otherwise(F.substring(F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8))
    rest = weights.where(F.col("copies") < HOT).select(F.col("digest").alias("key"), *facts)
    found = rows.withColumn("key", key).drop("digest").join(rest, "key", "left")
    out = found.select("doc_id", "noise", *[F.coalesce(f"hot_{c}", c).alias(c) for c in facts])
    return out.select("doc_id", *facts, (F.col("weight") + F.col("noise")).alias("score"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the drawn documents by falling score, ties to the smaller id (nulls last), null for others.

    Of the N documents with ``least_words`` or more, floor(percent * N / 100) are drawn.  The order is dealt in ranges.
    """
    scored = materialise(scored, "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.count() * percent // 100
    placed = running(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], rank=F.lit(1).cast("bigint"))
    drawn = placed.withColumn("rank", F.when(F.col("rank") < n, F.col("rank") + 1))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **how) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged; rows without an id can't be named and are left out, rows that share an id are drawn together."""
    drawn = ranked(score(docs, target, **how), percent).where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull())
    return docs.join(drawn.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
