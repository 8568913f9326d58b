"""Quality rules with risk-controlled thresholds.

Every rule is a score of the text and a cutoff above which a document is rejected.  Cutoffs
come from labelled documents: per stratum and rule, cutoffs are tested from the loosest to
the strictest; a cutoff passes if the exact binomial test shows, at the corrected level,
that it rejects less than the allowed share of good documents.  Testing stops at the first
failure (fixed-sequence testing), so each stratum and rule costs one level, and levels
are split over strata and rules (Bonferroni).  The allowed share is split over the rules,
so that all rules together stay within it in every stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise, small

# The contract's symbols and base limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Rules: name, score as an expression over the features, cutoffs from the strictest to the loosest.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [i / 64 for i in range(1, 64)]),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", [i / 64 for i in range(1, 64)]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [i / 64 for i in range(1, 33)]),
    "long_words": ("word_chars / greatest(n_words, 1)", [4 + i / 4 for i in range(1, 64)]),
}
#: Share of good documents that all rules together may reject in a stratum, and the error probability of that claim.
MAX_FALSE_REJECTION, ERROR = 0.02, 0.05

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(text: bytes | None, window: int = 3) -> tuple[int, ...]:
    """FEATURES of a UTF-8 text; null and empty texts have all zero."""
    if not text:
        return (0,) * len(FEATURES)
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80)) if joined else 0
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if n >= window:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        keys = np.zeros(n - window + 1, np.int64)
        for k in range(window):  # ids are ranked anew after each word, so keys stay under n * n
            keys = keys * len(seen) + ids[k : n - window + 1 + k]
            if 0 < k < window - 1:
                keys = np.unique(keys, return_inverse=True)[1]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(window):
            covered[k : n - window + 1 + k] |= again
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """(doc_id, stratum, FEATURES) of every row; the default stratum is ``lang`` (null: the empty string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([features(t.as_py()) for t in b.column(2)], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, found.T)], names=["doc_id", "stratum", *FEATURES])

    key = F.coalesce((stratum if stratum is not None else F.col("lang")).cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("stratum"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{f} long" for f in FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    head = math.lgamma(n + 1)
    logs = [head - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose(counts: np.ndarray, cutoffs: list[float], share: float, level: float) -> float:
    """Strictest cutoff that passes, or infinity.

    ``counts[i]``: good documents whose score exceeds exactly ``i`` of the cutoffs.  A cutoff passes if
    observing as few rejections as it makes would have at most ``level`` probability were the true
    share ``share`` (its Clopper-Pearson upper bound is then at most ``share``).
    """
    n, best = int(counts.sum()), math.inf
    for i in range(len(cutoffs) - 1, -1, -1):
        rejected = int(counts[i + 1 :].sum())
        if n == 0 or rejected > share * n or binomial_cdf(rejected, n, share) > level:
            break
        best = cutoffs[i]
    return best


def thresholds(measured_docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """(stratum, cut_<rule> ...) from the good labelled documents; a rule without a passing cutoff has infinity.

    A document is good if its labels (doc_id, quality) are all 1; null labels don't count.
    Only counts per stratum, rule and cutoff leave the executors' tasks.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low")).where("low = 1").select(F.col("doc_id").alias("good_id"))
    held = measured_docs.where(~base_failed()).join(small(good), F.col("doc_id") == F.col("good_id"), "left_semi")
    above = lambda score, cutoffs: F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: F.expr(score) > c))
    ranks = [F.struct(F.lit(name).alias("rule"), above(score, cutoffs).alias("above")) for name, (score, cutoffs) in RULES.items()]
    counted = held.select("stratum", F.explode(F.array(*ranks)).alias("r")).groupBy("stratum", "r.rule", "r.above").agg(F.count("*").alias("n"))
    counted = materialise(counted, "counted")  # at most a row per stratum, rule and cutoff
    strata = max(1, counted.select("stratum").distinct().count())
    share, level = max_false_rejection / len(RULES), error / (len(RULES) * strata)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": [group["stratum"].iloc[0]]}
        for name, (_, cutoffs) in RULES.items():
            own = group[group["rule"] == name]
            counts = np.bincount(own["above"].to_numpy(int), own["n"].to_numpy(float), len(cutoffs) + 1)
            row[f"cut_{name}"] = [choose(counts, cutoffs, share, level)]
        return pd.DataFrame(row)

    return counted.groupBy("stratum").applyInPandas(pick, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, FEATURES, base_failed, kept, rejected_by) of every row of ``docs`` (doc_id, text, lang).

    Null, empty and wordless texts fail the base rules; a stratum without labelled good documents
    rejects nothing beyond them; a score equal to a cutoff stays; repeated rows are judged alike;
    empty tables give no rows; other columns are ignored.
    """
    table = materialise(measured(docs), "features")
    cuts = small(materialise(thresholds(table, labels, **how).withColumnRenamed("stratum", "cut_stratum"), "cutoffs"))
    joined = table.join(cuts, F.col("stratum") == F.col("cut_stratum"), "left")
    over = [F.when(F.expr(score) > F.col(f"cut_{name}"), F.lit(name)) for name, (score, _) in RULES.items()]
    failed = base_failed()
    by = F.array_compact(F.array(*over))
    return joined.select("doc_id", *FEATURES, failed.alias("base_failed"), (~failed & (F.size(by) == 0)).alias("kept"), F.array_join(by, ",").alias("rejected_by"))
