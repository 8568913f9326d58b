"""Benchmark decontamination by latent semantic retrieval.

1. Words of the benchmark form the vocabulary.  Each document is reduced, in one pass, to the
   sequence of its vocabulary words (other words keep their place as gaps), and document
   frequencies over passages of all documents give the weights.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives the latent space; its rank is raised
   until it keeps nearly all of every item's energy, so that no item is lost in the reduction.
3. Overlapping windows of every document are folded in and compared with the items, block
   by block, by cosine.  Windows near an item are candidates.
4. A candidate counts if the longest common subsequence of its words and the item's covers
   enough of the item in a span not much longer than it; paraphrases, which cover less, must also
   hold the item's answer.

The benchmark is the stated query set: it is small beside the documents, checked, and
worked off in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .shared import materialise, publish

#: Characters of the benchmark that are worked off together; a larger one is split by items, each part going over the documents.
PART_CHARACTERS = 160_000_000
#: Items of a block; each block has a latent space of its own.
BLOCK_ITEMS = 1024
#: Least share of each item's energy that the latent space keeps, rows of the sketch beyond the rank, power iterations.
ENERGY, OVERSAMPLE, POWER = 0.95, 16, 2
#: Least cosine of a candidate, least share of the item that a copy covers, and that a paraphrase covers.
COSINE, COPY, PARAPHRASE = 0.45, 0.8, 0.6
#: Least share of the answer's words that a paraphrase holds; the answer of an item without one is its rarest words.
ANSWER, RAREST = 0.75, 6
#: Span in which the common subsequence must lie, in lengths of the item.
SPREAD = 1.5
#: Longest passage of an item; longer items are several overlapping passages.
PASSAGE = 64
_TABLE = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; ASCII punctuation and white space separate them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def _passages(n: int, size: int) -> list[tuple[int, int]]:
    """Windows of at most ``size`` over ``n`` places, overlapping by half."""
    if n <= size:
        return [(0, n)] if n else []
    return [(min(at, n - size), min(at, n - size) + size) for at in range(0, n - size // 2, size // 2)]


class Vocabulary:
    """The benchmark's words and passages, as shipped to the executors."""

    def __init__(self, items: pd.DataFrame, passage: int = PASSAGE):
        self.place: dict[bytes, int] = {}
        self.ids, self.ordinal, self.passages, self.answers = [], [], [], []
        for item_id, text, answer in items.itertuples(index=False):
            seq = [self.place.setdefault(w, len(self.place)) for w in words(text)]
            said = [self.place.setdefault(w, len(self.place)) for w in words(answer)]
            for a, b in _passages(len(seq), passage):
                self.ids.append(item_id)
                self.passages.append(np.array(seq[a:b], np.int32))
                self.answers.append(np.array(sorted(set(said)), np.int32))
        self.longest = max(map(len, self.passages), default=1)


def tf_idf(sequence: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary words of a sequence and their weights (1 + log count) * idf."""
    ids, count = np.unique(sequence[sequence >= 0], return_counts=True)
    return ids, (1 + np.log(count)) * idf[ids]


def randomised_svd(passages: DataFrame, width: int, rank: int, oversample: int = OVERSAMPLE, power: int = POWER) -> np.ndarray:
    """Right singular vectors (width x rank) of the sparse rows ``ids``, ``weights`` (binary int32 and float64).

    Halko, Martinsson and Tropp's range finder: each round is one Spark job in which every task
    multiplies its rows with the sketch and adds up its share; tasks' shares are summed by
    a group-by on row blocks of the product.  ``width`` is the benchmark's vocabulary.
    """
    spark = passages.sparkSession
    size = min(rank + oversample, width)
    sketch = np.random.default_rng(7).standard_normal((width, size))
    rows = 1024  # of the product that are one record

    def product(v: np.ndarray) -> np.ndarray:
        name = publish(spark, "sketch", v.tobytes())

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = np.fromfile(SparkFiles.get(name)).reshape(width, size)
            total = np.zeros((width, size))
            for b in batches:
                for ids, weights in zip(b.column(0), b.column(1)):
                    k, w = np.frombuffer(ids.as_py(), np.int32), np.frombuffer(weights.as_py())
                    total[k] += w[:, None] * (w @ v[k])
            parts = [(at // rows, total[at : at + rows]) for at in range(0, width, rows)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["part", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        schema = "part int, sums binary"
        done = passages.select("ids", "weights").mapInArrow(share, schema).groupBy("part").applyInArrow(add, schema).collect()  # width * size numbers
        return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(done, key=lambda r: r["part"])]).reshape(width, size)

    for _ in range(power + 1):
        sketch = np.linalg.qr(product(sketch))[0] if width else sketch
    image = product(sketch)  # A'A Q; its small core gives the singular values' order
    core = sketch.T @ image
    values, turn = np.linalg.eigh((core + core.T) / 2)
    return sketch @ turn[:, np.argsort(-values)[:rank]]


def lcs_places(window: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places in ``window`` of one longest common subsequence with ``item``, as close to their end as can be."""
    n, m = len(window), len(item)
    table = np.zeros((n + 1, m + 1), np.int16)
    for i in range(1, n + 1):
        if window[i - 1] < 0:
            table[i] = table[i - 1]
            continue
        step = np.where(item == window[i - 1], table[i - 1, :-1] + 1, table[i - 1, 1:])
        table[i, 1:] = np.maximum.accumulate(step)
    out, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return np.array(out[::-1], int)


def verify(window: np.ndarray, item: np.ndarray, answer: np.ndarray) -> tuple[float, float]:
    """(share of the item that one stretch of the window covers in order, share of the answer there)."""
    places = lcs_places(window, item)
    if not len(places):
        return 0.0, 0.0
    reach = int(np.ceil(SPREAD * len(item)))
    ends = np.searchsorted(places, places + reach)
    best = int(np.argmax(ends - np.arange(len(places))))
    stretch = window[places[best] : places[ends[best] - 1] + 1]
    return float(ends[best] - best) / len(item), float(np.isin(answer, stretch).mean()) if len(answer) else 0.0


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, copy: float = COPY, paraphrase: float = PARAPHRASE, block_items: int = BLOCK_ITEMS, part_characters: int = PART_CHARACTERS) -> DataFrame:
    """(doc_id, item_id, cosine, covered, answer) for every document of ``docs`` (doc_id, text) that holds an item of ``benchmark`` (item_id, text, perhaps answer).

    One row per document and item, with the best window's figures.  Null, empty and wordless texts
    and items match nothing; repeated benchmark rows count as one item per item_id and text; repeated
    document rows, and rows that share an id, give one result per doc_id and item; rows without a doc_id have no result, as nothing
    could name them; of windows that tie, the one with the higher cosine counts; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    told = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), told.alias("answer")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > part_characters and (parts := min(-(-size // part_characters), items.select("item_id").distinct().count())) > 1:
        cut = items.withColumn("part", F.pmod(F.hash("item_id"), F.lit(parts)))  # by item, so that an item's best window is found in one part
        each = [contaminated(docs, cut.where(F.col("part") == k).drop("part"), cosine, copy, paraphrase, block_items, size) for k in range(parts)]
        return reduce(DataFrame.unionByName, each)
    vocabulary = Vocabulary(items.orderBy("item_id", "text").toPandas())
    schema = "doc_id long, item_id long, cosine double, covered double, answer double"
    if not vocabulary.passages:
        return spark.createDataFrame([], schema)
    place, span = vocabulary.place, 2 * vocabulary.longest
    kind = np.int16 if len(place) < 2**15 else np.int32

    known = publish(spark, "vocabulary", pickle.dumps(place))

    def reduced_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = pickle.loads(Path(SparkFiles.get(known)).read_bytes()).get
        for b in batches:
            out = [np.fromiter((find(w, -1) for w in words(t.as_py())), kind).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "seq"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    reduced = materialise(slim.mapInArrow(reduced_to, "doc_id long, seq binary"), "sequences")
    df, total = _frequencies(reduced, len(place), span, kind)
    idf = np.log((total + 1) / (df + 1)) + 0.05

    answers = [a if len(a) else p[np.argsort(-idf[p], kind="stable")[:RAREST]] for p, a in zip(vocabulary.passages, vocabulary.answers)]
    found = None
    for at in range(0, len(vocabulary.passages), block_items):
        part = slice(at, at + block_items)
        one = _search(reduced, vocabulary.ids[part], vocabulary.passages[part], answers[part], idf, span, kind, cosine, copy, paraphrase, schema)
        found = one if found is None else found.unionByName(one)
    best = F.max_by(F.struct("cosine", "covered", "answer"), F.struct("covered", "answer", "cosine"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.cosine", "b.covered", "b.answer")


def _frequencies(reduced: DataFrame, width: int, span: int, kind: type) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each vocabulary word is, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(width + 1, np.int64), 0
        for b in batches:
            for seq in b.column(0):
                s = np.frombuffer(seq.as_py(), kind).astype(np.int64)
                if not len(s):
                    continue
                passage = np.arange(len(s)) // span
                n += int(passage[-1]) + 1
                s, passage = s[s >= 0], passage[s >= 0]
                seen[:width] += np.bincount(np.unique(passage * width + s) % width, minlength=width)
        seen[width] = n
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(seen[hit])], names=["word", "n"])

    got = reduced.select("seq").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the benchmark's words
    df = np.zeros(width + 1)
    for row in got:
        df[row["word"]] = row["n"]
    return df[:width], int(df[width])


def _search(reduced: DataFrame, ids: list[int], items: list[np.ndarray], answers: list[np.ndarray], idf: np.ndarray, span: int, kind: type, cosine: float, copy: float, paraphrase: float, schema: str) -> DataFrame:
    """Candidates of one block of items by latent cosine, verified."""
    spark, width = reduced.sparkSession, len(idf)
    sparse = [tf_idf(p, idf) for p in items]
    rows = spark.createDataFrame([(k.astype(np.int32).tobytes(), (w / np.linalg.norm(w)).tobytes()) for k, w in sparse], "ids binary, weights binary").repartition(min(8, 1 + len(sparse) // 64))
    rank = min(width, max(1, len(items) // 2))
    while True:
        space = randomised_svd(rows, width, rank)
        latent = np.array([w @ space[k] / np.linalg.norm(w) for k, w in sparse])
        if rank >= min(width, len(items)) or (latent**2).sum(1).min() >= ENERGY:
            break
        rank = min(width, len(items), 2 * rank)
    lengths = np.linalg.norm(latent, axis=1)
    unit = (latent / np.maximum(lengths, 1e-9)[:, None]).astype(np.float32)
    name = publish(spark, "latent", space.astype(np.float32).tobytes() + unit.tobytes())
    k = space.shape[1]
    told = publish(spark, "items", pickle.dumps((ids, items, answers, idf.astype(np.float32))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.memmap(SparkFiles.get(name), np.float32, "r")
        base, unit = raw[: width * k].reshape(width, k), raw[width * k :].reshape(-1, k)
        ids, items, answers, weight = pickle.loads(Path(SparkFiles.get(told)).read_bytes())
        step = span // 2
        for b in batches:
            out: list[tuple] = []
            for doc, seq in zip(b.column(0), b.column(1)):
                s = np.frombuffer(seq.as_py(), kind)
                hit = np.flatnonzero(s >= 0)
                if not len(hit):
                    continue
                # windows that start at every half span; each place is in two of them
                half = hit // step
                cell, ids_ = np.unique(half.astype(np.int64) * width + s[hit], return_counts=True)
                for first in range(0, int(half[-1]) + 1, 512):
                    out.extend(near(doc.as_py(), s, cell, ids_, first, min(first + 512, int(half[-1]) + 1), base, unit, weight, step, ids, items, answers))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["doc_id", "item_id", "cosine", "covered", "answer"])

    def near(doc, s, cell, counts, first, last, base, unit, weight, step, ids, items, answers) -> Iterator[tuple]:
        mine = slice(*np.searchsorted(cell, [first * width, (last + 1) * width]))
        place, word, n = cell[mine] // width - first, cell[mine] % width, counts[mine]
        # a window is two half spans; counts of a word in both are added before the logarithm
        both = np.concatenate([place * width + word, (place[place > 0] - 1) * width + word[place > 0]])
        keys, back = np.unique(both, return_inverse=True)
        tf = 1 + np.log(np.bincount(back, np.concatenate([n, n[place > 0]])))
        window, word = keys // width, keys % width
        inside = window < last - first
        window, word, w = window[inside], word[inside], (tf[inside] * weight[word[inside]]).astype(np.float32)
        size = np.sqrt(np.bincount(window, w * w, last - first))
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        folded = np.add.reduceat(base[word] * w[:, None], starts, axis=0)
        which = window[starts]
        close = (folded @ unit.T) / np.maximum(size[which], 1e-9)[:, None]
        for i, j in zip(*np.nonzero(close >= cosine)):
            at = (int(which[i]) + first) * step
            covered, answer = verify(s[at : at + 2 * step], items[j], answers[j])
            if covered >= copy or (covered >= paraphrase and answer >= ANSWER):
                yield doc, int(ids[j]), float(close[i, j]), covered, answer

    return reduced.mapInArrow(search, schema)
