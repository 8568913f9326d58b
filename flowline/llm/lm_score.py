"""Language-model scoring by cross-entropy difference.

Two word-bigram models, of the target documents and of all documents, share one vocabulary: the
corpus's words (lower-cased runs of anything but white space) and a start mark.  Both are smoothed alike,
by pseudo-counts in proportion to the model's tokens and spread evenly over the vocabulary:
p(w | h) = (c(h, w) + a / V) / (c(h) + a).  A document's score is the mean over its tokens of the target
model's loss less the background model's (Moore and Lewis, Intelligent Selection of Language Model
Training Data): lower is more like the target.  Every document is scored by the counts of the others: its
own are taken off first, from both models, so targets aren't judged by themselves, and words that no other document has are
unknown to both.

The loss of a token is a term of its bigram's counts less one of its context's, so counts needn't be
brought together by token.  Each document sends one entry per different bigram and context, by 64-bit
hash, to the hash's bucket; the bucket counts, takes each document's own off and returns sums per
document.  Keys with many of all entries (at most 524,288 of them, by the pigeonhole principle) are
counted beforehand and never sent; any other has under eight entries for each block of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import materialise, publish, small

#: Pseudo-counts of a context in the background model; the target's are as many fewer as its tokens are.
PRIOR = 1.0
#: Tokens of the documents that a task works on together; a longer document is a block of its own.
BLOCK = 1 << 19
#: Entries of one key in a block from which they are reported, and the least share of all entries of a key that is counted beforehand.
REPORTED, HEAVY = 4, 1 / (1 << 18)
#: Entries that a bucket should hold, and the least number of buckets.
BUCKET_ENTRIES, MIN_BUCKETS = 1 << 20, 32
#: Bytes of a key behind its bucket; with more buckets keys tell more apart.
KEY_BYTES = 6
#: Parts of a nat to which a bucket's sum for a document is rounded; a token has two terms, so its loss is off by 1 / FINE at most.
FINE = 1 << 16
#: Binary logarithm of the registers by which different words are counted (an error of 0.8 %).
REGISTERS = 14
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)
_PRIME, _PIECE = 0x9E3779B97F4A7C15 | 1, 1 << 20
_ONE = np.ones(1, np.uint64)
_POWERS = np.cumprod(np.concatenate([_ONE, np.full(_PIECE - 1, _PRIME, np.uint64)]))
_BACK = np.cumprod(np.concatenate([_ONE, np.full(_PIECE - 1, pow(_PRIME, -1, 1 << 64), np.uint64)]))
_START = np.uint64(0x5851F42D4C957F2D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words in order: polynomials of their lower-cased bytes, from running sums over the text."""
    out, at = [], 0
    while at < len(text):
        data = np.frombuffer(text, np.uint8, min(_PIECE, len(text) - at), at)
        space = _SPACE[data]
        if at + len(data) < len(text):  # a piece ends after white space; a longer word is cut
            gaps = np.flatnonzero(space)
            if len(gaps):
                data, space = data[: gaps[-1] + 1], space[: gaps[-1] + 1]
        at += len(data)
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([0 * _ONE, np.cumsum(_LOWER[data] * _POWERS[: len(data)])])
        out.append(mixed((total[last] - total[first]) * _BACK[first] + (last - first).astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def keys(words: np.ndarray) -> np.ndarray:
    """Keys of a document's bigrams (lowest bit 0) and, behind them, contexts (lowest bit 1)."""
    context = np.concatenate([_START * _ONE, words[:-1]])[: len(words)]
    bigram = mixed(mixed(context + np.uint64(7)) ^ (words * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate([bigram & ~np.uint64(1), mixed(context) | np.uint64(1)])


class Block:
    """Some documents' entries: for each different key and document the number of occurrences, in order of key and document."""

    def __init__(self, ids: list, targets: list[bool], words: list[np.ndarray]):
        self.ids, self.target = ids, np.array(targets, bool)
        self.tokens = np.array([len(w) for w in words], np.int64)
        every = np.concatenate([keys(w) for w in words]) if words else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(words), dtype=np.int64), 2 * self.tokens)
        order = np.argsort(every, kind="stable")
        k, d = every[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.empty(0, np.int64)
        self.key, self.doc, self.n = k[starts], d[starts], np.diff(np.append(starts, len(k)))
        self.words = words

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's entries begin, and how many there are."""
        at = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(self.key) else np.empty(0, np.int64)
        return at, np.diff(np.append(at, len(self.key)))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    ids, targets, words, held = [], [], [], 0
    for b in batches:
        for doc, text, hit in zip(b.column(0), b.column(1), b.column(2)):
            w = word_hashes(text.as_py() or b"")
            if held and held + len(w) > size:
                yield Block(ids, targets, words)
                ids, targets, words, held = [], [], [], 0
            ids.append(doc.as_py())
            targets.append(hit.as_py())
            words.append(w)
            held += len(w) + 1
    if ids:
        yield Block(ids, targets, words)


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes, small ones of either sign in few: count, number of planes, planes."""
    v = values.astype(np.int64)
    v = ((v << 1) ^ (v >> 63)).view(np.uint64)
    width = (int(v.max(initial=0)).bit_length() + 7) // 8
    return len(v).to_bytes(7, "little") + bytes([width]) + pa.compress(v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """The integers that were ``packed``."""
    n, width = int.from_bytes(data[:7], "little"), data[7]
    v = np.zeros((n, 8), np.uint8)
    v[:, :width] = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    v = v.view(np.uint64).reshape(-1)
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def losses(key: np.ndarray, target: np.ndarray, everything: np.ndarray, prior: tuple[float, float], vocabulary: float) -> np.ndarray:
    """What a key's counts add to a token's loss beyond log V, in the target model and in the background model."""
    context = (key & np.uint64(1)).astype(bool)
    parts = [np.where(context, np.log1p(n / a), -np.log1p(n * (vocabulary / a))) for n, a in zip((target, everything), prior)]
    return np.stack(parts, 1)


def _survey(marked: DataFrame, size: int) -> tuple[np.ndarray, dict[int, int], int]:
    """Keys that may be heavy, totals (tokens -1, the target's -2, entries -3, blocks -4), and the number of different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registers = np.zeros(1 << REGISTERS, np.int64)
        for b in blocks(batches, size):
            at, n = b.runs()
            often = n >= REPORTED
            sums = np.array([b.tokens.sum(), b.tokens[b.target].sum(), len(b.key), 1])
            for w in b.words:
                rest = w & np.uint64((1 << (64 - REGISTERS)) - 1)
                rank = 65 - REGISTERS - np.frexp(rest.astype(np.float64))[1].clip(0, 64 - REGISTERS)
                np.maximum.at(registers, (w >> np.uint64(64 - REGISTERS)).astype(np.int64), rank)
            kinds = np.repeat([0, 1], [often.sum(), 4])
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int8)), pa.array(np.concatenate([b.key[at[often]].view(np.int64), [-1, -2, -3, -4]])), pa.array(np.concatenate([n[often], sums]))], names=["kind", "key", "n"])
        hit = np.flatnonzero(registers)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), 2, np.int8)), pa.array(hit), pa.array(registers[hit])], names=["kind", "key", "n"])

    found = materialise(marked.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("n").alias("most")), "survey")
    total = {r["key"]: r["n"] for r in found.where("kind = 1").collect()}
    registers = np.zeros(1 << REGISTERS)
    for r in found.where("kind = 2").collect():  # at most 2 ** REGISTERS
        registers[r["key"]] = r["most"]
    m = float(1 << REGISTERS)
    words = 0.7213 / (1 + 1.079 / m) * m * m / (2.0**-registers).sum()
    if words <= 2.5 * m and (registers == 0).any():
        words = m * np.log(m / (registers == 0).sum())
    # what blocks leave out of a key is less than REPORTED for each, so a key above twice that is reported for half of its
    # entries at least; no more than 2 / HEAVY keys pass
    least = max(HEAVY * total.get(-3, 0), 2 * REPORTED * total.get(-4, 0)) / 2
    often = found.where((F.col("kind") == 0) & (F.col("n") >= least)).select("key").toArrow()["key"].to_numpy().view(np.uint64)
    return np.sort(often), total, max(1, round(words))


def _counted(marked: DataFrame, heavy: np.ndarray, name: str, size: int) -> np.ndarray:
    """(target, everything) counts of the heavy keys over all documents."""
    width = len(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = np.fromfile(SparkFiles.get(name), np.uint64), np.zeros((width, 2), np.int64)
        for b in blocks(batches, size):
            at = np.searchsorted(known, b.key).clip(0, width - 1)
            mine = known[at] == b.key
            np.add.at(sums, at[mine], np.stack([b.n * b.target[b.doc], b.n], 1)[mine])
        hit = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit, 0]), pa.array(sums[hit, 1])], names=["place", "target", "everything"])

    out = np.zeros((width, 2), np.int64)
    if width:
        got = marked.mapInArrow(run, "place long, target long, everything long").groupBy("place").agg(F.sum("target").alias("t"), F.sum("everything").alias("e")).toArrow()
        out[got["place"].to_numpy()] = np.stack([got["t"].to_numpy(), got["e"].to_numpy()], 1)
    return out


_PARTS = "bucket int, block long, own boolean, a binary, b binary, c binary, d binary"
_SUMS = "block long, own boolean, a binary, b binary, c binary, d binary"


def score(docs: DataFrame, targets: DataFrame, block: int = BLOCK, vocabulary: int | None = None) -> DataFrame:
    """(doc_id, is_target, n_tokens, target_loss, background_loss, score) of every row of ``docs`` (doc_id, text).

    ``targets`` (doc_id) names the target documents.  Null and wordless texts have no tokens and null losses
    and score; ids named more than once count once; without any target document the target
    model is uniform; repeated rows are documents of their own, so each is known from the others; empty
    tables give no rows; other columns are ignored.  A mean loss is exact to 1 / FINE nats.
    """
    spark = docs.sparkSession
    wanted = small(materialise(targets.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id is not null").distinct().withColumn("is_target", F.lit(True)), "targets"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = slim.join(wanted, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))

    heavy, total, words = _survey(marked, block)
    vocabulary = float(vocabulary or words)
    prior = (PRIOR * max(1, total.get(-2, 0)) / max(1, total.get(-1, 0)), PRIOR)
    counts = _counted(marked, heavy, publish(spark, "heavy", heavy.tobytes()) if len(heavy) else "", block)
    name = publish(spark, "lm", heavy.tobytes() + counts.tobytes())  # at most 2 / HEAVY keys of 24 bytes
    bits = max(int(np.log2(MIN_BUCKETS)), int(np.ceil(np.log2(max(1, total.get(-3, 0) / BUCKET_ENTRIES)))))
    width, shift = len(heavy), np.uint64(64 - bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.fromfile(SparkFiles.get(name), np.uint8) if width else np.empty(0, np.uint8)
        known, totals = raw[: 8 * width].view(np.uint64), raw[8 * width :].view(np.int64).reshape(-1, 2)
        task = TaskContext.get().partitionId() << 32
        for number, b in enumerate(blocks(batches, block)):
            sums = np.zeros((len(b.ids), 2))
            light = np.ones(len(b.key), bool)
            if width:
                at = np.searchsorted(known, b.key).clip(0, width - 1)
                light = known[at] != b.key
                mine = ~light
                n, doc = b.n[mine], b.doc[mine]
                left = totals[at[mine]] - np.stack([n * b.target[doc], n], 1)
                np.add.at(sums, doc, n[:, None] * losses(b.key[mine], left[:, 0], left[:, 1], prior, vocabulary))
            key, doc, n = b.key[light], b.doc[light], b.n[light]
            bucket = (key >> shift).astype(np.int64)
            order = np.argsort(bucket * len(b.ids) + doc, kind="stable")
            key, doc, n, bucket = key[order], doc[order], n[order], bucket[order]
            # the bits behind the bucket, and the lowest one, which tells contexts from bigrams
            rest = ((key << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)) & ~np.uint64(1) | (key & np.uint64(1))
            six = rest.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            rows = [((task + number) % (1 << bits), True, _ids(b.ids), b.target.tobytes(), b.tokens.tobytes(), sums.tobytes())]
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(bucket)) + 1) if len(key) else []:
                rows.append((int(bucket[part[0]]), False, six[part].tobytes(), packed(np.diff(doc[part], prepend=0)), packed(n[part] - 1), np.packbits(b.target[doc[part]]).tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(np.full(len(rows), task + number)), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "block", "own", "a", "b", "c", "d"])

    def meet(table: pa.Table) -> pa.Table:
        own = table.filter(table["own"]).drop_columns(["bucket"])
        sent = table.filter(pa.compute.invert(table["own"]))
        if not sent.num_rows:
            return own
        six = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, KEY_BYTES) for x in sent["a"]]
        sizes = np.array([len(x) for x in six])
        key = np.zeros((sizes.sum(), 8), np.uint8)
        key[:, :KEY_BYTES] = np.concatenate(six)
        key = key.view(np.uint64).reshape(-1)
        doc = np.concatenate([np.cumsum(unpacked(x.as_py())) for x in sent["b"]])
        n = np.concatenate([unpacked(x.as_py()) for x in sent["c"]]) + 1
        hit = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=size).astype(bool) for x, size in zip(sent["d"], sizes)])
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        all_, target = np.add.reduceat(n[order], starts), np.add.reduceat((n * hit)[order], starts)
        left = np.empty((len(key), 2), np.int64)
        left[order, 0], left[order, 1] = target[run], all_[run]
        left -= np.stack([n * hit, n], 1)
        value = n[:, None] * losses(key, left[:, 0], left[:, 1], prior, vocabulary)
        told = left[:, 1] > 0  # what no other document has adds nothing to either loss
        parts = []
        for block_, at, size in zip(sent["block"], np.cumsum(sizes) - sizes, sizes):
            mine = np.arange(at, at + size)[told[at : at + size]]
            if len(mine):
                first = np.flatnonzero(np.diff(doc[mine], prepend=-1))
                fine = np.rint(np.add.reduceat(value[mine], first) * FINE)
                parts.append((block_.as_py(), packed(np.diff(doc[mine][first], prepend=0)), packed(fine[:, 0]), packed(fine[:, 1])))
        cols = list(zip(*parts)) or [[]] * 4
        back = pa.table([pa.array(cols[0], pa.int64()), pa.array([False] * len(parts), pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[1:]), pa.nulls(len(parts), pa.binary())], names=own.column_names)
        return pa.concat_tables([own, back]).combine_chunks()

    def finish(table: pa.Table) -> pa.Table:
        own = table.filter(table["own"]).to_pylist()[0]
        ids, target = np.frombuffer(own["a"], np.int64).reshape(2, -1), np.frombuffer(own["b"], bool)
        tokens, sums = np.frombuffer(own["c"], np.int64), np.frombuffer(own["d"]).reshape(-1, 2).copy()
        back = table.filter(pa.compute.invert(table["own"]))
        for doc, *value in zip(*(back[c].to_pylist() for c in "abc")):
            sums[np.cumsum(unpacked(doc))] += np.stack([unpacked(v) for v in value], 1) / FINE
        none = tokens == 0
        mean = sums / np.maximum(tokens, 1)[:, None] + np.log(vocabulary)
        return pa.table({"doc_id": pa.array(ids[0], mask=ids[1] == 0), "is_target": pa.array(target), "n_tokens": pa.array(tokens), "target_loss": pa.array(mean[:, 0], mask=none), "background_loss": pa.array(mean[:, 1], mask=none), "score": pa.array(mean[:, 0] - mean[:, 1], mask=none)})

    met = marked.mapInArrow(deal, _PARTS).groupBy("bucket").applyInArrow(meet, _SUMS)
    return met.groupBy("block").applyInArrow(finish, "doc_id long, is_target boolean, n_tokens long, target_loss double, background_loss double, score double")


def _ids(ids: list) -> bytes:
    """Ids and, behind them, whether each is there."""
    return np.array([[i or 0 for i in ids], [i is not None for i in ids]], np.int64).tobytes()
