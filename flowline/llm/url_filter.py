"""URL filters on a sorted array of 64-bit digests.

Rules (host, path prefix, verdict) are kept as three files' worth of arrays: sorted
xxhash64 keys, string offsets, and the rules' full strings.  Tasks map that file into
memory, probe all (host suffix, path prefix) pairs of a batch with one vectorised binary
search, and compare full strings where a digest is found, so collisions never decide.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .shared import publish

#: Largest index that is sent to every executor; a larger rule table is joined by shuffle instead.
MAX_INDEX_BYTES = 1 << 30
VERDICTS = ("allow", "block")


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """The index file: count, then keys, then offsets, then verdicts, then strings ``host + path`` as UTF-8.

    Repeated rules count once; where verdicts disagree, block wins.
    """
    best: dict[bytes, int] = {}
    for host, path, verdict in rules:
        key = (host + path).encode()
        best[key] = max(best.get(key, 0), VERDICTS.index(verdict))
    items = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in best.items())
    keys = np.array([x[0] for x in items], np.uint64)
    ends = np.cumsum([0, *(len(x[1]) for x in items)]).astype(np.int64)
    depths = sorted({len(p) for _, p, _ in rules})
    head = np.array([len(items), len(depths), *depths], np.int64)
    return head.tobytes() + keys.tobytes() + ends.tobytes() + np.array([x[2] for x in items], np.int64).tobytes() + b"".join(x[1] for x in items)


class Index:
    """A packed index, mapped from a file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, d = np.frombuffer(data, np.int64, 2)
        at = 16
        self.depths, at = np.frombuffer(data, np.int64, d, at).tolist(), at + 8 * d
        self.keys, at = np.frombuffer(data, np.uint64, n, at), at + 8 * n
        self.ends, at = np.frombuffer(data, np.int64, n + 1, at), at + 8 * (n + 1)
        self.verdicts, at = np.frombuffer(data, np.int64, n, at), at + 8 * n
        self.data, self.start = data, int(at)

    def text(self, i: int) -> bytes:
        return self.data[self.start + int(self.ends[i]) : self.start + int(self.ends[i + 1])]

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """Position of each string, or -1; equal digests are walked until the full string fits."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(strings), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == digests[inside]]:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.text(k) == strings[i]:
                    found[i] = k
                    break
                k += 1
        return found


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    out = [host]
    while "." in host:
        host = host.partition(".")[2]
        out.append(host)
    return out


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest
    rule wins; ``rule`` is null where none fits, and the verdict is then ``otherwise``.  Null urls and urls
    without ``://`` have empty host and path.  Repeated rows give repeated results, other columns are
    ignored, an empty table or no rules are fine.  Bytes that aren't UTF-8 are read as U+FFFD.  Rules whose index
    would exceed ``max_index_bytes`` are joined by shuffle (:func:`judge_by_join`) instead.
    """
    spark = urls.sparkSession
    packed = pack(rules)
    if len(packed) > max_index_bytes:
        return judge_by_join(urls, spark.createDataFrame(rules, "host string, path string, verdict string"), id_col, url_col, otherwise)
    name = publish(spark, "urls", packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for b in batches:
            split = [parts((u.as_py() or b"").decode("utf-8", "replace")) for u in b.column(1)]
            probes: dict[bytes, int] = {}
            rows: list[list[int]] = []
            for host, path in split:
                mine = [s + path[:d] for s in suffixes(host) for d in index.depths if d <= len(path)]
                rows.append([probes.setdefault(p.encode(), len(probes)) for p in sorted(set(mine), key=len, reverse=True)])
            hit = index.probe(list(probes))
            won = [next((int(hit[p]) for p in mine if hit[p] >= 0), -1) for mine in rows]
            rule = [None if k < 0 else index.text(k).decode() for k in won]
            verdict = [otherwise if k < 0 else VERDICTS[index.verdicts[k]] for k in won]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    slim = urls.select(F.col(id_col), F.col(url_col).cast("binary").alias("url"))
    return slim.mapInArrow(run, f"`{id_col}` {dict(slim.dtypes)[id_col]}, host string, path string, rule string, verdict string")


def judge_by_join(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """The same for a rule table (host, path, verdict) beyond the index's bound: every url's probes are joined by shuffle.

    Probes are the distinct urls' host suffixes with the path prefixes of the lengths that rules have, so a url
    that a third of all rows share is probed once.
    """
    depths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    rest = F.regexp_extract("url", r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)/.*$", 0)
    distinct = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    under = lambda d: F.transform(names, lambda n: F.concat(n, F.substring("path", 1, d)))
    keys = F.array_distinct(F.flatten(F.array(*[F.when(F.length("path") >= d, under(d)).otherwise(F.array().cast("array<string>")) for d in depths])))
    probes = distinct.select("url", F.explode(keys).alias("rule"))
    known = rules.select(F.concat("host", "path").alias("rule"), "verdict").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    best = probes.join(known, "rule").groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("best"))
    judged = distinct.join(best, "url", "left")
    base = urls.select(F.col(id_col), F.col(url_col).alias("url"))
    return base.join(judged, "url", "left").select(id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))
