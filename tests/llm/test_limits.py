"""Ties, very long texts and wide rows, where operators must neither fail nor change their answer."""

import math
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from flowline.llm import mixing, pii, secret_scan, shared, spans
from flowline.llm.queries import ORACLE

from .test_text_operators import pii_base, secret_base


def shares(sizes):
    """Targets by resharing again and again, in whole-number comparisons."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, total = {}, set(order), sum(sizes.values())
    while open_:
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] > 3 * sizes[s] * w}
        target |= {s: 3 * sizes[s] for s in over} if over else {s: rest * weight[s] / w for s in open_}
        open_ -= over or open_
    return target


TIED = [{"a": 10, "b": 20}, {"a": 100, "b": 200, "c": 300, "d": 100}, {"a": 0, "b": 0}, {"a": 5, "b": 10, "c": 15, "d": 1000, None: 10}]


@pytest.mark.parametrize("k", range(8))
def test_mixing_ties(spark, k):
    rng = random.Random(k)
    sizes = TIED[k] if k < len(TIED) else {s: rng.choice([0, 10, 20, 30, 100, rng.randrange(300)]) for s in rng.sample(["a", "b", "c", "d", "é", None], 5)}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r["source"]: r["mix"] for r in mixing.mix(docs).collect()}
    want = shares(sizes)
    assert set(got) == set(want) and all(got[s]["target"] == pytest.approx(want[s]) and 0 <= got[s]["taken"] <= 3 * sizes[s] for s in want)


def test_mixing_sql_reshares():
    rng, con = random.Random(9), duckdb.connect()
    for sizes in TIED + [{s: rng.choice([0, 10, 20, 30, 100, rng.randrange(500)]) for s in rng.sample(["a", "b", "c", "d", "e", "f", "é", None], rng.randint(1, 7))} for _ in range(496)]:
        con.execute("create or replace table documents(doc_id bigint, text varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?)", [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
        got = dict(con.execute(f"select d.source, q.target from ({ORACLE['op8_mixing']}) q join documents d using (doc_id)").fetchall())
        assert got == pytest.approx(shares(sizes))


def test_many_sources_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("s%05d", F.col("id") % 1000).alias("source"), F.expr("repeat('w ', cast(id % 1000 % 50 as int))").alias("text"))
    got = {r["source"]: r["mix"]["target"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert got == pytest.approx(shares({f"s{i:05d}": 3 * (i % 50) for i in range(1000)}))


LONG = {
    "digits": "1" * 10**6, "spaced digits": "1 " * 10**6, "labels": "a@b" + ".b" * 10**5, "dots": "1." * 500_000, "at signs": "a@" * 500_000, "plus": "+1" * 300_000,
    "phone": "+1 " + "(" * 10**6, "local parts": "a.b-" * 250_000, "hex": "0f" * 500_000, "token": "aZ9/" * 250_000, "assign": "password=" * 100_000, "keys": "AKIA" * 250_000, "line": "x y " * 300_000, "colons": "token" + " " * 10**6,
}


@pytest.mark.parametrize("kind", ["pii", "secrets"])
def test_base_spans_of_long_texts(spark, kind):
    """A million characters of what the patterns could run over again and again."""
    names = list(LONG)
    df = spark.createDataFrame([(i, LONG[n]) for i, n in enumerate(names)], "doc_id long, text string").repartition(4)
    if kind == "pii":
        found, key, kinds, plain = pii.spans_of(df), "spans", pii.KINDS, _plain_pii
    else:
        (found, key), kinds, plain = secret_scan.scan(df), secret_scan.KINDS, secret_base
    got = {r[0]: r[1] for r in found.select("doc_id", spans.told(F.filter(key, lambda s: s["kind"].isin(*kinds)))).collect()}
    for i, n in enumerate(names):
        assert got[i] == plain(LONG[n]), n


def _plain_pii(text):
    """The base patterns in plain Python, each only where its mark occurs, since they take quadratic time without it."""
    marks = {"@": "email", ".": "ip", "+": "phone"}
    return ",".join(x for x in pii_base(text, [k for k in pii.KINDS if k == "card" or any(m in text and v == k for m, v in marks.items())]).split(","))


def disclosure(texts, support=3, least=0.9):
    """Terms and what they tell, by counting over all texts."""
    texts = set(texts)
    words = {t: {w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts}
    held = {t: {m[0].lower() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)} for t in texts}
    out = defaultdict(float)
    for e in {e for es in held.values() for e in es}:
        n_e = sum(e in es for es in held.values())
        for w in {w for t in texts if e in held[t] for w in words[t]} if n_e >= support else ():
            met, n = sum(w in words[t] and e in held[t] for t in texts), sum(w in words[t] for t in texts)
            if met >= support and (t := 1 + math.log(met / n) / math.log(max(len(texts), n_e + 1) / n_e)) >= least:
                out[w] = max(out[w], t)
    return dict(out)


def test_disclosing_terms_by_brute_force(spark):
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(300)] + ["Zorba", "zoom", "Ächz"]
    rows = [" ".join(rng.choices(filler, k=30)) for _ in range(300)]
    for i, (name, mail) in enumerate((("Zorblax", "zor@blax.example"), ("Quy", "q@uy.example"), ("Æon 77", "x@y.example"))):
        rows += [f"{' '.join(rng.choices(filler, k=30))} {name} wrote to {mail} {k}" for k in range(4 + i)]
        rows += [f"{' '.join(rng.choices(filler, k=30))} {name.lower()} alone" for _ in range(i)]
    rows += rows[-3:] + ["a@b.example once", "Quz is not Quy"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    based, key = pii.base_spans(marked, F.col("text"))
    found = based.where(F.size(key) > 0).select("copy", pii.entities(F.col(key)).alias("entities"), pii.terms(F.col("text")).alias("words"))
    got = {r["term"]: r for r in pii.disclosing(marked, found).collect()}
    want = disclosure(rows)
    assert {t: r["told"] for t, r in got.items()} == pytest.approx(want) and {"zorblax", "quy", "æon", "77"} <= set(want)
    assert all(r["general"] == "" or t.startswith(r["general"][:-1]) and r["general"][:-1] not in want for t, r in got.items())
    assert got["zorblax"]["general"] == "zorb*"  # other texts speak of Zorba
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    held = [i for i, t in enumerate(rows) if "Zorblax" in t]
    assert len(held) == 4 and all("orblax" not in clean[i] and "zorb* wrote to [EMAIL]" in clean[i] for i in held)
    assert all(clean[i] == t for i, t in enumerate(rows[:300]))


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(100).select("id", F.expr("repeat('x', 100000)").alias("text"), F.array(F.expr("repeat('y', 1000)")).alias("list"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert not hinted(shared.small(wide, most_bytes=1 << 20)) and hinted(shared.small(wide.select("id"), most_bytes=1 << 20))
    assert not hinted(shared.small(spark.range(11), most_rows=10))


def plain_redacted(text, found, mark):
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], mark(kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 255, 256, 257, 1000])
def test_redaction_and_overlaps_by_chance(spark, n):
    """Spans that nest, touch, overlap and repeat, in a text of wide letters, against plain Python."""
    rng = random.Random(n)
    text = "".join(rng.choice("aé日🙂 ") for _ in range(3000))
    draw = lambda k, rank: sorted((a, min(3000, a + rng.randrange(1, 12)), "xyz"[rank]) for a in (rng.randrange(2990) for _ in range(k)))
    base, more = draw(n, 0), draw(n // 2 + 1, 1)
    rows = lambda spans_, rank: [(a, b, k, rank, "v") for a, b, k in spans_]
    df = spark.createDataFrame([(text, rows(base, 0), rows(more, 1))], f"text string, base {spans.SPAN}, more {spans.SPAN}").repartition(2)
    got = df.select(
        spans.redacted(F.col("text"), F.concat("base", "more"), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))).alias("text"), spans.apart(F.col("base"), F.col("more"), 1).alias("free"),
    ).first()
    both = sorted([(a, 0, b, k) for a, b, k in base] + [(a, 1, b, k) for a, b, k in more])
    assert got["text"] == plain_redacted(text, [(a, b, k) for a, _, b, k in both], lambda k: f"[{k}]")
    assert [(s["start"], s["end"]) for s in got["free"]] == [(a, b) for a, b, _ in more if not any(x < b and a < y for x, y, _ in base)]


@pytest.mark.parametrize("kind", ["keys", "assignments", "addresses"])
def test_very_many_spans(spark, kind):
    """Twenty thousand spans in one text take seconds, for scanning and for redacting."""
    rng = random.Random(1)
    n = 20_000
    one = {"keys": lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOP234567", k=16)), "assignments": lambda: "token=" + "".join(rng.choices("abcdefghij0123456789", k=14)) + " é " + "".join(rng.choices("ABCDabcdXYZxyz0123456789", k=24)), "addresses": lambda: f"a{rng.randrange(10**6)}@b.org"}[kind]
    text = " ".join(one() for _ in range(n // (2 if kind == "assignments" else 1)))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    began = time.time()
    if kind == "addresses":
        clean = pii.sanitise(df).first()["text"]
        assert clean == " ".join(["[EMAIL]"] * n)
    else:
        found, key = secret_scan.scan(df)
        told = [(s["start"], s["end"], s["kind"]) for s in found.select(F.explode(key).alias("s")).select("s.*").collect()]
        told.sort(key=lambda s: s[0])
        assert len(told) > n * 0.9
        assert secret_scan.redact(df).first()["text"] == plain_redacted(text, told, lambda _: "[SECRET]")
    assert time.time() - began < 90  # on a machine about three times slower than usual; the quadratic fold took hours
