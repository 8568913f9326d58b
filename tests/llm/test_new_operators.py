"""Conversation repair, importance resampling and archives against plain Python."""

import base64
import gzip
import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowline.llm import conversation, importance, shared, warc
from flowline.llm.queries import ORACLE, QUERIES

from ..conftest import SF, same

GAP = " \t\n\v\f\r"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


# conversations


def brute_damage(rows):
    """{conv: [(turn, role, text), ...]} after damage; conversations whose rows are all dropped have none."""
    out = defaultdict(list)
    for r in rows:
        conv, turn = r["conv_id"], r["turn"]
        text, role = (" " if r[k] is None else r[k] for k in ("text", "role"))
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out[conv] += [(turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation: a shortest path over whole strings."""
    order = lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    rows = sorted(rows, key=order)
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.rstrip(GAP)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = lambda said, role: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((said, role))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(queue)
        if i == len(rows) and said in ("", "a"):
            break
        if (i, said) in done:
            continue
        done.add((i, said))
        for role in ("user", "assistant"):
            if to := after(said, role[0]):
                heapq.heappush(queue, (cost + 2, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, said, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if to := after(said, own[:1]):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, to, (*lines, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if to := after(said, role[0]):
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{role}:{text}")))
    n = Counter(kinds)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def found(df):
    return sorted(((r[0], tuple(r[1:])) for r in df.collect()), key=repr)


def test_conversations_of_the_tables(spark):
    want = sorted(((c, brute_repair(rows)) for c, rows in brute_damage(table("conversations")).items()), key=repr)
    assert found(QUERIES["op11_conversation_repair"](spark, SF)) == want


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_conversations_by_chance(spark, block):
    """Odd roles, ties, nulls, repeated turns, blank and cut texts, in blocks of every size."""
    rng = random.Random(block)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umpire"], ["Yes.", "No", "", " \t\n", "Ok?  ", None, "é!", "x" * 30]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += [(100, 5, "user", "Again.")] * 50 + [(100, t, rng.choice(roles[:3]), f"{t}{rng.choice('.! ')}") for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    by_conv = defaultdict(list)
    for c, t, r, x in rows:
        by_conv[c].append((t, " " if r is None else r, " " if x is None else x))
    got = conversation.told(conversation.repair(df, block=block))
    assert found(got) == sorted(((c, brute_repair(r)) for c, r in by_conv.items()), key=repr)
    damaged = brute_damage([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    got = conversation.told(conversation.repair(conversation.damage(df), present=F.col("present"), block=block))
    assert found(got) == sorted(((c, brute_repair(r)) for c, r in damaged.items()), key=repr)


def test_conversation_edges(spark):
    """Nothing present, nothing at all, other columns with the operator's own names, names of one's own, texts of a megabyte."""
    schema = "conv_id string, turn long, role string, text string"
    gone = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "user", "Hi.")], schema)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(conversation.told(conversation.repair(gone, present=F.col("conv_id") == "b")))[0] == ("a", nothing)
    assert conversation.told(conversation.repair(gone.limit(0))).count() == 0
    long = [("a", 1, "system", "s" * 1_000_000 + "."), ("a", 2, "user", "u " * 500_000 + "?")]
    wide = spark.createDataFrame([(*r, 1, 2, 3) for r in long], "c string, t long, r string, x string, conv long, kind long, part long")
    want = [("a", brute_repair([r[1:] for r in long]))]
    edits = conversation.repair(wide, "c", "t", "r", "x")
    assert found(conversation.told(edits)) == want
    assert [(r["edit"], r["role"] and bytes(r["role"])) for r in edits.orderBy(F.col("place").asc_nulls_last()).collect()] == [("K", b"system"), ("K", b"user"), ("I", b"assistant"), (None, None)]


def test_long_conversation_in_blocks(spark):
    """One conversation of 3,000 turns, a third of them out of turn, over several tasks and blocks."""
    rng = random.Random(5)
    rows = [(1, t, ["user", "assistant"][t % 2] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system"]), f"turn {rng.randrange(2500)}{rng.choice(['.', '?', ''])}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    want = brute_repair_linear([r[1:] for r in rows])
    got = [conversation.told(conversation.repair(df, block=b)).collect() for b in (256, 1 << 20)]
    assert [(r[0]["cost"], r[0]["audit"], r[0]["repaired_sha256"]) for r in got] == [want, want]


def brute_repair_linear(rows):
    """(cost, audit, sha256) turn by turn, keeping the least (cost, audit) of each state."""
    rows = sorted(rows, key=lambda r: r[0])
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    seen, best = set(), {"": (0, ())}

    def spread(best):
        for _ in range(3):
            for s, (c, path) in list(best.items()):
                new = (c + 2, (path, "I", f"{name[nxt[s]]}:"))
                if nxt[s] not in best or new[0] < best[nxt[s]][0] or new[0] == best[nxt[s]][0] and text_of(new[1])[0] < text_of(best[nxt[s]][1])[0]:
                    best[nxt[s]] = new
        return best

    def text_of(path):
        letters, lines = [], []
        while path:
            path, letter, line = path
            letters.append(letter)
            lines.append(line)
        return "".join(reversed(letters)), [x for x in reversed(lines) if x is not None]

    for _, role, text in rows:
        best = spread(best)
        bare, again = text.rstrip(GAP), (role, text) in seen
        seen.add((role, text))
        to = {}
        for s, (c, path) in best.items():
            options = [(c + 3, "D", s, None)]
            if bare and not again:
                more = bare[-1] not in ".!?"
                if role[0] == "s" and s == "" or role[0] == nxt[s]:
                    options.append((c + more, "K", role[0], f"{role}:{text}"))
                options.append((c + 2 + more, "R", nxt[s], f"{name[nxt[s]]}:{text}"))
            for cost, letter, state, line in options:
                new = (cost, (path, letter, line))
                if state not in to or cost < to[state][0] or cost == to[state][0] and text_of(new[1])[0] < text_of(to[state][1])[0]:
                    to[state] = new
        best = to
    best = spread(best)
    cost, audit, lines = min((c, *text_of(p)) for s, (c, p) in best.items() if s in ("", "a"))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


# importance


def brute_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_importance(docs, target, buckets=10_000, longest=1, percent=10):
    def features(text):
        w = brute_words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    each = [(d, *features(x)) for d, x in docs]
    for _, _, f in each:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, n, f in each:
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    n = len(fit) * percent // 100
    return sorted([(*r, k + 1) for k, r in enumerate(fit[:n])] + [(*r, None) for r in [*fit[n:], *(r for r in rows if r[1] < 20)]], key=repr)


def test_importance_of_the_tables(spark):
    want = brute_importance([(r["doc_id"], r["text"]) for r in table("documents")], [r["text"] for r in table("benchmark")])
    got = sorted((tuple(r) for r in QUERIES["op12_importance"](spark, SF).collect()), key=repr)
    assert got == sorted([(d, f, w, s, k) for d, _, f, w, s, k in want], key=repr)


@pytest.mark.parametrize(("hot", "longest", "buckets"), [(1000, 1, 10_000), (3, 2, 37), (1, 3, 5)])
def test_importance_by_chance(spark, monkeypatch, hot, longest, buckets):
    """Nulls, copies on both sides of the number from which they count as hot, equal ids, odd letters, a megabyte of text."""
    monkeypatch.setattr(importance, "HOT", hot)
    rng = random.Random(hot)
    vocabulary = ["Ab", "b1", "é", "ÀB", "日本", "x_y", "\x7f", "naïve-té", "\u0085", "z" * 200]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(40)] + [None, "", "  ", "word " * 200_000]
    docs = [(rng.choice([None, *range(300)]), rng.choice(texts)) for _ in range(400)] + [(7, texts[0])] * 5
    target = [rng.choice(texts) for _ in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"digest": F.lit(1), "weight": F.lit("w"), "rank": F.lit(0)})
    scored = importance.score(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets, longest)
    got = sorted((tuple(r) for r in importance.ranked(scored).collect()), key=repr)
    want = brute_importance(docs, target, buckets, longest)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert sorted(r[5] for r in got if r[5]) == list(range(1, sum(r[1] >= 20 for r in want) // 10 + 1))


def test_importance_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "x y z " * 10), (3, None)], "doc_id long, text string")
    assert importance.ranked(importance.score(empty, some)).count() == 0
    assert {r["weight"] for r in importance.score(some, empty).collect() if r["doc_id"] == 3} == {0}
    drawn = importance.resample(some.withColumn("key", F.lit("k")), some.where("doc_id = 1"), percent=50).collect()
    assert [(r["doc_id"], r["key"]) for r in drawn] == [(1, "k")]


# archives


def brute_archive(rows, least=0):
    out, pages = [], defaultdict(list)
    payload = lambda h: (h or "").encode() if not isinstance(h, bytes) else h
    for page, _, html in rows:
        pages[payload(html)].append(page)
    for page, _, html in rows:
        p = payload(html)
        known = [x for x in pages[p] if x is not None]
        first = max(known) if known and len(p) >= least else None
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        other = first is not None and page != first and len(pages[p]) > 1
        out.append((page, len(p), digest, "revisit" if other else "response", first if other else None, True))
    return sorted(out, key=repr)


def test_archive_of_the_tables(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in table("pages")]
    assert sorted((tuple(r) for r in QUERIES["op13_warc"](spark, SF).collect()), key=repr) == brute_archive(rows)


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, monkeypatch, least):
    """Payloads of none, one and many chunks, of any bytes, with line ends and record heads in them, equal ones, odd urls, in several segments."""
    monkeypatch.setattr(warc, "SEGMENT", 2000)
    rng = random.Random(least)
    texts = [None, "", "a", "abcd", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "\r\n\r\n" * 50, "é" * 40_000, "z" * 65536, "y" * 65537, "日" * 400_000]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "http://a/ b\r\nX: y", "http://é/"]), rng.choice(texts)) for _ in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"chunk": F.lit(1), "identity": F.lit(2), "sha1": F.lit(3)})
    segments, folder = warc.archive(df, least=least)
    assert segments.count() > 1
    assert sorted((tuple(r) for r in warc.told(segments, folder).collect()), key=repr) == brute_archive(rows, least)
    chunks = warc.read(segments, folder)
    assert chunks.agg(F.max(F.length("chunk"))).first()[0] == warc.CHUNK
    bodies = chunks.where("record_type = 'response'").groupBy("digest").agg(F.first("record_id").alias("r")).join(chunks.where("last"), "digest").select("digest", "n_bytes").distinct().collect()
    whole = {base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(): len((t or "").encode()) for _, _, t in rows}
    assert {d: whole[d] for d in whole} == {r["digest"]: r["n_bytes"] for r in bodies if r["digest"] in whole}


def test_archive_bytes_and_urls(spark):
    """A payload needn't be text; whole files are read without segments; a damaged body and a cut file are told."""
    body = bytes(range(256)) * 700
    segments, folder = warc.archive(spark.createDataFrame([(1, "http://x/\n", bytearray(body))], "page_id long, url string, html binary"))
    whole = segments.select("file", F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("length"))
    chunks = sorted(warc.read(whole, folder).collect(), key=lambda r: r["chunk_no"])
    assert b"".join(bytes(c["chunk"]) for c in chunks) == body and [c["last"] for c in chunks] == [False, False, True]
    assert chunks[0]["target_uri"] == "http://x/%0A"
    path = f"{folder.removeprefix('file://')}/{segments.first()['file']}"
    plain = gzip.open(path).read()
    for name, data in (("damaged.warc", plain.replace(b"\x00\x01\x02", b"\x00\x00\x02", 1)), ("cut.warc", plain[:-1000])):
        with open(f"{folder.removeprefix('file://')}/{name}", "wb") as f:
            f.write(data)
        one = spark.createDataFrame([(name, 0, None, 1)], warc.SEGMENTS)
        assert [r["intact"] for r in warc.told(one, folder).collect()] == [False]


def test_archive_of_nothing(spark):
    segments, folder = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.told(segments, folder).count() == 0


def test_chunks_from_any_order(spark):
    """Chunk rows of oversized records, dealt anyhow, are gathered, written and read back."""
    data = {f"urn:r{k}": random.Random(k).randbytes(200_000 + k) for k in range(5)}
    rows = [(r, None, "http://x/", len(d), bytearray(hashlib.sha1(d).digest()), at, bytearray(d[at * 60_000 : (at + 1) * 60_000])) for r, d in data.items() for at in range(4)]
    df = spark.createDataFrame(rows, "record_id string, refers_to string, target_uri string, n_bytes long, sha1 binary, chunk_no long, chunk binary").repartition(7)
    folder = f"{shared.shared_dir(spark)}/gathered-warc"
    segments = shared.materialise(warc.write(warc.gathered(df), folder), "segments")
    last = {r["record_id"]: (r["n_bytes"], r["digest"], r["whole"]) for r in warc.read(segments, folder, payload=False).collect()}
    assert last == {r: (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), True) for r, d in data.items()}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_importance", "op13_warc"])
def test_sql(spark, duck, name):
    if name not in ORACLE:
        pytest.skip("no SQL")
    same(QUERIES[name](spark, SF), duck, ORACLE[name])
