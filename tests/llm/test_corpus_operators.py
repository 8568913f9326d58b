"""Near-duplicates, decontamination and the pipeline against brute force on small tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowline.llm import decontaminate, simhash
from flowline.llm.components import connected, forest, spanning

from ..conftest import SF


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def brute_copies(ids, texts):
    """Smallest id reachable by links that either end of any family finds and all families' bits confirm."""
    prints = [simhash.fingerprints((t or "").encode(), simhash.FAMILIES, 5) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def met(a, b):
        x = a ^ b
        ends = x % (1 << simhash.STAGE_BITS), x >> (64 - simhash.STAGE_BITS)
        return x.bit_count() <= simhash.STAGE_WHOLE and min(e.bit_count() for e in ends) <= simhash.STAGE_RADIUS

    for i in range(len(ids)):
        for j in range(i):
            apart = sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j]))
            if apart <= simhash.APART * 64 * simhash.FAMILIES and any(map(met, prints[i], prints[j])):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_recall_of_near_copies(spark):
    """Copies with a similarity of 0.8 or more in five-word shingles, as edits of single words make them, against all pairs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    docs, pairs = [], []
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    for i in range(150):
        words = [word() for _ in range(rng.randint(80, 600))]
        rate = rng.choice((0.005, 0.015, 0.02, 0.08))
        other = [word() if rng.random() < rate else w for w in words]
        a, b = shingles(words), shingles(other)
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((i, len(a & b) / len(a | b)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for least, share, few in ((0.8, 0.9, 60), (0.9, 0.97, 20)):
        similar = [i for i, j in pairs if j >= least]
        assert len(similar) > few and sum(got[2 * i + 1] == 2 * i for i in similar) >= share * len(similar)
    other = [i for i, j in pairs if j < 0.7]
    assert len(other) > 20 and sum(got[2 * i + 1] == 2 * i for i in other) <= 0.05 * len(other)
    assert all(got[2 * i] == 2 * i for i in range(150))


def test_thinning_loses_no_link(spark):
    """Large groups of copies near the threshold, where forests hold pairs that aren't confirmed, against all pairs."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    texts = []
    for rate in (0.012, 0.016, 0.02, 0.024) * 2:
        words = [word() for _ in range(150)]
        texts += [" ".join(word() if rng.random() < rate else w for w in words) for _ in range(40)]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)).collect()}
    # without thinning: all neighbours in runs, every text labelled by itself
    prints = np.array([simhash.fingerprints(t.encode(), simhash.FAMILIES, 5) for t in texts], np.uint64)
    masks, bits = simhash.ball(simhash.STAGE_RADIUS // 2, simhash.STAGE_BITS), np.uint64(simhash.STAGE_BITS)
    numbers, links = np.array(ids, np.uint64), set()
    for column in [*prints.T, *((prints << bits) | (prints >> (np.uint64(64) - bits))).T]:
        found = simhash._bucket_links(np.stack([column, numbers, numbers], 1), 0, 0, masks, simhash.STAGE_RADIUS, simhash.STAGE_BITS, simhash.STAGE_WHOLE)
        links |= {(int(u), int(v)) for u, v in found}
    sure = [(u, v) for u, v in links if np.bitwise_count(prints[u] ^ prints[v]).sum() <= int(simhash.APART * 64 * simhash.FAMILIES)]
    parent = {int(v): int(u) for u, v in forest(np.array(sure))}
    unthinned = {i: parent.get(i, i) for i in ids}
    every = brute_copies(ids, texts)
    assert all(got[i] == got[unthinned[i]] and every[i] == every[got[i]] for i in ids)
    assert len(set(got.values())) <= len(set(unthinned.values())) and sum(got[i] != every[i] for i in ids) <= len(ids) // 100
    assert 20 < len(set(got.values())) < len(texts) - 100


def test_labelled_links(spark):
    """Ids with one fingerprint and others near it are met across labels, and within a label not at all."""
    entries = [(0, 5, 1, 1), (0, 5, 2, 2), (0, 5, 1, 3), (0, 7, 4, 4), (0, 1 << 50, 9, 9), (1, 5, 1, 1), (1, 6, 1, 2)]
    df = spark.createDataFrame(entries, "family int, fp long, label long, id long").repartition(3)
    found = {tuple(sorted((r["u"], r["v"]))) for r in simhash.linked(df, 2, 64, 16, 0).select("u", "v").collect()}
    assert {(1, 2), (2, 3)} <= found | {(1, 3)} and any(4 in p for p in found)
    assert (1, 3) not in found and not any(9 in p for p in found)
    assert simhash.linked(df.limit(0), 2, 64, 16, 0).collect() == []


def test_fingerprints_in_blocks():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 400):
        text = " ".join(f"W{rng.randrange(99)}é" for _ in range(n))
        assert simhash.fingerprint(text.encode()) == simhash.fingerprint(text.encode(), block=3) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("slice_variants,bits", [(1 << 21, 7), (500, 2), (1 << 21, 12)])
def test_links_find_every_pair(spark, monkeypatch, slice_variants, bits):
    """Chains, dense clusters and lone fingerprints, with bucket counts and slices that take every branch."""
    monkeypatch.setattr(simhash, "SLICE_VARIANTS", slice_variants)
    monkeypatch.setattr(simhash, "MIN_BUCKET_BITS", bits)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(6):
            prints.add(at)
            for b in rng.sample(range(64), rng.choice((1, 3, 4, 5))):
                at ^= 1 << b
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.linked(df).collect()]
    want = brute_components(prints, prints)
    assert all(want[u] == want[v] for u, v in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[max(find(u), find(v))] = min(find(u), find(v))
    assert {p: find(p) for p in prints} == want


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(5000, None), (5001, ""), (5002, "  "), (5003, "a"), (5004, "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "component_id": F.lit(1)})
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints)
    assert got == {i: (p, want[i]) for (i, _), p in zip(rows, prints)}
    assert got[5002][1] == got[5000][1] and got[5004][1] == 5003


def test_deduplicate_keeps_one(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (7, "other words are here now", "z"), (None, "a b c d e f", "n")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in kept.collect()) == [(0, "n"), (1, "y"), (7, "z")]
    assert simhash.deduplicate(spark.createDataFrame([], "doc_id long, text string, fp string")).collect() == []


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_forest_spans():
    rng = np.random.default_rng(0)
    links = rng.integers(0, 60, (50, 2))
    thin = forest(links)
    root = {i: i for i in range(60)}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {int(b): int(a) for a, b in thin} == {i: find(i) for i in range(60) if find(i) != i}


def test_spanning_takes_the_lightest_pairs():
    rng = np.random.default_rng(1)
    links, weights = rng.integers(0, 40, (120, 2)), rng.integers(0, 9, 120)
    root = {i: i for i in range(40)}

    def find(x):
        return x if root[x] == x else find(root[x])

    want = []  # Kruskal
    for w, (a, b) in sorted(zip(weights.tolist(), links.tolist()), key=lambda x: x[0]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append(w)
    of = {}
    for w, (a, b) in zip(weights.tolist(), links.tolist()):
        of[a, b] = min(w, of.get((a, b), 99))
    got = spanning(links, weights).tolist()
    assert sorted(of[a, b] for a, b in got) == sorted(want)
    tops = {find(i) for i in range(40)}
    assert len(got) == 40 - len(tops)
    assert spanning(np.empty((0, 2), np.int64), np.empty(0)).tolist() == []


def test_benchmark_passages(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(4000)]
    common = ["the", "of", "and", "to"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(15, 60))).capitalize() + ".") for i in range(40)] + [(40, None), (41, ""), (42, "...")]
    docs, want = [], set()
    for d in range(300):
        body = say(rng.randint(5, 900))
        if d % 10 == 0:
            i = rng.randrange(40)
            at = rng.randrange(len(body) + 1)
            body[at:at] = items[i][1].split()
            want.add((d, i))
        if d % 10 == 5:  # a paraphrase: a fifth of the words differ
            i = rng.randrange(40)
            words = [w if k % 6 else "changed" for k, w in enumerate(items[i][1].split())]
            body += words
            want.add((d, i))
        docs.append((d, " ".join(body)))
    docs += [(None, items[0][1]), (900, None), (901, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    benchmark = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, benchmark).collect()}
    exact = {(d, i) for d, i in want if d % 10 == 0}
    assert exact <= got <= want and len(got) >= 0.9 * len(want)
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, benchmark, block_items=16).collect()}
    assert exact <= blocks <= want
    parts = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, benchmark, part_characters=3000).collect()}
    assert exact <= parts <= want and len(parts) >= 0.9 * len(want)
    assert decontaminate.contaminated(df.where("false"), benchmark).collect() == []
    assert decontaminate.contaminated(df, benchmark.where("false")).collect() == []


def test_singular_vectors(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((60, 30)) * (0.7 ** np.arange(30))
    rows = [(np.arange(30, dtype=np.int32).tobytes(), r.tobytes()) for r in a]
    v = decontaminate.randomised_svd(spark.createDataFrame(rows, "ids binary, weights binary").repartition(3), 30, 8)
    exact = np.linalg.svd(a)[2][:8]
    assert np.linalg.svd(exact @ v)[1].min() > 0.999


def test_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(-1, 6, rng.integers(0, 12)), rng.integers(0, 6, rng.integers(1, 9))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        places = decontaminate.lcs_places(a, b)
        assert len(places) == table[-1, -1]
        it = iter(b)
        assert all(any(a[p] == y for y in it) for p in places)


def test_pipeline_stages(spark):
    """Every stage's decisions take effect, on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "mixing"]
    for name, stage in list(stages.items())[:4]:
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(docs.columns), name
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in stages["quality_rules"](spark, docs, SF).collect()}
    assert all(len((rows[i] or "").encode().split()) >= 50 for i in kept)
    ids = sorted(rows)
    want = brute_copies(ids, [rows[i] for i in ids])
    assert {r["doc_id"] for r in stages["near_dedup"](spark, docs, SF).collect()} == {i for i in ids if want[i] == i}
    final = corpus_pipeline.run(spark, SF).collect()
    assert final and {r["doc_id"] for r in final} <= kept
    assert not any("AKIA" in r["text"] and len(r["text"].split("AKIA")[1].split()[0]) > 14 for r in final)


def test_pipeline_takes_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", None, 0), (900002, "", None, "s", 0), (0, "again", "en", "s", 5)], docs.schema)
    out = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() > 0
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.collect() == []
