"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``radius`` bits share at least one variant that lies
within half the radius of both.  So every distinct fingerprint emits all variants in
that ball (2081 of them for radius 4), variants are shuffled, and fingerprints which
meet on a variant are linked.

The shuffle is packed.  Variants are dealt to buckets by a linear hash (the syndrome
of a binary code), so that bucket(fp ^ mask) = bucket(fp) ^ bucket(mask): all variants
of one fingerprint which fall in one bucket are told by the fingerprint alone, and a
block of fingerprints stands for its variants there.  The reducer writes the variants
out, sorts them, and links runs of equal ones.  A run of m fingerprints yields at most
m - 1 links (a star, thinned to a spanning forest per bucket), never all pairs.

The number of buckets grows with the number of fingerprints so that a bucket's variants
are a bounded number; beyond that, a bucket is worked off in slices of a second linear
hash.  A fingerprint is copied to at most 2081 buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected, forest, spanning
from .shared import drop_documents, materialise, small

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Where documents are deduplicated: families of 64-bit fingerprints, bits at either end of each that are searched, the radius
#: there, bits of the whole fingerprint that may differ, and words of a shingle.
FAMILIES, STAGE_BITS, STAGE_RADIUS, STAGE_WHOLE, STAGE_WORDS = 16, 36, 2, 16, 5
#: Share of all families' bits in which a linked pair may differ: a half for unrelated texts, 0.151 at a similarity of 0.8 and
#: 0.192 at 0.7, with a standard error of 0.011.
APART = 0.165
#: Least binary logarithm of the number of buckets of each family's end; there are 32 of these.
STAGE_BUCKET_BITS = 0
#: Least binary logarithm of the number of buckets, and variants that a bucket should hold.
MIN_BUCKET_BITS, BUCKET_VARIANTS = 7, 1 << 24
#: Variants that a reducer holds at once.
SLICE_VARIANTS = 1 << 21
#: Pairs of texts that the second search of parted groups compares at once.
PAIRS = 1 << 18
#: Fingerprints in a shuffled block.
BLOCK = 1 << 13
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(text: bytes | None, families: int = 1, shingle_words: int = SHINGLE_WORDS, block: int = 1 << 16) -> list[int]:
    """SimHashes of a UTF-8 text: bit set where more than half of the shingles' hashes have it; 0 without words.

    Shingles are hashed in blocks, so memory is bounded by the text and not by 64 times its words.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return [0] * families
    count = max(1, len(words) - shingle_words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    bits = np.zeros((families, 64), np.int64)
    for at in range(0, count, block):
        hashes = np.fromiter((digest(join(words[i : i + shingle_words]), SEED) for i in range(at, min(at + block, count))), np.uint64)
        for k in range(families):
            bits[k] += _bit_counts(family(hashes, k))
    return np.packbits(bits * 2 > count, axis=1, bitorder="little").view(np.uint64).reshape(-1).tolist()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; eight counters of a byte are added at once, over 255 hashes at most."""
    bytewise = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    return np.add.reduceat(bytewise, np.arange(0, len(bytewise), 255), axis=0).view(np.uint8).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS, block: int = 1 << 16) -> int:
    """The first family's fingerprint."""
    return fingerprints(text, 1, shingle_words, block)[0]


def family(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th family's hashes of the same shingles; the first is the hashes themselves."""
    if not k:
        return hashes
    x = hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_fingerprints(docs: DataFrame, families: int, shingle_words: int, text_col: str = "text") -> DataFrame:
    """(doc_id, fps): several families' fingerprints of each row, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprints(t.as_py(), families, shingle_words) for t in b.column(1)], np.uint64).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * families, pa.array(found))], names=["doc_id", "fps"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fps array<long>")


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, fingerprint as a signed long) of each row; the fingerprint's column name is returned too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long"), "fp"


def ball(radius: int, bits: int = 64) -> np.ndarray:
    """All masks of at most ``radius`` set bits."""
    one = [1 << i for i in range(bits)]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(one, r)], np.uint64)


def _columns(seed: int) -> np.ndarray:
    """64 odd-looking 24-bit columns, the linear hash's matrix; fixed by the seed."""
    return np.random.default_rng(seed).integers(1, 1 << 24, 64, dtype=np.uint32)


def syndrome(values: np.ndarray, columns: np.ndarray, bits: int) -> np.ndarray:
    """Linear hash of 64-bit values to ``bits`` bits: syndrome(a ^ b) = syndrome(a) ^ syndrome(b)."""
    out = np.zeros(len(values), np.uint32)
    for i in range(64):
        out ^= (((values >> np.uint64(i)) & np.uint64(1)).astype(np.uint32)) * columns[i]
    return out & np.uint32((1 << bits) - 1)


def _by_syndrome(masks: np.ndarray, columns: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    keys = syndrome(masks, columns, bits)
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return {int(keys[g[0]]): masks[g] for g in np.split(order, cuts)}


def _runs(fps: np.ndarray, bucket: int, bits: int, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variants in order, their fingerprints' positions) of a bucket, in slices of bounded size; equal variants are in one slice."""
    columns, second = _columns(1), _columns(2)
    table = _by_syndrome(masks, columns, bits)
    home = syndrome(fps, columns, bits) ^ np.uint32(bucket)
    average = len(fps) * len(masks) / (1 << bits)
    cut = max(0, int(np.ceil(np.log2(max(1.0, average / SLICE_VARIANTS)))))
    side = syndrome(fps, second, cut) if cut else np.zeros(len(fps), np.uint32)
    groups = []  # (fingerprints' positions, their masks in this bucket, those masks' second hash)
    order = np.argsort(home, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
        if (m := table.get(int(home[g[0]]))) is not None:
            groups.append((g, m, syndrome(m, second, cut) if cut else np.zeros(len(m), np.uint32)))
    for part in range(1 << cut):
        values, owners = [], []
        for g, m, s in groups:
            for mask, key in zip(m, s):
                who = g if not cut else g[side[g] == (key ^ np.uint32(part))]
                values.append(fps[who] ^ mask)
                owners.append(who)
        if values:
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            yield v[order], o[order]


def _bucket_links(entries: np.ndarray, bucket: int, bits: int, masks: np.ndarray, radius: int, width: int = 64, whole: int | None = None, apart: int | None = None) -> np.ndarray:
    """Links that meet in a bucket, in slices of bounded size.

    Entries are fingerprints (n, 1), and links are pairs of them: a spanning forest of stars, or with ``whole`` one of pairs, by the bits
    in which they differ. Or entries have a label, an id and perhaps a text's vector too: see :func:`_label_links`.
    """
    if entries.shape[1] > 1:
        return _label_links(entries, bucket, bits, masks, width, whole, apart)
    whole_fps = np.unique(entries)
    fps = whole_fps & np.uint64((1 << width) - 1)
    links = np.empty((0, 2), np.int64)
    for v, o in _runs(fps, bucket, bits, masks):
        same = np.flatnonzero(v[1:] == v[:-1])  # neighbours in a run of equal variants: that joins all who meet there
        pairs = np.unique(np.stack([o[same], o[same + 1]], 1), axis=0)
        # two that share a variant differ in twice half the radius at most; a wrong link would join whole components
        pairs = pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius]
        links = np.concatenate([links, pairs])
        links = forest(links) if whole is None else spanning(links, np.bitwise_count(whole_fps[links[:, 0]] ^ whole_fps[links[:, 1]]))
    return whole_fps[links.reshape(-1)].reshape(-1, 2)


def _label_links(entries: np.ndarray, bucket: int, bits: int, masks: np.ndarray, width: int, whole: int, apart: int | None) -> np.ndarray:
    """Links between labels of texts that meet in a bucket and differ in at most ``whole`` bits of their fingerprints.

    Entries are (fingerprint, label, id), and links are all pairs of ids. Or the texts' vectors of fingerprints follow, and links are labels joined by
    pairs whose vectors differ in at most ``apart`` bits: a forest of stars, so fewer than there are labels. Every pair of two labels that meets is
    compared, ``PAIRS`` at once, unless its labels are joined already. At most as many different fingerprints as there are masks share a variant.
    """
    ends_of = entries[:, 0] & np.uint64((1 << width) - 1)
    entries = entries[np.argsort(ends_of, kind="stable")]
    fps, size = np.unique(ends_of, return_counts=True)
    begin = np.cumsum(size) - size
    names, label = np.unique(entries[:, 1], return_inverse=True)
    vectors, root, links = entries[:, 3:], np.arange(len(names)), [np.empty((0, 2), np.uint64)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        least, most = np.minimum.reduceat(root[label], begin), np.maximum.reduceat(root[label], begin)
        several = np.minimum(least[a], least[b]) != np.maximum(most[a], most[b])
        a, b = a[several], b[several]
        ends = np.cumsum(size[a] * size[b])
        for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            place = np.arange(at, min(at + PAIRS, int(ends[-1])))
            k = np.searchsorted(ends, place, "right")
            inside = place - ends[k] + size[a[k]] * size[b[k]]
            u, v = begin[a[k]] + inside // size[b[k]], begin[b[k]] + inside % size[b[k]]
            wanted = root[label[u]] != root[label[v]]
            u, v = u[wanted], v[wanted]
            wanted = np.bitwise_count(entries[u, 0] ^ entries[v, 0]) <= whole
            u, v = u[wanted], v[wanted]
            if apart is None:
                links.append(np.unique(np.sort(np.stack([entries[u, 2], entries[v, 2]], 1), axis=1), axis=0))
                continue
            near = np.bitwise_count(vectors[u] ^ vectors[v]).sum(1, dtype=np.int64) <= apart
            joined = forest(np.stack([root[label[u[near]]], root[label[v[near]]]], 1))
            if len(joined):
                links.append(names[joined])
                new = np.arange(len(names))
                new[joined[:, 1]] = joined[:, 0]
                root = new[root]

    # texts of one fingerprint meet on itself, in one bucket
    alike = np.flatnonzero((size > 1) & (syndrome(fps, _columns(1), bits) == bucket))
    compare(alike, alike)
    for v, o in _runs(fps, bucket, bits, masks):
        for step in range(1, len(masks)):
            same = np.flatnonzero(v[step:] == v[:-step])
            if not len(same):
                break
            compare(*np.unique(np.stack([o[same], o[same + step]], 1), axis=0).T)
    return np.unique(np.concatenate(links), axis=0)


def linked(fps: DataFrame, radius: int = RADIUS, width: int = 64, whole: int | None = None, least_bits: int | None = None, apart: int | None = None) -> DataFrame:
    """Links (family, u, v) that span the components of fingerprints ``fp`` joined by steps of at most ``radius`` bits, in each ``family`` by itself.

    Colliding pairs are deduplicated and verified in every bucket, then thinned to a forest of stars, so u and v are in one
    component but need not be neighbours themselves.  ``fps`` has one row per family (0 without that column) and distinct fingerprint;
    its lowest ``width`` bits are searched.  With ``whole``, links are pairs that meet, so that they can be verified further: in every
    bucket a minimum spanning forest by how many of all bits they differ in.  ``least_bits``: least binary logarithm of the number of
    buckets (``MIN_BUCKET_BITS``).

    If ``fps`` also has longs ``label`` and ``id``, it may have several rows with one fingerprint, and u and v are ids: all pairs of two labels
    that meet and differ in ``whole`` of all bits at most.  With ``apart`` it has texts' vectors ``fps`` too, and u and v are labels, which pairs join whose
    vectors differ in so many bits at most: in every bucket fewer than it has labels, since only pairs that join two are handed on.
    """
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("the radius must be even: both sides meet at half of it")
    masks = ball(half, width)
    fps = fps if "family" in fps.columns else fps.withColumn("family", F.lit(0))
    carried = [F.col(c) for c in (["fp", "label", "id"] if "label" in fps.columns else ["fp"])]
    if apart is not None:
        carried += [F.col("fps")[k].alias(f"v{k}") for k in range(fps.select(F.max(F.size("fps"))).first()[0] or 0)]
    columns_held = len(carried)
    most = fps.groupBy("family").count().agg(F.max("count")).first()[0] or 0
    bits = min(24, max(MIN_BUCKET_BITS if least_bits is None else least_bits, int(np.ceil(np.log2(max(1, most * len(masks) / BUCKET_VARIANTS))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(1)
        known = np.array(sorted(_by_syndrome(masks, columns, bits)), np.uint32)
        held: dict[int, list[np.ndarray]] = {}

        def blocks(family: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            home = syndrome(values[:, 0] & np.uint64((1 << width) - 1), columns, bits)
            if len(known) == 1 << bits:  # every fingerprint has variants in every bucket
                yield batch(family, range(1 << bits), [values.tobytes()] * (1 << bits))
                return
            bucket = (home[:, None] ^ known[None, :]).reshape(-1)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cuts)
            for at in range(0, len(groups), 4096):
                part = groups[at : at + 4096]
                yield batch(family, [int(bucket[g[0]]) for g in part], [values[g // len(known)].tobytes() for g in part])

        def batch(family, buckets, blobs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([family] * len(blobs), pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["family", "bucket", "fps"])

        for b in batches:
            of, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            values = np.stack(rest, 1).view(np.uint64)
            for family in np.unique(of).tolist():
                mine = held.setdefault(family, [])
                mine.append(values[of == family])
                while sum(map(len, mine)) >= BLOCK:
                    whole = np.concatenate(mine)
                    mine[:] = [whole[BLOCK:]]
                    yield from blocks(family, whole[:BLOCK])
        for family, mine in held.items():
            if len(left := np.concatenate(mine)):
                yield from blocks(family, left)

    def meet(table: pa.Table) -> pa.Table:
        family, bucket = table.column("family")[0].as_py(), table.column("bucket")[0].as_py()
        entries = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("fps")]).reshape(-1, columns_held)
        found = _bucket_links(entries, bucket, bits, masks, radius, width, whole, apart).view(np.int64)
        return pa.table({"family": pa.array(np.full(len(found), family, np.int32)), "u": found[:, 0], "v": found[:, 1]})

    return fps.select(F.col("family").cast("int").alias("family"), *carried).mapInArrow(deal, "family int, bucket int, fps binary").groupBy("family", "bucket").applyInArrow(meet, "family int, u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Null and wordless texts have fingerprint 0 and link like any other; texts shorter
    than a shingle are one shingle; repeated rows give repeated results; a null id has
    the component of its fingerprint, named by the smallest id there (null if none has
    one); an empty table gives no rows; other columns are ignored.
    """
    prints, _ = with_fingerprint(docs)
    prints = materialise(prints, "fingerprints")
    # one row per distinct fingerprint, with the smallest id that has it
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    links = materialise(linked(distinct, radius).select("u", "v").distinct(), "links")
    roots = connected(links)  # (node, root), only nodes with a link
    lows = roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("low").alias("root_low"))
    low = roots.join(lows, "root").select(F.col("node"), "root_low")
    named = materialise(distinct.join(low, distinct["fp"] == low["node"], "left").select("fp", F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("root_low")).alias("component_id")), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: Column) -> Column:
    """16 lower-case hex digits of a fingerprint held as a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_copies(docs: DataFrame, families: int = FAMILIES, shingle_words: int = STAGE_WORDS) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` with an id: the smallest id that links reach.

    One short fingerprint sees a pair of similarity 0.8 within two bits at about every thirteenth draw; both ends of several
    families' fingerprints over the same shingles are as many draws, each searched by ball hashing.  A minimum spanning
    forest of the pairs that meet, for each end, is verified: a pair is linked if it differs in no more than ``APART`` of all families' bits, which estimates the similarity
    with a standard error of 0.025.  Where all verified pairs of a group of texts that met are linked, thinning has lost nothing; texts of the other
    groups are searched again, labelled by what is linked so far, and every pair of two labels that meets is verified where it meets.  Rows without an id are left out; null and wordless texts are copies of each other;
    an empty table gives no rows.
    """
    prints = materialise(with_fingerprints(docs.where("doc_id is not null"), families, shingle_words), "fingerprints")
    same = materialise(prints.groupBy("fps").agg(F.min("doc_id").alias("low")), "distinct")  # one row per different vector of fingerprints
    turned = F.transform("fps", lambda x: F.shiftleft(x, STAGE_BITS).bitwiseOR(F.shiftrightunsigned(x, 64 - STAGE_BITS)))
    each = same.select("low", F.posexplode(F.concat("fps", turned)).alias("family", "fp"))
    held = materialise(each.groupBy("family", "fp").agg(F.min("low").alias("rep"), F.max("low").alias("last")), "families")
    # texts that share a whole fingerprint: each is paired with the least of them
    shared = held.where("last <> rep").select("family", "fp", "rep")
    alike = each.join(shared, ["family", "fp"]).where("low <> rep").select(F.col("low").alias("u"), F.col("rep").alias("v"), F.lit(True).alias("fits"))
    near = linked(held.select("family", "fp"), STAGE_RADIUS, STAGE_BITS, STAGE_WHOLE, STAGE_BUCKET_BITS)
    near = materialise(near.distinct(), "near")
    near = near.join(held.select("family", F.col("fp").alias("u"), F.col("rep").alias("a")), ["family", "u"]).join(held.select("family", F.col("fp").alias("v"), F.col("rep").alias("b")), ["family", "v"])
    # pairs too far apart join those who may be linked by others: they count for the groups only
    near = near.select("a", "b", (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= STAGE_WHOLE).alias("fits"))
    judged = materialise(_verified(alike.union(near), same, families), "judged")
    # texts joined by linked pairs, and by all verified pairs; the latter groups hold every text that thinning may have parted
    roots, met = materialise(connected(judged.where("near")), "roots"), materialise(connected(judged), "met")
    labels = met.select("node", F.col("root").alias("met")).join(roots, "node", "left").select("node", "met", F.coalesce("root", "node").alias("label"))
    parted = small(materialise(labels.groupBy("met").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("met"), "parted"))
    labels = labels.join(parted, "met").select("node", "label")
    again = materialise(same.join(labels, same["low"] == labels["node"]).select("label", "fps"), "again").select("label", F.col("label").alias("id"), "fps", F.posexplode(F.concat("fps", turned)).alias("family", "fp"))
    joined = connected(linked(again, STAGE_RADIUS, STAGE_BITS, STAGE_WHOLE, STAGE_BUCKET_BITS, int(APART * 64 * families)).select("u", "v"))
    roots = same.select("low").join(roots, F.col("low") == F.col("node"), "left").select("low", F.coalesce("root", "low").alias("root"))
    roots = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("low", F.coalesce("least", "root").alias("component_id"))
    named = same.join(roots, "low").select("fps", "component_id")
    return prints.join(named, "fps").select("doc_id", "component_id")


def _verified(pairs: DataFrame, same: DataFrame, families: int) -> DataFrame:
    """(u, v, near) of each different pair of ids (u, v, fits): whether it fits and their vectors of fingerprints differ in at most ``APART`` of all bits."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "fits").where("u <> v").groupBy("u", "v").agg(F.max("fits").alias("fits"))
    of = lambda end: same.select(F.col("low").alias(end), F.col("fps").alias(f"of_{end}"))
    differ = F.aggregate(F.zip_with("of_u", "of_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, n: acc + n)
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", (F.col("fits") & (differ <= int(APART * 64 * families))).alias("near"))


def deduplicate(docs: DataFrame, families: int = FAMILIES, shingle_words: int = STAGE_WORDS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id; columns are as given.

    Rows that share an id are one document: if the kept ids repeat, one row of each stays.  Rows without an id stay.
    """
    near = materialise(near_copies(docs, families, shingle_words), "near")
    kept = drop_documents(docs, near.where("doc_id <> component_id").select("doc_id"))
    ids = near.where("doc_id = component_id").select("doc_id")
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
