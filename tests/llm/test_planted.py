"""Secrets and disclosing terms planted in the texts of a table: what the dealt methods find beyond the fixed patterns, and what they leave alone."""

import random
import string

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowline.llm import pii, secret_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    """{doc_id: text} of all documents with ten words or more."""
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] for r in table if r["text"] and len(r["text"].split()) >= 10}


def with_words(rng, text, words):
    """``text`` with each of ``words`` at a place of its own between two words."""
    parts = text.split(" ")
    for w in words:
        parts.insert(rng.randrange(len(parts) + 1), w)
    return " ".join(parts)


# alphabets and lengths of keys that no fixed pattern finds by itself
STYLES = {
    "letters and digits, 20": (string.ascii_letters + string.digits, 20), "letters and digits, 32": (string.ascii_letters + string.digits, 32), "base64, 40": (string.ascii_letters + string.digits + "+/", 40),
    "url-safe, 43": (string.ascii_letters + string.digits + "-_", 43), "upper-case hex, 32": ("0123456789ABCDEF", 32), "lower-case and digits, 24": (string.ascii_lowercase + string.digits, 24),
}


def test_planted_keys_are_found_and_ordinary_texts_left_alone(spark, texts):
    """Held out: keys of a generator that the models haven't seen, in texts that they haven't seen. At least 0.9 of every style are found whole; no text without a key gets one."""
    rng = random.Random(41)
    rows, planted = [], {}
    for k, (doc, text) in enumerate(sorted(texts.items())):
        if k % 2:
            style = rng.choice(list(STYLES))
            letters, n = STYLES[style]
            planted[doc] = style, "".join(rng.choice(letters) for _ in range(n))
            text = with_words(rng, text, [planted[doc][1]])
        rows.append((doc, text))
    found, key = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    hits = {r["doc_id"]: r["found"] for r in found.select("doc_id", F.filter(key, lambda s: s["kind"] == "random")["value"].alias("found")).collect()}
    assert {d: v for d, v in hits.items() if v and d not in planted} == {}
    assert all(set(hits[d]) <= {token} for d, (_, token) in planted.items())
    for style in STYLES:
        own = [(d, token) for d, (s, token) in planted.items() if s == style]
        assert len(own) > 20 and sum(hits[d] == [token] for d, token in own) >= 0.9 * len(own), style


def test_planted_terms_are_found_and_others_left_alone(spark, texts):
    """Forty people, each with an address in four texts: a name that stands nowhere else discloses it, a word that is in many other texts doesn't, nor does a name met twice only."""
    rng = random.Random(42)
    ids = sorted(texts)
    rng.shuffle(ids)
    rows, named, plain, rare = dict(texts), {}, set(), set()
    for k in range(40):
        own = ids[k * 14 : k * 14 + 14]
        name, common, seldom = (w + "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for w in "qxj")
        for at, doc in enumerate(own):
            words = [common]
            if at < 4:
                words += [f"p{k}@mail{k}.example", name]
                named.setdefault(name, set()).add(doc)
            if at < 2:
                words.append(seldom)
            rows[doc] = with_words(rng, rows[doc], words)
        plain.add(common)
        rare.add(seldom)
    assert len(ids) >= 40 * 14
    df = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    terms = F.filter("spans", lambda s: s["kind"] == "term")
    met = {}
    for r in pii.spans_of(df).select("doc_id", terms.alias("terms")).collect():
        for s in r["terms"]:
            met.setdefault(rows[r["doc_id"]][s["start"] : s["end"]].lower(), set()).add(r["doc_id"])
    assert sum(met.get(n) == docs for n, docs in named.items()) >= 0.9 * len(named)
    assert not met.keys() & (plain | rare)
    assert len(met.keys() - named.keys()) <= 0.05 * len(named)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for name in met.keys() & named.keys():
        for doc in named[name]:
            assert name not in clean[doc] and "@mail" not in clean[doc]
    untouched = [d for d in ids[40 * 14 :] if not any(d in docs for docs in met.values())]
    assert untouched and all(clean[d] == texts[d] for d in untouched if "[" not in clean[d])
