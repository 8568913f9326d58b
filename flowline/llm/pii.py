"""Personal data: fixed patterns plus information-theoretic sanitisation, with DataFrame functions only.

Protected entities are the values that the patterns find (an e-mail address, a phone number ...).
A term discloses an entity as far as it tells that the entity is there: by the pointwise mutual
information of the two over all documents, relative to the entity's information content
(Sanchez and Batet, C-sanitized).  Terms at or above the disclosure threshold are spans of
kind ``term`` in the documents that hold them.  A term is generalised by suppressing its end, as in
k-anonymity: to its longest beginning that tells less than the threshold of every entity the term
discloses.  If even its first letter tells too much, it is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh, materialise, small
from .spans import SPAN, apart, located, matches, redacted

# The patterns of the base kinds.  A local part starts where no character of its class stands before,
# or where the match before ended, and an address where no digit stands before, which is where the plain patterns' leftmost
# matches start too.  Possessive groups match the same here, as nothing follows them, and run in a loop, whatever the text's length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Least share of an entity's information that a term must tell to be disclosing.
DISCLOSURE = 0.9
#: Least number of different texts in which a term and an entity must meet.
SUPPORT = 3
#: Lengths of the beginnings to which a term may be generalised.
BEGINNINGS = (6, 5, 4, 3, 2, 1)
#: A term is a run of letters and digits.
TERM, _NOT_TERM = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def is_ip(m: Column) -> Column:
    """No part above 255, leading zeros aside."""
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def is_card(m: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(m)
    n = F.length(d)

    def term(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        doubled = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when((n - i) % 2 == 1, doubled).otherwise(v)

    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i))
    return F.when(n.between(12, 19), luhn % 10 == 0).otherwise(F.lit(False))


def is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


BASE = (("email", EMAIL, lambda m: F.lit(True), "@"), ("ip", IP, is_ip, "."), ("card", CARD, is_card, None), ("phone", PHONE, is_phone, "+"))


def base_spans(docs: DataFrame, text: Column) -> tuple[DataFrame, str]:
    """``docs`` with an array of the base kinds' spans, and that column's name."""
    names = {kind: fresh(docs, f"pii_{kind}") for kind, *_ in BASE}
    none = F.array().cast("array<string>")
    out = docs.withColumns({names[kind]: F.when(F.contains(text, F.lit(mark)), matches(text, pattern)).otherwise(none) if mark else matches(text, pattern) for kind, pattern, _, mark in BASE})
    key = fresh(docs, "pii_base")
    parts = [F.when(F.size(names[kind]) > 0, located(text, pattern, F.col(names[kind]), kind, rank, keep)).otherwise(F.array().cast(SPAN)) for rank, (kind, pattern, keep, _) in enumerate(BASE)]
    return out.withColumn(key, F.concat(*parts)).drop(*names.values()), key


def entities(spans: Column) -> Column:
    """Distinct protected values, told apart by kind; numbers by their digits, e-mail addresses without case."""
    value = lambda s: F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))
    return F.array_distinct(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), value(s))))


def terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.array_remove(F.transform(F.split(text, _NOT_TERM), F.lower), ""))


def told(n_met: Column, n_term: Column, n_entity: Column, total: int) -> Column:
    """Share of an entity's information that a term tells: their mutual information over the entity's own."""
    return 1 + F.log(n_met / n_term) / F.log(F.greatest(F.lit(float(total)), n_entity + F.lit(1.0)) / n_entity)


def disclosing(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame | None:
    """(term, told, general) of the terms that disclose an entity; ``general`` is what stands for the term, empty if it is removed.

    ``docs`` has copy (a hash of the text) and text; ``found`` has copy, entities and words of every document with an entity.
    Probabilities are over different texts, so copies of one text count once.
    """
    # one row per text with its entities, and with its words, of enough support
    pairs = materialise(found.select("copy", F.explode("entities").alias("entity")).distinct(), "pairs")
    known = materialise(pairs.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "entities")
    if known.isEmpty():
        return None
    total = docs.select("copy").distinct().count()
    # a row of a text that occurs n times weighs 1 / n, so that sums count different texts without bringing them together
    again = materialise(docs.groupBy(F.col("copy").alias("_copy")).agg(F.count("*").alias("_n")).where("_n > 1"), "copies")
    weighed = docs.join(small(again), F.col("copy") == F.col("_copy"), "left").select("text", (1 / F.coalesce("_n", F.lit(1))).alias("weight"))
    held = pairs.join(small(known), "entity").select("copy", "entity", "n_entity")
    # the number of partitions is given, since a short text of words makes many rows and tasks shouldn't be put together before that
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = found.groupBy("copy").agg(F.first("words").alias("words")).repartition(parts, "copy").select("copy", F.explode("words").alias("term"))
    there = words.groupBy("term").agg(F.count("*").alias("n_there")).where(F.col("n_there") >= support)
    # texts with an entity bound the term's probability from below, and no pair meets more often than its entity occurs: what
    # fails here can't pass later, so frequent words are never paired with entities
    able = told(F.col("n_entity"), F.greatest(F.col("n_there"), F.col("n_entity")), F.col("n_entity"), total) >= disclosure
    met = words.join(there, "term").join(held, "copy").where(able).groupBy("entity", "n_entity", "term", "n_there").agg(F.count("*").alias("n_met")).where(F.col("n_met") >= support)
    candidates = materialise(met.where(told(F.col("n_met"), F.col("n_there"), F.col("n_entity"), total) >= disclosure).select("entity", "n_entity", "term", "n_met"), "candidates")
    if candidates.isEmpty():
        return None
    n_term = _texts_with(weighed, candidates.select("term").distinct(), lambda ws: ws).withColumnRenamed("n", "n_term")
    chosen = candidates.join(n_term, "term").withColumn("told", told(F.col("n_met"), F.col("n_term"), F.col("n_entity"), total)).where(F.col("told") >= disclosure)
    chosen = materialise(chosen.select("term", "n_entity", "told"), "disclosing")
    begins = lambda w: F.array(*[F.when(F.length(w) > k, F.substring(w, 1, k)) for k in BEGINNINGS])
    begun = chosen.groupBy("term").agg(F.max("told").alias("told"), F.min("n_entity").alias("least"), F.max("n_entity").alias("most")).withColumn("start", F.explode_outer(F.array_compact(begins(F.col("term")))))
    n_start = _texts_with(weighed, begun.select(F.col("start").alias("term")).where("start is not null").distinct(), lambda ws: F.array_distinct(F.array_compact(F.flatten(F.transform(ws, begins)))))
    rated = begun.join(n_start.select(F.col("term").alias("start"), "n"), "start", "left")
    # at most every text of the entity holds the beginning; that share told falls or rises with the entity's own count, so its ends bound it
    safe = F.greatest(*[told(F.least(F.col(e), F.col("n")), F.col("n"), F.col(e), total) for e in ("least", "most")]) < disclosure
    best = F.max_by("start", F.when(safe, F.length("start")))
    return rated.groupBy("term").agg(F.max("told").alias("told"), F.coalesce(F.concat(best, F.lit("*")), F.lit("")).alias("general"))


def _texts_with(docs: DataFrame, wanted: DataFrame, parts) -> DataFrame:
    """(term, n): in how many different texts each of ``wanted`` (term) is among ``parts`` of the text's terms, by the rows' weights."""
    each = docs.select("weight", F.explode(parts(terms(F.col("text")))).alias("term"))
    return each.join(small(materialise(wanted, "wanted")), "term", "left_semi").groupBy("term").agg(F.round(F.sum("weight")).alias("n"))


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, text, copy) of whole-number ids; texts are told apart by 128 bits of a digest."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.withColumn("copy", _identity(F.col("text")))


def _identity(text: Column) -> Column:
    return F.unhex(F.md5(text))


def spans_of(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``.

    Kinds are email, ip, card and phone (fixed patterns; matches that fail their check are dropped),
    then term (the method's additions, where they overlap no base span; their ``value`` is what stands for them).
    Null and empty texts have no spans; rows without a doc_id have theirs like any other; repeated rows get equal spans;
    ties in start are ordered by kind; an empty table gives no rows; other columns are ignored.
    The patterns run over every text once; texts are read again for terms only if an entity is in enough texts.
    """
    return _spans(_marked(docs, text_col), disclosure, support)


def _spans(marked: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The same of rows (doc_id, text, copy)."""
    based, key = base_spans(marked, F.col("text"))
    base = materialise(based.select("doc_id", "copy", F.col(key).alias("base"), F.when(F.size(key) > 0, terms(F.col("text"))).alias("words")), "base")
    chosen = disclosing(marked.where("text is not null"), base.where(F.size("base") > 0).select("copy", entities(F.col("base")).alias("entities"), "words"), disclosure, support)
    if chosen is None:
        return base.select("doc_id", F.col("base").alias("spans"))
    chosen = small(materialise(chosen.select(F.col("term").alias("_term"), "general"), "chosen"))
    # only texts that hold a chosen term are cut into spans, copies of a text once, and only its own chosen terms are kept
    texts = marked.where("text is not null")
    places = texts.select("copy", F.explode(terms(F.col("text"))).alias("_term")).join(chosen, "_term").select(F.col("copy").alias("_copy"), "_term", "general").distinct()
    places = places.groupBy("_copy").agg(F.map_from_entries(F.collect_list(F.struct("_term", "general"))).alias("own"))
    near = texts.join(small(materialise(places, "places")), F.col("copy") == F.col("_copy")).dropDuplicates(["copy"])
    spans = located(F.col("text"), TERM, matches(F.col("text"), TERM), "term", len(KINDS), lambda m: F.col("own")[F.lower(m)].isNotNull())
    hits = near.select("_copy", F.transform(spans, lambda s: s.withField("value", F.col("own")[F.lower(s["value"])])).alias("found"))
    hits = materialise(hits, "term-spans")
    added = apart(F.col("base"), F.coalesce("found", F.array().cast(SPAN)), len(KINDS))
    joined = base.join(small(hits), F.col("copy") == F.col("_copy"), "left")
    return joined.select("doc_id", F.concat("base", added).alias("spans"))


def find(docs: DataFrame, text_col: str = "text", **how) -> tuple[DataFrame, str]:
    """``docs`` with one array column of spans as :func:`spans_of` has them, whose name is returned too.

    Other columns pass through, and the new column's name avoids theirs.
    """
    text, copy, name = F.col(text_col), fresh(docs, "pii_copy"), fresh(docs, "pii")
    marked = docs.select(_identity(text).alias("doc_id"), text.alias("text"), _identity(text).alias("copy")).where(text.isNotNull())
    found = _spans(marked, **how).where(F.size("spans") > 0)
    per_text = small(materialise(found.groupBy(F.col("doc_id").alias(copy)).agg(F.first("spans").alias(name)), "spans"))
    joined = docs.join(per_text, _identity(text) == per_text[copy], "left").drop(copy)
    return joined.withColumn(name, F.coalesce(name, F.array().cast(SPAN))), name


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every base span replaced by its kind in brackets, as ``[EMAIL]``, and terms by their beginning and ``*``, or removed; columns are as given."""
    found, key = find(docs, text_col, **how)
    return found.withColumn(text_col, redacted(F.col(text_col), F.col(key), lambda s: F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).drop(key)
