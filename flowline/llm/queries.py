"""One query per operator, over whole tables, with production parameters; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation, decontaminate, importance, language_id, license_scan, lm_score, mixing, pii, quality, secret_scan, simhash, spans, url_filter, warc
from .shared import materialise, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is no directory: each document has one of its own, and those of the pages whose article it is, by whose urls licences are inherited."""
    docs, own = _table(spark, sf_dir, "documents"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    docs = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), own, F.lit("text")).alias("path"), "text")
    return license_scan.scan(docs, places=license_scan.page_places(docs, _table(spark, sf_dir, "pages")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "words")
    mixed = mixing.mix(sized, words=F.col("words"))
    return mixed.select("doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), F.col("mix.taken").alias("taken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, key = pii.spans_of(_table(spark, sf_dir, "documents")), F.col("spans")
    base = F.filter(key, lambda s: s["kind"].isin(*pii.KINDS))
    return found.select(
        "doc_id", *[spans.count_kind(key, k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(spans.told(base), 256).alias("base_sha256"), spans.told(key).alias("spans"),
        spans.count_kind(key, "term").alias("n_term"), F.size(F.filter(key, lambda s: (s["kind"] == "term") & (s["value"] == ""))).cast("long").alias("n_removed"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(~language_id.held_out(F.col("doc_id"))).select("text", "lang")
    found = language_id.identify(docs, train)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, key = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(F.col(key), lambda s: s["kind"].isin(*secret_scan.KINDS))
    return found.select(
        "doc_id", *[spans.count_kind(F.col(key), k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(spans.told(base), 256).alias("base_sha256"), spans.told(F.col(key)).alias("spans"), spans.count_kind(F.col(key), "random").alias("n_random"),
    )


#: Rules of op6: host, path prefix, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(_table(spark, sf_dir, "documents"), good)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired."""
    damaged = conversation.damage(_table(spark, sf_dir, "conversations"))
    return conversation.told(conversation.repair(damaged, present=F.col("present")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return importance.ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, folder = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.told(segments, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_lm_score": op10_lm_score,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance": op12_importance,
    "op13_warc": op13_warc,
}

#: CRC-32 in SQL: ``tab`` holds the 256 steps of a byte, and the digest of a text runs over its bytes.
_CRC_TABLE = """tab AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


ORACLE: dict[str, str] = {
    "op11_conversation_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT k.*, {_crc("key")} % 20 AS c FROM k, tab),
d AS (
  SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
n AS (
  SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
f AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM n),
added(a, b, letters, lines, price) AS (
  VALUES (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0),
         (0, 2, 'I', chr(10) || 'user:', 2), (1, 2, 'I', chr(10) || 'user:', 2), (2, 3, 'I', chr(10) || 'assistant:', 2), (3, 2, 'I', chr(10) || 'user:', 2),
         (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4)),
edits(a, letter, ini, b, said, price) AS (
  VALUES (0, 'D', '', 0, '', 3), (1, 'D', '', 1, '', 3), (2, 'D', '', 2, '', 3), (3, 'D', '', 3, '', 3),
         (0, 'K', 's', 1, '', 0), (0, 'K', 'u', 2, '', 0), (1, 'K', 'u', 2, '', 0), (3, 'K', 'u', 2, '', 0), (2, 'K', 'a', 3, '', 0),
         (0, 'R', '', 2, 'user', 2), (1, 'R', '', 2, 'user', 2), (3, 'R', '', 2, 'user', 2), (2, 'R', '', 3, 'assistant', 2)),
walk(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} FROM conversations
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.b, min({{
           'cost': CAST(w.best.cost + x.price + e.price + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END AS BIGINT),
           'audit': w.best.audit || x.letters || e.letter,
           'lines': w.best.lines || x.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || e.said || ':' || f.text END}})
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN added x ON x.a = w.state
       JOIN edits e ON e.a = x.b AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR e.ini = f.ini))
  GROUP BY w.conv_id, w.i, e.b),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
done AS (
  SELECT w.conv_id, any_value(n) AS n, min({{'cost': w.best.cost + x.price, 'audit': w.best.audit || x.letters, 'lines': w.best.lines || x.lines}}) AS best
  FROM walk w LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM w.conv_id JOIN added x ON x.a = w.state AND x.b IN (0, 3)
  WHERE w.i = coalesce(n, 0) GROUP BY w.conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM done LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM done.conv_id
""",
    "op12_importance": f"""
WITH {_CRC_TABLE},
said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words,
         row_number() OVER () AS row FROM documents),
aimed AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
each AS (SELECT row, unnest(words) AS word FROM said),
known AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM each UNION SELECT word FROM aimed), tab),
s AS (SELECT bucket, count(*) AS s FROM each JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aimed JOIN known USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + 10000) / (coalesce(s, 0) + 1)::DOUBLE / ((SELECT count(*) FROM aimed) + 10000))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM each JOIN known USING (word) JOIN gain USING (bucket) GROUP BY row),
noisy AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
  FROM said LEFT JOIN weighed USING (row)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noisy),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM placed
""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS first FROM p),
v AS (SELECT *, list_transform(range(40), lambda k: strpos('0123456789abcdef', substr(hex, k + 1, 1)) - 1) AS four FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((four[5 * g // 4 + 1] * 16 + four[5 * g // 4 + 2]) >> (3 - 5 * g % 4)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS intact
FROM v
""",
    "op6_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages),
parted AS (
  SELECT page_id,
         translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM parted LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
""",
    "op8_mixing": """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM per),
level AS (
  WITH RECURSIVE shared(round, level) AS (
    SELECT 0, sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM weighed
    UNION ALL
    SELECT s.round + 1, (sum(source_size) - coalesce(sum(cap) FILTER (WHERE cap < s.level * weight), 0))::DOUBLE / (sum(weight) FILTER (WHERE cap >= s.level * weight))::DOUBLE
    FROM shared s, weighed WHERE s.round < (SELECT count(*) FROM weighed) GROUP BY s.round)
  SELECT arg_max(level, round) AS level FROM shared),
plan AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w.level * weight) AS target FROM weighed, level w),
rated AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN least(p.target / p.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated
""",
}
