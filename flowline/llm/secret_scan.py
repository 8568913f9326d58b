"""Secret scans: fixed patterns plus character Markov models, with DataFrame functions only.

Two first-order Markov models, of random strings and of ordinary identifiers, are
counted from labelled samples.  A token whose log-likelihood ratio passes the threshold, as a mean per
transition and as a sum, is a secret of kind ``random``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import fresh
from .spans import SPAN, apart, located, matches, redacted

# The patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

#: Tokens that the Markov models judge: runs of the characters of keys and passwords, of every length from which a sum can pass.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}"
#: Mean log-likelihood ratio per transition, in nats, from which a token counts as random.
THRESHOLD = 0.35
#: Least sum of the ratios, so that a short token needs a higher mean than a long one.
TOTAL = 12.0
#: Characters are told apart as these classes of one; any other character is ``~``.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+_=-/."

# Words of which ordinary identifiers are made.
WORDS = (
    "get set is has add remove find list map user name file path index count value key type node tree data table row column "
    "page item order client server request response error status message config option session cache buffer stream reader writer "
    "parser handler factory manager builder service process thread queue event time date version number string array object class "
    "method field test main update create delete open close start stop init load save read write send receive check valid default "
    "next first last width height size color image text line word char byte hash sort search filter merge split join"
).split()

# Common words of several languages, which are put together for the letters' ordinary transitions.
COMMON = (
    "the and that have for not with you this but from they which would there their what about when make like time just know people into "
    "year your good some could them other than then look only come over think also back after work even want because these give day most "
    "through thought should enough high light knowledge write wrong quick question example zero extra judge anything whether much years "
    "und der die das nicht ist mit auf für eine auch nach bei aus wird oder durch schon noch zwischen sprechen schreiben geschwindigkeit "
    "begrenzung wirtschaft gesellschaft verantwortung zeitung pflanze kopf pferd dampf schutz platz gesetz wichtig möglich zurück jetzt "
    "herbst kunst fenster versprechen entscheidung heit keit lich ung recht brauch kraft "
    "les des est une dans que pour qui sur pas avec sont mais comme tout elle nous vous leur bien cette même oui aux deux eux ceux heureux "
    "beau eau oiseau travaux nouvelle aujourd question quelque toujours feuille oeil soleil ouvrir raison maison voiture naturellement "
    "los las del por con para una como más pero sus este también hasta donde quien desde nos durante todos uno muchos año ciudad hijo "
    "hecho ejercicio mejor lluvia guerra noche leche viaje izquierda universidad gobierno trabajo siempre ella "
    "che della sono anche loro questo quando gli più oggi degli nella perché molto prezzo piazza ragazzo figlio bagno occhio acqua"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(token, random): strings from digests in base64 and hex, and identifiers, paths, URLs, dates and numbers.

    Both come from a rule over row numbers; a table of one's own samples may stand in for it.
    """
    rows = spark.range(n)
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    base64 = F.regexp_replace(F.base64(digest("b")), "[\r\n]", "")
    random = rows.select(F.explode(F.array(base64, F.lower(F.hex(digest("h"))), F.upper(F.substring(F.regexp_replace(F.base64(digest("u")), "[^A-Za-z0-9]", ""), 1, 24)))).alias("token"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    digits = F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100)).cast("string")).otherwise("")
    common = F.array(*[F.lit(w) for w in COMMON])
    word = lambda k: F.element_at(common, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(COMMON))) + 1).cast("int"))
    number = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000000))
    styles = [
        *[F.concat(*[word(k * 4 + j) for j in range(20, 24)], F.lit(".")) for k in range(4)],
        F.concat(*[F.initcap(word(k)) for k in range(40, 44)]),
        F.upper(F.concat_ws("-", *[word(k) for k in range(44, 47)])),
        F.concat(F.lit("//en.wikipedia.org/wiki/"), F.initcap(word(47)), F.lit("_"), F.initcap(word(48)), F.lit("_"), F.initcap(word(49))),
        F.concat(F.concat_ws("_", pick(1), pick(2), pick(3)), digits),
        F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4)), digits),
        F.concat(F.upper(F.concat_ws("_", pick(5), pick(6), pick(7))), digits),
        F.concat_ws("-", pick(2), pick(4), pick(6), F.when(digits != "", digits)),
        F.concat(F.lit("/"), F.concat_ws("/", pick(1), pick(3), pick(5)), F.lit("."), F.substring(pick(7), 1, 3)),
        F.concat(F.lit("//www."), pick(8), F.lit(".com/"), pick(2), F.lit("/"), F.concat_ws("-", pick(4), pick(6)), F.lit(".html")),
        F.concat(F.concat_ws(".", pick(3), pick(5), F.initcap(pick(7))), digits),
        F.concat(F.concat_ws("=", pick(4), number(10)), F.lit("."), F.initcap(pick(9)), F.lit("...")),
        F.concat_ws("-", (F.pmod(number(11), F.lit(130)) + 1900).cast("string"), F.lpad((F.pmod(number(12), F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(number(13), F.lit(28)) + 1).cast("string"), 2, "0")),
        F.concat_ws(".", number(14).cast("string"), number(15).cast("string"), number(16).cast("string")),
    ]
    return random.unionByName(rows.select(F.explode(F.array(*styles)).alias("token"), F.lit(False).alias("random")))


def _places(token: Column) -> Column:
    """Numbers in the alphabet of a token's characters, from 0; any other character is the last.  Takes time in proportion to the length."""
    table = F.from_json(F.lit(json.dumps([ALPHABET.find(chr(i)) if chr(i) in ALPHABET else len(ALPHABET) for i in range(128)])), "array<int>")
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(len(ALPHABET))))


def _pairs(token: Column) -> Column:
    """One number for each transition between two characters."""
    return _stepped(_places(token))


def _stepped(places: Column) -> Column:
    n = F.greatest(F.size(places) - 1, F.lit(0))
    return F.zip_with(F.slice(places, F.lit(1), n), F.slice(places, F.lit(2), n), lambda a, b: a * (len(ALPHABET) + 1) + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every transition between two characters, row by row of the alphabet.

    Counts are one group-by; the result is bounded by the square of the alphabet.
    Add-one smoothing covers transitions without a sample; without samples every ratio is 0.
    """
    counted = samples.where(F.length("token") >= 2).select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(F.sum(F.col("random").cast("long")).alias("r"), F.sum((~F.col("random")).cast("long")).alias("o"))
    seen = {row["pair"]: (row["r"], row["o"]) for row in counted.collect()}
    width, ratios = len(ALPHABET) + 1, []
    for a in range(width):
        r_all, o_all = (sum(seen.get(a * width + b, (0, 0))[k] for b in range(width)) + width for k in (0, 1))
        for b in range(width):
            r, o = seen.get(a * width + b, (0, 0))
            ratios.append(math.log((r + 1) / r_all) - math.log((o + 1) / o_all))
    return ratios


def ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token of two characters or more.

    The table is one folded literal, read by index.
    """
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    return F.aggregate(F.array(_pairs(token)), F.lit(0.0), lambda _, pairs: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p)) / F.size(pairs))


def scan(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one array column of spans, whose name is returned too.

    Kinds are assign, access and hex (fixed patterns), then random (the models' additions, where
    they overlap no base span).  Null and empty texts have no spans; ties in start are ordered by kind;
    repeated rows get equal spans; an empty table stays empty; other columns pass through, and
    the new column's name avoids theirs.
    """
    ratios = train(samples if samples is not None else labelled_samples(docs.sparkSession))
    text = F.col(text_col)
    names = {k: fresh(docs, f"secret_{k}") for k in ("assign", "value", "access", "hex", "token", "base")}
    out = docs.withColumns({names["assign"]: matches(text, ASSIGN), names["value"]: F.coalesce(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), F.array().cast("array<string>")), names["access"]: matches(text, ACCESS), names["hex"]: matches(text, HEX), names["token"]: matches(text, TOKEN)})
    assign, values = F.col(names["assign"]), F.col(names["value"])
    # a match's value is its longest tail of value characters, so its length decides without the position
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    some = lambda c: F.size(c) > 0
    nothing = F.array().cast(SPAN)
    base = F.concat(
        F.when(F.exists(values, lambda v: F.length(v) >= 12), located(text, ASSIGN, assign, "assign", 0, long_enough)).otherwise(nothing),
        F.when(some(F.col(names["access"])), located(text, ACCESS, F.col(names["access"]), "access", 1, lambda m: F.length(m) >= 18)).otherwise(nothing),
        F.when(some(F.col(names["hex"])), located(text, HEX, F.col(names["hex"]), "hex", 2)).otherwise(nothing),
    )
    out = out.withColumn(names["base"], base)
    passes = lambda m: F.aggregate(F.array(ratio(m, ratios)), F.lit(False), lambda _, r: (r >= threshold) & (r * (F.length(m) - 1) >= TOTAL))
    random = F.when(
        some(F.col(names["token"])),
        apart(F.col(names["base"]), located(text, TOKEN, F.col(names["token"]), "random", 3, passes), 3),
    ).otherwise(nothing)
    key = fresh(docs, "secrets")
    return out.withColumn(key, F.concat(F.col(names["base"]), random)).drop(*names.values()), key


def redact(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[SECRET]``; columns are as given."""
    found, key = scan(docs, text_col=text_col, **how)
    return found.withColumn(text_col, redacted(F.col(text_col), F.col(key), lambda s: F.lit("[SECRET]"))).drop(key)
