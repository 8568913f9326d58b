"""Character spans of regular-expression matches, with SQL functions only.

Spans are structs (start, end, kind, rank): code points, end exclusive; ``rank`` orders kinds
that start at the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:bigint,end:bigint,kind:string,rank:int,value:string>>"
#: Prefix sums are taken in runs of this many elements, so that n matches cost n * RUN and not n * n.
RUN = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], first: Column) -> Column:
    """Inclusive running results of ``step`` over an array of longs, from ``first``, with which ``step`` changes nothing."""
    within = lambda part: F.aggregate(part, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), first), x))))

    def joined(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: within(F.slice(v, i * RUN + 1, RUN)))
        return F.aggregate(
            runs,
            F.struct(first.alias("base"), F.array().cast("array<array<bigint>>").alias("parts")),
            lambda acc, part: F.struct(step(acc["base"], F.try_element_at(part, F.lit(-1))).alias("base"), F.concat(acc["parts"], F.array(F.transform(part, lambda x: step(acc["base"], x)))).alias("parts")),
            lambda acc: F.flatten(acc["parts"]),
        )

    return _let(values, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast("array<bigint>")))


def prefix_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array of longs."""
    return running(lengths, lambda a, b: a + b, F.lit(0).cast("bigint"))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (Java syntax, no empty matches); null text: none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def located(text: Column, pattern: str | Column, found: Column, kind: str, rank: int, keep: Callable[[Column], Column] = lambda m: F.lit(True)) -> Column:
    """The matches ``found`` as spans; ``keep`` says of a match's text whether it stays.

    The gaps between the matches come from splitting at the same pattern; running sums of gap and match lengths give the ends.
    """
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    spans = F.zip_with(prefix_sums(lengths), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m.alias("value")))
    return F.when(F.exists(found, keep), F.filter(spans, lambda s: keep(s["value"]))).otherwise(F.array().cast(SPAN))


def ordered(spans: Column) -> Column:
    """By start, then rank of the kind, then end."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))


def told(spans: Column) -> Column:
    """kind:start:end of each span in order, joined by commas."""
    return F.array_join(F.transform(ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart(base: Column, more: Column, rank: int) -> Column:
    """Those of the spans ``more``, all of one ``rank`` above that of ``base``, that overlap none of ``base``, by start.

    Both are sorted together: a span is free if no base span before it ends beyond its start and none after it begins before its end.
    """
    none, far = F.lit(0).cast("bigint"), F.lit(1 << 62).cast("bigint")

    def free(m: Column) -> Column:
        reach = running(F.transform(m, lambda s: F.when(s["rank"] < rank, s["end"]).otherwise(none)), F.greatest, none)
        after = F.reverse(running(F.reverse(F.transform(m, lambda s: F.when(s["rank"] < rank, s["start"]).otherwise(far))), F.least, far))
        bounds = F.zip_with(reach, after, lambda r, a: F.struct(r.alias("reach"), a.alias("after")))
        told = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["rank"].alias("rank"), s["value"].alias("value"))
        return F.array_compact(F.zip_with(m, bounds, lambda s, b: F.when((s["rank"] == rank) & (b["reach"] <= s["start"]) & (b["after"] >= s["end"]), told(s))))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), _let(ordered(F.concat(base, more)), free)).otherwise(more)


def redacted(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with every span replaced by ``mark(span)``; a span that begins inside an earlier one only extends its cut.

    Of n spans, about the square root are put together at a time, and their stretch of the text is cut out first: finding a place in a UTF-8 text
    takes time in proportion to what is before it.
    """
    whole = lambda c: c.cast("int")

    def joined(run: Column) -> Column:
        """What a run of (at, span) puts in place of the text from its first ``at`` to its last span's start."""
        first, last = F.element_at(run, 1)["at"], F.element_at(run, -1)["span"]["start"]
        piece = lambda block: F.array_join(F.transform(run, lambda x: F.concat(F.substring(block, whole(x["at"] - first + 1), whole(x["span"]["start"] - x["at"])), mark(x["span"]))), "")
        return _let(F.substring(text, whole(first + 1), whole(last - first)), piece)

    def cut(seen: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(seen))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(seen) - 1) / width).cast("int")), lambda i: F.slice(seen, i * width + 1, width))
        return F.array_join(F.transform(runs, joined), "")

    def put(m: Column) -> Column:
        ends = running(F.transform(m, lambda s: s["end"]), F.greatest, F.lit(0).cast("bigint"))

        def parts(e: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(e, F.lit(1), F.size(e) - 1))
            met = F.zip_with(m, before, lambda s, b: F.struct(b.alias("at"), s.alias("span")))
            return F.concat(_let(F.filter(met, lambda x: x["span"]["start"] >= x["at"]), cut), F.substring(text, whole(F.element_at(e, -1) + 1), F.lit(2**31 - 1)))

        return _let(ends, parts)

    return F.when(F.size(spans) > 0, _let(ordered(spans), put)).otherwise(text)
