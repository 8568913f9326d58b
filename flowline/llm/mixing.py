"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a water level turns weights into token targets, and
each document is emitted ``floor(rate)`` times plus one more time with the
probability of the fraction, drawn from a hash of the seed and its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh, materialise, running, small, word_count

#: Largest number of times that a source's tokens may be repeated.
MAX_EPOCHS = 3
#: Seed of the draws.
SEED = "mix-1"


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: sources by code point, null last, take the weights of ``cycle`` in turn."""
    turn = F.col("_turn") % len(cycle)
    placed = running(sources, [F.col("source").asc_nulls_last()], _turn=F.lit(1))
    return placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (turn + 1).cast("int")).cast("long")).drop("_turn")


def water_level(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> float | None:
    """The level at which min(cap, level * weight), cap being ``max_epochs`` sizes, adds up to all sizes; None if nothing is open.

    Sources that tie in cap / weight fill up at one level, so they are one group.  Taking groups in rising order, the first
    whose ratio isn't below the level that the rest would share, once all lower groups are full, sets the level.
    """
    cap = F.col("source_size") * max_epochs
    groups = sources.groupBy((cap / F.col("weight")).alias("ratio")).agg(F.sum(cap).alias("cap"), F.sum("weight").alias("weight"))
    all_size, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    walked = running(groups, [F.col("ratio").asc()], full=F.col("cap"), shut=F.col("weight"))
    level = (F.lit(all_size) - F.col("full")) / (F.lit(all_weight) - F.col("shut"))
    held = walked.where(F.col("ratio") >= level).agg(F.min_by(level, "ratio")).first()
    return held[0]


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    All sizes together are shared by weight; a target stops at ``max_epochs`` times
    its source's size and the excess is shared anew by weight until none is above.
    That end state is min(cap, level * weight) for the :func:`water_level`.
    """
    sources = materialise(sources, "sources")
    level = water_level(sources, max_epochs)
    return sources.withColumn("target", F.least((F.col("source_size") * max_epochs).cast("double"), F.lit(level).cast("double") * F.col("weight")))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and id; a null id draws as the word null."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, weigh=cycled_weights, max_epochs: int = MAX_EPOCHS, seed: str = SEED, words: Column | None = None) -> DataFrame:
    """``docs`` with one struct column ``mix``: size, source_size, weight, target, rate, copies, taken.

    Null text has size 0 and is taken 0 times or more like any other; null sources form
    one source, last in order; repeated rows draw alike (the draw depends on the id);
    a source whose documents are all empty has target and rate 0; sources that tie in size
    and weight get equal targets; an empty table gives an empty table; other columns pass through, and one named ``mix`` keeps its name
    while the new column gets underscores in front.  ``words`` is a document's size where it is
    known already; else words are counted twice, for the sums and for the copies.
    """
    size, source, key = fresh(docs, "mix_size"), fresh(docs, "mix_source"), fresh(docs, "mix")
    sized = docs.withColumn(size, words if words is not None else word_count(F.col("text")))
    per_source = materialise(sized.groupBy(F.col("source").alias("source")).agg(F.sum(size).alias("source_size")), "sizes")
    plan = targets(weigh(per_source), max_epochs)
    plan = small(plan.select(F.struct("source", "source_size", "weight", "target").alias(source)))
    joined = sized.join(plan, sized["source"].eqNullSafe(plan[source]["source"]), "inner")
    total = F.col(source)["source_size"]
    rate = F.when(total > 0, F.least(F.col(source)["target"] / total, F.lit(float(max_epochs)))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (draw(F.col("doc_id"), seed) < rate - whole).cast("long")
    out = F.struct(
        F.col(size).alias("size"), total.alias("source_size"), F.col(source)["weight"].alias("weight"),
        F.col(source)["target"].alias("target"), rate.alias("rate"), copies.alias("copies"), (copies * F.col(size)).alias("taken"),
    )
    return joined.withColumn(key, out).drop(size, source)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every document ``copies`` times, with ``copy`` counting from 1; columns as given plus ``copy``."""
    mixed = mix(docs, **how)
    key = next(c for c in mixed.columns if c not in docs.columns)
    number = fresh(docs, "copy")
    return mixed.where(F.col(key)["copies"] > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(key)["copies"]))).drop(key)
