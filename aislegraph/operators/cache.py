"""Outcome of every cache lookup when entries expire by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.model import BARCODE_HIT_TTL_DAYS, BARCODE_MISS_TTL_DAYS
from aislegraph.operators.ordering import first_known
from aislegraph.session import cut_lineage

STATE = ["key", "cached_at", "found"]


def _expires(cached_at: Column, found: Column) -> Column:
    days = F.when(found, F.lit(BARCODE_HIT_TTL_DAYS)).otherwise(F.lit(BARCODE_MISS_TTL_DAYS))
    return cached_at + F.make_dt_interval(days=days)


WRITE = ["key", "ts", "seq", "found"]


def _following(lookups: DataFrame, sources: DataFrame) -> DataFrame:
    """source and target of every source that a lookup would replace: its first lookup after
    expiry, one that found something where the source had.

    Lookups and expiry times are merged in one sort over (key, time), dealt by ranges, so that a key's
    lookups may lie over many tasks."""
    write = F.struct(*WRITE)
    looked = lookups.select("key", F.col("ts").alias("at"), F.lit(1).alias("tie"), "seq", F.lit(None).cast(sources.schema["source"].dataType).alias("source"), write.alias("any"), F.when(F.col("found"), write).alias("known"))
    none = F.lit(None).cast(looked.schema["any"].dataType)
    # A lookup at the very moment of expiry comes after it.
    probes = sources.select(
        F.col("source.key").alias("key"), _expires(F.col("source.ts"), F.col("source.found")).alias("at"), F.lit(0).alias("tie"),
        F.col("source.seq").alias("seq"), "source", none.alias("any"), none.alias("known"),
    )
    told = first_known(looked.unionByName(probes), [F.col("key"), F.col("at"), F.col("tie"), F.col("seq")], {"next_any": "any", "next_known": "known"})
    target = F.when(F.col("source.found"), F.col("next_known")).otherwise(F.col("next_any"))
    return told.where("tie = 0").select("source", target.alias("target")).where("target.key = source.key")


def cache_writes(lookups: DataFrame, state: DataFrame) -> DataFrame:
    """All cache writes that ``lookups(key, ts, seq, found)`` cause, after ``state``.

    A key's writes form a chain: the next one is its first lookup after expiry (a
    lookup that found nothing never replaces a known entry). Every lookup points at the one that would
    follow it as a write; from each key's first write the chain is then reached by pointer jumping: a
    round doubles the reach, so rounds grow with the logarithm of the longest chain. No key's lookups are
    gathered in one task. A null key has no entry.
    """
    lookups = lookups.select(*WRITE).where("key IS NOT NULL")
    first = F.min(F.struct("ts", "seq", "found")).alias("f")
    fresh = lookups.join(state.select("key"), "key", "left_anti").groupBy("key").agg(first).select("key", "f.*")
    known = state.select("key", F.col("cached_at").alias("ts"), F.lit(-1).cast("bigint").alias("seq"), "found").where("key IS NOT NULL")
    every = lookups.select(F.struct(*WRITE).alias("source")).unionByName(known.select(F.struct(*WRITE).alias("source")))
    jump = cut_lineage(_following(lookups, every))
    start = fresh.select(F.struct(*WRITE).alias("w")).unionByName(known.select(F.struct(*WRITE).alias("w")))
    reached = cut_lineage(start)
    while True:
        further = reached.join(jump, F.col("w") == F.col("source")).select(F.col("target").alias("w"))
        grown = cut_lineage(further.join(reached, "w", "left_anti").distinct())
        if grown.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(grown))
        onward = jump.select(F.col("source").alias("target"), F.col("target").alias("end"))
        jump = cut_lineage(jump.join(onward, "target").select("source", F.col("end").alias("target")))
    written = reached.select("w.*").where("seq >= 0")
    return cut_lineage(written.select("key", F.col("ts").alias("cached_at"), "seq", "found"))


def cache_outcomes(lookups: DataFrame, state: DataFrame, writes: DataFrame) -> DataFrame:
    """hit, expired or miss for every lookup, judged by the last write before it."""
    every = state.select("key", "cached_at", F.lit(-1).cast("bigint").alias("w_seq"), "found").unionByName(
        writes.select("key", "cached_at", F.col("seq").alias("w_seq"), "found")
    ).withColumnRenamed("found", "w_found")
    earlier = F.struct("cached_at", "w_seq") < F.struct("ts", "seq")
    prior = F.max(F.when(earlier, F.struct("cached_at", "w_seq", "w_found"))).alias("p")
    judged = lookups.join(every, "key", "left").groupBy("key", "ts", "seq", "found").agg(prior)
    state_of = (
        F.when(F.col("p").isNull(), "miss")
        .when(F.col("ts") < _expires(F.col("p.cached_at"), F.col("p.w_found")), "hit").otherwise("expired")
    )
    return judged.select("key", "ts", "seq", "found", state_of.alias("outcome"))


def state_after(state: DataFrame, writes: DataFrame) -> DataFrame:
    last = F.max(F.struct("cached_at", "found")).alias("l")
    both = state.select(*STATE).unionByName(writes.select(*STATE))
    return both.groupBy("key").agg(last).select(
        "key", F.col("l.cached_at").alias("cached_at"), F.col("l.found").alias("found")
    )
