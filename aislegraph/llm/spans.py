"""Spans in texts as native array expressions; places are code points, ends exclusive.

Defined cases: a null or empty text has no spans; time grows in proportion to a text's matches and their chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,value:string,inner:string>>"


#: Matches whose places are summed up together. A running sum copies what it has so far with every match,
#: so that long lists are cut into chunks, whose own places are then shifted by what stands before them.
CHUNK = 128


def find_spans(text: Column, pattern: str, gate: Column | None = None, group: int = 0) -> Column:
    """start, end, value and inner (the group) of all leftmost non-overlapping matches. What stands
    between matches comes from a split by the same pattern, so places are running sums of lengths.
    ``gate``: a cheap condition that holds for every text with a match."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else values
    parts = F.arrays_zip(gaps.alias("gap"), values.alias("value"), inner.alias("inner"))
    none = F.array().cast(EMPTY)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["inner"].alias("inner"))
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def chunked(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(every) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(
            F.slice(every, c * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step
        ))
        return F.flatten(bound(chunks, shifted))

    def shifted(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: c["at"])
        return bound(lengths, lambda sizes: bound(running_sums(sizes), lambda before: F.transform(chunks, lambda c, i: F.transform(
            c["out"], lambda s: F.struct((s["start"] + before[i]).alias("start"), (s["end"] + before[i]).alias("end"), s["value"].alias("value"), s["inner"].alias("inner"))
        ))))

    has = F.regexp_like(text, F.lit(pattern))
    return F.when((has if gate is None else gate & has), bound(parts, chunked)).otherwise(none)


def bound(value: Column, body) -> Column:
    """``value`` worked out once and handed to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(sizes: Column) -> Column:
    """Sum of the elements before each."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def kind_spans(spans: Column, kind: str, rank: int, by_start: bool = True) -> Column:
    """Sortable spans: (start, rank) or (rank, start) first, then end and kind."""
    def one(s: Column) -> Column:
        first, second = (s["start"], F.lit(rank)) if by_start else (F.lit(rank), s["start"])
        return F.struct(first.alias("first"), second.alias("second"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.transform(spans, one)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans in their order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def cover(text: Column, spans: Column, mark: str) -> Column:
    """The text with every stretch that spans cover replaced by ``mark``."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
