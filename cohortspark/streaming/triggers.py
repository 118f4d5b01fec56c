"""Triggers and event schedules: parsed on the driver (they are short texts), expanded in Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trigger:
    first: float
    last: float
    step: float


def parse_triggers(text: str, end: float) -> tuple[list[Trigger], bool]:
    """Triggers of a definition, and whether it fires at the very end.

    ``s``: every s from 0; ``-s``: every s so that it hits the end; ``[a:b]s``: from a to b (empty
    bounds: 0 and infinity, no step: 1, negative bounds count from the end); ``[t]``: once;
    ``final``: after the last step; ``+`` joins. (Here ``final`` makes no trigger with undefined bounds.)
    """
    found, final = [], False
    for part in filter(None, (p.strip() for p in text.split("+"))):
        if part == "final":
            final = True
        elif part.startswith("["):
            inside, _, rest = part[1:].partition("]")
            low, colon, high = inside.partition(":")
            first = float(low) if low else 0.0
            last = (float(high) if high else math.inf) if colon else first
            if last <= 0 and (last < 0 or first < 0):
                last += end
            if first < 0:
                first += end
            found.append(Trigger(first, last, abs(float(rest)) if rest else 1.0))
        else:
            step = float(part)
            first = 0.0 if step >= 0 else end + step * math.floor(end / -step)
            found.append(Trigger(first, math.inf, abs(step)))
    return found, final


def schedule(spark: SparkSession, events: list[tuple[str, str]], end: float, always: tuple[str, ...] = ("write",)) -> DataFrame:
    """``time, events``: per time the distinct events that fire, in order of name, from (event, triggers) pairs.

    Events in ``always`` also fire at 0 and at the end.
    """
    rows = []
    for name, text in events:
        triggers, final = parse_triggers(text, end)
        rows += [(name, t.first, min(t.last, end), t.step) for t in triggers if t.first <= end]
        if final or name.split("|")[0] in always:
            rows.append((name, end, end, 1.0))
        if name.split("|")[0] in always:
            rows.append((name, 0.0, 0.0, 1.0))
    table = spark.createDataFrame(rows, "event string, first double, last double, step double")
    count = F.floor((F.col("last") - F.col("first")) / F.col("step") + 1e-9)
    times = table.where("last >= first").select("event", "first", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), count)).alias("i"))
    return times.groupBy((F.col("first") + F.col("i") * F.col("step")).alias("time")).agg(F.array_sort(F.collect_set("event")).alias("events"))


def linearize(intervals: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(time, step) of overlapping (from, to, step) intervals: the one started last rules; when it ends, the one
    below goes on at its own next phase; infinity stands for no interval."""
    edges = sorted([(b, 0, i) for i, (_, b, _) in enumerate(intervals)] + [(a, 1, i) for i, (a, _, _) in enumerate(intervals)])
    open_, out = [], []

    def put(t: float, step: float) -> None:
        while out and out[-1][0] >= t:
            out.pop()
        out.append((t, step))

    for t, starts, i in edges:
        if starts:
            open_.append(i)
            put(t, intervals[i][2])
        else:
            top = open_[-1] == i
            open_.remove(i)
            if top and open_:
                a, _, step = intervals[open_[-1]]
                put(a + math.ceil((t - a) / step) * step, step)
            elif top:
                put(t, math.inf)
    return out
