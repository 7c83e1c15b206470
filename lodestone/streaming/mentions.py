"""Streams of mentions and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, last_at): mentions of each key in tumbling windows; rows later than `late` are dropped by the watermark."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_at")).select(F.col("window.start").alias("start"), key, "n", "last_at")


def pairs_in_window(stream: DataFrame, at: str, group: str, entities: str, late: str = "2 hours") -> DataFrame:
    """(a, b, group): ordered pairs of the entities named together in one row, each once for a row's key within the watermark."""
    one = F.array_sort(F.array_distinct(entities))
    rows = stream.withWatermark(at, late).select(at, group, one.alias("e"))
    left = rows.select(at, group, "e", F.posexplode("e").alias("i", "a"))
    return left.select(at, group, "a", F.explode(F.slice("e", F.col("i") + 2, F.greatest(F.lit(0), F.size("e") - F.col("i") - 1))).alias("b"))


def unobserved(messages: DataFrame, marks: DataFrame, thread: str, at: str, mark: str = "mark") -> DataFrame:
    """Messages after the mark of their thread; a thread without a mark gives all of its messages."""
    return messages.join(marks.select(thread, mark), thread, "left").filter(F.col(mark).isNull() | (F.col(at) > F.col(mark))).drop(mark)


def registry(rows: DataFrame, who: str, at: str, tie: str, kind: str, cap: int, ring: int) -> DataFrame:
    """(who, mentions, kept, oldest_kept, ring): per entity how many mentions there were, the latest ``cap`` that are
    kept, and the kinds of the last ``ring``, latest first."""
    back = Window.partitionBy(who).orderBy(F.desc(at), F.desc(tie))
    m = rows.select(who, tie, kind, F.row_number().over(back).alias("back"), F.count(F.lit(1)).over(Window.partitionBy(who)).alias("mentions")).filter(F.col("back") <= cap)
    last = F.array_sort(F.collect_list(F.when(F.col("back") <= ring, F.struct("back", kind))))
    g = m.groupBy(who, "mentions").agg(F.count(F.lit(1)).alias("kept"), F.min(tie).alias("oldest_kept"), last.alias("r"))
    return g.select(who, "mentions", "kept", "oldest_kept", F.array_join(F.transform("r", lambda x: x[kind]), ",").alias("ring"))


def recompute(kept: DataFrame, rows: DataFrame, late: DataFrame, scope: str, roll) -> DataFrame:
    """kept with the scopes of late rows computed again from all of their rows; the others stay as they are."""
    dirty = late.select(scope).distinct()
    return kept.join(dirty, scope, "left_anti").unionByName(roll(rows.join(dirty, scope, "left_semi")))


def registry_stream(stream: DataFrame, who: str, at: str, tie: str, kind: str, cap: int, ring: int, idle: str | None = None, late: str = "2 hours") -> DataFrame:
    """``registry`` kept up to date over a stream: (who, mentions, kept, oldest_kept, ring, evicted), a row for each entity that a
    batch names (output mode update).  The state of an entity is its number of mentions and the latest ``cap`` of them, so rows may
    come in any order and a restart goes on from the checkpoint.  idle: an entity that the watermark has left so far
    behind is evicted, with a last row that says so; rows later than ``late`` are dropped then.  Null entities and times take no part."""
    rows = stream.filter(F.col(who).isNotNull() & F.col(at).isNotNull())
    if idle is not None:
        rows = rows.withWatermark(at, late)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle is not None else None
    # the time column stays as it is beside its number: the watermark is bound to it
    plain = rows.select(F.col(who).alias("who"), F.col(at).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(kind).cast("string").alias("kind"))

    def row(who_, total, held, evicted) -> pd.DataFrame:
        last = ",".join(k for _, _, k in held[:ring])
        return pd.DataFrame({"who": [who_], "mentions": [total], "kept": [len(held)], "oldest_kept": [min(t for _, t, _ in held)], "ring": [last], "evicted": [evicted]})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, held = 0, []
        if state.exists:
            total, ats, ties, kinds = state.get
            held = list(zip(ats, ties, kinds, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield row(key[0], total, held, True)
            return
        for f in frames:
            total += len(f)
            new = zip(f["at"].astype("datetime64[us]").astype("int64"), f["tie"], f["kind"], strict=True)
            held = sorted([*held, *((int(a), int(t), k) for a, t, k in new)], key=lambda m: m[:2], reverse=True)[:cap]
        state.update((total, [m[0] for m in held], [m[1] for m in held], [m[2] for m in held]))
        if wait is not None:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield row(key[0], total, held, False)

    kept = "mentions long, at array<long>, tie array<long>, kind array<string>"
    out = f"who {stream.schema[who].dataType.simpleString()}, mentions long, kept long, oldest_kept long, ring string, evicted boolean"
    timeout = GroupStateTimeout.EventTimeTimeout if wait is not None else GroupStateTimeout.NoTimeout
    return plain.groupBy("who").applyInPandasWithState(step, out, kept, "update", timeout).withColumnRenamed("who", who)
