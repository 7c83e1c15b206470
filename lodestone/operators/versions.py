"""Versioned rows: slowly changing history, as-of views, interval joins, bi-temporal state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """SCD-2 rows from changes: version from 1, valid_to is the next change's start, is_current."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return changes.withColumns({"version": F.row_number().over(w), "valid_from": F.col(at), "valid_to": F.lead(at).over(w)}).withColumn("is_current", F.col("valid_to").isNull())


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to", closed: bool = False) -> Column:
    """Half-open [start, end), or closed [start, end]; a null end is open."""
    return (F.col(start) <= t) & (F.col(end).isNull() | ((F.col(end) >= t) if closed else (F.col(end) > t)))


def as_of(rows: DataFrame, key: str, t: Column, start: str = "valid_from", end: str = "valid_to", order: str = "version") -> DataFrame:
    """The valid row of each key at t, of several the last in order."""
    v = rows.filter(valid_at(t, start, end))
    return v.groupBy(key).agg(F.max_by(F.struct(*v.columns), order).alias("r")).select("r.*")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in place of those of equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def bitemporal_view(rows: DataFrame, key: str, valid: Column, recorded: Column, order: str = "recorded_at") -> DataFrame:
    """The last row of each key that is valid at ``valid`` and recorded at ``recorded``, half-open on both axes."""
    seen = rows.filter(valid_at(valid) & valid_at(recorded, "recorded_at", "expired_at"))
    return seen.groupBy(key).agg(F.max_by(F.struct(*seen.columns), order).alias("r")).select("r.*")


def changed(rows: DataFrame, since: Column, until: Column) -> DataFrame:
    """Rows activated and/or expired in [since, until): activated if since <= valid_from < until, expired if since < valid_to <= until."""
    on = (F.col("valid_from") >= since) & (F.col("valid_from") < until)
    off = F.coalesce((F.col("valid_to") > since) & (F.col("valid_to") <= until), F.lit(False))
    return rows.withColumn("change", F.when(on & off, "ActivatedAndExpired").when(on, "Activated").when(off, "Expired")).filter(F.col("change").isNotNull())


def overlaps(a: DataFrame, b: DataFrame, on: list[str], width: int, a_start: str, a_end: str, b_start: str, b_end: str) -> DataFrame:
    """Pairs with a_start < b_end and b_start < a_end and equal ``on`` columns, by an equi-join on bins
    of ``width``; each pair is kept in the one bin where it begins. Starts and ends are numbers."""
    cut = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    left, right = a.withColumn("_bin", cut(a_start, a_end)), b.withColumn("_bin", cut(b_start, b_end))
    out = left.join(right, [*on, "_bin"]).filter((F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)))
    return out.filter(F.col("_bin") == F.floor(F.greatest(F.col(a_start), F.col(b_start)) / width)).drop("_bin")
