"""Report and search queries: traces, term counts, latest rows, running throughput, top-k and searches."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.texts import glob


def trace(edges: DataFrame, uid: str, t_min: float, t_max: float) -> DataFrame:
    """A target's incident edges in a window, in order of time: alarms are path edges, risk is severity or 50."""
    rows = edges.where(((F.col("src_uid") == uid) | (F.col("dst_uid") == uid)) & F.col("ts_float").between(t_min, t_max))
    alarm = F.coalesce("is_alarm", F.lit(False))
    return rows.select(
        "src_uid", "dst_uid", "rtype", "event_id", "ts_us", alarm.alias("is_path_edge"), F.when(alarm, F.coalesce("severity", F.lit(50))).otherwise(0).alias("risk"),
        F.concat_ws(" | ", "rtype", "tactic_id", "technique_id").alias("summary"),
    )


def terms(df: DataFrame, column: str, size: int = 10) -> DataFrame:
    """The most frequent values of a column; ties in order of value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column)).limit(size)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def running_average(df: DataFrame, key: str, order: list[str], value: str, points: int = 10) -> DataFrame:
    """df with the average of each point and the nine before it, within a key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - points, 0)
    return df.withColumn("running", F.avg(value).over(w))


def filter_of(query: dict[str, Any], arrays: frozenset[str] = frozenset()) -> Column:
    """The condition of a filter given as nested dictionaries, in the way of document stores:
    match_all, match_none, term, terms, range, exists, prefix, wildcard, ids and bool with must, filter, should and must_not.

    Columns in ``arrays`` match when they hold the value. A missing value fails every condition, so must_not lets it pass.
    """
    if len(query) != 1:
        raise ValueError("one condition is needed")
    (kind, body), = query.items()
    if kind in ("match_all", "match_none"):
        return F.lit(kind == "match_all")
    if kind == "bool":
        out = F.lit(True)
        for q in [*_many(body.get("must")), *_many(body.get("filter"))]:
            out = out & filter_of(q, arrays)
        for q in _many(body.get("must_not")):
            out = out & ~filter_of(q, arrays)
        should = [filter_of(q, arrays).cast("int") for q in _many(body.get("should"))]
        if should:
            need = int(body.get("minimum_should_match", 0 if "must" in body or "filter" in body else 1))
            out = out & (sum(should[1:], should[0]) >= need)
        return out
    if kind == "ids":
        return F.coalesce(F.col("event_id").isin(*body["values"]), F.lit(False))
    if kind == "exists":
        name = body["field"]
        return F.coalesce(F.size(name) > 0, F.lit(False)) if name in arrays else F.col(name).isNotNull()
    (name, value), = body.items()
    c = F.col(name)
    if kind == "term":
        value = value["value"] if isinstance(value, dict) else value
        test = F.array_contains(c, value) if name in arrays else c == F.lit(value)
    elif kind == "terms":
        test = F.arrays_overlap(c, F.array(*map(F.lit, value))) if name in arrays else c.isin(*value)
    elif kind == "range":
        test = F.lit(True)
        for op, v in value.items():
            test = test & {"gte": c >= F.lit(v), "gt": c > F.lit(v), "lte": c <= F.lit(v), "lt": c < F.lit(v)}[op]
    elif kind == "prefix":
        test = c.startswith(value)
    elif kind == "wildcard":
        test = glob(c, value["value"] if isinstance(value, dict) else value)
    else:
        raise ValueError(f"{kind} isn't a condition")
    return F.coalesce(test, F.lit(False))


def _many(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def search(df: DataFrame, condition: Column, order: list[Column], offset: int = 0, size: int = 100) -> DataFrame:
    """A page of the rows that meet a condition, in a total order."""
    return df.where(condition).orderBy(*order).offset(offset).limit(size)


def events_condition(start_us: int, end_us: int, host_name: str | None = None, ids: list[str] | None = None, datasets: list[str] | None = None, host_id: str | None = None) -> Column:
    """Events in a closed time window, by host (name or id), ids and datasets (which may hold * and ?)."""
    out = F.col("ts_us").between(start_us, end_us)
    out = out & (F.col("host_name") == host_name) if host_name else out
    out = out & (F.col("host_id") == host_id) if host_id else out
    out = out & F.col("event_id").isin(*ids) if ids else out
    if datasets:
        any_of = F.lit(False)
        for d in datasets:
            any_of = any_of | (glob(F.col("dataset"), d) if "*" in d or "?" in d else F.col("dataset") == d)
        out = out & any_of
    return out


def findings_condition(tactics: list[str] | None = None, techniques: list[str] | None = None, providers: list[str] | None = None, least_severity: int | None = None, rules: list[str] | None = None) -> Column:
    """Findings by tactic, technique, provider, severity and rule (its id or its name)."""
    out = F.lit(True)
    out = out & F.col("tactic_id").isin(*tactics) if tactics else out
    out = out & F.col("technique_id").isin(*techniques) if techniques else out
    out = out & (F.col("rule_id").isin(*rules) | F.col("rule_name").isin(*rules)) if rules else out
    out = out & F.arrays_overlap("providers", F.array(*map(F.lit, providers))) if providers else out
    return out & (F.col("severity") >= least_severity) if least_severity is not None else out
