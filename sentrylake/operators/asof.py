"""As-of joins: for every seeker the nearest event of its key at or before its time, and how many events there are up to it.

Events and seekers are range-partitioned once by (key, time) and scanned in that order, so a key that holds most rows, or
a moment that does, is spread like any other. What a partition's first key had before it (its last events, and their
number) is carried over from the partitions before: each partition reports one row, its tail, and these rows alone are
put together and broadcast. Nothing is paired, and no window runs over a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from sentrylake.operators.tables import cut


def tagged(kind: str, *columns: str | Column) -> Column:
    """A key of a kind from columns; null where one of them is."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit("\x01"), p.cast("string"))])


def keyed(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows once for each of the keys that isn't null, with it as ``key``."""
    return rows.select("*", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def _scanner(other: str | None):
    """Scans partitions sorted by (key, time, side): of every seeker the last event and the last one whose ``other`` differs
    from that one's, within the partition; and of the whole partition its tail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell = TaskContext.get().partitionId()
        head = last = None  # the partition's first key, the last row's key
        held, seen = None, 0  # that key's last events, in order, and the number of its events

        def batch_of(t: pa.Table, rows: np.ndarray, first: np.ndarray, second: np.ndarray, count: np.ndarray, kind: int) -> pa.RecordBatch:
            pick = lambda at: t["e"].combine_chunks().take(pa.array(at, pa.int64(), mask=at < 0))
            n = len(rows)
            columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, cell, np.int32)), t["key"].take(pa.array(rows)).combine_chunks(), pa.array([head] * n, pa.string())]
            columns += [pa.array(count, pa.int64()), t["s"].take(pa.array(rows)).combine_chunks(), pick(first), pick(second)]
            return pa.RecordBatch.from_arrays(columns, ["kind", "cell", "key", "head", "seen", "s", "first", "second"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            old = 0 if held is None else held.num_rows
            t = t if held is None else pa.concat_tables([held, t])
            key = t["key"].to_numpy(zero_copy_only=False)
            head = key[0] if head is None else head
            n, at = len(key), np.arange(len(key))
            start = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
            event = t["side"].to_numpy() == 0
            first = np.maximum.accumulate(np.where(event, at, -1))
            first = np.where(first >= start, first, -1)
            second = np.full(n, -1)
            if other is not None and event.any():
                places = np.flatnonzero(event)
                value = pc.struct_field(t["e"].combine_chunks(), other).to_numpy(zero_copy_only=False)[places]
                begins = np.r_[True, (value[1:] != value[:-1]) | (start[places[1:]] != start[places[:-1]])]
                run_at = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
                before = np.where(run_at > 0, places[run_at - 1], -1)  # the event before the run of equal values
                of_event = np.full(n, -1)
                of_event[places] = np.where(before >= start[places], before, -1)
                second = np.where(first >= 0, of_event[first], -1)
            fresh = np.cumsum(event & (at >= old))
            count = fresh - np.where(start > 0, fresh[start - 1], 0) + np.where(key == last, seen, 0)
            asked = np.flatnonzero(~event)
            if len(asked):
                yield batch_of(t, asked, first[asked], second[asked], count[asked], 1)
            keep = [x for x in (second[-1], first[-1]) if x >= 0]
            held, seen, last = (t.take(pa.array(keep, pa.int64())) if keep else None), int(count[-1]), key[-1]
            ends = (t, np.array([n - 1]), first[-1:], second[-1:], count[-1:])
        if head is not None:
            yield batch_of(*ends, 2)

    return run


def carried(tails: list[Row], other: str | None) -> list[tuple]:
    """(cell, key, first, second, seen): what the partitions before each one know of its first key. A row for each partition."""
    out, state = [], None
    for t in sorted(tails, key=lambda r: r["cell"]):
        if state is not None and state[0] == t["head"]:
            out.append((t["cell"], *state))
        first, second, seen = t["first"], t["second"], t["seen"]
        if state is not None and state[0] == t["key"]:
            _, old_first, old_second, old_seen = state
            seen += old_seen
            if first is None:
                first, second = old_first, old_second
            elif other is not None and second is None and old_first is not None:
                second = old_first if old_first[other] != first[other] else old_second
        state = (t["key"], first, second, seen)
    return out


def nearest(events: DataFrame, seekers: DataFrame, forward: bool = False, other: str | None = None, to: str | None = None) -> DataFrame:
    """seekers with ``found``, the nearest event of equal key at or before the seeker's ts_us (at or after it, with
    ``forward``), and ``seen``, the number of events up to there.

    events: key, ts_us, event_id and what else is wanted of them; seekers: key, ts_us and any other columns. A tie goes to
    the smallest event_id. With ``other``, found is the nearest event whose value of it differs from the seeker's value of
    ``to`` (by default of the same name); seen counts all events. Null keys and times find nothing; seekers that have them
    are left out, as are events, and with ``other`` those without a value of it.
    """
    to = to or other
    at = -F.col("ts_us") if forward else F.col("ts_us")
    e = events.where("key IS NOT NULL AND ts_us IS NOT NULL")
    e = e.where(F.col(other).isNotNull()) if other else e
    asked = seekers.where("key IS NOT NULL AND ts_us IS NOT NULL")
    found = F.struct(*[c for c in events.columns if c != "key"])
    out = _scanned(
        e.select("key", at.alias("at"), F.col("event_id").cast("string").alias("id"), found.alias("e")),
        asked.select("key", at.alias("at"), F.lit("").alias("id"), F.struct(*seekers.columns).alias("s")), ["key", "at", "side", "-id"], other,
    )
    options = F.array_compact(F.array("first", "second", "old_first", "old_second"))
    if other:
        options = F.filter(options, lambda x: x[other] != F.col("s")[to])
    return out.select("s.*", F.try_element_at(options, F.lit(1)).alias("found"), "seen")


def ranks(events: DataFrame) -> DataFrame:
    """events (key, ts_us, event_id and others; ids are distinct in a key) with ``rank``, their place from 1 in their key's order
    of time. Those up to a moment are as many as ``nearest`` has ``seen`` there.
    """
    e = events.where("key IS NOT NULL AND ts_us IS NOT NULL").select("key", F.col("ts_us").alias("at"), F.col("event_id").cast("string").alias("id"), F.struct(*events.columns).alias("s"))
    out = _scanned(e.select("key", "at", "id", F.struct("id").alias("e")), e, ["key", "at", "-id", "side"], None)
    return out.select("s.*", F.col("seen").alias("rank"))


def _scanned(events: DataFrame, seekers: DataFrame, order: list[str], other: str | None) -> DataFrame:
    """s, first, second, old_first, old_second and seen of each of the seekers (key, at, id, s), from events (key, at, id, e)."""
    kinds = {"e": events.schema["e"].dataType, "s": seekers.schema["s"].dataType}
    rows = events.withColumns({"side": F.lit(0), "s": F.lit(None).cast(kinds["s"])}).unionByName(seekers.withColumns({"side": F.lit(1), "e": F.lit(None).cast(kinds["e"])}))
    by = [F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c) for c in order]
    fields = {"kind": IntegerType(), "cell": IntegerType(), "key": StringType(), "head": StringType(), "seen": LongType(), "s": kinds["s"], "first": kinds["e"], "second": kinds["e"]}
    schema = StructType([StructField(n, k, True) for n, k in fields.items()])
    scanned = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scanner(other), schema), "as-of")
    tails = scanned.where("kind = 2").select("cell", "key", "head", "seen", "first", "second").collect()  # a row for each partition
    told = {"cell": IntegerType(), "key": StringType(), "old_first": kinds["e"], "old_second": kinds["e"], "old_seen": LongType()}
    carry = events.sparkSession.createDataFrame(carried(tails, other), StructType([StructField(n, k, True) for n, k in told.items()]))
    out = scanned.where("kind = 1").join(F.broadcast(carry), ["cell", "key"], "left")
    return out.withColumn("seen", F.col("seen") + F.coalesce("old_seen", F.lit(0)))
