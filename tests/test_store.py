from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import store

SCHEMA = "key string, n long, note string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def table(spark, tmp_path, **kw):
    return store.KeyedTable(spark, f"file://{tmp_path}/t", ["key"], SCHEMA, buckets=8, order=("n",), **kw)


def test_commits_and_compaction(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().isEmpty() and t.lookup(["k1"]).isEmpty() and t.compact() == 0
    rng, want = random.Random(1), {}
    for batch in range(4):
        data = [(f"k{rng.randrange(40)}", i, rng.choice([None, f"b{batch}"])) for i in range(30)]
        t.append(rows(spark, data), batch)
        for k, n, note in sorted(data, key=lambda r: (r[1], r[2] or "")):
            want[k] = (n, note)
    got = lambda df: {r["key"]: (r["n"], r["note"]) for r in df.collect()}
    assert got(t.read()) == want
    before = t.manifest()
    assert t.compact() > 0 and got(t.read()) == want and t.compact() == 0
    assert len({f.name for f in t.manifest().folders}) < len(before.folders) + 1 and all(sum(b in f.buckets for f in t.manifest().folders) == 1 for b in range(8) if any(b in f.buckets for f in before.folders))
    assert got(t.read(manifest=before)) == want  # a reader of an older state
    t.append(rows(spark, [("k1", 7, "late")]))
    assert got(t.lookup(["k1", "none"])) == {"k1": (7, "late")}
    assert t.vacuum(keep=1) and got(t.read()) == want | {"k1": (7, "late")}


def test_a_batch_tried_again_replaces_itself(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, [("a", 1, "old"), ("b", 1, "old")]), 5)
    t.append(rows(spark, [("a", 1, "next")]), 6)
    t.append(rows(spark, [("a", 1, "again")]), 5)
    assert {(r["key"], r["note"]) for r in t.read().collect()} == {("a", "next")}
    t.append(rows(spark, []), 6)
    assert {(r["key"], r["note"]) for r in t.read().collect()} == {("a", "again")}


def test_two_writers_and_a_reader(spark, tmp_path):
    """Both commits are kept, whoever comes first; a compaction that was overtaken changes nothing."""
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.append(rows(spark, [("a", 1, "0"), ("b", 1, "0")]))
    seen = one.read()
    inner, raced = one.manifest, []

    def overtaken():
        m = inner()
        if not raced:
            raced.append(two.append(rows(spark, [("b", 2, "two"), ("c", 2, "two")])))
        return m

    one.manifest = overtaken
    version = one.append(rows(spark, [("a", 3, "one"), ("c", 3, "one")]))
    assert raced == [2] and version == 3
    assert {(r["key"], r["note"]) for r in two.read().collect()} == {("a", "one"), ("b", "two"), ("c", "one")}
    assert {(r["key"], r["note"]) for r in seen.collect()} == {("a", "0"), ("b", "0")}
    stale = one.manifest()
    two.compact()
    one.manifest = lambda seen=[]: stale if not seen and not seen.append(1) else inner()  # noqa: B006
    with pytest.raises(store.Conflict):
        one.compact()
    one.manifest = inner
    assert {(r["key"], r["note"]) for r in one.read().collect()} == {("a", "one"), ("b", "two"), ("c", "one")}


def test_a_lookup_reads_its_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"), F.lit("x").alias("note")))
    found = t.lookup(["k17"])
    bucket = t.buckets_of(rows(spark, [("k17", 0, "")]))
    assert [r["n"] for r in found.collect()] == [17] and len(bucket) == 1
    assert {f.rsplit("/", 2)[1] for f in t.read(bucket).inputFiles()} == {f"_bucket={bucket[0]}"} and len(found.inputFiles()) < len(t.read().inputFiles())


def test_other_merges(spark, tmp_path):
    def most(df):
        return df.groupBy("key").agg(F.sum("n").alias("n"), F.max("note").alias("note"))

    t = table(spark, tmp_path, merge=most)
    for i in range(3):
        t.append(rows(spark, [("a", 2, f"{i}"), ("b", i, None)]))
    t.compact()
    t.append(rows(spark, [("a", 1, "")]))
    assert {tuple(r) for r in t.read().collect()} == {("a", 7, "2"), ("b", 3, None)}


def test_days(spark, tmp_path):
    path, day = f"file://{tmp_path}/days", 86_400_000_000
    base = 19_700 * day  # 2023-12-09
    d = spark.range(50).select(F.concat(F.lit("e"), "id").alias("event_id"), (F.lit(base) + (F.col("id") % 5) * day).alias("ts_us"), F.lit("first").alias("note"))
    store.store_days(d.unionByName(spark.createDataFrame([("x", None, "no time")], d.schema)), path)
    scan = store.scan_days(spark, path, "2023-12-10", "2023-12-11")
    plan = spark._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "formatted")
    assert scan.count() == 20 and re.search(r"PartitionFilters: \[[^\n]*day[^\n]*2023-12-10", plan)
    files = scan.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert {r["f"].split("day=")[1][:10] for r in files} == {"2023-12-10", "2023-12-11"}
    store.store_days(d.where("id % 5 = 1").withColumn("note", F.lit("second")), path)
    assert {(r["day"], r["note"], r["n"]) for r in spark.read.parquet(path).groupBy("day", "note").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.col("day").cast("string")).collect() if r["note"] == "second"} == {("2023-12-10", "second", 10)}
    assert store.drop_days(spark, path, 2, "2023-12-13") == ["2023-12-09", "2023-12-10"]
    left = {str(r["day"]) for r in spark.read.parquet(path).select("day").distinct().collect()}
    assert left == {"2023-12-11", "2023-12-12", "2023-12-13", "none"}
