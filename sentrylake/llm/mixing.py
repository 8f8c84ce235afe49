"""Mixing sources to target weights.

Targets: the sources share all words by weight; no target exceeds ``most`` times its source, and the excess is reshared
by weight among the others until none is above. Sampling is Efraimidis-Spirakis: a document's key is an exponential
variate divided by its quality weight, so that ascending keys are a weighted draw without replacement. Within a source,
whole epochs of all documents come first; the rest of the target is filled in key order as long as a document brings
the running sum of words nearer to the budget, so that it ends within half a document of it.

The running sums never put a source into one task: rows are range-partitioned by source and key, so that a large source
lies in many ranges; a source's ranges are summed and prefix-summed (sources + ranges rows), and rows are added up
only within their range of their source.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, after all others; ties
of keys are broken by doc_id and text hash, null first; repeated rows are taken one by one; very long texts are counted whole, and
the budget is met within half of one; callers' columns keep their names and values, whatever they are; an empty table gives no rows; a mix of empty texts takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import WORD, global_rank, materialize, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(n_words: Column, n_chars: Column) -> Column:
    """Between 0.25 and 1: lower for texts of under 50 words and for mean word lengths far from six characters."""
    mean = n_chars / F.greatest(n_words, F.lit(1))
    shape = F.greatest(F.lit(0.5), F.lit(1.0) - F.abs(mean - F.lit(6.0)) / F.lit(12.0))
    length = F.greatest(F.lit(0.5), F.least(F.lit(1.0), n_words / F.lit(50.0)))
    return shape * length


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target for rows (source, source_size).

    Weights repeat over the sources by code point, null last. Each round fixes the sources at their cap and reshares the
    rest by weight; a round is one aggregate of the sources, so any number of sources will do.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "sources")
    options = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(options, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * share
    level, fixed = 0.0, -1
    while True:  # ends: sources at their cap only become more
        at_cap = F.col("cap") <= F.col("weight") * F.lit(level)
        s = ranked.agg(F.count(F.when(at_cap, 1)).alias("n"), F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)).alias("caps"), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0)).alias("rest")).first()
        if s["n"] == fixed or not s["rest"]:
            break
        fixed = s["n"]
        level = (total - s["caps"]) / s["rest"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level)) if s["rest"] else F.col("cap")
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, quality: Column | None = None, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken, copies, source, quality, row_hash (of all its columns) of every row.

    Rows that are equal in the key, the doc_id and the text follow each other by row_hash, so that reruns agree.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.xxhash64(*map(F.col, sorted(docs.columns))).alias("row_hash"),
        *([quality.alias("quality")] if quality is not None else []),
    )
    if quality is None:
        rows = rows.withColumn("quality", quality_weight(F.col("size"), F.col("chars")))
    key = -F.log(unit_hash(F.lit(seed), F.col("doc_id"))) / F.greatest(F.coalesce("quality", F.lit(1e-6)), F.lit(1e-6))
    rows = materialize(rows.drop("chars").withColumn("key", key).withColumn("at", F.monotonically_increasing_id()), "mix")
    order = [F.col("source"), F.col("key"), F.col("doc_id"), F.col("text_hash"), F.col("row_hash"), F.col("at")]
    rows = materialize(rows.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "ranges")
    cells = materialize(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    aims = targets(cells.groupBy("source").agg(F.sum("cell_size").cast("long").alias("source_size")), weights, share, most)
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("cells_before", F.coalesce(before, F.lit(0)))
    cells = cells.join(aims, cells["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    both = rows["source"].eqNullSafe(cells["source"]) & (rows["cell"] == cells["cell"])
    rows = rows.join(cells, both).drop(cells["source"], cells["cell"])
    within = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "text_hash", "row_hash", "at").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("running", F.col("cells_before") + F.sum("size").over(within)).withColumn("epochs", epochs)
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("epochs") + (2 * F.col("running") - F.col("size") <= 2 * budget).cast("long"))
    rows = rows.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "text_hash", "size", "source_size", "target", "taken", "copies", "source", "quality", "row_hash")


def expand(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns. Rows that are equal in all columns share their copies."""
    taken = mix(docs, **how).where("copies > 0").groupBy(F.col("row_hash").alias("_hash"), F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"))
    row, doc_id = F.xxhash64(*map(F.col, sorted(docs.columns))), F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("id"), row.alias("hash")).dropDuplicates(["id", "hash"])
    rows = rows.join(taken, (rows["hash"] == taken["_hash"]) & rows["id"].eqNullSafe(taken["_id"]))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The cap level of a water-filling: the sources in ascending order of cap to weight are at their cap as long as the
#: level that the others would then share is not below.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, length(coalesce(text, '')) AS chars FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, sum(cap) OVER o - cap AS caps_before, sum(weight) OVER () - (sum(weight) OVER o - weight) AS weight_left, sum(source_size) OVER () AS total FROM w WINDOW o AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - caps_before) / weight_left AS level FROM r),
lv AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap > weight * level),
t AS (SELECT source, source_size, CASE WHEN final_level IS NULL THEN cap ELSE least(cap, weight * final_level) END::DOUBLE AS target FROM l CROSS JOIN (SELECT (SELECT level FROM lv) AS final_level) x),
q AS (SELECT d.*, greatest(0.5, 1.0 - abs(chars / greatest(size, 1) - 6.0) / 12.0) * greatest(0.5, least(1.0, size / 50.0)) AS quality,
  (('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)}::DOUBLE AS u FROM d),
k AS (SELECT q.*, t.source_size, t.target, -ln(u) / quality AS key, floor(t.target / greatest(t.source_size, 1)) AS epochs FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (size * (epochs + CASE WHEN 2 * running - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
