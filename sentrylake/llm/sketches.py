"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A text's sketch holds the K smallest distinct 32-bit hashes of its shingles of five words (fewer words: of the whole
sequence). Sketches of parts merge to the sketch of the whole. From two sketches follow the texts' resemblance and
containment, and from one the number of distinct shingles; all three are exact while texts have fewer than K of them.

Defined results: a null text is an empty one, whose sketch is empty; two empty sketches have resemblance 1, an empty and
another one 0; equal hashes of different shingles count once; very long texts are sketched whole, in K hashes; rows with
equal doc_id and text count as one document when a document's successor is sought, a null doc_id comes first, and rows that
tie in doc_id follow each other by their texts' hashes; a lone document follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.common import global_rank, materialize

K = 128
WIDTH = 5
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The 32-bit hashes (signed) of a text's shingles, repeats included."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    top = lambda h: F.shiftright(h, 32).cast("int")

    def of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) == 0, F.array().cast("array<int>")).when(F.size(h) < width, F.array(top(F.xxhash64(h)))).otherwise(
            F.transform(places, lambda i: top(F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: (k - 1) over the share of hashes up to the k-th."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**31) + F.lit(1.0)) / F.lit(2.0**32)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def complete(a: Column, b: Column, k: int = K) -> Column:
    """Whether both sketches hold all hashes of their texts."""
    return (F.size(a) < k) & (F.size(b) < k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the k smallest hashes of both texts together that lie in both; of all hashes, where both are complete."""

    def of(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))

    return let(F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), F.when(complete(a, b, k), 2 * k).otherwise(k)), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's distinct shingles that b has too."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    exact = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(complete(a, b, k), exact).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as text: eight hex digits a hash, in ascending order."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def with_successors(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, next_prefix (the successor's first floor(n_chars / 4) code points) and next_sketch of every row.

    Only ids and lengths are ranked. Texts are shuffled once, by id; their prefixes and sketches once, to their
    predecessors' ids.
    """
    none = F.lit(-(2**63)).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = rows.select("id", "hash", F.length("text").alias("n")).distinct()
    keys = materialize(global_rank(keys, [F.col("id"), F.col("hash")], "order"), "ranked")
    total = keys.count()
    before = keys.select(((F.col("rank") + 1) % max(total, 1)).alias("rank"), F.col("id").alias("prev_id"), F.col("hash").alias("prev_hash"), F.col("n").alias("prev_n"))
    chain = materialize(keys.select("id", "hash", "rank").join(before, "rank").drop("rank"), "chain")
    placed = rows.join(chain.hint("shuffle_merge"), ["id", "hash"])
    handed = placed.select(F.col("prev_id").alias("id"), F.col("prev_hash").alias("hash"), F.expr("left(text, cast(floor(prev_n / 4) AS int))").alias("next_prefix"), sketch(F.col("text"), k).alias("next_sketch"))
    handed = handed.dropDuplicates(["id", "hash"])
    out = rows.join(handed.hint("shuffle_merge"), ["id", "hash"])
    return out.select(F.when(F.col("id") != none, F.col("id")).alias("doc_id"), "text", "next_prefix", "next_sketch")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_successors(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) AS int))"), F.col("next_prefix"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_sketch", sketch(F.col("text")).alias("own"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_sketch", "own", sketch(F.col("edited")).alias("other"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("own")).alias("n_shingles"), distinct_count(F.col("other")).alias("edited_n_shingles"), containment(F.col("own"), F.col("other")).alias("contained_in_edited"), containment(F.col("own"), F.col("next_sketch")).alias("contained_in_next"),
    )
