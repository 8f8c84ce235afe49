"""MinHash near-duplicates by an inverted join of signature coordinates, confirmed on full sets of shingles.

Of each distinct set of shingles, COORDINATES minima of as many hash functions are the signature. Sets whose signatures agree
in fewer than MATCHES coordinates are no candidates: at a resemblance of 0.8 the agreeing coordinates are binomial with mean 32,
and fewer than 18 of 40 have a probability of about 1e-7. Two signatures with MATCHES agreeing coordinates agree in one
of any PREFIX = COORDINATES - MATCHES + 1 of them, so sets are posted under the first PREFIX pairs of coordinate and value
alone. In a posting list, agreements of the others are counted, and rows of a long list are only compared where they agree in
another coordinate, of which again PREFIX are enough: whatever can't reach MATCHES is skipped without being counted, and so is a pair in all lists but the first that it shares.

A list of more than LIST_ROWS rows (a value that very many sets share) is posted again, under pairs of two coordinates, so
that unlike sets part; what is still as long is dealt into blocks, each two of which meet in one task. A list yields a spanning
forest of its candidates, never all its pairs. The groups that candidates form are searched for links on full sets
(``simhash.resembling``), and components of the links are found by star contraction.

Defined results: a null text has no words; a document without words has an empty set, which is linked with nothing, not
even with another empty one; fewer words than a shingle's are one shingle; equal sets are linked; a null doc_id is never a
component's name unless nothing else is in it, and ``kept`` then holds for it; repeated rows give repeated rows; ties cannot occur,
as the smallest doc_id names a component and equal ids are one; texts are shingled whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.common import join_by_key, materialize
from sentrylake.llm.simhash import RESEMBLANCE, SEED, by_runs, components, dealt, resembling, shingle_hashes

WIDTH = 2
COORDINATES, MATCHES = 40, 18
PREFIX = COORDINATES - MATCHES + 1
#: Longer posting lists are posted again under two coordinates, and then dealt into blocks of about so many rows.
LIST_ROWS = 1 << 17
#: In a task, all pairs of lists of up to so many rows are compared by shifting; longer ones are visited breadth first.
SHORT_LIST = 16
#: In a task, lists of more rows with many components are cut by a second coordinate.
CUT_ROWS = 1 << 9
#: Of so many sets (about), or a thousandth if that is more, posting lists are counted to find long ones; only the balance of
#: the tasks depends on it.
SAMPLE_SETS = 1 << 17


def multipliers(n: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the hash functions, the same everywhere."""
    drawn = np.array([xxhash.xxh64_intdigest(f"coordinate {i}", SEED) for i in range(2 * n)], np.uint64)
    return drawn[:n] | np.uint64(1), drawn[n:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) 16-bit values of the least hash of each coordinate; sets must not be empty."""
    out = np.empty((len(sets), COORDINATES), np.uint16)
    factor, addend = multipliers()
    lo = 0
    while lo < len(sets):  # chunks of about a million hashes
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= 1 << 20):
            n, hi = n + len(sets[hi]), hi + 1
        h = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for i in range(COORDINATES):
            least = np.minimum.reduceat(h * factor[i] + addend[i], starts)
            # the value itself is near zero in large sets; its low bits are as good as any
            out[lo:hi, i] = ((least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)
        lo = hi
    return out


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, set_hash, set_hash2, n_shingles, signature (binary; null for an empty set) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch["text"]]
            filled = [i for i, s in enumerate(sets) if len(s)]
            made: list[bytes | None] = [None] * len(sets)
            for i, row in zip(filled, signatures([sets[i] for i in filled]) if filled else (), strict=True):
                made[i] = row.tobytes()
            digests = [xxhash.xxh128_intdigest(s.tobytes(), SEED) for s in sets]
            halves = np.array([(d >> 64, d & (2**64 - 1)) for d in digests], np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "set_hash": halves[:, 0], "set_hash2": halves[:, 1],
                "n_shingles": np.fromiter(map(len, sets), np.int64, len(sets)), "signature": made,
            })

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, set_hash long, set_hash2 long, n_shingles long, signature binary")


def values_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, COORDINATES)


def posting_keys(sig: np.ndarray, coordinates: range) -> np.ndarray:
    """(rows, coordinates) keys: the coordinate's number and its value, mixed so that they hash evenly."""
    at = np.array(coordinates, np.uint64) << np.uint64(16)
    return (at | sig[:, list(coordinates)].astype(np.uint64)).view(np.int64)


def others(coordinate: int) -> list[int]:
    """The first PREFIX coordinates but that one."""
    return [i for i in range(PREFIX + 1) if i != coordinate][:PREFIX]


def spanning(node: np.ndarray, sig: np.ndarray, size: np.ndarray, hundredths: int, work: int) -> tuple[list, list, np.ndarray]:
    """A spanning forest of the candidate pairs among rows, breadth first: MATCHES agreeing coordinates at least, and sizes
    that allow the resemblance. Ends after so many comparisons; the rows of components that aren't complete by then come third.
    """
    left, a, b = np.arange(len(node)), [], []
    rest, sizes = sig, size  # of those left
    while len(left) > 1:
        before, front, left, rest, sizes = left, [left[0]], left[1:], rest[1:], sizes[1:]
        while front and len(left):
            if work < 0:
                return a, b, before
            x = front.pop()
            work -= len(left)
            near = (100 * np.minimum(sizes, size[x]) >= hundredths * np.maximum(sizes, size[x])) & (np.count_nonzero(rest == sig[x], axis=1) >= MATCHES)
            if near.any():
                found = left[near]
                a.append(np.full(len(found), node[x], node.dtype))
                b.append(node[found])
                front.extend(found.tolist())
                left, rest, sizes = left[~near], rest[~near], sizes[~near]
    return a, b, left[:0]


def list_links(node: np.ndarray, sig: np.ndarray, size: np.ndarray, hundredths: int = RESEMBLANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning candidates of one posting list. Where its rows have too many components to be told apart by comparing rows,
    they are cut by a further coordinate, if that leaves fewer pairs to compare.
    """
    a, b, todo = [node[:0]], [node[:0]], [np.unique(node, return_index=True)[1]]
    while todo:
        rows = todo.pop()
        x, y, rest = spanning(node[rows], sig[rows], size[rows], hundredths, len(rows) * CUT_ROWS)
        a += x
        b += y
        rows = rows[rest]
        if not len(rows):
            continue
        # rows agree in some coordinates; of the others, so many are enough for the agreements that are lacking
        free = np.flatnonzero((sig[rows] != sig[rows[0]]).any(axis=0))
        lacking = MATCHES - (COORDINATES - len(free))
        free = free[: len(free) - lacking + 1] if lacking > 0 else free[:0]
        orders = [rows[np.argsort(sig[rows, j], kind="stable")] for j in free]
        parts = [np.split(order, np.flatnonzero(np.diff(sig[order, j])) + 1) for j, order in zip(free, orders, strict=True)]
        parts = [part for cut in parts for part in cut if len(part) > 1]
        if len(free) and 2 * sum(len(p) ** 2 for p in parts) < len(rows) ** 2:
            todo += parts
        else:
            x, y, _ = spanning(node[rows], sig[rows], size[rows], hundredths, len(rows) ** 2)
            a += x
            b += y
    return np.concatenate(a), np.concatenate(b)


def short_links(key: np.ndarray, node: np.ndarray, sig: np.ndarray, size: np.ndarray, hundredths: int = RESEMBLANCE) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs of short lists, key being sorted. A pair that meets in several lists is taken in the first of them:
    the one of its first posted coordinate in which it agrees. Lists of two coordinates take all their pairs.
    """
    a, b = [node[:0]], [node[:0]]
    at_coordinate = np.where(key >> 62 == 0, key >> 16, 0)
    for step in range(1, SHORT_LIST):
        x = np.flatnonzero(key[step:] == key[:-step])
        if not len(x):
            break
        x = x[100 * np.minimum(size[x], size[x + step]) >= hundredths * np.maximum(size[x], size[x + step])]
        equal = sig[x] == sig[x + step]
        first = (equal[:, :PREFIX].argmax(axis=1) >= at_coordinate[x]) & (node[x] != node[x + step])
        x = x[first & (np.count_nonzero(equal, axis=1) >= MATCHES)]
        a.append(node[x])
        b.append(node[x + step])
    return np.concatenate(a), np.concatenate(b)


def links_of(key: np.ndarray, node: np.ndarray, sig: np.ndarray, size: np.ndarray, hundredths: int = RESEMBLANCE) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of whole lists, key being sorted."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(edges)
    short = np.repeat((sizes > 1) & (sizes <= SHORT_LIST), sizes)
    found = [short_links(key[short], node[short], sig[short], size[short], hundredths)]
    found += [list_links(node[x : x + n], sig[x : x + n], size[x : x + n], hundredths) for x, n in zip(edges[:-1][sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True)]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def post(sets: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """key, node, size, signature of every posting; under the keys of ``twice`` (key), postings of two coordinates instead."""

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo : lo + 2048]
                key = posting_keys(values_of(part["signature"]), range(PREFIX))
                at = np.repeat(np.arange(len(part)), key.shape[1])
                yield pd.DataFrame({"key": key.ravel()} | {n: part[n].to_numpy()[at] for n in ("node", "size", "signature")})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo : lo + 2048]
                sig, first = values_of(part["signature"]), part["key"].to_numpy(np.int64)
                columns = np.array([others(int(k >> 16)) for k in first])
                second = (columns.astype(np.int64) << 16) | np.take_along_axis(sig, columns, axis=1).astype(np.int64)
                at = np.repeat(np.arange(len(part)), PREFIX)
                yield pd.DataFrame({"key": ((first[:, None] << 24) | second | (1 << 62)).ravel()} | {n: part[n].to_numpy()[at] for n in ("node", "size", "signature")})

    schema = "key long, node long, size long, signature binary"
    rows = sets.select("node", "size", "signature").mapInPandas(once, schema)
    if twice is None:
        return rows
    rows = rows.join(F.broadcast(twice.withColumn("long", F.lit(True))), "key", "left")  # at most PREFIX << 16 keys exist
    return rows.where(F.col("long").isNull()).drop("long").unionByName(rows.where("long").drop("long").mapInPandas(again, schema))


def long_lists(postings: DataFrame, share: float, rows: int) -> DataFrame | None:
    """key and blocks (rows / ``rows``) of the lists that a sample of that share shows to be longer than ``rows``."""
    seen = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows * share)
    out = materialize(seen.select("key", F.ceil(F.col("n") / share / rows).alias("blocks")), "long-lists")
    return None if out.isEmpty() else out


def candidates(sets: DataFrame, hundredths: int = RESEMBLANCE, list_rows: int = LIST_ROWS, sample: int = SAMPLE_SETS) -> DataFrame:
    """a, b: links among nodes (node, size, signature) with the components of all candidate pairs."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_runs(batches, "key"):
            key, node, size, sig = rows["key"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), rows["size"].to_numpy(np.int64), values_of(rows["signature"])
            a, b = links_of(key, node, sig, size, hundredths)
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    total = sets.count()
    postings = post(sets)
    if total > list_rows:
        share = min(1.0, max(sample / total, 0.001))
        some = materialize(sets.sample(share, seed=1), "sampled-sets") if share < 1 else sets
        twice = long_lists(post(some), share, list_rows)
        if twice is not None:
            twice = twice.select("key")
            postings = post(sets, twice)
            still = long_lists(post(some, twice), share, list_rows)
            postings = postings if still is None else dealt(postings, still)
    return postings.repartition("key").sortWithinPartitions("key").mapInPandas(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, hundredths: int = RESEMBLANCE, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept of every document."""
    marked = materialize(shingle_sets(docs, width), "shingle-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    filled = marked.where("n_shingles > 0")
    groups = filled.groupBy("set_hash", "set_hash2").agg(F.first("n_shingles").alias("size"), F.first("signature").alias("signature"), least, F.count(F.lit(1)).alias("n_docs"))
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    loose = components(candidates(groups, hundredths, list_rows))
    loose = materialize(groups.select("node", F.col("size").alias("n_shingles"), "least").join(loose, "node"), "loose")
    sure = components(resembling(loose, docs, width, hundredths))
    rooted = materialize(groups.drop("signature").join(sure, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    total = marked.count()
    named = join_by_key(rooted.select("set_hash", "set_hash2", "root", "n_docs"), names, "root", max(1000, total // 1000))
    named = named.select(F.struct("set_hash", "set_hash2").alias("set"), F.col("rep.doc_id").alias("component_id"), F.col("n_docs").alias("n_rows"))
    found = join_by_key(filled.withColumn("set", F.struct("set_hash", "set_hash2")), named, "set", max(1000, total // 1000))
    found = found.select("doc_id", "n_shingles", "component_id").unionByName(marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
