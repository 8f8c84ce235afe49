"""SimHash near-duplicates with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 bits agree on one of 3 segments but for one bit at most (any distance
under twice the number of segments is found without loss). For looser likeness, fingerprints of several 64-bit words
with more segments find candidates, and exact resemblance decides: see LOOSE. Each distinct
fingerprint is indexed, for every segment, once for each bit of it left out (a one-wildcard variant); fingerprints whose
segment differs in one bit or none meet under a variant, in an equality join on (segment, bit, remaining bits). Within a
variant, candidates are verified on all bits. Large buckets yield a spanning forest of their links instead of all
pairs, found by visiting the bucket's rows breadth first, so that what a bucket emits is at most its size. A bucket of
more than BLOCK_ROWS rows is dealt into blocks, and each two of its blocks meet in a bucket of their own, so no task holds
more than two blocks of it and no link is lost. Components are then joined by star contraction over the links, each round
written to the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other; equal
texts are linked; a null doc_id is never a component's name unless nothing else is in it; repeated rows give repeated
rows; a bit that exactly half of the hashes have set is 0; very long texts are shingled whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.common import join_by_key, materialize

SEED = 42
SHINGLE = 4
BITS = 64
MAX_DISTANCE = 4
SEGMENTS = 3
#: Settings for a resemblance of 0.8 or more of 5-word shingles (sets). Bits only propose pairs; their shingles decide. A pair
#: at resemblance J differs in a bit with probability p = acos(2J / (1 + J)) / pi: 0.148 at J = 0.8, 0.102 at 0.9. Candidates agree
#: on one of 12 segments of 16 bits but for one bit at most (0.984 at J = 0.8, 0.998 at 0.85) and differ in at most ``most`` of
#: 192 bits (0.995 at J = 0.8).
LOOSE = {"width": 5, "most": 41, "words": 3, "segments": 12}
#: In hundredths, the least resemblance of near copies.
RESEMBLANCE = 80
#: Nodes, and distinct shingles, that a block of a group of candidates has about.
BLOCK_NODES, BLOCK_SHINGLES = 1 << 12, 1 << 21
#: So many links (16 bytes each) are contracted in one task; more by rounds over all tasks.
LOCAL_LINKS = 1 << 18
#: Pivots of large groups are broadcast while they have so many bytes together at most.
PIVOT_BYTES = 1 << 25
#: Up to this size, all pairs of a bucket are compared by shifting; larger ones are visited breadth first.
SMALL_BUCKET = 32
#: Larger buckets are dealt into blocks of about so many rows.
BLOCK_ROWS = 1 << 18
#: Of so many nodes (about), or a thousandth if that is more, keys are counted to find such buckets; only the balance of
#: the tasks depends on it.
SAMPLE_NODES = 1 << 17
#: Up to so many of such buckets are known to every task; more are joined by a shuffle.
MOST_TOLD = 1 << 20
#: A bucket's blocks of more rows are first cut by parts of the bits that vary in them.
CUT_ROWS = 1 << 12


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) text, repeats included; fewer words: of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :][:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0; for further words, hashes of them (a 64-bit finalizer)."""
    if not word:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * word & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, width: int = SHINGLE, words: int = 1) -> list[int]:
    """``words`` words of 64 bits; a bit is 1 if it is set in over half the shingles' hashes."""
    return majority(shingle_hashes(text, width), words)


def majority(h: np.ndarray, words: int) -> list[int]:
    out = []
    for word in range(words):
        counts = np.zeros(BITS, np.int64)
        for a in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(mixed(h[a : a + (1 << 16)], word))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(h)))))
    return out


def names(words: int) -> list[str]:
    return [f"fp{i}" for i in range(words)]


def fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, text_hash (long), fp0 ... (the words, as signed longs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, width, words) for t in batch["text"]], np.uint64).reshape(len(batch), words).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"]} | {n: fp[:, i] for i, n in enumerate(names(words))})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names(words)))


def shingle_sets(docs: DataFrame, width: int, words: int) -> DataFrame:
    """doc_id, text_hash, set_hash and n_shingles of the text's distinct shingles, and their fingerprint fp0 ..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch["text"]]
            fp = np.array([majority(h, words) for h in sets], np.uint64).reshape(len(batch), words).view(np.int64)
            digest = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            out = {"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "set_hash": digest, "n_shingles": np.array([len(h) for h in sets], np.int64)}
            yield pd.DataFrame(out | {n: fp[:, i] for i, n in enumerate(names(words))})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, set_hash long, n_shingles long, " + ", ".join(f"{n} long" for n in names(words)))


def variant_keys(fp: np.ndarray, segments: int = SEGMENTS, turns: int = 1) -> np.ndarray:
    """(rows, bits * turns) keys of fingerprints (rows, words): for every bit, its segment's other bits, with its number.

    Segments never cross a word, and have at most 40 bits. On each further turn, words are rotated by a part of a segment.
    """
    rows, words = fp.shape
    out = np.empty((rows, turns * words * BITS), np.uint64)
    each = -(-segments // words)
    cuts = [round(i * BITS / each) for i in range(each + 1)]
    for turn in range(turns):
        by = turn * BITS // (each * turns)
        for w in range(words):
            word = np.ascontiguousarray(fp[:, w]).astype(np.uint64)
            word = (word >> np.uint64(by)) | (word << np.uint64(BITS - by)) if by else word
            for a, b in zip(cuts, cuts[1:], strict=False):
                segment = (word >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                for bit in range(a, b):
                    at = (turn * words + w) * BITS + bit
                    out[:, at] = (segment & np.uint64(~(1 << (bit - a)) & (2**64 - 1))) | np.uint64(at << 40)
    return out.view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints (unsigned, as bitwise_count takes the absolute value of a signed number)."""
    return np.bitwise_count((a ^ b).astype(np.uint64)).sum(axis=-1, dtype=np.int64)


def spanning_links(node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (at most ``most`` bits apart) among nodes, breadth first."""
    left, a, b = np.arange(len(node)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = distance(fp[left], fp[x]) <= most
            if near.any():
                found = left[near]
                a.append(np.full(len(found), node[x], node.dtype))
                b.append(node[found])
                front.extend(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def parts_of(fp: np.ndarray, most: int) -> list[np.ndarray]:
    """For each of ``most`` + 1 parts of the bits that vary among fingerprints, the groups of rows that agree on it.

    Rows at most ``most`` bits apart agree on a part at least. Where parts would have under six bits, all rows are one group.
    """
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1)
    bits = bits[:, np.flatnonzero(bits.min(axis=0) != bits.max(axis=0))]
    if bits.shape[1] < 6 * (most + 1):
        return [np.arange(len(fp))]
    out = []
    for part in np.array_split(np.arange(bits.shape[1]), most + 1):
        value = np.packbits(bits[:, part[:64]], axis=1)
        value = np.ascontiguousarray(np.pad(value, ((0, 0), (0, 8 - value.shape[1])))).view(np.uint64).ravel()
        order = np.argsort(value, kind="stable")
        out += [g for g in np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(g) > 1]
    return out


def bucket_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found in whole buckets: key is sorted, and nodes are distinct in each bucket."""
    if not len(key):
        return node, node
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[edges, len(key)])
    a, b = [node[:0]], [node[:0]]
    small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
    k, n, f = key[small], node[small], fp[small]
    for step in range(1, SMALL_BUCKET):
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        at = at[distance(f[at], f[at + step]) <= most]
        a.append(n[at])
        b.append(n[at + step])
    for s, size in zip(edges[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        at = s + np.argsort(node[s : s + size])  # links of other buckets then begin at the same nodes
        for part in parts_of(fp[at], most) if size > CUT_ROWS else [np.arange(size)]:
            x, y = spanning_links(node[at[part]], fp[at[part]], most)
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def large_buckets(groups: DataFrame, segments: int, words: int, turns: int, block: int, sample: int = SAMPLE_NODES) -> DataFrame | None:
    """key and blocks (their number) of the buckets of about ``block`` rows or more; None where there can't be one."""
    total = groups.count()
    if total <= block:
        return None
    share = min(1.0, max(sample / total, 0.001))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                yield pd.DataFrame({"key": variant_keys(batch[names(words)].iloc[at : at + 2048].to_numpy(np.int64), segments, turns).ravel()})

    seen = groups.select(*names(words)).sample(share, seed=1).mapInPandas(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return materialize(seen.where(F.col("n") > block * share).select("key", F.ceil(F.col("n") / share / block).alias("blocks")), "large-buckets")


def dealt(rows: DataFrame, large: DataFrame, most_told: int = MOST_TOLD) -> DataFrame:
    """rows (key, node, ...) with each row of a large bucket once for every pair of blocks that has the row's block.

    Two buckets whose new keys collide are searched as one, which adds no false link.
    """
    told = large.hint("broadcast" if large.count() <= most_told else "shuffle_merge")
    own = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.join(told, "key", "left").withColumn("own", own).withColumn("other", F.explode(others))
    pair = F.xxhash64(F.lit(2), "key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumn("key", F.when(F.col("other") < 0, F.col("key")).otherwise(pair)).drop("blocks", "own", "other")


def by_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of whole runs of equal keys, from batches of rows sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and batch[key].iloc[-1] == held[-1][key].iloc[-1]:
            held.append(batch)  # still the same run
            continue
        rows = pd.concat([*held, batch]) if held else batch
        whole = int(rows[key].searchsorted(rows[key].iloc[-1]))
        if whole:
            yield rows.iloc[:whole]
        held = [rows.iloc[whole:]]
    if held:
        yield pd.concat(held)


def links(groups: DataFrame, most: int = MAX_DISTANCE, segments: int = SEGMENTS, words: int = 1, turns: int = 1, block: int = BLOCK_ROWS, most_told: int = MOST_TOLD) -> DataFrame:
    """a, b (a < b): links among nodes (node, fp0 ...; distinct fingerprints) with the components of all links found."""
    columns = ["node", *names(words)]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo : lo + 2048]
                key = variant_keys(part[names(words)].to_numpy(np.int64), segments, turns)
                at = np.repeat(np.arange(len(part)), key.shape[1])
                yield pd.DataFrame({"key": key.ravel()} | {n: part[n].to_numpy(np.int64)[at] for n in columns})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_runs(batches, "key"):
            a, b = bucket_links(rows["key"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), rows[names(words)].to_numpy(np.int64), most)
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    large = large_buckets(groups, segments, words, turns, block)
    rows = groups.select(*columns).mapInPandas(index, ", ".join(f"{n} long" for n in ["key", *columns]))
    if large is not None and not large.isEmpty():
        rows = dealt(rows, large, most_told)
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(verify, "a long, b long").distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node, root of every node of links, root being its component's smallest node: labels fall along links and jump to
    their label's label until nothing changes.
    """
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b]):  # roots are pulled, so that whole trees move at once
            np.minimum.at(new, side, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return node, node[label]
        label = new


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """node, root of every node of edges (a, b), root being its component's smallest node.

    Large-star and small-star contraction: each round, a node's larger neighbours and then its smaller ones are linked
    to the smallest in its neighbourhood. Minima are taken with partial aggregation; ends after a round without change. Up to
    ``local`` links, a few megabytes whatever the input, are contracted in one task instead.
    """
    # a set of links by its size and the sum of their hashes
    told = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = told(edges)
    if before[0] <= local:

        def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(batches)
            if held:
                rows = pd.concat(held)
                yield pd.DataFrame(dict(zip(("node", "root"), stars(rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64)), strict=True)))

        return materialize(edges.coalesce(1).mapInPandas(contract, "node long, root long"), "stars")
    changed = True
    while changed:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u != v").distinct(), "small-star")
        # a forest of stars, unchanged by the round: every node has one link, to a node that has no smaller one
        now = told(small)
        changed, before = now != before, now
        edges = small
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, most: int = MAX_DISTANCE, segments: int = SEGMENTS, words: int = 1, turns: int = 1) -> DataFrame:
    """doc_id, text_hash, fp0 ..., component_id (the smallest doc_id reachable) and kept_hash (the text of that document)."""
    fps = names(words)
    marked = materialize(fingerprints(docs, width, words), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    groups = marked.groupBy(*fps).agg(least, F.count(F.lit(1)).alias("n_rows"))
    groups = materialize(groups.withColumn("node", F.col("fp0") if words == 1 else F.monotonically_increasing_id()), "groups")
    found = components(links(groups, most, segments, words, turns))
    rooted = groups.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "rooted")
    roots = rooted.groupBy("root").agg(F.min("least").alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    total = marked.count()
    named = join_by_key(rooted.select(*fps, "root", F.col("n_rows").alias("n_docs")), roots, "root", max(1000, total // 1000))
    named = named.select(F.struct(*fps).alias("fp"), "rep", F.col("n_docs").alias("n_rows"))
    out = join_by_key(marked.withColumn("fp", F.struct(*fps)), named, "fp", max(1000, total // 1000))
    return out.select("doc_id", "text_hash", *fps, F.col("rep.doc_id").alias("component_id"), F.col("rep.text_hash").alias("kept_hash"))


def set_links(node: np.ndarray, sets: list[np.ndarray], hundredths: int = RESEMBLANCE, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among nodes whose sets have that resemblance at least, breadth first.

    Shared elements are counted by the lists of the nodes that have each of them. Nodes marked ``joined`` are known to be
    connected: links among them aren't searched, and one link to them is enough for any other node.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    value, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[inverse] > 1
    # a link shares at least that part of either set
    able = 100 * np.bincount(owner[shared], minlength=len(sets)) >= hundredths * size
    use = shared & able[owner]
    inverse, owner = inverse[use], owner[use]
    order = np.argsort(inverse, kind="stable")
    lists, begin = owner[order], np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(value)))]
    first = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sets)))]
    joined = np.zeros(len(sets), bool) if joined is None else joined
    left = able & ~joined
    a, b = [node[:0]], [node[:0]]
    for x in np.flatnonzero(left):
        if not left[x]:
            continue
        left[x], front = False, [x]
        while front:
            x = front.pop()
            mine = inverse[first[x] : first[x + 1]]
            lo, n = begin[mine], begin[mine + 1] - begin[mine]
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(lists[at], minlength=len(sets))
            alike = 100 * both >= hundredths * (size[x] + size - both)
            found = np.flatnonzero(left & alike)
            anchor = np.flatnonzero(joined & able & alike)[:1]
            if len(anchor):
                a.append(node[[x]])
                b.append(node[anchor])
            if len(found):
                a.append(np.full(len(found), node[x], node.dtype))
                b.append(node[found])
                left[found] = False
                front.extend(found)
    return np.concatenate(a), np.concatenate(b)


def attached(large: DataFrame, width: int, hundredths: int) -> DataFrame:
    """large (node, root, n_shingles, text) with ``pivot``, a node of the root, and ``near``: the pivot and what it is linked to.

    A root's pivot is one row. Pivots are broadcast while their texts have PIVOT_BYTES together at most, else joined.
    """
    chosen = large.groupBy("root").agg(F.min(F.struct(F.xxhash64("node"), "node")).getField("node").alias("pivot"))
    pivots = materialize(large.join(chosen, "root").where("node = pivot").select("root", "pivot", F.col("text").alias("pivot_text")), "pivots")
    total = pivots.agg(F.sum(F.octet_length("pivot_text") + F.lit(32))).first()[0] or 0

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = {p: np.unique(shingle_hashes(t, width)) for p, t in batch.drop_duplicates("pivot")[["pivot", "pivot_text"]].itertuples(index=False)}
            found = []
            for node, pivot, text in batch[["node", "pivot", "text"]].itertuples(index=False):
                mine = np.unique(shingle_hashes(text, width))
                both = len(np.intersect1d(mine, sets[pivot], assume_unique=True))
                found.append(node == pivot or 100 * both >= hundredths * (len(mine) + len(sets[pivot]) - both))
            yield batch.drop(columns="pivot_text").assign(near=np.array(found, bool))

    rows = large.join(F.broadcast(pivots) if total <= PIVOT_BYTES else pivots, "root").select("node", "root", "n_shingles", "text", "pivot", "pivot_text")
    return materialize(rows.mapInPandas(near, "node long, root long, n_shingles long, text string, pivot long, near boolean"), "attached")


def resembling(loose: DataFrame, docs: DataFrame, width: int, hundredths: int = RESEMBLANCE, block: tuple[int, int] = (BLOCK_NODES, BLOCK_SHINGLES)) -> DataFrame:
    """a, b: links among the nodes of each root whose texts' sets of shingles have that resemblance at least.

    loose: node, root, n_shingles and least of the nodes that have candidates. The links keep the components of all such
    links. A root of at most a block's nodes and shingles is searched in one task. In a larger one, all nodes are first
    compared with one of them, the pivot; those linked to it are connected and not compared with each other. The rest is dealt
    into blocks, each two of which meet in a task, and each of which meets the blocks of the connected ones. So a
    text of a large group of near copies travels once for each block of what its pivot leaves, and not for each block.
    """
    of_blocks = lambda nodes, shingles: F.ceil(F.greatest(nodes / block[0], shingles / block[1]))
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_shingles").alias("shingles"))
    total = max(1, loose.count())
    sizes = materialize(sizes.select("root", F.col("nodes").alias("n_rows"), (of_blocks(F.col("nodes"), F.col("shingles")) > 1).alias("large")), "roots")
    none = F.lit(-(2**63)).cast("long")
    needed = join_by_key(loose, sizes, "root", max(1000, total // 1000)).select("node", "root", "n_shingles", "large", F.coalesce("least.doc_id", none).alias("id"), F.col("least.text_hash").alias("hash"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    texts = rows.join(needed, ["id", "hash"]).dropDuplicates(["node"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_runs(batches, "key"):
            key, node, texts, near = rows["key"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), rows["text"].to_numpy(), rows["near"].to_numpy(bool)
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            out = [set_links(node[x:y], [np.unique(shingle_hashes(t, width)) for t in texts[x:y]], hundredths, near[x:y]) for x, y in zip(edges, edges[1:], strict=False) if y - x > 1]
            if out:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    if sizes.where("large").isEmpty():
        small = texts.select(F.xxhash64("root").alias("key"), "node", F.lit(False).alias("near"), "text")
        return small.repartition("key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long")
    texts = materialize(texts.select("node", "root", "n_shingles", "large", "text"), "candidate-texts")
    marked = attached(texts.where("large").drop("large"), width, hundredths)
    part = lambda near: of_blocks(F.count(F.when(F.col("near") == near, 1)), F.coalesce(F.sum(F.when(F.col("near") == near, F.col("n_shingles"))), F.lit(0)))
    blocks = materialize(marked.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows"), part(True).alias("joined"), part(False).alias("rest")).where("rest > 0"), "blocks")
    dealt_rows = join_by_key(marked, blocks, "root", max(1000, total // 1000), "inner").where("rest > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("joined")).otherwise(F.col("rest")))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    joined, rest = F.col("joined"), F.col("rest")
    met = F.when(F.col("near"), F.transform(upto(rest), lambda o: F.xxhash64("root", F.lit(1), o, F.col("own")))).otherwise(
        F.concat(F.transform(upto(joined), lambda o: F.xxhash64("root", F.lit(1), F.col("own"), o)), F.transform(upto(rest), lambda o: F.xxhash64("root", F.lit(2), F.least("own", o), F.greatest("own", o))))
    )
    dealt_rows = dealt_rows.withColumn("own", own).select(F.explode(met).alias("key"), "node", "near", "text")
    small = texts.where("NOT large").select(F.xxhash64("root").alias("key"), "node", F.lit(False).alias("near"), "text")
    compared = dealt_rows.unionByName(small).repartition("key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long")
    return compared.unionByName(marked.where("near AND node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))


def near_copies(docs: DataFrame, width: int, most: int, words: int, segments: int, block: tuple[int, int] = (BLOCK_NODES, BLOCK_SHINGLES)) -> DataFrame:
    """node, root and least (the smallest doc_id of the node, with its text_hash) of every set of shingles.

    Nodes of one root are joined by links of RESEMBLANCE hundredths or more, each verified; see LOOSE for the settings.
    The candidates of the index are joined to groups first (a spanning forest a bucket, never all its pairs), and the links
    are searched within these.
    """
    marked = shingle_sets(docs, width, words)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    groups = materialize(marked.groupBy("set_hash", "n_shingles", *names(words)).agg(least), "sets")
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    loose = groups.select("node", "n_shingles", "least").join(components(links(groups, most, segments, words)), "node")
    sure = components(resembling(materialize(loose, "loose"), docs, width, RESEMBLANCE, block))
    return materialize(groups.join(sure, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one row of each group of near-duplicates: the one with its smallest doc_id.

    Rows with equal doc_id and text are repeats, of which one stays: the first by the hashes of its other columns, so that
    reruns agree. ``settings`` are those of near_copies (LOOSE).
    """
    none = F.lit(-(2**63)).cast("long")
    found = near_copies(docs, **(LOOSE | settings)).groupBy("root").agg(F.min("least").alias("rep"))
    kept = found.select(F.coalesce("rep.doc_id", none).alias("id"), F.col("rep.text_hash").alias("hash"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64(text).alias("hash"))
    first = rows.join(kept, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.struct(*[F.xxhash64(F.col(f"row.{c}")) for c in docs.columns if c != "text"])).alias("row"))
    return first.select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
