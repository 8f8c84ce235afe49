"""A Merkle manifest of a table: a digest for every row, for every group of rows and for the table, with proofs.

Leaves are digests of whole rows. Within a group they stand in ascending order; every ``arity`` consecutive digests (the
last run may be shorter, even one) become the digest of their parent, level by level, down to one. The groups' digests
(subroots), in the order of the groups, are the leaves of a last tree of the same kind, whose top is the root.

Trees are built by ``combineByKey``, ``depth`` levels a round. A key is the ancestor of a block of at most
arity ** depth nodes. A digest that arrives is put under its place in its parent; the number of children that a parent
waits for follows from the size of its level; the child that completes it is the event on which the parent's digest is made
and arrives in its turn. So what one task holds of a block is reduced before the shuffle, parents that lack children
travel as they are, and the blocks' tops are the nodes of the next round. The children of each parent are kept with
their block as reverse links: from the root downwards they give every node the siblings on its way up.

Rows of a group are ranked by range partitioning, so that no group is one task; a task holds whole blocks, one at a
time. Rounds follow the logarithm of the largest group's size. Nothing is persisted: shuffle files and the ranked table in
the shared folder are what a lost executor's work is repeated from.

Defined results: null columns are written ``-``; a null group comes first; a null key comes first in its group, and its row
is not tampered with; rows with equal keys are ordered by their digests, so repeated rows are repeated leaves, each with
its own proof; a lone leaf is its group's subroot, and a lone subroot the root; texts are digested whole; an empty table gives no
rows; columns that aren't named play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from sentrylake.llm.common import global_rank, join_by_key, materialize

ARITY = 2
#: Levels of a round; a block has at most arity ** depth nodes.
DEPTH = 10
#: Nodes of a round that a partition has about.
PARTITION_NODES = 1 << 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value as ``-`` where null, else its number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def digest_of(children: Iterable[bytes]) -> bytes:
    """The digest of a run of digests, which are taken as hex text."""
    return hashlib.sha256("".join(x.hex() for x in children).encode()).digest()


def levels(size: int, arity: int = ARITY) -> int:
    """The number of levels above the leaves of a tree of so many leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // arity), n + 1
    return n


def rounds(size: int, arity: int = ARITY, depth: int = DEPTH) -> int:
    return max(1, -(-levels(size, arity) // depth))


class Block:
    """The part of a tree under one node: parents that wait for children, reverse links, and the top once it is known."""

    __slots__ = ("size", "base", "arity", "depth", "waiting", "links", "top", "leaves")

    def __init__(self, size: int, base: int, arity: int, depth: int) -> None:
        self.size, self.base, self.arity, self.depth = size, base, arity, depth
        self.waiting: dict[tuple[int, int], dict[int, bytes]] = {}
        self.links: dict[tuple[int, int], tuple[bytes, ...]] = {}
        self.top: bytes | None = None
        self.leaves: list[tuple] = []

    def level_size(self, level: int) -> int:
        """Nodes of a level of the whole tree."""
        return -(-self.size // self.arity**level)

    def arrive(self, level: int, index: int, digest: bytes) -> None:
        """A node's digest is known; so are then, one after the other, those of all ancestors that it completes."""
        while level < self.base + self.depth and (n := self.level_size(level)) > 1:
            parent, slot = divmod(index, self.arity)
            children = self.waiting.setdefault((level, parent), {})
            children[slot] = digest
            if len(children) < min(self.arity, n - parent * self.arity):
                return
            del self.waiting[level, parent]
            run = tuple(children[s] for s in sorted(children))
            self.links[level, parent] = run
            level, index, digest = level + 1, parent, digest_of(run)
        self.top = digest

    def add(self, node: tuple) -> Block:
        index, digest, payload = node
        if payload is not None:
            self.leaves.append((index, digest, payload))
        self.arrive(self.base, index, digest)
        return self

    def merge(self, other: Block) -> Block:
        self.links.update(other.links)
        self.leaves += other.leaves
        self.top = self.top or other.top
        for (level, parent), children in other.waiting.items():
            for slot, digest in children.items():
                self.arrive(level, parent * self.arity + slot, digest)
        return self

    def siblings(self, index: int) -> list[tuple[int, tuple[bytes, ...]]]:
        """A node's place in its run and the others of it, level by level up to the block's top."""
        out, level = [], self.base
        while level < self.base + self.depth and self.level_size(level) > 1:
            index, slot = divmod(index, self.arity)
            run = self.links[level, index]
            out.append((slot, run[:slot] + run[slot + 1 :]))
            level += 1
        return out

    def children(self) -> Iterator[int]:
        """The indexes of the block's nodes at its base."""
        if self.level_size(self.base) == 1:
            yield 0
            return
        for (level, parent), run in self.links.items():
            if level == self.base:
                yield from range(parent * self.arity, parent * self.arity + len(run))


def fold(digest: bytes, path: Iterable[tuple[int, tuple[bytes, ...]]]) -> bytes:
    """The root that follows from a leaf and the siblings on its way up."""
    for slot, others in path:
        digest = digest_of((*others[:slot], digest, *others[slot:]))
    return digest


def verdicts(block: Block, subroot: bytes, root: bytes, path: list[tuple[int, tuple[bytes, ...]]]) -> Iterator[tuple]:
    """The manifest's row of each leaf of a block; path: from the block's top to the root. Every leaf, its other one in its place
    where there is one, is folded with its siblings up to a root of its own, which is then compared.
    """
    for index, digest, (key, other) in block.leaves:
        way = block.siblings(index) + path
        folded = fold(other or digest, way)
        yield key, digest.hex(), subroot.hex(), root.hex(), digest_of(s for _, others in way for s in others).hex(), folded.hex(), folded == root


def built(nodes: RDD, total: int, largest: int, arity: int = ARITY, depth: int = DEPTH, partition: int = PARTITION_NODES) -> list[RDD]:
    """The blocks ((group, size, number), Block) of each round, from nodes ((group, size), (index, digest, payload)).

    total: the number of nodes; largest: of the largest group. In round r, groups of at most arity ** (depth * (r + 1)) nodes
    have come to their top, in their block 0.
    """
    out, span = [], arity**depth
    for r in range(rounds(largest, arity, depth)):
        base = r * depth

        def create(v: tuple, base: int = base) -> Block:
            return Block(v[0], base, arity, depth).add(v[1])

        keyed = nodes.map(lambda x: ((*x[0], x[1][0] // span), (x[0][1], x[1])))
        parts = max(1, total // span**r // partition, min(nodes.getNumPartitions(), total // span**r // span + 1))
        blocks = keyed.combineByKey(create, lambda b, v: b.add(v[1]), lambda a, b: a.merge(b), parts)
        out.append(blocks)
        # groups that are at their top don't go on
        nodes = blocks.filter(lambda x: x[0][1] > arity ** (x[1].base + depth)).map(lambda x: ((x[0][0], x[0][1]), (x[0][2], x[1].top, None)))
    return out


def tops(blocks: list[RDD], arity: int = ARITY, depth: int = DEPTH) -> RDD:
    """(group, size, digest) of each group."""
    done = [b.filter(lambda x: x[0][1] <= arity ** (x[1].base + depth)).map(lambda x: (x[0][0], x[0][1], x[1].top)) for b in blocks]
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def proofs(blocks: list[RDD], above: RDD, arity: int = ARITY, depth: int = DEPTH) -> RDD:
    """(Block, (what ``above`` tells of the group, path above the block)) of the first round's blocks.

    above: (group, size) with (anything, path above the group's top). Each round hands the paths of its blocks down to their
    nodes, which are the blocks of the round below.
    """
    paths = above.map(lambda x: ((*x[0], 0), x[1]))
    for r in reversed(range(len(blocks))):
        mine = paths.filter(lambda x, r=r: x[0][1] <= arity ** (depth * (r + 1)) and (r == 0 or x[0][1] > arity ** (depth * r)))
        if r + 1 < len(blocks):
            mine = mine.union(down.flatMap(_handed))
        joined = blocks[r].join(mine.partitionBy(blocks[r].getNumPartitions()), blocks[r].getNumPartitions())
        down = joined
    return down.values()


def _handed(x: tuple) -> Iterator[tuple]:
    (group, size, _), (block, (told, path)) = x
    for index in block.children():
        yield (group, size, index), (told, block.siblings(index) + path)


def manifest(rows: DataFrame, group: str, key: str, leaf_name: str = "leaf", other: str = "tampered", arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """key, leaf, subroot, root, proof (the digest of all siblings on the leaf's way up), folded_root (made from ``other``, another
    leaf in the place of the first, and the original siblings) and verified (whether it is the root) of every row.

    rows: the columns named; leaves are lower-case hex. Groups are texts, ordered by their UTF-8 bytes.
    """
    spark = rows.sparkSession
    kept = rows.select(
        F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("group"), F.col(key).alias("key"),
        F.col(leaf_name).alias("leaf"), F.when(F.col(other) != F.col(leaf_name), F.col(other)).alias("other"),
    )
    ranked = global_rank(materialize(kept, "leaves"), [F.col("group"), F.col("key"), F.col("leaf")], "leaves-in-order")
    sizes = materialize(ranked.groupBy("group").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n_rows")), "groups")
    total, most, n_groups = sizes.agg(F.sum("n_rows"), F.max("n_rows"), F.count(F.lit(1))).first()
    schema = StructType([StructField("key", rows.schema[key].dataType), *[StructField(n, StringType()) for n in ("leaf", "subroot", "root", "proof", "folded_root")], StructField("verified", BooleanType())])
    if not total:
        return spark.createDataFrame([], schema)
    places = global_rank(sizes, [F.col("group")], "groups-in-order", "place").withColumn("size", F.col("n_rows"))
    placed = join_by_key(ranked, places, "group", max(1000, total // 1000)).select("place", "size", (F.col("rank") - F.col("start")).alias("index"), "key", "leaf", "other")
    nodes = placed.rdd.map(lambda x: ((x[0], x[1]), (x[2], bytes.fromhex(x[4]), (x[3], bytes.fromhex(x[5]) if x[5] else None))))
    trees = built(nodes, total, most, arity, depth)
    subroots = tops(trees, arity, depth).map(lambda x: ((0, n_groups), (x[0], x[2], (x[1],))))
    upper = built(subroots, n_groups, n_groups, arity, depth)
    root = upper[-1].map(lambda x: x[1].top).first()  # one digest
    above = proofs(upper, spark.sparkContext.parallelize([((0, n_groups), (None, []))], 1), arity, depth)
    above = above.flatMap(lambda x: [((index, size), (digest, x[0].siblings(index) + x[1][1])) for index, digest, (size,) in x[0].leaves])

    told = proofs(trees, above, arity, depth).flatMap(lambda x: verdicts(x[0], x[1][0], root, x[1][1]))
    return spark.createDataFrame(told, schema, verifySchema=False)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    c = F.col
    hit = F.crc32(c("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit & c("n_chars").isNotNull(), leaf(c("doc_id"), c("source"), c("lang"), c("n_chars") + 1, c("text")))
    rows = docs.withColumn("leaf", leaf(*map(c, COLUMNS))).withColumn("tampered", F.coalesce(changed, "leaf"))
    out = manifest(rows, "lang", "doc_id")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = """WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, text, source,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)::UBIGINT[]),
      lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS crc FROM documents),
e AS (SELECT *, coalesce(xor(crc, 4294967295::UBIGINT) % 7 = 0, false) AS hit,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM d),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS bad FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
tree AS (SELECT g, 0 AS level, i, leaf AS digest FROM placed UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM tree) WHERE n > 1 GROUP BY g, level, i // 2),
sub AS (SELECT g, arg_max(digest, level) AS digest, max(level) AS height FROM tree GROUP BY g),
top AS (SELECT 0 AS level, g AS i, digest FROM sub UNION ALL SELECT level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT arg_max(digest, level) AS digest, max(level) AS height FROM top),
steps AS (SELECT p.*, step, CASE WHEN step < s.height THEN i >> step ELSE g >> (step - s.height) END AS at, s.height AS h FROM placed p JOIN sub s USING (g), root r, unnest(range(s.height + r.height)) AS u(step)),
ways AS (SELECT x.doc_id, x.leaf, x.i, x.g, x.step, x.at & 1 = 1 AS odd, coalesce(t.digest, u.digest, '') AS sibling FROM steps x LEFT JOIN tree t ON x.step < h AND t.g = x.g AND t.level = x.step AND t.i = xor(x.at, 1)
  LEFT JOIN top u ON x.step >= h AND u.level = x.step - h AND u.i = xor(x.at, 1)),
told AS (SELECT g, i, sha256(string_agg(sibling, '' ORDER BY step)) AS proof, list((CASE WHEN odd THEN 'L' ELSE 'R' END) || sibling ORDER BY step) AS way FROM ways GROUP BY g, i),
out AS (SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(bad, coalesce(way, [])), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root FROM placed p JOIN sub s USING (g) JOIN root r ON true LEFT JOIN told t USING (g, i))
SELECT *, folded_root = root AS verified FROM out"""
