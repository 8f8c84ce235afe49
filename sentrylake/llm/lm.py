"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A text is its lower-cased (A-Z) words and one end token. A word's cell is three numbers: a class hashed from its last
letters, a sub-class hashed from its first ones, and a slot hashed from the whole word. The model is

    P(word | history) = P(class | history) * P(sub-class | class, history) * P(slot | class, sub-class, history) * P(word | cell)

The first three factors are softmaxes over hashed n-gram and skip features of the history: the last word, the last two
words, and the cells of the words two and three back. The last is the word's smoothed share of the few words of its cell,
which is what a maximum-entropy model with word features alone comes to. Words not seen in training share one event in
each cell.

1. Tasks turn texts into blocks: token numbers, with a vocabulary of the block of its own. No text is read twice.
2. Words are counted over all blocks by their 64-bit hashes (a collision of two words is expected once in some billion
   distinct words), and counts go back to the blocks that have the word.
3. Training is bulk-synchronous: in each round every task takes gradient steps over its blocks' share of the training
   documents, and the tasks' changes, weighted by tokens, are summed by rows of the model in two shuffles, of FAN_IN tasks
   at most and then of their sums. Each training document is used once. What is counted grows with the corpus; the features'
   table does not (ROWS rows for each, a parameter), as every task sends its changes of all of it.
4. Blocks are scored with their words' counts, in sparse numpy batches.

Defined results: a null text is an empty one and has the end token alone; a null doc_id counts as the empty text for the
crc32 and so as a training row; repeated rows are learnt from and scored one by one; very long texts
are cut into blocks and scored whole; words of equal counts in one cell tie and share its probability; without training tokens every token
has probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import materialize

#: Classes, sub-classes of a class and slots of a sub-class.
LEVEL = 16
CELLS = LEVEL**3
ROWS = 1 << 14
FEATURES = 4
WIDTH = 3 * LEVEL
ROUNDS = 2
BATCH = 1 << 14
RATE = 0.5
#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 22
#: Model rows are exchanged in pieces of so many.
PIECE = 1 << 9
#: Tasks whose changes are summed at once.
FAN_IN = 256
SEED = 42
TAIL = b".,;:!?\"')(|*#&%$"
BLOCK = "block long, doc_ids array<long>, held array<boolean>, n_tokens array<long>, tokens binary, hashes binary, marks binary, cells binary, counts binary"


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte in four planes, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def remainder(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def sub_class_of(word: bytes) -> int:
    """The number of a word's sub-class among all."""
    bare = word.strip(TAIL) or word
    return xxhash.xxh32_intdigest(bare[-3:], 1) % LEVEL * LEVEL + (xxhash.xxh32_intdigest(bare[:3], 2) + (word[-1:] != bare[-1:])) % LEVEL


def cells_of(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """The words' cells; their slots are the last bits of their hashes."""
    return np.fromiter(map(sub_class_of, words), np.uint16, len(words)) * np.uint16(LEVEL) + (hashes % np.uint64(LEVEL)).astype(np.uint16)


class BlockBuilder:
    """Gathers documents; a block's vocabulary numbers its words from 1, 0 is the end token."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict(count(1).__next__)
        self.ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        tokens = np.zeros(len(words) + 1, np.uint32)
        tokens[:-1] = np.fromiter(map(self.vocabulary.__getitem__, words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.parts.append(tokens)
        self.size += len(tokens)

    def row(self, block: int) -> dict:
        words = list(self.vocabulary)
        tokens, lengths = np.concatenate(self.parts), [len(p) for p in self.parts]
        held = [remainder(i) == 1 for i in self.ids]
        n = len(words) + 1
        counts = np.bincount(tokens[np.repeat(~np.array(held), lengths)], minlength=n).astype(np.uint32)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, n - 1)
        cells = cells_of(words, hashes)
        return {
            "block": block, "doc_ids": self.ids, "held": held, "n_tokens": lengths, "tokens": packed(tokens),
            "hashes": np.r_[np.uint64(0), hashes].tobytes(), "marks": np.r_[np.uint64(0), hashes >> np.uint64(32)].astype(np.uint32).tobytes(), "cells": np.r_[np.uint16(0), cells].tobytes(), "counts": packed(counts),
        }


def blocks(docs: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """BLOCK rows of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, builder = count(TaskContext.get().partitionId() << 32), BlockBuilder()
        for batch in batches:
            for i, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                builder.add(None if pd.isna(i) else int(i), text)
                if builder.size >= tokens:
                    yield pd.DataFrame([builder.row(next(part))])
                    builder = BlockBuilder()
        if builder.size:
            yield pd.DataFrame([builder.row(next(part))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, BLOCK)


def vocabulary(found: DataFrame) -> DataFrame:
    """block, local, hash, cell, n: the words of each block with their counts in its training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, h, c, n in zip(batch["block"], batch["hashes"], batch["cells"], batch["counts"], strict=True):
                h = np.frombuffer(h, np.int64)
                yield pd.DataFrame({"block": b, "local": np.arange(len(h), dtype=np.int32), "hash": h, "cell": np.frombuffer(c, np.uint16).astype(np.int16), "n": unpacked(n).astype(np.int64)})

    return found.select("block", "hashes", "cells", "counts").mapInPandas(run, "block long, local int, hash long, cell short, n long")


def cell_counts(found: DataFrame) -> np.ndarray:
    """The training tokens of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS)
        for batch in batches:
            for c, n in zip(batch["cells"], batch["counts"], strict=True):
                total += np.bincount(np.frombuffer(c, np.uint16), weights=unpacked(n), minlength=CELLS)
        yield pd.DataFrame({"cell": range(CELLS), "n": total.astype(np.int64)})

    rows = found.select("cells", "counts").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS rows
    out = np.zeros(CELLS, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


def spread(listed: DataFrame) -> DataFrame:
    """block, local, c (where a word's count over all blocks isn't its block's own), and cell at one row of each word seen.

    One shuffle by word; a word has one row for each block at most, so that no word is hot by its number of uses.
    """
    w = Window.partitionBy("hash")
    rows = listed.select("*", F.sum("n").over(w).alias("c"), F.min(F.struct("block", "local")).over(w).alias("first"))
    first = (F.col("first.block") == F.col("block")) & (F.col("first.local") == F.col("local")) & (F.col("c") > 0)
    back = F.col("c") != F.col("n")
    out = rows.where(first | back).select(*[F.when(back, F.col(x)).alias(x) for x in ("block", "local", "c")], F.when(first, F.col("cell")).alias("cell"))
    return materialize(out, "words")


def histories(tokens: np.ndarray, first: np.ndarray, marks: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES) rows of the model for each token's history; ``first`` marks the first token of a document.

    Before a document's first word stand end tokens.
    """
    at = np.arange(len(tokens))
    start = np.maximum.accumulate(np.where(first, at, 0))

    def back(values: np.ndarray, step: int) -> np.ndarray:
        return np.where(at - step >= start, values[np.maximum(at - step, 0)], 0)

    word = marks[tokens]
    cell = cells[tokens].astype(np.uint64) + np.uint64(1)
    w1, w2 = back(word, 1), back(word, 2)
    mixed = lambda x, k: (((x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
    pair = w1 ^ (w2 * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return np.stack([mixed(w1, 0), mixed(pair, 1), back(cell, 2).astype(np.int64), back(cell, 3).astype(np.int64)], axis=1) + np.arange(FEATURES) * ROWS


class Biases(NamedTuple):
    """Logarithms of the shares of classes, of sub-classes in their class and of slots in their sub-class."""

    of_class: np.ndarray
    of_sub: np.ndarray
    of_slot: np.ndarray
    #: The three side by side, a row for each sub-class.
    rows: np.ndarray

    @classmethod
    def of(cls, cells_n: np.ndarray) -> Biases:
        n = (cells_n + 0.5 / LEVEL).reshape(LEVEL, LEVEL, LEVEL)
        sub, whole = n.sum(axis=2), n.sum(axis=(1, 2))
        shares = (whole / whole.sum(), sub / whole[:, None], (n / sub[:, :, None]).reshape(-1, LEVEL))
        a, b, c = (np.log(x).astype(np.float32) for x in shares)
        return cls(a, b, c, np.concatenate([np.tile(a, (LEVEL**2, 1)), np.repeat(b, LEVEL, axis=0), c], axis=1))


#: Which columns belong to which level: products with it sum a level's columns, and with its transpose spread a level's value.
OF_LEVEL = np.repeat(np.eye(3, dtype=np.float32), LEVEL, axis=0)


def log_shares(w: np.ndarray, bias: Biases, rows: np.ndarray, cell: np.ndarray, shares: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of P(cell | history) of tokens, and with ``shares`` the probabilities of each level's numbers (WIDTH columns)."""
    logits = np.take(w, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        logits += np.take(w, rows[:, k], axis=0)
    np.clip(logits, -60, 60, out=logits)
    at, sub = np.arange(len(cell)), cell // LEVEL
    logits += np.take(bias.rows, sub, axis=0)
    out = logits[at, sub // LEVEL] + logits[at, LEVEL + sub % LEVEL] + logits[at, 2 * LEVEL + cell % LEVEL]
    np.exp(logits, out=logits)
    sums = logits @ OF_LEVEL
    out -= np.log(sums).sum(axis=1)
    if shares:
        logits *= (1 / sums) @ OF_LEVEL.T
    return out, logits


def learn(w: np.ndarray, squares: np.ndarray, bias: Biases, rows: np.ndarray, cell: np.ndarray) -> None:
    """One adaptive gradient step over a batch, in place."""
    error = log_shares(w, bias, rows, cell, shares=True)[1]
    at = np.arange(len(cell))
    for level, number in enumerate((cell // LEVEL**2, cell // LEVEL % LEVEL, cell % LEVEL)):
        error[at, level * LEVEL + number] -= 1
    for k in range(rows.shape[1]):
        r = (rows[:, k] - k * ROWS).astype(np.uint16)  # narrow numbers are sorted by digits
        order = np.argsort(r, kind="stable")
        r = r[order]
        edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        g = np.add.reduceat(np.take(error, order, axis=0), edge, axis=0)
        u = r[edge].astype(np.int64) + k * ROWS
        squares[u] += (g * g).mean(axis=1)
        w[u] -= (RATE / FEATURES) * g / np.sqrt(squares[u] + 1.0)[:, None]


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens, lengths of documents, marks (hashes of 32 bits) and cells of words of a block."""
    return unpacked(row.tokens), np.asarray(row.n_tokens, np.int64), np.frombuffer(row.marks, np.uint32).astype(np.uint64), np.frombuffer(row.cells, np.uint16)


def halved(x: np.ndarray) -> bytes:
    """Numbers in half precision, scaled so that the greatest fits, behind their scale."""
    x = x.ravel()
    scale = np.float32(np.abs(x).max(initial=0.0)) or np.float32(1)
    return scale.tobytes() + (x / scale).astype(np.float16).tobytes()


def doubled(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float16, offset=4).astype(np.float32) * np.frombuffer(b, np.float32, 1)


def train(found: DataFrame, bias: Biases, rounds: int = ROUNDS, fan_in: int = FAN_IN) -> np.ndarray:
    """The model's weights (FEATURES * ROWS, WIDTH)."""
    spark = found.sparkSession
    w = np.zeros((FEATURES * ROWS, WIDTH), np.float32)
    squares = np.zeros(FEATURES * ROWS, np.float32)
    # sums of sums, until all tasks' are one
    levels = max(1, math.ceil(math.log(max(2, found.rdd.getNumPartitions()), fan_in)))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((w, squares, bias))

        def run(batches: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            w0, s0, bias = shared.value
            w, s, seen = w0.copy(), s0.copy(), 0
            for batch in batches:
                for row in batch.itertuples(index=False):
                    tokens, lengths, marks, cells = opened(row)
                    chosen = ~np.asarray(row.held, bool) & (np.arange(len(lengths)) % rounds == turn)
                    tokens, lengths = tokens[np.repeat(chosen, lengths)], lengths[chosen]
                    if not len(tokens):
                        continue
                    first = np.zeros(len(tokens), bool)
                    first[np.cumsum(lengths) - lengths] = True
                    for lo in range(0, len(tokens), BATCH * 8):
                        hi = min(len(tokens), lo + BATCH * 8)
                        a = max(0, lo - 3)
                        rows = histories(tokens[a:hi], np.r_[True, first[a + 1 : hi]], marks, cells)[lo - a :]
                        cell = cells[tokens[lo:hi]].astype(np.int64)
                        for x in range(0, hi - lo, BATCH):
                            learn(w, s, bias, rows[x : x + BATCH], cell[x : x + BATCH])
                    seen += len(tokens)
            if seen:
                part = TaskContext.get().partitionId()
                change, grown = ((w - w0) * np.float32(seen)).reshape(-1, PIECE, WIDTH), (s - s0).reshape(-1, PIECE)
                yield pd.DataFrame({"part": [part], "piece": [-1], "n": [seen], "parts": [1], "change": [b""], "squares": [b""]})
                for i in np.flatnonzero(np.abs(change).max(axis=(1, 2))):
                    yield pd.DataFrame({"part": [part], "piece": [i], "n": [0], "parts": [1], "change": [halved(change[i])], "squares": [halved(grown[i])]})

        def added(rows: pd.DataFrame) -> pd.DataFrame:
            change, squares = np.zeros(PIECE * WIDTH, np.float32), np.zeros(PIECE, np.float32)
            for r in rows.itertuples(index=False):
                if r.piece >= 0:
                    change += doubled(r.change)
                    squares += doubled(r.squares)
            out = {"part": rows["part"].iloc[:1] // fan_in, "piece": rows["piece"].iloc[:1], "n": [rows["n"].sum()], "parts": [rows["parts"].sum()]}
            return pd.DataFrame(out | {"change": [halved(change)], "squares": [halved(squares)]})

        kinds = "part int, piece int, n long, parts long, change binary, squares binary"
        changes = found.select("held", "n_tokens", "tokens", "marks", "cells").mapInPandas(run, kinds)
        for _ in range(levels):
            changes = changes.groupBy("piece", F.floor(F.col("part") / fan_in)).applyInPandas(added, kinds)
        summed = changes.collect()  # the model's rows
        total = sum(r["n"] for r in summed)
        for r in summed:
            if r["piece"] >= 0:
                at = slice(r["piece"] * PIECE, (r["piece"] + 1) * PIECE)
                w[at] += doubled(r["change"]).reshape(PIECE, WIDTH) / np.float32(total)
                squares[at] += doubled(r["squares"]) / np.float32(r["parts"])
        shared.unpersist()
    return w


def score(found: DataFrame, words: DataFrame, w: np.ndarray, bias: Biases, cells_n: np.ndarray, cells_v: np.ndarray, n: int, v: int) -> DataFrame:
    """The documents' scores. words: block, local, c (the word's training count) of the words that other blocks count too."""
    shared = found.sparkSession.sparkContext.broadcast((w, bias))
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        w, bias = shared.value
        row = next(block.itertuples(index=False))
        tokens, lengths, marks, cells = opened(row)
        c = unpacked(row.counts).astype(np.int64)
        c[known["local"].to_numpy()] = known["c"].to_numpy()
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1))) if n else np.zeros(len(c))
        inner = np.log10((c + 0.5) / (cells_n[cells] + 0.5 * (cells_v[cells] + 1))) if n else np.zeros(len(c))
        first = np.zeros(len(tokens), bool)
        starts = np.cumsum(lengths) - lengths
        first[starts] = True
        of = inner[tokens]
        for lo in range(0, len(tokens) if n else 0, BATCH):
            hi = min(len(tokens), lo + BATCH)
            a = max(0, lo - 3)
            rows = histories(tokens[a:hi], np.r_[True, first[a + 1 : hi]], marks, cells)[lo - a :]
            of[lo:hi] += log_shares(w, bias, rows, cells[tokens[lo:hi]].astype(np.int64))[0] / np.log(10)
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], "Int64"), "held_out": np.asarray(row.held, bool), "n_tokens": lengths,
            "n_known": np.add.reduceat((c > 0)[tokens].astype(np.int64), starts), "train_tokens": n,
            "base_score": np.add.reduceat(base[tokens], starts), "score": np.add.reduceat(of, starts),
        })

    return found.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(run, kinds)


def scores(docs: DataFrame, tokens: int = BLOCK_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    found = materialize(blocks(docs, tokens), "blocks")
    words = spread(vocabulary(found))
    distinct = words.where("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("v")).collect()  # CELLS rows at most
    cells_n, cells_v = cell_counts(found), np.zeros(CELLS, np.int64)
    for r in distinct:
        cells_v[r["cell"]] = r["v"]
    bias = Biases.of(cells_n)
    w = train(found, bias, rounds) if cells_n.sum() else np.zeros((FEATURES * ROWS, WIDTH), np.float32)
    back = words.where("block IS NOT NULL").select("block", "local", "c")
    return score(found.drop("hashes"), back, w, bias, cells_n, cells_v, int(cells_n.sum()), int(cells_v.sum()))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
