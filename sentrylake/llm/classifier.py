"""Quality classifier: random Fourier features of document statistics, ridge scores and isotonic calibration.

Statistics of whole texts are standardised by the means and deviations of all documents. Random Fourier features of
fixed seed approximate a Gaussian kernel over them. Tasks sum the normal equations of their labelled rows, and their sums
are summed by row of the matrix, in bounded fan-in; the driver solves one system of FEATURES + 1 unknowns. Raw scores of
the labelled rows of a fold that the ridge has not seen are counted into 1024 bins, and a pool of adjacent violators over
those makes them probabilities.

All labelled training rows are used. Labels, lang, source and doc_id are never inputs of a score.

Defined results: a null or empty text has the statistics of a text without words and gets their score; a null doc_id is
scored, is never labelled and counts as held out as the remainder of an empty text says (crc32 of it is 0); a document's
repeated labels count once, by their maximum, and null labels not at all; without any labelled row every score is 0.5;
repeated rows are scored one by one; equal texts have equal scores, and raw scores of one bin tie and share its
probability; very long texts are read whole, and their statistics
are bounded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.common import materialize

STATS = ("log_words", "mean_length", "length_spread", "capitals", "symbols", "digits", "punctuation", "duplicate_lines", "stutter", "distinct", "top_word", "repeats", "line_words", "no_letters")
FEATURES = 256
#: Width of the kernel, in standard deviations of the statistics.
WIDTH = 3.0
RIDGE = 1.0
BINS = 1024
LOW, HIGH = -0.5, 1.5
SYMBOL = re.compile(r"[#*$%&|<>@_~^=+{}\\]")
DIGIT = re.compile(r"[0-9]")
PUNCTUATION = re.compile(r"[.,;:!?]")
THRESHOLD = 0.3
#: Of so many folds of the labelled rows, one calibrates.
FOLDS = 5
#: Tasks whose sums are added at once.
FAN_IN = 256


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, each of a bounded range."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")  # bytes are split at the six ASCII white-space characters alone
    words = b" ".join(raw.split()).decode("utf-8", "surrogatepass").split(" ") if raw and not raw.isspace() else []
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    pairs = Counter(zip(words, words[1:], words[2:], strict=False))
    return [
        float(np.log1p(n)), float(min(lengths.mean(), 30)), float(min(lengths.std(), 30)), sum(map(str.isupper, words)) / n,
        min(len(SYMBOL.findall(text)) / n, 5.0), min(len(DIGIT.findall(text)) / n, 5.0), min(len(PUNCTUATION.findall(text)) / n, 5.0),
        1 - len(set(lines)) / len(lines), sum(map(str.__eq__, words, words[1:])) / n, len(counts) / n**0.8, max(counts.values()) / n,
        1 - len(pairs) / max(n - 2, 1) if n > 2 else 0.0, float(np.log1p(n / len(lines))), sum(not w[0].isalpha() and not w[-1].isalpha() for w in words) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS (float) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]], np.float32).reshape(len(batch), len(STATS))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")} | {s: x[:, i] for i, s in enumerate(STATS)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, " + ", ".join(f"{s} float" for s in STATS))


class FourierFeatures:
    """Features whose inner products approximate exp(-|x - y|^2 / (2 WIDTH^2)) over standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, 1 / WIDTH, (len(STATS), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(x))]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def pooled(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ones in bins of n rows each, by pooling adjacent violators; empty bins are interpolated."""
    full = np.flatnonzero(n)
    if not len(full):
        return np.full(len(n), 0.5)
    blocks: list[list[float]] = []  # ones, rows, bins
    for i in full:
        blocks.append([float(ones[i]), float(n[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.repeat(np.arange(len(blocks)), [int(b[2]) for b in blocks])
    # a block's share stands at its mean bin, and shares between blocks are interpolated
    where = np.array([np.average(full[at == k], weights=n[full[at == k]]) for k in range(len(blocks))])
    share = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])
    return np.interp(np.arange(len(n)), where, np.maximum.accumulate(share))


def fit(stats: DataFrame, labelled: DataFrame) -> tuple[FourierFeatures, np.ndarray, np.ndarray]:
    """(features, weights, calibrated share of each bin) from stats of all rows and labelled rows (STATS, label, fold).

    The ridge is fitted on all folds but 0, which calibrates it; where that leaves either without rows, both see all.
    """
    sums = stats.agg(*[F.avg(s).alias(f"m_{s}") for s in STATS], *[F.stddev_pop(s).alias(f"d_{s}") for s in STATS]).first()
    mean = np.array([sums[f"m_{s}"] or 0.0 for s in STATS])
    spread = np.array([sums[f"d_{s}"] or 0.0 for s in STATS])
    features = FourierFeatures(mean, np.where(spread > 1e-9, spread, 1.0))
    size = FEATURES + 1

    sizes = {r["f"]: r["n"] for r in labelled.groupBy((F.col("fold") == 0).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    both = len(sizes) == 2
    fitted, calibrating = (labelled.where("fold <> 0"), labelled.where("fold = 0")) if both else (labelled, labelled)

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = features(batch[list(STATS)].to_numpy(np.float64))
            total += z.T @ np.c_[z, batch["label"].to_numpy(np.float64)]
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "i": range(size), "row": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1] // FAN_IN, "i": rows["i"].iloc[:1], "row": [np.sum(np.stack(rows["row"].tolist()), axis=0)]})

    kinds, parts = "part int, i int, row array<double>", fitted.mapInPandas(normal, "part int, i int, row array<double>")
    # sums of FAN_IN tasks at most, and sums of those, until all tasks' are one
    for _ in range(max(1, math.ceil(math.log(max(2, fitted.rdd.getNumPartitions()), FAN_IN)))):
        parts = parts.groupBy("i", F.floor(F.col("part") / FAN_IN)).applyInPandas(added, kinds)
    found = {r["i"]: r["row"] for r in parts.collect()}  # FEATURES + 1 rows
    if not found:
        return features, np.zeros(size), np.full(BINS, 0.5)
    system = np.array([found[i] for i in range(size)])
    weights = np.linalg.solve(system[:, :size] + RIDGE * np.eye(size), system[:, size])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            at = bin_of(features(batch[list(STATS)].to_numpy(np.float64)) @ weights)
            n += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=batch["label"].to_numpy(np.float64), minlength=BINS).astype(np.int64)
        full = np.flatnonzero(n)
        yield pd.DataFrame({"bin": full, "n": n[full], "ones": ones[full]})

    rows = calibrating.mapInPandas(binned, "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()  # BINS rows at most
    n, ones = np.zeros(BINS), np.zeros(BINS)
    for r in rows:
        n[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    return features, weights, pooled(n, ones)


def place(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS - 0.5, 0, BINS - 1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.rint(place(raw)).astype(np.int64)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = materialize(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = materialize(stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select(*STATS, "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")), "labelled")
    features, weights, shares = fit(stats, labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = features(batch[list(STATS)].to_numpy(np.float64)) @ weights
            score = np.clip(np.interp(place(raw), np.arange(BINS), shares), 0.0, 1.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    return stats.withColumn("held_out", held_out(F.col("doc_id"))).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
