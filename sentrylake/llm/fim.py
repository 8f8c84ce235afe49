"""Fill-in-the-middle: texts are cut in three and rearranged so that a model learns to write the middle part.

Cuts fall between units (code points, words or lines). A text's UTF-8 bytes become big integers with one bit a byte:
``bytes.translate`` gives the mask of a class of bytes, shifts and boolean operations on whole masks mark the units' last
bytes, ``bit_count`` gives their number n, and the place of the unit of a given rank is found by halving the mask, which
takes time in proportion to the text. Nothing is done byte by byte in Python, and no text meets another one.

Defined results: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain, as does any text
that its hash chooses; a null doc_id counts as an empty number; equal doc_ids have equal hashes, so repeated rows give
repeated rows; texts of any length are cut whole; malformed UTF-8 is cut before bytes that aren't continuations;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts so many are rearranged, and of 100 of these so many begin with the suffix.
RATE, SPM_RATE = 90, 20

BLANKS = b" \t\n\v\f\r"


def _class(members) -> bytes:
    """A translation of the bytes for which members is true to 1, and of all others to 0."""
    return bytes(ord("1") if members(b) else ord("0") for b in range(256))


LEADS, WORDS, NEWLINES = _class(lambda b: b & 0xC0 != 0x80), _class(lambda b: b not in BLANKS), _class(lambda b: b == 0x0A)


def mask(data: bytes, table: bytes) -> int:
    """Bit i is 1 where byte i belongs to the table's class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def unit_ends(data: bytes, unit: str = "char") -> int:
    """Bit i is 1 where byte i is the last of a unit.

    A unit is a code point ("char"), a word with the blanks behind it ("word"; blanks before the first word belong to it),
    or a line with its newline ("line").
    """
    if not data:
        return 0
    last = 1 << (len(data) - 1)
    if unit == "char":
        return mask(data, LEADS) >> 1 | last
    if unit == "line":
        return mask(data, NEWLINES) | last
    words = mask(data, WORDS)
    starts = words & ~(words << 1)
    starts ^= starts & -starts  # the first word's unit begins with the text
    return starts >> 1 | last


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it, by halving the part that holds it."""
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    return at


def cuts(data: bytes, draws: tuple[int, int], unit: str = "char") -> tuple[int, tuple[int, int], tuple[int, int]]:
    """n, the two cuts in units (each draw modulo n + 1, in order) and in bytes."""
    ends = unit_ends(data, unit)
    n = ends.bit_count()
    ranks = sorted(d % (n + 1) for d in draws)
    places = [select(ends, r - 1, len(data)) + 1 if r else 0 for r in ranks]
    return n, (ranks[0], ranks[1]), (places[0], places[1])


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from the key's text and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, unit: str = "char", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_units, middle_units (null where plain) and output of every document.

    psm is prefix, suffix and middle, each behind its sentinel; spm begins with the suffix.
    """
    marks = [s.encode() for s in sentinels]
    pairs = [(s, t) for s in sentinels for t in sentinels]
    if "" in sentinels or sum(s in t for s, t in pairs) > 3 or any(t.startswith(s[k:]) for s, t in pairs for k in range(1, len(s))):
        raise ValueError("sentinels must not be empty, hold each other or overlap")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, s, m = marks
        for batch in batches:
            out = []
            for doc_id, data, h1, h2, h3, h4 in batch.itertuples(index=False, name=None):
                n, ranks, (a, b) = cuts(data, (h1, h2), unit)
                if not data or h3 % 100 >= rate or any(x in data for x in marks):
                    out.append((doc_id, n, "plain", None, None, data))
                    continue
                first, middle, rest = data[:a], data[a:b], data[b:]
                spm = h4 % 100 < spm_rate
                parts = (s, rest, p, first, m, middle) if spm else (p, first, s, rest, m, middle)
                out.append((doc_id, n, "spm" if spm else "psm", ranks[0], ranks[1] - ranks[0], b"".join(parts)))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])
            yield frame.astype({"doc_id": "Int64", "n": "int64", "prefix_units": "Int64", "middle_units": "Int64"})

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *draws(F.col("doc_id").cast("long"), seed))
    out = rows.mapInPandas(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made of. No part of a rearranged text holds a sentinel, so each is found once."""
    p, s, m = sentinels
    before = lambda c, mark: F.substring_index(c, mark, 1)
    behind = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(before(behind(output, p), s), behind(output, m), before(behind(output, s), m))
    spm = F.concat(before(behind(output, p), m), behind(output, m), before(behind(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
h AS (SELECT *, length(t) AS n, ('0x' || substr(g, 1, 8))::BIGINT AS h1, ('0x' || substr(g, 9, 8))::BIGINT AS h2, ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
