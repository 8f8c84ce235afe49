"""Quality rules as a short-circuit cascade.

The rules are run on a sample first, which gives each one's cost and the share of texts that it rejects; the cascade then
runs them in descending order of rejections per cost and stops at the first that rejects. The order never changes a
verdict, only the work. Where base figures are asked for, they are computed of every text and the cascade has the other
rules; where verdicts alone are, the base rules are part of it.

Defined results: a null text counts as empty and, having fewer than ten words, fails the base rules; repeated rows are
judged one by one; rules of equal worth run in order of name; very long texts are judged whole, and no rule depends on
a length beyond which it is off; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
#: Rows (about) of the sample that the rules' costs and selectivities are estimated on.
SAMPLE_ROWS = 2000


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[tuple, int] = {}
    twice: set[int] = set()
    for i, window in enumerate(zip(*(words[k:] for k in range(WINDOW)), strict=False)):
        first = seen.setdefault(window, i)
        if first != i:
            twice.add(first)
            twice.add(i)
    total, end = 0, 0
    for i in sorted(twice):
        total += i + WINDOW - max(i, end)
        end = i + WINDOW
    return total


class Text:
    """A text and its figures, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def strings(self) -> list[str]:
        """The words as text; only the six ASCII white-space characters part them."""
        return b" ".join(self.words).decode("utf-8", "surrogatepass").split(" ") if self.words else []

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "surrogatepass"))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[bytes]:
        """The lines that have a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true for a text that goes."""

    name: str
    rejects: Callable[[Text], bool]


def _symbols(t: Text) -> bool:
    """More than three symbols for ten words: decorated words and tables."""
    return 10 * t.n_symbols > 3 * t.n_words


def _duplicate_lines(t: Text) -> bool:
    """Over three lines in ten repeat an earlier one; one or two such lines are no boilerplate."""
    return t.n_dup_lines > 2 and 10 * t.n_dup_lines > 3 * len(t.lines)


def _word_length(t: Text) -> bool:
    """Words of under 2 or over 20 code points on average."""
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


def _shouting(t: Text) -> bool:
    """Over half the words are in capitals."""
    return 2 * sum(map(str.isupper, t.strings)) > t.n_words


def _few_letters(t: Text) -> bool:
    """Under half the words have a letter with two cases, and the text is not in a script without cases."""
    return t.text.isascii() and 2 * sum(w.upper() != w.lower() for w in t.strings) < t.n_words


def _one_word(t: Text) -> bool:
    """A few words said again and again: clean texts of n words have twice n ** 0.8 / 2.5 distinct ones and more, whatever n is."""
    return 10 * len(set(t.words)) < 4 * t.n_words**0.8


def _stutter(t: Text) -> bool:
    """Over three words in ten equal the word before them."""
    return 10 * sum(map(bytes.__eq__, t.words, t.words[1:])) > 3 * t.n_words


def _few_words(t: Text) -> bool:
    return t.n_words < 10


def _repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > 20 * t.n_words


RULES = (
    Rule("symbols", _symbols), Rule("duplicate_lines", _duplicate_lines), Rule("word_length", _word_length), Rule("shouting", _shouting),
    Rule("few_letters", _few_letters), Rule("one_word", _one_word), Rule("stutter", _stutter),
)
#: The base rules as rules of the cascade, where verdicts alone are asked for.
ALL_RULES = (Rule("few_words", _few_words), Rule("repeats", _repeats), *RULES)


def measure(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, int, int]]:
    """(rule, seconds, texts, rejected) over a sample's texts (for RULES those that pass the base rules); every rule sees every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, seen, hit = dict.fromkeys((r.name for r in rules), 0.0), 0, dict.fromkeys((r.name for r in rules), 0)
        for batch in batches:
            for text in batch["text"]:
                t = Text(text)
                if t.base_failed and rules is RULES:
                    continue
                seen += 1
                for r in rules:
                    t = Text(text)
                    t.words, t.strings  # noqa: B018 (split by whichever rule comes first)
                    began = time.perf_counter()
                    hit[r.name] += r.rejects(t)
                    spent[r.name] += time.perf_counter() - began
        yield pd.DataFrame([(k, spent[k], seen, hit[k]) for k in spent], columns=["rule", "seconds", "texts", "rejected"])

    out = sample.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "rule string, seconds double, texts long, rejected long")
    rows = out.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("texts").alias("texts"), F.sum("rejected").alias("rejected")).collect()  # a row for each rule
    return [tuple(r) for r in rows]


def order_rules(measured: list[tuple[str, float, int, int]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules in descending order of rejections per second; half a rejection is lent to a rule that made none."""
    worth = {name: (rejected + 0.5) / (seconds + 1e-6) for name, seconds, _, rejected in measured}
    return tuple(sorted(rules, key=lambda r: (-worth.get(r.name, 0.0), r.name)))


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Orders the rules by a random sample of about ``sample_rows`` rows (only the order depends on it)."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    return order_rules(measure(docs.select("text").sample(share, seed=1), rules), rules)


def verdict(text: str | None, order: tuple[Rule, ...]) -> tuple[Text, bool, bool]:
    """The text with its figures, whether the base rules reject it, and whether it is kept."""
    t = Text(text)
    return t, t.base_failed, not t.base_failed and not any(r.rejects(t) for r in order)


def judge(docs: DataFrame, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """STATS of every document."""
    order = plan_cascade(docs) if order is None else order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [verdict(t, order) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"]})
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                out[name] = [getattr(t, name) for t, _, _ in rows]
            out["base_failed"] = [b for _, b, _ in rows]
            out["kept"] = [k for _, _, k in rows]
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, STATS)


def keep(docs: DataFrame, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """The documents that pass, with all their columns. The base rules are part of the cascade, and no figure is computed in vain."""
    order = plan_cascade(docs, ALL_RULES) if order is None else order

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        return pd.Series([not any(r.rejects(t) for r in order) for t in map(Text, text)], dtype=bool)

    return docs.where(passes(F.col("text").cast("string")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
