from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrylake.llm import mixing, packing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_against_brute_force(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = brute_targets(sizes)
    draws = defaultdict(list)
    for i, text, _, source, *_ in rows:
        n = size(text)
        u = (int(hashlib.md5(f"7|{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        mean = len(text or "") / max(n, 1)
        q = max(0.5, 1 - abs(mean - 6) / 12) * max(0.5, min(1.0, n / 50))
        draws[source].append((-math.log(u) / q, -1 if i is None else i, n))
    want = Counter()
    for s, found in draws.items():
        epochs = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        run = 0
        for _, i, n in sorted(found):
            run += n
            want[(None if i < 0 else i, s)] += n * (epochs + (2 * run - n <= 2 * (target[s] - epochs * sizes[s])) if n else 0)
    have = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        have[(r["doc_id"], r["source"])] += r["taken"]
    assert +have == +want


def test_mix_is_the_same_again_and_expands(docs, none):
    key = lambda r: (str(r["doc_id"]), r["text_hash"], r["taken"])
    a, b = (sorted(map(key, mixing.mix(d).collect())) for d in (docs, docs.repartition(5)))
    assert a == b
    mixed = mixing.expand(docs)
    assert mixed.columns == docs.columns
    words = sum(size(r["text"]) for r in mixed.collect())
    assert words == sum(r[2] for r in a)
    assert mixing.mix(none).count() == 0 and mixing.expand(none).count() == 0


def test_rows_of_one_text_keep_their_own_columns(spark):
    rows = [(i, f"w{i} " * 20, lang, "a") for i in range(30) for lang in ("en", "fr", None)] + [(7, "w7 " * 20, "en", "a")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = Counter((r["doc_id"], r["lang"]) for r in mixing.expand(d).collect())
    again = Counter((r["doc_id"], r["lang"]) for r in mixing.expand(d.repartition(2)).collect())
    assert got == again and {(i, x) for i, _, x, _ in rows} == set(got) and sum(got.values()) == len(rows)
    assert got[(7, "en")] == 4


def test_empty_texts_take_nothing(spark):
    d = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(d).collect()] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plan_is_gapless_best_fit(lengths):
    runs = sorted(Counter(lengths).items(), reverse=True)
    steps = packing.plan(runs, 64)
    place, rank = [], 0
    at = np.array([s[0] for s in steps], int)
    for size_, n in runs:
        for _ in range(n):
            k = int(np.searchsorted(at, rank, side="right")) - 1
            place.append((steps[k][1] + rank - steps[k][0], steps[k][2], size_))
            rank += 1
    by = defaultdict(list)
    for s, o, n in place:
        by[s].append((o, n))
    for items in by.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= 64
    # best-fit decreasing, one by one
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(64 - n)
        else:
            gaps[gaps.index(fit)] -= n
    assert len(by) == len(gaps)


def test_pack_against_the_tokenizer(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= 4096
    assert packing.pack(none).count() == 0


def test_words_are_tokenised_as_in_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["It's  a b c\x0bd\x1ce <|endoftext|> ÀÉ é I'LL\r\nx", "<|startoftext|>", "", " \t\n", "don't 123 4-5 ΣΑΣ İ ǅ \U0001f600\U0001f600 a​b"]
    tokenizer, want = packing.WordTokenizer(packing.tokenizer_path()), [t.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        ids, first = tokenizer.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want


def test_texts_of_megabytes_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    rng = np.random.default_rng(5)
    long = " ".join("".join(rng.choice(list("abcdefgh"), 5)) + "," * (i % 7 == 0) for i in range(300_000))
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(packing.tokenizer_path()).encode(long, add_special_tokens=False).ids, 1]
    tokenizer = packing.WordTokenizer(packing.tokenizer_path())
    got, first = tokenizer.encode(pa.array(["a b", long, "x"]))
    assert got[first[1] : first[2]].tolist() == ids[:-1]
    cut = packing.pieces(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string")).where("doc_id = 1").orderBy("piece").collect()
    assert [(r["start"], r["length"], r["ids_crc32"]) for r in cut] == [(k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
