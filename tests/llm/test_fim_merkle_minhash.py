from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import fim, merkle, minhash, simhash

# --- fill-in-the-middle


def units(text: str, unit: str) -> list[str]:
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+$", text)
    words = re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text)
    lead = re.match(r"[ \t\n\v\f\r]*", text)[0]
    return [lead + words[0], *words[1:]] if words else [text] if text else []


def brute_fim(doc_id, text, unit="char", rate=90, spm_rate=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    g = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[i : i + 8], 16) for i in range(0, 32, 8)]
    u = units(text, unit)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    p, s, m = marks
    out = s + z + p + x + m + y if h[3] % 100 < spm_rate else p + x + s + z + m + y
    return doc_id, len(u), "spm" if h[3] % 100 < spm_rate else "psm", a, b - a, out


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_texts_are_cut_and_come_back(spark, docs, rows, none, unit):
    extra = [(200 + i, t) for i, t in enumerate(["a<P>b", "<", "P><S", "é", "\U0001f600" * 3, "  lead", "a\n\nb\n", "\n", " \t "])]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    out = fim.transform(d, unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    given = [(r[0], r[1]) for r in rows] + extra
    assert Counter(tuple(r)[:6] for r in out) == Counter(brute_fim(i, t, unit) for i, t in given)
    assert Counter((r["doc_id"], r["back"]) for r in out) == Counter((i, t or "") for i, t in given)
    assert fim.transform(none, unit).count() == 0


def test_forms_and_sentinels(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), F.lit(1).alias("n"), F.lit("x").alias("form"))
    kinds = Counter(r["form"] for r in fim.transform(d, rate=100, spm_rate=50, sentinels=("[P]", "[S]", "[M]")).collect())
    assert set(kinds) == {"psm", "spm"} and min(kinds.values()) > 150
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "x"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transform(d, sentinels=bad)


def test_masks_of_a_long_text():
    rng = random.Random(3)
    data = "".join(rng.choice("ab é文\U0001f600\n") for _ in range(700_000)).encode()
    ends = fim.unit_ends(data)
    want = [i for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]
    assert ends.bit_count() == len(want)
    for rank in (0, 1, 77_777, len(want) // 2, len(want) - 1):
        assert fim.select(ends, rank, len(data)) == want[rank]


# --- Merkle manifest


def joined(items):
    return hashlib.sha256("".join(items).encode()).hexdigest()


def brute_manifest(rows, arity=2):
    """rows (lang, key, leaf, tampered) to key, leaf, subroot, root, proof, folded, verified."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([joined(levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    trees = [tree([r[2] for r in groups[g]]) for g in names]
    upper = tree([t[-1][0] for t in trees])

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // arity * arity : i // arity * arity + arity]
            out.append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
            i //= arity
        return out

    out = []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = way(trees[g], i) + way(upper, g)
            digest = r[3]
            for slot, others in path:
                digest = joined([*others[:slot], digest, *others[slot:]])
            root = upper[-1][0]
            out.append((r[1], r[2], trees[g][-1][0], root, joined([x for _, o in path for x in o]), digest, digest == root))
    return Counter(out)


@pytest.mark.parametrize(("arity", "depth"), [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_manifest_against_brute_force(spark, arity, depth):
    rng = random.Random(arity)
    rows = []
    for lang, n in ((None, 7), ("", 1), ("de", 64), ("en", 201), ("é", 2), ("zz", 9)):
        for _ in range(n):
            leaf = joined([str(rng.random())])
            rows.append((lang, rng.randrange(150) if rng.random() < 0.97 else None, leaf, joined([leaf]) if rng.random() < 0.2 else leaf, "clash"))
    rows += [rows[3], rows[3], rows[100]]
    d = spark.createDataFrame(rows, "lang string, key long, leaf string, tampered string, rank string").repartition(5)
    got = merkle.manifest(d, "lang", "key", arity=arity, depth=depth).collect()
    assert Counter(map(tuple, got)) == brute_manifest([r[:4] for r in rows], arity)
    assert merkle.manifest(d.limit(0), "lang", "key").count() == 0


def test_parents_complete_whatever_the_order_and_split():
    rng = random.Random(1)
    nodes = [(i, hashlib.sha256(str(i).encode()).digest(), None) for i in range(77)]
    tops, links = set(), set()
    for _ in range(20):
        rng.shuffle(nodes)
        parts = [merkle.Block(77, 0, 2, 10) for _ in range(rng.randint(1, 9))]
        for n in nodes:
            rng.choice(parts).add(n)
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.merge(p)
        assert not whole.waiting
        tops.add(whole.top)
        links.add(tuple(sorted(whole.links.items())))
    assert len(tops) == len(links) == 1 and None not in tops


def test_originals_are_folded_too():
    """The root of every leaf is recomputed from its siblings, so a wrong sibling shows on rows that nobody tampered with."""
    block = merkle.Block(5, 0, 2, 10)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5)]
    for i, d in enumerate(digests):
        block.add((i, d, (i, None)))
    assert all(r[-1] and r[-2] == block.top.hex() for r in merkle.verdicts(block, block.top, block.top, []))
    block.links[0, 1] = (digests[2], digests[0])
    assert [r[-1] for r in merkle.verdicts(block, block.top, block.top, [])] == [True, True, False, True, True]


def test_leaves_count_bytes_and_nulls(spark):
    d = spark.createDataFrame([(1, None, "é"), (None, 12, "")], "a long, b long, c string")
    got = [r[0] for r in d.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [hashlib.sha256("1:1-2:é".encode()).hexdigest(), hashlib.sha256(b"-2:120:").hexdigest()]


def test_tampered_rows_do_not_verify(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    for r in merkle.op11(spark, str(tmp_path)).collect():
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] == (not hit or r["doc_id"] == 120)  # 120 has no n_chars


# --- MinHash


def set_of(text, width=2):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_near(rows, hundredths=80):
    """rows (doc_id, text) to doc_id, n_shingles, component, kept."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and root[i] != root[j] and 100 * both >= hundredths * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = defaultdict(list)
    for (doc_id, _), r in zip(rows, root, strict=True):
        least[r].append(doc_id)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((d, len(s), name[r], d == name[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))


def families(seed=2, n=25, long_star=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for family in range(n):
        base = [word() for _ in range(rng.choice((3, 12, 60, 200)))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(int(len(base) * rng.uniform(0, 0.12)) + 1):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    star = [word() for _ in range(120)]
    for _ in range(long_star):
        copy = list(star)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    half = [word() for _ in range(60)]
    texts += [" ".join(half + [word() for _ in range(60)]) for _ in range(60)]  # clean texts that share their half
    texts += [f"of the {word()}" for _ in range(60)] + ["of the"] * 3 + ["Of", "of", "x"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def near(spark, rows, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, size string, node long").repartition(4)
    return Counter(map(tuple, minhash.near_duplicates(d, **kw).collect()))


def test_near_duplicates_against_brute_force(spark, docs, rows, none):
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == brute_near([(r[0], r[1]) for r in rows])
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("list_rows", "block", "cut"), [(minhash.LIST_ROWS, None, minhash.CUT_ROWS), (40, (30, 1 << 21), 8), (10, (7, 2000), 2)])
def test_long_lists_and_large_groups_lose_no_link(spark, monkeypatch, list_rows, block, cut):
    if block:
        monkeypatch.setattr(simhash.resembling, "__defaults__", (simhash.RESEMBLANCE, block))
    monkeypatch.setattr(minhash, "CUT_ROWS", cut)
    rows = families()
    assert near(spark, rows, list_rows=list_rows) == brute_near(rows)


def test_copies_of_a_large_group_travel_once(spark, monkeypatch):
    """Rows shipped grow with the group, not with its square, where a pivot connects it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(80)]
    shipped = []
    for n in (300, 1200):
        rows = []
        for i in range(n):
            copy = list(base)
            copy[rng.randrange(80)] = word()
            rows.append((i, " ".join(copy)))
        loose = spark.createDataFrame([(i, 0, 79, (False, i, None)) for i in range(n)], "node long, root long, n_shingles long, least struct<none boolean, doc_id long, text_hash long>")
        d = spark.createDataFrame(rows, "doc_id long, text string")
        loose = loose.drop("least").join(d.select(F.col("doc_id").alias("node"), F.struct(F.lit(False).alias("none"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("least")), "node")
        links = simhash.resembling(loose, d, 2, 80, (50, 1 << 21))
        found = links.collect()
        shipped.append(len(found))
        assert len({r["a"] for r in found}) == 1 and {r["b"] for r in found} | {found[0]["a"]} == set(range(n))
    assert shipped == [299, 1199]


def test_signatures_agree_as_often_as_sets_resemble():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**64 - 1, 1800, dtype=np.uint64))
    a, b = np.sort(h[:1000]), np.sort(h[200:1200])  # resemblance 2 / 3
    pairs = [minhash.signatures([np.unique(rng.permutation(x) * np.uint64(2 * k + 1)) for x in (a, b)]) for k in range(60)]
    assert abs(np.mean([(x == y).mean() for x, y in pairs]) - 2 / 3) < 0.04
    assert minhash.multipliers()[0].dtype == np.uint64 and len(set(minhash.multipliers()[0].tolist())) == minhash.COORDINATES
