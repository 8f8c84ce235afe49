from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylake.llm import archives, packing, quality_rules, secrets, simhash
from sentrylake.llm.common import global_rank


def brute(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        again = b in first and i != first[b]
        out[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)] += 1
    return out


PAGES = [
    (1, "http://a/ b", "<p>é\U0001f600\r\n\r\nWARC/1.1\r\n" * 9), (2, None, None), (3, "", ""), (4, "u", "x" * 100), (5, "u", "x" * 100), (5, "u", "x" * 100), (4, "v", "x" * 100),
    (6, "u", "y" * 99), (7, "u", "y" * 99), (None, "n", "x" * 100), (8, "big", "z\n" * 60000), (9, "tail", "ends with lines\n\n\r\n" * 20),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    back, _, _ = archives.convert(spark, archives.to_arc(pages, "page_id", "url", "html", per_file=3), f"file://{tmp_path}/warc", archives.MARK)
    rows = back.collect()
    assert len(rows) == len(PAGES)
    bodies = Counter((r["key"], r["body"]) for r in rows if r["record_type"] == "response")
    want = brute(PAGES)
    assert Counter((r["key"], r["record_type"], r["refers_to"]) for r in rows) == _summed(want)
    assert all((i, (h or "").encode()) in bodies for i, _, h in PAGES if (i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response", None) in want)
    pages.write.parquet(f"file://{tmp_path}/sf/pages.parquet")
    got = archives.op4(spark, f"file://{tmp_path}/sf").collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    pages.where("false").write.parquet(f"file://{tmp_path}/none/pages.parquet")
    assert archives.op4(spark, f"file://{tmp_path}/none").count() == 0


def test_foreign_archives_of_any_bytes(spark, tmp_path):
    """Payloads in other encodings, marks in URLs, spaces in URLs, addresses and payloads of every size survive the round trip."""
    bodies = [("http://x/#id=abc", "192.0.2.7", "caf\xe9 ".encode("latin-1") * 30), (f"http://y/{archives.MARK}z", "-", bytes(range(256)) * 5), ("http://x y", "0.0.0.0", b"\xff\xfe\r\n\r\nWARC/1.1\r\n" * 900),
              ("http://caf\u00e9/", "198.51.100.1", b""), ("http://big", "-", b"\xc3" * 3_000_000), ("http://again", "-", b"\xc3" * 3_000_000), ("http://mid", "-", b"m" * 40_000)]
    data = archives.arc_version_block(1, "f.arc", "20240101000000")
    for url, ip, body in bodies:
        data += f"{url} {ip} 20240102030405 text/html {len(body)}".encode("utf-8" if "caf" not in url else "latin-1") + b"\n" + body + b"\n"
    arcs = spark.createDataFrame([(bytearray(data),)], "arc binary")
    back, path, rejects = archives.convert(spark, arcs, f"file://{tmp_path}/warc", file_bytes=5_000_000)
    rows = {r["url"]: r for r in back.collect()}
    for url, ip, body in bodies:
        r = rows[url.replace(" ", "%20")]
        again = url == "http://again"
        assert bytes(r["body"]) == (b"" if again else body) and r["declared_digest"] == hashlib.sha256(body).hexdigest() and r["record_type"] == ("revisit" if again else "response")
        assert r["ip"] == (ip if ip[0] == "1" else None)
    assert rejects.isEmpty() and len(rows) == len(bodies) and {p.name for p in (tmp_path / "warc").iterdir()} == {"size=0", "size=1", "size=5"}


def test_pages_may_be_bytes(spark):
    pages = spark.createDataFrame([(1, "u", bytearray(b"\xe9" * 120)), (2, "v", bytearray(b"\xe9" * 120)), (3, None, None)], "page_id long, url string, html binary")
    rows = {r["key"]: r for r in archives.convert(spark, archives.to_arc(pages, "page_id", "url", "html", bytes_per_file=100), mark=archives.MARK)[0].collect()}
    assert (rows[1]["record_type"], rows[2]["record_type"], rows[2]["refers_to"], bytes(rows[1]["body"])) == ("response", "revisit", 1, b"\xe9" * 120) and rows[3]["url"] == "-"


def _summed(want):
    out = Counter()
    for (a, _, _, d, e), n in want.items():
        out[(a, d, e)] += n
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = b"two\n\nlines http://x 0.0.0.0 20240101000000 text/html 5\n"
    data = archives.arc_version_block(version, "f.arc", "20240101000000") + archives.arc_header(version, "http://x y", "20240102030405", "text/html", len(body)) + body + b"\n" + archives.arc_header(version, "http://z", "20240102", "", 0) + b"\n"
    got = list(archives.parse_arc(data))
    assert [p for _, p in got] == [body, b""] and got[0][0]["url"] == "http://x%20y" and got[1][0]["type"] == "no-type"
    with pytest.raises(archives.Broken):
        list(archives.parse_arc(data[:-20]))


DATES = {
    None: "1970-01-01T00:00:00Z", "": "1970-01-01T00:00:00Z", "-": "1970-01-01T00:00:00Z", "2024": "2024-01-01T00:00:00Z", "202405": "2024-05-01T00:00:00Z", "20240102": "2024-01-02T00:00:00Z",
    "202401020304": "2024-01-02T03:04:00Z", "20240102030405": "2024-01-02T03:04:05Z", "20240102030405678": "2024-01-02T03:04:05Z", "20241301": "1970-01-01T00:00:00Z", "0000": "1970-01-01T00:00:00Z", "202": "1970-01-01T00:00:00Z",
}


def test_dates_and_broken_files(spark, tmp_path):
    """A file cut short, an empty one and one that is no archive stand beside a good one; dates of any length become timestamps."""
    good = archives.arc_version_block(1, "g", "20240101000000")
    for i, d in enumerate(DATES):
        good += f"http://{i} - {d or '-'} text/html 3".encode() + b"\nabc\n"
    files = [("good", good), ("cut", good[:-30] + b"http://x - 2024 text/html 900\nabc"), ("none", b""), ("odd", b"\x00\xff" * 40), ("line", b"a b c\n"), ("version", b"f 0 1 text/plain 2\n9 \n"), ("sign", good + b"u - - t -5\nabc\n")]
    arcs = spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, arc binary")
    back, _, rejects = archives.convert(spark, arcs, f"file://{tmp_path}/warc")
    rows, bad = back.collect(), {r["file"]: r for r in rejects.collect()}
    assert set(bad) == {"cut", "odd", "line", "version", "sign"} and bad["cut"]["place"] == len(good) - 32 and bad["sign"]["place"] == len(good) and "no end" in bad["odd"]["reason"]
    assert len(rows) == 3 * len(DATES) - 1
    want = [DATES[k] for k in DATES]
    assert all(r["date"] == want[int(r["url"][7:])] for r in rows)


def test_global_rank(spark):
    d = spark.range(500).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = [r["rank"] for r in global_rank(d, [F.col("a"), F.col("id").desc()], "t").orderBy("a", F.col("id").desc()).collect()]
    assert got == list(range(500))


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage against a plain version over its own input."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, d = d.collect(), stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
        after = d.collect()
        if name == "quality rules":
            assert Counter(after) == Counter(r for r in before if quality_rules.verdict(r["text"], quality_rules.RULES)[2])
        elif name == "SimHash near-dedup":
            assert Counter(after) == Counter(_deduplicated(before))
        elif name == "secret scans":
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
            assert not [r for r in secrets.scan(d).collect() if any(s["kind"] in ("access", "hex") for s in r["base"])]
        else:
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            assert max(Counter(after).values()) <= 3 * max(Counter(before).values())
    packed = packing.pack(d).count()
    assert packed == corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0


def _deduplicated(rows):
    sets = [set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    n = len(rows)
    near = defaultdict(list)
    for i in range(n):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                near[i].append(j)
                near[j].append(i)
    seen, kept = set(), []
    for i in order:
        if i not in seen:
            kept.append(rows[i])
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += near[x]
    return kept
