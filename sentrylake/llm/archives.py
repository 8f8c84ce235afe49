"""Legacy archive converter: ARC files to WARC files.

An ARC file is a version block followed by records, each a header line and as many payload bytes as the line declares.
Version 1 lines have five fields (URL, IP address, date, content type, length); version 2 lines have ten (URL, IP
address, date, content type, result code, checksum, location, offset, file name, length). The version block's own
second line says which. Nothing but declared lengths ends a record, so payloads may hold anything that looks like one.

Each record becomes a WARC record: a name-based identifier (the same in every run), the ARC date as a WARC timestamp,
type response, or revisit for a payload seen before, the address of the server, and SHA-256 digests of the payload.
Payloads are bytes throughout and need not be text.

Archives are written by Spark's text writer (a record a row, ended by its own last byte), so they land in any store
that Spark can write, with its commit protocol. They are read back as binary files: records are written by classes of
their size, and the larger they are, the fewer a file holds, so that a file has about FILE_BYTES or one record.

Defined results: a null payload is an empty one; a null id sorts last; equal rows are records each, the first in order
of id being the response; ids that repeat with equal payloads are all responses if theirs is the smallest; a very long
payload has a file of its own (the longest that a row can hold has 2 GB); an empty table gives an empty archive and no
rows; other columns are ignored, whatever their names. A file that is cut short, or whose header can't be read, is converted up to
there and the rest goes to the rejects, so that one bad file never ends a job; dates that name no time are 1970-01-01. Spaces in a URL of a header line become %20; a line that is not
UTF-8 is read as Latin-1.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm.common import join_by_key, materialize, scratch_path

#: Payloads under this many bytes are always responses.
LEAST_REVISIT = 100
#: Records and (about) bytes of an archive file.
FILE_RECORDS, FILE_BYTES = 500, 1 << 28
#: Marks the page's id at the end of the URLs that to_arc writes.
MARK = "#sentrylake-page="
FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")}
ARC_DATE = "20240115120000"
EPOCH = "1970-01-01T00:00:00Z"


def arc_header(version: int, url: str, date: str, kind: str, length: int, ip: str = "0.0.0.0", checksum: str = "-", offset: int = 0, filename: str = "-") -> bytes:
    """A record's header line."""
    url = "".join(c if c not in " \r\n\t" else f"%{ord(c):02X}" for c in url) or "-"
    values = {"url": url, "ip": ip, "date": date, "type": kind or "no-type", "result": "200", "checksum": checksum, "location": "-", "offset": str(offset), "filename": filename, "length": str(length)}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


def arc_version_block(version: int, filename: str, date: str) -> bytes:
    """The block that opens a file and names its version and fields."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 sentrylake\n{names[version]}\n".encode()
    return arc_header(version, f"filedesc://{filename}", date, "text/plain", len(body), filename=filename) + body + b"\n"


def header_text(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


class Broken(ValueError):
    """A record that can't be read, at a place of its file."""

    def __init__(self, place: int, reason: str) -> None:
        super().__init__(f"at {place}: {reason}")
        self.place, self.reason = place, reason


def _number(text: bytes | str, place: int, what: str) -> int:
    if not (text.isdigit() and len(text) < 19):
        raise Broken(place, f"{what} is no number")
    return int(text)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of an ARC file but its version block; Broken where one can't be read."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise Broken(at, "the header line has no end")
        parts = header_text(data[at:end]).rstrip("\r").split(" ")
        if not version:
            length = _number(parts[-1], at, "the version block's length")
            version = _number(data[end + 1 : end + 1 + length].split(b" ", 1)[0], at, "the version")
            if version not in FIELDS:
                raise Broken(at, f"version {version} of the format isn't known")
            at = end + 1 + length + 1
            continue
        if (more := len(parts) - len(FIELDS[version])) > 0:
            parts = ["%20".join(parts[: more + 1]), *parts[more + 1 :]]
        if len(parts) != len(FIELDS[version]):
            raise Broken(at, f"the header line has {len(parts)} fields, version {version} has {len(FIELDS[version])}")
        fields = dict(zip(FIELDS[version], parts, strict=True))
        length = _number(fields["length"], at, "the declared length")
        payload = data[end + 1 : end + 1 + length]
        if len(payload) < length:
            raise Broken(at, f"the record declares {length} bytes and has {len(payload)}")
        yield fields, payload
        at = end + 1 + length + 1  # a line feed follows each record


def warc_date(arc: Column) -> Column:
    """An ARC date of 4 to 14 leading digits (more are fractions) as a WARC timestamp; parts that it lacks are the first of their
    kind, and what names no time (no year, a 13th month) is EPOCH.
    """
    digits = F.regexp_extract(F.coalesce(arc, F.lit("")), r"^[0-9]{4}(?:[0-9]{2}){0,5}", 0)
    whole = F.concat(digits, F.substr(F.lit("00000101000000"), F.length(digits) + 1))
    part = lambda a, n: F.substring(whole, a, n)
    made = F.format_string("%s-%s-%sT%s:%s:%sZ", part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), part(13, 2))
    valid = (digits > "0001") & F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")).isNotNull()
    return F.when(valid, made).otherwise(F.lit(EPOCH))


def to_arc(pages: DataFrame, key: str, url: str, payload: str, per_file: int = 64, bytes_per_file: int = 1 << 26, mark: str = MARK) -> DataFrame:
    """arc (binary): small ARC files (version 1 and 2 by turns) of the pages, payloads being text or bytes.

    A record's URL is followed by its id behind ``mark``, which the converter reads back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = 0

        def opened() -> list[bytes]:
            return [arc_version_block(1 + turn % 2, "pages.arc", ARC_DATE)]

        for batch in batches:
            out, n, size = opened(), 0, 0
            for i, u, p in batch.itertuples(index=False):
                if n and (n >= per_file or size + len(p) > bytes_per_file):
                    yield pd.DataFrame({"arc": [b"".join(out)]})
                    turn += 1
                    out, n, size = opened(), 0, 0
                name = "" if pd.isna(i) else str(int(i))
                out += [arc_header(1 + turn % 2, f"{u or '-'}{mark}{name}", ARC_DATE, "text/html", len(p)), p, b"\n"]
                n, size = n + 1, size + len(p)
            if n:
                yield pd.DataFrame({"arc": [b"".join(out)]})
                turn += 1

    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    return rows.mapInPandas(run, "arc binary")


def parsed(arcs: DataFrame, mark: str | None = None) -> DataFrame:
    """record_key, url, ip, date, type, payload (binary), payload_bytes, payload_digest of ARC files' records, and rejects.

    Without ``mark``, or where a URL doesn't end in it and a number, records have no key and keep their whole URL. A file
    is read up to its first record that can't be; of the rest, the file (arcs' ``path``, if it has one), place and reason are
    a row (columns file, place, reason), whose other columns are null.
    """
    numbered = re.compile(f"(.*){re.escape(mark)}(-?[0-9]{{1,18}})?", re.DOTALL) if mark else None
    columns = ["record_key", "url", "ip", "date", "type", "payload", "payload_bytes", "payload_digest", "file", "place", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in batch[["path", "arc"]].itertuples(index=False):
                rows: list[tuple] = []
                try:
                    for f, payload in parse_arc(data):
                        m = numbered.fullmatch(f["url"]) if numbered else None
                        url, name = m.groups() if m else (f["url"], None)
                        rows.append((int(name) if name else None, url, f["ip"], f["date"], f["type"], payload, len(payload), hashlib.sha256(payload).hexdigest(), None, None, None))
                except Broken as e:
                    rows.append((None,) * 8 + (path, e.place, e.reason))
                yield pd.DataFrame(rows, columns=columns).astype({"record_key": "Int64", "payload_bytes": "Int64", "place": "Int64"})

    path = F.col("path").cast("string") if "path" in arcs.columns else F.lit(None).cast("string")
    rows = arcs.select(path.alias("path"), F.coalesce(F.col("arc"), F.lit(b"")).alias("arc"))
    return rows.mapInPandas(run, "record_key long, url string, ip string, date string, type string, payload binary, payload_bytes long, payload_digest string, file string, place long, reason string")


def with_types(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """records with record_type and refers_to: of equal payloads, all but those with the smallest key are revisits."""
    keyed = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("record_key").alias("first_key"), F.count(F.lit(1)).alias("n_rows"))
    again = materialize(keyed.where("n_rows > 1"), "digests")
    share = max(1000, (again.agg(F.sum("n_rows").alias("n")).first()["n"] or 0) // 1000)
    out = join_by_key(records, again, "payload_digest", share)
    revisit = F.col("first_key").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("first_key"))
    out = out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    return out.withColumn("refers_to", F.when(revisit, F.col("first_key"))).drop("first_key", "n_rows")


def warc_record(records: DataFrame) -> Column:
    """A whole WARC record as bytes: header lines, a blank line, the payload and two line ends."""

    def urn(key: Column, digest: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit("warc"), F.coalesce(key.cast("string"), F.lit("")), digest))
        parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    key = F.coalesce(F.col("record_key").cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("record_key"), F.col("payload_digest"))),
        F.concat(F.lit("WARC-Date: "), warc_date(F.col("date"))), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Source-Key: "), key),
        F.when(~F.col("ip").isin("", "-", "0.0.0.0"), F.concat(F.lit("WARC-IP-Address: "), F.col("ip"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to"), F.col("payload_digest")), F.lit("\r\nWARC-Refers-To-Key: "), F.col("refers_to").cast("string"))),
        F.when(F.col("type") != "", F.concat(F.lit("Content-Type: "), F.col("type"))), F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit(b"\r\n\r\n"), body, F.lit(b"\r\n\r\n"))


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes records (of with_types) as WARC files; a revisit has no body, its length and digest are its response's.

    The records of class k have up to file_bytes / FILE_RECORDS * 4^k bytes; its files are in the folder size=k.
    """
    least = file_bytes // FILE_RECORDS
    size = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    of = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) / least) / 2), F.lit(0)).cast("int")
    found = records.groupBy(of.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()  # a row for each class, 12 at most
    # the writer puts a line feed after each row: the record's own last byte
    value = F.expr("left(record, length(record) - 1)").cast("string").alias("value")
    for k in [r["k"] for r in found] or [0]:
        rows = records.where(of == k).select(warc_record(records).alias("record")).select(value)
        rows.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, FILE_RECORDS >> 2 * k)).text(f"{path}/size={k}")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = header_text(data[at:end]).split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + length]
        at = end + 4 + length
        if len(body) < length or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record before {at} is not as long as it declares")
        at += 4
        yield fields, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key, record_type, refers_to, body_bytes, body_digest, declared_digest, record_id, date, url, ip, body (binary) of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for f, body in parse_warc(bytes(data)):
                    key, to = f.get("WARC-Source-Key", ""), f.get("WARC-Refers-To-Key", "")
                    declared = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((int(key) if key else None, f["WARC-Type"], int(to) if to else None, len(body), hashlib.sha256(body).hexdigest(), declared, f["WARC-Record-ID"], f["WARC-Date"], f["WARC-Target-URI"], f.get("WARC-IP-Address"), body))
                out = pd.DataFrame(rows, columns=["key", "record_type", "refers_to", "body_bytes", "body_digest", "declared_digest", "record_id", "date", "url", "ip", "body"])
                yield out.astype({"key": "Int64", "refers_to": "Int64"})

    kinds = "key long, record_type string, refers_to long, body_bytes long, body_digest string, declared_digest string, record_id string, date string, url string, ip string, body binary"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, kinds)


def convert(spark: SparkSession, arcs: DataFrame, path: str | None = None, mark: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str, DataFrame]:
    """Converts ARC files (arc binary, and path if known) to WARC files at ``path``; returns what reading them back gives, the
    path, and the rejects: file, place and reason of the first record of a file that can't be read.
    """
    path = path or scratch_path(spark, "warc")
    records = parsed(arcs, mark)
    if mark is None:  # records of other makers' archives are numbered
        records = records.withColumn("record_key", F.monotonically_increasing_id())
    records = materialize(records, "arc-records")
    rejects = records.where("reason IS NOT NULL").select("file", "place", "reason")
    write_warc(with_types(records.where("reason IS NULL").drop("file", "place", "reason")), path, file_bytes)
    return read_warc(spark, path), path, rejects


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as ARC files, converted to WARC and read back; a revisit's payload is its response's."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back, _, _ = convert(spark, to_arc(pages, "page_id", "url", "html"), mark=MARK)
    back = materialize(back.drop("body"), "read-back")
    # the full payload of a revisit is the body of the response that it refers to, found by its digest
    seen = back.where("record_type = 'response'").groupBy("body_digest").agg(F.min("body_bytes").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    revisits = back.where("record_type = 'revisit'")
    needed = revisits.groupBy("declared_digest").agg(F.count(F.lit(1)).alias("n_rows"))
    found = needed.join(seen.select(F.col("body_digest").alias("declared_digest"), "n"), "declared_digest")
    full = join_by_key(revisits, materialize(found, "responses"), "declared_digest", max(1000, revisits.count() // 1000))
    columns = lambda digest, n: [F.col("key").alias("page_id"), F.col(n).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", "refers_to", "record_id", "date"]
    return back.where("record_type = 'response'").select(*columns("body_digest", "body_bytes")).unionByName(full.select(*columns("declared_digest", "n")))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_key FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest),
t AS (SELECT q.*, f.first_key, f.first_key IS NOT NULL AND q.page_id IS DISTINCT FROM f.first_key AS again FROM q LEFT JOIN f USING (payload_digest)),
m AS (SELECT *, md5('warc|' || coalesce(page_id::VARCHAR, '') || '|' || payload_digest) AS h FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_key END AS refers_to,
  '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' AS record_id,
  '2024-01-15T12:00:00Z' AS date FROM m
"""
