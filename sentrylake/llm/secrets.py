"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Each kind's candidates are found by a pattern; the texts between them (a split by the same pattern) give their places.
Candidates' values are hashed and counted over the whole corpus by distinct owners and distinct repositories (rows of
equal text count as one repository). A value with few of both is live-looking; one copied widely, among owners or within
one owner's repositories, is an example from documentation or a template. The scan always keeps the spans of the base
kinds and adds bare values of high entropy that are live-looking.

Defined results: a null text is an empty one without spans; a null owner or repository counts as one more of them;
repeated rows are scanned one by one and count as one repository; spans that start together are in the order of their
kinds; very long texts are scanned whole, in time about proportional to their length and hits; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import join_by_key, materialize

#: The base kinds' patterns, with letters of the key words in either case, and the group and least length
#: of the value in each.
KEY_WORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
KINDS = (
    ("assign", f"({KEY_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Added kind: at least 20 such characters with three digits and three letters among them.
BARE = ("bare", r"(?<![A-Za-z0-9+/_=-])(?=(?:[A-Za-z+/_=-]*[0-9]){3})(?=(?:[0-9+/_=-]*[A-Za-z]){3})[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: Bits a character that an added value has at least (Shannon entropy of its characters), and code points of its longest
#: part between the separators of paths and slugs.
ENTROPY, DENSE = 3.8, 16
#: A value with at most so many distinct owners and repositories is live-looking.
LIVE_OWNERS, LIVE_REPOSITORIES = 3, 20
#: Arrays are folded in parts of so many elements, and texts cut in parts of so many code points.
FOLD, PART = 128, 1024

SPAN = "array<struct<start:long,rank:int,kind:string,end:long,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs, the fold of zero and all before it; in parts, so that long arrays aren't copied for each element."""
    zero = F.lit(0).cast("long")

    def scan(array: Column, begin: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            return F.struct(fold(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

        return F.aggregate(array, F.struct(begin.alias("at"), F.lit([]).cast("array<long>").alias("out")), step, lambda s: s["out"])

    def parts_of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda k: F.slice(v, k * FOLD + 1, FOLD))
        whole = lambda p: scan(F.transform(p, lambda x: F.aggregate(x, zero, fold)), zero)
        return let(parts, lambda p: F.flatten(F.zip_with(p, whole(p), scan)))

    return F.when(F.size(values) <= FOLD, scan(values, zero)).otherwise(let(values, parts_of))


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """An array of SPAN of one kind, in order."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # each hit follows a gap; behind the last gap is no hit
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value")), lambda r: r["hit"].isNotNull())

    def placed(r: Column) -> Column:
        begins = running(F.transform(r, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")), lambda s, x: s + x)
        return F.zip_with(r, begins, span)

    def span(r: Column, at: Column) -> Column:
        start = at + F.length(r["gap"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(r["hit"])).alias("end"), r["value"].alias("value"))

    return F.when(text.rlike(pattern), F.filter(let(rows, placed), lambda x: F.length(x["value"]) >= least)).otherwise(F.lit([])).cast(SPAN)


def entropy(value: Column) -> Column:
    """Bits a character of a value, by the shares of its characters."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES, carry: list[str] = ()) -> DataFrame:
    """row_id, doc_id, base (spans), spans (base and added ones), n_live, n_example and the columns in ``carry`` as kept_...

    n_live and n_example count the base spans of values that are live-looking (at most ``live_owners`` owners and
    ``live_repositories`` repositories), and of the others.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("doc_id") if repository is None else repository
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.xxhash64(text).alias("text_hash"),
        F.concat(*[spans_of(text, i, *k) for i, k in enumerate(KINDS)]).alias("base"), spans_of(text, len(KINDS), *BARE).alias("bare"), *[F.col(c).alias(f"kept_{c}") for c in carry],
    )
    hit = (F.size("base") > 0) | (F.size("bare") > 0)
    found = materialize(found.withColumn("hit", hit).withColumn("row_id", F.monotonically_increasing_id()), "candidates")
    listed = materialize(_distinct_spans(found), "listed")
    none = F.lit("\0none")
    rows = listed.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    owners = listed.select("value_hash", F.coalesce("owner", none).alias("who")).distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"))
    texts = listed.groupBy("value_hash", "text_hash").agg(F.min(F.coalesce("repository", none)).alias("where"))
    repositories = texts.select("value_hash", "where").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    counts = materialize(rows.join(owners, "value_hash").join(repositories, "value_hash"), "ownership")
    told = join_by_key(listed, counts, "value_hash", max(1000, listed.count() // 1000))
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    added = F.col("span.rank") == len(KINDS)
    per_row = told.groupBy("row_id").agg(
        F.count(F.when(live & ~added, 1)).alias("n_live"), F.count(F.when(~live & ~added, 1)).alias("n_example"), F.collect_list(F.when(live & added, F.col("span"))).alias("added"),
    )
    # rows without candidates pass by the join
    zero, kept = F.lit(0).cast("long"), [f"kept_{c}" for c in carry]
    hits = found.where("hit").select("row_id", "doc_id", "base", *kept).join(per_row, "row_id", "left")
    hits = hits.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.lit([]).cast(SPAN)))))
    out = ["row_id", "doc_id", "base", "spans"]
    rest = found.where("NOT hit").withColumn("spans", F.col("base")).select(*out, zero.alias("n_live"), zero.alias("n_example"), *kept)
    return hits.select(*out, F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"), *kept).unionByName(rest)


def _distinct_spans(found: DataFrame) -> DataFrame:
    """row_id, owner, repository, text_hash, span, value_hash: base spans, and bare ones of high entropy that touch none of them.

    Neighbours among a row's spans are found by windows over them, so a text with many hits costs its hits and not their pairs.
    """
    bare = F.col("span.rank") == len(KINDS)
    rows = found.where("hit").select("row_id", "owner", "repository", "text_hash", F.explode(F.concat("base", "bare")).alias("span"))
    order = [F.col("span.start"), F.col("span.rank")]
    before = Window.partitionBy("row_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row_id").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_end", F.max(F.when(~bare, F.col("span.end"))).over(before)).withColumn("_start", F.min(F.when(~bare, F.col("span.start"))).over(after))
    touched = (F.coalesce("_end", F.lit(0)) > F.col("span.start")) | (F.coalesce("_start", F.lit(2**62)) < F.col("span.end"))
    value = F.col("span.value")
    dense = F.array_max(F.transform(F.split(value, "[/_-]"), F.length)) >= DENSE
    rows = rows.where(~bare | (~touched & dense & (entropy(value) >= ENTROPY)))
    return rows.drop("_end", "_start").withColumn("value_hash", F.sha2(F.col("span.value"), 256))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each run of spans that touch or overlap (sorted by start) replaced by a mask."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def pieces(p: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """The code points from a to b, from the parts that hold them."""
            lo, hi = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")

            def part(k: Column) -> Column:
                start = F.greatest(a - k * PART, F.lit(0))
                return F.substring(F.get(p, k), (start + 1).cast("int"), (F.least(b - k * PART, F.lit(PART)) - start).cast("int"))

            return F.when(b > a, F.array_join(F.transform(F.sequence(lo, hi), part), "")).otherwise("")

        def piece(s: Column, at: Column) -> Column:
            return F.when((s["start"] < at) | ((s["start"] == at) & (at > 0)), "").otherwise(F.concat(between(at, s["start"]), F.lit(mask)))

        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        tail = between(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("long"))
        return F.concat(F.array_join(F.zip_with(spans, ends, piece), ""), tail)

    return let(parts, pieces)


def redact(docs: DataFrame, mask: str = "[secret]", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """docs with every span found replaced by a mask in its text; n_chars follows. Nulls stay null."""
    columns = docs.columns
    out = scan(docs, live_owners=live_owners, live_repositories=live_repositories, carry=columns)
    text = F.col("kept_text").cast("string")
    new = F.when(F.size("spans") == 0, text).otherwise(masked(text, F.col("spans"), mask)).alias("new_text")
    named = out.select(F.size("spans").alias("n"), new, *[f"kept_{c}" for c in columns])

    def column(c: str) -> Column:
        old = F.col(f"kept_{c}")
        if c == "text":
            return F.col("new_text").cast(docs.schema[c].dataType).alias(c)
        return (F.when(F.col("n") == 0, old).otherwise(F.length("new_text").cast(docs.schema[c].dataType)) if c == "n_chars" else old).alias(c)

    return named.select(*map(column, columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k[0]) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_example")
