"""Readers. Each gives a DataFrame; streams are had with stream=True where a source grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import ids
from sentrylake.operators.detect import MessageRule
from sentrylake.operators.rules import Rule, with_condition


def lines(spark: SparkSession, path: str, pattern: str | None = None, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """value: the non-empty lines of text files, batch or stream (a file is read once, by the checkpoint)."""
    reader = spark.readStream if stream else spark.read
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if stream else reader
    return reader.text(path).where(F.trim("value") != "")


def queue_lines(raw: DataFrame) -> DataFrame:
    """value, event_id: JSON lines that parse, each with its own id or one made from the line."""
    doc = F.try_parse_json("value")
    given = F.coalesce(F.try_variant_get(doc, "$.event.id", "string"), F.try_variant_get(doc, "$['event.id']", "string"))
    return raw.select("value", doc.alias("doc"), given.alias("given")).where("doc IS NOT NULL").select("value", ids.event_id(F.col("given"), F.col("value")).alias("event_id"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """value: the documents of JSON files that hold a list, or an object with a list under data; a stray prefix before
    the first bracket is skipped.
    """
    text = spark.read.option("wholetext", True).text(path)
    body = F.try_parse_json(F.regexp_replace("value", r"^[^\[{]*", ""))
    listed = F.coalesce(F.try_variant_get(body, "$.data", "array<variant>"), F.try_variant_get(body, "$", "array<variant>"))
    return text.select(F.explode(listed).alias("d")).select(F.to_json("d").alias("value"))


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a STIX bundle ({"objects": [...]} or a list)."""
    schema = (
        "type string, id string, name string, x_mitre_shortname string, external_references array<struct<source_name:string,external_id:string>>, "
        "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, relationship_type string, source_ref string, target_ref string"
    )
    text = spark.read.option("wholetext", True).text(path)
    bundle, flat = F.from_json("value", f"objects array<struct<{_colons(schema)}>>")["objects"], F.from_json("value", f"array<struct<{_colons(schema)}>>")
    listed = F.when(F.ltrim("value").startswith("["), flat).otherwise(bundle)
    return text.select(F.explode(listed).alias("o")).select("o.*")


def _colons(schema: str) -> str:
    out, depth = [], 0
    for part in schema.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def message_rules(spark: SparkSession, path: str) -> list[MessageRule]:
    """Rules from YAML files (small, and read by Spark, so any store will do); files that can't be read as a rule are
    skipped. A list of selections, or of parts of one, is a list of alternatives. Rules come in order of file name.
    """
    import yaml

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yml").load(path).select("path", "content").orderBy("path").collect()
    return [r for f in files if (r := rule_of(yaml, bytes(f["content"]))) is not None]


def rule_of(yaml, body: bytes) -> MessageRule | None:
    try:
        doc = yaml.safe_load(body)
    except yaml.YAMLError:
        return None
    if not isinstance(doc, dict) or not isinstance(doc.get("detection"), dict):
        return None
    many = lambda x: [str(y) for y in x] if isinstance(x, list) else [str(x)]
    contains, groups, equals = [], [], {}
    for name, selection in doc["detection"].items():
        if name in ("condition", "timeframe"):
            continue
        for part in selection if isinstance(selection, list) else [selection]:
            for key, value in (part or {}).items() if isinstance(part, dict) else []:
                if key == "message|contains|all":
                    groups.append(tuple(many(value)))
                elif key == "message|contains":
                    contains += many(value)
                elif key in ("event.id", "event.kind"):
                    equals[key.replace("event.", "event_" if key == "event.id" else "")] = tuple(many(value))
    kept = {k: str(v) for k, v in doc["detection"].items() if k in ("condition", "timeframe")}
    return MessageRule(str(doc.get("title", "unknown")), str(doc.get("level", "medium")).lower(), tuple(contains), tuple(groups), equals, tuple(map(str, doc.get("tags") or ())), **kept)


def condition_rules(spark: SparkSession, path: str) -> tuple[list[Rule], dict[str, str]]:
    """Rules with conditions from YAML files, in order of file name, and for each file that is none, why."""
    import yaml

    out, bad = [], {}
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.yml").load(path).select("path", "content").orderBy("path").collect():
        try:
            rule = with_condition(yaml.safe_load(bytes(f["content"])))
            rule.parsed()
        except (yaml.YAMLError, ValueError, KeyError, TypeError, AttributeError) as e:
            bad[f["path"]] = f"{type(e).__name__}: {e}"
        else:
            out.append(rule)
    return out, bad
