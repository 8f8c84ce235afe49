"""Identities: short digests of what names a thing. Null parts count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def joined(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[text(p) for p in parts])


def host_id(name: Column) -> Column:
    return F.concat(F.lit("h-"), short(F.sha1(name)))


def process_entity_id(host: Column, pid: Column, start: Column, executable: Column) -> Column:
    return F.concat(F.lit("p-"), short(F.sha1(joined(":", host, pid, start, executable))))


def session_id(host: Column, user: Column, source_ip: Column, epoch_seconds: Column) -> Column:
    """One id for each host, user, source and five minutes."""
    return F.concat(F.lit("sess-"), short(F.sha1(joined(":", host, user, source_ip, F.floor(epoch_seconds / 300)))))


def event_id(given: Column, raw: Column) -> Column:
    """The given id, else one made from the raw line."""
    return F.coalesce(F.when(F.trim(given) != "", given), F.concat(F.lit("evt-"), short(F.sha1(raw))))


def import_event_id(ts: Column, host: Column, message: Column) -> Column:
    return short(F.sha2(joined("|", ts, host, message), 256))


def rule_id(given: Column, name: Column) -> Column:
    return F.coalesce(given, F.concat(F.lit("rule-"), short(F.sha1(name))))


def fingerprint_id(key: Column) -> Column:
    return F.concat(F.lit("fp-"), F.sha1(key))


def canonical_id(key: Column) -> Column:
    return F.concat(F.lit("canonical-"), short(F.sha2(key, 256)))


def correlation_id(*event_ids: Column) -> Column:
    return F.concat(F.lit("corr-"), short(F.md5(joined("-", *event_ids))))


def edge_id(given: Column, src: Column, rtype: Column, dst: Column, ts: Column) -> Column:
    return F.coalesce(given, F.concat(F.lit("e-"), short(F.sha1(joined("|", src, rtype, dst, ts)))))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def node_uid(label: str, **keys: Column) -> Column:
    """``Label:k=v;k2=v2`` with keys in order of name and null ones left out; null where all are."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in sorted(keys.items())]
    rest = F.concat_ws(";", *parts)
    return F.when(rest != "", F.concat(F.lit(f"{label}:"), rest))


def parse_uid(uid: Column) -> Column:
    """struct(ntype, key map) of a uid; a short form ``Label:value`` uses the label's own key."""
    label = F.substring_index(uid, ":", 1)
    rest = F.substring(uid, F.length(label) + 2, F.length(uid))
    own = {"Host": "host.id", "User": "user.id", "Process": "process.entity_id", "File": "file.path", "IP": "ip", "Domain": "domain.name"}
    default = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), label), F.lit("id"))
    keys = F.when(F.contains(rest, F.lit("=")), F.str_to_map(rest, F.lit(";"), F.lit("="))).otherwise(F.create_map(default, rest))
    return F.struct(label.alias("ntype"), keys.alias("key"))
