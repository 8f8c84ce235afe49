"""Correlation rules: three conditions each, for the stages of an attack. They mean what they say; none drops an alternative.

Rows need category, type and tags (arrays), action, host_name, process_name, parent_name, command_line, file_path, file_size,
src_ip, dst_ip, dst_port, direction and network_bytes; see ``with_missing``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.texts import in_network
from sentrylake.operators import correlate

COLUMNS = {
    "category": "array<string>", "type": "array<string>", "tags": "array<string>", "action": "string", "host_name": "string", "process_name": "string", "parent_name": "string", "command_line": "string", "file_path": "string",
    "file_size": "bigint", "src_ip": "string", "dst_ip": "string", "dst_port": "bigint", "direction": "string", "network_bytes": "bigint",
}
WEB_PORTS = (80, 443, 8080, 8443)
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/16", "192.168.0.0/16")


def with_missing(rows: DataFrame) -> DataFrame:
    """rows with nulls for the columns that the rules read and rows lack."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in rows.columns})


def _is(category: str) -> Column:
    return F.array_contains("category", category)


def _any(column: str, *parts: str) -> Column:
    """Whether the text has one of the parts, in any letter case."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(column), F.lit(p.lower()))
    return out


def _started() -> Column:
    return _is("process") & (F.col("action") == "process_start")


def _privileged() -> Column:
    return correlate.privilege_level(F.col("process_name"), F.col("command_line"), F.col("parent_name")) > 0


def _tagged(*tags: str) -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, tags)))


@dataclass(frozen=True)
class Rule:
    name: str
    stages: tuple[Callable[[], Column], Callable[[], Column], Callable[[], Column]]

    def stage(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows that meet a stage's condition; one that is missing something meets none that needs it."""
        return with_missing(rows).where(F.coalesce(self.stages[number](), F.lit(False)))


def _outbound() -> Column:
    return _is("network") & (F.col("direction") == "outbound")


def _external() -> Column:
    inside = F.lit(False)
    for n in PRIVATE_NETWORKS:
        inside = inside | F.coalesce(in_network(F.col("dst_ip"), n), F.lit(False))
    return F.col("dst_ip").isNotNull() & ~inside


LATERAL_MOVEMENT = Rule("Lateral Movement", (
    lambda: _started() & _privileged() & F.col("host_name").isNotNull(),
    lambda: _outbound() & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("host_name").isNotNull() & ~F.coalesce(F.col("dst_port").isin(*WEB_PORTS), F.lit(False)),
    lambda: F.col("host_name").isNotNull() & ((_started() & _privileged()) | (_is("authentication") & (F.col("action") == "user_login"))),
))
PRIVILEGE_ESCALATION = Rule("Privilege Escalation", (
    lambda: _started() & F.col("host_name").isNotNull() & (F.coalesce(_any("command_line", "sudo", "runas", "elevate", "privilege", "uac", "gksu", "pkexec", "su "), F.lit(False)) | F.coalesce(_tagged("attack.privilege_escalation", "attack.t1078", "attack.t1548"), F.lit(False))),
    lambda: F.coalesce(_is("file") & F.col("action").isin("file_read", "file_modify", "file_create") & F.col("file_path").rlike("^/(etc|usr/bin|usr/sbin)/"), F.lit(False))
    | (_started() & (F.coalesce(_any("process_name", "service", "systemd"), F.lit(False)) | F.coalesce(_any("command_line", "systemctl"), F.lit(False)))),
    lambda: F.coalesce(_is("file") & (F.col("action") == "file_modify") & F.col("file_path").isin("/etc/passwd", "/etc/shadow", "/etc/sudoers"), F.lit(False)) | (_started() & _any("command_line", "chmod", "chown", "sudo")),
))
DATA_EXFILTRATION = Rule("Data Exfiltration", (
    lambda: F.coalesce(_is("file") & (F.col("action") == "file_read") & (F.col("file_size") > 1_000_000), F.lit(False)) | F.coalesce(_started() & _any("command_line", "tar", "zip", "7z", "rar", "compress"), F.lit(False)) | _tagged("attack.collection", "attack.t1005", "attack.t1074"),
    lambda: _outbound() & F.array_contains("type", "connection") & _external() & ((F.col("dst_port") > 1024) | F.col("dst_port").isin(80, 443)),
    lambda: _outbound() & (F.coalesce(F.col("action") == "network_flow_end", F.lit(False)) | F.array_contains("type", "flow")) & (F.col("network_bytes") > 10_000_000),
))
RULES = (LATERAL_MOVEMENT, PRIVILEGE_ESCALATION, DATA_EXFILTRATION)


def with_levels(events: DataFrame) -> DataFrame:
    """events with the fields that rules read, and their privilege levels."""
    rows = with_missing(events)
    rows = rows.withColumn("level", correlate.privilege_level(F.col("process_name"), F.col("command_line"), F.col("parent_name")))
    return rows.withColumn("level_confidence", correlate.level_confidence(F.col("level")))


def apply(rule: Rule, events: DataFrame) -> DataFrame:
    """The rule's three-stage correlations among events, which also need event_id, ts_us, user_name, host_ip."""
    rows = with_levels(events)
    return correlate.three_stage(*[rule.stage(rows, i) for i in range(3)]).withColumn("rule", F.lit(rule.name))


def apply_all(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    first, *rest = [apply(r, events) for r in rules]
    for r in rest:
        first = first.unionByName(r)
    return first
