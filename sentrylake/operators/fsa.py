"""Attack chains: alarms in time order, read by a state machine over tactics with backtracking and a beam.

The order-dependent part runs once for each scope (such as a host) over its alarms alone; segments and their summaries
are windows and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tactics and those that may follow each.
NEXT = {
    "Reconnaissance": ("Resource Development", "Initial Access", "Execution"),
    "Resource Development": ("Initial Access", "Execution"),
    "Initial Access": ("Execution", "Persistence", "Privilege Escalation", "Defense Evasion"),
    "Execution": ("Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact"),
    "Persistence": ("Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control"),
    "Privilege Escalation": ("Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact"),
    "Defense Evasion": ("Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control"),
    "Credential Access": ("Discovery", "Lateral Movement", "Collection", "Command and Control"),
    "Discovery": ("Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact", "Privilege Escalation"),
    "Lateral Movement": ("Execution", "Privilege Escalation", "Defense Evasion", "Discovery", "Collection", "Command and Control", "Exfiltration", "Impact"),
    "Collection": ("Command and Control", "Exfiltration", "Impact"),
    "Command and Control": ("Exfiltration", "Impact"),
    "Exfiltration": ("Impact",),
    "Impact": (),
}
ACCEPT = frozenset({"Exfiltration", "Impact"})
BEAM, BACKTRACK = 30, 10
# Hops that a path between two segments may have, by state.
HOPS, STATE_HOPS = 8, {"Reconnaissance": 10, "Discovery": 10, "Lateral Movement": 10, "Command and Control": 6}


def state_of(tag: Column) -> Column:
    """The tactic of a tag in either spelling (LateralMovement or Lateral Movement), or null."""
    spaced = {**{s.replace(" ", ""): s for s in NEXT}, "CommandAndControl": "Command and Control"}
    out = F.when(tag.isin(*NEXT), tag)
    for compact, state in spaced.items():
        out = F.when(tag == compact, state).otherwise(out)
    return out


@dataclass(frozen=True)
class Policy:
    """What may follow what; any state may start a chain, and a state may follow itself."""

    next_states: dict[str, tuple[str, ...]] | None = None
    jumps: frozenset[tuple[str, str]] = frozenset()
    self_loop: bool = True
    start_anywhere: bool = True

    def allows(self, last: str | None, then: str) -> bool:
        if last is None:
            return self.start_anywhere
        return (self.self_loop and last == then) or (last, then) in self.jumps or then in (self.next_states or NEXT).get(last, ())


class Hypothesis(NamedTuple):
    """Alarms taken so far, as their numbers; what was given up, and how."""

    taken: tuple[int, ...] = ()
    drops: int = 0
    pops: int = 0
    steps: tuple[tuple[int, str], ...] = ()

    @property
    def worth(self) -> float:
        return len(self.taken) - 0.25 * self.drops - 0.5 * self.pops


def accepted(states: list[str], anchors: list[str], policy: Policy, accept: frozenset[str] = ACCEPT, beam: int = BEAM, backtrack: int = BACKTRACK) -> list[Hypothesis]:
    """The chains that reach an accept state, in the order in which they do."""
    out: list[Hypothesis] = []
    active = [Hypothesis()]
    for i, state in enumerate(states):
        follow = []
        for h in active:
            last = states[h.taken[-1]] if h.taken else None
            if policy.allows(last, state):
                options = [h._replace(taken=h.taken + (i,))]
            else:
                keep = next((n for n in range(len(h.taken), max(-1, len(h.taken) - backtrack - 1), -1) if policy.allows(states[h.taken[n - 1]] if n else None, state)), None)
                options = [] if keep is None else [Hypothesis(h.taken[:keep] + (i,), h.drops, h.pops + 1, h.steps + ((i, "POP"),))]
                options.append(h._replace(drops=h.drops + 1, steps=h.steps + ((i, "DROP"),)))
            for o in options:
                if o.taken and o.taken[-1] == i and state in accept:
                    out.append(o)
                    o = Hypothesis()
                follow.append(o)
        best: dict[tuple, Hypothesis] = {}
        for h in follow:
            end = (states[h.taken[-1]], anchors[h.taken[-1]]) if h.taken else (None, None)
            if end not in best or h.worth > best[end].worth:
                best[end] = h
        active = sorted(best.values(), key=lambda h: -h.worth)[:beam]
    return out


def chain_score(states: list[str], times: list[float], h: Hypothesis) -> float:
    chosen = [states[i] for i in h.taken]
    segments = sum(a != b for a, b in zip([None, *chosen], chosen, strict=False))
    span = times[h.taken[-1]] - times[h.taken[0]]
    time_part = 0.0 if span <= 0 else 0.3 if span < 60 else 0.5 if span > 86400 else 1.0
    return (
        0.3 * min(1, len(chosen) / 100) + 0.25 * min(1, len(set(chosen)) / 14) + 0.2 * min(1, segments / 20)
        + 0.15 * (1 - min(0.2, 0.05 * len(h.steps))) + 0.1 * time_part
    )


def chosen(states: list[str], times: list[float], found: list[Hypothesis]) -> list[tuple[Hypothesis, float]]:
    """The better half (three at most) of several chains, or the best alone when it leads by over 0.3; lone alarms go."""
    rated = [(h, chain_score(states, times, h)) for h in found]
    if len(rated) < 2:
        return rated
    long = sorted((x for x in rated if len(x[0].taken) > 1), key=lambda x: -x[1])
    if not long:
        return rated
    if len(long) > 1 and long[0][1] - long[1][1] > 0.3:
        return long[:1]
    return long[: max(1, min(3, len(long) // 2))]


CHAIN = "scope string, chain int, score double, seq int, event_id string, state string, ts_float double, src_uid string, dst_uid string"


def chains(alarms: DataFrame, scope: str = "scope", tag: str = "tactic_name", policy: Policy | None = None) -> DataFrame:
    """CHAIN rows: the alarms of each scope's accepted chains, in order."""
    policy = policy or Policy()
    rows = alarms.select(F.col(scope).alias("scope"), "event_id", state_of(F.col(tag)).alias("state"), "ts_float", "src_uid", "dst_uid").where("state IS NOT NULL")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["ts_float", "event_id", "src_uid", "dst_uid"], kind="stable").reset_index(drop=True)
        states, times = g["state"].tolist(), g["ts_float"].tolist()
        parts = []
        for k, (h, score) in enumerate(chosen(states, times, accepted(states, g["dst_uid"].tolist(), policy))):
            parts.append(g.iloc[list(h.taken)].assign(chain=k, score=score, seq=range(len(h.taken))))
        columns = [x.split()[0] for x in CHAIN.split(", ")]
        return pd.DataFrame({c: pd.Series([x for p in parts for x in p[c].tolist()], dtype=object) for c in columns})

    return rows.groupBy("scope").applyInPandas(run, CHAIN)


def segments(rows: DataFrame, keys: list[str], order: list[str], state: str = "state") -> DataFrame:
    """rows with ``segment``: the number of the run of equal states that each is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(0))
    return rows.withColumn("_changed", changed).withColumn("segment", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def segment_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each segment's state, times and number of alarms, with its first source and last target as anchors."""
    order = F.struct("ts_float", "seq") if "seq" in rows.columns else F.struct("ts_float", "event_id")
    return rows.groupBy(*keys, "segment", "state").agg(
        F.min("ts_float").alias("t_start"), F.max("ts_float").alias("t_end"), F.count(F.lit(1)).alias("n_alarms"), F.min_by("src_uid", order).alias("anchor_in"), F.max_by("dst_uid", order).alias("anchor_out")
    )


def top_per_segment(rows: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The first n alarms of each segment by time."""
    w = Window.partitionBy(*keys, "segment").orderBy("ts_float", "event_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def most_hops(a: Column, b: Column) -> Column:
    """Hops that a path between segments of two states may have: the greater of theirs."""
    def of(c: Column) -> Column:
        out = F.lit(HOPS)
        for s, n in STATE_HOPS.items():
            out = F.when(c == s, n).otherwise(out)
        return out

    return F.greatest(of(a), of(b))
