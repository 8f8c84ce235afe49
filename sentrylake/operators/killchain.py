"""Kill chains: the accepted chains' segments joined by paths in the graph, and a choice of one path for each join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators import fsa, graph
from sentrylake.operators.tables import cut

#: Seconds before a segment's end and after the next one's start in which a path may lie.
MARGIN_S = 120.0
CANDIDATES = 20
KEYS = ["scope", "chain", "pair"]


@dataclass(frozen=True)
class AnchorRule:
    """Alarms that give other anchors for a join of two states: any one of the conditions is enough."""

    before: str
    after: str
    priority: int
    rtypes: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()

    def matches(self) -> Column:
        kind = lambda c: F.substring_index(c, ":", 1)
        out = F.lit(not (self.rtypes or self.sources or self.targets or self.actions))
        for c, values in ((F.col("rtype"), self.rtypes), (kind("src_uid"), self.sources), (kind("dst_uid"), self.targets), (F.col("action"), self.actions)):
            out = out | F.coalesce(c.isin(*values), F.lit(False)) if values else out
        return out


# The joins of states with alarms that may anchor them.
ANCHOR_RULES = (
    AnchorRule("Initial Access", "Execution", 1, rtypes=("SPAWN", "RUNS_ON"), targets=("Process",)),
    AnchorRule("Execution", "Privilege Escalation", 1, rtypes=("SPAWN",), targets=("Process",), actions=("process_start",)),
    AnchorRule("Privilege Escalation", "Lateral Movement", 1, rtypes=("NET_CONNECT",), sources=("Process", "Host"), targets=("IP",), actions=("network_connection",)),
    AnchorRule("Lateral Movement", "Command and Control", 1, rtypes=("SPAWN", "RUNS_ON"), targets=("Process",)),
    AnchorRule("Lateral Movement", "Command and Control", 2, rtypes=("DNS_QUERY", "NET_CONNECT"), sources=("Process",)),
    AnchorRule("Lateral Movement", "Command and Control", 3, rtypes=("DNS_QUERY", "NET_CONNECT"), targets=("Domain", "IP")),
    AnchorRule("Command and Control", "Impact", 1, rtypes=("FILE_ACCESS", "SPAWN"), targets=("File", "Process"), actions=("file_delete", "file_write", "process_start")),
    AnchorRule("Command and Control", "Impact", 2, rtypes=("DNS_QUERY",), targets=("Domain",)),
    AnchorRule("Command and Control", "Impact", 3, rtypes=("FILE_ACCESS",), sources=("Process",)),
)


def segment_pairs(chain_rows: DataFrame) -> DataFrame:
    """scope, chain, pair, src_uid, dst_uid, t_min, t_max, hops: neighbouring segments' anchors."""
    keys = ["scope", "chain"]
    runs = fsa.segment_runs(fsa.segments(chain_rows, keys, ["seq"]), keys)
    w = Window.partitionBy(*keys).orderBy("segment")
    nxt = lambda c: F.lead(c).over(w)
    out = runs.select(*keys, F.col("segment").alias("pair"), F.col("anchor_out").alias("src_uid"), nxt("anchor_in").alias("dst_uid"), (F.col("t_end") - MARGIN_S).alias("t_min"), (nxt("t_start") + MARGIN_S).alias("t_max"), fsa.most_hops(F.col("state"), F.coalesce(nxt("state"), F.col("state"))).alias("hops"), F.col("state").alias("before"), nxt("state").alias("after"))
    return out.where("dst_uid IS NOT NULL")


def search_pool(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """at, to, event_id, ts_float: the edges that any pair's window may hold, in both directions, stored for all searches."""
    span = pairs.agg(F.min("t_min").alias("a"), F.max("t_max").alias("b")).first()
    near = found.where(F.col("ts_float").between(span["a"], span["b"]))
    pool = near.select(F.col("src_uid").alias("at"), F.col("dst_uid").alias("to"), "event_id", "ts_float")
    return cut(pool.unionByName(pool.select(F.col("to").alias("at"), F.col("at").alias("to"), "event_id", "ts_float")).where("at <> to"), "pool")


def candidate_paths(found: DataFrame, pairs: DataFrame, most: int = CANDIDATES, pool: DataFrame | None = None) -> DataFrame:
    """scope, chain, pair, hops, path, steps: for each pair the first ``most`` simple undirected paths from its source to
    its target whose times lie in its window and never descend, by (hops, steps); equal anchors give the empty path.

    All pairs are searched at once, from their own sources. A search backwards from the targets comes first; a walk then goes
    on only to nodes from which its target can still be reached, with the hops that are left and by edges that aren't too early, and walks over the same nodes are one: the one that arrives first, with the
    smallest ids of edges, from which every continuation of the others is open too. ``pool`` may be a search_pool of found
    for these pairs or more.
    """
    keys = KEYS + ["order"] * ("order" in pairs.columns)
    pairs = cut(pairs, "pairs")
    both = search_pool(found, pairs) if pool is None else pool
    # windows of pairs hold few distinct links of the pool; searches run over these
    near = pairs.select(*keys, "src_uid", "dst_uid", "t_min", "t_max", F.col("hops").alias("most"))
    limit = pairs.agg(F.max("hops").alias("n")).first()["n"] or 0
    reach = graph.latest_departures(both, near.select(*keys, "t_min", "t_max", "most", F.col("dst_uid").alias("node")), keys)
    # of each node the hops and departures from which the target can be reached: at most as many as there are hops
    reach = cut(reach.groupBy(*keys, F.col("node").alias("to")).agg(F.collect_list(F.struct("left", "departs")).alias("open")), "reach")
    walks = near.select(*keys, "dst_uid", "t_min", "t_max", "most", F.col("src_uid").alias("end"), F.array("src_uid").alias("path"), F.array().cast("array<string>").alias("steps"), F.lit(-1e300).alias("last"))
    done = walks.where("end = dst_uid")
    walks = walks.where("end <> dst_uid")
    for hop in range(1, limit + 1):
        j = walks.where(F.col("most") >= hop).join(both, F.col("end") == F.col("at")).where("ts_float BETWEEN t_min AND t_max AND ts_float >= last AND NOT array_contains(path, to)")
        j = j.join(reach, [*keys, "to"]).where(F.exists("open", lambda o: (o["left"] + hop <= F.col("most")) & (o["departs"] >= F.col("ts_float"))))
        same = [*keys, "dst_uid", "t_min", "t_max", "most", F.col("to").alias("end"), F.concat("path", F.array("to")).alias("path")]
        arrival = F.struct(F.col("ts_float").alias("last"), F.concat("steps", F.array("event_id")).alias("steps"))
        walked = cut(j.groupBy(*same).agg(F.min(arrival).alias("a")).select("*", "a.steps", "a.last").drop("a"), "walks")
        done = done.unionByName(walked.where("end = dst_uid"))
        # a pair that has its candidates needs no longer ones
        full = done.groupBy(*keys).count().where(F.col("count") >= most).select(*keys)
        walks = walked.where("end <> dst_uid").join(full, keys, "left_anti")
        if walks.isEmpty():
            break
    w = Window.partitionBy(*keys).orderBy("hops", "steps", "path")
    out = done.select(*keys, F.size("steps").alias("hops"), "path", "steps")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


OVERLAP = 0.5


def heuristic(candidates: DataFrame) -> DataFrame:
    """candidates with score: 10 / (1 + hops), and OVERLAP for each node shared with the best path of an earlier pair of the chain.

    A pair's best path is its first in rank, so earlier pairs' nodes are one running union of their chain's pairs.
    """
    best = candidates.where("rank = 1").select(*KEYS, "path")
    w = Window.partitionBy("scope", "chain").orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)
    earlier = best.select(*KEYS, F.coalesce(F.flatten(F.collect_list("path").over(w)), F.array().cast("array<string>")).alias("_seen"))
    shared = F.size(F.array_intersect("path", F.coalesce("_seen", F.array().cast("array<string>"))))
    out = candidates.join(earlier, KEYS, "left").withColumn("score", F.lit(10.0) / (F.lit(1.0) + F.col("hops")) + F.lit(OVERLAP) * shared)
    return out.drop("_seen")


def validated(chosen: DataFrame, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """scope, chain, problem: chains whose choice is wrong, and why: ``count`` (not one path for each pair) or ``membership``
    (a path that is none of the pair's candidates). chosen: scope, chain, pair, path, steps.
    """
    wanted = pairs.groupBy("scope", "chain").agg(F.count(F.lit(1)).alias("wanted"))
    given = chosen.groupBy("scope", "chain").agg(F.count(F.lit(1)).alias("given"), F.count_distinct("pair").alias("pairs"))
    count = wanted.join(given, ["scope", "chain"], "full_outer").where("coalesce(wanted, 0) <> coalesce(given, 0) OR given <> pairs").select("scope", "chain", F.lit("count").alias("problem"))
    odd = chosen.join(candidates.select(*KEYS, "path", "steps"), [*KEYS, "path", "steps"], "left_anti").select("scope", "chain").distinct()
    return count.unionByName(odd.join(count, ["scope", "chain"], "left_anti").withColumn("problem", F.lit("membership")))


def choose(pairs: DataFrame, candidates: DataFrame, chooser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """scope, chain, pair, path, steps, confidence: one path for each pair of the chains all of whose pairs have one.

    ``chooser`` may pick among the candidates (one row for each pair); the default is the highest score, first in rank.
    Chains for which a chooser's answer is not valid get the default.
    """
    keys = KEYS
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "rank")
    picked = heuristic(candidates).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "hops", "path", "steps")
    if chooser is not None:
        own = cut(chooser(candidates).select(*keys, "path", "steps"), "chosen")
        wrong = cut(validated(own, pairs, candidates).select("scope", "chain").distinct(), "wrong")
        own = own.join(wrong, ["scope", "chain"], "left_anti").withColumn("hops", F.size("steps"))
        picked = picked.join(own.select("scope", "chain").distinct(), ["scope", "chain"], "left_anti").unionByName(own)
    gone = dropped(pairs, candidates).select("scope", "chain").distinct()
    return picked.join(gone, ["scope", "chain"], "left_anti").select(*keys, "hops", "path", "steps", F.lit(0.5).alias("confidence"))


def dropped(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """scope, chain, pair, before, after, reason of the joins that no path makes: why their chains are dropped."""
    return without(pairs, candidates).select(*KEYS, "before", "after", F.concat_ws(" ", F.lit("no path from"), "before", F.lit("to"), "after").alias("reason"))


def write_back(found: DataFrame, all_nodes: DataFrame, chain_rows: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and nodes with killchain (an id made of scope and chain): those of the chains' alarms and chosen paths.

    Of several chains the one of most confidence (ties: the first by id) names an edge; a node is named by the first of its edges'
    chains. Others keep what they had.
    """
    name = F.concat(F.lit("kc-"), F.substring(F.sha1(F.concat_ws("|", "scope", F.col("chain").cast("string"))), 1, 16)).alias("_killchain")
    kept = chain_rows.join(picked.select("scope", "chain").distinct(), ["scope", "chain"], "left_semi")
    sure = F.col("confidence") if "confidence" in picked.columns else F.lit(0.5)
    trust = picked.groupBy("scope", "chain").agg(F.avg(sure).alias("_sure"))
    events = kept.select("scope", "chain", "event_id").unionByName(picked.select("scope", "chain", F.explode("steps").alias("event_id"))).join(trust, ["scope", "chain"])
    events = events.select(name, "event_id", "_sure").groupBy("event_id").agg(F.min_by("_killchain", F.struct(-F.col("_sure"), "_killchain")).alias("_killchain"))
    old = F.col("killchain") if "killchain" in found.columns else F.lit(None).cast("string")
    out = found.withColumn("killchain", old).join(events, "event_id", "left").withColumn("killchain", F.coalesce("_killchain", "killchain")).drop("_killchain")
    touched = out.where("killchain IS NOT NULL").select(F.explode(F.array("src_uid", "dst_uid")).alias("uid"), F.col("killchain").alias("_killchain")).groupBy("uid").agg(F.min("_killchain").alias("killchain"))
    return out, all_nodes.drop("killchain").join(touched, "uid", "left")


def joined_chains(alarms: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chains' rows, the pairs of their segments, and the path picked for each pair."""
    rows = fsa.chains(alarms)
    if {"rtype", "action"} <= set(alarms.columns):
        facts = alarms.groupBy("scope", "event_id", "src_uid", "dst_uid").agg(F.min("rtype").alias("rtype"), F.min("action").alias("action"))
        rows = rows.join(facts, ["scope", "event_id", "src_uid", "dst_uid"], "left")
    rows = cut(rows, "chains")
    pairs = cut(segment_pairs(rows), "pairs")
    return rows, pairs, cut(choose(pairs, staged_paths(found, rows, pairs)), "picked")


def kill_chains(alarms: DataFrame, found: DataFrame) -> DataFrame:
    """scope, chain, n_pairs, hops, events, confidence of each chain that holds together; lone segments have 0.3."""
    return summed(*joined_chains(alarms, found))


def summed(rows: DataFrame, pairs: DataFrame, picked: DataFrame) -> DataFrame:
    joined = picked.groupBy("scope", "chain").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("hops").cast("long").alias("hops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("steps")))).alias("events"), F.avg("confidence").alias("confidence"))
    lone = rows.select("scope", "chain").distinct().join(pairs.select("scope", "chain").distinct(), ["scope", "chain"], "left_anti")
    lone = lone.select("scope", "chain", F.lit(0).cast("long").alias("n_pairs"), F.lit(0).cast("long").alias("hops"), F.array().cast("array<string>").alias("events"), F.lit(0.3).alias("confidence"))
    return joined.unionByName(lone)


def stored_chains(alarms: DataFrame, found: DataFrame, all_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kill chains, and the edges and nodes with the chain that they belong to: what an analysis stores."""
    rows, pairs, picked = joined_chains(alarms, found)
    return summed(rows, pairs, picked), *write_back(found, all_nodes, rows, picked)


def without(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs that have no candidate yet."""
    return pairs.join(candidates.select(*KEYS).distinct(), KEYS, "left_anti")


def first_order(candidates: DataFrame) -> DataFrame:
    """Of each pair's candidates by several anchors, those of the first anchors that have any."""
    w = Window.partitionBy(*KEYS)
    return candidates.withColumn("_first", F.min("order").over(w)).where("order = _first").drop("_first", "order")


def semantic_anchors(chain_rows: DataFrame, pairs: DataFrame, rules: tuple[AnchorRule, ...] = ANCHOR_RULES) -> DataFrame:
    """pairs by other anchors: targets of the first segment's alarms and sources of the second's that a rule for the two
    states matches, in order of rule and time. chain_rows need rtype and action.
    """
    rows = fsa.segments(chain_rows, ["scope", "chain"], ["seq"])
    parts = []
    for r in rules:
        own = pairs.where((F.col("before") == r.before) & (F.col("after") == r.after)).select(*KEYS)
        hit = rows.where(r.matches())
        ends = [hit.select("scope", "chain", (F.col("segment") - back).alias("pair"), F.col(uid).alias(uid), F.struct(F.lit(r.priority).alias("p"), F.col("seq").alias("s")).alias(f"at_{uid}")).join(own, KEYS) for back, uid in ((0, "dst_uid"), (1, "src_uid"))]
        parts.append(ends)
    union = lambda k: _union([p[k] for p in parts])
    first = union(0).groupBy(*KEYS, F.col("dst_uid").alias("a")).agg(F.min("at_dst_uid").alias("at_a"))
    second = union(1).groupBy(*KEYS, F.col("src_uid").alias("b")).agg(F.min("at_src_uid").alias("at_b"))
    joined = pairs.drop("src_uid", "dst_uid").join(first, KEYS).join(second, KEYS)
    w = Window.partitionBy(*KEYS).orderBy("at_a", "a", "at_b", "b")
    return joined.select(*KEYS, F.col("a").alias("src_uid"), F.col("b").alias("dst_uid"), "t_min", "t_max", "hops", "before", "after", F.row_number().over(w).alias("order"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def staged_paths(found: DataFrame, chain_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates by ever wider searches, each for the pairs that still have none: between the anchors (10 paths); two more
    hops (25); from any node of the first segment; and, where chain_rows have rtype and action, between semantic anchors.
    """
    pairs = cut(pairs, "pairs")
    pool = search_pool(found, pairs)  # wider searches have the same windows
    wider = lambda p: p.withColumn("hops", F.col("hops") + 2)
    out = cut(candidate_paths(found, pairs, 10, pool), "found")
    out = cut(out.unionByName(candidate_paths(found, wider(without(pairs, out)), 25, pool)), "found")
    segments = fsa.segments(chain_rows, ["scope", "chain"], ["seq"])
    inside = segments.select("scope", "chain", F.col("segment").alias("pair"), F.explode(F.array("src_uid", "dst_uid")).alias("src_uid")).distinct()
    other = wider(without(pairs, out)).drop("src_uid").join(inside, KEYS)
    out = cut(out.unionByName(candidate_paths(found, other, 25, pool)), "found")
    if {"rtype", "action"} <= set(chain_rows.columns):
        more = candidate_paths(found, wider(semantic_anchors(chain_rows, without(pairs, out))), 25, pool)
        out = cut(out.unionByName(first_order(more)), "found")
    w = Window.partitionBy(*KEYS).orderBy("hops", "steps", "path")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CANDIDATES)


def payload(pairs: DataFrame, candidates: DataFrame, per_pair: int = 8, steps: int = 10) -> DataFrame:
    """scope, chain, payload (JSON): each chain's pairs with their best candidates, cut to so many steps, for a chooser."""
    best = heuristic(candidates).where(F.col("rank") <= per_pair)
    listed = best.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 6).alias("score"), F.slice("path", 1, steps + 1).alias("path"), F.slice("steps", 1, steps).alias("steps")))).alias("candidates"))
    rows = pairs.select(*KEYS, "src_uid", "dst_uid", "t_min", "t_max").join(listed, KEYS, "left")
    return rows.groupBy("scope", "chain").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pair", "src_uid", "dst_uid", "t_min", "t_max", "candidates")))).alias("payload"))


def path_signature(path: DataFrame, steps: str = "steps") -> DataFrame:
    """Candidates with the digest of their steps."""
    return path.withColumn("signature", F.substring(F.sha1(F.array_join(steps, "|")), 1, 20))
