"""The property graph: projection of ECS rows to nodes and edges, keyed upserts, queries and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import ids
from sentrylake.operators.asof import nearest
from sentrylake.operators.tables import cut, last_of

# The endpoint types that an edge type may have.
ENDPOINTS = {
    "LOGON": ({"User"}, {"Host"}), "RUNS_ON": ({"Process"}, {"Host"}), "SPAWN": ({"Process"}, {"Process"}), "FILE_ACCESS": ({"Host", "Process"}, {"File"}),
    "NET_CONNECT": ({"Host", "Process"}, {"IP"}), "DNS_QUERY": ({"Host", "Process"}, {"Domain"}), "RESOLVES_TO": ({"Domain"}, {"IP"}), "HAS_IP": ({"Host"}, {"IP"}),
}
EDGE_KEY = ["src_uid", "dst_uid", "rtype", "event_id"]
#: Parallel edges are dealt into packs of about so many by ``temporal_paths``.
PACK_EDGES = 1024


def host_uid() -> Column:
    return F.coalesce(ids.node_uid("Host", **{"host.id": F.col("host_id")}), ids.node_uid("Host", **{"host.name": F.col("host_name")}))


def user_uid() -> Column:
    named = F.when(F.col("user_name").isNotNull() & F.col("host_id").isNotNull(), ids.node_uid("User", **{"host.id": F.col("host_id"), "user.name": F.col("user_name")}))
    return F.coalesce(ids.node_uid("User", **{"user.id": F.col("user_id").cast("string")}), named)


def process_uid() -> Column:
    """By the given id, else by one made of host, pid, start (or time) and executable, where all are there."""
    start = F.coalesce("process_start", F.col("ts_us").cast("string"))
    known = F.col("host_id").isNotNull() & F.col("pid").isNotNull() & F.col("executable").isNotNull()
    made = F.when(known, ids.process_entity_id(F.col("host_id"), F.col("pid"), start, F.col("executable")))
    return ids.node_uid("Process", **{"process.entity_id": F.coalesce("process_entity_id", made)})


def file_op(action: Column) -> Column:
    """write, read or execute by what the action says, else the action itself."""
    low = F.lower(action)
    return F.when(low.rlike("write|modify|create|delete"), "write").when(low.rlike("read|open"), "read").when(F.contains(low, F.lit("execute")), "execute").otherwise(action)


#: What else is read from rows where they have it, with its type.
OPTIONAL = {
    "pid": "long", "executable": "string", "process_start": "string", "parent_entity_id": "string", "file_path": "string", "dst_domain": "string", "dst_port": "long", "dns_answers": "array<string>", "host_ips": "array<string>",
    "category": "array<string>", "outcome": "string", "session_id": "string", "rule_id": "string", "rule_name": "string", "tactic_name": "string", "confidence": "double", "providers": "array<string>", "fingerprint": "string",
    "event_type": "array<string>", "event_code": "string", "ruleset": "string", "framework": "string", "stage": "string", "command_line": "string", "process_name": "string", "file_sha256": "string", "parent_name": "string",
}
#: Properties that an edge takes over from its event, and those that only alerts give.
EVENT_PROPS = ("kind", "dataset", "action", "category", "event_type", "event_code", "outcome", "session_id")
ALERT_PROPS = ("rule_id", "rule_name", "tactic_name", "confidence", "providers", "fingerprint", "evidence_ids", "ruleset", "framework", "stage")


def completed(rows: DataFrame) -> DataFrame:
    """rows with nulls for the columns of OPTIONAL that they don't have."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in rows.columns})


def file_uid() -> Column:
    return F.when(F.col("file_path").isNotNull() & F.col("host_id").isNotNull(), ids.node_uid("File", **{"file.path": F.col("file_path"), "host.id": F.col("host_id")}))


def ip_uid(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.concat(F.lit("IP:ip="), c))


def domain_uid(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.concat(F.lit("Domain:domain.name="), c))


def eligible(rows: DataFrame) -> DataFrame:
    """Events, and alerts that are canonical findings with evidence; an id and a time are needed."""
    alert = (F.col("kind") == "alert") & (F.col("dataset") == "finding.canonical") & (F.size("evidence_ids") > 0)
    return rows.where(((F.col("kind") == "event") | alert) & F.col("event_id").isNotNull() & F.col("ts_us").isNotNull())


UIDS = ("_host", "_user", "_process", "_file", "_ip", "_domain", "_parent")


def with_uids(rows: DataFrame) -> DataFrame:
    """rows with the uids of what they name, each computed once."""
    parent = ids.node_uid("Process", **{"process.entity_id": F.col("parent_entity_id")})
    return completed(rows).withColumns(dict(zip(UIDS, (host_uid(), user_uid(), process_uid(), file_uid(), ip_uid(F.col("dst_ip")), domain_uid(F.col("dst_domain")), parent), strict=True)))


def with_links(rows: DataFrame) -> DataFrame:
    """Rows of with_uids with ``links``, an array of struct(src_uid, rtype, dst_uid); all conditions are evaluated in one pass."""
    h, u, p, f, ip, domain, parent = map(F.col, UIDS)
    actor = F.coalesce(p, h)
    ds, category = F.col("dataset"), F.coalesce("category", F.array().cast("array<string>"))
    has = lambda c: F.array_contains(category, c)

    def link(when: Column, src: Column, rtype: str, dst: Column) -> Column:
        return F.when(when & src.isNotNull() & dst.isNotNull(), F.struct(src.alias("src_uid"), F.lit(rtype).alias("rtype"), dst.alias("dst_uid")))

    process = has("process") | (ds == "hostlog.process")
    net = (ds == "netflow.flow") | ((ds == "hostbehavior.syscall") & F.contains(F.lower("action"), F.lit("connect"))) | ((F.col("kind") == "alert") & has("network"))
    dns = (ds == "netflow.dns") | ((F.col("kind") == "alert") & (has("dns") | F.contains(F.lower("action"), F.lit("dns"))))
    links = F.array(
        link(has("authentication") | (ds == "hostlog.auth"), u, "LOGON", h), link(process, p, "RUNS_ON", h), link(process, parent, "SPAWN", p),
        link(has("file") | ds.isin("hostbehavior.file", "hostlog.file_registry"), F.when(ds == "hostlog.file_registry", F.coalesce(p, h)).otherwise(p), "FILE_ACCESS", f),
        link(net, actor, "NET_CONNECT", ip), link(dns, actor, "DNS_QUERY", domain),
    )
    own = F.transform(F.coalesce("host_ips", F.array().cast("array<string>")), lambda x: F.when(h.isNotNull() & (F.trim(x) != ""), F.struct(h.alias("src_uid"), F.lit("HAS_IP").alias("rtype"), F.concat(F.lit("IP:ip="), x).alias("dst_uid"))))
    answers = F.transform(F.coalesce("dns_answers", F.array().cast("array<string>")), lambda x: link(dns & (F.trim(x) != ""), domain, "RESOLVES_TO", F.concat(F.lit("IP:ip="), x)))
    return rows.withColumn("links", F.array_compact(F.concat(links, own, answers)))


def edges(rows: DataFrame) -> DataFrame:
    """src_uid, dst_uid, rtype, event_id, ts_us, ts_float, is_alarm, tactic_id, technique_id, severity, op (of file accesses), dst_port
    (of connections), EVENT_PROPS and, of alarms, ALERT_PROPS of eligible rows' links.
    """
    # explode_outer: for explode, Spark infers a filter on the list's size, which computes the whole list twice
    out = with_links(with_uids(eligible(rows))).select("*", F.explode_outer("links").alias("l")).where("l.src_uid IS NOT NULL")
    return out.select(
        "l.src_uid", "l.dst_uid", "l.rtype", "event_id", "ts_us", (F.col("ts_us") / F.lit(1e6)).alias("ts_float"), (F.col("kind") == "alert").alias("is_alarm"), "tactic_id", "technique_id", "severity",
        F.when(F.col("l.rtype") == "FILE_ACCESS", file_op(F.col("action"))).alias("op"), F.when(F.col("l.rtype") == "NET_CONNECT", F.col("dst_port")).alias("dst_port"),
        *EVENT_PROPS, *[F.when(F.col("kind") == "alert", F.col(c)).alias(c) for c in ALERT_PROPS],
    )


def nodes(rows: DataFrame) -> DataFrame:
    """uid, ntype, ts_us (of the last mention), name and name_us (of its last one); one row for each node that a row names or an edge touches."""
    pick = lambda uid, kind, name: F.when(F.col(uid).isNotNull(), F.struct(F.col(uid).alias("uid"), F.lit(kind).alias("ntype"), F.col(name).cast("string").alias("name")))
    own = (("_host", "Host", "host_name"), ("_user", "User", "user_name"), ("_process", "Process", "process_name"), ("_file", "File", "file_path"), ("_ip", "IP", "dst_ip"), ("_domain", "Domain", "dst_domain"))
    end = lambda x: F.struct(x.alias("uid"), F.substring_index(x, ":", 1).alias("ntype"), F.lit(None).cast("string").alias("name"))
    touched = F.flatten(F.transform("links", lambda x: F.array(end(x["src_uid"]), end(x["dst_uid"]))))
    named = F.array_compact(F.concat(F.array(*[pick(*x) for x in own]), touched))
    out = with_links(with_uids(eligible(rows))).select("ts_us", "event_id", F.explode_outer(named).alias("n")).where("n.uid IS NOT NULL")
    last = F.struct("ts_us", "event_id")
    return out.groupBy("n.uid", "n.ntype").agg(F.max("ts_us").alias("ts_us"), F.max_by("n.name", F.when(F.col("n.name").isNotNull(), last)).alias("name"), F.max(F.when(F.col("n.name").isNotNull(), F.col("ts_us"))).alias("name_us"))


def node_properties(rows: DataFrame) -> DataFrame:
    """uid, props of the nodes that eligible rows name: of each property the last value, by time; absent ones don't erase any."""
    c = F.col

    def node(uid: str, **props: str) -> Column:
        given = F.create_map(*[x for k, column in props.items() for x in (F.lit(k.replace("__", ".")), c(column).cast("string"))])
        return F.when(c(uid).isNotNull(), F.struct(c(uid).alias("uid"), F.map_filter(given, lambda _, v: v.isNotNull()).alias("props")))

    own = F.array(
        node("_host", host__id="host_id", host__name="host_name"), node("_user", user__id="user_id", user__name="user_name", host__id="host_id"),
        node("_process", process__pid="pid", process__name="process_name", process__executable="executable", process__command_line="command_line", process__start="process_start", host__id="host_id"),
        node("_parent", process__name="parent_name", host__id="host_id"), node("_file", file__path="file_path", file__hash__sha256="file_sha256", host__id="host_id"),
        node("_ip", ip="dst_ip"), node("_domain", domain__name="dst_domain"),
    )
    named = with_uids(eligible(rows)).select("ts_us", F.explode_outer(F.array_compact(own)).alias("n")).where("n.uid IS NOT NULL")
    return merge_nodes(named.select("n.uid", "n.props", F.col("ts_us").alias("ord")))


def duplicate_nodes(stored: DataFrame) -> DataFrame:
    """uid, n: nodes that are stored more than once, or under more than one type."""
    return stored.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def invalid_edges(found: DataFrame) -> DataFrame:
    """Edges whose endpoints' types their own type doesn't allow: for quarantine."""
    src, dst = F.substring_index("src_uid", ":", 1), F.substring_index("dst_uid", ":", 1)
    ok = reduce(lambda a, b: a | b, [(F.col("rtype") == t) & src.isin(*s) & dst.isin(*d) for t, (s, d) in ENDPOINTS.items()])
    return found.where(~ok)


def merge_nodes(updates: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """uid, props from rows (uid, props map, ord): each property's last value wins; absent ones stay as they are."""
    if stored is not None:
        updates = stored.select("uid", "props", F.lit(-1).cast("long").alias("ord")).unionByName(updates.select("uid", "props", "ord"))
    flat = updates.select("uid", "ord", F.explode("props").alias("k", "v"))
    last = flat.groupBy("uid", "k").agg(F.max_by("v", F.struct("ord", "v")).alias("v"))
    return last.groupBy("uid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))


def merge_edges(updates: DataFrame, stored: DataFrame | None = None, order: str = "ts_us") -> DataFrame:
    """One row for each (source, target, type, event); the last one by ``order`` wins, ties going to the
    greatest of the other values. An edge without event is an error.
    """
    rows = updates if stored is None else stored.unionByName(updates, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in EDGE_KEY]
    checked = rows.withColumn("event_id", F.coalesce("event_id", F.raise_error(F.lit("an edge needs an event id")).cast("string")))
    out = checked.groupBy(*EDGE_KEY).agg(F.max_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)))).alias("_r"))
    return out.select(*EDGE_KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_analysis(found: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """Sets analysis columns of the edges that results name; edges of the key without a value get null."""
    return found.drop(*fields).join(last_of(results.select(*EDGE_KEY, *fields), EDGE_KEY, []), EDGE_KEY, "left")


def in_window(found: DataFrame, t_min: float, t_max: float, rtypes: list[str] | None = None, alarms_only: bool = False) -> DataFrame:
    out = found.where(F.coalesce("ts_float", F.lit(0.0)).between(t_min, t_max))
    out = out.where(F.col("rtype").isin(*rtypes)) if rtypes else out
    return alarms(out) if alarms_only else out


def alarms(found: DataFrame) -> DataFrame:
    return found.where(F.coalesce("is_alarm", F.lit(False)))


def by_attack_id(found: DataFrame, attack_id: str) -> DataFrame:
    return found.where((F.col("technique_id") == attack_id) | (F.col("tactic_id") == attack_id))


def endpoints(found: DataFrame) -> DataFrame:
    """uid: the distinct endpoints of edges."""
    return found.select(F.explode(F.array("src_uid", "dst_uid")).alias("uid")).distinct()


def nodes_of(all_nodes: DataFrame, found: DataFrame) -> DataFrame:
    return all_nodes.join(endpoints(found), "uid", "left_semi")


def incident(found: DataFrame, uid: str) -> DataFrame:
    return found.where((F.col("src_uid") == uid) | (F.col("dst_uid") == uid))


def infer_host(found: DataFrame, uid: str) -> DataFrame:
    """host_uid: the node itself if it is a host, else the host that its earliest incident edge touches."""
    if uid.startswith("Host:"):
        return found.sparkSession.createDataFrame([(uid,)], "host_uid string")
    other = F.when(F.col("src_uid") == uid, F.col("dst_uid")).otherwise(F.col("src_uid"))
    rows = incident(found, uid).select(other.alias("host_uid"), "ts_us", "event_id").where("host_uid LIKE 'Host:%'")
    return rows.agg(F.min_by("host_uid", F.struct("ts_us", "event_id")).alias("host_uid"))


def parallel_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("src_uid", "rtype", "dst_uid").agg(F.count(F.lit(1)).alias("n_edges"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def shortest_costs(found: DataFrame, source: str, risks: dict[str, float] | None = None, least_risk: float = 0.0, window: tuple[float, float] | None = None) -> DataFrame:
    """uid, cost, hops, path of the cheapest directed path from source to every node it reaches.

    An edge costs max_risk + 1 - its type's risk (1.0 where none is given); types below ``least_risk`` are left out.
    Only edges in ``window`` (seconds, if given) count. Relaxes from the nodes that became cheaper in the last round only;
    rounds end when none did, however many hops that takes. The cheapest of parallel edges is kept before the first round,
    every round cuts its lineage, and rounds carry predecessors alone: paths are put together at the end by doubling.
    """
    risks = risks or {}
    top = max([1.0, *risks.values()])
    risk = F.lit(1.0)
    for t, r in risks.items():
        risk = F.when(F.col("rtype") == t, F.lit(float(r))).otherwise(risk)
    used = found if window is None else in_window(found, *window)
    step = used.withColumn("risk", risk).where(F.col("risk") >= least_risk)
    step = cut(step.groupBy("src_uid", "dst_uid").agg(F.min(F.lit(top + 1.0) - F.col("risk")).alias("step")), "steps")
    start = found.sparkSession.createDataFrame([(source, 0.0, 0, None)], "uid string, cost double, hops int, before string")
    best, front = cut(start, "best"), start
    while True:  # ends: costs are positive, so each node's falls to its least
        reached = front.join(step, F.col("uid") == F.col("src_uid")).select(F.col("dst_uid").alias("uid"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src_uid").alias("before"))
        reached = reached.groupBy("uid").agg(F.min(F.struct("cost", "hops", "before")).alias("n"))
        better = reached.join(best.select("uid", F.col("cost").alias("old")), "uid", "left").where("old IS NULL OR n.cost < old - 1e-12").select("uid", "n.cost", "n.hops", "n.before")
        front = cut(better, "front")
        if front.isEmpty():
            break
        best = cut(best.join(front.select("uid"), "uid", "left_anti").unionByName(front), "best")
    # path: the known end of a node's path; back: the node before it
    paths = cut(best.select("uid", F.col("before").alias("back"), F.array("uid").alias("path")), "paths")
    while not paths.where("back IS NOT NULL").isEmpty():
        more = paths.select(F.col("uid").alias("back"), F.col("back").alias("_back"), F.col("path").alias("_path"))
        joined = paths.join(more, "back", "left")
        paths = cut(joined.select("uid", F.col("_back").alias("back"), F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path")), "paths")
    return best.drop("before").join(paths.select("uid", "path"), "uid")


def packed(both: DataFrame) -> DataFrame:
    """at, to, leg: the edges between two nodes (at, to, event_id, ts_float) in one row, as (t, id) by time; those with over PACK_EDGES
    are dealt into packs of about that many.
    """
    many = both.groupBy("at", "to").agg(F.ceil(F.count(F.lit(1)) / F.lit(PACK_EDGES)).alias("packs")).where("packs > 1")  # a pair for each PACK_EDGES edges at most
    part = F.pmod(F.xxhash64("event_id", "ts_float"), F.coalesce("packs", F.lit(1))).alias("part")
    dealt = both.join(F.broadcast(many), ["at", "to"], "left").select("at", "to", part, F.struct(F.col("ts_float").alias("t"), F.col("event_id").alias("id")).alias("e"))
    return dealt.groupBy("at", "to", "part").agg(F.array_sort(F.collect_list("e")).alias("leg")).drop("part")


def _walked(walks: DataFrame, hops: int, texts: bool) -> DataFrame:
    """The paths of walks over packs (src_uid, end, path, leg0, leg1, ...): every choice of an edge a leg whose times never descend.

    What a path shares with others, its nodes and its first steps, is put together once for all of them.
    """
    rows = walks.withColumns({"path": F.array_join("path", ">") if texts else F.col("path"), "steps": F.lit(None).cast("string") if texts else F.array().cast("array<string>"), "t": F.lit(-1e300)})
    for i in range(hops):
        rows = rows.withColumn("e", F.explode(f"leg{i}")).where("e.t >= t")
        longer = F.when(F.col("e.id").isNull(), F.col("steps")).when(F.col("steps").isNull(), F.col("e.id")).otherwise(F.concat("steps", F.lit(","), "e.id"))
        steps = longer if texts else F.concat("steps", F.array("e.id"))
        rows = rows.select("src_uid", "end", "path", *[f"leg{k}" for k in range(i + 1, hops)], F.col("e.t").alias("t"), steps.alias("steps"))
    return rows.select("src_uid", F.col("end").alias("dst_uid"), F.lit(hops).alias("hops"), "path", F.coalesce("steps", F.lit("")).alias("steps") if texts else F.col("steps"))


def temporal_paths(found: DataFrame, sources: DataFrame, most_hops: int, t_min: float, t_max: float, targets: DataFrame | None = None, per_pair: int = 20, texts: bool = False) -> DataFrame:
    """src_uid, dst_uid, hops, path (uids), steps (event ids): simple paths over undirected edges in a window, times never
    descending; for each pair the first ``per_pair`` by (hops, steps), when targets are given. With ``texts``, path and steps are
    texts, joined by > and by commas.

    Walks go over packs of parallel edges, of which each leg keeps those that the walk can take; they become paths where
    these are read. So what is stored follows the edges of the nodes that walks come by, and not the number of paths.
    """
    pool = in_window(found, t_min, t_max).where("src_uid <> dst_uid").select("src_uid", "dst_uid", "event_id", "ts_float")
    both = pool.select(F.col("src_uid").alias("at"), F.col("dst_uid").alias("to"), "event_id", "ts_float").unionByName(pool.select(F.col("dst_uid").alias("at"), F.col("src_uid").alias("to"), "event_id", "ts_float"))
    packs = packed(cut(both, "pool"))
    front = sources.select(F.col("uid").alias("src_uid"), F.col("uid").alias("end"), F.array("uid").alias("path"), F.lit(-1e300).alias("since"))
    goals = None if targets is None else cut(targets.select(F.col("uid").alias("end")).distinct(), "goals")
    out, legs = [], []
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for hop in range(most_hops):
        # few walks can make many: they are dealt out whatever their bytes and nodes
        front = front.repartition(parts, "end", "path", "since")
        j = front.join(packs, front["end"] == packs["at"]).where((F.element_at("leg", -1)["t"] >= F.col("since")) & ~F.array_contains("path", F.col("to")))
        leg = F.filter("leg", lambda e: e["t"] >= F.col("since"))
        front = j.select("src_uid", F.col("to").alias("end"), F.concat("path", F.array("to")).alias("path"), *legs, leg.alias(f"leg{hop}"))
        legs.append(f"leg{hop}")
        front = front.withColumn("since", F.col(legs[-1])[0]["t"])
        # the last hop's walks, by far the most, are the result: they are made once, where it is read, and not stored before
        front = front if hop + 1 == most_hops else cut(front, "walks")
        out.append(_walked(front if goals is None else front.join(goals, "end", "left_semi"), hop + 1, texts))
        if hop + 1 < most_hops and front.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, out)
    if goals is None:
        return rows
    w = Window.partitionBy("src_uid", "dst_uid").orderBy("hops", "steps", "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_pair).drop("rank")


def latest_departures(both: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, left, departs: from where, with so many hops left, a goal is reached by edges whose times never descend, if
    the first of them leaves at ``departs`` or before. The search goes backwards from the goals.

    both: at, to, ts_float, event_id of edges in both directions; goals: keys, node, t_min, t_max, most (hops). Of each
    node the rows whose departure is later than with fewer hops are given, so at most ``most`` + 1; rounds carry a row for each node
    that got a later departure, and no paths. A departure allows walks that come by a node again, so it never misses a path.
    """
    limit = goals.agg(F.max("most").alias("n")).first()["n"] or 0
    bounds = [*keys, "t_min", "t_max", "most"]
    front = cut(goals.select(*bounds, "node", F.lit(0).alias("left"), F.col("t_max").alias("departs")), "departures")
    best = front
    out = [front]
    for hop in range(1, limit + 1):
        j = front.where(F.col("most") >= hop).join(both.select("at", "to", "ts_float"), F.col("node") == F.col("to")).where("ts_float >= t_min AND ts_float <= departs")
        later = j.groupBy(*bounds, F.col("at").alias("node")).agg(F.max("ts_float").alias("departs"))
        known = best.groupBy(*keys, "node").agg(F.max("departs").alias("known"))
        front = cut(later.join(known, [*keys, "node"], "left").where("known IS NULL OR departs > known").select(*bounds, "node", F.lit(hop).alias("left"), "departs"), "departures")
        if front.isEmpty():
            break
        out.append(front)
        best = reduce(DataFrame.unionByName, out)
    return reduce(DataFrame.unionByName, out).select(*keys, "node", "left", "departs")


def reverse_paths(found: DataFrame, targets: DataFrame, most_hops: int, t_min: float, t_max: float) -> DataFrame:
    """dst_uid, uid, hops, departs: from which nodes each target (uid) can be reached within the window by undirected edges in
    time order, and how late one may leave: for each number of hops with which one may leave later than with fewer.
    """
    pool = in_window(found, t_min, t_max).select(F.col("src_uid").alias("at"), F.col("dst_uid").alias("to"), "event_id", "ts_float")
    both = cut(pool.unionByName(pool.select(F.col("to").alias("at"), F.col("at").alias("to"), "event_id", "ts_float")).where("at <> to"), "pool")
    goals = targets.select(F.col("uid").alias("dst_uid"), F.col("uid").alias("node"), F.lit(float(t_min)).alias("t_min"), F.lit(float(t_max)).alias("t_max"), F.lit(most_hops).alias("most")).distinct()
    return latest_departures(both, goals, ["dst_uid"]).select("dst_uid", F.col("node").alias("uid"), F.col("left").alias("hops"), "departs")


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b), root being the smallest node that it is connected with.

    Each round, nodes take the least root in their neighbourhood and then their root's root; every round cuts its lineage.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct(), "links")
    roots = cut(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root")), "roots")
    while True:
        told = both.join(roots.select(F.col("node").alias("near"), F.col("root").alias("_near")), "near").groupBy("node").agg(F.min("_near").alias("_near"))
        next_roots = roots.join(told, "node").select("node", F.least("root", "_near").alias("root"), F.col("root").alias("old"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("_above"))
        next_roots = cut(next_roots.join(above, "root", "left").select("node", F.least("root", F.coalesce("_above", "root")).alias("root"), "old"), "roots")
        roots = next_roots.select("node", "root")
        if next_roots.where("root <> old").isEmpty():
            return roots


def incidents(found: DataFrame, own_ips: DataFrame, gap_s: float = 6 * 3600.0) -> DataFrame:
    """The alarm edges with ``scope``: connected incidents over hosts.

    A source's alarms with gaps of up to ``gap_s`` are a session, whatever the day; a session is joined to that of another
    host (own_ips: ip_uid, host_uid) which one of its alarms goes to, if that one is on within the gap. Joined sessions are an incident.
    """
    found_alarms = alarms(found).where("src_uid IS NOT NULL AND ts_float IS NOT NULL").withColumns({"key": F.col("src_uid"), "ts_us": F.round(F.col("ts_float") * F.lit(1e6)).cast("long")})
    times = cut(found_alarms.select("key", "ts_us").distinct().withColumn("event_id", F.lit("")), "alarm-times")
    before = nearest(times, times.select("key", (F.col("ts_us") - 1).alias("ts_us")))
    gap_us = F.lit(round(gap_s * 1e6))
    starts = before.where((F.col("found").isNull()) | (F.col("ts_us") + 1 - F.col("found.ts_us") > gap_us)).select("key", (F.col("ts_us") + 1).alias("ts_us"), F.lit("").alias("event_id"))
    rows = nearest(starts, found_alarms).withColumn("session", F.concat_ws("#", "src_uid", F.col("found.ts_us").cast("string")))
    rows = cut(rows.select(*found.columns, "session"), "sessions")
    spans = rows.groupBy("src_uid", "session").agg(F.min("ts_float").alias("t_start"), F.max("ts_float").alias("t_end"))
    # sessions of a host lie over a gap apart, so at most two are within it of a time: few rows a slot
    slots = F.sequence(F.floor((F.col("t_start") - gap_s) / gap_s).cast("long"), F.floor((F.col("t_end") + gap_s) / gap_s).cast("long"))
    spans = spans.select(F.col("src_uid").alias("host_uid"), F.col("session").alias("b"), "t_start", "t_end", F.explode(slots).alias("slot"))
    goes = rows.select(F.col("session").alias("a"), F.col("src_uid"), F.col("dst_uid").alias("ip_uid"), "ts_float", F.floor(F.col("ts_float") / gap_s).cast("long").alias("slot")).join(own_ips.select("ip_uid", "host_uid").distinct(), "ip_uid").where("src_uid <> host_uid")
    links = goes.join(spans, ["host_uid", "slot"]).where((F.col("ts_float") >= F.col("t_start") - gap_s) & (F.col("ts_float") <= F.col("t_end") + gap_s)).select("a", "b").distinct()
    roots = components(links)
    return rows.join(roots.select(F.col("node").alias("session"), "root"), "session", "left").withColumn("scope", F.coalesce("root", "session")).drop("session", "root")
