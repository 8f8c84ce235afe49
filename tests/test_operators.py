from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import attack, ids, texts
from sentrylake.functions.times import graph_seconds, parse_time, rfc3339
from sentrylake.operators import analysis, correlate, detect, findings, fsa, graph, killchain, normalize, reports, sensors, tables, ttp
from sentrylake.sources import readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_times(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T11:04:05.123456+0800",), ("1704164645",), ("1704164645123",), ("now",), ("",), (None,), ("2024-01-02",)], "t string")
    got = [r["x"] for r in rows.select(rfc3339(parse_time(F.col("t"))).alias("x")).collect()]
    assert got == ["2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05.000000Z", "2024-01-02T03:04:05.123000Z", None, None, None, "2024-01-02T00:00:00.000000Z"]
    assert [r["x"] for r in rows.select(graph_seconds(F.col("t")).alias("x")).collect()][2:7] == [1704164645.0, 1704164645123.0, 0.0, 0.0, 0.0]


def test_ids_and_texts(spark):
    r = one(
        spark, ids.node_uid("User", **{"user.name": F.lit("bob"), "host.id": F.lit("h-1")}).alias("u"), ids.node_uid("Host", **{"host.id": F.lit(None).cast("string")}).alias("none"), ids.parse_uid(F.lit("User:host.id=h-1;user.name=a=b")).alias("p"), ids.parse_uid(F.lit("IP:10.0.0.1")).alias("q"),
        texts.entropy(F.lit("aabb")).alias("e"), texts.entropy(F.lit("")).alias("e0"), texts.glob(F.lit("netflow.dns"), "netflow.*").alias("g"), texts.glob(F.lit("a_b"), "a?b").alias("g2"), texts.glob(F.lit("axb"), "a_b").alias("g3"), texts.size_bytes(F.lit("16kb")).alias("s"),
        texts.in_network(F.lit("10.1.2.3"), "10.0.0.0/8").alias("n"), texts.in_network(F.lit("::1"), "10.0.0.0/8").alias("n6"), texts.truncated(F.lit("x" * 300)).alias("t"), texts.basename(F.lit("C:\\a\\b.exe")).alias("b"), texts.truthy(F.lit("Yes")).alias("y"),
    )
    assert r["u"] == "User:host.id=h-1;user.name=bob" and r["none"] is None and r["p"]["key"] == {"host.id": "h-1", "user.name": "a=b"} and r["q"]["key"] == {"ip": "10.0.0.1"}
    assert (r["e"], r["e0"], r["g"], r["g2"], r["g3"], r["s"], r["n"], r["n6"], len(r["t"]), r["b"], r["y"]) == (1.0, 0.0, True, True, False, 16384, True, None, 203, "b.exe", True)


def test_attack_maps(spark):
    t = spark.createDataFrame([("t1059.004",), ("T1021",), ("T0001",), (None,)], "t string")
    assert [r[0] for r in t.select(attack.tactic_of_technique(F.col("t"))).collect()] == ["TA0002", "TA0008", "TA0000", "TA0000"]
    assert one(spark, attack.tactic_id_of_name(F.lit("Lateral Movement")).alias("x"))["x"] == "TA0008"


def test_normalize_documents(spark):
    base = {"@timestamp": "2024-01-01T00:00:00Z", "event": {"id": "e1", "kind": "alert", "dataset": "falco", "severity": 150}, "host": {"name": " h "}}
    docs = [
        base, {**base, "event": {**base["event"], "severity": "x"}, "tags": ["attack.t1110", "attack.lateral_movement"]}, {**base, "event": {**base["event"], "kind": "other"}}, {**base, "@timestamp": None},
        {**base, "threat": {"technique": [{"id": "T1003"}]}}, {"@timestamp": "1704067200000", "event.id": "e2", "event.dataset": "hostlog.auth", "host.name": "h", "user.name": "u", "source.ip": "1.2.3.4"},
    ]
    rows = normalize.normalized(spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{",)], "value string")).collect()
    assert [r["drop_reason"] for r in rows] == [None, None, "bad_kind", "no_time", None, None, "invalid_json"]
    assert (rows[0]["severity"], rows[0]["dataset"], rows[0]["providers"], rows[0]["evidence_ids"], rows[0]["tactic_id"], rows[0]["technique_id"]) == (100, "finding.raw.falco", ["falco"], ["e1"], "TA0000", "T0000")
    assert (rows[1]["severity"], rows[1]["tactic_id"], rows[1]["technique_id"]) == (50, "TA0008", "T1110") and rows[4]["technique_id"] == "T1003"
    assert rows[5]["session_id"].startswith("sess-") and rows[5]["target_table"] == "events" and rows[0]["host_name"] == "h"
    counts = {r["outcome"]: r["n"] for r in normalize.store_counts(normalize.normalized(spark.createDataFrame([(json.dumps(base),), (json.dumps(base),), ("{",)], "value string"))).collect()}
    assert counts == {"stored": 1, "repeated": 1, "dropped:invalid_json": 1}


def test_falco(spark):
    lines = [
        {"time": "2024-01-01T00:00:00.5Z", "rule": "Run shell untrusted", "priority": "Warning", "hostname": "h", "output_fields": {"evt.type": "execve", "proc.pid": "7", "proc.exepath": "/bin/sh", "proc.name": "sh"}},
        {"time": "2024-01-01T00:00:00Z", "rule": "own", "priority": "Debug", "hostname": "h", "tags": ["threat.technique.id=T1005"], "output_fields": {"evt.type": "openat", "evt.is_open_write": "true", "fd.name": "/etc/x"}},
        {"time": "2024-01-01T00:00:00Z", "rule": "own", "priority": "what", "hostname": "h", "output_fields": {"evt.type": "connect", "fd.l4proto": "<NA>", "fd.sip": "9.9.9.9"}},
    ]
    rows = sensors.falco(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("no json",)], "value string")).collect()
    assert Counter((r["kind"], r["dataset"]) for r in rows) == Counter({("event", "hostlog.process"): 1, ("alert", "finding.raw.falco"): 2, ("event", "hostlog.file_registry"): 1, ("event", "hostbehavior.syscall"): 1})
    first = next(r for r in rows if r["dataset"] == "hostlog.process")
    assert first["process_entity_id"].startswith("p-") and first["technique_id"] == "T1059.004" and first["action"] == "process_start" and first["severity"] == 4
    second = next(r for r in rows if r["dataset"] == "hostlog.file_registry")
    assert second["action"] == "file_write" and second["technique_id"] == "T1005"
    third = next(r for r in rows if r["dataset"] == "hostbehavior.syscall")
    assert third["dst_ip"] == third["src_ip"] == "9.9.9.9" and third["transport"] is None


def test_fd_names_and_auth(spark):
    names = ["10.0.0.1:12->10.0.0.2:80", "10.0.0.2:80", "[2001:db8::1]:5->[2001:db8::2]:443", "/etc/passwd", ""]
    got = [tuple(r["x"]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(sensors.fd_endpoints(F.col("n")).alias("x")).collect()]
    assert got == [("10.0.0.1", 12, "10.0.0.2", 80), (None, None, "10.0.0.2", 80), ("2001:db8::1", 5, "2001:db8::2", 443), (None,) * 4, (None,) * 4]
    said = "Jan 1 h sshd[1]: Failed password for invalid user eve from 1.2.3.4 port 9"
    assert tuple(one(spark, sensors.auth(F.lit(said)).alias("x"))["x"]) == ("eve", "1.2.3.4", "user_login", "failure")


def test_rules_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "b.yml").write_text("title: B\nlevel: high\ntags: [attack.t1110]\ndetection:\n  s:\n    - message|contains: [Failed, Denied]\n    - message|contains|all: [session, opened]\n  condition: s\n")
    (tmp_path / "a.yml").write_text("title: A\ndetection:\n  s:\n    event.kind: alert\n  condition: s\n")
    (tmp_path / "c.yml").write_text(": [")
    rules = readers.message_rules(spark, f"file://{tmp_path}")
    assert [r.name for r in rules] == ["A", "B"] and rules[0].severity == 50 and rules[1].severity == 70
    d = spark.createDataFrame([("a FAILED b", "event"), ("Session was opened", "event"), ("session", "event"), ("x", "alert"), (None, None)], "message string, kind string")
    assert [r["matched_rules"] for r in detect.matched(d, rules).collect()] == [["B"], ["B"], [], ["A"], []]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('pre:{"data": [{"event": {"id": "1"}}, {"event.id": "2"}]}')
    assert [json.loads(r["value"]) for r in readers.json_documents(spark, f"file://{tmp_path}/a.json").collect()] == [{"event": {"id": "1"}}, {"event.id": "2"}]
    (tmp_path / "l.jsonl").write_text('{"event":{"id":"9"}}\n\n{"x":1}\nbroken{\n')
    got = [r["event_id"] for r in readers.queue_lines(readers.lines(spark, f"file://{tmp_path}/l.jsonl")).collect()]
    assert got[0] == "9" and got[1].startswith("evt-") and len(got) == 2
    bundle = {"objects": [
        {"type": "intrusion-set", "id": "is-1", "external_references": [{"source_name": "mitre-attack", "external_id": "G1"}]}, {"type": "intrusion-set", "id": "is-2"},
        {"type": "attack-pattern", "id": "ap-1", "external_references": [{"source_name": "mitre-attack", "external_id": "T1059.004"}], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}]},
        {"type": "x-mitre-tactic", "id": "t", "x_mitre_shortname": "execution", "external_references": [{"source_name": "mitre-attack", "external_id": "TA0002"}]},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "is-1", "target_ref": "ap-1"},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    uses, tactics = ttp.stix_uses(readers.stix_objects(spark, f"file://{tmp_path}/b.json"))
    assert sorted(map(tuple, uses.collect())) == [("G1", "T1059"), ("G1", "T1059.004")] and sorted(map(tuple, tactics.collect())) == [("T1059", "TA0002"), ("T1059.004", "TA0002")]


# --- findings, graph


def flat(spark, rows):
    return spark.createDataFrame(rows, "event_id string, ts_us long, technique_id string, tactic_id string, host_id string, process_entity_id string, dst_ip string, dst_domain string, file_sha256 string, provider string, severity int, confidence double")


def test_canonical_findings(spark):
    rows = [("a", 10, "T1", "TA", "h", "p", None, None, None, "falco", 10, 0.5), ("b", 20, "T1", "TA", "h", "p", None, None, None, "suricata", 90, 0.4), ("c", 30, None, None, None, None, None, None, None, "falco", 1, 0.2), ("d", None, "T1", "TA", "h", "p", None, None, None, "falco", 1, 0.2)]
    out = {r["event_id"]: r for r in findings.canonical(flat(spark, rows)).collect()}
    assert set(out) == {"a", "c"} and out["a"]["severity"] == 90 and out["a"]["confidence"] == pytest.approx(0.7) and out["a"]["providers"] == ["falco", "suricata"] and out["a"]["evidence_ids"] == ["a", "b"]
    assert out["c"]["confidence"] == pytest.approx(0.2)
    keys = [r[0] for r in flat(spark, [("x", 0, None, None, None, None, "1.1.1.1", "d", "s", "f", 1, 0.1), ("y", 0, "T", "t", "h", None, None, "d", "s", "f", 1, 0.1)]).select(findings.fingerprint_key()).collect()]
    assert keys == ["unknown|unknown|1.1.1.1|d|0", "T|h|s|0"]


def test_upserts(spark):
    first = spark.createDataFrame([("u", {"a": "1", "b": "2"}, 1), ("u", {"a": "3"}, 2)], "uid string, props map<string,string>, ord long")
    stored = graph.merge_nodes(first)
    assert stored.first()["props"] == {"a": "3", "b": "2"}
    again = graph.merge_nodes(spark.createDataFrame([("u", {"b": "9"}, 1)], "uid string, props map<string,string>, ord long"), stored)
    assert again.first()["props"] == {"a": "3", "b": "9"}
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, a string, b int")
    new = spark.createDataFrame([(2, "z", None), (3, "w", 5)], "k int, a string, b int")
    assert sorted(map(tuple, tables.upserted(old, new, ["k"]).collect())) == [(1, "x", 1), (2, "z", None), (3, "w", 5)]
    assert sorted(map(tuple, tables.merged(old, new, ["k"]).collect())) == [(1, "x", 1), (2, "z", 2), (3, "w", 5)]
    twice = spark.createDataFrame([(1, "p", 7, 1), (1, "q", None, 2), (9, "n", None, 1)], "k int, a string, b int, c int")
    assert sorted(map(tuple, tables.upserted(old, twice, ["k"], ["c"]).collect())) == [(1, "q", None, 2), (2, "y", 2, None), (9, "n", None, 1)]
    assert sorted(map(tuple, tables.merged(old, twice, ["k"], ["c"]).collect())) == [(1, "q", 7, 2), (2, "y", 2, None), (9, "n", None, 1)]
    lost = spark.createDataFrame([(1, "p"), (1, "q"), (9, "n"), (None, "x")], "k int, a string")
    assert {r["outcome"]: r["n"] for r in tables.upsert_counts(old, lost, ["k"]).collect()} == {"replaced": 1, "inserted": 1, "failed": 1}
    with pytest.raises(Exception, match="event id"):
        graph.merge_edges(spark.createDataFrame([("a", "b", "SPAWN", None, 1)], "src_uid string, dst_uid string, rtype string, event_id string, ts_us long")).collect()


def test_invalid_edges(spark):
    e = spark.createDataFrame([("User:x", "Host:y", "LOGON"), ("Host:y", "User:x", "LOGON"), ("IP:a", "IP:b", "ODD")], "src_uid string, dst_uid string, rtype string")
    assert {r["src_uid"] for r in graph.invalid_edges(e).collect()} == {"Host:y", "IP:a"}


EDGES = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 5.0), ("c", "d", 1.5), ("d", "a", 9.0), ("x", "y", 1.0), ("b", "d", 2.0), ("a", "b", 3.0)]


def edge_frame(spark):
    return spark.createDataFrame([(s, d, "SPAWN", f"e{i}", t) for i, (s, d, t) in enumerate(EDGES)], "src_uid string, dst_uid string, rtype string, event_id string, ts_float double")


def brute_paths(start, hops):
    out = Counter()
    steps = [(s, d, f"e{i}", t) for i, (s, d, t) in enumerate(EDGES)] + [(d, s, f"e{i}", t) for i, (s, d, t) in enumerate(EDGES)]

    def go(path, used, last):
        for s, d, e, t in steps:
            if s == path[-1] and t >= last and d not in path:
                out[(tuple(path + [d]), tuple(used + [e]))] += 1
                if len(used) + 1 < hops:
                    go(path + [d], used + [e], t)

    go([start], [], -1e300)
    return out


def test_paths(spark):
    e = edge_frame(spark)
    got = graph.temporal_paths(e, spark.createDataFrame([("a",)], "uid string"), 3, 0.0, 10.0).collect()
    assert Counter((tuple(r["path"]), tuple(r["steps"])) for r in got) == brute_paths("a", 3)
    costs = {r["uid"]: (r["cost"], r["hops"]) for r in graph.shortest_costs(e, "a").collect()}
    assert costs == {"a": (0.0, 0), "b": (1.0, 1), "c": (1.0, 1), "d": (2.0, 2)}
    assert {r["uid"] for r in graph.shortest_costs(e, "a", window=(0.0, 1.6)).collect()} == {"a", "b"}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "SPAWN", f"c{i}", 1.0) for i in range(40)], "src_uid string, dst_uid string, rtype string, event_id string, ts_float double")
    far = {r["uid"]: r for r in graph.shortest_costs(chain, "n0").collect()}
    assert len(far) == 41 and far["n40"]["hops"] == 40 and far["n40"]["path"] == [f"n{i}" for i in range(41)]
    best = graph.temporal_paths(e, spark.createDataFrame([("a",)], "uid string"), 3, 0.0, 10.0, spark.createDataFrame([("d",)], "uid string"), per_pair=2).collect()
    assert len(best) == 2 and min(r["hops"] for r in best) == 1


def test_walks_of_the_last_hop_are_not_stored(spark, monkeypatch):
    """They are the result; before them, walks are stored once a hop."""
    stored, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: (stored.append(name), cut(df, name))[1])
    got = graph.temporal_paths(edge_frame(spark), spark.createDataFrame([("a",)], "uid string"), 3, 0.0, 10.0).collect()
    assert Counter((tuple(r["path"]), tuple(r["steps"])) for r in got) == brute_paths("a", 3)
    assert stored == ["pool", "walks", "walks"]


@pytest.mark.parametrize("pack", [2, 1024])
def test_parallel_edges_are_walked_in_packs(spark, pack, monkeypatch):
    """Paths are those of all walks, with ties, loops, repeated edges and ids that are missing; as texts they are the same."""
    monkeypatch.setattr(graph, "PACK_EDGES", pack)
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(4)}", f"n{rng.randrange(4)}", "SPAWN", f"e{i}" if i % 9 else None, float(rng.randint(0, 9)) if i % 11 else None) for i in range(36)]
    edges += edges[:2]
    ways = [(a, b, i, t) for x, y, _, i, t in edges for a, b in ((x, y), (y, x)) if x != y and t is not None and 1.0 <= t <= 8.0]
    want, walks = Counter(), [(("n0",), (), -1.0)]
    for _ in range(3):
        walks = [((*p, b), (*s, i), t) for p, s, last in walks for a, b, i, t in ways if a == p[-1] and t >= last and b not in p]
        want.update((p, s) for p, s, _ in walks)
    found, source = spark.createDataFrame(edges, "src_uid string, dst_uid string, rtype string, event_id string, ts_float double"), spark.createDataFrame([("n0",)], "uid string")
    got = graph.temporal_paths(found, source, 3, 1.0, 8.0)
    assert Counter((tuple(r["path"]), tuple(r["steps"])) for r in got.collect()) == want and len(want) > 100
    as_texts = got.select("src_uid", "dst_uid", "hops", F.array_join("path", ">"), F.array_join("steps", ","))
    assert Counter(map(tuple, graph.temporal_paths(found, source, 3, 1.0, 8.0, texts=True).collect())) == Counter(map(tuple, as_texts.collect()))


def test_stored_walks_do_not_follow_the_number_of_paths(spark, monkeypatch):
    """Ten times the edges between the same nodes are as many stored walks, and a thousand times the paths."""
    cut, stored = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df, name: (kept := cut(df, name), stored.append((name, kept.count())))[0])
    paths = {}
    for n in (1, 10):
        edges = [(a, b, "SPAWN", f"{a}{i}", float(k)) for k, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "d")]) for i in range(n)]
        found = spark.createDataFrame(edges, "src_uid string, dst_uid string, rtype string, event_id string, ts_float double")
        paths[n] = graph.temporal_paths(found, spark.createDataFrame([("a",)], "uid string"), 3, 0.0, 10.0).where("hops = 3").count()
    assert paths == {1: 1, 10: 1000} and [n for name, n in stored if name == "walks"] == [1, 1, 1, 1]


@pytest.mark.parametrize("seed", range(3))
def test_reverse_search_against_all_walks(spark, seed):
    """Latest departures for each number of hops, with times that tie and edges that go both ways."""
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", "SPAWN", f"e{i}", float(rng.randint(0, 12))) for i in range(14)]
    d = spark.createDataFrame(edges, "src_uid string, dst_uid string, rtype string, event_id string, ts_float double")
    both = [(a, b, t) for a, b, _, _, t in edges if a != b and 1 <= t <= 11] + [(b, a, t) for a, b, _, _, t in edges if a != b and 1 <= t <= 11]
    want = set()
    for goal in ("n0", "n3"):
        best, level = {goal: 11.0}, {goal: 11.0}
        want.add((goal, goal, 0, 11.0))
        for hop in range(1, 5):
            reached = {}
            for a, b, t in both:
                if b in level and t <= level[b]:
                    reached[a] = max(reached.get(a, -1.0), t)
            level = {n: t for n, t in reached.items() if t > best.get(n, -1.0)}
            best |= level
            want |= {(goal, n, hop, t) for n, t in level.items()}
    targets = spark.createDataFrame([("n0",), ("n3",), ("n3",)], "uid string")
    assert {tuple(r) for r in graph.reverse_paths(d, targets, 4, 1.0, 11.0).collect()} == want


# --- correlation


def correlated(rng, n):
    return [(f"e{i}", rng.randint(0, 50) * 1000000, f"host{rng.randint(0, 3)}", f"h{rng.randint(0, 3)}", rng.choice(["u", "v", None]), rng.choice(["10.0.0.0", "10.0.0.1", "10.0.0.2", None]), f"10.0.0.{rng.randint(0, 3)}", f"10.0.0.{rng.randint(0, 3)}", 0, 0.0) for i in range(n)]


CORRELATED = "event_id string, ts_us long, host_name string, host_id string, user_name string, host_ip string, src_ip string, dst_ip string, level int, level_confidence double"


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_nearest_three_against_brute_force(spark, partitions):
    """Users and addresses may be missing, hosts share addresses, and keys cross many boundaries of partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(2)
        rows = correlated(rng, 120)
        d = spark.createDataFrame(rows, CORRELATED).cache()
        parts = [rows[0:40], rows[40:80], rows[80:120]]
        frames = [d.where(F.col("event_id").isin(*[r[0] for r in p])) for p in parts]
        want, users = set(), lambda x, y: x is None or y is None or x == y
        for e2 in parts[1]:
            before = [e for e in parts[0] if e[2] == e2[2] and users(e[4], e2[4]) and e[1] <= e2[1]]
            after = [e for e in parts[2] if e[5] in (None, e2[7]) and users(e[4], e2[4]) and e[1] >= e2[1] and e[2] != e2[2]]
            if before and after:
                want.add((min(before, key=lambda e: (-e[1], e[0]))[0], e2[0], min(after, key=lambda e: (e[1], e[0]))[0]))
        assert {(r["id1"], r["id2"], r["id3"]) for r in correlate.three_stage(*frames).collect()} == want and len(want) > 20
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("hot", "n"), [(0.1, 90), (0.9, 150)])
def test_two_stage_against_all_pairs(spark, hot, n):
    """One address in a tenth or in nine of ten rows; ranges, counts, latest partners and pairs agree with all pairs."""
    rng = random.Random(n)
    ip = lambda: None if rng.random() < 0.05 else "10.0.0.1" if rng.random() < hot else f"10.0.0.{rng.randint(2, 9)}"
    rows = [(f"e{i}", rng.randint(0, 40) * 1_000_000, f"h{rng.randint(0, 3)}" if rng.random() < 0.95 else None, "x", "u", ip(), ip(), ip(), 0, rng.choice([0.0, 0.4])) for i in range(2 * n)]
    a, b = rows[:n], rows[n:]
    first, second = (spark.createDataFrame(x, CORRELATED).repartition(5) for x in (a, b))
    links, ranges = correlate.two_stage(first, second, 9_000_000)
    met = lambda x, y: x is not None and x == y
    want = [(p, q) for p in a for q in b if p[2] and q[2] and p[2] != q[2] and (met(p[7], q[6]) or met(p[6], q[7])) and abs(p[1] - q[1]) <= 9_000_000]
    assert Counter((r["id1"], r["id2"]) for r in correlate.two_stage_pairs(ranges, second).collect()) == Counter((p[0], q[0]) for p, q in want) and len(want) > 100
    by = {}
    for p, q in want:
        by.setdefault(p[0], []).append(q)
    got = {r["id1"]: r for r in links.collect()}
    assert set(got) == set(by)
    for i, partners in by.items():
        assert (got[i]["n_links"], got[i]["id2"]) == (len(partners), min(partners, key=lambda q: (-q[1], q[0]))[0])


def test_wide_ranges_meet_in_few_blocks(spark):
    """A range touches three blocks at most, however wide it is, and they hold all its ranks."""
    rng = random.Random(5)
    made = [(lo, lo + rng.randint(1, 10**e)) for e in range(1, 7) for lo in (rng.randint(0, 10**6) for _ in range(30))] + [(0, 1), (31, 33), (0, 64), (63, 127), (0, 65)]
    rows = correlate.in_blocks(correlate.levelled(spark.createDataFrame(made, "low long, high long"))).collect()
    blocks = {}
    for r in rows:
        size = correlate.BLOCK_RANKS * correlate.BLOCK_GROWTH ** r["level"]
        blocks.setdefault((r["low"], r["high"]), set()).add((r["block"] * size, (r["block"] + 1) * size))
    assert set(blocks) == set(made)
    for (low, high), held in blocks.items():
        assert len(held) <= 3 and min(b[0] for b in held) <= low and max(b[1] for b in held) >= high and sum(y - x for x, y in held) == max(b[1] for b in held) - min(b[0] for b in held)


@pytest.mark.parametrize(("hot", "n"), [(0.1, 60), (0.9, 200)])
def test_ranges_alone_are_those_of_two_stage(spark, hot, n, monkeypatch):
    """Blocks of two ranks, so that ranges are on several levels."""
    monkeypatch.setattr(correlate, "BLOCK_RANKS", 2)
    rng = random.Random(n)
    ip = lambda: None if rng.random() < 0.05 else "10.0.0.1" if rng.random() < hot else f"10.0.0.{rng.randint(2, 9)}"
    rows = [(f"e{i}", rng.randint(0, 40) * 1_000_000, f"h{rng.randint(0, 3)}" if rng.random() < 0.95 else None, "x", "u", ip(), ip(), ip(), 0, rng.choice([0.0, 0.4])) for i in range(2 * n)]
    first, second = (spark.createDataFrame(x, CORRELATED).repartition(5) for x in (rows[:n], rows[n:]))
    ranges = correlate.two_stage_ranges(first, second, 9_000_000)
    assert Counter(map(tuple, ranges.collect())) == Counter(map(tuple, correlate.two_stage(first, second, 9_000_000)[1].collect()))
    met = lambda x, y: x is not None and x == y
    want = Counter((p[0], q[0]) for p in rows[:n] for q in rows[n:] if p[2] and q[2] and p[2] != q[2] and (met(p[7], q[6]) or met(p[6], q[7])) and abs(p[1] - q[1]) <= 9_000_000)
    assert Counter((r["id1"], r["id2"]) for r in correlate.two_stage_pairs(ranges, second).collect()) == want and want


@pytest.mark.parametrize(("hot", "n", "part_rows"), [(0.1, 60, 1 << 14), (0.9, 200, 7)])
def test_all_pairs_without_ranges(spark, hot, n, part_rows, monkeypatch):
    """Nothing is stored for them; busy periods of an address are dealt, and times before 1970, windows of nothing and missing values are like others."""
    monkeypatch.setattr(correlate, "PART_ROWS", part_rows)
    monkeypatch.setattr(correlate, "cut", None)
    rng = random.Random(n)
    ip = lambda: None if rng.random() < 0.05 else "10.0.0.1" if rng.random() < hot else f"10.0.0.{rng.randint(2, 9)}"
    rows = [(f"e{i}", rng.randint(-20, 20) * 1_000_000 if rng.random() < 0.95 else None, f"h{rng.randint(0, 3)}" if rng.random() < 0.95 else None, "x", "u", ip(), ip(), ip(), 0, rng.choice([0.0, 0.4])) for i in range(2 * n)]
    first, second = (spark.createDataFrame(x, CORRELATED).repartition(5) for x in (rows[:n], rows[n:]))
    met = lambda x, y: x is not None and x == y
    for window in (9_000_000, 0):
        want = Counter((p[0], q[0], p[1], 0.88 if max(p[9], q[9]) else 0.8) for p in rows[:n] for q in rows[n:] if p[2] and q[2] and p[2] != q[2] and p[1] is not None and q[1] is not None and (met(p[7], q[6]) or met(p[6], q[7])) and abs(p[1] - q[1]) <= window)
        assert Counter((r["id1"], r["id2"], r["ts_us"], round(r["score"], 6)) for r in correlate.two_stage_all(first, second, window).collect()) == want and want


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_over_boundaries(spark, forward):
    """A key of most rows and many ties; with another value asked for or not; nothing is dealt to a single partition."""
    from sentrylake.operators import asof

    rng = random.Random(7)
    key = lambda: rng.choice(["hot"] * 9 + ["a", "b", None])
    events = [(key(), rng.choice([None, *range(60)]), f"e{i:03}", rng.choice(["x", "x", "x", "y", None])) for i in range(300)]
    seekers = [(key(), rng.choice([None, *range(60)]), i, rng.choice(["x", "y"])) for i in range(200)]
    e = spark.createDataFrame(events, "key string, ts_us long, event_id string, host string").repartitionByRange(9, "event_id")
    s = spark.createDataFrame(seekers, "key string, ts_us long, n long, host string")
    for other in (None, "host"):
        got = {r["n"]: r for r in asof.nearest(e, s, forward, other).collect()}
        assert set(got) == {r[2] for r in seekers if r[0] is not None and r[1] is not None}
        for k, t, n, host in seekers:
            if k is None or t is None:
                continue
            good = [x for x in events if x[0] == k and x[1] is not None and (x[1] >= t if forward else x[1] <= t) and (other is None or x[3] is not None)]
            assert got[n]["seen"] == len(good)
            near = [x for x in good if other is None or x[3] != host]
            best = min(near, key=lambda x: (abs(x[1] - t), x[2]))[2] if near else None
            assert (got[n]["found"] and got[n]["found"]["event_id"]) == best
    ranked = asof.ranks(e).collect()
    of = lambda k: sorted((r for r in ranked if r["key"] == k), key=lambda r: r["rank"])
    for k in ("hot", "a", "b"):
        assert [r["rank"] for r in of(k)] == list(range(1, len(of(k)) + 1)) and [r["ts_us"] for r in of(k)] == sorted(r["ts_us"] for r in of(k))
    assert asof.nearest(e.limit(0), s).where("found IS NOT NULL OR seen > 0").isEmpty() and asof.nearest(e, s.limit(0)).isEmpty()


def test_privilege_levels(spark):
    rows = spark.createDataFrame([("SUDO", "", "bash"), ("x", "su root", "Firefox"), ("ls", None, "chrome"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in rows.select(correlate.privilege_level(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1, 2, 0, 0]


# --- state machine


def test_state_machine_by_hand():
    p = fsa.Policy()
    run = lambda *s: [h.taken for h in fsa.accepted(list(s), [str(i) for i in range(len(s))], p)]
    assert run("Initial Access", "Execution", "Exfiltration") == [(0, 1, 2)]
    assert run("Initial Access", "Execution") == []
    # Impact can't follow Initial Access: going back drops it and starts anew, or Impact itself is dropped
    assert run("Initial Access", "Impact") == [(1,)]
    assert run("Execution", "Impact", "Execution", "Exfiltration") == [(0, 1), (2, 3)]
    assert fsa.accepted([], [], p) == []


def test_state_machine_properties():
    rng = random.Random(4)
    p, states = fsa.Policy(), list(fsa.NEXT)
    for _ in range(50):
        s = [rng.choice(states) for _ in range(rng.randint(1, 25))]
        for h in fsa.accepted(s, [rng.choice("ab") for _ in s], p):
            assert list(h.taken) == sorted(set(h.taken)) and s[h.taken[-1]] in fsa.ACCEPT
            assert all(p.allows(s[a], s[b]) for a, b in zip(h.taken, h.taken[1:], strict=False))
            assert 0 <= fsa.chain_score(s, [60.0 * i for i in range(len(s))], h) <= 1


def test_chains_and_kill_chain(spark):
    rows = [("s", f"e{i}", t, float(i * 100), a, b) for i, (t, a, b) in enumerate([("InitialAccess", "n0", "n1"), ("Execution", "n1", "n2"), ("Execution", "n2", "n3"), ("Exfiltration", "n4", "n5"), ("nonsense", "n5", "n6")])]
    alarms = spark.createDataFrame(rows, "scope string, event_id string, tactic_name string, ts_float double, src_uid string, dst_uid string")
    chain = fsa.chains(alarms)
    assert [r["event_id"] for r in chain.orderBy("seq").collect()] == ["e0", "e1", "e2", "e3"]
    pairs = killchain.segment_pairs(chain).orderBy("pair").collect()
    assert [(r["src_uid"], r["dst_uid"], r["t_min"], r["t_max"], r["hops"]) for r in pairs] == [("n1", "n1", -120.0, 220.0, 8), ("n3", "n4", 80.0, 420.0, 8)]
    found = spark.createDataFrame([("n3", "m", "x1", 250.0), ("m", "n4", "x2", 260.0), ("n3", "n4", "late", 9999.0)], "src_uid string, dst_uid string, event_id string, ts_float double")
    out = killchain.kill_chains(alarms, found).collect()
    assert len(out) == 1 and out[0]["events"] == ["x1", "x2"] and out[0]["n_pairs"] == 2 and out[0]["hops"] == 2
    assert killchain.kill_chains(alarms, found.where("event_id = 'late'")).count() == 0
    chains, marked, touched = killchain.stored_chains(alarms, found, graph.endpoints(found))
    assert sorted(map(str, chains.collect())) == sorted(map(str, out))
    named = {r["event_id"] for r in marked.where("killchain IS NOT NULL").collect()}
    assert {e for r in out for e in r["events"]} <= named and touched.where("killchain IS NOT NULL").count() > 1


def test_candidate_paths_against_brute_force(spark):
    """One candidate for each simple path of nodes in time order, with the edges that arrive first."""
    rng = random.Random(9)
    names = list("abcdefg")
    rows = [(*rng.sample(names, 2), f"e{i:02d}", float(rng.randint(0, 30))) for i in range(45)]
    found = spark.createDataFrame(rows, "src_uid string, dst_uid string, event_id string, ts_float double")
    asked = [("s", 0, i, a, b, float(lo), float(lo + 18), hops, "x", "y") for i, (a, b, lo, hops) in enumerate([("a", "d", 0, 3), ("b", "g", 5, 4), ("c", "c", 0, 2), ("e", "f", 10, 2), ("a", "g", 12, 5)])]
    pairs = spark.createDataFrame(asked, "scope string, chain int, pair int, src_uid string, dst_uid string, t_min double, t_max double, hops int, before string, after string")
    want = {}
    for _, _, pair, a, b, lo, hi, hops, _, _ in asked:
        done = []

        def go(path, steps, last):
            if path[-1] == b:
                done.append((len(steps), steps, path))
                return
            for to in set(names) - set(path):
                first = min(((t, e) for s, d, e, t in rows if {s, d} == {path[-1], to} and lo <= t <= hi and t >= last), default=None)
                if first and len(steps) < hops:
                    go([*path, to], [*steps, first[1]], first[0])

        go([a], [], -1e300)
        want[pair] = sorted(done)[:20]
    got = {}
    for r in killchain.candidate_paths(found, pairs).orderBy("pair", "rank").collect():
        got.setdefault(r["pair"], []).append((r["hops"], r["steps"], r["path"]))
    assert got == {k: v for k, v in want.items() if v} and len(got[4]) > 3


def test_choice_of_paths(spark):
    pairs = spark.createDataFrame([("s", 0, 0, "A", "B"), ("s", 0, 1, "B", "C"), ("s", 1, 0, "A", "B")], "scope string, chain int, pair int, before string, after string")
    rows = [("s", 0, 0, 1, ["a", "b"], ["e1"], 1), ("s", 0, 1, 2, ["x", "y", "z"], ["e2", "e3"], 1), ("s", 0, 1, 2, ["a", "b", "z"], ["e4", "e5"], 2)]
    found = spark.createDataFrame(rows, "scope string, chain int, pair int, hops int, path array<string>, steps array<string>, rank int")
    scores = {tuple(r["steps"]): r["score"] for r in killchain.heuristic(found).collect()}
    assert scores[("e1",)] == 5.0 and scores[("e4", "e5")] == pytest.approx(10 / 3 + 1.0) and scores[("e2", "e3")] == pytest.approx(10 / 3)
    assert sorted(r["steps"] for r in killchain.choose(pairs, found).collect()) == [["e1"], ["e4", "e5"]]
    assert [(r["chain"], r["reason"]) for r in killchain.dropped(pairs, found).collect()] == [(1, "no path from A to B")]
    ask = lambda f: sorted(r["steps"] for r in killchain.choose(pairs, found, f).collect())
    assert ask(lambda c: c.where("rank = 1")) == [["e1"], ["e2", "e3"]] and ask(lambda c: c.where("pair = 0")) == [["e1"], ["e4", "e5"]]
    assert ask(lambda c: c.withColumn("steps", F.array(F.lit("made up")))) == [["e1"], ["e4", "e5"]]
    wrong = {r["chain"]: r["problem"] for r in killchain.validated(found.where("pair = 0"), pairs, found).collect()}
    assert wrong == {0: "count", 1: "count"}
    edges = spark.createDataFrame([("u", "v", "X", "e1"), ("v", "w", "X", "k"), ("p", "q", "X", "no")], "src_uid string, dst_uid string, rtype string, event_id string")
    chain = spark.createDataFrame([("s", 0, "k")], "scope string, chain int, event_id string")
    nodes = spark.createDataFrame([(x,) for x in "uvwpq"], "uid string")
    marked, touched = killchain.write_back(edges, nodes, chain, found.where("pair = 0"))
    assert {r["event_id"] for r in marked.where("killchain IS NOT NULL").collect()} == {"e1", "k"} and {r["uid"] for r in touched.where("killchain IS NOT NULL").collect()} == {"u", "v", "w"}


def test_incidents_span_hosts_and_midnight(spark):
    h = 3600.0
    rows = [("H:a", "IP:b", 23 * h, "1"), ("H:a", "IP:x", 27 * h, "2"), ("H:b", "IP:y", 28 * h, "3"), ("H:b", "IP:y", 60 * h, "4"), ("H:c", "IP:a", 90 * h, "5")]
    found = spark.createDataFrame(rows, "src_uid string, dst_uid string, ts_float double, event_id string").withColumn("is_alarm", F.lit(True))
    own = spark.createDataFrame([("IP:a", "H:a"), ("IP:b", "H:b")], "ip_uid string, host_uid string")
    scope = {r["event_id"]: r["scope"] for r in graph.incidents(found, own).collect()}
    assert scope["1"] == scope["2"] == scope["3"] and len({scope[x] for x in "1345"}) == 3
    links = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(30)] + [("x", "y")], "a string, b string")
    assert {r["node"]: r["root"] for r in graph.components(links).collect()} == {f"{i:02d}": "00" for i in range(31)} | {"x": "x", "y": "x"}


def test_edges_are_projected_once_for_all_searches(spark, monkeypatch):
    """Incidents and searches read what is stored of the edges; wider searches share one pool."""
    from sentrylake import registry
    from sentrylake.operators import tables

    stored, cut = [], tables.cut
    for module in (tables, graph, killchain):
        monkeypatch.setattr(module, "cut", lambda df, name: (stored.append((name, df.inputFiles())), cut(df, name))[1])
    registry.QUERIES["killchain_paths"](spark, "/root/testdata/sf0.001")
    assert [n for n, _ in stored].count("pool") == 1
    assert [n for n, files in stored if any("events.parquet" in f for f in files)] == ["edges"]


def test_kill_chain_query_over_the_events(spark):
    """Every chain that is left holds: its events are edges, and lone segments have none."""
    from sentrylake import registry

    out = registry.QUERIES["killchain_paths"](spark, "/root/testdata/sf0.001").collect()
    known = {r["event_id"] for r in registry.QUERIES["graph_edges"](spark, "/root/testdata/sf0.001").select("event_id").distinct().collect()}
    assert out and all(set(r["events"]) <= known and (r["n_pairs"] > 0 or not r["events"]) for r in out)
    chains = registry.QUERIES["fsa_chains"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in sorted(chains, key=lambda r: r["seq"]):
        by.setdefault((r["scope"], r["chain"]), []).append(r)
    for rows in by.values():
        states = [r["state"] for r in rows]
        assert states[-1] in fsa.ACCEPT and all(fsa.Policy().allows(a, b) for a, b in zip(states, states[1:])) and [r["ts_float"] for r in rows] == sorted(r["ts_float"] for r in rows)


# --- reads and jobs


def test_reads_and_jobs(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, "event", "hostlog.auth"), ("b", None, "alert", "x"), ("c", 3, "event", "netflow.flow")], "event_id string, ts_us long, kind string, dataset string")
    rows, total = analysis.page(d, [F.col("event_id")], 1, 1)
    assert [r["event_id"] for r in rows.collect()] == ["b"] and total == 3
    q = {"bool": {"filter": [{"term": {"a": 1}}, {"bool": {"must": {"range": {"t": {"gte": 2}}}}}]}}
    assert analysis.first_clause(q, "range") == {"t": {"gte": 2}} and analysis.first_clause(q, "term") == {"a": 1} and analysis.first_clause(q, "ids") is None
    good, bad = (lambda s: d), (lambda s: s.read.parquet(f"file://{tmp_path}/none"))
    out, told, status = analysis.routes(spark, {"one": good, "two": bad})
    assert out.count() == 3 and status == "partial" and told["one"] == "ok" and "PATH_NOT_FOUND" in told["two"] and analysis.routes(spark, {"two": bad})[2] == "failed"
    analysis.write_split(d, f"file://{tmp_path}/split")
    assert spark.read.json(f"file://{tmp_path}/split/normal").count() == 2 and spark.read.json(f"file://{tmp_path}/split/abnormal").count() == 1
    assert {r["event_id"] for r in analysis.recent(d, 300_000_002).collect()} == {"b", "c"}
    none = d.where("false").withColumn("provider", F.lit("x"))
    late = spark.createDataFrame([("a", 5), ("b", 1), ("b", 1), ("c", None), ("d", 9)], "event_id string, ts_us long")
    held = spark.createDataFrame([("d", 9), ("x", 3_600_000_000)], "event_id string, ts_us long")  # a newer one is stored: what comes late is taken all the same
    assert sorted(r["event_id"] for r in analysis.unseen(late, held).collect()) == ["a", "b", "c"] and sorted(r["event_id"] for r in analysis.unseen(late, held, 4).collect()) == ["a", "c"]
    many = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"), F.lit("event").alias("kind"), F.col("id").alias("ingested_us"))
    assert analysis.ingested_window(many, "event", 0, 30_000, limit=15_000).count() == 15_000
    assert tables.read_or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0
    rules = spark.createDataFrame([("r1", 1), ("r2", 2)], "name string, level int")
    once = analysis.registered(rules, spark.createDataFrame([("r2", 5), ("r3", 3)], "name string, level int"))
    assert sorted(map(tuple, once.collect())) == [("r1", 1), ("r2", 5), ("r3", 3)] == sorted(map(tuple, analysis.registered(once, once).collect()))
    log, task = [], "trace-" + "0" * 36
    assert analysis.analysis_task(task, 1, 2, {"n": d.count}, lambda *x: log.append(x)) == {"n": 3} and [x[1] for x in log] == ["running", "done"]
    with pytest.raises(ZeroDivisionError):
        analysis.analysis_task(task, 1, 2, {"n": lambda: 1 / 0}, lambda *x: log.append(x))
    assert log[-1][1] == "failed" and "division" in log[-1][2]
    for args in ((task, 3, 2), ("trace-1", 1, 2)):
        with pytest.raises(ValueError):
            analysis.analysis_task(*args, {}, print)


def test_correlation_before_merge(spark):
    """A privileged start, a connection to another host and a privileged start there become one finding with its evidence."""
    t, rows = 1_700_000_000_000_000, []
    for i, (host, ip, action, cat, src, dst) in enumerate([("a", "10.0.0.1", "process_start", "process", None, None), ("a", "10.0.0.1", "conn", "network", "10.0.0.1", "10.0.0.2"), ("b", "10.0.0.2", "process_start", "process", "10.0.0.2", None)]):
        rows.append((f"e{i}", t + i, host, f"h-{host}", ip, action, [cat], "sudo x" if cat == "process" else None, src, dst, "outbound", "u"))
    events = spark.createDataFrame(rows, "event_id string, ts_us long, host_name string, host_id string, host_ip string, action string, category array<string>, command_line string, src_ip string, dst_ip string, direction string, user_name string")
    raw = flat(spark, [("r", t, "T1021", "TA0008", "h-a", None, None, None, None, "falco", 10, 0.5)])
    out = analysis.correlated_then_merged(events, raw.withColumn("evidence_ids", F.array("event_id"))).collect()
    assert len(out) == 1 and out[0]["n_merged"] == 2 and out[0]["providers"] == ["correlation_rules", "falco"] and set(out[0]["evidence_ids"]) == {"r", "e0", "e1", "e2"} and out[0]["severity"] == 50


def test_tags_of_matched_rules_and_answers(spark):
    doc = {"@timestamp": "2024-01-01T00:00:00Z", "event": {"id": "e", "kind": "alert", "dataset": "finding.raw.falco"}, "host": {"name": "h"}, "anomaly": {"matched_rules": [{"name": "r"}, {"tags": ["attack.t1059", "attack.execution"]}]}, "dns": {"answers": [{"data": "1.1.1.1"}, {"ip": "2.2.2.2"}], "resolved_ip": "3.3.3.3"}}
    r = normalize.normalized(spark.createDataFrame([(json.dumps(doc),)], "value string")).first()
    assert (r["tactic_id"], r["technique_id"], r["dns_answers"]) == ("TA0002", "T1059", ["1.1.1.1", "2.2.2.2", "3.3.3.3"])


def test_wider_searches(spark):
    """Pairs that the anchors don't join: by two more hops, from another node of the segment, or by semantic anchors."""
    chain = [("s", 0, 1.0, i, f"e{i}", st, float(i * 10), a, b, r, "x") for i, (st, a, b, r) in enumerate([("Initial Access", "Host:h", "Process:p", "RUNS_ON"), ("Initial Access", "User:u", "Host:q", "LOGON"), ("Execution", "Process:far", "Process:r", "SPAWN")])]
    rows = spark.createDataFrame(chain, "scope string, chain int, score double, seq int, event_id string, state string, ts_float double, src_uid string, dst_uid string, rtype string, action string")
    pairs = killchain.segment_pairs(rows)
    edges = lambda *e: spark.createDataFrame([(a, b, f"x{i}", 5.0 + i) for i, (a, b) in enumerate(e)], "src_uid string, dst_uid string, event_id string, ts_float double")
    best = lambda found: sorted((r["hops"], r["path"][0]) for r in killchain.staged_paths(found, rows, pairs).collect())
    assert best(edges(("Host:q", "m"), ("m", "Process:far"))) == [(2, "Host:q")]
    long = ["Host:q", *[f"n{i}" for i in range(8)], "Process:far"]
    assert best(edges(*zip(long, long[1:]))) == [(9, "Host:q")]
    assert best(edges(("Process:p", "Process:far"))) == [(1, "Process:p")]
    assert best(edges(("Process:p", "none"))) == []
    order = [(r["src_uid"], r["dst_uid"], r["order"]) for r in killchain.semantic_anchors(rows, pairs).orderBy("order").collect()]
    assert order == [("Process:p", "Process:far", 1)]
    body = json.loads(killchain.payload(pairs, killchain.staged_paths(edges(("Host:q", "Process:far")), rows, pairs)).first()["payload"])
    assert body[0]["candidates"][0]["steps"] == ["x0"]


# --- filters and similarity


def test_filters(spark):
    d = spark.createDataFrame([("1", "x", ["a"], 5), ("2", None, [], None), ("3", "xy", ["a", "b"], 9)], "event_id string, s string, l array<string>, n int")
    run = lambda q: [r["event_id"] for r in d.where(reports.filter_of(q, frozenset({"l"}))).orderBy("event_id").collect()]
    assert run({"match_all": {}}) == ["1", "2", "3"] and run({"match_none": {}}) == []
    assert run({"term": {"l": "b"}}) == ["3"] and run({"terms": {"s": ["x", "q"]}}) == ["1"] and run({"range": {"n": {"gt": 5}}}) == ["3"] and run({"exists": {"field": "l"}}) == ["1", "3"]
    assert run({"bool": {"must_not": [{"term": {"s": "x"}}]}}) == ["2", "3"] and run({"bool": {"should": [{"term": {"s": "x"}}, {"prefix": {"s": "xy"}}]}}) == ["1", "3"] and run({"ids": {"values": ["2"]}}) == ["2"] and run({"wildcard": {"s": "x?"}}) == ["3"]
    with pytest.raises(ValueError):
        run({"script": {}})


def test_similarity_ranking(spark):
    uses = spark.createDataFrame([("G1", "T1001"), ("G1", "T1002"), ("G2", "T1002"), ("G3", "T1003")], "group_id string, technique_id string")
    tactics = spark.createDataFrame([("G1", "TA1"), ("G2", "TA2")], "group_id string, tactic_id string")
    out = ttp.ranked(spark.createDataFrame([("T1001",), ("T1002",), ("T9999",)], "technique_id string"), spark.createDataFrame([("TA1",)], "tactic_id string"), uses, tactics).collect()
    assert [r["group_id"] for r in out] == ["G1", "G2"] and out[0]["score"] == pytest.approx(1.0)
    idf = lambda df: math.log(4 / (df + 1)) + 1
    assert out[1]["score"] == pytest.approx(0.5 * idf(2) / math.hypot(idf(1), idf(2)))


def test_empty_inputs(spark):
    none = flat(spark, [])
    assert findings.canonical(none).count() == 0
    e = edge_frame(spark).where("false")
    assert graph.shortest_costs(e, "a").count() == 1 and graph.temporal_paths(e, spark.createDataFrame([("a",)], "uid string"), 2, 0.0, 1.0).count() == 0


def test_scratch_can_be_dropped(spark):
    assert tables.cut(spark.range(3), "t").count() == 3
    tables.drop_scratch(spark)
    assert tables.cut(spark.range(2), "t").count() == 2
