from __future__ import annotations

import json

from sentrylake.operators import findings
from sentrylake.operators.normalize import normalized
from sentrylake.sources import readers
from sentrylake.streaming import ingest


def line(i, kind="event", **event):
    return json.dumps({"@timestamp": f"2024-01-01T00:{i:02d}:00Z", "event": {"id": f"e{i}", "kind": kind, "dataset": "hostlog.auth" if kind == "event" else "falco", **event}, "host": {"name": "h"}, "user": {"name": "u", "id": "7"}, "tags": ["attack.t1110"]})


def test_stream_equals_batch(spark, tmp_path):
    """In one batch or in one for each file, whose rows are hours late, the tables come out alike."""
    src = tmp_path / "in"
    src.mkdir()
    alert = lambda i, at, who, sev: json.dumps({"@timestamp": at, "event": {"id": f"a{i}", "kind": "alert", "dataset": who, "severity": sev, "category": ["network"]}, "host": {"name": "h"}, "destination": {"ip": "10.0.0.9"}, "tags": ["attack.t1021"]})
    (src / "a.jsonl").write_text("\n".join([line(1), line(2, "alert"), line(1), "{broken", alert(1, "2024-01-01T09:00:10Z", "falco", 40)]))
    (src / "b.jsonl").write_text("\n".join([line(3, "alert"), line(2, "alert"), line(4), alert(2, "2024-01-01T09:00:20Z", "suricata", 90)]))
    (src / "c.jsonl").write_text("\n".join([line(5).replace("2024-01-01T00", "2023-12-31T20"), line(4), alert(3, "2024-01-01T09:00:30Z", "falco", 10)]))
    found = {}
    for files in (10, 1):
        out = f"file://{tmp_path}/out{files}"
        q = ingest.run(readers.lines(spark, f"file://{src}", stream=True, files_per_trigger=files), out, f"file://{tmp_path}/ck{files}")
        q.await_termination(240)
        ticks = ingest.ticks(q.rows)
        assert sum(t["lines"] for t in ticks) == 12 and sum(t["dropped"] for t in ticks) == 1 and sum(t["bytes"] for t in ticks) > 1000
        now = ingest.current(spark, out)
        found[files] = {n: sorted(str(r) for r in df.select(sorted(c for c in df.columns if c != "ingested")).collect()) for n, df in now.items()}
        assert sorted(r["event_id"] for r in now["events"].collect()) == ["e1", "e4", "e5"] and sorted(r["event_id"] for r in now["raw_findings"].collect()) == ["a1", "a2", "a3", "e2", "e3"]
        merged = {r["event_id"]: r for r in now["canonical_findings"].collect()}
        assert merged["a2"]["n_merged"] == 3 and merged["a2"]["providers"] == ["falco", "suricata"] and merged["a2"]["evidence_ids"] == ["a1", "a2", "a3"] and "a1" not in merged
        assert [(r["event_id"], r["dst_uid"]) for r in now["edges"].where("is_alarm AND rtype = 'NET_CONNECT'").collect()] == [("a2", "IP:ip=10.0.0.9")]
    assert found[10] == found[1]
    batch = ingest.flat(normalized(readers.lines(spark, f"file://{src}")).where("drop_reason IS NULL")).dropDuplicates(["event_id"])
    want = sorted(r["fingerprint"] for r in findings.canonical(batch.where("kind = 'alert'")).collect())
    assert sorted(r["fingerprint"] for r in now["canonical_findings"].collect()) == want


def test_state_over_batches_and_a_restart(spark, tmp_path):
    """Findings merge in state across batches and a restart from the checkpoint; repeats count once; all fields of the winner come along."""
    src, out = tmp_path / "f", f"file://{tmp_path}/out"
    src.mkdir()

    def alert(i, second, who, sev):
        return json.dumps({"@timestamp": f"2024-01-01T09:00:{second:02d}Z", "event": {"id": f"a{i}", "kind": "alert", "dataset": who, "severity": sev, "category": ["network"]}, "host": {"name": "h"}, "destination": {"ip": "10.0.0.9"}, "tags": ["attack.t1021"]})

    def job():
        q = ingest.run(readers.lines(spark, f"file://{src}", stream=True), out, f"file://{tmp_path}/ck")
        q.await_termination(240)
        return {r["event_id"]: r for r in ingest.current(spark, out)["canonical_findings"].collect()}

    (src / "a.jsonl").write_text("\n".join([alert(1, 10, "falco", 40), alert(1, 10, "falco", 40)]))
    first = job()
    assert first["a1"]["n_merged"] == 1 and first["a1"]["evidence_ids"] == ["a1"] and first["a1"]["host_name"] == "h" and first["a1"]["technique_id"] == "T1021" and first["a1"]["dst_ip"] == "10.0.0.9"
    (src / "b.jsonl").write_text("\n".join([alert(2, 20, "suricata", 90), alert(1, 10, "falco", 40)]))
    (src / "c.jsonl").write_text(alert(3, 30, "falco", 10))
    second = job()
    assert set(second) == {"a2"} and (second["a2"]["n_merged"], second["a2"]["severity"], second["a2"]["providers"], second["a2"]["evidence_ids"]) == (3, 90, ["falco", "suricata"], ["a1", "a2", "a3"])
    assert abs(second["a2"]["confidence"] - 0.7) < 1e-9
    assert sum(ingest.compact(spark, out, 1).values()) > 0 and [r["dst_uid"] for r in ingest.current(spark, out)["edges"].where("rtype = 'NET_CONNECT'").collect()] == ["IP:ip=10.0.0.9"]
    assert sorted(r["event_id"] for r in ingest.tables(spark, out)["raw_findings"].lookup(["a1", "a3", "zz"]).collect()) == ["a1", "a3"]
