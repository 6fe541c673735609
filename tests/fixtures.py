"""Random and hand-written events for brute-force comparison."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from tracemill.schema import EVENT_SCHEMA

START = datetime(2026, 3, 8, 1, 0, 0)


def event(id, seconds, *, case="C1", evidence="EV-0001", source="system", **kw):
    meta = kw.pop("metadata", {})
    row = dict(
        id=id, event_uid=f"EVT-{id:06d}", case_id=case, evidence_id=evidence, row_index=id,
        timestamp=None if seconds is None else START + timedelta(seconds=seconds), tz_note=None,
        source_type=source, event_type=kw.pop("event_type", ""), user=None, host=None, source_ip=None,
        destination_ip=None, process=None, file_path=None, action=None, severity=None, metadata=meta,
        dedupe_hash=None, duplicate_of=None,
    )
    row.update(kw)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT_SCHEMA) for r in rows], EVENT_SCHEMA)


def random_events(seed, n=160, span=1500, step=20):
    """Few hosts, users and addresses, many equal instants, some blanks: worst case for ties and hot keys."""
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(1, 10 * n), n):
        source = rng.choice(["authentication", "process", "file_activity", "network", "browser", "system"])
        kw = dict(
            source=source, case=rng.choice(["C1", "C1", "C1", "C2"]), evidence=rng.choice(["EV-0001", "EV-0002"]),
            user=rng.choice(["u1", "u1", "u2", "u3", None, ""]), host=rng.choice(["h1", "h1", "h2", "h3", None, ""]),
            source_ip=rng.choice(["8.8.8.8", "10.0.0.1", "9.9.9.9", None, ""]),
            severity=rng.choice(["Low", "Medium", "High", "Critical", None]),
        )
        if source == "authentication":
            kw.update(event_type="login", action="login", metadata={"status": rng.choice(["failed", "failed", "success", "x"])})
        if source == "process":
            kw.update(process=rng.choice(["cmd.exe", "PowerShell.exe", "explorer.exe", "", None]), action="start",
                      metadata={"command_line": rng.choice(["run", "x -nop -enc", ""])})
        if source == "file_activity":
            kw.update(file_path=rng.choice(["/a", "/b", "/c", None]), action=rng.choice(["write", "Rename", "open", "delete"]))
        if source == "network":
            kw.update(destination_ip=rng.choice(["93.184.216.34", "10.9.9.9", None]), action="connect")
        rows.append(event(i, rng.randrange(0, span, step), **kw))
    return rows
