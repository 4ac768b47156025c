"""The run history: append-only events, one file of JSON lines a run, in a folder a month.

A file is never changed once it is written (a file source or a stream never rereads one), so a month's folder is what
rotation would give. Questions about it are DataFrame queries. Writing never stops a run.
"""

from __future__ import annotations

import atexit
import datetime
import getpass
import json
import logging
import os
import platform
import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwell.settings import located, settings
from stepwell.sources import files

SCHEMA = (
    "id string, ts string, type string, v int, project_id string, machine string, user string, run_id string, flow string, "
    "task_id string, family string, reason string, message string, level string, duration_s double, error string, "
    "traceback string, code_version string, fingerprint string, success boolean, n_ran int, n_complete int, n_failed int, git_sha string, git_dirty boolean, "
    "params map<string,string>, extra map<string,string>, roots array<string>, changed_files array<string>"
)
_lock = threading.Lock()
_waiting: list[dict] = []
_context: dict[str, str | None] = {"run_id": None, "flow": None}


def set_context(**values: str | None) -> None:
    _context.update(values)


def identity() -> dict[str, str]:
    try:
        user = getpass.getuser()
    except Exception:
        user = ""
    return {"project_id": os.path.basename(os.getcwd()), "machine": platform.node(), "user": user}


def append(type: str, **payload: Any) -> None:
    """Note an event. The envelope wins over equal names in the payload."""
    if not settings.events:
        return
    envelope = {"id": uuid.uuid4().hex, "ts": datetime.datetime.now(datetime.timezone.utc).isoformat(), "type": type, "v": 1} | identity() | _context
    with _lock:
        _waiting.append(payload | envelope)
        full = len(_waiting) >= 1000
    if full:
        flush()


def flush() -> bool:
    """Write what waits as one new file. False if it couldn't be written; it is tried again later."""
    global _waiting
    with _lock:
        taken, _waiting = _waiting, []
    if not taken:
        return True
    months: dict[str, list[dict]] = {}
    for e in taken:
        months.setdefault(e["ts"][:7].replace("-", ""), []).append(e)
    try:
        for month, events in months.items():
            path = f"{settings.events_dir}/events-{month}/{events[0]['ts'].replace(':', '')}-{events[0]['id'][:8]}.jsonl"
            files.write_bytes(path, "".join(json.dumps(e, default=str) + "\n" for e in events).encode())
        return True
    except Exception:
        with _lock:
            _waiting = taken + _waiting
        logging.getLogger("stepwell").warning("%d events of the run history can't be written yet; they are kept", len(_waiting))
        return False


def _at_exit() -> None:
    if _waiting and SparkSession.getActiveSession() is not None:
        flush()


atexit.register(_at_exit)


def events(spark: SparkSession | None = None, type: str | None = None) -> DataFrame:
    """All events; lines that can't be read are dropped."""
    flush()
    spark = spark or files.active()
    if not files.names(settings.events_dir):
        df = spark.createDataFrame([], SCHEMA)
    else:
        df = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(located(f"{settings.events_dir}/events-*/*.jsonl")).where("id is not null")
    return df.where(F.col("type") == type) if type else df


iter_events = events


def runs(df: DataFrame | None = None, family: str | None = None, flow: str | None = None, limit: int | None = 20) -> DataFrame:
    """Steps that ran or failed, newest first."""
    df = (events() if df is None else df).where("type in ('task_ran', 'task_failed')")
    for column, value in (("family", family), ("flow", flow)):
        if value is not None:
            df = df.where(F.col(column) == value)
    df = df.orderBy(F.desc("ts"), F.desc("id"))
    return df if limit is None else df.limit(limit)


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def warnings(df: DataFrame | None = None) -> DataFrame:
    """The latest warning of each task that nothing later has cleared: a run of the task, its acceptance, or the
    acceptance of any task of its family."""
    df = events() if df is None else df
    last = latest(df.where("type = 'code_warning'"), "task_id", [F.desc("ts"), F.desc("id")])
    for key, types in (("task_id", ["task_ran", "code_accepted"]), ("family", ["code_accepted"])):
        clears = df.where(F.col("type").isin(types) & (F.col(key).cast("string") != "")).groupBy(key).agg(F.max("ts").alias("cleared")).alias("c")
        last = last.alias("w").join(clears, (F.col(f"w.{key}") == F.col(f"c.{key}")) & (F.col("c.cleared") > F.col("w.ts")), "left_anti")
    return last


def status(df: DataFrame | None = None) -> dict[str, DataFrame]:
    """pending warnings, the latest run of each family (a failed one too), and the last ten failures."""
    df = events() if df is None else df
    return {
        "pending": warnings(df),
        "latest": latest(df.where("type in ('task_ran', 'task_failed') and family <> ''"), "family", [F.desc("ts"), F.desc("id")]),
        "failures": df.where("type = 'task_failed'").orderBy(F.desc("ts"), F.desc("id")).limit(10),
    }


def print_status(df: DataFrame | None = None) -> str:
    """The status as text; short by nature, so it is collected."""
    got = status(df)
    took = F.when(F.col("duration_s").isNotNull(), F.concat(F.format_number("duration_s", 2), F.lit("s"))).otherwise("")
    outcome = F.when(F.col("type") == "task_failed", "FAILED").otherwise(F.coalesce("reason", F.lit("ran")))
    changed = F.concat(F.lit("changed "), F.coalesce(F.array_join("changed_files", ", "), F.lit("?")))
    columns = {
        "pending": ["family", "code_version", changed.alias("changed"), "message"],
        "latest": ["family", F.substring("ts", 1, 16).alias("at"), outcome.alias("outcome"), took.alias("took")],
        "failures": ["family", F.substring("ts", 1, 16).alias("at"), "error"],
    }
    lines = []
    for title, shown in columns.items():
        rows = got[title].select(*shown).limit(50).collect()
        rows = sorted(rows, key=lambda r: r["family"] or "") if title == "latest" else rows
        lines += [f"{title} ({len(rows)})", *["  " + "  ".join(str(x) for x in r) for r in rows]]
    print("\n".join(lines))
    return "\n".join(lines)
