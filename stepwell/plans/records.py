"""Records of what was made from which code and inputs, and the policy that reads them.

A record lies in one JSON file a data directory (one writer at a time). A task without a record, or with one of another
layout or Python version, counts as up to date and gets a new record the next time it is seen.
"""

from __future__ import annotations

import contextlib
import json
import os
import secrets
import sys
import time
import warnings
from collections.abc import Iterable, Iterator
from typing import Any

from stepwell.plans import codeid
from stepwell.plans.ident import flatten, short_md5
from stepwell.settings import settings
from stepwell.sources import files, history

LAYOUT = 3
PYTHON = f"{sys.version_info[0]}.{sys.version_info[1]}"
FILE = ".stepwell-code-status.json"
_stores: dict[str, dict[str, dict]] = {}
_dirty: set[str] = set()
_written: dict[str, float] = {}
_held = False


class StalenessWarning(UserWarning):
    """An output is kept although its code may have changed."""


# ----------------------------------------------------------------------------------------------------- store


def _path(root: str) -> str:
    return f"{root}/{FILE}"


def _store(root: str) -> dict[str, dict]:
    if root not in _stores:
        _stores[root] = json.loads(files.read_bytes(_path(root))) if files.exists(_path(root)) else {}
    return _stores[root]


def get(task: Any) -> dict | None:
    return _store(task.root()).get(task.task_id)


def put(task: Any, record: dict) -> None:
    """Keep a record. During a run the file is written at most once a second and at the end."""
    root = task.root()
    _store(root)[task.task_id] = record
    _dirty.add(root)
    if not _held or time.time() - _written.get(root, 0.0) > 1.0:
        flush(root)


def flush(root: str | None = None) -> None:
    for r in [root] if root else list(_dirty):
        files.write_bytes(_path(r), json.dumps(_stores[r], indent=1, sort_keys=True).encode())
        _written[r] = time.time()
        _dirty.discard(r)


@contextlib.contextmanager
def held() -> Iterator[None]:
    """Gather records while a run goes on."""
    global _held
    before, _held = _held, True
    try:
        yield
    finally:
        _held = before
        if not _held:
            flush()


def all_records(root: str | None = None) -> dict[str, dict]:
    return dict(_store(str(root or settings.dirpath)))


def clear_cache() -> None:
    """Forget what was read, so that the files are read again."""
    flush()
    _stores.clear()


def records_frame(spark: Any, root: str | None = None) -> Any:
    """All records of a data directory as a frame."""
    names = ("task_id", "family", "code_version", "fingerprint", "output_id", "dep_state", "duration_s", "ts")
    rows = [(k, *[r.get(n) if n != "duration_s" else float(r.get(n) or 0) for n in names[1:]]) for k, r in all_records(root).items()]
    return spark.createDataFrame(rows, "task_id string, family string, code_version string, fingerprint string, output_id string, dep_state string, duration_s double, ts double")


# ---------------------------------------------------------------------------------------------------- status


def dep_state(task: Any) -> str:
    """Changes whenever something the task needs was made anew."""
    ids = []
    for d in task.deps():
        for t in _with_records(d):
            ids.append((get(t) or {}).get("output_id", ""))
    return short_md5("|".join(sorted(ids)))


def _with_records(task: Any) -> list:
    return [task] if hasattr(task, "root") else [t for d in task.deps() for t in _with_records(d)]


def make(task: Any, output_id: str | None = None, duration: float = 0.0) -> dict:
    return {
        "v": LAYOUT,
        "py": PYTHON,
        "family": task.task_family,
        "fingerprint": task.fingerprint(),
        "code_version": None if task.code_version is None else str(task.code_version),
        "source_hashes": codeid.current(type(task)),
        "output_id": output_id or secrets.token_hex(8),
        "dep_state": dep_state(task),
        "duration_s": round(duration, 3),
        "ts": time.time(),
    }


def _readable(record: dict | None) -> bool:
    return bool(record) and record.get("v") == LAYOUT and record.get("py") == PYTHON


def code_ok(task: Any) -> bool:
    record = get(task)
    if not _readable(record) or task.fingerprint() is None:
        return True
    return own_code_ok(task, record) and record["dep_state"] == dep_state(task)


def own_code_ok(task: Any, record: dict) -> bool:
    same = record["source_hashes"] == codeid.current(type(task))
    if task.code_version is not None:
        # A pin decides alone; taking up a pin without touching the code is free.
        return record["code_version"] == str(task.code_version) or record["code_version"] is None and settings.code_version_auto and same
    if not settings.code_version_auto:
        return True  # code isn't followed here
    # A pin that was taken off leaves the hashes it was made with. An expensive output is kept, whatever made it.
    return same or bool(settings.expensive_seconds) and (record["duration_s"] or 0) > settings.expensive_seconds


def changed_symbols(task: Any, record: dict) -> list[str]:
    old, new = record["source_hashes"], codeid.current(type(task))
    return sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))


def reason_for(task: Any) -> str:
    """Why a task that isn't complete has to run."""
    if not all(t.exists() for t in flatten(task.output())):
        return "output missing"
    record = get(task) if hasattr(task, "root") else None
    if _readable(record) and not own_code_ok(task, record):
        old, new = record["code_version"], None if task.code_version is None else str(task.code_version)
        if old != new:
            return f"code change ({old or 'auto'} -> {new or 'auto'})"
        changed = changed_symbols(task, record)
        return f"code change (auto: {', '.join(changed[:3])}{'...' if len(changed) > 3 else ''})"
    return "upstream rerun"


_said: set[str] = set()


def warn(task: Any, message: str, changed: Iterable[str] = ()) -> None:
    """An event each time, a warning once a process for each message; never stops a run."""
    files_changed = sorted({k.partition("::")[0] for k in changed})
    version = None if task.code_version is None else str(task.code_version)
    history.append("code_warning", task_id=task.task_id, family=task.task_family, message=message, changed_files=files_changed, code_version=version)
    if message in _said:
        return
    _said.add(message)
    try:
        warnings.warn(message, StalenessWarning, stacklevel=2)
    except StalenessWarning:
        pass


def advise(task: Any) -> list[str]:
    """For a complete task: give it a record if it has none that can be read, take over a new pin or mode, and say what
    is kept although its code has changed. Returns warnings."""
    if not hasattr(task, "root") or task.external or task.fingerprint() is None:
        return []
    record = get(task)
    if not _readable(record):
        if source_is_newer(task):
            message = f"{task!r}: its source is newer than its output, which has no record yet; it is kept"
            warn(task, message, [os.path.basename(codeid.source_of(type(task)) or "")])
            put(task, make(task, (record or {}).get("output_id")))
            return [message]
        put(task, make(task, (record or {}).get("output_id")))
        return []
    same = record["source_hashes"] == codeid.current(type(task))
    pin = None if task.code_version is None else str(task.code_version)
    if record["code_version"] != pin and same:
        put(task, make(task, record["output_id"], record["duration_s"]))
        return []
    if same:
        return []
    why = f"code_version {pin} is pinned" if pin is not None else f"it took {record['duration_s']:.0f} s"
    message = f"{task!r}: code has changed ({', '.join(changed_symbols(task, record)[:3])}), the output is kept as {why}"
    warn(task, message, changed_symbols(task, record))
    return [message]


def source_is_newer(task: Any) -> bool:
    path = codeid.source_of(type(task))
    outputs = [t for t in flatten(task.output()) if hasattr(t, "read")]
    if not path or not outputs:
        return False
    return os.path.getmtime(path) > max(files.modified(t.path) for t in outputs)


def accept(tasks: list) -> dict[str, list[str]]:
    """Take the present code as that of the present outputs, without running: new records with the old output ids, from
    the bottom up. Returns the ids accepted, those that were in order, and those without an output."""
    out: dict[str, list[str]] = {"accepted": [], "skipped": [], "unverified": []}
    for t in tasks:
        if not hasattr(t, "root") or t.external:
            continue
        record = get(t)
        if not all(x.exists() for x in flatten(t.output())):
            out["unverified"].append(t.task_id)
        elif _readable(record) and record["source_hashes"] == codeid.current(type(t)) and record["dep_state"] == dep_state(t) and record["code_version"] == (None if t.code_version is None else str(t.code_version)):
            out["skipped"].append(t.task_id)
        else:
            put(t, make(t, (record or {}).get("output_id"), (record or {}).get("duration_s", 0.0)))
            history.append("code_accepted", task_id=t.task_id, family=t.task_family)
            out["accepted"].append(t.task_id)
    return out
