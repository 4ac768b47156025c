"""Runs: work out what is missing or stale, make it in order, and say what was done and why."""

from __future__ import annotations

import functools
import inspect
import subprocess
import time
import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from stepwell.plans import codeid, graph, records
from stepwell.plans.ident import flatten, mapped
from stepwell.plans.task import Task, outputs_changed, traversal
from stepwell.settings import settings
from stepwell.sources import files, history

TRACEBACK = 4096


def _is_of(task: Task, cls: Any) -> bool:
    """Whether a task is one of a class, or of a subclass; a name stands for the family alone."""
    return isinstance(task, cls) if isinstance(cls, type) else task.task_family == graph.family_of(cls)


@dataclass
class TaskFailure:
    task: Task
    reason: str
    exception: BaseException | None = None

    def __str__(self) -> str:
        return f"{self.task!r}: {self.reason}" + (f": {self.exception}" if self.exception else "")


@dataclass
class RunResult:
    """What a run did. True if nothing failed."""

    run_id: str = ""
    ran: list[Task] = field(default_factory=list)
    complete: list[Task] = field(default_factory=list)
    failed: list[TaskFailure] = field(default_factory=list)
    reasons: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return not self.failed

    scheduling_succeeded = success

    def __bool__(self) -> bool:
        return self.success

    @property
    def first_exception(self) -> BaseException | None:
        return next((f.exception for f in self.failed if f.exception), None)

    def did_run(self, cls: Any) -> bool:
        return bool(self.ran_of(cls))

    def ran_of(self, cls: Any) -> list[Task]:
        return [t for t in self.ran if _is_of(t, cls)]

    def failure_of(self, cls: Any) -> TaskFailure | None:
        return next((f for f in self.failed if _is_of(f.task, cls)), None)

    def summary(self) -> str:
        """What was scheduled, met, made and failed, as text."""
        return str(self)

    def __str__(self) -> str:
        n = len(self.ran) + len(self.complete) + len(self.failed)
        lines = [f"Scheduled {n} tasks of which:"]
        for title, items in (
            ("complete ones were encountered", [repr(t) for t in self.complete]),
            ("ran successfully", [f"{t!r}: {self.reasons.get(t.task_id, '')}" for t in self.ran]),
            ("failed", [str(f) for f in self.failed]),
        ):
            lines.append(f"* {len(items)} {title}" + ":" * bool(items))
            shown = items[:10] if items and title.startswith("complete") else items  # what was there already is only counted on
            lines += [f"    - {x}" for x in shown]
            if len(shown) < len(items):
                lines.append(f"    ... and {len(items) - len(shown)} more")
        lines.append("This progress looks :) because there were no failed tasks or missing dependencies" if self.success else "This progress looks :( because there were failed tasks")
        return "\n".join(lines)

    def to_df(self, spark: Any) -> DataFrame:
        """(task_id, family, state, reason), a row for each task met."""
        rows = [(t.task_id, t.task_family, "ran", self.reasons.get(t.task_id)) for t in self.ran]
        rows += [(t.task_id, t.task_family, "complete", None) for t in self.complete]
        rows += [(f.task.task_id, f.task.task_family, "failed", f.reason) for f in self.failed]
        return spark.createDataFrame(rows, "task_id string, family string, state string, reason string")


class MultiRunResult(dict):
    """RunResults by flow, with merged views."""

    @property
    def success(self) -> bool:
        return all(self.values())

    def __bool__(self) -> bool:
        return self.success

    def _merged(self, name: str) -> list:
        return list(dict.fromkeys(x for r in self.values() for x in getattr(r, name)))

    @property
    def ran(self) -> list[Task]:
        return self._merged("ran")

    @property
    def complete(self) -> list[Task]:
        return self._merged("complete")

    @property
    def failed(self) -> list[TaskFailure]:
        return [f for r in self.values() for f in r.failed]

    @property
    def reasons(self) -> dict[str, str]:
        return {k: v for r in reversed(self.values()) for k, v in r.reasons.items()}

    @property
    def warnings(self) -> list[str]:
        return self._merged("warnings")

    def summary(self) -> str:
        return str(self)

    def __str__(self) -> str:
        return "\n".join(f"== {k} ==\n{r}" for k, r in self.items())


@functools.lru_cache(maxsize=1)
def _git_at(when: int) -> tuple[str | None, bool | None]:
    def git(*args: str) -> str:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD"), bool(git("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return None, None


def git_info() -> tuple[str | None, bool | None]:
    """(commit, whether files are changed), asked at most every ten seconds."""
    return _git_at(int(time.time() // 10))


class _Run:
    def __init__(self) -> None:
        self.result = RunResult(run_id=uuid.uuid4().hex)
        self.state: dict[Task, bool] = {}
        self.active: list[Task] = []
        self.advised: set[Task] = set()

    def visit(self, task: Task) -> bool:
        """Make a task and what it needs; True if it is complete afterwards."""
        if task in self.state:
            return self.state[task]
        if task in self.active:
            raise ValueError(f"{task!r} needs itself: {' -> '.join(t.task_family for t in [*self.active[self.active.index(task) :], task])}")
        self.active.append(task)
        try:
            done = self._make(task)
        finally:
            self.active.pop()
        self.state[task] = done
        return done

    def _fail(self, task: Task, reason: str, e: BaseException | None = None) -> bool:
        self.result.failed.append(TaskFailure(task, reason, e))
        trace = "".join(traceback.format_exception(e))[-TRACEBACK:] if e else None
        history.append("task_failed", task_id=task.task_id, family=task.task_family, reason=reason, error=str(e) if e else reason, traceback=trace)
        return False

    def _make(self, task: Task) -> bool:
        r = self.result
        if task.is_complete():
            for t in graph.post_order(task):  # what lies above is complete too, and its records are kept up as well
                if t not in self.advised:
                    self.advised.add(t)
                    r.warnings += records.advise(t)
            r.complete.append(task)
            return True
        if not all([self.visit(d) for d in task.deps()]):  # siblings of what failed are still made
            return self._fail(task, "dependency failed")
        if task.external:
            return self._fail(task, "external missing output")
        if not flatten(task.output()):  # a group: its members are done
            with_run = type(task).run is not Task.run
            if not with_run:
                r.complete.append(task)
                return True
        return self._booked(task, records.reason_for(task), *self._step(task))

    def _step(self, task: Task) -> tuple[bool, float, BaseException | None]:
        """Run a task all of whose dependencies are there: whether they were, the seconds it took, what went wrong."""
        began = time.time()
        try:
            if not self._run(task):
                return False, 0.0, None
            if missing := [getattr(t, "path", t) for t in flatten(task.output()) if not t.exists()]:
                raise RuntimeError(f"run() left outputs missing: {missing}")
        except Exception as e:
            return True, 0.0, e
        return True, time.time() - began, None

    def _booked(self, task: Task, reason: str, fed: bool, duration: float, error: BaseException | None) -> bool:
        """Note how a step went."""
        if not fed:
            return self._fail(task, "dependency failed")
        if error is not None:
            return self._fail(task, "run error", error)
        r = self.result
        outputs_changed()
        record: dict = {}
        if hasattr(task, "root"):
            record = records.make(task, duration=duration)
            records.put(task, record)
        r.ran.append(task)
        r.reasons[task.task_id] = reason
        sha, dirty = git_info()
        history.append(
            "task_ran", task_id=task.task_id, family=task.task_family, params=task.to_str_params(), reason=reason, duration_s=duration,
            code_version=record.get("code_version"), fingerprint=record.get("fingerprint"), git_sha=sha, git_dirty=dirty,
        )
        return True

    def _run(self, task: Task) -> bool:
        """run(), which may be a generator that yields tasks and gets their targets back."""
        got = task.run()
        if not inspect.isgenerator(got):
            return True
        try:
            wanted = next(got)
            while True:
                if not all([self.visit(t) for t in flatten(wanted)]):
                    got.close()
                    return False
                wanted = got.send(mapped(wanted, lambda t: t.output()))
        except StopIteration:
            return True


    def ahead(self, roots: list[Task], workers: int) -> None:
        """Make what doesn't need anything missing, some steps at a time, wave after wave. Steps start their jobs from threads of their own, so that jobs of one wave share the cluster; all that is
        decided or noted is done here. What remains (steps that yield tasks, groups, failures) is left to visit()."""
        try:
            todo = list(dict.fromkeys(t for root in roots for t in graph.post_order(root)))
        except ValueError:
            return  # visit() says which cycle it is
        todo = [t for t in todo if not t.is_complete()]
        undone = set(todo)
        with ThreadPoolExecutor(workers, "stepwell-step") as pool:
            while True:
                ready = [t for t in todo if t not in self.state and _is_plain(t) and all(self.state.get(d, d not in undone) for d in t.deps())]
                if not ready:
                    return
                reasons = [records.reason_for(t) for t in ready]
                if len(ready) == 1:
                    steps = iter([self._step(ready[0])])
                else:
                    started = [pool.submit(inheritable_thread_target(files.active())(self._step), t) for t in ready]
                    steps = (x.result() for x in started)
                for t, reason, step in zip(ready, reasons, steps, strict=True):
                    self.state[t] = self._booked(t, reason, *step)


def _is_plain(task: Task) -> bool:
    return not task.external and not inspect.isgeneratorfunction(type(task).run) and bool(flatten(task.output()))


def build(tasks: Any, flow: str | None = None, workers: int | None = None) -> RunResult:
    """Make tasks, what they need first; each at most once. workers: independent steps made at a time (1: one after
    another; None: as many as settings.workers says)."""
    todo = flatten(tasks)
    run = _Run()
    history.set_context(run_id=run.result.run_id, flow=flow)
    history.append("run_started", roots=[t.task_id for t in todo])
    codeid.freeze()
    try:
        with traversal(), records.held():
            if (workers or settings.workers) > 1:
                run.ahead(todo, workers or settings.workers)
            for t in todo:
                run.visit(t)
    finally:
        codeid.unfreeze()
        r = run.result
        history.append("run_finished", success=r.success, n_ran=len(r.ran), n_complete=len(r.complete), n_failed=len(r.failed))
        history.set_context(run_id=None, flow=None)
        if r.ran or r.failed:
            history.flush()
    return run.result


def run(
    tasks: Any, forced: Any = None, forced_all: bool = False, forced_all_upstream: bool = False, confirm: bool = False, abort: bool = True,
    execution_summary: bool | None = None, workers: int | None = None, flow: str | None = None,
) -> RunResult:
    """Build tasks. forced: families remade, with all between them and the roots; forced_all: the roots; forced_all_upstream:
    everything. abort: raise where something failed. workers: see build()."""
    roots = flatten(tasks)
    doomed: dict[Task, None] = {}
    for root in roots:
        if forced_all_upstream:
            doomed |= dict.fromkeys(graph.traverse(root))
        if forced_all:
            doomed[root] = None
        for family in flatten(forced):
            doomed |= {t: None for t in graph.find_deps(root, family) if t.complete(cascade=False)}
    if doomed and confirm and input(f"Delete the outputs of {len(doomed)} tasks? (y/n) ").strip().lower() != "y":
        doomed = {}
    for t in doomed:
        if hasattr(t, "stem") and not t.external:
            t.invalidate()
    result = build(roots, flow, workers)
    if settings.execution_summary if execution_summary is None else execution_summary:
        from stepwell.plans.log import _logger

        _logger.info("%s", result)
    if abort and not result:
        causes = [f for f in result.failed if f.reason != "dependency failed"] or result.failed
        shown = "; ".join(map(str, causes[:3]))
        raise RuntimeError(f"{len(result.failed)} tasks failed: {shown}{' ...' if len(causes) > 3 else ''}") from result.first_exception
    return result
