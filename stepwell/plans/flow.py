"""Flows: one binding of parameters to a graph of tasks, or several by name."""

from __future__ import annotations

import contextvars
from typing import Any

from stepwell.operators.concat import concat_iter
from stepwell.operators.grid import params_generator_multiple, params_generator_single
from stepwell.plans import graph, lint, records, runner
from stepwell.plans.ident import flatten
from stepwell.plans.params import ParameterError
from stepwell.plans.runner import MultiRunResult, RunResult
from stepwell.plans.task import Task, TaskData, traversal
from stepwell.settings import settings

#: Flows attached to the one that is running, by name; tasks see them as self.flows.
attached: contextvars.ContextVar[dict] = contextvars.ContextVar("attached", default={})


def _subclasses(cls: type) -> list[type]:
    return [x for c in cls.__subclasses__() for x in (c, *_subclasses(c))]


class Workflow:
    """A default task, parameters and a place for outputs."""

    def __init__(self, task: type[Task] | None = None, params: dict | None = None, path: str | None = None, env: str | None = None):
        self.params = dict(params or {})
        path = self.params.pop("path", path)
        self.default_task, self.env = task, env
        self.path = f"{path or settings.dirpath}/env={env}" if env else path
        self.attached: dict[str, Workflow] = {}
        self._roots: dict[type[Task], None] = {}

    # -- tasks

    def set_default(self, task: type[Task]) -> None:
        self.default_task = task

    def get_task(self, task: Any = None) -> Task:
        """An instance with the flow's parameters."""
        task = task or self.default_task
        if task is None:
            raise RuntimeError("no task is given and the flow has no default")
        return task if isinstance(task, Task) else task.bind(self.params, self.path)

    def _tasks(self, tasks: Any) -> list[Task]:
        return [self.get_task(t) for t in (flatten(tasks) or [None])]

    def attach_flow(self, flow: Workflow, flow_name: str) -> None:
        self.attached[flow_name] = flow

    # -- running

    def run(self, tasks: Any = None, forced: Any = None, forced_all: bool = False, forced_all_upstream: bool = False, confirm: bool = False, workers: int | None = None, abort: bool = True, execution_summary: bool | None = None, flow_name: str | None = None) -> RunResult:
        todo = self._tasks(tasks)
        self._roots |= dict.fromkeys(type(t) for t in todo)
        token = attached.set(self.attached)
        try:
            return runner.run(todo, forced, forced_all, forced_all_upstream, confirm, abort, execution_summary, workers, flow=flow_name)
        finally:
            attached.reset(token)

    def preview(self, tasks: Any = None, indent: str = "", last: bool = True, show_params: bool = True, clip_params: bool = False, print_it: bool = True) -> str:
        """The tree of tasks with their states, and inputs that are declared but not used."""
        with traversal():
            todo = self._tasks(tasks)
            parts = [graph.tree(t, show_params, clip_params) for t in todo]
            unused = lint.unused(todo)
        text = "\n".join(indent + line for part in parts for line in part.split("\n"))
        if unused:
            text += "\n\nUNUSED INPUTS\n" + "\n".join(f"  {f.message}" for f in unused)
        if print_it:
            print(text)
        return text

    def complete(self, task: Any = None, cascade: bool = True) -> bool:
        with traversal():
            return self.get_task(task).complete(cascade)

    # -- outputs

    def output(self, task: Any = None) -> Any:
        return self.get_task(task).output()

    def outputPath(self, task: Any = None) -> Any:
        out = self.output(task)
        return {k: t.path for k, t in out.items()} if isinstance(out, dict) else out.path

    def outputLoad(self, task: Any = None, keys: Any = None, as_dict: bool = False, cached: bool = False) -> Any:
        return self.get_task(task).outputLoad(keys=keys, as_dict=as_dict, cached=cached)

    def outputLoadAll(self, task: Any = None, keys: Any = None, as_dict: bool = False, cached: bool = False, by: str = "family") -> dict[str, Any]:
        """Outputs of a task and all above it, by family (instances of one family overwrite each other) or by task_id."""
        tasks = [t for t in graph.traverse(self.get_task(task)) if isinstance(t, TaskData)]
        return {t.task_id if by == "task_id" else t.task_family: t.outputLoad(keys=keys, as_dict=as_dict, cached=cached) for t in reversed(tasks)}

    def outputLoadMeta(self, task: Any = None) -> Any:
        return self.get_task(task).outputLoadMeta()

    def outputLoadMetaJson(self, task: Any = None) -> Any:
        return self.get_task(task).outputLoadMetaJson()

    # -- resetting

    def reset(self, task: Any = None, confirm: bool = False) -> bool:
        return self.get_task(task).reset(confirm)

    def reset_upstream(self, task: Any = None, confirm: bool = False, only: Any = None) -> bool:
        """Delete the outputs of a task and all above it, or of the families in ``only``."""
        return _invalidate(graph.traverse(self.get_task(task)), confirm, only)

    def reset_downstream(self, task: Any, task_downstream: Any = None, confirm: bool = False) -> bool:
        """Delete the complete outputs between one or more families and the default (or given) task."""
        root = self.get_task(task_downstream)
        band = {t: None for family in flatten(task) for t in graph.find_deps(root, family)}
        return _invalidate([t for t in band if t.complete(cascade=False)], confirm)

    # -- graph

    def dependents(self, task: Any, root: Any = None, paths: bool = False) -> list:
        """What between the root and a family depends on it, the family included; or the paths to it."""
        return (graph.find_paths if paths else graph.find_deps)(self.get_task(root), task)

    def dependencies(self, task: Any = None, target: Any = None, paths: bool = False) -> list:
        """What a task needs, or what of it leads to a target family."""
        t = self.get_task(task)
        if target is None:
            return graph.upstream(t)
        return (graph.find_paths if paths else graph.find_deps)(t, target)

    # -- code

    def check_inputs(self, tasks: Any = None, raise_on_unused: bool = False, include_clean: bool = False, print_it: bool = True) -> list:
        found = lint.check([c for t in self._tasks(tasks) for c in dict.fromkeys(type(x) for x in graph.traverse(t))])
        shown = [f for f in found if include_clean or f.verdict != "clean"]
        if print_it:
            print("\n".join(f.message for f in shown))
        if raise_on_unused and any(f.verdict == "unused" for f in found):
            raise ValueError("; ".join(f.message for f in found if f.verdict == "unused"))
        return shown

    def accept_code(self, task: Any = None) -> dict[str, list[str]]:
        """Keep outputs although code has changed: of a task instance and all above it, of a class or list of classes
        where they stand in this flow, or (without a task) of all that the flow knows or can bind."""
        if isinstance(task, Task):
            todo = graph.post_order(task)
        else:
            classes = [c for c in flatten(task) if isinstance(c, type)]
            roots = [c for c in dict.fromkeys([self.default_task, *self._roots, *([] if classes else _subclasses(TaskData))]) if c]
            todo = {}
            for c in [*roots, *classes]:
                try:
                    todo |= dict.fromkeys(graph.post_order(self.get_task(c)))
                except (ParameterError, ValueError, TypeError):
                    continue
            todo = [t for t in todo if not classes or type(t) in classes]
        with traversal():
            result = records.accept(list(todo))
        print(f"accepted {len(result['accepted'])}, in order {len(result['skipped'])}, without output {len(result['unverified'])}")
        return result


def _invalidate(tasks: list[Task], confirm: bool, only: Any = None) -> bool:
    wanted = tuple(flatten(only))
    chosen = [t for t in tasks if hasattr(t, "stem") and not t.external and (not wanted or isinstance(t, wanted))]
    if confirm and input(f"Delete the outputs of {len(chosen)} tasks? (y/n) ").strip().lower() != "y":
        return False
    for t in chosen:
        t.invalidate()
    return True


class WorkflowMulti:
    """Workflows by name. params: a dict of dicts, a list of dicts (numbered), or a dict of lists (all combinations)."""

    def __init__(self, task: type[Task] | None = None, params: Any = None, path: str | None = None, env: str | None = None):
        if not params:
            raise Exception("parameters for at least one flow are needed")
        if isinstance(params, dict) and isinstance(next(iter(params.values())), list):
            params = params_generator_single(params) if len(params) == 1 else params_generator_multiple(params)
        elif isinstance(params, list):
            params = dict(enumerate(params))
        self.params, self.default_task = params, task
        self.workflow_objs = {name: Workflow(task, p, path, env) for name, p in params.items()}

    def get_flow(self, flow: Any) -> Workflow:
        return self.workflow_objs[flow]

    def _each(self, method: str, flow: Any, *args: Any, **kwargs: Any) -> Any:
        if flow is not None:
            return getattr(self.get_flow(flow), method)(*args, **kwargs)
        return {name: getattr(f, method)(*args, **kwargs) for name, f in self.workflow_objs.items()}

    def run(self, tasks: Any = None, flow: Any = None, **options: Any) -> Any:
        """One flow's RunResult, or all flows one after another."""
        if flow is not None:
            return self.get_flow(flow).run(tasks, flow_name=str(flow), **options)
        return MultiRunResult({name: f.run(tasks, flow_name=str(name), **options) for name, f in self.workflow_objs.items()})

    def preview(self, tasks: Any = None, flow: Any = None, **options: Any) -> Any:
        return self._each("preview", flow, tasks, **options)

    def output(self, task: Any = None, flow: Any = None) -> Any:
        return self._each("output", flow, task)

    def outputPath(self, task: Any = None, flow: Any = None) -> Any:
        return self._each("outputPath", flow, task)

    def outputLoad(self, task: Any = None, flow: Any = None, keys: Any = None, as_dict: bool = False, cached: bool = False) -> Any:
        return self._each("outputLoad", flow, task, keys=keys, as_dict=as_dict, cached=cached)

    def outputLoadAll(self, task: Any = None, flow: Any = None, **options: Any) -> Any:
        return self._each("outputLoadAll", flow, task, **options)

    def outputLoadMeta(self, task: Any = None, flow: Any = None) -> Any:
        return self._each("outputLoadMeta", flow, task)

    def outputLoadMetaJson(self, task: Any = None, flow: Any = None) -> Any:
        return self._each("outputLoadMetaJson", flow, task)

    def outputLoadConcat(self, task: Any = None, keys: Any = None, as_dict: bool = False, cached: bool = False, concat_fn: Any = None, tagkeys: list[str] | None = None) -> Any:
        """One task's outputs over all flows, stacked, with the flows' parameters as columns."""
        items = [(name, self.params[name], f.outputLoad(task, keys, as_dict, cached)) for name, f in self.workflow_objs.items()]
        return concat_iter(items, concat_fn=concat_fn, keys=tagkeys)

    def _confirmed(self, confirm: bool) -> bool:
        return not confirm or input(f"Delete outputs in {len(self.workflow_objs)} flows? (y/n) ").strip().lower() == "y"

    def reset(self, task: Any = None, flow: Any = None, confirm: bool = False) -> Any:
        if flow is not None:
            return self.get_flow(flow).reset(task, confirm)
        return {f.reset(task) for f in self.workflow_objs.values()} if self._confirmed(confirm) else {False}

    def reset_upstream(self, task: Any = None, flow: Any = None, confirm: bool = False, only: Any = None) -> Any:
        if flow is not None:
            return self.get_flow(flow).reset_upstream(task, confirm, only)
        return {f.reset_upstream(task, only=only) for f in self.workflow_objs.values()} if self._confirmed(confirm) else {False}

    def reset_downstream(self, task: Any, task_downstream: Any = None, flow: Any = None, confirm: bool = False) -> Any:
        if flow is not None:
            return self.get_flow(flow).reset_downstream(task, task_downstream, confirm)
        return {f.reset_downstream(task, task_downstream) for f in self.workflow_objs.values()} if self._confirmed(confirm) else {False}

    def dependents(self, task: Any, root: Any = None, flow: Any = None, paths: bool = False) -> Any:
        return self._each("dependents", flow, task, root, paths)

    def dependencies(self, task: Any = None, target: Any = None, flow: Any = None, paths: bool = False) -> Any:
        return self._each("dependencies", flow, task, target, paths)

    def check_inputs(self, tasks: Any = None, flow: Any = None, **options: Any) -> list:
        """Code is the same in all flows, so the first stands for them."""
        return self.get_flow(next(iter(self.workflow_objs)) if flow is None else flow).check_inputs(tasks, **options)

    def accept_code(self, task: Any = None, flow: Any = None) -> Any:
        return self._each("accept_code", flow, task)

    def set_default(self, task: type[Task]) -> None:
        self.default_task = task
        for f in self.workflow_objs.values():
            f.set_default(task)

    def get_task(self, task: Any = None, flow: Any = None) -> Any:
        return self._each("get_task", flow, task)


# ------------------------------------------------------------------------------------------- calls without flows


def taskflow_upstream(task: Task, only_complete: bool = False) -> list[Task]:
    return [t for t in graph.traverse(task) if not only_complete or t.complete(cascade=False)]


def taskflow_downstream(task: Task, task_downstream: Task, only_complete: bool = False) -> list[Task]:
    return [t for t in graph.find_deps(task_downstream, task) if not only_complete or t.complete(cascade=False)]


def invalidate_upstream(task: Task, confirm: bool = False, only: Any = None) -> bool:
    return _invalidate(graph.traverse(task), confirm, only)


def invalidate_downstream(task: Any, task_downstream: Task, confirm: bool = False) -> bool:
    band = {t: None for family in flatten(task) for t in graph.find_deps(task_downstream, family)}
    return _invalidate([t for t in band if t.complete(cascade=False)], confirm)


def orphans(root: str | None = None, known: list[Task] | None = None) -> list[str]:
    """Paths under a data directory that belong to none of the known tasks."""
    from stepwell.sources import files

    base = str(root or settings.dirpath)
    mine = {t.path.rsplit("/", 1)[-1] for k in known or [] for t in flatten(k.output()) if hasattr(t, "path")}
    return [f"{base}/{d}/{n}" for d in files.names(base) if not d.startswith((".", "_")) for n in files.names(f"{base}/{d}") if n not in mine and "-meta." not in n and not n.startswith(("_", "."))]


def show(task: Task, **options: Any) -> None:
    print(graph.tree(task, **options))


def preview(tasks: Any, **options: Any) -> str:
    return Workflow().preview(tasks, **options)


def runLoad(task: Any, params: dict | None = None, path: str | None = None, reset: bool = False, load: bool = True, keys: Any = None, **options: Any) -> Any:
    """Run one task with parameters and load its output."""
    flow = Workflow(task if isinstance(task, type) else None, params, path)
    if reset:
        flow.reset(task)
    flow.run(task, **options)
    return flow.outputLoad(task, keys) if load else flow


runIt = runLoad


def runIterConcat(task: type[Task], params: Any, load: bool = True, taskLoad: Any = None, reset: bool = False, path: str | None = None, **options: Any) -> Any:
    """Run a task for several sets of parameters and stack its outputs."""
    flow = WorkflowMulti(task, params, path)
    if reset:
        flow.reset(task)
    flow.run(**options)
    return flow.outputLoadConcat(taskLoad or task) if load else flow
