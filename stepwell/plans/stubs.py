"""Export of flows as stubs without code, and import of such stubs: other projects read outputs without the steps."""

from __future__ import annotations

import datetime
import importlib.util
import sys
from pathlib import Path
from typing import Any

from stepwell.plans import graph, params
from stepwell.plans.flow import Workflow, WorkflowMulti
from stepwell.plans.task import Task, TaskData
from stepwell.settings import settings

HEAD = '"""Stubs of tasks: they load what the tasks made elsewhere and never run."""\n\nimport datetime\nimport enum\n\nimport stepwell\nfrom stepwell import *  # noqa: F403\n'


class dotdict(dict):
    """A dict whose entries are attributes too; an attribute that isn't there raises."""

    def __getattr__(self, name: str) -> Any:
        if name not in self:
            raise AttributeError(f"no task is called {name!r}")
        return self[name]

    def __setattr__(self, name: str, value: Any) -> None:
        self[name] = value

    def __delattr__(self, name: str) -> None:
        if name not in self:
            raise AttributeError(f"no task is called {name!r}")
        del self[name]


def _parameter(p: params.Parameter, value: Any) -> tuple[str, type | None]:
    """The declaration of a parameter with its value as default, and the enum class it needs."""
    significant = "" if p.significant else ", significant=False"
    if isinstance(p, params.EnumParameter):
        return f"stepwell.EnumParameter(default={p.enum.__name__}[{value.name!r}], enum={p.enum.__name__}{significant})", p.enum
    if not _plain(value):
        return f"stepwell.Parameter(default={p.serialize(value)!r}{significant})", None
    if isinstance(p, params.ChoiceParameter) and _plain(p.choices):
        return f"stepwell.ChoiceParameter(default={value!r}, choices={p.choices!r}{significant})", None
    known = next((c.__name__ for c in type(p).__mro__ if c.__module__ == params.__name__ and not issubclass(c, params.ChoiceParameter)), "Parameter")
    return f"stepwell.{known}(default={value!r}{significant})", None


def _plain(value: Any) -> bool:
    """Whether repr gives Python that makes the value again, with nothing but datetime imported."""
    try:
        return bool(eval(repr(value), {"datetime": datetime, "__builtins__": {}}) == value)
    except Exception:
        return False


class FlowExport:
    """The tasks of flows or tasks, each family once, the roots last."""

    def __init__(self, tasks: Any = None, flows: Any = None, save: bool = False, path_export: str = "tasks_export.py"):
        roots: list[Task] = []
        for f in [flows] if isinstance(flows, (Workflow, WorkflowMulti)) else list(flows or []):
            roots += [f.get_task()] if isinstance(f, Workflow) else list(f.get_task().values())
        for t in [tasks] if isinstance(tasks, (Task, type)) else list(tasks or []):
            roots.append(t() if isinstance(t, type) else t)
        found: dict[str, Task] = {}
        for root in roots:
            for t in graph.post_order(root):
                if isinstance(t, TaskData) and getattr(t, "export", True):
                    found.setdefault(t.task_family, t)
        self.tasks, self.save, self.path_export = list(found.values()), save, path_export

    def generate(self) -> str:
        """The source of the stubs; written to path_export if save was asked for."""
        parts: list[str] = [HEAD]
        enums: list[type] = []
        for t in self.tasks:
            base = next(c.__name__ for c in type(t).__mro__ if c.__module__ == TaskData.__module__)
            lines = [f"class {t.task_family}(stepwell.{base}):", "    external = True", f"    persists = {t.output_names!r}"]
            for name in ("target_dir", "task_group", "save_attrib", "keep_versions", "code_version"):
                if getattr(t, name) != getattr(TaskData, name):
                    lines.append(f"    {name} = {getattr(t, name)!r}")
            for name, p in t.get_params():
                declared, needed = _parameter(p, t.param_values[name])
                lines.append(f"    {name} = {declared}")
                if needed and needed not in enums:
                    enums.append(needed)
                    members = [f"    {m.name} = {m.value if _plain(m.value) and not isinstance(m.value, str) else str(m.value)!r}" for m in needed]
                    parts.insert(1, "\n".join([f"class {needed.__name__}(enum.Enum):", *members]) + "\n")
            parts.append("\n".join(lines) + "\n")
        text = "\n\n".join(parts)
        if self.save:
            Path(self.path_export).write_text(text)
        return text


class FlowImport:
    """The task classes of a stub module, as attributes; outputs are looked for under path."""

    def __init__(self, module_path: str, path: str | None = None):
        self.path = path or settings.dirpath
        name = f"stepwell_stubs_{Path(module_path).stem}"
        spec = importlib.util.spec_from_file_location(name, module_path)
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        spec.loader.exec_module(module)
        self.tasks = dotdict({n: c for n, c in vars(module).items() if isinstance(c, type) and issubclass(c, TaskData) and c.__module__ == name})

    def __getattr__(self, name: str) -> Any:
        tasks = self.__dict__.get("tasks", {})
        if name in tasks:
            return tasks[name]
        raise AttributeError(name)

    def flow(self, task: Any, params: dict | None = None) -> Workflow:
        return Workflow(task, params, self.path)
