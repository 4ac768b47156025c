"""Functions as steps: decorate functions that take the task, and run them as a flow."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from stepwell.plans import runner
from stepwell.plans.flow import Workflow as Flow
from stepwell.plans.ident import flatten, mapped
from stepwell.plans.params import Parameter
from stepwell.plans.task import TaskData, requires
from stepwell.settings import settings
from stepwell.sources import files


class Workflow:
    """A registry of steps. Decorators apply to one function, ``task`` nearest to it."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.steps: dict[str, type[TaskData]] = {}
        self.used: list[dict] = []
        self.multi: dict[Any, dict] | None = None
        self.common: dict[str, Any] = {}

    def _step(self, func: Any) -> type[TaskData]:
        if isinstance(func, type):
            return func
        return self.steps[func if isinstance(func, str) else func.__name__]

    # -- declaring

    def task(self, task_type: type[TaskData]) -> Callable:
        if TaskData not in task_type.__bases__ and task_type is not TaskData:
            raise TypeError("task: a task class of one format is needed")

        def made(func: Callable) -> Callable:
            body = {"run": func, "__module__": func.__module__, "__qualname__": func.__qualname__, "__doc__": func.__doc__}
            cls = type(task_type)(func.__name__, (task_type,), body | {n: Parameter(v) for n, v in self.common.items()})
            self.steps[func.__name__] = cls
            return func

        return made

    def requires(self, *funcs: Any) -> Callable:
        def made(func: Callable) -> Callable:
            needed = [mapped(f, self._step) for f in funcs]
            requires(*needed)(self._step(func))
            return func

        return made

    def params(self, **params: Any) -> Callable:
        def made(func: Callable) -> Callable:
            for name, value in params.items():
                setattr(self._step(func), name, value if isinstance(value, Parameter) else Parameter(value))
            return func

        return made

    def persists(self, names: list[str]) -> Callable:
        def made(func: Callable) -> Callable:
            self._step(func).persists = list(names)
            return func

        return made

    def add_global_params(self, **params: Any) -> None:
        """A parameter on every step, those declared later too."""
        self.common |= params
        for cls in self.steps.values():
            for name, value in params.items():
                setattr(cls, name, value if isinstance(value, Parameter) else Parameter(value))

    # -- running

    def _flow(self, params: dict | None = None) -> Flow:
        return Flow(None, params, self.path)

    def _note(self, params: dict | None) -> None:
        if (params or {}) not in self.used:
            self.used.append(dict(params or {}))

    def preview(self, func: Any, params: dict | None = None) -> str:
        sets = [params] if params is not None else self.used or [{}]
        return "\n".join(self._flow(p).preview(self._step(func)) for p in sets)

    def run(self, funcs: Any, params: dict | None = None, multi_params: dict | None = None, **options: Any) -> Any:
        steps = [self._step(f) for f in flatten(funcs)]
        if multi_params is None:
            self.multi = None
            self._note(params)
            return self._flow(params).run(steps, **options)
        self.multi = multi_params
        for p in multi_params.values():
            self._note(p)
        return runner.MultiRunResult({name: self._flow(p).run(steps, flow_name=str(name), **options) for name, p in multi_params.items()})

    def _sets(self, params: dict | None) -> dict | None:
        return self.multi if params is None and self.multi else None

    def outputLoad(self, func: Any, params: dict | None = None, **options: Any) -> Any:
        many = self._sets(params)
        if many:
            return {name: self._flow(p).outputLoad(self._step(func), **options) for name, p in many.items()}
        return self._flow(params if params is not None else (self.used or [{}])[-1]).outputLoad(self._step(func), **options)

    def outputLoadAll(self, func: Any, params: dict | None = None, **options: Any) -> Any:
        many = self._sets(params)
        if many:
            return {name: self._flow(p).outputLoadAll(self._step(func), **options) for name, p in many.items()}
        return self._flow(params if params is not None else (self.used or [{}])[-1]).outputLoadAll(self._step(func), **options)

    # -- resetting

    def reset(self, func: Any, params: dict | None = None) -> None:
        for p in [params] if params is not None else self.used or [{}]:
            self._flow(p).reset(self._step(func))

    def resetAll(self) -> None:
        for name in self.steps:
            self.reset(name)

    def delete(self, func: Any) -> None:
        """Remove all that lies in the directory of a step."""
        cls = self._step(func)
        files.delete(f"{self.path or settings.dirpath}/{cls.target_dir or cls.__name__}")

    def deleteAll(self) -> None:
        for name in self.steps:
            self.delete(name)
