"""Tasks: named, parameterised steps with stored outputs, and how they declare what they need.

A task instance is a value: it is memoised by class, parameters and data path, and nothing is written to it afterwards.
What a task needs is declared by decorators that add entries to its class's ``spec``; parameters are derived from the
whole stack of entries, so the order of decorators doesn't matter.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import pickle
import threading
import warnings
from collections.abc import Callable, Iterator
from typing import Any

from stepwell.plans.ident import flatten, mapped, short_md5, task_id
from stepwell.plans.params import DuplicateParameterError, MissingParameterError, Parameter, UnknownParameterError
from stepwell.settings import settings
from stepwell.sources import files, targets

RESERVED = ("path", "flows", "cls", "derive")

# ----------------------------------------------------------------------------------------------- traversals


class Traversal(threading.local):
    """What a walk over the graph has found out. Completeness is volatile: it goes when an output changes; resolved
    dependencies and code fingerprints stay for the walk."""

    def __init__(self) -> None:
        self.depth = 0
        self.volatile: dict = {}
        self.structural: dict = {}
        self.changes = 0
        self.executed = {"complete": 0, "requires": 0, "fingerprint": 0}


_walk = Traversal()


@contextlib.contextmanager
def traversal() -> Iterator[None]:
    """Share answers between all questions asked inside; nested walks share the outermost one's."""
    from stepwell.plans import codeid

    if not _walk.depth:
        _walk.volatile.clear()
        _walk.structural.clear()
        _walk.executed = dict.fromkeys(_walk.executed, 0)
    _walk.depth += 1
    froze = codeid.freeze()
    try:
        yield
    finally:
        if froze:
            codeid.unfreeze()
        _walk.depth -= 1
        if not _walk.depth:
            _walk.volatile.clear()
            _walk.structural.clear()


def traversal_stats() -> dict[str, int]:
    """Executions (not answers from memory) of the last or running traversal."""
    return dict(_walk.executed)


def outputs_changed() -> None:
    _walk.changes += 1
    _walk.volatile.clear()


def _once(kind: str, memory: dict, key: Any, ask: Callable[[], Any]) -> Any:
    if not _walk.depth:
        _walk.executed[kind] += 1
        return ask()
    if key in memory:
        return memory[key]
    _walk.executed[kind] += 1
    before = _walk.changes
    answer = ask()
    if memory is _walk.structural or before == _walk.changes:
        memory[key] = answer
    return answer


# --------------------------------------------------------------------------------------------------- classes


class Register(type):
    """Metaclass: checks parameter names, and gives one instance for each class, set of values and path."""

    instances: dict = {}

    def __init__(cls, name: str, bases: tuple, body: dict):
        super().__init__(name, bases, body)
        for reserved in RESERVED:
            if isinstance(body.get(reserved), Parameter):
                raise ValueError(f"{name}.{reserved}: this name is reserved")
        cls.spec = []  # entries of requires decorators on this very class
        cls.injected = set()  # names of parameters that came from dependencies
        if "requires" not in body and any(b.__dict__.get("spec") for b in cls.__mro__[1:]):
            inherited = next(b for b in cls.__mro__[1:] if b.__dict__.get("spec"))
            cls.spec, cls.injected = list(inherited.spec), set(inherited.injected)

    def __call__(cls, *args: Any, path: str | None = None, **kwargs: Any) -> Any:
        values = cls.resolve_params(args, kwargs)
        params = dict(cls.get_params())
        try:
            key = (cls, path, tuple((n, params[n].serialize(v)) for n, v in values))
            hash(key)
        except Exception:  # a value that can't be serialised: a fresh instance each time
            return super().__call__(values, path)
        if key not in Register.instances:
            Register.instances[key] = super().__call__(values, path)
        return Register.instances[key]


class Task(metaclass=Register):
    """A named step with parameters. Subclasses define requires(), output() and run(), or use the decorators."""

    code_version: Any = None
    external = False

    def __init__(self, values: list[tuple[str, Any]], path: str | None):
        for name, value in values:
            object.__setattr__(self, name, value)
        object.__setattr__(self, "param_values", dict(values))
        object.__setattr__(self, "path", path)
        object.__setattr__(self, "task_id", task_id(self.task_family, self.to_str_params(only_significant=True)))

    # -- parameters

    @classmethod
    def get_params(cls) -> list[tuple[str, Parameter]]:
        found = [(n, p) for n in dir(cls) if isinstance(p := getattr(cls, n), Parameter)]
        return sorted(found, key=lambda x: x[1].order)

    @classmethod
    def get_param_names(cls, include_insignificant: bool = False) -> list[str]:
        return [n for n, p in cls.get_params() if include_insignificant or p.significant]

    @classmethod
    def resolve_params(cls, args: tuple, kwargs: dict) -> list[tuple[str, Any]]:
        """(name, normalised value) of every parameter, in order of declaration."""
        params = cls.get_params()
        positional = [n for n, p in params if p.positional]
        if len(args) > len(positional):
            raise UnknownParameterError(f"{cls.__name__}: takes at most {len(positional)} positional parameters")
        given = dict(zip(positional, args, strict=False))
        known = dict(params)
        for name, value in kwargs.items():
            if name in given:
                raise DuplicateParameterError(f"{cls.__name__}.{name}: given twice")
            if name not in known:
                raise UnknownParameterError(f"{cls.__name__} has no parameter {name}")
            given[name] = value
        out = []
        for name, param in params:
            if name in given:
                out.append((name, param.normalize(given[name])))
            elif param.has_task_value():
                out.append((name, param.task_value()))
            else:
                raise MissingParameterError(f"{cls.__name__}.{name}: no value and no default")
        return out

    @classmethod
    def bind(cls, params: dict, path: str | None = None) -> Task:
        """An instance from a dict that may hold parameters of other tasks too."""
        known = set(cls.get_param_names(True))
        return cls(path=path, **{k: v for k, v in params.items() if k in known})

    def to_str_params(self, only_significant: bool = False) -> dict[str, str]:
        return {n: p.serialize(self.param_values[n]) for n, p in self.get_params() if p.significant or not only_significant}

    def significant_params(self) -> dict[str, Any]:
        return {n: self.param_values[n] for n in self.get_param_names()}

    def clone(self, cls: type[Task] | None = None, **overrides: Any) -> Task:
        """This task's values for another class (or this one), as far as it has them; overrides win."""
        cls = cls or type(self)
        known = set(cls.get_param_names(True))
        values = {k: v for k, v in self.param_values.items() if k in known} | {k: v for k, v in overrides.items() if k in known}
        return cls(path=self.path, **values)

    # -- identity

    @property
    def task_family(self) -> str:
        return type(self).__name__

    def __repr__(self) -> str:
        shown = self.to_str_params(only_significant=True)
        return f"{self.task_family}({', '.join(f'{k}={v}' for k, v in shown.items())})"

    def __eq__(self, other: Any) -> bool:
        return type(self) is type(other) and self.task_id == other.task_id and self.path == other.path

    def __hash__(self) -> int:
        return hash(self.task_id)

    @property
    def logger(self):
        from stepwell.plans.log import TaskLogger

        return TaskLogger(self)

    # -- dependencies

    def requires(self) -> Any:
        return self._resolved()[0]

    def _resolved(self) -> tuple[Any, dict]:
        """(dependencies, groups) of the spec; groups: group -> {key of dependency: label of branch}."""
        if not type(self).spec:
            return [], {}
        return _once("requires", _walk.structural, ("requires", self, self.path), self._resolve)

    def _resolve(self) -> tuple[Any, dict]:
        entries = type(self).spec
        if len(entries) == 1 and "fixed" in entries[0]:
            return mapped(entries[0]["fixed"], self.clone), {}
        deps: dict[Any, Task] = {}
        groups: dict[Any, dict] = {}

        def put(key: Any, dep: Task) -> None:
            if key in deps:
                raise ValueError(f"{self.task_family}: two dependencies are called {key!r}")
            deps[key] = dep

        for e in entries:
            if "fixed" in e:
                named = e["fixed"] if isinstance(e["fixed"], dict) else {c.__name__: c for c in flatten(e["fixed"])}
                for name, cls in named.items():
                    put(name, self.clone(cls))
                continue
            branches = self.requires_grid(e["cls"], derive=e["derive"], **e["grid"])
            group = e["group"] or e["cls"].__name__
            groups[group] = {}
            for label, dep in branches.items():
                key = f"{e['group']}_{label}" if e["group"] else label
                put(key, dep)
                groups[group][key] = label
        return deps, groups

    def requires_grid(self, cls: type[Task], derive: dict | None = None, **grid: Any) -> dict[Any, Task]:
        """One dependency for each combination of the grid's values. Keys: the value, or name_value pairs for several
        parameters. A value may be a function of this task; derive adds parameters that are functions of the values."""
        derive = derive or {}
        _check_grid(cls, grid, derive)
        names = sorted(grid)
        choices = [grid[n](self) if callable(grid[n]) else grid[n] for n in names]
        for n, values in zip(names, choices, strict=True):
            if isinstance(values, (str, bytes, dict)) or not hasattr(values, "__iter__"):
                raise ValueError(f"{cls.__name__}.{n}: a list of values is needed, not {values!r}")
        out: dict[Any, Task] = {}
        for combination in itertools.product(*map(list, choices)):
            values = dict(zip(names, combination, strict=True))
            key = combination[0] if len(names) == 1 else "_".join(f"{n}_{v}" for n, v in values.items())
            try:
                hash(key)
            except TypeError:
                key = str(key)
            if key in out:
                raise ValueError(f"{cls.__name__}: two branches are called {key!r}")
            out[key] = self.clone(cls, **values, **{n: fn(dict(values)) for n, fn in derive.items()})
        if not out:
            raise ValueError(f"{cls.__name__}: the grid is empty")
        return out

    def deps(self) -> list[Task]:
        return flatten(self.requires())

    def input(self) -> Any:
        return mapped(self.requires(), lambda t: t.output())

    # -- work

    def output(self) -> Any:
        return []

    def run(self) -> Any:
        """Overridden by tasks. A generator may yield tasks; it gets their targets sent back."""

    def complete(self, cascade: bool = True) -> bool:
        outputs = flatten(self.output())
        if not outputs:
            warnings.warn(f"{self!r} has no outputs and no custom complete()", stacklevel=2)
            return False
        return all(t.exists() for t in outputs)

    def is_complete(self) -> bool:
        """complete(), asked once for each task of a traversal."""
        return _once("complete", _walk.volatile, ("complete", self, self.path), self.complete)

    # -- code

    def code_token(self) -> str | None:
        """code_version, or a hash of the code, or None where neither is wanted."""
        from stepwell.plans import codeid

        if self.code_version is not None:
            return str(self.code_version)
        if not settings.code_version_auto:
            return None
        hashed = codeid.token(type(self))
        return hashed and f"auto:{hashed}"

    def fingerprint(self) -> str | None:
        """Hash of the code of this task and all above it; None where nothing is tracked."""
        return _once("fingerprint", _walk.structural, ("fingerprint", self, self.path), self._fingerprint)

    def _fingerprint(self) -> str | None:
        own = self.code_token()
        above = sorted(d.fingerprint() or "" for d in self.deps())
        if own is None and not any(above):
            return None
        return short_md5("|".join([self.task_family, own or "", *above]))


# ------------------------------------------------------------------------------------------------ decorators


def _check_grid(cls: type[Task], grid: dict, derive: dict) -> None:
    known = set(cls.get_param_names(True))
    if not grid:
        raise ValueError(f"{cls.__name__}: nothing to fan out over")
    for n in [*grid, *derive]:
        if n not in known:
            raise ValueError(f"{cls.__name__} has no parameter {n}")
    if both := set(grid) & set(derive):
        raise ValueError(f"{cls.__name__}: fanned out and derived: {sorted(both)}")
    if wrong := [n for n, fn in derive.items() if not callable(fn)]:
        raise ValueError(f"{cls.__name__}: not functions: {wrong}")


def _sources(entry: dict) -> list[type[Task]]:
    return flatten(entry["fixed"]) if "fixed" in entry else [entry["cls"]]


def _add(cls: type[Task], entry: dict) -> type[Task]:
    """Add an entry and derive the parameters anew from all entries: every parameter of a dependency comes over, but for
    those that any entry fans out or derives."""
    if "requires" in cls.__dict__:
        raise TypeError(f"{cls.__name__} has both a requires() of its own and a decorator")
    cls.spec = [entry, *cls.spec]  # decorators apply from the bottom up
    for name in cls.injected:
        if name in cls.__dict__:
            delattr(cls, name)
    cls.injected = set()
    fanned = {n for e in cls.spec if "cls" in e for n in [*e["grid"], *e["derive"]]}
    own = {n for n, v in cls.__dict__.items() if isinstance(v, Parameter)}
    if wrong := own & fanned:
        raise TypeError(f"{cls.__name__} declares parameters that its branches get: {sorted(wrong)}")
    for e in cls.spec:
        for source in _sources(e):
            for name, param in source.get_params():
                if name not in fanned and not isinstance(getattr(cls, name, None), Parameter):
                    setattr(cls, name, param)
                    cls.injected.add(name)
    return cls


class requires:
    """Decorator: this task needs others (classes, a list of them, or a dict of names). Their parameters come over."""

    def __init__(self, *tasks: Any):
        if not tasks:
            raise TypeError("requires: name at least one task")
        self.fixed = tasks[0] if len(tasks) == 1 else list(tasks)

    def __call__(self, cls: type[Task]) -> type[Task]:
        return _add(cls, {"fixed": self.fixed})


class requires_each:
    """Decorator: this task needs a task once for each value of some parameters, or each combination.

    ``requires_each(Leaf, region=['a', 'b'])``; ``requires_each({'regions': Leaf}, ...)`` names the group; ``derive``
    gives parameters of a branch as functions of its values."""

    def __init__(self, task: Any, derive: dict | None = None, **grid: Any):
        group = None
        if isinstance(task, dict):
            if len(task) != 1:
                raise ValueError("requires_each: a group has one name and one task")
            (group, task), *_ = task.items()
        _check_grid(task, grid, derive or {})
        self.entry = {"cls": task, "grid": grid, "derive": derive or {}, "group": group}

    def __call__(self, cls: type[Task]) -> type[Task]:
        return _add(cls, self.entry)


class inherits:
    """Decorator: parameters of other tasks come over, without needing them. Adds clone_parent() and clone_parents()."""

    def __init__(self, *tasks: Any):
        self.tasks = tasks[0] if len(tasks) == 1 else list(tasks)

    def __call__(self, cls: type[Task]) -> type[Task]:
        for source in flatten(self.tasks):
            for name, param in source.get_params():
                if not isinstance(getattr(cls, name, None), Parameter):
                    setattr(cls, name, param)
        parents = self.tasks
        cls.clone_parents = lambda me: mapped(parents, me.clone)
        cls.clone_parent = lambda me: flatten(me.clone_parents())[0]
        return cls


# --------------------------------------------------------------------------------------------- tasks with data


def _chosen(keys: Any, names: list) -> list:
    wanted = list(names) if keys is None else [keys] if isinstance(keys, str) else list(keys)
    if missing := [k for k in wanted if k not in names]:
        raise IndexError(f"no such output: {missing}; there are {list(names)}")
    return wanted


class TaskData(Task):
    """A task with named outputs (``persists``) of one format."""

    persists: Any = ("data",)
    target: type = targets.ParquetTarget
    ext = "parquet"
    target_dir: str | None = None
    task_group: str | None = None
    save_attrib = True
    keep_versions = False
    meta_format = "pickle"

    # -- paths

    @property
    def output_names(self) -> list[str]:
        return [self.persists] if isinstance(self.persists, str) else list(self.persists)

    def root(self) -> str:
        return str(self.path or settings.dirpath)

    def directory(self) -> str:
        parts = [self.root(), *([f"group={self.task_group}"] if self.task_group else []), self.target_dir or self.task_family]
        if self.keep_versions and self.code_version is not None:
            parts.append(f"v{self.code_version}")
        return "/".join(parts)

    def stem(self) -> str:
        return f"{self.directory()}/{self.task_id if self.save_attrib and settings.save_with_param else self.task_family}"

    def target_of(self, name: str) -> Any:
        return self.target(f"{self.stem()}-{name}.{self.ext}")

    def output(self) -> Any:
        names = self.output_names
        return self.target_of("data") if names == ["data"] else {n: self.target_of(n) for n in names}

    def _targets(self) -> dict[str, Any]:
        out = self.output()
        return out if isinstance(out, dict) else {"data": out}

    # -- save and load

    def save(self, data: Any, from_list: bool = False, **options: Any) -> None:
        """One output as it is; several as a dict keyed by their names, or as a list in their order."""
        found = self._targets()
        if len(found) == 1 and not (isinstance(data, dict) and data.keys() == found.keys() and self.output_names != ["data"]):
            parts = {next(iter(found)): data[0] if from_list else data}
        elif from_list:
            if len(data) != len(found):
                raise ValueError(f"{self!r}: {len(found)} outputs are needed, {len(data)} are given")
            parts = dict(zip(found, data, strict=True))
        else:
            if not isinstance(data, dict) or data.keys() != found.keys():
                raise ValueError(f"{self!r}: save needs a dict of {list(found)}")
            parts = data
        for name, part in parts.items():
            found[name].save(part, **options)
        outputs_changed()

    def outputLoad(self, keys: Any = None, as_dict: bool = False, cached: bool = False) -> Any:
        """Own outputs: one, or a list in their order, or a dict. Frames are lazy, so only what is used is read."""
        if not self.complete(cascade=False):
            raise RuntimeError(f"{self!r} isn't complete: run it first")
        found, names = self._targets(), self.output_names
        wanted = _chosen(keys, names)
        data = {n: found[n].load(cached=cached) for n in wanted}
        if as_dict:
            return data
        return data[wanted[0]] if isinstance(keys, str) or len(names) == 1 else list(data.values())

    def inputLoad(self, keys: Any = None, task: Any = None, cached: bool = False, as_dict: bool = False, flatten: bool = True) -> Any:
        """What this task needs, loaded, in the shape in which it is declared. task: one dependency by key, number, class
        or the name of a group. keys: names of outputs for one dependency, of dependencies for a dict of them.
        flatten=False: branches of a group stand together under its name."""
        deps, groups = self._inputs()
        load = lambda d, k=None: d.outputLoad(keys=k, as_dict=as_dict, cached=cached)
        if task is not None:
            got = self._select(deps, groups, task)
            return {label: load(d, keys) for label, d in got.items()} if isinstance(got, dict) else load(got, keys)
        if isinstance(deps, Task):
            return load(deps, keys)
        if isinstance(deps, dict):
            data = {k: load(deps[k]) for k in _chosen(keys, list(deps))}
            return data if flatten else _regrouped(data, groups)
        return [load(d, keys) for d in deps]

    def _inputs(self) -> tuple[Any, dict]:
        if "requires" in _declared(type(self)):
            return self.requires(), {}
        return self._resolved()

    @staticmethod
    def _select(deps: Any, groups: dict, task: Any) -> Any:
        if isinstance(deps, dict):
            if isinstance(task, type) and task.__name__ in groups:
                task = task.__name__
            if task in groups:
                return {label: deps[key] for key, label in groups[task].items()}
            if task in deps:
                return deps[task]
            found = {k: d for k, d in deps.items() if isinstance(task, type) and isinstance(d, task)}
        elif isinstance(deps, Task):
            found = {0: deps} if task in (0, type(deps), deps.task_family) else {}
        else:
            if isinstance(task, int) and task < len(deps):
                return deps[task]
            found = {k: d for k, d in enumerate(deps) if task in (type(d), d.task_family)}
        if not found:
            raise KeyError(f"no such dependency: {task!r}")
        return next(iter(found.values())) if len(found) == 1 else found

    def inputLoadConcat(self, keys: Any = None, tag: bool = True, tagkeys: list[str] | None = None, as_dict: bool = False, concat_fn: Callable | None = None, cached: bool = False, task: Any = None, flatten: bool = True) -> Any:
        """All dependencies stacked, each with its significant parameters as columns."""
        from stepwell.operators.concat import concat_iter

        deps, groups = self._inputs()
        if task is not None:
            got = self._select(deps, groups, task)
            chosen = list(got.values()) if isinstance(got, dict) else [got]
        else:
            chosen = _flat(deps)
        names = [] if not tag else tagkeys

        def stack(tasks: list[Task]) -> Any:
            items = [(t.task_id, t.significant_params(), t.outputLoad(keys=keys, as_dict=as_dict, cached=cached)) for t in tasks]
            return concat_iter(items, concat_fn=concat_fn, keys=names)

        if not flatten:
            return {g: stack([deps[k] for k in members]) for g, members in groups.items()}
        if task is None and groups and len(deps) > sum(map(len, groups.values())):
            warnings.warn(f"{self!r}: a shared dependency is stacked with the branches; name the group with task=", stacklevel=2)
        return stack(chosen)

    # -- metadata

    def _meta_path(self, format: str | None = None) -> str:
        return f"{self.stem()}-meta.{format or self.meta_format}"

    def metaSave(self, data: Any) -> None:
        files.write_bytes(self._meta_path("pickle"), pickle.dumps(data))

    saveMeta = metaSave

    def saveMetaJson(self, data: Any) -> None:
        files.write_bytes(self._meta_path("json"), json.dumps(data, indent=4).encode())

    def outputLoadMeta(self) -> Any:
        return self._load_meta("pickle")

    def outputLoadMetaJson(self) -> Any:
        return self._load_meta("json")

    def _load_meta(self, format: str) -> Any:
        path = self._meta_path(format)
        if not files.exists(path):
            raise RuntimeError(f"no metadata of {self!r}")
        data = files.read_bytes(path)
        return json.loads(data) if format == "json" else pickle.loads(data)

    def metaLoad(self, key: Any = None) -> Any:
        return self._input_meta("pickle", key)

    def inputLoadMeta(self, key: Any = None) -> Any:
        return self._input_meta("pickle", key)

    def inputLoadMetaJson(self, key: Any = None) -> Any:
        return self._input_meta("json", key)

    def _input_meta(self, format: str, key: Any) -> Any:
        deps = self.requires()
        return (deps if key is None else deps[key])._load_meta(format) if isinstance(deps if key is None else deps[key], Task) else mapped(deps, lambda d: d._load_meta(format))

    def outputLoadAllMeta(self) -> dict[str, Any]:
        """Metadata of every complete task above and of this one that has any, by family."""
        from stepwell.plans import graph

        found = {}
        for t in graph.traverse(self):
            if isinstance(t, TaskData) and t.complete(cascade=False) and files.exists(t._meta_path("pickle")):
                found[t.task_family] = t.outputLoadMeta()
        return found

    # -- completeness

    def complete(self, cascade: bool = True) -> bool:
        from stepwell.plans import records

        if not all(t.exists() for t in flatten(self.output())):
            return False
        if self.external:
            return True
        if not records.code_ok(self):
            return False
        if cascade and settings.check_dependencies:
            return all(d.is_complete() for d in self.deps())
        return True

    def reset(self, confirm: bool = False) -> bool:
        return self.invalidate(confirm)

    def invalidate(self, confirm: bool = False) -> bool:
        """Delete outputs and metadata. confirm: ask first."""
        if confirm and input(f"Delete the outputs of {self!r}? (y/n) ").strip().lower() != "y":
            return False
        for t in flatten(self.output()):
            t.invalidate()
        for format in ("pickle", "json"):
            if files.exists(self._meta_path(format)):
                files.delete(self._meta_path(format))
        outputs_changed()
        return True

    @property
    def flows(self) -> dict:
        """Other flows attached to the flow that is running."""
        from stepwell.plans.flow import attached

        return attached.get()


def _declared(cls: type) -> dict:
    """What the classes between a task and the library define."""
    return {n: v for c in reversed(cls.__mro__) if c.__module__ != __name__ for n, v in c.__dict__.items()}


def _flat(deps: Any) -> list[Task]:
    return flatten(deps)


def _regrouped(data: dict, groups: dict) -> dict:
    """Branches under the name of their group, other dependencies beside them."""
    of = {key: (g, label) for g, members in groups.items() for key, label in members.items()}
    out: dict = {}
    for key, value in data.items():
        if key in of:
            g, label = of[key]
            out.setdefault(g.__name__ if isinstance(g, type) else g, {})[label] = value
        else:
            out[key] = value
    return out


# ---------------------------------------------------------------------------------------------- task formats


class TaskCache(TaskData):
    target, ext = targets.CacheTarget, "cache"


class TaskCacheFrame(TaskData):
    target, ext = targets.FrameCacheTarget, "cache"


class TaskParquet(TaskData):
    pass


class TaskOrc(TaskData):
    target, ext = targets.OrcTarget, "orc"


class TaskCSV(TaskData):
    target, ext = targets.CSVTarget, "csv"


class TaskCSVGZ(TaskData):
    target, ext = targets.CSVGZTarget, "csv.gz"


class TaskJsonLines(TaskData):
    target, ext = targets.JsonLinesTarget, "jsonl"


class TaskJson(TaskData):
    target, ext = targets.JsonTarget, "json"


class TaskPickle(TaskData):
    target, ext = targets.PickleTarget, "pkl"


class TaskMarkdown(TaskData):
    target, ext = targets.MarkdownTarget, "md"


class TaskModel(TaskData):
    target, ext = targets.ModelTarget, "model"


class TaskTorch(TaskData):
    target, ext = targets.TorchTarget, "pt"


class TaskKeras(TaskData):
    target, ext = targets.KerasTarget, "hdf5"


class TaskExcelSingle(TaskData):
    target, ext = targets.ExcelTarget, "xlsx"


class TaskExcel(TaskData):
    """All outputs in one spreadsheet, a sheet each; loading gives a dict of sheets, or one by its name."""

    target, ext = targets.ExcelSheetsTarget, "xlsx"

    def output(self) -> Any:
        return self.target(f"{self.stem()}.{self.ext}")

    def save(self, data: dict, **options: Any) -> None:
        if data.keys() != set(self.output_names):
            raise ValueError(f"{self!r}: save needs a dict of {self.output_names}")
        self.output().save(data, **options)
        outputs_changed()

    def outputLoad(self, keys: Any = None, as_dict: bool = False, cached: bool = False) -> Any:
        if not self.complete(cascade=False):
            raise RuntimeError(f"{self!r} isn't complete: run it first")
        wanted = _chosen(keys, self.output_names)
        got = self.output().load(keys=wanted)
        return got[wanted[0]] if isinstance(keys, str) and not as_dict else got


class TaskFused(TaskData):
    """All branches of a fan-out as one query: rows keyed by a tag column, stored a partition a value. Its plan doesn't
    grow with the number of branches, and only branches that are missing are made. Subclasses give ``tag``, ``values()``
    and ``build(values)``, the frame of those branches with the tag as a column."""

    tag = "tag"
    target = targets.FusedTarget

    def values(self) -> list:
        raise NotImplementedError

    def build(self, values: list) -> Any:
        raise NotImplementedError

    def target_of(self, name: str) -> Any:
        return self.target(f"{self.stem()}-{name}.{self.ext}", self.tag, self.values())

    def run(self) -> None:
        self.save(self.build(self.output().missing()))

    def reset_branches(self, values: list) -> None:
        self.output().forget(values)
        outputs_changed()


class TaskAggregator(Task):
    """A group of tasks without an output of its own: complete when all of them are."""

    def __init__(self, values: list, path: str | None):
        import inspect

        if inspect.isgeneratorfunction(type(self).run):
            raise TypeError(f"{type(self).__name__}: declare the tasks with a decorator, run() can't yield them")
        super().__init__(values, path)

    def complete(self, cascade: bool = True) -> bool:
        return all(d.is_complete() for d in self.deps())

    def output(self) -> list:
        return [d.output() for d in self.deps()]

    def outputLoad(self, keys: Any = None, as_dict: bool = False, cached: bool = False) -> list:
        return [d.outputLoad(keys=keys, as_dict=as_dict, cached=cached) for d in self.deps()]

    def invalidate(self, confirm: bool = False) -> bool:
        return all([d.invalidate(confirm) for d in self.deps()])

    def reset(self, confirm: bool = False) -> bool:
        return self.invalidate(confirm)
