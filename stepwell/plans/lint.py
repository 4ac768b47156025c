"""Inputs that a task declares but doesn't use, found in the source of its run().

A dependency is *unused* if run() provably doesn't load it, *clean* if it is loaded, and *unanalyzed* where the source
doesn't tell. A line in the class with ``# stepwell: input-unused`` says that it is meant so.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
import warnings
from dataclasses import dataclass

from stepwell.plans.ident import flatten
from stepwell.plans.task import Task

SUPPRESS = "stepwell: input-unused"
LOADS = {"inputLoad", "inputLoadConcat", "input", "metaLoad", "inputLoadMeta", "inputLoadMetaJson", "requires", "deps", "inputs"}
_said: set[tuple[str, str]] = set()


class UnusedInputWarning(UserWarning):
    """A declared dependency isn't loaded."""


@dataclass(frozen=True)
class InputFinding:
    family: str
    dependency: str
    verdict: str

    @property
    def message(self) -> str:
        said = {"unused": "is declared but run() doesn't load it", "clean": "is loaded", "unanalyzed": "can't be judged from the source"}
        return f"{self.family}: {self.dependency} {said[self.verdict]}"


def check_class(cls: type[Task]) -> list[InputFinding]:
    """A verdict for each declared dependency; none for classes without a run() of their own or declared dependencies."""
    if "run" not in cls.__dict__ or not cls.spec:
        return []
    names: list[tuple[str, set]] = []
    for e in cls.spec:
        if "cls" in e:
            names.append((e["cls"].__name__, {e["group"], e["cls"].__name__}))
        elif isinstance(e["fixed"], dict):
            names += [(k, {k, c.__name__}) for k, c in e["fixed"].items()]
        else:
            names += [(c.__name__, {c.__name__}) for c in flatten(e["fixed"])]
    all_of = lambda verdict: [InputFinding(cls.__name__, n, verdict) for n, _ in names]
    try:
        source = textwrap.dedent(inspect.getsource(cls))
        body = ast.parse(source).body[0]
    except (OSError, TypeError, SyntaxError, IndexError):
        return all_of("unanalyzed")
    if SUPPRESS in source:
        return []
    if len(cls.spec) != 1:
        return all_of("unanalyzed")
    run = next((s for s in body.body if isinstance(s, ast.FunctionDef) and s.name == "run"), None)
    if run is None:
        return all_of("unanalyzed")
    me = run.args.args[0].arg if run.args.args else "self"
    loaded: set[str] = set()
    whole = False
    for n in ast.walk(run):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == me:
            if n.func.attr not in LOADS:
                if n.func.attr not in ("save", "saveMeta", "metaSave", "saveMetaJson"):
                    whole = whole or n.func.attr in vars(cls)  # a method of one's own may load anything
                continue
            chosen = [k.value for k in n.keywords if k.arg in ("task", "keys")] + n.args[:1]
            known = [x for c in chosen for x in _strings(c)]
            if chosen and known:
                loaded |= set(known)
            else:
                whole = True
        elif isinstance(n, ast.Call) and any(isinstance(a, ast.Name) and a.id == me for a in n.args):
            whole = True
    if whole:
        used = _strings_used(run)
        if len(names) > 1 and isinstance(cls.spec[0].get("fixed"), dict) and used & {n for n, _ in names}:
            return [InputFinding(cls.__name__, n, "clean" if aliases & used else "unused") for n, aliases in names]
        return all_of("clean")
    return [InputFinding(cls.__name__, n, "clean" if aliases & loaded else "unused") for n, aliases in names]


def _strings(node: ast.expr) -> list[str]:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return [node.value]
    if isinstance(node, ast.Name):
        return [node.id]
    return [x for e in getattr(node, "elts", []) for x in _strings(e)]


def _strings_used(run: ast.FunctionDef) -> set[str]:
    return {n.value for n in ast.walk(run) if isinstance(n, ast.Constant) and isinstance(n.value, str)}


def check(classes: list[type[Task]]) -> list[InputFinding]:
    return [f for c in dict.fromkeys(classes) for f in check_class(c)]


def unused(tasks: list[Task]) -> list[InputFinding]:
    """Findings above some tasks, for a preview; each is also warned of once. Never raises."""
    from stepwell.plans import graph

    try:
        found = [f for f in check([type(t) for root in tasks for t in graph.traverse(root)]) if f.verdict == "unused"]
    except Exception:
        return []
    for f in found:
        if (f.family, f.dependency) not in _said:
            _said.add((f.family, f.dependency))
            warnings.warn(f.message, UnusedInputWarning, stacklevel=3)
    return found
