"""Identity of code: hashes of the top-level symbols that a task's class can reach in its project's sources.

Starting at the class, names used by a symbol are followed to top-level symbols of the same file and through imports of
local files. Other task classes are left out (they are tracked on their own), base classes count. Comments, layout,
docstrings and the line that pins code_version are invisible. What can't be read is left out rather than guessed.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import inspect
import os
import sys
from dataclasses import dataclass, field


@dataclass
class File:
    """Top-level symbols of one source file."""

    symbols: dict[str, list[ast.stmt]] = field(default_factory=dict)
    imports: dict[str, tuple[str, str | None]] = field(default_factory=dict)  # name -> (module, symbol)
    stars: list[str] = field(default_factory=list)
    effects: list[ast.stmt] = field(default_factory=list)


class _Bare(ast.NodeTransformer):
    """Without docstrings and pins."""

    def _body(self, node):
        self.generic_visit(node)
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        if isinstance(node, ast.ClassDef):
            node.body = [s for s in node.body if not _is_pin(s)] or [ast.Pass()]
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _body


def _is_pin(s: ast.stmt) -> bool:
    names = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
    return any(isinstance(n, ast.Name) and n.id == "code_version" for n in names)


def _bound(s: ast.stmt) -> list[str]:
    if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return [s.name]
    if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
        return [n.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in ast.walk(t) if isinstance(n, ast.Name)]
    return []


def _used(node: ast.AST) -> set[str]:
    """Names read anywhere inside, and dotted names as far as they are plain (a.b)."""
    found = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            found.add(n.id)
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
            found.add(f"{n.value.id}.{n.attr}")
    return found


@functools.lru_cache(maxsize=None)
def _parsed(path: str, stamp: tuple) -> File | None:
    try:
        with open(path, "rb") as f:
            module = ast.parse(f.read())
    except (OSError, SyntaxError, ValueError):
        return None
    out = File()

    def take(body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, ast.Import):
                for a in s.names:
                    out.imports[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], None)
            elif isinstance(s, ast.ImportFrom):
                module_name = "." * s.level + (s.module or "")
                for a in s.names:
                    if a.name == "*":
                        out.stars.append(module_name)
                    else:
                        out.imports[a.asname or a.name] = (module_name, a.name)
            elif isinstance(s, ast.If) and "__name__" in _used(s.test):
                continue
            elif isinstance(s, (ast.If, ast.Try)):
                for part in (s.body, getattr(s, "orelse", []), getattr(s, "finalbody", []), *[h.body for h in getattr(s, "handlers", [])]):
                    take(part)
            elif names := _bound(s):
                for n in names:
                    out.symbols.setdefault(n, []).append(s)
            elif not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)):
                out.effects.append(s)

    take(module.body)
    return out


def _file(path: str) -> File | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    return _parsed(path, (s.st_mtime_ns, s.st_size))


def project_root(path: str) -> str:
    """The directory above the outermost package that holds a file."""
    at = os.path.dirname(os.path.abspath(path))
    while os.path.exists(os.path.join(at, "__init__.py")):
        at = os.path.dirname(at)
    return at


def _local(module: str, importer: str, root: str) -> str | None:
    """The file of a module if it lies in the project; relative names are seen from the importing file."""
    if module.startswith("."):
        level = len(module) - len(module.lstrip("."))
        base = os.path.dirname(importer)
        for _ in range(level - 1):
            base = os.path.dirname(base)
        rest = module.lstrip(".")
        stem = os.path.join(base, *rest.split(".")) if rest else base
    else:
        stem = os.path.join(root, *module.split("."))
    for path in (stem + ".py", os.path.join(stem, "__init__.py")):
        if os.path.isfile(path) and f"{os.sep}site-packages{os.sep}" not in path:
            return path
    return None


def _digest(statements: list[ast.stmt]) -> str:
    bare = [ast.dump(_Bare().visit(ast.parse(ast.unparse(s)).body[0]), annotate_fields=False) for s in statements]
    return hashlib.md5("\n".join(bare).encode()).hexdigest()


def _task_names(path: str) -> set[str]:
    """Names of task classes that a loaded module of this file defines."""
    from stepwell.plans.task import Task

    for m in list(sys.modules.values()):
        if getattr(m, "__file__", None) and os.path.abspath(m.__file__) == path:
            return {n for n, v in vars(m).items() if isinstance(v, type) and issubclass(v, Task)}
    return set()


def source_of(cls: type) -> str | None:
    try:
        path = inspect.getsourcefile(cls)
    except TypeError:
        return None
    return os.path.abspath(path) if path and os.path.isfile(path) else None


def hashes(cls: type) -> dict[str, str]:
    """{'relative/path.py::symbol': md5} of all that the class can reach; empty where there is no source."""
    path = source_of(cls)
    if path is None or f"{os.sep}site-packages{os.sep}" in path:
        return {}
    root = project_root(path)
    file = _file(path)
    if file is None or cls.__name__ not in file.symbols:  # made inside a function, or the file can't be parsed
        return module_hashes(path, root)
    own = {path: {cls.__name__}}
    for base in cls.__mro__[1:]:
        at = source_of(base)
        if at and os.path.commonpath([at, root]) == root and not base.__module__.startswith("stepwell."):
            own.setdefault(at, set()).add(base.__name__)
    found: dict[str, str] = {}
    todo = [(p, n) for p, names in own.items() for n in names]
    seen = set(todo)

    def reach(p: str, name: str) -> None:
        f = _file(p)
        if f is None:
            return
        if name in f.symbols:
            if name in own.get(p, ()) or name not in _task_names(p):
                go(p, name)
        elif name in f.imports:
            module, symbol = f.imports[name]
            if symbol is None:
                return
            if at := _local(module, p, root):
                reach(at, symbol)
        else:
            for module in f.stars:
                if at := _local(module, p, root):
                    g = _file(at)
                    if g and (name in g.symbols or name in g.imports):
                        reach(at, name)

    def go(p: str, name: str) -> None:
        if (p, name) not in seen:
            seen.add((p, name))
            todo.append((p, name))

    while todo:
        p, name = todo.pop()
        f = _file(p)
        if f is None:
            continue
        statements = f.symbols.get(name)
        if not statements:
            continue
        found[f"{os.path.relpath(p, root)}::{name}"] = _digest(statements)
        for s in statements:
            for used in _used(s):
                first, _, attribute = used.partition(".")
                if not attribute:
                    reach(p, first)
                elif first in f.imports:
                    module, symbol = f.imports[first]
                    inner = module if symbol is None else f"{module}.{symbol}" if module.strip(".") else module + symbol
                    if at := _local(inner, p, root):
                        reach(at, attribute)
    return dict(sorted(found.items()))


def file_hash(path: str) -> str:
    """Hash of a file's code without comments and docstrings; of its bytes where it can't be parsed."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        bare = ast.dump(_Bare().visit(ast.parse(data)), annotate_fields=False).encode()
    except (SyntaxError, ValueError):
        bare = data
    return hashlib.md5(bare).hexdigest()


def module_hashes(path: str, root: str | None = None) -> dict[str, str]:
    """{'relative/path.py': md5} of a file and the local files that it imports, directly or not: for classes whose
    symbols can't be told apart."""
    root = root or project_root(path)
    found: dict[str, str] = {}
    todo = [path]
    while todo:
        p = todo.pop()
        key = os.path.relpath(p, root)
        if key in found:
            continue
        found[key] = file_hash(p)
        f = _file(p)
        for module, symbol in (f.imports.values() if f else ()):
            inner = [module] if symbol is None else [module, f"{module}.{symbol}" if module.strip(".") else module + symbol]
            todo += [at for m in inner if (at := _local(m, p, root))]
        todo += [at for m in (f.stars if f else ()) if (at := _local(m, p, root))]
    return dict(sorted(found.items()))


def current_hash(key: str, root: str) -> str | None:
    """What a stored key would hash to now; None where it is gone."""
    name, _, symbol = key.partition("::")
    path = os.path.join(root, name)
    if not os.path.isfile(path):
        return None
    if not symbol:
        return file_hash(path)
    f = _file(path)
    return _digest(f.symbols[symbol]) if f and symbol in f.symbols else None


#: Hashes held while a run goes on, so that each class is hashed once and an edit in between doesn't split the run.
_frozen: dict[type, dict[str, str]] | None = None


def freeze() -> bool:
    """Hold hashes from now on; False if they are held already."""
    global _frozen
    if _frozen is not None:
        return False
    _frozen = {}
    return True


def unfreeze() -> None:
    global _frozen
    _frozen = None


def current(cls: type) -> dict[str, str]:
    if _frozen is None:
        return hashes(cls)
    if cls not in _frozen:
        _frozen[cls] = hashes(cls)
    return _frozen[cls]


def token(cls: type) -> str | None:
    got = current(cls)
    return hashlib.md5("\n".join(f"{k}={v}" for k, v in got.items()).encode()).hexdigest()[:16] if got else None
