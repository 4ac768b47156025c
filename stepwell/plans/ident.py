"""Identity of a parameterised step, and flattening of dependency structures."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from stepwell.settings import settings


def task_id(family: str, serialised: dict[str, str]) -> str:
    """family_summary_hash: MD5 over sorted JSON, and the first values in sorted order for the reader."""
    text = json.dumps(serialised, separators=(",", ":"), sort_keys=True)
    shown = "_".join(serialised[k][: settings.summary_chars] for k in sorted(serialised)[: settings.summary_params])
    return f"{family}_{re.sub(r'[^A-Za-z0-9_]', '_', shown)}_{hashlib.md5(text.encode()).hexdigest()[:10]}"


def short_md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:16]


def flatten(struct: Any) -> list:
    """The leaves of nested dicts, lists, tuples and iterators, in order; None is no leaf."""
    if struct is None:
        return []
    if isinstance(struct, dict):
        return [x for v in struct.values() for x in flatten(v)]
    if isinstance(struct, str) or not hasattr(struct, "__iter__"):
        return [struct]
    return [x for v in struct for x in flatten(v)]


def mapped(struct: Any, fn) -> Any:
    """fn over the leaves of a structure, which keeps its shape."""
    if isinstance(struct, dict):
        return {k: mapped(v, fn) for k, v in struct.items()}
    if isinstance(struct, (list, tuple)):
        return [mapped(v, fn) for v in struct]
    return fn(struct)
