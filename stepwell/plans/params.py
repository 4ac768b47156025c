"""Typed parameters of tasks. ``serialize`` feeds a task's id; ``normalize`` runs on every value given."""

from __future__ import annotations

import datetime
import enum
import itertools
import json
from typing import Any

MISSING = object()
_order = itertools.count()


class ParameterError(Exception):
    """Base of the errors in giving parameters."""


class MissingParameterError(ParameterError):
    """A parameter without default was not given."""


class UnknownParameterError(ParameterError):
    """A parameter was given that the task doesn't have."""


class DuplicateParameterError(ParameterError):
    """A parameter was given by position and by name."""


class Parameter:
    """A value of any kind. significant=False keeps it out of the task's id, positional=False makes it keyword-only."""

    implicit_default: Any = MISSING

    def __init__(self, default: Any = MISSING, significant: bool = True, positional: bool = True, description: str | None = None):
        self.default = self.implicit_default if default is MISSING else default
        self.significant, self.positional, self.description = significant, positional, description
        self.order = next(_order)

    def has_task_value(self) -> bool:
        return self.default is not MISSING

    def task_value(self) -> Any:
        if self.default is MISSING:
            raise MissingParameterError("no value and no default")
        return self.normalize(self.default)

    def parse(self, text: str) -> Any:
        return text

    def serialize(self, value: Any) -> str:
        return str(value)

    def normalize(self, value: Any) -> Any:
        return value


class _Number(Parameter):
    kind: type = int

    def parse(self, text: str) -> Any:
        return self.kind(text)

    def normalize(self, value: Any) -> Any:
        """The value as it is, so that ids don't change with its type; what isn't a number of this kind raises."""
        if value is not None:
            self.kind(value)
        return value


class IntParameter(_Number):
    kind = int


class FloatParameter(_Number):
    kind = float


class BoolParameter(Parameter):
    implicit_default = False

    def parse(self, text: str) -> bool:
        known = {"true": True, "false": False}
        if str(text).lower() not in known:
            raise ValueError(f"not a truth value: {text!r}")
        return known[str(text).lower()]

    def normalize(self, value: Any) -> Any:
        return value if value is None else self.parse(value)


class DateParameter(Parameter):
    FORMAT = "%Y-%m-%d"

    def parse(self, text: str) -> datetime.date:
        return datetime.datetime.strptime(text, self.FORMAT).date()

    def serialize(self, value: Any) -> str:
        return str(value) if value is None else value.strftime(self.FORMAT)

    def normalize(self, value: Any) -> Any:
        return value.date() if isinstance(value, datetime.datetime) else value


class DictParameter(Parameter):
    def parse(self, text: str) -> dict:
        return json.loads(text)

    def serialize(self, value: Any) -> str:
        return json.dumps(value, sort_keys=True)


class ListParameter(Parameter):
    def parse(self, text: str) -> list:
        return list(json.loads(text))

    def serialize(self, value: Any) -> str:
        return json.dumps(value)


class ChoiceParameter(Parameter):
    def __init__(self, *args: Any, choices: Any = None, **kwargs: Any):
        if not choices:
            raise ParameterError("choices are needed, at least one")
        self.choices = list(choices)
        super().__init__(*args, **kwargs)
        if self.default is not MISSING:
            self.normalize(self.default)

    def normalize(self, value: Any) -> Any:
        if value not in self.choices:
            raise ValueError(f"{value!r} is none of {self.choices!r}")
        return value


class EnumParameter(Parameter):
    def __init__(self, *args: Any, enum: type[enum.Enum] | None = None, **kwargs: Any):
        if enum is None:
            raise ParameterError("an enum is needed")
        self.enum = enum
        super().__init__(*args, **kwargs)

    def parse(self, text: str) -> Any:
        return self.enum[text]

    def serialize(self, value: Any) -> str:
        return value.name
