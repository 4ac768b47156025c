"""Logging: silent unless asked for; what a task logs also goes into the run history."""

from __future__ import annotations

import logging
from typing import Any

from stepwell.settings import settings
from stepwell.sources import history

_logger = logging.getLogger("stepwell")
_logger.addHandler(logging.NullHandler())
MESSAGE, EXTRAS, EXTRA = 4096, 20, 512


def enable_logging(level: str | None = None) -> logging.Logger:
    if not any(isinstance(h, logging.StreamHandler) and not isinstance(h, logging.NullHandler) for h in _logger.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        _logger.addHandler(handler)
    _logger.setLevel(level or settings.log_level)
    return _logger


def disable_logging() -> None:
    for h in list(_logger.handlers):
        if not isinstance(h, logging.NullHandler):
            _logger.removeHandler(h)


class TaskLogger:
    """A logger that knows its task."""

    def __init__(self, task: Any):
        self.task = task

    def _log(self, level: str, message: str, *args: Any, **extra: Any) -> None:
        text = str(message) % args if args else str(message)
        history.append(
            "task_log", task_id=self.task.task_id, family=self.task.task_family, level=level, message=text[:MESSAGE], extra={str(k): str(v)[:EXTRA] for k, v in list(extra.items())[:EXTRAS]}
        )
        _logger.log(logging.getLevelName(level.upper()), "%s: %s", self.task, text)

    def __getattr__(self, name: str) -> Any:
        if name in ("debug", "info", "warning", "error", "critical"):
            return lambda message, *args, **extra: self._log(name, message, *args, **extra)
        return getattr(_logger, name)
