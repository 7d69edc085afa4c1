"""Settings from the environment, and JSON log lines."""

from __future__ import annotations

import json
import logging
import os
import sys
from datetime import datetime, timezone


class MissingCredential(RuntimeError):
    """A required setting isn't in the environment."""


class Secret:
    """A string that shows itself only on request."""

    __slots__ = ("_value",)

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret(<redacted>)"

    def __str__(self) -> str:
        return "<redacted>"

    def __format__(self, spec: str) -> str:
        return format(str(self), spec)

    def __eq__(self, other) -> bool:
        return isinstance(other, Secret) and other._value == self._value

    def __hash__(self) -> int:
        return hash(self._value)


def require(name: str) -> Secret:
    value = os.environ.get(name, "").strip()
    if not value:
        raise MissingCredential(f"{name} must be set in the environment; there is no default")
    return Secret(value)


def optional_setting(name: str, default: str) -> str:
    return os.environ.get(name, "").strip() or default


_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonFormatter(logging.Formatter):
    """One JSON object a line, with whatever `extra` holds."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def configure_logging(level: int = logging.INFO, stream=None) -> None:
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter())
    root = logging.getLogger("panelweave")
    root.handlers[:] = [handler]
    root.setLevel(level)
    root.propagate = False


class DataCredentials:
    """Key and secret of a data vendor, from PANELWEAVE_DATA_KEY and PANELWEAVE_DATA_SECRET alone."""

    def __init__(self):
        self.key, self.secret = require("PANELWEAVE_DATA_KEY"), require("PANELWEAVE_DATA_SECRET")

    def __repr__(self) -> str:
        return "DataCredentials(<redacted>)"
