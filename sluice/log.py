"""The engine's log: one JSON object a line, level by $LOG_LEVEL, to standard error or the file that $SLUICE_LOG names."""

from __future__ import annotations

import json
import logging
import os
from datetime import datetime, timezone

from sluice.plans.config import DEFAULTS

_PLAIN = frozenset(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        extra = {k: v for k, v in record.__dict__.items() if k not in _PLAIN}
        return json.dumps({"time": at, "level": record.levelname.lower(), "msg": record.getMessage(), **extra}, default=str)


def setup(level: str | None = None, path: str | None = None) -> logging.Logger:
    log = logging.getLogger("sluice")
    log.setLevel((level or os.environ.get("LOG_LEVEL") or DEFAULTS["log_level"]).upper())
    path = path or os.environ.get("SLUICE_LOG")
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(JsonLines())
    log.handlers[:] = [handler]
    log.propagate = False
    return log
