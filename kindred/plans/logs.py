"""The library's log, on standard error, as text or as JSON lines."""

from __future__ import annotations

import json
import logging
import sys

# Fixed values; another level counts as info.
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname, "msg": record.getMessage()}
        return json.dumps(said | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


def set_up(level: str = "info", form: str = "text", stream=None) -> logging.Logger:
    """The log `kindred` with one handler; a second call takes the place of the first. form: json, or text for any other."""
    log, handler = logging.getLogger("kindred"), logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(_Json() if form.lower() == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(LEVELS.get(level.lower(), logging.INFO))
    return log
