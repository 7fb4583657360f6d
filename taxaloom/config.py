"""Options, paths and logs."""

from __future__ import annotations

import json
import logging
import os
from enum import Enum
from pathlib import Path


class FileKind(Enum):
    DUMP = "dump"
    GMT = "gmt"
    ALL = "all"


class LogFormat(Enum):
    CONSOLE = "console"
    JSON = "json"


class Evidence(Enum):
    """How much of an article a scored run has read; a label only."""

    ABSTRACT = "abstract-only"
    TEXT_TABLES = "text-tables"
    TEXT_TABLES_FIGURES = "text-tables-figures"


def cache_root(override: str | None = None) -> Path:
    """A folder from the caller, else from the environment, else the user's cache."""
    named = override or os.environ.get("TAXALOOM_CACHE")
    return Path(named) if named else Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "taxaloom"


#: Where keys of services are looked for, the first that is set being taken.
MODEL_KEYS, NAME_SEARCH_KEYS = ("GOOGLE_API_KEY", "GEMINI_API_KEY", "GOOGLE_GENERATIVE_AI_API_KEY"), ("NCBI_API_KEY",)


def service_key(names: tuple[str, ...]) -> str | None:
    """A key from the environment. It goes to the tasks that call a service and into no log."""
    return next((v for v in map(os.environ.get, names) if v), None)


class JsonLines(logging.Formatter):
    """Records as the event stream reads them."""

    def format(self, record: logging.LogRecord) -> str:
        extra = {k: getattr(record, k) for k in ("stage", "event", "study_id", "n", "latency_ms") if hasattr(record, k)}
        return json.dumps({"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "message": record.getMessage()} | extra)


def configure_logging(form: LogFormat | None = None, level: str | None = None) -> None:
    """Options go before the environment; other libraries speak from warnings on."""
    chosen = form or LogFormat(os.environ.get("TAXALOOM_LOG_FORMAT", "console"))
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if chosen is LogFormat.JSON else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logging.basicConfig(handlers=[handler], level=logging.WARNING, force=True)
    logging.getLogger("taxaloom").setLevel(level or os.environ.get("TAXALOOM_LOG_LEVEL", "INFO"))
