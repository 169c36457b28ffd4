"""Logging: silent unless configured."""

from __future__ import annotations

import logging
import sys
from pathlib import Path

_ROOT = logging.getLogger("rootstock")
_ROOT.addHandler(logging.NullHandler())
_FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def _add(handler: logging.Handler, level: str) -> None:
    handler.setFormatter(logging.Formatter(_FORMAT))
    _ROOT.addHandler(handler)
    _ROOT.setLevel(level.upper())


def configure_logging(level: str = "INFO") -> None:
    """Messages to standard error."""
    _add(logging.StreamHandler(sys.stderr), level)


def configure_file_logging(path: str | Path, level: str = "INFO") -> None:
    """Messages to a file as well."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    _add(logging.FileHandler(path), level)
