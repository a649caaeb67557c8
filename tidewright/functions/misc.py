"""Small helpers of command lines and logs."""

from __future__ import annotations

import logging
import re
import sys
from pathlib import Path

import tidewright


def parse_bool(text: str | bool) -> bool:
    if isinstance(text, bool):
        return text
    word = str(text).strip().lower()
    if word in ("1", "true", "yes", "y", "on", "t"):
        return True
    if word in ("0", "false", "no", "n", "off", "f"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


def mask_coordinates(latitude: float, longitude: float) -> tuple[float, float]:
    """To a tenth of a degree, so that logs do not name a place."""
    return round(latitude, 1), round(longitude, 1)


def mask_secrets(text: str) -> str:
    """Values of keys, tokens and passwords as stars."""
    return re.sub(r"(?i)\b((?:api[_-]?)?key|token|secret|password)(\s*[=:]\s*)\S+", r"\1\2***", text)


def cpe(vendor: str = "tidewright", product: str = "tidewright", version: str | None = None) -> str:
    """A CPE 2.3 name of this version."""
    return f"cpe:2.3:a:{vendor}:{product}:{version or tidewright.__version__}:*:*:*:*:*:*:*"


def greeting() -> str:
    return f"tidewright {tidewright.__version__}"


def logger(name: str = "tidewright", level: str = "INFO", file: str | None = None) -> logging.Logger:
    """A logger to the console and, if asked, a file; calling it again adds no handler."""
    out = logging.getLogger(name)
    out.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    if not any(type(h) is logging.StreamHandler for h in out.handlers):
        h = logging.StreamHandler(sys.stderr)
        h.setFormatter(form)
        out.addHandler(h)
    if file and not any(isinstance(h, logging.FileHandler) and h.baseFilename == str(Path(file).resolve()) for h in out.handlers):
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        h = logging.FileHandler(file)
        h.setFormatter(form)
        out.addHandler(h)
    return out
