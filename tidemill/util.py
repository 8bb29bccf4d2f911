"""Retries and settings files."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

R = TypeVar("R")


def retry(call: Callable[[], R], times: int = 3, wait_seconds: float = 1.0, within_seconds: float | None = None) -> R:
    """Call until it does not fail: so many times, and not beyond a duration."""
    began = time.monotonic()
    for left in range(times - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left or (within_seconds is not None and time.monotonic() - began + wait_seconds > within_seconds):
                raise
            time.sleep(wait_seconds)
    raise ValueError("times must be positive")


def read_settings(path: str) -> dict[str, str]:
    """Settings of a file of 'key: value' lines; # begins a comment."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            key, _, value = line.partition(":")
            out[key.strip()] = value.strip().strip("'\"")
    return out
