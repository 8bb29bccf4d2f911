"""Orders written as text: 'a asc, b desc'."""

from __future__ import annotations


def parse_order(text: str) -> list[tuple[str, bool]]:
    """(column, ascending) for each part; ascending unless desc is written."""
    out = []
    for part in text.split(","):
        words = part.split()
        if not words or len(words) > 2 or (len(words) == 2 and words[1].lower() not in ("asc", "desc")):
            raise ValueError(f"not an order: {part!r}")
        out.append((words[0], len(words) == 1 or words[1].lower() == "asc"))
    return out


def parse_keys(text: str) -> list[str]:
    keys = [k.strip() for k in text.split(",") if k.strip()]
    if not keys:
        raise ValueError("no keys are named")
    return keys
