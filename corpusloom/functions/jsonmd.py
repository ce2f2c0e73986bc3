"""Markdown of one JSON value; the per-row helper of the conversion job."""

from __future__ import annotations

import json
import re

from .frontmatter import js_string


def _human(key: str) -> str:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[_-]+", " ", key))
    words = re.sub(r"\s+", " ", words).strip()
    return words[:1].upper() + words[1:]


def _title(value) -> str | None:
    if isinstance(value, dict):
        for key in ("title", "name", "id"):
            found = value.get(key)
            if isinstance(found, str) and found.strip():
                return found.strip()
    return None


def _heading(depth: int) -> str:
    return "#" * min(depth + 2, 6)


def _expanded(value, depth: int, label: str | None) -> list:
    """Lines of one value, in order; nested values stand in it as (value, depth, label) to expand."""
    pad = "  " * depth
    if not isinstance(value, (dict, list)):
        name = f"**{_human(label)}:** " if label else ""
        return [f"{pad}- {name}{js_string(value)}"]
    out: list = [f"{_heading(depth)} {_human(label)}", ""] if label else []
    below = depth + 1 if label else depth
    if isinstance(value, dict):
        for key, item in value.items():
            nested = isinstance(item, (dict, list))
            out.append((item, below, key) if nested else f"{pad}- **{_human(key)}:** {js_string(item)}")
    elif not value:
        out.append(f"{pad}- _(empty)_")
    else:
        for number, item in enumerate(value, 1):
            if isinstance(item, dict):
                out += [f"{_heading(below)} {_title(item) or f'Item {number}'}", "", (item, below, None)]
            elif isinstance(item, list):
                out += [f"{pad}- Item {number}:", (item, depth + 1, None)]
            else:
                out.append(f"{pad}- {js_string(item)}")
    return [*out, ""]


def _lines(value) -> list[str]:
    """All lines of a value of any depth, without recursion."""
    out: list[str] = []
    waiting: list = [(value, 0, None)]
    while waiting:
        now = waiting.pop()
        if isinstance(now, str):
            out.append(now)
        else:
            waiting += reversed(_expanded(*now))
    return out


def convert(text: str) -> str:
    """Headings and bullets of a JSON text; text that is no JSON, or nested too deep to read, stays as it is."""

    def forbidden(name):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=forbidden)
    except (ValueError, RecursionError):
        return text
    lines = [f"# {_title(value) or 'JSON Extract'}", "", *_lines(value)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() or text
