"""Frontmatter of one page: YAML 1.2 core values in, YAML text out.

Per-row helpers of the jobs in sources.documents. The YAML events come from PyYAML, whose
own value rules are YAML 1.1; the rules here are the core schema's.
"""

from __future__ import annotations

import json
import math
import re

MAX_BYTES = 128 * 1024
MAX_DEPTH = 32
MAX_DIGITS = 400
# Keys with a meaning of their own, in the order they are written.
STANDARD_KEYS = (
    "type title description resource tags sources generated verified status stale_after category "
    "domain aliases recall_triggers created updated summary raw_path source_id"
).split()
LEGACY_KEYS = "created updated summary raw_path source_id".split()

_INT = re.compile(r"[-+]?[0-9]+\Z")
_BASED = re.compile(r"0(?:o([0-7]+)|x([0-9a-fA-F]+))\Z")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z")
_SPECIAL = re.compile(r"(?:([-+])?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z")
_TRUE, _FALSE = ("true", "True", "TRUE"), ("false", "False", "FALSE")
_NULL = ("", "~", "null", "Null", "NULL")


class FrontmatterError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def core_scalar(text: str):
    """Value of a plain scalar under the core schema."""
    if text in _NULL:
        return None
    if text in _TRUE or text in _FALSE:
        return text in _TRUE
    # Numbers with more digits than any integer type are texts.
    if len(text) > MAX_DIGITS:
        return text
    if _INT.match(text):
        return int(text)
    based = _BASED.match(text)
    if based:
        return int(based.group(1), 8) if based.group(1) else int(based.group(2), 16)
    if _FLOAT.match(text):
        return float(text)
    special = _SPECIAL.match(text)
    if special:
        return math.nan if text[-1] in "nN" else math.inf * (-1 if special.group(1) == "-" else 1)
    return text


def js_string(value) -> str:
    """A scalar spelled the way the reference turns values into text."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "Infinity" if value > 0 else "-Infinity"
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
        return re.sub(r"e([+-])0+", r"e\1", repr(value))
    return str(value)


def flatten(value) -> str:
    """Search text of any value: lists and map values joined by spaces."""
    if value is None:
        return ""
    if isinstance(value, dict):
        value = list(value.values())
    return " ".join(flatten(v) for v in value) if isinstance(value, list) else js_string(value)


class _Reader:
    """Builds values from YAML events and notes what the rules forbid."""

    def __init__(self, events):
        self.events = events
        self.alias = self.tag = False
        self.depth = 0
        self.duplicate = None

    def note_tag(self, event):
        if event.tag and event.tag.startswith("!"):
            self.tag = True

    def value(self, event, depth: int):
        kind = type(event).__name__
        if kind == "AliasEvent":
            self.alias = True
            return "*" + event.anchor
        self.note_tag(event)
        if kind == "ScalarEvent":
            if event.tag == "tag:yaml.org,2002:str" or event.style or event.tag == "!":
                return event.value
            return core_scalar(event.value)
        self.depth = max(self.depth, depth + 1)
        if kind == "SequenceStartEvent":
            items = []
            while type(nxt := next(self.events)).__name__ != "SequenceEndEvent":
                items.append(self.value(nxt, depth + 1))
            return items
        seen, out = set(), {}
        while type(nxt := next(self.events)).__name__ != "MappingEndEvent":
            key = self.value(nxt, depth + 1)
            item = self.value(next(self.events), depth + 1)
            name = key if isinstance(key, str) else js_string(key) if not isinstance(key, (dict, list)) else json.dumps(key)
            # At the top keys clash as text; deeper only when type and value agree.
            identity = name if depth == 0 else (type(key).__name__, name)
            if identity in seen and self.duplicate is None:
                self.duplicate = name
            seen.add(identity)
            out[name] = item
        return out


def read_mapping(text: str, max_depth: int = MAX_DEPTH) -> dict:
    """Frontmatter text to a mapping, or FrontmatterError with a diagnostic code."""
    try:
        return _read_mapping(text, max_depth)
    except FrontmatterError:
        raise
    except RecursionError:
        raise FrontmatterError("frontmatter_limit_depth", f"Frontmatter nesting exceeds {max_depth}") from None
    except (ValueError, OverflowError) as error:
        raise FrontmatterError("frontmatter_parse_error", f"YAML parse error: {type(error).__name__}") from None


def _read_mapping(text: str, max_depth: int) -> dict:
    import yaml

    loader = getattr(yaml, "CBaseLoader", yaml.BaseLoader)
    documents, reader = [], None
    try:
        events = iter(list(yaml.parse(text, Loader=loader)))
        for event in events:
            if type(event).__name__ == "DocumentStartEvent":
                reader = reader or _Reader(events)
                documents.append(reader.value(next(events), 0))
    except yaml.YAMLError as error:
        first = str(getattr(error, "problem", None) or error).split("\n")[0]
        raise FrontmatterError("frontmatter_parse_error", f"YAML parse error: {first}") from None
    if reader and reader.duplicate is not None:
        raise FrontmatterError("frontmatter_duplicate_key", f"Duplicate key: {reader.duplicate}")
    if len(documents) != 1:
        raise FrontmatterError("frontmatter_multiple_documents", "Multiple YAML documents in frontmatter")
    if not isinstance(documents[0], dict):
        raise FrontmatterError("frontmatter_parse_error", "Frontmatter must be a YAML mapping")
    if reader.alias:
        raise FrontmatterError("frontmatter_alias_forbidden", "YAML aliases are not allowed")
    if reader.tag:
        raise FrontmatterError("frontmatter_custom_tag_forbidden", "Custom YAML tags are not allowed")
    if reader.depth > max_depth:
        raise FrontmatterError("frontmatter_limit_depth", f"Frontmatter nesting exceeds {max_depth}")
    return documents[0]


def sources_kind(mapping: dict) -> str:
    if "sources" not in mapping:
        return "absent"
    value = mapping["sources"]
    if isinstance(value, str):
        return "legacy-scalar"
    if isinstance(value, list):
        if all(isinstance(v, str) for v in value):
            return "legacy-list"
        if all(isinstance(v, dict) for v in value):
            return "canonical"
    return "unknown-shape"


def dump_json(value) -> str:
    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v == int(v) and abs(v) < 1e21 else v
        return v

    return json.dumps(clean(value), ensure_ascii=False, separators=(",", ":"))


_PLAIN_START = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`=]|[-?:](?=\S)")


def _plain_ok(text: str) -> bool:
    return (
        bool(text)
        and bool(_PLAIN_START.match(text))
        and core_scalar(text) == text
        and isinstance(core_scalar(text), str)
        and text == text.strip()
        and not re.search(r": |:$| #|[\x00-\x08\x0a-\x1f\x7f]|\t", text)
        and not text.startswith(("---", "..."))
    )


def _scalar(value, indent: str) -> str:
    if value is None or isinstance(value, (bool, int, float)):
        return js_string(value) if not isinstance(value, float) or math.isfinite(value) else (
            ".nan" if math.isnan(value) else ".inf" if value > 0 else "-.inf"
        )
    if _plain_ok(value):
        return value
    if "\n" in value and not re.search(r"[\x00-\x08\x0b-\x1f\x7f]", value) and not value.startswith((" ", "\t")) and value.strip("\n"):
        chomp = "" if re.search(r"[^\n]\n\Z", value) else "+" if value.endswith("\n") else "-"
        lines = value[:-1].split("\n") if value.endswith("\n") else value.split("\n")
        return f"|{chomp}\n" + "\n".join(indent + line if line else "" for line in lines)
    return json.dumps(value, ensure_ascii=False)


def _emit(value, indent: str, out: list[str], lead: str) -> None:
    """Append `lead` followed by value; nested blocks are indented by two."""
    deeper = indent + "  "
    if isinstance(value, dict) and value:
        if lead.endswith("-"):
            first = True
            for key, item in value.items():
                name = _scalar(key, "")
                _emit(item, deeper, out, f"{lead} {name}:" if first else f"{deeper}{name}:")
                first = False
            return
        out.append(lead)
        for key, item in value.items():
            _emit(item, deeper, out, f"{deeper}{_scalar(key, '')}:")
    elif isinstance(value, list) and value:
        out.append(lead)
        for item in value:
            _emit(item, deeper, out, f"{deeper}-")
    elif isinstance(value, (dict, list)):
        out.append(f"{lead} {'{}' if isinstance(value, dict) else '[]'}")
    else:
        out.append(f"{lead} {_scalar(value, deeper)}")


def write_yaml(mapping: dict) -> str:
    """Block-style YAML, one final newline."""
    out: list[str] = []
    for key, value in mapping.items():
        _emit(value, "", out, f"{_scalar(key, '')}:")
    return "\n".join(out).rstrip("\n") + "\n" if out else "{}\n"
