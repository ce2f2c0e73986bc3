"""CommonMark inline link scan for bodies with code, HTML, escapes or references.

A small per-row helper: it finds which parts of a body are code or raw HTML, collects
reference definitions, and reads the links of what is left. Ordinary bodies never get
here (see operators.links).
"""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_DEFINITION = re.compile(
    r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)"
    r"(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$",
    re.S,
)
_HTML_TAG = re.compile(
    r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
    r"|!--.*?-->|\?.*?\?>|![A-Z].*?>|!\[CDATA\[.*?\]\]>)",
    re.S,
)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s@<>]+@[^\s@<>]+)>")
# Tags that open an HTML block (CommonMark start condition 6, plus 1).
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd "
    "details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav "
    "noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul pre script style textarea"
).split()
_HTML_BLOCK = re.compile(rf"^ {{0,3}}<(?:/?(?:{'|'.join(_BLOCK_TAGS)})(?:[\s/>]|$)|!--|\?|![A-Z])", re.I)
# Limits CommonMark allows or sets: nested brackets in a target, characters of a label.
_NESTED, _LABEL = 32, 999
# Raw HTML that ends with a mark of its own; without one later on it is no HTML.
_MARKED = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">"))
_ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def _unescape(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def _blocks(body: str):
    """Paragraph-like text runs as (offset, text), with code and HTML blocks left out."""
    runs, definitions = [], {}
    current: list[tuple[int, str]] = []
    fence = None
    html_block = False
    offset = 0

    def flush():
        nonlocal current
        at = 0
        while at < len(current):
            for take in (1, 2):
                found = _DEFINITION.match("\n".join(t for _, t in current[at : at + take]))
                if found:
                    break
            if not found:
                break
            target = found.group(2)
            if target.startswith("<"):
                target = target[1:-1]
            definitions.setdefault(_label(found.group(1)), _unescape(target))
            at += take
        if at < len(current):
            runs.append((current[at][0], "\n".join(t for _, t in current[at:])))
        current = []

    for line in body.split("\n"):
        start = offset
        offset += len(line) + 1
        expanded = line.expandtabs(4)
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                fence = None
            continue
        if html_block:
            html_block = bool(line.strip())
            continue
        opening = _FENCE.match(line)
        if opening and not (opening.group(1)[0] == "`" and "`" in opening.group(2)):
            flush()
            fence = opening.group(1)
        elif not line.strip():
            flush()
        elif expanded.startswith("    ") and not current:
            continue
        elif _HTML_BLOCK.match(line):
            flush()
            html_block = True
        elif re.match(r"^ {0,3}#{1,6}(\s|$)", line):
            flush()
            runs.append((start, line))
        else:
            current.append((start, line))
    flush()
    return runs, definitions


def _destination(text: str, i: int):
    """Parse '(dest "title")' at i; (target, end) or None."""
    i += 1
    while i < len(text) and text[i] in " \t\n":
        i += 1
    if i < len(text) and text[i] == "<":
        end = i + 1
        while end < len(text) and text[end] not in "<>\n":
            end += 2 if text[end] == "\\" else 1
        if end >= len(text) or text[end] != ">":
            return None
        target, i = text[i + 1 : end], end + 1
    else:
        depth, start = 0, i
        while i < len(text) and text[i] > " ":
            ch = text[i]
            if ch == "\\" and i + 1 < len(text) and text[i + 1] in _ESCAPABLE:
                i += 1
            elif ch == "(":
                depth += 1
                if depth > _NESTED:
                    return None
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            i += 1
        if depth:
            return None
        target = text[start:i]
    rest = re.compile(
        r"(?:[ \t\n]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t\n]*\)", re.S
    ).match(text, i)
    if not rest:
        return None
    return _unescape(target), rest.end()


def _inline(text: str, base: int, definitions: dict, used: set, out: list) -> None:
    # Openers: (position, is_image). Links do not nest: the plain ones below `closed` open no link.
    openers: list[tuple[int, bool]] = []
    closed = 0
    # Closing marks that do not occur any more.
    missing: set[str] = set()
    i = 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text) and text[i + 1] in _ESCAPABLE:
            i += 2
            continue
        if ch == "`":
            ticks = re.compile("`+").match(text, i).group()
            close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, i + len(ticks))
            i = close.end() if close else i + len(ticks)
            continue
        if ch == "<":
            mark = next((end for begin, end in _MARKED if text.startswith(begin, i)), None)
            if mark is not None and mark not in missing and text.find(mark, i) < 0:
                missing.add(mark)
            skip = _AUTOLINK.match(text, i) or (_HTML_TAG.match(text, i) if mark not in missing else None)
            i = skip.end() if skip else i + 1
            continue
        if ch == "!" and text[i + 1 : i + 2] == "[":
            openers.append((i, True))
            i += 2
            continue
        if ch == "[":
            openers.append((i, False))
            i += 1
            continue
        if ch != "]" or not openers:
            i += 1
            continue
        start, is_image = openers.pop()
        active = is_image or len(openers) >= closed
        closed = min(closed, len(openers))
        if not active:
            i += 1
            continue
        inner = text[start + (2 if is_image else 1) : i][: _LABEL + 1]
        target, end, ident = None, i + 1, None
        if text[i + 1 : i + 2] == "(" and ")" not in missing:
            found = _destination(text, i + 1)
            if not found and text.find(")", i) < 0:
                missing.add(")")
            if found:
                target, end = found
        if target is None:
            ref = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S).match(text, i + 1)
            label = ref.group(1) if ref and ref.group(1).strip() else inner
            ident = _label(label) if len(label) <= _LABEL else None
            if ident in definitions:
                target, end = definitions[ident], ref.end() if ref else i + 1
        if target is None:
            i += 1
            continue
        if not is_image:
            if ident is None or ident not in used:
                if ident is not None:
                    used.add(ident)
                out.append((target, base + start))
            closed = len(openers)
        i = end


def markdown_links(body: str) -> list[tuple[str, int]]:
    """(target, offset) of inline and used reference links, in source order."""
    runs, definitions = _blocks(body)
    out: list[tuple[str, int]] = []
    used: set[str] = set()
    for base, text in runs:
        _inline(text, base, definitions, used, out)
    return sorted((t for t in out if t[0]), key=lambda t: t[1])
