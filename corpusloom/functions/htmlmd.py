"""Markdown of one HTML fragment; the per-row helper of the conversion job."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

# Elements whose content is no text of the page.
NOISE = ("script", "style", "nav", "header", "footer", "noscript")
_OPEN = re.compile("<(" + "|".join(NOISE) + ")", re.I)
# Elements nested deeper than this do not style their content; the text itself is kept.
MAX_NESTING = 256
_REFERENCE = re.compile("&(#(?:[0-9]+;|x[0-9a-f]+;)?|[a-z][a-z0-9]*;?)", re.I)
# Characters that stand for no character: one that a page lacks marks its references without an end.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {
    "p", "div", "section", "article", "main", "aside", "figure", "figcaption", "address", "dl",
    "dt", "dd", "form", "fieldset", "body", "html", "center", "details", "summary",
}


def _without_elements(html: str, opening: re.Pattern, names: tuple[str, ...]) -> str:
    """One pass from left to right: every opening that has its end tag later on goes with it.

    The end tags of each name are listed first, so an opening without one costs nothing.
    """
    ends = {name: [m.span() for m in re.finditer(f"</{name}>", html, re.I)] for name in names}
    used = dict.fromkeys(names, 0)
    out, at = [], 0
    for found in opening.finditer(html):
        if found.start() < at:
            continue
        name = found.group(1).lower()
        while used[name] < len(ends[name]) and ends[name][used[name]][0] < found.end():
            used[name] += 1
        if used[name] < len(ends[name]):
            out.append(html[at : found.start()])
            at = ends[name][used[name]][1]
    return "".join([*out, html[at:]]) if at else html


def strip_noise(html: str) -> str:
    """Remove noise elements until nothing changes."""
    while (out := _without_elements(html, _OPEN, NOISE)) != html:
        html = out
    return html


def strip_head(html: str) -> str:
    """Remove head elements; an opening without its end tag stays."""
    return _without_elements(html, re.compile("<(head)", re.I), ("head",))


def _escape(text: str) -> str:
    return re.sub(r"[\\`*_~\[\]]", r"\\\g<0>", text)


class _Node:
    """An element; `out` is its markdown once its children have theirs."""

    def __init__(self, tag: str, attrs=None):
        self.tag, self.attrs, self.children = tag, dict(attrs or []), []
        self.out = ""


class _Tree(HTMLParser):
    """A forgiving element tree: unknown end tags are dropped, open ones close with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.stack = [self.root]
        self.nodes = []

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "tr", "td", "th", "option") and self.stack[-1].tag == tag:
            self.stack.pop()
        if len(self.stack) > MAX_NESTING and tag not in _VOID:
            return
        if self._add(tag, attrs).tag not in _VOID:
            self.stack.append(self.nodes[-1])

    def _add(self, tag, attrs):
        self.nodes.append(_Node(tag, attrs))
        self.stack[-1].children.append(self.nodes[-1])
        return self.nodes[-1]

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                del self.stack[depth:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _raw_text(node) -> str:
    out, waiting = [], list(reversed(node.children))
    while waiting:
        now = waiting.pop()
        if isinstance(now, str):
            out.append(now)
        else:
            waiting += reversed(now.children)
    return "".join(out)


def _inline(node) -> str:
    return "".join(_escape(re.sub(r"\s+", " ", c)) if isinstance(c, str) else c.out for c in node.children)


def _wrap(text: str, mark: str) -> str:
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _block(text: str) -> str:
    # A run of blanks is entered at its start only, so long indents are read once.
    text = re.sub(r"(?:(?<![ \t])[ \t]++)?+\n[ \t]*+\n[ \t]*+", "\n\n", text).strip()
    return f"\n\n{text}\n\n" if text else ""


def _list(node) -> str:
    lines = []
    number = int(node.attrs.get("start") or 1) if str(node.attrs.get("start") or "1").isdigit() else 1
    for item in node.children:
        if isinstance(item, str):
            continue
        mark = f"{number}. " if node.tag == "ol" else "* "
        number += 1
        text = re.sub(r"\n{3,}", "\n\n", _inline(item)).strip()
        text = re.sub(r"\n\n(?=\s*+(?:\* |\d++\. ))", "\n", text)
        lines.append(mark + text.replace("\n", "\n" + " " * len(mark)))
    return "\n".join(lines)


def _rows(node) -> list:
    out, waiting = [], list(reversed(node.children))
    while waiting:
        now = waiting.pop()
        if not isinstance(now, str):
            if now.tag == "tr":
                out.append(now)
            else:
                waiting += reversed(now.children)
    return out


def _table(node) -> str:
    rows = [
        [re.sub(r"\s+", " ", _inline(c)).strip().replace("|", "\\|") for c in row.children if not isinstance(c, str)]
        for row in _rows(node)
    ]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(len(r) for r in rows)
    rows = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |"] + lines[1:])


def _element(node) -> str:
    tag = node.tag
    if tag in ("script", "style", "head", "template", "title"):
        return ""
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        src = node.attrs.get("src") or ""
        return f"![{node.attrs.get('alt') or ''}]({src})" if src else ""
    if tag == "pre":
        code = _raw_text(node).strip("\n")
        inner = next((c for c in node.children if not isinstance(c, str) and c.tag == "code"), None)
        language = re.search(r"language-(\S+)", (inner.attrs.get("class") or "") if inner else "")
        fence = "```"
        while fence in code:
            fence += "`"
        return f"\n\n{fence}{language.group(1) if language else ''}\n{code}\n{fence}\n\n"
    if tag in ("code", "kbd", "samp", "tt"):
        text = _raw_text(node)
        return f"`{text}`" if text else ""
    if re.fullmatch("h[1-6]", tag):
        text = re.sub(r"\s+", " ", _inline(node)).strip()
        return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
    if tag in ("ul", "ol"):
        return _block(_list(node))
    if tag == "table":
        return _block(_table(node))
    if tag == "blockquote":
        text = _block(_inline(node)).strip()
        return _block("\n".join("> " + line if line else ">" for line in text.split("\n"))) if text else ""
    inner = _inline(node)
    if tag in ("b", "strong"):
        return _wrap(inner, "**")
    if tag in ("i", "em"):
        return _wrap(inner, "_")
    if tag in ("s", "del", "strike"):
        return _wrap(inner, "~~")
    if tag == "a":
        href, text = node.attrs.get("href") or "", inner.strip()
        if not href or not text:
            return inner
        return f"<{href}>" if _raw_text(node).strip() == href else f"[{text}]({href})"
    return _block(inner) if tag in _BLOCK or tag == "li" else inner


def _set_aside(html: str, mark: str) -> str:
    """Replace the '&' of every character reference that has no semicolon or no known name."""

    def checked(found: re.Match) -> str:
        name = found.group(1)
        known = name.endswith(";") and (name[0] == "#" or name in html5)
        return found.group() if known else mark + name

    return _REFERENCE.sub(checked, html)


def to_markdown(html: str) -> str:
    mark = next((m for m in _MARKS if m not in html), "&")
    html = _set_aside(html, mark)
    tree = _Tree()
    # What follows the last '>' holds no tag; the parser would try every '<' of it to the end.
    end = html.rfind(">") + 1
    tree.feed(html[:end])
    tree.close()
    if html[end:]:
        tree.handle_data(unescape(html[end:]))
    # Elements are listed as they open, so in reverse every element comes after its children.
    for node in reversed(tree.nodes):
        node.out = _element(node)
    text = re.sub(r"(?<![ \t])[ \t]++\n", lambda m: "  \n" if m.group().startswith("  ") else "\n", _inline(tree.root))
    text = re.sub(r"\n[ \t]++(?=\n)", "\n", text)
    text = re.sub(r"\n ++(?=\S)", lambda m: m.group() if re.match(r"\n {2,}", m.group()) else "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip().replace(mark, "&")


def convert(source: str) -> str:
    """Whole-page conversion: head and noise removed, title on top if the body has no h1."""
    found = re.search(r"<title[^>]*>([^<]*)</title>", source, re.I)
    title = found.group(1).strip() if found else ""
    body = strip_noise(strip_head(source))
    text = to_markdown(body)
    if not text:
        return source
    has_h1 = re.search(r"<h1[^>]*>[\s\S]*?</h1>", body, re.I)
    return text if has_h1 or not title else f"# {title}\n\n{text}"
