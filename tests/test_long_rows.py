"""One long row must not hold up a task: the per-row helpers on inputs that nest or never close."""

from __future__ import annotations

import time

import pytest

from corpusloom.functions.commonmark import markdown_links
from corpusloom.functions.htmlmd import to_markdown

SIZE = 400_000


@pytest.mark.parametrize("text", [
    "[a](" * (SIZE // 4), "[a](" * (SIZE // 4) + ")", "[" * SIZE, "[" * (SIZE // 2) + "]" * (SIZE // 2),
    "<!--" * (SIZE // 4), "<?x " * (SIZE // 4), "` " * (SIZE // 2), "[a]: b\n" * (SIZE // 7), "<a b='" * (SIZE // 6),
])
def test_links_of_long_texts(text):
    start = time.perf_counter()
    assert markdown_links(text) == []
    assert time.perf_counter() - start < 20


def test_many_links_in_open_brackets():
    found = markdown_links("[" * 50_000 + "[a](b.md)" * 20_000)
    assert len(found) == 20_000 and found[0] == ("b.md", 50_000)


def test_links_keep_their_rules():
    assert markdown_links("[a [b](c.md) d](e.md) ![x [y](z.md)](w.png)") == [("c.md", 3), ("z.md", 26)]
    assert markdown_links("[a](" + "(" * 32 + ")" * 32 + ") [b](c)")[-1][0] == "c"
    assert markdown_links("x <!-- [a](b.md) --> [c](d.md) <!-- [e](f.md)") == [("d.md", 21), ("f.md", 36)]


def test_indents_are_read_once():
    start = time.perf_counter()
    to_markdown("<p>" + " " * SIZE + "x</p>" + "<pre>" + (" " * 2000 + "\nx") * 100 + "</pre>")
    assert to_markdown("<ul><li>a<ul><li>b</li><li>c<ol><li>d</ol></ul><li>e</ul>") == "* a\n  * b\n  * c\n    1. d\n* e"
    assert to_markdown("a<br>b   \n <p>c</p>  \n\n  <p>d</p>") == "a  \nb\n\nc\n\nd"
    assert time.perf_counter() - start < 20
