from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.paths import encode_path, escape_label, resolve_markdown_target


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", expr(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


# Titles by what their slug shows: words, other scripts, widths, marks, device and page names, length.
SLUGS = [
    ("Tidal Power in Wales", "tidal-power-in-wales"), ("  spaced   out ", "spaced-out"), ("one -- two", "one-two"), ("-edge-", "edge"),
    ("潮汐 発電", "潮汐-発電"), ("Strom für Öre", "strom-für-öre"), ("Ｗｉｄｅ　９９", "wide-99"), ("㉓", "㉓"), ("?!", "untitled"), ("", "untitled"),
    ("prn", "_prn"), ("Com7", "_com7"), ("lpt²", "_lpt²"), ("auxiliary", "auxiliary"), ("LOG", "log-page"), ("Index", "index-page"),
    ("logs", "logs"), ("z" * 90, "z" * 80), ("z" * 78 + "-yy", "z" * 78 + "-y"), ("z" * 79 + "-y", "z" * 79), ("z" * 79 + "𝒳", "z" * 79),
]


def test_slugs(spark):
    assert column(spark, [t for t, _ in SLUGS], text.slugify) == [s for _, s in SLUGS]


def test_slug_arrays_match_single_slugs(spark):
    df = spark.createDataFrame([([t for t, _ in SLUGS],), (["Plain One", "x"],)], "a array<string>")
    got = [r[0] for r in df.select(text.slugify_all(F.col("a"))).collect()]
    assert got == [[s for _, s in SLUGS], ["plain-one", "x"]]


def test_stable_ranges_never_change():
    for low, high in text.STABLE_RANGES:
        for code in range(low, high + 1):
            char = chr(code).lower()
            assert unicodedata.normalize("NFKC", char) == char
            assert unicodedata.normalize("NFC", char) == char


def test_unstable_class_is_the_complement(spark):
    codes = [c for c in range(0x20, 0x11000) if not 0xD800 <= c <= 0xDFFF]
    stable = {c for low, high in text.STABLE_RANGES for c in range(low, high + 1)}
    flagged = column(spark, [chr(c) for c in codes], lambda c: c.rlike(text._UNSTABLE))
    assert [c for c, hit in zip(codes, flagged) if hit == (c in stable)] == []


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Foo-Bar_baz.qux/x\\y", "foo bar baz qux x y"), ("  A—B!  ", "a b"), ("ＡＢ①", "ab1"),
        ("继续学习pi", "继续学习pi"), ("a b　c", "a b c"), ("ﬁle", "file"), ("", ""),
    ],
)
def test_normalize(spark, value, expected):
    assert column(spark, [value], text.normalize_text) == [expected]


def test_query_terms(spark):
    got = column(spark, ["Login form!", "继续学习pi", "x", "", "日本"], text.query_terms)
    assert got[0] == ["login form", "loginform", "login", "form"]
    assert got[1] == ["继续学习pi", "pi", "继续", "续学", "学习", "继续学", "续学习"]
    assert got[2] == ["x"]
    assert got[3] == []
    assert got[4] == ["日本"]


def test_terms_are_capped(spark):
    assert len(column(spark, [" ".join(f"word{i}" for i in range(60))], text.query_terms)[0]) == 62


def test_utf16_cut(spark):
    assert column(spark, ["ab𐐀cd", "abcdef"], lambda c: text.left_units(c, 3)) == ["ab", "abc"]
    assert column(spark, ["ab𐐀cd"], lambda c: text.left_units(c, 4)) == ["ab𐐀"]


def test_observation_slug(spark):
    got = column(spark, ["Hello, World!", "中文"], lambda c: text.observation_slug(c, F.lit("2024-01-02")))
    assert got == ["obs-2024-01-02-hello-world", "obs-2024-01-02-"]


def test_insight_slug(spark):
    values = ["a-b1", "index", "log", "../x", "A", "a--b", "a-", "a\n"]
    assert column(spark, values, text.valid_insight_slug) == [True] + [False] * 7


TARGETS = [
    ("/plans/2031/kiln.md?v=9", "concept", "plans/2031/kiln"), ("../glazes/ash%20blue.md", "concept", "glazes/ash blue"),
    ("ftp://kiln.example/x.md", "external", None), ("TEL:1", "external", None),
    ("../../../up.md", "escape", None), ("/../x.md", "escape", None), ("ash%G1.md", "invalid", None),
    ("ash%FE.md", "invalid", None), ("/plans/2031", "empty", None), ("#firing", "empty", None), ("", "empty", None),
    ("a+b.md", "concept", "concepts/a+b"), ("./kiln/../cone.md#p?q", "concept", "concepts/cone"),
    ("a%5Cb.md", "concept", "concepts/a/b"), ("a%2Fb.md", "concept", "concepts/a/b"), ("x.md?y#z", "concept", "concepts/x"),
]


def test_link_targets(spark):
    got = column(spark, [t for t, _, _ in TARGETS], lambda c: resolve_markdown_target(c, F.lit("concepts/source")))
    assert [(r["kind"], r["dst"]) for r in got] == [(k, d) for _, k, d in TARGETS]


def test_labels_and_paths(spark):
    assert column(spark, ["Cone [6]\\"], escape_label) == ["Cone \\[6\\]\\\\"]
    values = ["ash blue glaze.md", "a/b c", "é!'()*~+&"]
    assert column(spark, values, encode_path) == [
        "ash%20blue%20glaze.md", "a/b%20c", "%C3%A9!'()*~%2B%26",
    ]
