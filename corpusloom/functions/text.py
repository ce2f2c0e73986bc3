"""Text normalisation, query terms and slugs.

Everything runs on JVM columns. Unicode normal forms are the one thing Spark has
no built-in for; the Python function receives NULL unless a value holds a character
that a normal form could change, so ordinary text never crosses to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# The whitespace class the reference's regular expressions use.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Ranges whose characters no normal form (NFC, NFKC) changes, alone or side by side.
STABLE_RANGES = [
    (0x00, 0x9F), (0xA1, 0xA7), (0xBF, 0x131), (0x400, 0x481), (0x2012, 0x2015),
    (0x2018, 0x201E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF),
]
# The outer ranges only let ordinary letters fail fast; a bare negated class is ten times slower.
_UNSTABLE = (
    r"[\x{A0}-\x{BE}\x{132}-\x{10FFFF}&&[^"
    + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in STABLE_RANGES)
    + "]]"
)
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_CJK_RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+"

# Punctuation, symbols and white space; plain lower-case letters and digits are ruled out first.
SEPARATORS = rf"[[^a-z0-9]&&[\p{{P}}\p{{S}}{SPACE}]]+"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _utf16_left(values: pd.Series, units: pd.Series) -> pd.Series:
    def cut(value, n):
        if value is None:
            return None
        return value.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore")

    return pd.Series([cut(v, n) for v, n in zip(values, units)], dtype="object")


def _unstable_only(c: Column) -> Column:
    return F.when(c.rlike(_UNSTABLE), c)


def nfc(c: Column) -> Column:
    return F.coalesce(_nfc(_unstable_only(c)), c)


def nfkc(c: Column) -> Column:
    return F.coalesce(_nfkc(_unstable_only(c)), c)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def left_units(c: Column, n: int) -> Column:
    """The first n UTF-16 units; code points on the JVM unless astral characters occur."""
    astral = _utf16_left(F.when(c.rlike(_ASTRAL), c), F.lit(n))
    return F.coalesce(astral, F.substring(c, 1, n))


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.btrim(F.regexp_replace(c, f"[{SPACE}]+", " "), F.lit(" "))


def blank_to_null(c: Column) -> Column:
    """NULL unless the string has a non-space character."""
    return F.when(trim_space(c) != "", c)


def fold(c: Column) -> Column:
    """Lower case and NFKC, the shared first half of normalisation."""
    return nfkc(F.lower(c))


def normalize_text(c: Column) -> Column:
    """Lower-cased NFKC words separated by one space; punctuation and symbols separate words."""
    runs = F.regexp_replace(fold(c), SEPARATORS, " ")
    return F.btrim(F.coalesce(runs, F.lit("")), F.lit(" "))


def compact_text(normalized: Column) -> Column:
    """Normalised text without its spaces.

    A term is contained in a text or in its compact form exactly when the compact
    term is contained in the compact text, so matching only needs this form.
    """
    return F.replace(normalized, F.lit(" "), F.lit(""))


def compact_fold(c: Column) -> Column:
    """compact_text(normalize_text(c)) in one regular expression pass."""
    return F.coalesce(F.regexp_replace(fold(c), SEPARATORS, ""), F.lit(""))


def _grams(run: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(run) - F.lit(size - 1))
    return F.when(
        F.length(run) >= size, F.transform(starts, lambda i: F.substring(run, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def terms_of(normalized: Column, most: int | None = None) -> Column:
    """Query terms of normalised text: phrase, compact phrase, words, Latin runs, CJK 2/3-grams.

    All distinct ones, or the first `most`.
    """
    none = F.array().cast("array<string>")
    squeezed = compact_text(normalized)
    long_word = lambda w: (F.length(w) >= 2) | (F.octet_length(w) == 4)
    runs = F.regexp_extract_all(normalized, F.lit(_CJK_RUN), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 2), _grams(r, 3))))
    terms = F.concat(
        F.when(normalized != "", F.array(normalized)).otherwise(none),
        F.when((squeezed != "") & (squeezed != normalized), F.array(squeezed)).otherwise(none),
        F.filter(F.split(normalized, " "), long_word),
        F.regexp_extract_all(normalized, F.lit("[a-z0-9]{2,}"), F.lit(0)),
        grams,
    )
    terms = F.array_distinct(terms)
    return terms if most is None else F.slice(terms, 1, most)


def query_terms(c: Column, most: int | None = None) -> Column:
    return terms_of(normalize_text(c), most)


# Names that may not become file names as they are.
_DEVICE = "con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³]"
_RESERVED = "index|log"
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_FULL_WIDTH_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
SLUG_UNITS = 80
# Titles whose slug needs a normal form or a cut by UTF-16 units.
_HARD_TITLE = f"{_UNSTABLE}|{_ASTRAL}"


def slug_of(title: str) -> str:
    """Slug of one title; the pandas path for the few titles the JVM path cannot take."""
    words = title.translate(str.maketrans(_FULL_WIDTH, _FULL_WIDTH_TO)).lower()
    kept = [c for c in unicodedata.normalize("NFC", words)
            if c in "-" + SPACE_CHARS or unicodedata.category(c)[0] in "LN"]
    joined = re.sub(f"[{re.escape(SPACE_CHARS)}-]+", "-", "".join(kept).strip(SPACE_CHARS)).strip("-")
    cut = joined.encode("utf-16-le")[: 2 * SLUG_UNITS].decode("utf-16-le", "ignore").strip("-")
    if re.fullmatch(_DEVICE, cut):
        return "_" + cut
    return cut + "-page" if re.fullmatch(_RESERVED, cut) else cut or "untitled"


@F.pandas_udf(T.StringType())
def _slug(titles: pd.Series) -> pd.Series:
    return titles.map(slug_of, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _slug_array(titles: pd.Series) -> pd.Series:
    return titles.map(lambda ts: [slug_of(t) for t in ts], na_action="ignore")


def _plain_slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), rf"[^\p{{L}}\p{{N}}{SPACE}-]", "")
    joined = F.btrim(F.regexp_replace(trim_space(kept), rf"[{SPACE}-]+", "-"), F.lit("-"))
    slug = F.btrim(F.substring(joined, 1, SLUG_UNITS), F.lit("-"))
    slug = F.regexp_replace(slug, r"^\z", "untitled")
    slug = F.regexp_replace(slug, rf"^({_DEVICE})\z", "_$1")
    return F.regexp_replace(slug, rf"^({_RESERVED})\z", "$1-page")


def slugify(title: Column) -> Column:
    """Kebab-case page slug that keeps Unicode letters and digits."""
    return F.coalesce(_slug(F.when(title.rlike(_HARD_TITLE), title)), _plain_slug(title))


def slugify_all(titles: Column) -> Column:
    """Slugs of an array of titles."""
    hard = F.exists(titles, lambda t: t.rlike(_HARD_TITLE))
    return F.coalesce(_slug_array(F.when(hard, titles)), F.transform(titles, _plain_slug))


def observation_slug(title: Column, day: Column) -> Column:
    """ASCII slug of an observation, prefixed with its day."""
    base = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    base = F.regexp_replace(base, r"^-|-\z", "")
    return F.concat(F.lit("obs-"), day, F.lit("-"), F.substring(base, 1, 60))


def valid_insight_slug(slug: Column) -> Column:
    return slug.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*\z") & ~slug.isin("index", "log")


def path_title(doc_id: Column) -> Column:
    last = F.element_at(F.split(doc_id, "/"), -1)
    return F.when(last != "", last).otherwise(F.lit("Untitled"))


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def guarded(convert, fallback=lambda text: text):
    """A text function for one row that never fails: lone surrogates become U+FFFD, and a text
    it cannot handle takes the fallback."""

    def safe(text):
        try:
            out = convert(text)
        except (ValueError, RecursionError, OverflowError, MemoryError):
            out = fallback(text)
        return out if out is None or out.isascii() else out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return safe
