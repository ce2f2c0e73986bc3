"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

A value that follows a credential's name is worth reporting if a guesser would need many tries.
The cost is the cheapest way to cut the value into dictionary words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming over its positions in log10 guesses.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, log10

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.store import prepare
from corpusloom.llm.tokens import by_bytes

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12

# Names that announce a credential anywhere in a run of name characters, a sign, and a value. A run
# is entered at its start only and never given back, so a text of any length is read once.
_NAME = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?:{}))[A-Za-z0-9_-]++[\"']?+[ \t]*+(?:=>|:=|[:=])[ \t]*+"
_CONTEXT = re.compile(
    _NAME.format("passphrase|password|passwd|passcode|pwd|secret|token|credential|api[_-]?key|private[_-]?key|authorization")
    + r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>]+))""",
    re.IGNORECASE | re.ASCII,
)
# In an authorization the credential stands after the name of a scheme.
_SCHEME = re.compile(
    _NAME.format("authorization")
    + r"""["']?(?:Bearer|Basic|Token|Negotiate|NTLM|DPoP|OAuth|Api-?Key|PrivateToken)[ \t]+["']?([^\s"'<>]+)""",
    re.IGNORECASE | re.ASCII,
)
_USERINFO = re.compile(r"://[^\s:/@]+:([^\s/@]+)@")

# Words often met in passwords, the likeliest first.
WORDS = """
password pass qwerty admin welcome login letmein dragon master monkey secret shadow sunshine princess football
baseball superman batman trustno hello freedom whatever charlie michael jordan hunter summer winter spring autumn
flower love iloveyou computer internet access root user guest test testing demo example sample default changeme
change temp temporary system server oracle mysql postgres redis mongo docker jenkins github google amazon azure
cloud data database backup public private security secure token key api auth account service manager office
company business money bank credit card phone mobile home house family baby angel daniel thomas robert george
william andrew jessica ashley nicole michelle jennifer amanda matthew joshua anthony pepper ginger cookie cheese
chocolate banana orange apple purple yellow green blue black white silver golden diamond star moon earth fire
water storm thunder lightning tiger lion eagle falcon panther wolf bear horse mustang ferrari porsche mercedes
harley soccer hockey tennis golf player killer ninja samurai pirate matrix hacker gamer player one two three
none null true false undefined your here the and for you not
""".split()

# Characters that stand for letters.
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "2": "z"}

# The rows of a keyboard, each half a key to the right of the one above.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_SEGMENT = log10(2)
_YEARS = 119
_DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}([-/._]?)\d{1,2}\1(?:19|20)\d\d|(?:19|20)\d\d([-/._]?)\d{1,2}\2\d{1,2}", re.ASCII)
_MAX_REPEAT_UNIT = 8
_KEYS = {key: (row, column + row * 0.5) for row, keys in enumerate(KEYBOARD) for column, key in enumerate(keys)}


def _alphabet(c: str) -> float:
    if c.isascii():
        if c.isdigit():
            return 1.0
        return log10(26) if c.isalpha() else log10(33)
    return 2.0


def _step(a: str, b: str) -> tuple[float, float] | None:
    """The way from one key to a neighbour; None if they are none."""
    p, q = _KEYS.get(a), _KEYS.get(b)
    if p is None or q is None or p == q:
        return None
    way = (q[0] - p[0], q[1] - p[1])
    return way if abs(way[0]) <= 1 and abs(way[1]) <= 1 else None


def _cased(text: str) -> float:
    """log10 of the ways to set the capitals of a word."""
    letters = [c for c in text if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    if upper == 0:
        return 0.0
    if upper == len(letters) or (upper == 1 and (text[0].isupper() or text[-1].isupper())):
        return log10(2)
    return log10(sum(comb(len(letters), i) for i in range(1, min(upper, len(letters) - upper) + 1)) + 1)


@dataclass(frozen=True)
class Guesser:
    """Guess costs under a list of words, the likeliest first."""

    ranks: dict[str, int]
    longest: int

    @staticmethod
    def of(words: list[str]) -> Guesser:
        ranks: dict[str, int] = {}
        for word in words:
            ranks.setdefault(word.lower(), len(ranks) + 1)
        return Guesser(ranks, max(map(len, ranks), default=0))

    def cost(self, value: str) -> float:
        """log10 of the guesses for value: the cheapest segmentation. Linear in its length."""
        n = len(value)
        lower = value.lower() if len(value.lower()) == n else value
        plain = "".join(LEET.get(c, c) for c in lower)
        ends: dict[int, list[tuple[int, float]]] = {}
        for match in _DATE.finditer(value):
            days = 0.0 if match.end() - match.start() == 4 else log10(365)
            signs = log10(4) if match[1] or match[2] else 0.0
            ends.setdefault(match.end(), []).append((match.start(), log10(_YEARS) + days + signs))
        self._walks(lower, ends)
        self._runs(lower, ends)
        repeats = self._repeats(value)
        best, brute = [0.0] * (n + 1), [float("inf")] * (n + 1)
        for i in range(1, n + 1):
            c = _alphabet(value[i - 1])
            brute[i] = min(brute[i - 1], best[i - 1] + _SEGMENT) + c
            low = brute[i]
            for start, cost in ends.get(i, ()):
                low = min(low, best[start] + cost + _SEGMENT)
            for size in range(3, min(self.longest, i) + 1):
                rank = self.ranks.get(plain[i - size : i])
                text = value[i - size : i]
                if rank is None:
                    rank, swapped = self.ranks.get(lower[i - size : i]), 0
                else:
                    swapped = sum(a != b for a, b in zip(plain[i - size : i], lower[i - size : i]))
                if rank is not None:
                    low = min(low, best[i - size] + log10(rank) + _cased(text) + swapped * log10(2) + _SEGMENT)
            for start, unit in repeats.get(i, ()):
                once = best[start + unit]
                low = min(low, once + log10((i - start) / unit) + _SEGMENT)
            best[i] = low
        return best[n]

    @staticmethod
    def _walks(lower: str, ends: dict[int, list[tuple[int, float]]]) -> None:
        start, turns, way = 0, 0, None
        for i in range(1, len(lower)):
            step = _step(lower[i - 1], lower[i])
            if step is None:
                start, turns, way = i, 0, None
                continue
            turns += step != way
            way = step
            if i + 1 - start >= 3:
                cost = log10(len(_KEYS)) + log10(i + 1 - start) + turns * log10(5)
                ends.setdefault(i + 1, []).append((start, cost))

    @staticmethod
    def _runs(lower: str, ends: dict[int, list[tuple[int, float]]]) -> None:
        """Alphabetic and numeric runs, up or down: abc, 987."""
        start, step = 0, 0
        for i in range(1, len(lower)):
            now = ord(lower[i]) - ord(lower[i - 1])
            same_kind = lower[i].isalnum() and lower[i - 1].isalnum()
            if now not in (1, -1) or not same_kind:
                start, step = i, 0
                continue
            if now != step:
                start, step = i - 1, now
            if i + 1 - start >= 3:
                ends.setdefault(i + 1, []).append((start, log10(26) + log10(i + 1 - start) + log10(2)))

    @staticmethod
    def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
        """By end: where a unit of up to 8 characters is repeated back to back, as (start, unit)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for unit in range(1, _MAX_REPEAT_UNIT + 1):
            run = 0
            for i in range(unit, len(value)):
                run = run + 1 if value[i] == value[i - unit] else 0
                if run and run % unit == 0 and run + unit >= 3:
                    found.setdefault(i + 1, []).append((i + 1 - run - unit, unit))
        return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, int]], guesser: Guesser, least: float) -> list[tuple[int, int, int]]:
    """Values in credential contexts that cost 10^least guesses or more and do not lie within a base span."""
    if ":" not in text and "=" not in text:
        return []
    found, taken = [], 0
    places = [m.span(m.lastindex) for m in _CONTEXT.finditer(text)]
    places += [m.span(1) for pattern in (_SCHEME, _USERINFO) for m in pattern.finditer(text)]
    for start, end in sorted(set(places)):
        if end <= taken or any(a <= start and end <= b for a, _, b in base):
            continue
        if guesser.cost(text[start:end]) >= least:
            found.append((start, 3, end))
            taken = end
    return found


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] = WORDS, least_log10: float = 10.0,
    mark: str | None = None,
) -> DataFrame:
    """One row per document: the id, counts and spans, and with `mark` the text with spans replaced.

    Columns: id, n_assign, n_access, n_hex, n_guess (long), base_spans, spans (string,
    kind:start:end in code points), and redacted (string) if mark is given. Null and empty
    texts have no spans; a null text stays null when redacted. Repeated rows give repeated
    rows; other columns of docs are not read. `words` is the guesser's dictionary, the
    likeliest first; values below 10^least_log10 guesses are taken for placeholders.
    """
    prepare(docs.sparkSession)
    guesser = Guesser.of(words)
    schema = "id {}, n_assign long, n_access long, n_hex long, n_guess long, base_spans string, spans string".format(
        dict(docs.dtypes)[id_col]
    ) + (", redacted string" if mark is not None else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            counts: list[list[int]] = [[], [], [], []]
            base_out, out, texts = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + guessed_spans(text or "", base, guesser, least_log10))
                for kind in range(4):
                    counts[kind].append(sum(s[1] == kind for s in spans))
                base_out.append(_written(base))
                out.append(_written(spans))
                if mark is not None:
                    texts.append(redacted(text, spans, mark) if text and spans else text)
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(out, pa.string())]
            names = ["id", "n_assign", "n_access", "n_hex", "n_guess", "base_spans", "spans"]
            if mark is not None:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def redact(
    docs: DataFrame, text_col: str = "text", words: list[str] = WORDS, least_log10: float = 10.0, mark: str = "[SECRET]",
) -> DataFrame:
    """docs, all rows and columns, with every span found in the text replaced by mark."""
    prepare(docs.sparkSession)
    guesser = Guesser.of(words)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            texts = []
            for text in batch.column(place).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + guessed_spans(text or "", base, guesser, least_log10))
                texts.append(redacted(text, spans, mark) if spans else text)
            columns = batch.columns
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
