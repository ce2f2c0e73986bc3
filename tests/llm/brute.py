"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    keyed = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in keyed.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def repeats(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    """(words, words removed, what is kept) of each text."""
    words = [spaced(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rules(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = spaced(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if spaced(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def overlaps(texts: list[str | None], items: list[tuple[object, str | None]], window: int = 13) -> list[tuple[int, int, list[str]]]:
    index = defaultdict(set)
    for name, text in items:
        words = alnum(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            index[tuple(words[i : i + n])].add(str(name))
    sizes = {len(k) for k in index}
    out = []
    for text in texts:
        words, hit, names = alnum(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = index.get(tuple(words[i : i + n]))
                if found:
                    names |= found
                    hit |= set(range(i, i + n))
        out.append((len(words), len(hit), sorted(names)))
    return out


def near_duplicates(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """id -> (shingles, smallest id that links reach); ids are unique here."""
    sets = {}
    for key, text in rows:
        w = spaced((text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def unigram(rows: list[tuple[object, str | None]], held) -> dict[object, tuple[int, int, int, float]]:
    tokens = {k: [*spaced((t or "").translate(LOWER)), None] for k, t in rows}
    counts: Counter = Counter()
    for k, own in tokens.items():
        if not held(k):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    return {
        k: (len(own), sum(counts[x] > 0 for x in own), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own))
        for k, own in tokens.items()
    }


def crc(key: object, k: int) -> int:
    return zlib.crc32(str(key).encode()) % k


def kneser_ney(texts: list[tuple[int, str]], buckets: int, discount: float = 0.75, shared: float = 4.0):
    """P(class, word before or None, word) of two bigram models interpolated with continuation counts."""
    pairs: list[dict] = [{}, {}]
    for c, text in texts:
        words = re.findall(r"[0-9a-z]+", text.lower())
        for pair in zip([None, *words], words):
            pairs[c][pair] = pairs[c].get(pair, 0) + 1
    after = [{w: sum(1 for _, x in own if x == w) for w in {w for _, w in own}} for own in pairs]
    totals = [len(own) for own in pairs]
    every = {w: sum(a.get(w, 0) for a in after) for w in {*after[0], *after[1]}}
    mass = sum(min(n, shared) for n in every.values()) + 0.1 * buckets

    def word(c: int, w: str) -> float:
        less = discount * max(totals[c] / min(totals), 1)
        kept = sum(max(n - less, 0) for n in after[c].values()) / totals[c]
        return max(after[c].get(w, 0) - less, 0) / totals[c] + (1 - kept) * (min(every.get(w, 0), shared) + 0.1) / mass

    def probability(c: int, before: str | None, w: str) -> float:
        own = list(pairs[c].values())
        less = own.count(1) / (own.count(1) + 2 * own.count(2)) if 1 in own and 2 in own else 0.75
        following = [n for (v, _), n in pairs[c].items() if v == before]
        if not following:
            return word(c, w)
        direct = max(pairs[c].get((before, w), 0) - less, 0)
        return (direct + less * len(following) * word(c, w)) / sum(following)

    return probability
