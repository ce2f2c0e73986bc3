"""Quality rules: how far a text's characters and common words are from those of its language.

Per language the corpus gives two references: the mix of character classes, and the shares of
its common words. A document's histograms are compared to them by the Jensen-Shannon distance
(base 2, 0 to 1). Short texts are not judged by distances that their length makes uncertain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.store import prepare
from corpusloom.llm.tokens import SPACED, Words, buffer_of, by_bytes, mix, span_hash, windows, words_of

# Character classes by the first UTF-8 byte; 0 is the rest of a longer character.
CLASSES = ("lower", "upper", "digit", "blank", "point", "symbol", "beyond_ascii")
_CLASS = np.full(256, 0, np.uint8)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[c for c in range(128) if _CLASS[c] == 0]] = 6
_CLASS[0xC0:] = 7

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _duplicates(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return later


def _lines_repeated(words: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line, character by character."""
    out = np.zeros(len(words.first) - 1, np.int64)
    if not len(words.hash):
        return out
    data = words.data
    # A line is its own kind of word: everything but the line feed.
    begins = np.union1d(np.flatnonzero(data == 10) + 1, words.at[:-1])
    begins = begins[begins < len(data)]
    with_word = np.unique(np.searchsorted(begins, words.start, "right") - 1)
    start = begins[with_word]
    stops = np.union1d(np.flatnonzero(data == 10), words.at[1:])
    end = stops[np.searchsorted(stops, start, "right")]
    row = np.searchsorted(words.at, start, "right") - 1
    key = mix(span_hash(data, start, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    np.add.at(out, row[_duplicates(key)], 1)
    return out


def _words_repeated(words: Words, k: int = 5) -> np.ndarray:
    """Per text: words inside a window of k words that is found twice or more in the text."""
    value, begin = windows(words, k)
    row = words.row
    key = mix(value + row[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, place, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = begin[n[place] > 1]
    change = np.zeros(len(words.hash) + 1, np.int64)
    change[twice] += 1
    np.subtract.at(change, twice + k, 1)
    return np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=len(words.counts)).astype(np.int64)


def _classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of each class, per text."""
    kind = _CLASS[data]
    return np.stack([_per_text(kind == c, at) for c in range(1, 8)], axis=1)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) of the rows of p and q."""
    middle = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / middle), 0.0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = batch.column("lang").fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """(lang, word) of all words that could make up a share of `least` of a language's words.

    Such a word has that share in some batch at least, and a batch has at most 1 / least of
    them per language: the rows grow with the number of batches only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            names, lang = _languages(batch)
            words = words_of(batch.column("text"), SPACED, lower=True)
            each = lang[words.row]
            for code, name in enumerate(names):
                own, n = np.unique(words.hash[each == code], return_counts=True)
                often = own[n >= least * n.sum()].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(often), pa.string()), pa.array(often)], ["lang", "word"])

    return rows.mapInArrow(run, "lang string, word long").distinct()


def _counted(rows: DataFrame, candidates: dict[str, np.ndarray]) -> DataFrame:
    """(lang, kind, key, n): exact counts of candidate words, of all words, and of character classes."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for batch in by_bytes(batches):
            names, lang = _languages(batch)
            words = words_of(batch.column("text"), SPACED, lower=True)
            each, classes = lang[words.row], _classes(*buffer_of(batch.column("text")))
            for code, name in enumerate(names):
                known = shared.value.get(name, np.zeros(0, np.int64))
                own = words.hash[each == code].view(np.int64)
                place = np.searchsorted(known, own)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == own[hit]
                found = np.bincount(place[hit], minlength=len(known))
                old = totals.get(name)
                new = [found, np.array([len(own)]), classes[lang == code].sum(0)]
                totals[name] = new if old is None else [a + b for a, b in zip(old, new)]
        for name, parts in totals.items():
            known = shared.value.get(name, np.zeros(0, np.int64))
            kind = np.repeat([0, 1, 2], [len(known), 1, len(CLASSES)])
            key = np.concatenate([known, [0], np.arange(len(CLASSES))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(key), pa.string()), pa.array(kind), pa.array(key), pa.array(np.concatenate(parts))],
                ["lang", "kind", "key", "n"],
            )

    counted = rows.mapInArrow(run, "lang string, kind long, key long, n long")
    return counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = 50, least: float = 0.005) -> dict[str, tuple]:
    """By language: (hashes of its common words in order, their shares and that of the rest, class shares).

    Common words are those with a share of `least` or more of all words of the language, at
    most `common`, ties in the order of their hash. Null is a language of its own.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = _candidates(rows, least).toPandas()
    candidates = {name: np.sort(group["word"].to_numpy(np.int64)) for name, group in found.groupby("lang")}
    counted = _counted(rows, candidates).toPandas()
    out = {}
    for name, group in counted.groupby("lang"):
        n_words = int(group.loc[group.kind == 1, "n"].sum())
        top = group[(group.kind == 0) & (group.n >= least * n_words)].sort_values(["n", "key"], ascending=[False, True])[:common]
        top = top.sort_values("key")
        shares = _shares(np.append(top.n.to_numpy(float), n_words - top.n.sum()))
        classes = _shares(group[group.kind == 2].sort_values("key").n.to_numpy(float))
        out[name] = (top.key.to_numpy(np.int64), shares, classes)
    return out


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class_distance: float = 0.3,
    max_word_distance: float = 0.4, least_chars: int = 200, least_words: int = 100, least_kept_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """One row per document: counts, both distances and the verdict.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    class_distance, word_distance (double, null under least_chars characters or least_words
    words), base_failed, kept (boolean). Null texts count as empty and fail for having too few
    words. A document is kept if it passes the base rule and no distance exceeds its limit.
    Repeated rows give repeated rows; a null language has a reference of its own.
    """
    reference = references(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED)
            lowered = words_of(batch.column("text"), SPACED, lower=True)
            data, at = words.data, words.at
            n_words, classes = words.counts, _classes(data, at)
            leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            chars = leads[words.end] - leads[words.start]
            word_chars = np.bincount(words.row, chars, len(n_words)).astype(np.int64)
            repeated = _words_repeated(words)
            names, lang = _languages(batch)
            class_distance, word_distance = np.zeros(len(n_words)), np.zeros(len(n_words))
            each, row = lang[words.row], words.row
            for code, name in enumerate(names):
                known, word_shares, class_shares = shared.value[name]
                mine = lang == code
                class_distance[mine] = divergence(_shares(classes[mine].astype(float)), class_shares)
                own = lowered.hash[each == code].view(np.int64)
                place = np.searchsorted(known, own)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == own[hit]
                slot = np.where(hit, place, len(known))
                width = len(known) + 1
                histogram = np.bincount(row[each == code] * width + slot, minlength=len(n_words) * width).reshape(-1, width)
                word_distance[mine] = divergence(_shares(histogram[mine].astype(float)), word_shares)
            short_chars, short_words = classes.sum(1) < least_chars, n_words < least_words
            failed = (n_words < least_kept_words) | (100 * repeated > max_repeat_percent * n_words)
            far = (~short_chars & (class_distance > max_class_distance)) | (~short_words & (word_distance > max_word_distance))
            columns = [
                batch.column("id"), pa.array(n_words), pa.array(word_chars), pa.array(_per_text(_SYMBOLS[data], at)),
                pa.array(_lines_repeated(words)), pa.array(repeated), pa.array(class_distance, mask=short_chars),
                pa.array(word_distance, mask=short_words), pa.array(failed), pa.array(~failed & ~far),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    schema = (
        f"id {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "class_distance double, word_distance double, base_failed boolean, kept boolean"
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
