"""Language-model scoring with a hidden Markov model.

States are latent; a state emits a common word itself, or a class of rare words of which one is
drawn by its corpus count. Common words are all those that the training texts have a fixed
number of times or more, so the symbols grow with the corpus. Baum-Welch counts of all training texts are summed across partitions; a text's
likelihood is exact, by the scaled forward recursion over the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.samples import crc_mod
from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import SPACED, Words, by_bytes, mix, words_of

# Rare words fall into classes by length and by whether they are plain letters.
RARE = 8
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
# Training cuts longer texts into sequences of so many tokens; scoring never cuts.
SEQUENCE = 4096
# A task of the training reads so many tokens per symbol, or all: its sums have a row per symbol,
# so the rows of all tasks are at most the tokens by this number.
TOKENS_PER_SYMBOL = 64
# Tokens that a task works on at once, except for a single longer text.
BLOCK = 1 << 20


def _rare_class(words: Words) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum(_LETTER[words.data], dtype=np.int64)])
    size = words.end - words.start
    letters = plain[words.end] - plain[words.start] == size
    return np.minimum((size - 1) // 4, 3) * 2 + letters


def _known(common: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the sorted common hashes, whether it is there)."""
    place = np.searchsorted(common, own)
    hit = place < len(common)
    hit[hit] = common[place[hit]] == own[hit]
    return place, hit


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, kind, c): how often the training texts have each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED, lower=True)
            own, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            kind = _rare_class(words)[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(kind), pa.array(n)], ["word", "kind", "n"])

    rows = train.select("text").mapInArrow(run, "word long, kind int, n long")
    return rows.groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("c"))


def _sequences(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(id, key, held, classes): the class of every token; the last is the end of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED, lower=True)
            n = len(shared.value)
            place, hit = _known(shared.value, words.hash.view(np.int64))
            own = np.where(hit, place, n + 1 + _rare_class(words))
            ends = words.first + np.arange(len(words.first))
            classes = np.full(ends[-1], n, np.int32)
            classes[np.arange(len(own)) + words.row] = own
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(classes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "held")), lists], ["id", "key", "held", "classes"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long, held boolean, classes array<int>")


def _rare_words(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(word, key, n): the rare words of each text, and how often."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED, lower=True)
            _, hit = _known(shared.value, words.hash.view(np.int64))
            rare = np.flatnonzero(~hit)
            row = words.row[rare]
            own = mix(words.hash[rare] ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            _, at, n = np.unique(own, return_index=True, return_counts=True)
            # In the order of the texts, equal keys follow each other and shrink in the shuffle.
            order = np.argsort(at)
            at, n = at[order], n[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.hash[rare][at].view(np.int64)), batch.column("key").take(pa.array(row[at])), pa.array(n)],
                ["word", "key", "n"],
            )

    return rows.select("key", "text").mapInArrow(run, "word long, key long, n int")


@dataclass
class Model:
    """start[s], move[s, t], emit[class, s]: probabilities of the hidden Markov model."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _by_time(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with the first tokens of all sequences first, then all second ones, and so on.

    Longer sequences come first, so those that have a token t are the first ones of each part.
    Also returned: where each part begins (and the last ends), and the order of the sequences.
    """
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    alive = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(int(lengths.max(initial=0))), "right")
    start = np.concatenate([[0], np.cumsum(alive)]).astype(np.int64)
    time = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty_like(classes)
    out[start[time] + np.repeat(rank, lengths)] = classes
    return out, start, order


def forward(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each of consecutive sequences, all advanced token by token together."""
    classes, start, order = _by_time(classes, lengths)
    out = np.zeros(len(lengths))
    state = np.repeat(model.start[None, :], len(lengths), 0)
    for t, (low, high) in enumerate(zip(start[:-1].tolist(), start[1:].tolist())):
        n = high - low
        state = (state[:n] if t == 0 else state[:n] @ model.move) * model.emit[classes[low:high]]
        scale = state.sum(1)
        state /= scale[:, None]
        out[:n] += np.log10(scale)
    result = np.empty(len(lengths))
    result[order] = out
    return result


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions (class, state) of consecutive sequences."""
    classes, start, _ = _by_time(classes, lengths)
    states, parts = len(model.start), list(zip(start[:-1].tolist(), start[1:].tolist()))
    emitted = model.emit[classes]
    ahead, scales = np.empty((len(classes), states)), np.empty(len(classes))
    state = np.repeat(model.start[None, :], len(lengths), 0)
    for t, (low, high) in enumerate(parts):
        n = high - low
        state = (state[:n] if t == 0 else state[:n] @ model.move) * emitted[low:high]
        scale = state.sum(1)
        state /= scale[:, None]
        ahead[low:high], scales[low:high] = state, scale
    emitted /= scales[:, None]
    moves = np.zeros((states, states))
    back = np.ones((0, states))
    for t in range(len(parts) - 1, 0, -1):
        low, high = parts[t]
        n, before = high - low, parts[t - 1][0]
        weighted = emitted[low:high]
        # Texts that end here go on with a value of one.
        weighted[: len(back)] *= back
        moves += ahead[before : before + n].T @ weighted
        back = weighted @ model.move.T
        ahead[before : before + n] *= back
    begin = ahead[: parts[0][1]].sum(0) if parts else np.zeros(states)
    emissions = np.stack([np.bincount(classes, ahead[:, s], len(model.emit)) for s in range(states)], axis=1)
    return begin, moves * model.move, emissions


def _blocks(batches: Iterator[pa.RecordBatch], cut: int | None) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches joined to blocks of about BLOCK tokens: (batches, classes, lengths of the sequences)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        low, ends = 0, np.cumsum(batch.column("classes").value_lengths().to_numpy(zero_copy_only=False))
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + BLOCK - size, "right")))
            held.append(batch.slice(low, high - low))
            size += int(ends[high - 1]) - before
            low = high
            if size >= BLOCK or low < batch.num_rows:
                yield _joined(held, cut)
                held, size = [], 0
    if held:
        yield _joined(held, cut)


def _joined(held: list[pa.RecordBatch], cut: int | None) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
    classes = np.concatenate([b.column("classes").flatten().to_numpy(zero_copy_only=False) for b in held])
    lengths = np.concatenate([b.column("classes").value_lengths().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
    if cut is not None and lengths.max(initial=0) > cut:
        parts = -(-lengths // cut)
        whole = np.full(int(parts.sum()), cut, np.int64)
        whole[np.cumsum(parts) - 1] = lengths - (parts - 1) * cut
        lengths = whole
    return held, classes, lengths


def _improved(train: DataFrame, model: Model) -> Model:
    """One round of Baum-Welch over all training texts; the sums have a row per class and kind."""
    shared = train.sparkSession.sparkContext.broadcast(vars(model))
    states, size = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        total = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states))]
        for _, classes, lengths in _blocks(batches, SEQUENCE):
            for whole, part in zip(total, expected_counts(own, classes, lengths)):
                whole += part
        rows = np.concatenate([total[2], total[1], total[0][None, :]])
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(rows[some, s]) for s in range(states))], ["row", *(f"s{s}" for s in range(states))]
        )

    schema = "row long, " + ", ".join(f"s{s} double" for s in range(states))
    sums = train.select("classes").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)])
    found = sums.toPandas()
    rows = np.zeros((size + states + 1, states))
    rows[found["row"].to_numpy(int)] = found[[f"s{s}" for s in range(states)]].to_numpy(float)
    emit, move, start = rows[:size] + 0.5 / states, rows[size : size + states] + 0.5, rows[-1] + 0.5
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def score(
    docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", states: int = 6,
    iterations: int = 3, fewest: int = 100, seed: int = 3,
) -> DataFrame:
    """Score every document, learning from those for which held_out does not hold.

    Columns: id, held_out, n_tokens, n_known, train_tokens (long), base_score (add-half unigram)
    and score (the hidden Markov model), both log10 of the whole text's probability. Words are
    lower-cased in A to Z; each text ends with an end token, so null and empty texts have one
    token. Rows with the same id and text share their values. held_out defaults to a fifth of
    the rows, by crc32 of the id. With no training rows every base score is 0. Every word that
    the training texts have `fewest` times or more is a symbol; the driver and each task hold
    the symbols' probabilities.
    """
    prepare(docs.sparkSession)
    held = crc_mod(id_col, 5) == 1 if held_out is None else held_out
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), held.alias("held"), F.col(text_col).alias("text")
    )
    words = written(_word_counts(rows.where("not held")))
    often = words.where(F.col("c") >= fewest).select("word", "c").toPandas().sort_values("word")
    common = often["word"].to_numpy(np.int64)
    learned = words.where(F.col("c") < fewest)
    n, size = len(common), len(common) + 1 + RARE
    texts = written(_sequences(rows, common))
    train = texts.where("not held")
    # Of every symbol: words, the end that each training text has, and the classes of rare words.
    counts = np.zeros(size)
    counts[:n], counts[n] = often["c"].to_numpy(), train.select("key").count()
    distinct = np.zeros(RARE)
    for kind, number, times in learned.groupBy("kind").agg(F.count("*"), F.sum("c")).collect():
        distinct[kind], counts[n + 1 + kind] = number, times
    # Every rare word's training count is joined to each text that has it; none means no training text does.
    rare = _rare_words(rows, common).join(learned.select("word", "c"), "word", "left")
    times = F.coalesce("c", F.lit(0))
    rare_sums = written(rare.groupBy("key").agg(
        F.sum(F.col("n") * F.log10(times + 0.5)).alias("rare_log"), F.sum(F.when(times > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    ))
    total, vocabulary = counts.sum(), float((counts[: n + 1] > 0).sum() + distinct.sum())
    random = np.random.default_rng(seed)
    # States that tend to stay and like different words leave the symmetric start fast.
    emit = (counts + 0.5)[:, None] * random.exponential(1.0, (size, states))
    move = 0.8 * np.eye(states) + 0.2 / states
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(0))
    tasks = max(1, int(total) // (TOKENS_PER_SYMBOL * size))
    train = train.coalesce(tasks) if tasks < train.rdd.getNumPartitions() else train
    for _ in range(iterations if total else 0):
        model = _improved(train, model)
    each = np.concatenate([np.log10(counts[: n + 1] + 0.5), np.zeros(RARE)])
    within = np.concatenate([np.zeros(n + 1), -np.log10(counts[n + 1 :] + 0.5 * (distinct + 1))])
    whole = float(np.log10(total + 0.5 * (vocabulary + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((vars(model), each, within, np.append(counts[: n + 1] > 0, np.zeros(RARE, bool))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own_log, inside, seen = shared.value
        for blocks, classes, lengths in _blocks(batches, None):
            begin = np.cumsum(lengths) - lengths
            hidden = forward(Model(**parts), classes, lengths) + np.add.reduceat(inside[classes], begin)
            columns = [np.add.reduceat(own_log[classes], begin), np.add.reduceat(seen[classes].astype(np.int64), begin), hidden, lengths]
            ids, keys, helds = (pa.concat_arrays([b.column(c) for b in blocks]) for c in ("id", "key", "held"))
            yield pa.RecordBatch.from_arrays([ids, keys, helds, *map(pa.array, columns)], ["id", "key", "held", "log", "known", "hidden", "n"])

    scored = texts.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long, held boolean, log double, known long, hidden double, n long")
    # Rows that are repeated add up to one sum per key.
    times = texts.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    rare_each = rare_sums.join(times, "key", "left").select(
        "key", (F.col("rare_log") / F.coalesce("times", F.lit(1))).alias("rare_log"),
        (F.col("rare_known") / F.coalesce("times", F.lit(1))).cast("long").alias("rare_known"),
    )
    joined = scored.join(rare_each, "key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log") + rare_log - F.col("n") * F.lit(whole)).alias("base_score"), (F.col("hidden") + rare_log).alias("score"),
    )
