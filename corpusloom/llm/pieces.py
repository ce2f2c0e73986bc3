"""SentencePiece encoding and decoding by streaming Viterbi search.

The best segmentation of a text maximises the sum of its pieces' scores. The search keeps the
scores of as many boundaries as the longest piece is long; ids are committed as soon as the
backpointer paths of all these boundaries meet in one boundary. No piece of the vocabulary has
a space after another character, so paths always meet where a space begins: between such places
many short stretches are searched side by side, and longer ones as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.store import prepare
from corpusloom.llm.tokens import by_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Stretches of up to so many characters are searched side by side.
SIDE_BY_SIDE = 64
CACHED = 150_000
_SPACE = "▁"
_STRETCH = re.compile(r" *[^ ]+| +")
_LINED = re.compile(r" *[^ \n]+|\n| +")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass
class Pieces:
    """A vocabulary: text, score and id of each piece, and the id of each byte (spaces are plain here)."""

    texts: list[str]
    scores: list[float]
    ids: list[int]
    bytes_: list[int]
    dummy_prefix: bool
    table: dict[str, tuple[int, float]] = field(init=False)
    longest: int = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.table = {t: (i, s) for t, i, s in zip(self.texts, self.ids, self.scores)}
        self.longest = max(map(len, self.texts), default=1)
        self.unknown = min(self.scores, default=0.0) - 10.0

    def plain(self) -> tuple:
        return self.texts, self.scores, self.ids, self.bytes_, self.dummy_prefix

    def separable(self) -> bool:
        """Whether every piece has its spaces at its beginning only."""
        return all(" " not in t.lstrip(" ") for t in self.texts)

    def decoder(self) -> dict[int, bytes]:
        out = {i: t.encode() for t, i in zip(self.texts, self.ids)}
        out.update({i: bytes([b]) for b, i in enumerate(self.bytes_)})
        return out


def load(path: str = MODEL) -> Pieces:
    """Read the pieces of a model file on the driver: normal pieces with their scores, and the byte pieces."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    texts, scores, ids, by_byte = [], [], [], {}
    for i, piece in enumerate(model.pieces):
        if piece.type in (_NORMAL, _USER):
            texts.append(piece.piece.replace(_SPACE, " "))
            scores.append(float(piece.score))
            ids.append(i)
        elif piece.type == _BYTE:
            by_byte[int(piece.piece[3:5], 16)] = i
    if len(by_byte) != 256:
        raise ValueError(f"{path} has no piece for every byte, so it cannot encode every text")
    return Pieces(texts, scores, ids, [by_byte[b] for b in range(256)], model.normalizer_spec.add_dummy_prefix)


class Stream:
    """Viterbi search over a stream of text: feed() returns the ids that are certain, close() the rest."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.text = ""
        self.base = 0
        self.best = [0.0]
        self.back: list[tuple[int, int]] = [(0, -1)]

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        longest, table = self.pieces.longest, self.pieces.table
        self.text += text
        for end in range(len(self.best), len(self.text) + 1):
            top, link = float("-inf"), (end - 1, -1)
            # Longer pieces first: of equal sums the longest last piece wins.
            for start in range(max(0, end - longest), end):
                found = table.get(self.text[start:end])
                if found is not None and self.best[start] + found[1] > top:
                    top, link = self.best[start] + found[1], (start, found[0])
            if self.text[end - 1] not in table and self.best[end - 1] + self.pieces.unknown > top:
                top, link = self.best[end - 1] + self.pieces.unknown, (end - 1, -1)
            self.best.append(top)
            self.back.append(link)
        if len(self.best) > 4 * longest:
            out = self._commit()
        return out

    def _commit(self) -> list[int]:
        """Ids up to the boundary in which the paths of all boundaries in reach meet."""
        last = len(self.best) - 1
        open_ = set(range(max(0, last - self.pieces.longest + 1), last + 1))
        while len(open_) > 1:
            high = max(open_)
            open_.remove(high)
            open_.add(self.back[high][0])
        meet = open_.pop()
        out = self._ids(meet)
        # Only what lies behind the meeting point is kept; its score becomes the new zero.
        zero = self.best[meet]
        self.text = self.text[meet:]
        self.best = [s - zero for s in self.best[meet:]]
        self.back = [(max(start - meet, 0), piece) for start, piece in self.back[meet:]]
        return out

    def _ids(self, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > 0:
            start, piece = self.back[end]
            out.append([piece] if piece >= 0 else [self.pieces.bytes_[b] for b in self.text[start:end].encode("utf-8", "replace")])
            end = start
        return list(chain.from_iterable(reversed(out)))

    def close(self) -> list[int]:
        out = self._ids(len(self.best) - 1)
        self.__init__(self.pieces)
        return out


def encode_stream(parts: Iterable[str], pieces: Pieces, step: int = 256) -> list[int]:
    """The ids of a text that comes in parts; the state kept is bounded by where paths meet."""
    stream, out = Stream(pieces), []
    for part in parts:
        for low in range(0, len(part), step):
            out += stream.feed(part[low : low + step])
    return out + stream.close()


class Searcher:
    """Encoder of whole texts: the same search, many stretches side by side."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.cache: dict[str, bytes] = {}
        prefixes: dict[str, int] = {}
        for k, text in enumerate(pieces.texts):
            for n in range(1, len(text)):
                prefixes.setdefault(text[:n], -1)
        for k, text in enumerate(pieces.texts):
            prefixes[text] = k
        keys = self._hashes(list(prefixes))
        self.bits = np.uint64(64 - max(16, int(np.ceil(np.log2(len(keys) + 1))) + 4))
        self.slots = np.full((1 << (64 - int(self.bits))) + 64, -1, np.int32)
        self.keys, self.values = keys, np.array(list(prefixes.values()), np.int32)
        self.probes = 1
        for i, place in enumerate((keys * _MULTIPLIER >> self.bits).tolist()):
            n = 0
            while self.slots[place + n] >= 0:
                n += 1
            self.slots[place + n] = i
            self.probes = max(self.probes, n + 1)
        self.scores = np.append(np.array(pieces.scores, float), pieces.unknown)
        self.piece_ids = np.array(pieces.ids, np.int64)
        self.byte_ids = np.array(pieces.bytes_[:128], np.int64)
        # A line feed that is part of no piece is a stretch of its own.
        self.stretch = _LINED if all("\n" not in t for t in pieces.texts) else _STRETCH

    @staticmethod
    def _hashes(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        for i, text in enumerate(texts):
            h = 0
            for c in text:
                h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out[i] = h
        return out

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known as a prefix, number of the piece or -1) of hashed strings."""
        place = (h * _MULTIPLIER >> self.bits).astype(np.int64)
        known, value = np.zeros(len(h), bool), np.full(len(h), -1, np.int32)
        for n in range(self.probes):
            slot = self.slots[place + n]
            same = (slot >= 0) & (self.keys[slot] == h)
            known |= same
            value[same] = self.values[slot[same]]
        return known, value

    def _side_by_side(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch, as the bytes of 32-bit numbers."""
        lengths = np.array([len(s) for s in stretches])
        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        first = np.cumsum(lengths) - lengths
        offset = np.arange(len(codes)) - np.repeat(first, lengths)
        room = np.repeat(lengths, lengths) - offset
        start, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.pieces.longest + 1):
            h = h * np.uint64(0x100000001B3) + codes[start + n - 1]
            known, value = self._look_up(h)
            hit = value >= 0
            found.append((start[hit], np.full(int(hit.sum()), n), value[hit]))
            if n == 1:
                found.append((start[~hit], np.ones(int((~hit).sum()), np.int64), np.full(int((~hit).sum()), -1, np.int32)))
            go = known & (room[start] > n)
            start, h = start[go], h[go]
            if not len(start):
                break
        begin, size, piece = (np.concatenate(x) for x in zip(*found))
        # Boundaries are numbered with one more per stretch, so that each has its own zero.
        shift = np.repeat(np.arange(len(stretches)), lengths)
        left = begin + shift[begin]
        end = left + size
        until = offset[begin] + size
        order = np.lexsort((-size, end, until))
        left, end, piece, until = left[order], end[order], piece[order], until[order]
        score = self.scores[piece]
        best = np.zeros(len(codes) + len(stretches))
        back, taken = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
        bounds = np.searchsorted(until, np.arange(1, int(lengths.max()) + 2))
        for low, high in zip(bounds[:-1], bounds[1:]):
            if low == high:
                continue
            value, own = best[left[low:high]] + score[low:high], end[low:high]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            top = np.maximum.reduceat(value, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, high - low)))
            winner = np.flatnonzero(value == top[group])
            _, pick = np.unique(group[winner], return_index=True)
            at = winner[pick]
            best[own[at]], back[own[at]], taken[own[at]] = value[at], left[low:high][at], piece[low:high][at]
        # Walk all paths back together; a step per piece of the longest path.
        now = first + lengths + np.arange(len(stretches))
        stop = first + np.arange(len(stretches))
        owner, steps = np.arange(len(stretches)), []
        while len(owner):
            steps.append((owner, taken[now], back[now]))
            now = back[now]
            go = now > stop[owner]
            owner, now = owner[go], now[go]
        owner, piece, left = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(owner, kind="stable")
        owner, piece, left = owner[order], piece[order], left[order]
        # Unknown characters of one byte are looked up here, longer ones further down.
        char = codes[np.minimum(left - owner, len(codes) - 1)].astype(np.int64) - 1
        single = np.where(char < 128, self.byte_ids[np.minimum(char, 127)], -1)
        flat = np.where(piece >= 0, self.piece_ids[piece], single)
        ids, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=len(stretches)))).tolist()
        out = [ids[low:high] for low, high in zip([0, *ends[:-1]], ends)]
        for i in np.unique(owner[flat < 0]).tolist():
            out[i] = self._streamed(stretches[i])
        return out

    def _streamed(self, stretch: str) -> bytes:
        return np.array(encode_stream([stretch], self.pieces), np.int32).tobytes()

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit numbers; null and empty texts have none."""
        prefix = " " if self.pieces.dummy_prefix else ""
        cut = [self.stretch.findall(prefix + t) if t else [] for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = {s for stretches in cut for s in stretches if s not in self.cache}
        short = [s for s in new if len(s) <= SIDE_BY_SIDE]
        for low in range(0, len(short), 1 << 15):
            part = short[low : low + (1 << 15)]
            self.cache.update(zip(part, self._side_by_side(part)))
        for s in new:
            if len(s) > SIDE_BY_SIDE:
                self.cache[s] = self._streamed(s)
        look = self.cache.__getitem__
        return [b"".join(map(look, stretches)) for stretches in cut]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.packed(texts)]


class Decoder:
    """Bytes of many arrays of ids at once."""

    def __init__(self, pieces: Pieces) -> None:
        known = pieces.decoder()
        parts = [known.get(i, b"") for i in range(max(known, default=-1) + 1)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[shift + np.arange(len(shift))].tobytes()


def decode_ids(ids: Iterable[int], decoder: dict[int, bytes], dummy_prefix: bool) -> str:
    data = b"".join([decoder.get(i, b"") for i in ids])
    text = data.decode("utf-8", "replace")
    return text[1:] if dummy_prefix and text.startswith(" ") else text


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, n_tokens, ids (array of int), round_trip (whether decoding gives the text).

    The whole text is encoded as it is, with the model's dummy space in front; characters that
    are no piece become bytes, so every text has an encoding. Null and empty texts have no ids.
    `carry` names more columns of docs to keep. Repeated rows give repeated rows.
    """
    prepare(docs.sparkSession)
    pieces = load(model)
    if not pieces.separable():
        raise ValueError("a piece has a space after another character")
    shared = docs.sparkSession.sparkContext.broadcast(pieces.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*shared.value)
        searcher, decoder = Searcher(own), Decoder(own)
        prefix = b" " if own.dummy_prefix else b""
        for batch in by_bytes(batches, most=1 << 20):
            texts = batch.column("text").to_pylist()
            found = searcher.packed(texts)
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            ids = np.frombuffer(b"".join(found), np.int32)
            places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            same = [
                decoder.decode(ids[low:high]) == (prefix + t.encode() if t else b"")
                for t, low, high in zip(texts, places[:-1].tolist(), places[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("carried"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(places), pa.array(ids)), pa.array(same)],
                ["id", "carried", "n_tokens", "ids", "round_trip"],
            )

    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"id {types['id']}, carried {types['carried']}, n_tokens long, ids array<int>, round_trip boolean")
    return out.select(F.col("id").alias(id_col), *[f"carried.`{c}`" for c in carry or []], "n_tokens", "ids", "round_trip")


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of each array of ids; null stays null, ids without text are skipped."""
    prepare(encoded.sparkSession)
    pieces = load(model)
    shared = encoded.sparkSession.sparkContext.broadcast((pieces.decoder(), pieces.dummy_prefix))

    @F.pandas_udf("string")
    def text_of(ids):
        import pandas as pd

        decoder, prefix = shared.value
        return pd.Series([None if x is None else decode_ids(x, decoder, prefix) for x in ids], dtype=object)

    return encoded.withColumn(text_col, text_of(F.col(ids_col)))
