"""Repair of conversation structure by a checkpointed dynamic program.

A conversation is a sequence of rows by turn. Edits (keep, change the role, delete, insert) turn
its role initials into an optional `s` and pairs `ua`. Four states say what may come next:

    0 nothing yet    1 after s    2 after u    3 after a pair

Costs run backward: a vector holds, for each state, the least cost of what follows. Rows are
sorted into range slices, so a conversation of any size spans as many tasks as its rows need;
what one slice holds of it, cut at BLOCK rows, is a block. Each block yields the matrix of least
costs between the states at its ends; a scan over a conversation's blocks gives the vectors at
the block ends, which are the checkpoints between tasks. Inside a block vectors are stored at
every square root of its length only; the forward walk recomputes the rows in between and emits
the edits, the ASCII-least of the cheapest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.llm.samples import crc_mod
from corpusloom.llm.store import prepare, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 1 << 16
_BLANKS = " \t\n\x0b\x0c\r"

# Where a row of class s, u, a or other leads from each state; -1 is not allowed.
_KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
# Where a user or assistant row put in or renamed leads, and which it is.
_MADE = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_PLAIN, _CUT, _GONE = 0, 4, 8
_FAR = 1 << 60

Vector = tuple[int, int, int, int]


def _with_inserts(costs: list[int]) -> Vector:
    """Costs from each state when rows may be put in first; two insertions in a row lead nowhere cheaper but to 3."""
    two, three = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return (min(costs[0], INSERT + two), min(costs[1], INSERT + two), two, three)


FINAL: Vector = _with_inserts([0, _FAR, _FAR, 0])


@lru_cache(maxsize=1 << 16)
def _step(after: Vector, symbol: int) -> Vector:
    """Costs before a row, from the costs after it. symbol: the class plus _PLAIN, _CUT (truncated) or _GONE (must go)."""
    costs = [DELETE + c for c in after]
    if symbol < _GONE:
        extra = TRUNCATED if symbol >= _CUT else 0
        for state in range(4):
            target = _KEPT[state][symbol % 4]
            kept = KEEP + after[target] if target >= 0 else _FAR
            costs[state] = min(costs[state], extra + kept, extra + REROLE + after[_MADE[state]])
    return _with_inserts(costs)


def _back(after: Vector, symbol: int, extra: int) -> Vector:
    """Costs before a row and `extra` copies of it that must go, kept small by taking out the least."""
    least = min(after)
    before = _step(tuple(min(c - least, _FAR) for c in after), symbol)
    return tuple(c + least + DELETE * extra for c in before)


@lru_cache(maxsize=1 << 16)
def _edits(after: Vector, symbol: int, state: int) -> tuple[str, int]:
    """The edits up to and with a row's own, and the state they lead to. Of equally cheap ones D, I, K, R in this order."""
    before = _step(after, symbol)
    out = ""
    while True:
        if before[state] == DELETE + after[state]:
            return out + "D", state
        if before[state] == INSERT + before[_MADE[state]]:
            out, state = out + "I", _MADE[state]
            continue
        target = _KEPT[state][symbol % 4]
        extra = TRUNCATED if symbol >= _CUT else 0
        if target >= 0 and before[state] == extra + KEEP + after[target]:
            return out + "K", target
        return out + "R", _MADE[state]


def matrix(symbols: bytes, extras: list[int]) -> list[Vector]:
    """Least costs of a block from each state before it to each state after it, by end state."""
    out = []
    for end in range(4):
        vector = tuple(0 if s == end else _FAR for s in range(4))
        for i in range(len(symbols) - 1, -1, -1):
            vector = _back(vector, symbols[i], extras[i])
        out.append(vector)
    return out


def before_block(costs: list[Vector], after: Vector) -> Vector:
    """The vector before a block from its matrix and the vector after it."""
    return tuple(min(costs[end][start] + after[end] for end in range(4)) for start in range(4))


def walk(symbols: bytes, extras: list[int], after: Vector, state: int) -> tuple[list[str], int]:
    """The edits of each row of a block and the state after it, from the vector after the block.

    Stores vectors at every square root of the length and recomputes those in between.
    """
    n = len(symbols)
    stride = max(1, math.isqrt(n))
    checkpoints = {}
    vector = after
    for i in range(n - 1, -1, -1):
        if (i + 1) % stride == 0 or i == n - 1:
            checkpoints[i] = vector
        vector = _back(vector, symbols[i], extras[i])
    edits = []
    for low in range(0, n, stride):
        high = min(low + stride, n)
        vector = checkpoints[high - 1]
        vectors = []
        for i in range(high - 1, low - 1, -1):
            # The copies that follow a row all go, whatever the state: they shift costs alike.
            vectors.append(vector)
            vector = _back(vector, symbols[i], extras[i])
        for i in range(low, high):
            vector = vectors[high - 1 - i]
            least = min(vector)
            edit, state = _edits(tuple(c - least for c in vector), symbols[i], state)
            edits.append(edit)
    return edits, state


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with planted faults and the column `copies`.

    The checksum of `conv_id:turn`, nulls as one space, modulo 20 says which: 0 drops the row, 1
    empties its text, 2 takes out its full stops, exclamation and question marks, 3 doubles it, 4
    makes it the user's. Null roles and texts become one space.
    """
    space = F.lit(" ")
    spot = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), spot.alias("spot")
    ).withColumn("fault", crc_mod("spot", 20)).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the hash that stands for their conversation, role and text."""
    known = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    mark = F.xxhash64(F.col("conv_id").isNull(), "conv_id", role, text)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), known.alias("copies"), mark.alias("mark"))


def _symbols(keyed: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, class, fault, copies, first): one narrow row per distinct row.

    Equal rows of a turn are counted before the shuffle, so that a row repeated any number of
    times costs one; `first` says whether no earlier turn has the same role and text.
    """
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    seen = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(seen == "", 2).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    narrow = keyed.select("conv_id", "turn", "mark", "copies", kind.alias("class"), fault.alias("fault"))
    distinct = narrow.groupBy("conv_id", "turn", "mark").agg(
        F.first("class").alias("class"), F.first("fault").alias("fault"), F.sum("copies").alias("copies")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = distinct.groupBy("mark").agg(F.min(place).alias("earliest"))
    first = F.col("turn").eqNullSafe(F.col("earliest")["turn"])
    return distinct.join(earliest, "mark").select("conv_id", "turn", "mark", "class", "fault", "copies", first.alias("first"))


_BLOCKS = [
    StructField("slice", IntegerType()), StructField("part", LongType()), StructField("turns", ArrayType(LongType())),
    StructField("marks", ArrayType(LongType())), StructField("symbols", ArrayType(IntegerType())),
    StructField("extras", ArrayType(LongType())), StructField("costs", ArrayType(LongType())),
    StructField("counts", ArrayType(LongType())),
]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _blocks(ordered: DataFrame, block: int) -> DataFrame:
    """One row per block of sorted rows: its rows, its cost matrix, and its counts.

    counts: blank, duplicate, truncated, illegal neighbours inside, first and last class.
    """

    def finish(conv, number: tuple[int, int], rows: list[tuple]) -> tuple:
        counts = [0, 0, 0, 0, rows[0][2], rows[-1][2]]
        symbols, extras = bytearray(), []
        last = None
        for _, _, kind, fault, copies, first in rows:
            gone = fault == 2 or not first
            symbols.append(kind + (_GONE if gone else _CUT if fault == 1 else _PLAIN))
            extras.append(copies - 1)
            if fault == 2:
                counts[0] += copies
            else:
                counts[1] += copies - first
                counts[2] += fault == 1 and first
            # No class may follow itself.
            counts[3] += copies - 1 + (last is not None and (last, kind) not in _LEGAL)
            last = kind
        costs = [c for vector in matrix(bytes(symbols), extras) for c in vector]
        return (conv, *number, [r[0] for r in rows], [r[1] for r in rows], list(symbols), extras, costs, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rows, number, done, size = None, [], 0, [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for slice_, own, *row in zip(*columns):
                if rows and (own != conv or len(rows) >= block):
                    done.append(finish(conv, (slice_, number), rows))
                    size += len(rows)
                    number, rows = number + 1, []
                conv = own
                rows.append(tuple(row))
                last_slice = slice_
            if size > block:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=arrow)
                done, size = [], 0
        if rows:
            done.append(finish(conv, (last_slice, number), rows))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=arrow)

    schema = StructType([ordered.schema["conv_id"], *_BLOCKS])
    names = schema.names
    arrow = _arrow(schema)
    columns = [F.spark_partition_id().alias("slice"), "conv_id", "turn", "mark", "class", "fault", "copies", "first"]
    return ordered.select(*columns).mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, function, fields: list[StructField]) -> DataFrame:
    """Each row through a function that yields the rows made of it, as tuples."""
    schema = StructType(fields)
    names, arrow = schema.names, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [dict(zip(names, made)) for row in batch.to_pylist() for made in function(row)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _vectors(row: dict) -> Iterator[tuple]:
    """The vector after each block of a conversation, whether the block is the first or last, and the whole cost."""
    after = FINAL
    blocks = sorted(row["blocks"], key=lambda b: (b["slice"], b["part"]))
    illegal = 0
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if i:
            illegal += (blocks[i - 1]["counts"][5], b["counts"][4]) not in _LEGAL
        flat = b["costs"]
        here = after
        after = before_block([tuple(flat[4 * e : 4 * e + 4]) for e in range(4)], after)
        counts = b["counts"][:4]
        if not i:
            counts[3] += illegal
        yield b["slice"], b["part"], list(here), int(i == 0), int(i == len(blocks) - 1), after[0] if not i else 0, counts


def _walked(row: dict) -> Iterator[tuple]:
    """The edits of a block from each state it may begin in, and the states it ends in."""
    symbols, after = bytes(row["symbols"]), tuple(row["after"])
    edits, ends = [], []
    for state in (0,) if row["is_first"] else range(4):
        made, end = walk(symbols, row["extras"], after, state)
        edits.append(made)
        ends.append(end)
    yield row["slice"], row["part"], edits, ends


def _starts(row: dict) -> Iterator[tuple]:
    """The state each block of a conversation begins in."""
    state = 0
    for b in sorted(row["blocks"], key=lambda b: (b["slice"], b["part"])):
        yield b["slice"], b["part"], state
        state = b["ends"][state]


def _planned(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The edits of every distinct row, and counts and cost of every block."""
    ordered = _symbols(rows).repartitionByRange("conv_id", "turn", "mark").sortWithinPartitions("conv_id", "turn", "mark")
    blocks = written(_blocks(ordered, block))
    where = [StructField("slice", IntegerType()), StructField("part", LongType())]
    longs = ArrayType(LongType())
    ends = F.collect_list(F.struct("slice", "part", "costs", "counts")).alias("blocks")
    flags = [StructField("is_first", IntegerType()), StructField("is_last", IntegerType())]
    vectors = written(_mapped(
        blocks.groupBy("conv_id").agg(ends).select("blocks"), _vectors,
        [*where, StructField("after", longs), *flags, StructField("cost", LongType()), StructField("counts", longs)],
    ))
    to_walk = blocks.drop("costs", "counts").join(vectors.drop("cost", "counts"), ["slice", "part"])
    walked = written(_mapped(
        to_walk.select("slice", "part", "symbols", "extras", "after", "is_first"), _walked,
        [*where, StructField("edits", ArrayType(ArrayType(StringType()))), StructField("ends", ArrayType(IntegerType()))],
    ))
    chained = blocks.select("conv_id", "slice", "part").join(walked.drop("edits"), ["slice", "part"])
    begun = chained.groupBy("conv_id").agg(F.collect_list(F.struct("slice", "part", "ends")).alias("blocks"))
    starts = _mapped(begun.select("blocks"), _starts, [*where, StructField("state", IntegerType())])
    chosen = blocks.select("conv_id", "slice", "part", "turns", "marks", "extras").join(walked, ["slice", "part"])
    chosen = chosen.join(starts, ["slice", "part"]).join(vectors.select("slice", "part", "is_last"), ["slice", "part"])
    edits = F.col("edits")[F.col("state")]
    zipped = F.arrays_zip("turns", "marks", "extras", edits.alias("edit"))
    flat = chosen.select("conv_id", F.inline(zipped)).toDF("conv_id", "turn", "mark", "extra", "edit")
    final = F.col("ends")[F.col("state")]
    tails = chosen.where("is_last = 1").select("conv_id", F.when(final == 1, "II").when(final == 2, "I").otherwise("").alias("edit")).where("edit <> ''")
    plan = flat.withColumn("order", F.lit(0)).unionByName(tails.withColumn("order", F.lit(1)), allowMissingColumns=True)
    counted = vectors.join(blocks.select("conv_id", "slice", "part"), ["slice", "part"]).select("conv_id", "cost", "counts")
    return plan, counted


def _stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Texts and edits, each conversation in order within one partition; a row's text precedes its edits."""
    texts = rows.select("conv_id", "turn", "mark", "role", "text", F.lit(0).alias("order"), F.lit(None).cast("string").alias("edit"), F.lit(0).cast("long").alias("extra"))
    both = texts.unionByName(plan, allowMissingColumns=True)
    at = F.when(F.col("edit").isNull(), 0).otherwise(1)
    ranked = both.withColumn("kind", at)
    order = ["conv_id", "order", "turn", "mark", "kind"]
    return ranked.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "edit", "extra")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, turn, edit, role, text) of every edit, in order; role and text are None for deleted rows.

    Holds one row's text at a time.
    """
    conv, state, fresh, role, text = None, 0, True, None, None
    for batch in batches:
        for own, turn, own_role, own_text, edit, extra in zip(*[c.to_pylist() for c in batch.columns]):
            if fresh or own != conv:
                conv, state, fresh = own, 0, False
            if edit is None:
                role, text = own_role, own_text
                continue
            for mark in edit:
                if mark == "D":
                    yield conv, turn, "D", None, None
                elif mark == "K":
                    state = _KEPT[state]["sua".find(role[:1])]
                    yield conv, turn, "K", role, text
                else:
                    made, state = _ROLE[state], _MADE[state]
                    yield conv, turn, mark, made, "" if mark == "I" else text
            for _ in range(extra or 0):
                yield conv, turn, "D", None, None


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): every edit of every conversation, in order.

    edit is K, R, D or I; deleted rows have neither role nor text. Rows are taken by turn, nulls
    first; ties within a turn in an order fixed by a hash of role and text, so copies adjoin.
    Null roles and texts count as one space; a role without an initial s, u or a is renamed or
    deleted; rows of a null conv_id are one conversation. An empty table gives no rows.
    """
    prepare(conversations.sparkSession)
    rows = _keyed(conversations)
    plan, _ = _planned(rows, block)
    schema = StructType([
        rows.schema["conv_id"], StructField("position", LongType()), StructField("edit", StringType()),
        rows.schema["turn"], StructField("role", StringType()), StructField("text", StringType()),
    ])
    arrow = _arrow(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, out, size = object(), 0, [], 0
        for own, turn, edit, role, text in _replayed(batches):
            conv, position = own, position + 1 if own == conv else 1
            out.append(dict(zip(names, (own, position, edit, turn, role, text))))
            size += 64 + len(text or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _stream(rows, plan).mapInArrow(run, schema)


def _digests(stream: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256); texts are hashed as they pass."""
    schema = StructType([stream.schema["conv_id"], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow, names = _arrow(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, begun, out = object(), [], None, False, []

        def close() -> None:
            if digest is not None:
                out.append(dict(zip(names, (conv, "".join(audit), digest.hexdigest()))))

        for own, _, edit, role, text in _replayed(batches):
            if own != conv or digest is None:
                close()
                conv, audit, digest, begun = own, [], hashlib.sha256(), False
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
            audit.append(edit)
            if edit != "D":
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
        close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return stream.mapInArrow(run, schema)


def report(conversations: DataFrame, all_ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    all_ids: further conv_ids to report; those without rows have zeros, no audit and the hash of
    the empty text. A row's first fault counts. Other cases are as in `repaired`; a hash of the
    repaired text needs it in order, so each conversation's texts pass through one task, one at a
    time.
    """
    prepare(conversations.sparkSession)
    rows = _keyed(conversations)
    plan, counted = _planned(rows, block)
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    names = ["blank", "duplicate", "truncated", "illegal"]
    faults = counted.select("conv_id", "cost", *[F.col("counts")[i].alias(n) for i, n in enumerate(names)])
    ids = rows.select("conv_id") if all_ids is None else all_ids.select("conv_id")
    parts = ids.distinct()
    for more in (gaps, faults, _digests(_stream(rows, plan))):
        parts = parts.unionByName(more, allowMissingColumns=True)
    empty = hashlib.sha256(b"").hexdigest()
    totals = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in ["gaps", *names, "cost"]]
    return parts.groupBy("conv_id").agg(
        *totals, F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"),
    )
