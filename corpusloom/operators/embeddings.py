"""Embedding texts, staleness, batching and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, left_units, normalize_text, trim_space
from ..functions.vectors import content_hash, normalize_vector
from ..session import broadcast_if_small, materialise, stored
from .registry import with_fields

# Limits of one embedding request; a longer text is a request of its own.
BATCH_TEXTS = 96
BATCH_CHARS = 45_000
KEYS = ["aliases", "recall_triggers", "summary", "description", "tags", "category", "domain"]

EmbedFn = Callable[[list[str]], list[list[float]]]


def embedding_text(pages: DataFrame, body_units: int | None = None) -> Column:
    """Text to embed: title, type, metadata lines, a blank line, the body (or its first body_units).

    `pages` supplies the column types: list columns are joined with ', '.
    """
    kinds = dict(pages.dtypes)

    def line(name: str) -> Column:
        if kinds[name].startswith("array"):
            value = F.when(F.size(name) > 0, F.array_join(F.col(name), ", ", "null"))
        else:
            value = trim_space(blank_to_null(F.col(name)))
        return F.concat(F.lit(f"{name}: "), value)

    title = F.coalesce(trim_space(blank_to_null(F.col("title"))), F.col("id"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("title: "), title),
        F.concat(F.lit("type: "), trim_space(blank_to_null(F.col("type")))),
        *[line(n) for n in KEYS],
    )
    body = trim_space(F.coalesce("body", F.lit("")))
    body = body if body_units is None else left_units(body, body_units)
    return F.when(body != "", F.concat(head, F.lit("\n\n"), body)).otherwise(head)


def page_texts(pages: DataFrame, body_units: int | None = None) -> DataFrame:
    """texts(id, text, hash) of pages that have a body column; the hash is that of the text embedded."""
    pages = with_fields(pages, KEYS + ["title", "body"])
    return pages.select("id", embedding_text(pages, body_units).alias("text")).withColumn(
        "hash", content_hash(F.col("text"))
    )


def stale_texts(texts: DataFrame, store: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Texts without a stored vector of the same hash and model.

    Only ids and hashes meet the store; the texts are then picked by id.
    """
    if force:
        return texts
    known = store.select("id", F.col("hash").alias("_hash"), F.col("model").alias("_model"))
    fresh = F.col("_hash").eqNullSafe(F.col("hash")) & F.col("_model").eqNullSafe(F.lit(model))
    stale = materialise(texts.select("id", "hash").join(known, "id", "left").where(~fresh).select("id"))
    return texts.join(broadcast_if_small(stale), "id", "left_semi")


def pruned_ids(store: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored vectors whose page is gone."""
    return store.select("id").join(pages.select("id"), "id", "left_anti")


def _batches(
    rows: Iterator[tuple], max_texts: int, max_chars: int, chars_of: Callable[[tuple], int] = lambda row: len(row[1])
) -> Iterator[list[tuple]]:
    """Greedy batches in order; a text over the character budget stands alone."""
    batch, chars = [], 0
    for row in rows:
        size = chars_of(row)
        if batch and (len(batch) >= max_texts or chars + size > max_chars):
            yield batch
            batch, chars = [], 0
        batch.append(row)
        chars += size
    if batch:
        yield batch


def _rows(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*[frame[n] for n in names])


def embed_batches(
    texts: DataFrame, max_texts: int = BATCH_TEXTS, max_chars: int = BATCH_CHARS
) -> DataFrame:
    """batches(partition, batch_no, texts, chars): the requests an embedding run will make.

    Only the lengths of the texts go to Python.
    """

    def plan(frames):
        sizes = _rows(frames, ["chars"])
        found = [
            (number, len(batch), sum(r[0] for r in batch))
            for number, batch in enumerate(_batches(sizes, max_texts, max_chars, lambda row: row[0]))
        ]
        yield pd.DataFrame(found, columns=["batch_no", "texts", "chars"])

    out = texts.select(F.length("text").alias("chars")).mapInPandas(plan, "batch_no long, texts long, chars long")
    return out.select(F.spark_partition_id().cast("bigint").alias("partition"), "*")


def batch_numbers(sizes: DataFrame, max_texts: int = BATCH_TEXTS, max_chars: int = BATCH_CHARS) -> DataFrame:
    """(id, batch) of sizes(id, chars): the batches of one greedy run over all ids in order.

    A batch depends on where the one before it ended, so a slice of the ids says for each of its
    first rows what follows if a batch begins there: how many batches end in the slice, and what
    its last one holds by then. One pass over these summaries, at most max_texts numbers a slice,
    gives every slice the batch that is open when it begins; then all slices number their rows.
    A text over the budget stands alone.
    """
    ordered = sizes.select("id", F.col("chars").cast("bigint").alias("chars")).repartitionByRange("id", "chars")
    sliced = stored(ordered.withColumn("slice", F.spark_partition_id()))

    def cut(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Sizes in order, and for every row the first row after a batch that begins there."""
        chars = rows.sort_values(["id", "chars"], kind="stable")["chars"].to_numpy()
        total = np.concatenate([[0], np.cumsum(chars)])
        start = np.arange(len(chars))
        full = np.searchsorted(total, total[:-1] + max_chars, "right") - 1
        return chars, np.maximum(np.minimum(full, start + max_texts), start + 1)

    def summarise(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chars, after = cut(rows)
        n = len(chars)
        total = np.concatenate([[0], np.cumsum(chars)])
        ended, held, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = after[i]
            if j < n:
                ended[i], held[i], used[i] = ended[j] + 1, held[j], used[j]
            else:
                held[i], used[i] = n - i, total[n] - total[i]
        first = min(n, max_texts) + 1
        return pd.DataFrame([{
            "slice": key[0], "n": n, "chars": chars[:first].tolist(), "ended": ended[:first].tolist(),
            "held": held[:first].tolist(), "used": used[:first].tolist(),
        }])

    schema = "slice int, n long, chars array<long>, ended array<long>, held array<long>, used array<long>"
    batch, count, chars, opened = 0, 0, 0, []
    for row in sliced.groupBy("slice").applyInPandas(summarise, schema).orderBy("slice").collect():
        opened.append((row.slice, batch, count, chars))
        at = 0
        while at < row.n and count and count < max_texts and chars + row.chars[at] <= max_chars:
            count, chars, at = count + 1, chars + row.chars[at], at + 1
        if at < row.n:
            batch += (count > 0) + row.ended[at]
            count, chars = row.held[at], row.used[at]
    begins = sizes.sparkSession.createDataFrame(opened, "slice int, batch long, count long, open long")

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "chars"], kind="stable").reset_index(drop=True)
        batch, count, chars = (int(rows[c].iat[0]) for c in ("batch", "count", "open"))
        _, after = cut(rows)
        out, at, n = np.empty(len(rows), np.int64), 0, len(rows)
        while at < n and count and count < max_texts and chars + rows["chars"].iat[at] <= max_chars:
            out[at], count, chars, at = batch, count + 1, chars + rows["chars"].iat[at], at + 1
        batch += bool(count) and at < n
        while at < n:
            out[at : after[at]], batch, at = batch, batch + 1, after[at]
        return pd.DataFrame({"id": rows["id"], "batch": out})

    # A row per slice.
    numbered = sliced.join(F.broadcast(begins), "slice")
    return numbered.groupBy("slice").applyInPandas(number, f"id {dict(sizes.dtypes)['id']}, batch long")


def embed_texts(
    texts: DataFrame, embed: EmbedFn, max_texts: int = BATCH_TEXTS, max_chars: int = BATCH_CHARS
) -> DataFrame:
    """vectors(id, hash, vector): embed(texts) runs inside tasks, one call per batch.

    A call that returns another number of vectors than texts fails the job: nothing is
    stored for it.
    """

    def run(frames):
        for batch in _batches(_rows(frames, ["id", "text", "hash"]), max_texts, max_chars):
            vectors = embed([r[1] for r in batch])
            if len(vectors) != len(batch):
                raise ValueError(f"expected {len(batch)} vectors, got {len(vectors)}")
            yield pd.DataFrame({
                "id": [r[0] for r in batch], "hash": [r[2] for r in batch],
                "vector": [[float(x) for x in v] for v in vectors],
            })

    raw = texts.select("id", "text", "hash").mapInPandas(run, "id string, hash string, vector array<double>")
    return raw.withColumn("vector", normalize_vector(F.col("vector")))


def refresh_embeddings(
    pages: DataFrame, store: DataFrame, embed: EmbedFn, model: str, updated: str, force: bool = False
) -> DataFrame:
    """The new store: stale pages embedded, fresh ones kept, deleted ones pruned.

    store(id, hash, model, dim, vector, updated).
    """
    texts = page_texts(pages)
    todo = stale_texts(texts, store, model, force)
    new = embed_texts(todo, embed).select(
        "id", "hash", F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector",
        F.lit(updated).alias("updated"),
    )
    kept = store.join(pages.select("id"), "id", "left_semi").join(todo.select("id"), "id", "left_anti")
    return kept.select("id", "hash", "model", "dim", "vector", "updated").unionByName(new)


def refresh_stats(pages: DataFrame, store: DataFrame, model: str, force: bool = False) -> DataFrame:
    """One row: embedded, skipped, total, pruned."""
    texts = page_texts(pages).select("id", "hash")
    known = store.select("id", F.col("hash").alias("_hash"), F.col("model").alias("_model"), F.lit(True).alias("_stored"))
    both = texts.withColumn("_paged", F.lit(True)).join(known, "id", "full")
    paged, stored = F.col("_paged").isNotNull(), F.col("_stored").isNotNull()
    fresh = F.col("_hash").eqNullSafe(F.col("hash")) & F.col("_model").eqNullSafe(F.lit(model)) & F.lit(not force)
    return both.agg(
        F.count_if(paged & ~fresh).cast("bigint").alias("embedded"),
        F.count_if(paged & fresh).cast("bigint").alias("skipped"),
        F.count_if(paged).cast("bigint").alias("total"),
        F.count_if(stored & ~paged).cast("bigint").alias("pruned"),
    )


def response_vectors(responses: DataFrame) -> DataFrame:
    """Check embedding responses(request_id, status, body, n) and order their vectors.

    -> vectors(request_id, error, vectors): error is NULL for a usable response. Rows are
    ordered by their index when all have one.
    """
    shape = "struct<data:array<struct<index:int,embedding:array<double>>>,error:struct<message:string>,detail:string>"
    body = F.from_json("body", shape)
    data = F.col("_b.data")
    indexed = F.forall(data, lambda d: d["index"].isNotNull())
    ordered = F.when(indexed, F.array_sort(data, lambda a, b: a["index"] - b["index"])).otherwise(data)
    error = (
        F.when(F.col("_b.error").isNotNull(), F.coalesce("_b.error.message", F.lit("embedding error")))
        .when(F.col("_b.detail").isNotNull(), F.col("_b.detail"))
        .when((F.col("status") < 200) | (F.col("status") >= 300), F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(F.coalesce(F.size(data), F.lit(-1)) != F.col("n"), F.lit("vector count mismatch"))
    )
    return responses.withColumn("_b", body).select(
        "request_id", error.alias("error"),
        F.when(error.isNull(), F.transform(ordered, lambda d: d["embedding"])).alias("vectors"),
    )


def embed_queries(queries: DataFrame, embed: EmbedFn) -> DataFrame:
    """vectors(query_id, vector): queries(query_id, query) that normalise alike are embedded once."""
    keyed = queries.select("query_id", "query", normalize_text(F.col("query")).alias("key"))
    once = keyed.groupBy("key").agg(F.min_by("query", "query_id").alias("text"))
    texts = once.select(F.col("key").alias("id"), "text", F.lit("").alias("hash"))
    vectors = materialise(embed_texts(texts, embed)).select(F.col("id").alias("key"), "vector")
    return keyed.select("query_id", "key").join(vectors, "key").select(
        "query_id", "vector"
    )
