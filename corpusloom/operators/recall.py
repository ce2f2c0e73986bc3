"""Recall: weighted lexical ranking with section scores, relevance feedback and vectors.

A batch of queries is answered in two scans of the pages. The first looks up all terms of
all queries in every text at once (one automaton per batch, built from the query terms) and
keeps rows that can still reach a query's top ranks. The second fetches the few pages that
did. No page meets a query in a join, so cost follows text size, not pages x queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.text import (
    SEPARATORS, _UNSTABLE, blank_to_null, collapse_space, compact_fold, compact_text, left_units,
    normalize_text, terms_of, trim_space,
)
from ..functions.vectors import SEMANTIC_MIN_COSINE, SEMANTIC_SCALE, SEMANTIC_WEIGHT, fuse_scores
from ..session import broadcast_if_small, computed_once, materialise, stored
from . import vector_index
from .chunks import chunk_array, chunk_preview, page_preview
from .registry import semantic_title, with_fields

# Fixed values of the ranking.
FEEDBACK_PAGES = 3
FEEDBACK_TERMS = 6
BOOSTED_PAGES = 25
BOOST_SHARE = 0.4
# (column, weight): metadata fields score in the registry and again in the page itself.
DOUBLED_FIELDS = [
    ("aliases", 6.0), ("recall_triggers", 7.0), ("summary", 3.0), ("description", 3.0),
    ("tags", 2.0), ("category", 2.0), ("domain", 2.0),
]
ID_WEIGHT, TITLE_WEIGHT, TYPE_WEIGHT = 3.0, 5.0, 1.0
HEADING_WEIGHT, CONTENT_WEIGHT = 4.0, 1.0
STOP_WORDS = (
    "the this that with from have been were they their them will would could should about "
    "there which what when where than then also just more some such only other into over "
    "very after before because between through during without within along these those "
    "page section note info type used using"
).split()

# Queries answered per scan of the pages; more are answered in further scans.
QUERIES_PER_SCAN = 2000
# Up to this many queries are scored by JVM expressions over the stored index.
FEW_QUERIES = 3
# Pages scored at a time within a task.
BLOCK_ROWS = 512

META = ["title", "aliases", "tags", "summary", "description"]

_SCORED = "query_id long, vault string, id string, lexical double, chunk_no int, cosine double"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_array(values: pd.Series) -> pd.Series:
    import unicodedata

    return values.map(
        lambda vs: [unicodedata.normalize("NFKC", v) for v in vs], na_action="ignore"
    )


def _text(df: DataFrame, name: str) -> Column:
    """Field as text: list values are joined by a space."""
    column = F.col(name)
    return F.array_join(column, " ") if dict(df.dtypes)[name].startswith("array") else column


def search_index(pages: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Normalise pages once for any number of recalls.

    index(vault, id, weights, texts, sections, vector): `texts` holds compact metadata fields
    matching `weights`; `sections` alternates compact headings and contents.
    pages: id, type, title, body and any of the metadata columns; origin = 'packet' marks
    registry rows without a page. Write the result to a table and reuse it.
    """
    pages = with_fields(pages, [n for n, _ in DOUBLED_FIELDS] + ["title", "body"])
    if "vault" not in pages.columns:
        pages = pages.withColumn("vault", F.lit("main"))
    paged = F.lit(True) if "origin" not in pages.columns else F.col("origin") != "packet"
    times = F.when(paged, 2.0).otherwise(1.0)
    own_title = F.when(paged & blank_to_null(F.col("title")).isNotNull(), 2.0).otherwise(1.0)
    weights = F.array(
        F.lit(ID_WEIGHT), F.lit(TITLE_WEIGHT) * own_title, F.lit(TYPE_WEIGHT),
        *[F.lit(w) * times for _, w in DOUBLED_FIELDS],
    )
    texts = F.array(
        compact_fold(F.col("id")),
        compact_fold(semantic_title(F.col("title"), F.col("id"))),
        compact_fold(F.col("type")),
        *[compact_fold(_text(pages, n)) for n, _ in DOUBLED_FIELDS],
    )
    body = F.coalesce(F.col("body"), F.lit(""))
    lowered = F.flatten(
        F.transform(
            chunk_array(F.col("_body")), lambda c: F.array(F.lower(c["heading"]), F.lower(c["content"]))
        )
    )
    index = (
        computed_once(
            pages.select("vault", "id", weights.alias("weights"), texts.alias("texts"), body.alias("_body")),
            {"_lowered": lowered},
        )
        .withColumn("_unstable", F.col("_body").rlike(_UNSTABLE))
        .withColumn(
            "_folded",
            F.coalesce(_nfkc_array(F.when(F.col("_unstable"), F.col("_lowered"))), F.col("_lowered")),
        )
        .select(
            "vault", "id", "weights", "texts",
            F.transform(
                "_folded", lambda t: F.regexp_replace(t, SEPARATORS, "")
            ).alias("sections"),
        )
    )
    if vectors is None:
        return index.withColumn("vector", F.lit(None).cast("array<double>"))
    keys = ["vault", "id"] if "vault" in vectors.columns else ["id"]
    return index.join(vectors.select(*keys, "vector"), keys, "left")


def prepare_queries(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) -> normalised text and terms; queries without terms drop out."""
    return (
        queries.select("query_id", normalize_text(F.col("query")).alias("normalized"))
        .where(F.col("normalized") != "")
        .withColumn("terms", terms_of(F.col("normalized")))
    )


class _Batch:
    """Terms and vectors of one batch of queries; built on the driver, used in tasks."""

    def __init__(self, rows, vectors: dict):
        self.query_ids = np.array([r["query_id"] for r in rows], dtype="int64")
        owners: dict[str, dict[int, int]] = {}
        for number, row in enumerate(rows):
            for term in row["terms"]:
                # Two terms may share a compact form; both count.
                counts = owners.setdefault(term.replace(" ", ""), {})
                counts[number] = counts.get(number, 0) + 1
        self.owners = owners
        dims = {len(v) for v in vectors.values()}
        self.query_vectors = {}
        for dim in dims:
            numbers = [i for i, q in enumerate(self.query_ids) if len(vectors.get(int(q), ())) == dim]
            matrix = np.array([vectors[int(self.query_ids[i])] for i in numbers], dtype="float64")
            self.query_vectors[dim] = (np.array(numbers), _unit_rows(matrix))

    def automaton(self):
        auto = ahocorasick.Automaton()
        numbers, counts = [], []
        for slot, (term, owner) in enumerate(self.owners.items()):
            auto.add_word(term, slot)
            numbers.append(np.fromiter(owner.keys(), dtype="int64"))
            counts.append(np.fromiter(owner.values(), dtype="float64"))
        if len(auto):
            auto.make_automaton()
        return auto, numbers, counts


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _scorer(batch: _Batch, weight: float, keep_lexical: int, keep_fused: int):
    """mapInPandas function: index rows -> scored (query, page) rows that may still rank.

    A task returns at most keep_lexical + keep_fused rows per query and vault, ties included,
    so the ranking shuffle is bounded by tasks, not by how many pages match.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, numbers, counts = batch.automaton()
        n = len(batch.query_ids)

        def hits(text: str) -> np.ndarray | None:
            if not text or not len(auto):
                return None
            found = {slot for _, slot in auto.iter(text)}
            if not found:
                return None
            return np.bincount(
                np.concatenate([numbers[s] for s in found]),
                weights=np.concatenate([counts[s] for s in found]), minlength=n,
            )

        # Per vault and column, the score of each query's last kept row: what is below cannot rank.
        least: dict[tuple[str, str], np.ndarray] = {}
        none = np.full(n, -np.inf)

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            """Scored rows of a block that are among its best per vault and query."""
            # In id order a stable sort by score breaks ties the way the ranking does.
            frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
            size = len(frame)
            lexical = np.zeros((size, n))
            chunk_no = np.full((size, n), -1, dtype="int32")
            cosine = np.zeros((size, n))
            for row, (weights, texts, sections) in enumerate(
                zip(frame["weights"], frame["texts"], frame["sections"])
            ):
                for w, text in zip(weights, texts):
                    found = hits(text)
                    if found is not None:
                        lexical[row] += w * found
                top = np.zeros(n)
                for number in range(0, len(sections), 2):
                    head, content = hits(sections[number]), hits(sections[number + 1])
                    if head is None and content is None:
                        continue
                    value = np.zeros(n)
                    if head is not None:
                        value += HEADING_WEIGHT * head
                    if content is not None:
                        value += CONTENT_WEIGHT * content
                    better = value > top
                    top[better] = value[better]
                    chunk_no[row, better] = number // 2
                lexical[row] += top
            for dim, (query_numbers, matrix) in batch.query_vectors.items():
                rows = [i for i, v in enumerate(frame["vector"]) if v is not None and len(v) == dim]
                if rows and dim:
                    pages = _unit_rows(np.array([frame["vector"].iat[i] for i in rows], dtype="float64"))
                    cosine[np.ix_(rows, query_numbers)] = pages @ matrix.T
            fused = lexical + weight * SEMANTIC_SCALE * np.maximum(cosine, 0.0)
            candidate = (lexical > 0) | (cosine >= SEMANTIC_MIN_COSINE)
            keep = np.zeros_like(candidate)
            vaults = frame["vault"].to_numpy()
            for vault in pd.unique(vaults):
                mine = np.flatnonzero(vaults == vault)
                for name, values, k in (("lexical", lexical, keep_lexical), ("fused", fused, keep_fused)):
                    able = candidate[mine] & ~(values[mine] < least.get((vault, name), none))
                    if able.sum() <= n:
                        keep[mine] |= able
                        continue
                    ranked = np.where(able, -values[mine], np.inf)
                    first = np.argsort(ranked, axis=0, kind="stable")[:k]
                    keep[mine[first], np.arange(n)] |= able[first, np.arange(n)]
            rows, cols = np.nonzero(keep & candidate)
            return pd.DataFrame({
                "query_id": batch.query_ids[cols],
                "vault": vaults[rows],
                "id": frame["id"].to_numpy()[rows],
                "lexical": lexical[rows, cols],
                "chunk_no": chunk_no[rows, cols],
                "cosine": cosine[rows, cols],
                "fused": fused[rows, cols],
            })

        def prune(rows: pd.DataFrame) -> pd.DataFrame:
            """The best of all blocks so far; nothing a later ranking could need is dropped."""
            keep = np.zeros(len(rows), dtype=bool)
            rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
            for column, k in (("lexical", keep_lexical), ("fused", keep_fused)):
                order = rows.sort_values(column, ascending=False, kind="stable")
                place = order.groupby(["query_id", "vault"], sort=False).cumcount()
                keep[place.index[place < k]] = True
                last = order[place == k - 1]
                for vault, some in last.groupby("vault"):
                    scores = none.copy()
                    scores[[at[q] for q in some["query_id"]]] = some[column]
                    least[vault, column] = scores
            return rows[keep]

        at = {int(q): i for i, q in enumerate(batch.query_ids)}
        kept, seen = [], 0
        for frame in frames:
            for start in range(0, len(frame), BLOCK_ROWS):
                part = block(frame.iloc[start : start + BLOCK_ROWS])
                kept.append(part)
                seen += len(part)
                if len(kept) > 1 and seen > 4 * n * (keep_lexical + keep_fused):
                    kept = [prune(pd.concat(kept))]
                    seen = len(kept[0])
        if seen:
            yield prune(pd.concat(kept)).drop(columns="fused")

    return score


def _hits(text: Column, terms: list[str]) -> Column:
    """How many of the compact terms the compact text contains; repeated terms count again."""
    total = F.lit(0.0)
    for term in terms:
        total = total + F.when(text.contains(F.lit(term)), 1.0).otherwise(0.0)
    return total


def _score_few(index: DataFrame, rows) -> DataFrame:
    """Lexical scores for a handful of queries with JVM expressions, no Python workers."""
    found = []
    for row in rows:
        terms = [t.replace(" ", "") for t in row["terms"]]
        fields = F.zip_with("weights", "texts", lambda w, t: w * _hits(t, terms))
        numbers = F.sequence(F.lit(0), (F.size("sections") / 2 - 1).cast("int"))
        scores = F.transform(
            numbers,
            lambda i: _hits(F.get(F.col("sections"), 2 * i), terms) * HEADING_WEIGHT
            + _hits(F.get(F.col("sections"), 2 * i + 1), terms) * CONTENT_WEIGHT,
        )
        found.append(F.struct(
            F.lit(row["query_id"]).cast("bigint").alias("query_id"),
            F.aggregate(fields, F.lit(0.0), lambda acc, v: acc + v).alias("field_score"),
            F.when(F.size("sections") > 0, scores).alias("scores"),
        ))
    rows = index.select("vault", "id", F.inline(F.array(*found)))
    rows = computed_once(rows, {"best": F.coalesce(F.array_max("scores"), F.lit(0.0))})
    return rows.select(
        "query_id", "vault", "id", (F.col("field_score") + F.col("best")).alias("lexical"),
        F.when(F.col("best") > 0, F.array_position("scores", F.col("best")) - 1).otherwise(-1).cast("int").alias("chunk_no"),
        F.lit(0.0).alias("cosine"),
    ).where(F.col("lexical") > 0)


def score_pages(
    index: DataFrame, queries: DataFrame, query_vectors: DataFrame | None = None,
    weight: float = SEMANTIC_WEIGHT, keep: int = BOOSTED_PAGES, total: int | None = None,
) -> DataFrame:
    """scored(query_id, vault, id, lexical, chunk_no, cosine) of rows that may rank in `keep`.

    Terms of at most QUERIES_PER_SCAN queries are on the driver at a time; larger batches
    scan the pages once per slice of queries. A few queries without vectors stay on the JVM;
    their rows are cut by the rank filter, which Spark applies before the shuffle.
    """
    total = queries.count() if total is None else total
    slices = max(1, -(-total // QUERIES_PER_SCAN))
    out = None
    for number in range(slices):
        part = queries if slices == 1 else queries.where(
            F.pmod(F.xxhash64("query_id"), F.lit(slices)) == number
        )
        rows = part.select("query_id", "terms").collect()
        vectors = {}
        if query_vectors is not None:
            mine = query_vectors.join(part.select("query_id"), "query_id", "left_semi")
            vectors = {r["query_id"]: r["vector"] for r in mine.select("query_id", "vector").collect()}
        if 0 < total <= FEW_QUERIES and query_vectors is None:
            return _score_few(index, rows)
        batch = _Batch(rows, vectors)
        scored = index.mapInPandas(_scorer(batch, weight, max(keep, BOOSTED_PAGES), keep), _SCORED)
        out = scored if out is None else out.unionAll(scored)
    return out


def semantic_topk(
    vectors: DataFrame, query_vectors: DataFrame, k: int = 5, min_cosine: float = SEMANTIC_MIN_COSINE
) -> DataFrame:
    """neighbours(query_id, rank, id, cosine): nearest pages by cosine, min_cosine at least.

    Builds an inverted file for this one search; keep one with operators.vector_index for many.
    """
    centroids = vector_index.fit_centroids(vectors)
    index = stored(vector_index.index_vectors(vectors, centroids).repartition("cell"))
    return vector_index.search(index, centroids, query_vectors, k, min_cosine)


def _rank(score: str) -> Column:
    order = Window.partitionBy("query_id", "vault").orderBy(F.desc(score), F.asc("id"))
    return F.row_number().over(order)


def rank_lexical(scored: DataFrame, k: int = BOOSTED_PAGES) -> DataFrame:
    return scored.where("lexical > 0").withColumn("rank", _rank("lexical")).where(F.col("rank") <= k)


def _section_boost(sections: Column, terms: Column) -> Column:
    """Best section score of expansion terms: 2 per heading hit, 0.5 per content hit."""

    def value(i: Column) -> Column:
        head, content = F.get(sections, 2 * i), F.get(sections, 2 * i + 1)
        return F.aggregate(
            terms, F.lit(0.0),
            lambda acc, t: acc
            + F.when(head.contains(t), HEADING_WEIGHT / 2).otherwise(0.0)
            + F.when(content.contains(t), CONTENT_WEIGHT / 2).otherwise(0.0),
        )

    numbers = F.sequence(F.lit(0), (F.size(sections) / 2 - 1).cast("int"))
    return F.when(F.size(sections) > 0, F.array_max(F.transform(numbers, value))).otherwise(0.0)


def _expansion_terms(top: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query and vault, the terms that feedback pages add: (query_id, vault, expansion)."""
    words = top.where(F.col("rank") <= FEEDBACK_PAGES).select(
        "query_id", "vault",
        F.explode(F.split(normalize_text(F.concat_ws(" ", *[F.col(f"meta_{n}") for n in META], "body")), " ")).alias("word"),
    ).where((F.length("word") >= 4) & ~F.col("word").isin(STOP_WORDS))
    counted = words.groupBy("query_id", "vault", "word").agg(F.count(F.lit(1)).alias("n"))
    fresh = counted.join(queries.select("query_id", "normalized"), "query_id").where(
        ~F.col("normalized").contains(F.col("word"))
    )
    order = Window.partitionBy("query_id", "vault").orderBy(F.desc("n"), F.asc("word"))
    kept = fresh.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= FEEDBACK_TERMS)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda t: t["word"]), " "
    )
    return kept.groupBy("query_id", "vault").agg(joined.alias("joined")).select(
        "query_id", "vault",
        F.transform(terms_of(F.col("joined")), compact_text).alias("expansion"),
    )


def recall(
    pages: DataFrame, queries: DataFrame, max_results: int = 5, min_score: float = 0.0,
    vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
    weight: float = SEMANTIC_WEIGHT, index: DataFrame | None = None,
) -> DataFrame:
    """Ranked pages per query and vault: results(query_id, vault, rank, id, title, type, preview, score).

    pages(id, type, title, body, ...), queries(query_id BIGINT, query). With vectors and
    query_vectors (both with a `vector` array) the ranking is hybrid. Pass a stored
    search_index to skip normalising the pages again.
    """
    if "vault" not in pages.columns:
        pages = pages.withColumn("vault", F.lit("main"))
    prepared = prepare_queries(queries)
    total = prepared.count()
    hybrid = vectors is not None and query_vectors is not None
    if index is None:
        index = search_index(pages, vectors if hybrid else None)
    scored = score_pages(
        index, prepared, query_vectors if hybrid else None, weight, max(max_results, 1), total
    ).withColumn("base", fuse_scores(F.col("lexical"), F.col("cosine"), weight))
    if hybrid:
        ranked = scored.withColumn("rank", _rank("lexical")).withColumn("rank_base", _rank("base"))
        ranked = ranked.where(
            (F.col("rank") <= BOOSTED_PAGES) | (F.col("rank_base") <= max_results)
        ).drop("rank_base")
    else:
        # Feedback only raises the first BOOSTED_PAGES, so no later page can pass them.
        ranked = scored.withColumn("rank", _rank("lexical")).where(
            F.col("rank") <= max(BOOSTED_PAGES, max_results)
        )
    # At most BOOSTED_PAGES + max_results rows per query and vault.
    wanted = materialise(ranked.select("query_id", "vault", "id", "lexical", "chunk_no", "base", "rank"))
    pages = with_fields(pages, META + ["body"])
    fetched = (
        pages.select(
            "vault", "id", F.col("type").alias("page_type"),
            semantic_title(F.col("title"), F.col("id")).alias("meta_title"),
            *[_text(pages, n).alias(f"meta_{n}") for n in META if n != "title"],
            F.coalesce("body", F.lit("")).alias("body"),
        )
        .join(broadcast_if_small(wanted), ["vault", "id"])
    )
    top = materialise(fetched.select("*", chunk_array(F.col("body")).alias("chunks")))
    expansion = _expansion_terms(top, prepared)
    lowered = search_index(
        top.select("vault", "id", "body", F.lit("").alias("type")).dropDuplicates(["vault", "id"])
    ).select("vault", "id", "sections")
    boosted = (
        top.join(lowered, ["vault", "id"])
        .join(expansion, ["query_id", "vault"], "left")
        .withColumn(
            "boost",
            F.when(
                (F.col("rank") <= BOOSTED_PAGES) & F.col("expansion").isNotNull(),
                _section_boost(F.col("sections"), F.col("expansion")) * BOOST_SHARE,
            ).otherwise(0.0),
        )
        .withColumn("score", F.col("base") + F.col("boost"))
        .where(F.col("score") >= min_score)
        .withColumn("position", _rank("score"))
        .where(F.col("position") <= max_results)
    )
    best = F.get(F.col("chunks"), F.col("chunk_no"))
    has_chunk = (F.col("chunk_no") >= 0) & (best["content"] != "")
    return boosted.select(
        "query_id", "vault", F.col("position").cast("bigint").alias("rank"), "id",
        F.col("meta_title").alias("title"),
        F.coalesce(F.nullif("page_type", F.lit("")), F.lit("page")).alias("type"),
        F.when(has_chunk, chunk_preview(best["heading"], best["content"]))
        .otherwise(page_preview(F.col("body"))).alias("preview"),
        "score",
    )


def recall_layered(results: DataFrame, max_results: int = 5, personal: str = "personal") -> DataFrame:
    """Merge per-vault results: personal block first, one row per id, cut to max_results.

    At most two result lists per query, so the windows are small.
    """
    layer = F.when(F.col("vault") == personal, 0).otherwise(1)
    first = Window.partitionBy("query_id", "id").orderBy("layer", "rank")
    block = Window.partitionBy("query_id").orderBy("layer", "rank")
    return (
        results.withColumn("layer", layer)
        .withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .withColumn("_pos", F.row_number().over(block)).where(F.col("_pos") <= max_results)
        .withColumn("rank", F.col("_pos").cast("bigint"))
        .drop("_n", "_pos", "layer")
    )


def only_kinds(results: DataFrame, kinds: list[str], max_results: int = 5) -> DataFrame:
    """Keep skill and case results of an over-fetched list, renumbered and cut."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        results.where(F.col("type").isin(kinds))
        .withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") <= max_results)
        .withColumn("rank", F.col("_pos").cast("bigint")).drop("_pos")
    )


def uses_links_first(page_count: Column, threshold: int = 50) -> Column:
    return page_count > threshold


def vault_sizes(pages: DataFrame) -> DataFrame:
    """sizes(vault, pages, links_first): how many pages each vault has, and how to show its results."""
    counted = pages.groupBy("vault").agg(F.count(F.lit(1)).cast("bigint").alias("pages"))
    return counted.withColumn("links_first", uses_links_first(F.col("pages")))


def with_links_first(results: DataFrame, pages: DataFrame, threshold: int = 50) -> DataFrame:
    """results(query_id, vault, ...) with links_first: whether the vaults that answered a query
    have, together, more pages than `threshold`, so that links are shown instead of bodies."""
    sizes = pages.groupBy("vault").agg(F.count(F.lit(1)).alias("_pages"))
    asked = results.select("query_id", "vault").distinct().join(sizes, "vault")
    total = asked.groupBy("query_id").agg(uses_links_first(F.sum("_pages"), threshold).alias("links_first"))
    return results.join(total, "query_id")


def link_snippet(preview: Column) -> Column:
    line = collapse_space(preview)
    cut = F.concat(left_units(line, 80), F.lit("…"))
    return F.when(F.length(line) > 80, cut).otherwise(line)


def is_skill_or_case(type_: Column, doc_id: Column) -> Column:
    return type_.isin("skill", "case") | doc_id.startswith("skills/") | doc_id.startswith("cases/")


def inline_skill_body(body: Column, limit: int = 1600) -> Column:
    """Body to show under a skill or case result, NULL when blank; limit 0 turns it off."""
    if limit <= 0:
        return F.lit(None).cast("string")
    text = trim_space(F.replace(body, F.lit("\r\n"), F.lit("\n")))
    cut = F.concat(
        left_units(text, limit),
        F.lit("\n…(truncated — `read` the path above for the full page)"),
    )
    return blank_to_null(F.when(F.length(text) > limit, cut).otherwise(text))


def fenced_block(body: Column, indent: str) -> Column:
    """Indented code fence longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    lines = F.transform(F.split(body, "\n"), lambda line: F.concat(F.lit(indent), line))
    return F.concat(
        F.lit(f"\n{indent}"), fence, F.lit("\n"), F.array_join(lines, "\n"),
        F.lit(f"\n{indent}"), fence,
    )


def render_context(
    results: DataFrame, bodies: DataFrame | None = None, links_first: bool = False,
    skill_inline_max: int = 1600, personal: str = "personal",
) -> DataFrame:
    """context(query_id, text): one rendered block per query from at most ten results.

    results need a `path` column; bodies(vault?, id, body) supply skill and case texts to inline.
    """
    skill = is_skill_or_case(F.col("type"), F.col("id"))
    rows = results.withColumn("skill", skill)
    if bodies is not None and skill_inline_max > 0:
        keys = ["vault", "id"] if "vault" in bodies.columns else ["id"]
        rows = rows.join(bodies.select(*keys, F.col("body").alias("_body")), keys, "left")
    else:
        rows = rows.withColumn("_body", F.lit(None).cast("string"))
    rows = rows.withColumn(
        "inline", F.when(F.col("skill"), inline_skill_body(F.col("_body"), skill_inline_max))
    )
    layered = F.col("vault") == personal
    tag = F.when(layered, " 📓 personal").otherwise("")
    if links_first:
        tail = link_snippet(F.col("preview"))
        line = F.concat(
            F.col("rank").cast("string"), F.lit(". **[["), "id", F.lit("]]** — *"), "type",
            F.lit("* — score "), F.format_string("%.1f", "score"), tag, F.lit(" — "), "title",
            F.when(tail != "", F.concat(F.lit(" — "), tail)).otherwise(""),
            F.lit("\n   ↳ `read "), "path", F.lit("`"),
            F.coalesce(F.concat(F.lit("\n"), fenced_block(F.col("inline"), "   ")), F.lit("")),
        )
    else:
        shown = F.when(F.col("preview") == "", "").otherwise(
            F.concat(
                F.lit("\n  "),
                F.when(F.length("preview") > 120, F.concat(left_units(F.col("preview"), 120), F.lit("…")))
                .otherwise(F.col("preview")),
            )
        )
        inlined = F.concat(
            F.lit("\n  ↳ `read "), "path", F.lit("`\n"), fenced_block(F.col("inline"), "  ")
        )
        line = F.concat(
            F.lit("- **[["), "id", F.lit("]]** — *"), "type", F.lit("* — "), "title", tag,
            F.coalesce(inlined, shown), F.lit("\n"),
        )
    ordered = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line")))),
            lambda r: r["line"],
        ),
        "\n",
    )
    blocks = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(layered).alias("layered"),
        F.max("skill").alias("skill"), ordered.alias("lines"),
    )
    label = F.when(F.col("layered"), " (personal + project)").otherwise("")
    nudge = F.when(
        F.col("skill"),
        "\n⚠️ A distilled skill/case below matches this task — read and APPLY it BEFORE "
        "experimenting on your own.\n",
    ).otherwise("")
    number = F.col("n").cast("string")
    if links_first:
        head = F.concat(
            F.lit("## Relevant Wiki Knowledge (links-first)\n"), nudge, F.lit("\n_"), number,
            F.lit(" page(s) matched your query"), label,
            F.lit(", ranked. Two-stage recall: links only — open the ones you need to read their full content._\n\n"),
        )
        foot = (
            "\n\nCall `read` on the exact path shown under each link to pull its full content."
            " Add new findings via wiki_ensure_page or wiki_retro.\n"
        )
    else:
        head = F.concat(
            F.lit("## Relevant Wiki Knowledge\n"), nudge, F.lit("\n_"), number,
            F.lit(" page(s) matched your query"), label, F.lit("._\n\n"),
        )
        foot = "\nUse `read` to view full pages. Add new findings via wiki_ensure_page or wiki_retro.\n"
    return blocks.select("query_id", F.concat(head, "lines", F.lit(foot)).alias("text"))
