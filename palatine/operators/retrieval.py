"""BM25 retrieval: index statistics, scoring by token join, top k with zero-score fill.

For a top k the weighted query tokens go out in blocks of bounded size, one
after another; every task scores its documents against a block with array
arithmetic, by matrix products for tokens that are frequent on both sides and by
postings for all others, and passes on each query's best k; neither documents
nor scores are shuffled.  A block that is still too large (one query of very
many tokens), and where all scores are asked for, tokens are joined: documents
are placed by id once and scores are summed per (document, query) where they lie
while the query side can be broadcast, else both sides are shuffled by token,
left to adaptive execution to split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palatine.functions.normalize import first_truthy, tokens
from palatine.operators.physical import BROADCAST_BYTES, is_small, kept, spread

K1, B = 1.5, 0.75
#: Query tokens up to which they are broadcast.
QUERY_TOKENS = 1_000_000
#: Digits of a score that is shown, and of one that is ranked: sums of the same parts in another order agree in so many.
DIGITS, RANK_DIGITS = 6, 12
#: Documents and their tokens scored together, queries of one matrix product, of one addition of postings, and pairs scored in full at once.
DOC_BLOCK, TOKEN_BLOCK, QUERY_STEP, ADD_STEP, PAIR_STEP = 65_536, 4_000_000, 64, 8, 8_192
#: Share of the (document, query) pairs that have a token in common from which it is multiplied densely, and the most of such tokens.
DENSE_SHARE, DENSE_TOKENS = 0.03, 256
#: Relative error allowed to the first, single-precision scores; what may be among the best is scored again in full.
SLACK = 1e-4


def food_document(food: Column | str, molecules: Column | str) -> Column:
    """Corpus text of a food task; the words food and molecules are tokens of it."""
    return F.concat(F.lit("Food: "), first_truthy(food), F.lit(". Molecules: "), molecule_text(molecules))


def molecule_text(molecules: Column | str) -> Column:
    m = F.col(molecules) if isinstance(molecules, str) else molecules
    return F.array_join(F.coalesce(m, F.array().cast("array<string>")), " ")


def completion_document(food: Column | str, partial: Column | str, missing: Column | str) -> Column:
    """Corpus text of a completion task: food, known and missing molecules."""
    return F.concat_ws(" ", first_truthy(food), molecule_text(partial), molecule_text(missing))


def completion_query(food: Column | str, partial: Column | str) -> Column:
    """Query text of a completion task: food and known molecules; never the answer, never n."""
    return F.concat_ws(" ", first_truthy(food), molecule_text(partial))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _cut(rows: DataFrame, text: str = "text") -> Column:
    """The tokens of ``text``; of rows that are cut already, their column ``tokens``."""
    return F.col("tokens") if text not in rows.columns and "tokens" in rows.columns else tokens(text)


def document_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, dl, token, tf): one row per distinct token of a document, placed by document."""
    cut = docs.select(F.col(key).alias("doc_id"), _cut(docs, text).alias("_t"))
    return cut.select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("token")).groupBy("doc_id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n, avgdl): all documents count, also those without tokens; avgdl is 0 without documents."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg(F.size(_cut(docs, text)).cast("double")), F.lit(0.0)).alias("avgdl"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, df)"""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def weighted_queries(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, token, w, n, avgdl): query tokens in the corpus, weighted by their count in the query and by idf."""
    qt = queries.select("query_id", F.explode(_cut(queries)).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    vocabulary = qt.select("token").distinct()
    vocabulary = F.broadcast(vocabulary) if is_small(vocabulary, QUERY_TOKENS) else vocabulary
    df = docs.select(F.explode(F.array_distinct(_cut(docs))).alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("df"))
    # corpus_stats is one row
    return qt.join(df, "token").crossJoin(F.broadcast(corpus_stats(docs))).select("query_id", "token", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"), "n", "avgdl")


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of all pairs with a common token; ``docs`` (doc_id, text), ``queries`` (query_id, text).

    A token that a query repeats counts as often as it stands there.
    """
    return _joined_scores(docs, weighted_queries(docs, queries), k1, b)


def _joined_scores(docs: DataFrame, weighted: DataFrame, k1: float, b: float) -> DataFrame:
    small = is_small(weighted, QUERY_TOKENS)
    dt = document_tokens(docs.repartition("doc_id") if small else docs)
    hits = dt.join(F.broadcast(weighted) if small else weighted, "token")
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0))
    part = F.col("w") * (F.col("tf") * F.lit(k1 + 1.0)) / (F.col("tf") + F.lit(k1) * norm)
    return hits.groupBy("doc_id", "query_id").agg(F.round(F.sum(part), RANK_DIGITS).alias("score")).select("query_id", "doc_id", "score")


class _Queries:
    """Weighted tokens of a block of queries: those of query i are ``token[start[i]:start[i + 1]]`` with weights ``w``."""

    def __init__(self, q: np.ndarray, token: np.ndarray, w: np.ndarray, n: int, words: pa.Array):
        order = np.lexsort((token, q))
        self.q, self.token, self.w, self.n, self.words = q[order].astype(np.int32), token[order].astype(np.int32), w[order], n, words
        self.start = np.searchsorted(self.q, np.arange(n + 1))


def _taken(start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of such starts and lengths, one run after another, and where each run begins among them."""
    at = np.cumsum(lengths) - lengths
    return np.repeat(start - at, lengths) + np.arange(lengths.sum()), at


class _Best:
    """The k best documents of every query so far, equal scores by id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.rows = k, np.zeros(n), [[] for _ in range(n)]

    def add(self, q: int, rows: list[tuple]) -> None:
        """``rows``: (negative score, id)."""
        rows = sorted(self.rows[q] + rows, key=lambda r: (r[0], r[1] is not None, r[1]))[: self.k]
        self.rows[q] = rows
        if len(rows) == self.k:
            self.floor[q] = -rows[-1][0]


def _where(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask of few true values; its length is a multiple of 8."""
    eights = np.flatnonzero(mask.view(np.uint64) != 0)
    at = np.flatnonzero(mask.reshape(-1, 8)[eights])
    return eights[at >> 3] * 8 + (at & 7)


def _least(rows: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that its k-th largest value reaches: the k-th largest of the largest values of pieces of the row; 0 where fewer are positive."""
    pieces = np.maximum.reduceat(rows, np.arange(0, rows.shape[1], max(8, rows.shape[1] // max(64, 4 * k))), axis=1)
    return np.partition(pieces, pieces.shape[1] - k, axis=1)[:, -k] if pieces.shape[1] >= k else np.zeros(len(rows), rows.dtype)


def _score_block(best: _Best, queries: _Queries, ids: list, dl: np.ndarray, doc: np.ndarray, token: np.ndarray, avgdl: float, k1: float, b: float) -> None:
    """Score the documents of a block, whose known tokens are (doc, token), against all queries."""
    if not len(doc):
        return
    k, n, size = best.k, len(dl), len(queries.words)
    code, tf = np.unique(doc * size + token, return_counts=True)
    d, t = (code // size).astype(np.int32), (code % size).astype(np.int32)
    del code
    value = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl[d] / (avgdl or 1.0)))
    doc_start = np.searchsorted(d, np.arange(n + 1))
    doc_size = np.diff(doc_start)
    order = np.argsort(t, kind="stable")  # postings: by token, then by document
    posting, weight = d[order].astype(np.uint16 if n <= 1 << 16 else np.int32), value[order].astype(np.float32)
    start = np.searchsorted(t[order], np.arange(size + 1))
    del d, order, tf
    df = np.diff(start)
    share = df / n * (np.bincount(queries.token, minlength=size) / max(1, queries.n))
    dense = np.argsort(-share)[:DENSE_TOKENS]
    dense = dense[share[dense] >= DENSE_SHARE]
    slot = np.full(size, -1)
    slot[dense] = np.arange(len(dense))
    places = -(-n // 8) * 8
    table = np.zeros((len(dense), places), np.float32)
    for row, x in zip(table, dense.tolist()):
        row[posting[start[x] : start[x + 1]]] = weight[start[x] : start[x + 1]]
    place = slot[queries.token]
    sparse = np.flatnonzero((place < 0) & (df[queries.token] > 0))
    few_start = np.searchsorted(queries.q[sparse], np.arange(queries.n + 1))
    some, column = np.empty((min(QUERY_STEP, queries.n), places), np.float32), np.zeros(size, np.int32)
    for lo in range(0, queries.n, QUERY_STEP):
        hi = min(queries.n, lo + QUERY_STEP)
        x = slice(queries.start[lo], queries.start[hi])
        q_of, m = queries.q[x] - lo, place[x] >= 0
        left = np.zeros((hi - lo, len(dense)), np.float32)
        left[q_of[m], place[x][m]] = queries.w[x][m]
        rows = np.matmul(left, table, out=some[: hi - lo])
        few = sparse[few_start[lo] : few_start[hi]]
        w, lengths, runs = queries.w[few].astype(np.float32), df[queries.token[few]], list(zip(start[queries.token[few]].tolist(), start[queries.token[few] + 1].tolist()))
        ends = (few_start[lo : hi + 1] - few_start[lo]).tolist()
        for at in range(0, hi - lo, ADD_STEP):
            i, j = ends[at], ends[min(at + ADD_STEP, hi - lo)]
            if i < j:
                part = np.concatenate([weight[u:v] for u, v in runs[i:j]])
                part *= np.repeat(w[i:j], lengths[i:j])
                cell = np.concatenate([posting[u:v] for u, v in runs[i:j]]).astype(np.intp)
                cell += np.repeat((queries.q[few[i:j]] - lo).astype(np.intp) * places, lengths[i:j])
                np.add.at(rows.reshape(-1), cell, part)
        floor = best.floor[lo:hi]
        if not floor.all():
            floor = np.maximum(floor, _least(rows, k))
        found = _where((rows > (floor * (1 - SLACK)).astype(np.float32)[:, None]).reshape(-1))
        used = np.unique(queries.token[x])
        column[used] = np.arange(1, len(used) + 1)
        full = np.zeros((hi - lo, len(used) + 1))
        full[q_of, column[queries.token[x]]] = queries.w[x]
        for pairs in (found[at : at + PAIR_STEP] for at in range(0, len(found), PAIR_STEP)):
            q, hits = np.divmod(pairs, places)
            at, first = _taken(doc_start[hits], doc_size[hits])
            score = np.round(np.add.reduceat(full[np.repeat(q, doc_size[hits]), column[t[at]]] * value[at], first), RANK_DIGITS)
            keep = np.flatnonzero((score >= best.floor[q + lo]) & (score > 0))
            keep = keep[np.lexsort((-score[keep], q[keep]))]
            q, hits, score = q[keep], hits[keep], score[keep]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            size_of = np.diff(first, append=len(q))
            last = score[first + np.minimum(k, size_of) - 1]  # what is worse than a query's k-th here is not among its best
            keep = np.flatnonzero(score >= np.repeat(last, size_of))
            q, hits, score = (q[keep] + lo).tolist(), hits[keep].tolist(), (-score[keep]).tolist()
            for one, own in groupby(zip(q, score, hits), key=itemgetter(0)):
                best.add(one, [(x, ids[i]) for _, x, i in own])
        column[used] = 0


def _block_scorer(queries: _Queries, avgdl: float, k: int, k1: float, b: float):
    """mapInArrow over (doc_id, tokens): (query number, doc_id, score) of every query's best k among the documents of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(queries.n, k), pa.null()
        ids, dl, doc, token, held = [], [], [], [], 0

        def flush() -> None:
            if ids:
                _score_block(best, queries, ids, np.concatenate(dl), np.concatenate(doc), np.concatenate(token), avgdl, k1, b)
                for x in (ids, dl, doc, token):
                    x.clear()

        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                known = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=queries.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                if ids and (len(ids) + len(n) > DOC_BLOCK or held + len(known) > TOKEN_BLOCK):
                    flush()
                    held = 0
                doc.append(np.repeat(np.arange(len(n)) + len(ids), n)[known >= 0])
                token.append(known[known >= 0])
                dl.append(n.astype(float))
                ids.extend(batch.column(0).to_pylist())
                held += len(known)
        flush()
        for lo in range(0, queries.n, 10_000):
            rows = [(q, i, -s) for q in range(lo, min(queries.n, lo + 10_000)) for s, i in best.rows[q]]
            if rows:
                q, i, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, kind), pa.array(s, pa.float64())], names=["q", "doc_id", "score"])

    return run


def _scored_blocks(docs: DataFrame, weighted: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) of rows that contain every query's best k; ``docs`` (doc_id, tokens)."""
    spark = docs.sparkSession
    rows = weighted.select("query_id", "token", "w").toArrow()  # bounded by the caller
    q, t = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "token"))
    by = pc.sort_indices(t.dictionary).to_numpy()
    number = np.empty(len(by), np.int64)
    number[by] = np.arange(len(by))
    avgdl = weighted.select("avgdl").first()
    queries = _Queries(q.indices.to_numpy(), number[t.indices.to_numpy()], rows.column("w").to_numpy(), len(q.dictionary), t.dictionary.take(pa.array(by)))
    run = _block_scorer(queries, avgdl[0] if avgdl else 0.0, k, k1, b)
    placed = spread(docs.select("doc_id", "tokens"))
    placed = placed.coalesce(2 * spark.sparkContext.defaultParallelism)  # every task passes on k rows a query
    scored = placed.mapInArrow(run, f"q bigint, doc_id {dict(docs.dtypes)['doc_id']}, score double")
    names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(queries.n)), "query_id": q.dictionary}))
    return scored.join(F.broadcast(names), "q").select(F.col("query_id").cast(weighted.schema["query_id"].dataType), "doc_id", "score")


def top_k(scores: DataFrame, k: int, position: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score): by score, then by corpus position; k rows per task and query are shuffled."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), position)
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 3, fill: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, doc_id, score); documents that match nothing fill up to k, in corpus order, with score 0.

    ``doc_id`` is the corpus position.  Only the first 2k documents can be
    needed for filling, since fewer than k of them match.
    """
    docs = kept(docs.select("doc_id", _cut(docs).alias("tokens")))
    queries = kept(queries.select("query_id", _cut(queries).alias("tokens")))
    weighted = kept(weighted_queries(docs, queries))
    held = F.sum(F.octet_length(F.col("query_id").cast("string")) + F.octet_length("token") + 16)
    rows, size = weighted.agg(F.count(F.lit(1)), F.coalesce(held, F.lit(0))).first()
    blocks = max(1, -(-rows * 5 // (4 * max(1, QUERY_TOKENS))), -(-size * 5 // (4 * BROADCAST_BYTES))) if QUERY_TOKENS else 1
    best = None
    for i in range(blocks):
        block = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else weighted
        rows, size = block.agg(F.count(F.lit(1)), F.coalesce(held, F.lit(0))).first()
        fits = rows <= 2 * QUERY_TOKENS and size <= 2 * BROADCAST_BYTES
        scores = _scored_blocks(docs, block, k, k1, b) if rows and fits else _joined_scores(docs, block, k1, b)
        found = kept(top_k(scores, k).select("query_id", "doc_id", "score"))  # at most k rows a query, read three times below
        best = found if best is None else best.unionByName(found)
    if fill:
        lacking = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left").where(F.coalesce("m", F.lit(0)) < k).select("query_id")
        first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
        extra = lacking.crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
        best = best.unionByName(extra)
    return top_k(best, k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", DIGITS).alias("score"))


def packed(ranked: DataFrame) -> DataFrame:
    """(query_id, retrieved): the ranked documents of a query as one array of structs."""
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("retrieved"))

