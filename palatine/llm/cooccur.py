"""Items that appear together: stripes of co-occurring neighbours with a log-likelihood ratio.

Every task builds, for the baskets it reads, one associative array (stripe) of
neighbour counts per item; stripes, not pairs, are shuffled by item and merged
key by key.  The stripes of hot items are cut into parts by neighbour, so that no
task has to merge the whole of one.  Items below the support that any reported pair needs are pruned
first (a pair cannot occur more often than its rarer item), which loses nothing.

Items travel as 64-bit hashes and get their names back at the end; among V
items two share a hash with probability V**2 / 2**65.

Defined cases: null, empty and repeated values do not count; baskets that are
null or empty are no baskets; no baskets give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint

#: Pair counts a task holds before it passes its stripes on; frequent items (8 bytes each) up to which the pruning set is sent to tasks.
HELD, PRUNE_ITEMS = 8_000_000, 1_000_000
#: Parts of a hot item's stripe; hot is an item in more than a thousandth of all places, so there are at most a thousand.
PARTS, HOT_SHARE = 64, 1000
#: The ratio that chance exceeds in one of twenty pairs (chi-square with one degree of freedom).
SIGNIFICANT = 3.8415


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    return c[first], np.add.reduceat(n, first)


def stripe_batches(keep: np.ndarray | None, held: int = HELD, chunk: int = 4096, hot: np.ndarray | None = None):
    """mapInArrow over (items array<bigint>): stripes (item, part, neighbours, counts), neighbour > item as signed numbers.

    ``hot`` items (sorted) have a stripe for each part of their neighbours.
    """
    hot = np.zeros(0, np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.zeros(0, np.int64)  # sorted hashes met so far in this task
        store: tuple[list, list] = ([], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if size:
                codes, counts = _merge(*store)
                a, b = codes >> 32, codes & 0xFFFFFFFF
                is_hot = hot[np.minimum(np.searchsorted(hot, ids[a]), len(hot) - 1)] == ids[a] if len(hot) else np.zeros(len(a), bool)
                part = np.where(is_hot, ids[b] & (PARTS - 1), 0).astype(np.int32)
                order = np.lexsort((part, a))
                a, b, counts, part = a[order], b[order], counts[order], part[order]
                heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]))))
                for at in range(0, len(heads), 256):  # a few stripes at a time keeps batches small
                    some = heads[at : at + 256]
                    lo, hi = some[0], heads[at + 256] if at + 256 < len(heads) else len(a)
                    off = pa.array(np.append(some, hi).astype(np.int32) - np.int32(lo))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a[some]]), pa.array(part[some]), pa.ListArray.from_arrays(off, pa.array(ids[b[lo:hi]])), pa.ListArray.from_arrays(off, pa.array(counts[lo:hi]))],
                        names=["item", "part", "neighbours", "counts"],
                    )
            store[0].clear(), store[1].clear()
            size = 0

        def count(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Add pair codes to the store; merge it when it is full, and pass stripes on when merging no longer helps."""
            nonlocal size
            if found:
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                store[0].append(codes), store[1].append(counts.astype(np.int64))
                size += len(codes)
                found.clear()
            if size > held:
                merged = _merge(*store)
                store[0][:], store[1][:] = [merged[0]], [merged[1]]
                size = len(merged[0])
                if size > held * 3 // 4:
                    yield from flush()

        ids = np.zeros(0, np.int64)  # number to hash
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                col = whole.slice(at, chunk).column(0)
                offsets = col.offsets.to_numpy()
                flat = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                row = np.repeat(np.arange(len(col)), np.diff(offsets))
                if keep is not None and len(flat):
                    seen = keep[np.minimum(np.searchsorted(keep, flat), len(keep) - 1)] == flat if len(keep) else np.zeros(len(flat), bool)
                    flat, row = flat[seen], row[seen]
                if not len(flat):
                    continue
                fresh = np.setdiff1d(flat, names)
                if len(fresh):
                    ids = np.concatenate((ids, fresh))
                    order = np.argsort(ids, kind="stable")
                    names, numbers = ids[order], order
                num = numbers[np.searchsorted(names, flat)]
                order = np.lexsort((flat, row))
                num, row = num[order], row[order]
                sizes = np.bincount(row, minlength=len(col))
                start = np.cumsum(sizes) - sizes
                found = []
                for m in np.unique(sizes[sizes > 1]):
                    at_rows = start[sizes == m]
                    if m > 2000:  # one basket at a time, item by item
                        for s in at_rows:
                            x = num[s : s + m]
                            pending = 0
                            for i in range(m - 1):
                                found.append((x[i] << 32) | x[i + 1 :])
                                pending += m - 1 - i
                                if pending > held:
                                    yield from count(found)
                                    pending = 0
                            yield from count(found)
                        continue
                    i, j = np.triu_indices(m, 1)
                    step = max(1, 4_000_000 // len(i))
                    for k in range(0, len(at_rows), step):
                        mat = num[at_rows[k : k + step, None] + np.arange(m)]
                        found.append(((mat[:, i] << 32) | mat[:, j]).reshape(-1))
                yield from count(found)
        yield from flush()

    return run


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def llr(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Log-likelihood ratio G² of the 2×2 table of two items."""
    ab, a, b, t = (c.cast("double") for c in (n_ab, n_a, n_b, n))
    cells = xlogx(ab) + xlogx(a - ab) + xlogx(b - ab) + xlogx(t - a - b + ab)
    sides = xlogx(a) + xlogx(t - a) + xlogx(b) + xlogx(t - b)
    return F.lit(2.0) * (cells - sides + xlogx(t))


def pruned(hashed: DataFrame, items: DataFrame) -> DataFrame:
    """``hashed`` (items) without the items that are not in ``items`` (item), where those are too many to be sent to every task."""
    placed = checkpoint(hashed.withColumn("b", F.monotonically_increasing_id()))
    kept = placed.select("b", F.explode("items").alias("item")).join(items.select("item"), "item", "left_semi")
    return kept.groupBy("b").agg(F.array_sort(F.collect_list("item")).alias("items")).select("items")


def significant(pairs: DataFrame, least: float = SIGNIFICANT) -> DataFrame:
    """The ``pairs`` that stand together more often than chance with a log-likelihood ratio of ``least`` or more.

    A pair in n baskets that exceeds chance r times has a ratio of at least
    2n(ln r - 1 + 1/r); five baskets and threefold chance give 4.3.
    """
    return pairs.where((F.col("lift") > 1) & (F.col("llr") >= least))


def cooccurrence(baskets: DataFrame, min_count: int = 1, min_share_ppm: int = 0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr), item_a < item_b, of ``baskets`` (items: sorted distinct texts).

    Pairs with n_ab below ``min_count`` or below ``min_share_ppm`` millionths of
    the baskets are left out; both bounds also prune items beforehand.
    """
    baskets = checkpoint(baskets.where(F.size("items") > 0).select("items"))
    total = baskets.count()
    least = max(1, min_count, -(-min_share_ppm * total // 1_000_000))
    every = baskets.select(F.explode("items").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    items = checkpoint(every.where(F.col("n") >= least).select(F.xxhash64("name").alias("item"), "name", "n"))
    hashed = baskets.select(F.transform("items", lambda v: F.xxhash64(v)).alias("items"))
    keep = None
    if least > 1:
        found = items.select("item").limit(PRUNE_ITEMS + 1).toPandas()["item"].to_numpy(np.int64)
        if len(found) <= PRUNE_ITEMS:
            keep = np.sort(found)
        else:
            hashed = pruned(hashed, items)
    places = items.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in items.where(F.col("n") > max(1, places // HOT_SHARE)).select("item").collect()]  # at most HOT_SHARE
    stripes = hashed.mapInArrow(stripe_batches(keep, hot=np.sort(np.array(hot, np.int64))), "item bigint, part int, neighbours array<bigint>, counts array<bigint>")
    merged = (
        stripes.repartition("item", "part")
        .select("item", "part", F.explode(F.arrays_zip("neighbours", "counts")).alias("s"))
        .groupBy("item", "part", F.col("s.neighbours").alias("other"))
        .agg(F.sum("s.counts").alias("n_ab"))
        .where(F.col("n_ab") >= least)
    )
    one = items.select("item", F.col("name").alias("x"), F.col("n").alias("nx"))
    two = items.select(F.col("item").alias("other"), F.col("name").alias("y"), F.col("n").alias("ny"))
    ordered = F.col("x") < F.col("y")
    pairs = merged.join(one, "item").join(two, "other").select(
        F.when(ordered, F.col("x")).otherwise(F.col("y")).alias("item_a"),
        F.when(ordered, F.col("y")).otherwise(F.col("x")).alias("item_b"),
        "n_ab",
        F.when(ordered, F.col("nx")).otherwise(F.col("ny")).alias("n_a"),
        F.when(ordered, F.col("ny")).otherwise(F.col("nx")).alias("n_b"),
        F.lit(total).cast("bigint").alias("n"),
    )
    return pairs.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")).cast("double")).withColumn("llr", llr(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")))
