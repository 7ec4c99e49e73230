"""Top N items within every group by bounded heaps built before the shuffle.

Each task keeps, for every group it meets, the best N entries; only these are
shuffled by group, and merged by a window that streams and spills.  A group's
rows stay where they are read, so a hot group is reduced by as many tasks as
hold its rows, and no task holds more than N entries of it.

Of an item's rows in a group the one with the largest ``seq`` counts, whatever
its score, so items with several rows must be reduced to one row before heaps
may drop any.  They are found by counting 64-bit hashes of (group, item), which
alone are shuffled; the rows of all other items go straight to the heaps.  Where
items with several rows are too many to be sent to every task (REPEATED), all
rows are reduced by (group, item) first.

Order: score descending, then item ascending (code points).  Defined cases:
null and NaN scores, null groups and null items are left out after the latest
row of an item has been chosen; groups without a limit give nothing; a limit
below 1 or null gives nothing; of rows that tie on ``seq`` the higher score
counts; empty inputs give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint, small_side

#: Rows a task gathers before it reduces them, and entries it holds before it passes its heaps on.
GATHERED, HELD = 200_000, 500_000
#: Hashes of repeated items (8 bytes each) that are broadcast.
REPEATED = 2_000_000


def best_of(rows: pa.Table) -> pa.Table:
    """The n best rows of each id of a table (id, item, score, n)."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("score", "descending"), ("item", "ascending")]))
    ids = rows.column("id").combine_chunks()
    first = np.flatnonzero(np.concatenate(([True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))) if len(ids) else np.zeros(0, int)
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return rows.filter(pa.array(place < rows.column("n").to_numpy()))


def heap_batches(gathered: int = GATHERED, held: int = HELD):
    """mapInArrow over (id, item, score, n): the same columns, at most n rows of each id per flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, fresh, size = None, [], 0

        def reduced() -> pa.Table:
            return best_of(pa.concat_tables([*([heaps] if heaps is not None else []), pa.Table.from_batches(fresh)]))

        for b in batches:
            fresh.append(b)
            size += b.num_rows
            if size >= gathered:
                heaps, fresh, size = reduced(), [], 0
                if heaps.num_rows > held:  # heaps can be merged, so passing them on early changes nothing
                    yield from heaps.to_batches()
                    heaps = None
        if fresh:
            heaps = reduced()
        if heaps is not None:
            yield from heaps.to_batches()

    return run


def top_n_per_group(rows: DataFrame, limits: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """(id, place, item): the best items of each id.

    ``rows`` has (id, item, seq, score), ``limits`` (id, n).
    """
    limits = checkpoint(limits.where("n >= 1 and id is not null").groupBy("id").agg(F.max("n").cast("int").alias("n")))
    rows = rows.where(F.col("id").isNotNull() & F.col("item").isNotNull()).select("id", "item", "seq", "score", F.xxhash64("id", "item").alias("h"))
    again = checkpoint(rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"))
    latest = lambda r: r.groupBy("id", "item").agg(F.max(F.struct(F.col("seq"), F.col("score"))).alias("m")).select("id", "item", "m.score")
    if again.count() <= repeated:
        single = rows.join(F.broadcast(again), "h", "left_anti").select("id", "item", "score")
        rows = single.unionByName(latest(rows.join(F.broadcast(again), "h", "left_semi")))
    else:
        rows = latest(rows)
    good = rows.where(F.col("score").isNotNull() & ~F.isnan("score")).join(small_side(limits), "id")
    heaps = good.select("id", "item", "score", "n").mapInArrow(heap_batches(), "id string, item string, score double, n int")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "item"))
    return heaps.withColumn("place", place.cast("bigint")).where("place <= n").select("id", "place", "item")
