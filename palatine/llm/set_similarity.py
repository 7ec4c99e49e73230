"""All pairs of records whose value sets overlap above a Jaccard threshold.

Plan: equal sets become one class; minwise signatures of the classes are cut
into bands; band rows are shuffled once by bucket and streamed bucket by bucket
through array code, which pairs the classes of a bucket off, thinned by set size
and a 64-bit minwise sketch; candidates are deduplicated and verified exactly in
integers; class pairs are expanded to record pairs at the very end.

A bucket of very many classes is not paired off at once: its classes are banded
again within the bucket by further minwise hashes (of fewer rows, so that a pair
is lost as seldom as before), level by level.  What still shares one bucket after
LEVELS levels agrees in so many hashes that nearly every pair of it is a result;
it is paired off in blocks.

Defined cases: null ids, null sets and empty sets have no partner; repeated
rows of an id count once; other columns are ignored; an empty input gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint, cleaned, hot_split_join, in_parts, of_part, remove

#: 40 bands of 4 miss a pair at the threshold of 0.7 with probability (1 - 0.7**4)**40 < 2e-5.
BANDS, ROWS = 40, 4
#: Pairs whose 64 sketch bits agree in fewer places are left out; at a Jaccard of 0.7 this loses less than 1e-5.
SKETCH_AGREE = 38
#: Classes in one bucket above which it is banded again; 18 bands of 2 miss a pair at 0.7 with (1 - 0.7**2)**18 < 6e-6.
HOT_BUCKET, SUB_BANDS, SUB_ROWS, LEVELS = 1024, 18, 2, 3
#: Pairs looked at in one step.
STEP = 2_000_000
#: Band rows shuffled at a time, and sets whose values are; what is more goes in passes, so that the disk holds one pass.
PASS_ROWS, PART_ROWS, MAX_PARTS = 8_000_000, 250_000, 64
PAIRS = "a bigint, b bigint, bucket bigint"


def _seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64), rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(values: np.ndarray, starts: np.ndarray, n: int, seed: int = 7, first: int = 0) -> Iterator[np.ndarray]:
    """The n minwise hashes from ``first`` on, one array over all sets after another. ``starts``: where each (non-empty) set begins."""
    xor, mul = _seeds(n, seed)
    for k in range(first, n):
        h = (values ^ xor[k]) * mul[k]
        h ^= h >> np.uint64(29)
        yield np.minimum.reduceat(h, starts)


def flat_sets(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts of an array<bigint> column without nulls and empty arrays."""
    col = batch.column(column)
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    return values, (offsets[:-1] - offsets[0]).astype(np.int64)


def _bands(batch: pa.RecordBatch, bands: int, rows: int, seed: int, outer: np.ndarray | None, span: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket of each band of ``span``, within the bucket ``outer`` if given, and the sketch of every set (if the span begins at the first band)."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    values, starts = flat_sets(batch, "hashes")
    sketch = np.zeros(len(starts), np.uint64)
    keys, key = [], None
    low_, high = span[0] * rows, span[1] * rows
    # the seeds depend on how many are drawn
    for k, low in enumerate(minwise(values, starts, bands * rows if outer is not None else max(64, bands * rows), seed, low_), low_):
        if k >= high and (low_ or k >= 64):
            break
        if k < 64:
            sketch |= ((low >> np.uint64(7)) & np.uint64(1)) << np.uint64(k)
        if k < high:
            if k % rows == 0:
                key = np.full(len(starts), k // rows + 1, np.uint64) + (outer if outer is not None else np.uint64(0))
            key = (key ^ low) * mix
            key ^= key >> np.uint64(31)
            if k % rows == rows - 1:
                keys.append(key)
    return keys, sketch


def band_batches(bands: int, rows: int, seed: int = 7, span: tuple[int, int] | None = None):
    """mapInArrow over (cid, size, hashes[, bucket][, sketch]): (bucket, cid, size, sketch) of every band of ``span``, of all without one."""
    span = span or (0, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                if not batch.num_rows:
                    continue
                has = batch.schema.names
                keys, sketch = _bands(batch, bands, rows, seed, batch.column("bucket").to_numpy().view(np.uint64) if "bucket" in has else None, span)
                sketch = batch.column("sketch").to_numpy() if "sketch" in has else sketch.view(np.int64)
                n = len(keys)
                cols = (np.concatenate(keys).view(np.int64), np.tile(batch.column("cid").to_numpy(), n), np.tile(batch.column("size").to_numpy(), n), np.tile(sketch, n))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "cid", "size", "sketch"])

    return run


def sketch_batches(bands: int, rows: int, seed: int = 7):
    """mapInArrow over (cid, size, hashes): the same with the sketch of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketch = _bands(batch, bands, rows, seed, None, (0, 1))[1]
                yield pa.RecordBatch.from_arrays([*batch.select(["cid", "size", "hashes"]).columns, pa.array(sketch.view(np.int64))], names=["cid", "size", "hashes", "sketch"])

    return run


def bucket_pairs(num: int, den: int, differ: int, hot: int | None, sided: bool = False):
    """mapInArrow over rows (bucket, cid, size, sketch[, side]) sorted by bucket: candidate pairs (a, b, null), a < b.

    Pairs whose sizes exclude num/den, whose sketches differ in more than
    ``differ`` bits or, if ``sided``, that do not stand on two sides (bits 1 and
    2) are left out.  The classes of a bucket of more than ``hot`` come out as
    (cid, null, bucket) instead.  At most one bucket is held in memory, of a hot
    one at most ``hot`` rows.
    """
    names = ["bucket", "cid", "size", "sketch", *(["side"] if sided else [])]

    def good(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cid, size, sketch = x[1], x[2].astype(np.int64), x[3]
        keep = (cid[i] != cid[j]) & (size[i] * den >= size[j] * num) & (size[j] * den >= size[i] * num)
        if sided:
            keep &= ((x[4][i] & 1) & (x[4][j] >> 1) | (x[4][j] & 1) & (x[4][i] >> 1)) > 0
        i, j = i[keep], j[keep]
        near = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)) <= differ  # of a negative number it would count those of the absolute value
        i, j = cid[i[near]], cid[j[near]]
        return np.minimum(i, j), np.maximum(i, j)

    def batch(a: np.ndarray, b: np.ndarray | None, bucket: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if bucket is None else pa.array(bucket)], names=["a", "b", "bucket"])

    def paired(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs within the complete buckets ``x``."""
        key = x[0]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        for m in np.unique(n[n > 1]).tolist():
            at = first[n == m]
            if hot is not None and m > hot:
                rows = (at[:, None] + np.arange(m)).ravel()
                yield batch(x[1][rows], None, key[rows])
            elif m <= 1000:
                i, j = np.triu_indices(m, 1)
                step = max(1, STEP // len(i))
                for k in range(0, len(at), step):
                    some = at[k : k + step, None]
                    yield batch(*good(x, (some + i).ravel(), (some + j).ravel()), None)
            else:
                for start in at.tolist():
                    for k in range(0, m, 1000):
                        left = np.arange(start + k, start + min(m, k + 1000))
                        for r in range(k, m, 1000):
                            right = np.arange(start + r, start + min(m, r + 1000))
                            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                            yield batch(*good(x, i[i < j], j[i < j]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, giant = None, None
        for b in batches:
            x = [b.column(c).to_numpy() for c in names]
            if giant is not None and len(x[0]):  # the rest of a bucket that was found to be hot
                n = int(np.searchsorted(x[0] != giant, True)) if (x[0] != giant).any() else len(x[0])
                if n:
                    yield batch(x[1][:n], None, x[0][:n])
                x = [c[n:] for c in x]
                giant = giant if not len(x[0]) else None
            held = x if held is None else [np.concatenate((h, c)) for h, c in zip(held, x)]
            if not len(held[0]):
                continue
            open_ = int(np.argmax(held[0] == held[0][-1]))  # where the last bucket, which may go on, begins
            if open_:
                yield from paired([c[:open_] for c in held])
                held = [c[open_:] for c in held]
            if hot is not None and len(held[0]) > hot:
                giant = held[0][0]
                yield batch(held[1], None, held[0])
                held = None
        if held is not None and len(held[0]):
            yield from paired(held)

    return run


def candidates(rows: DataFrame, num: int, den: int, differ: int, hot: int | None, sided: bool = False) -> DataFrame:
    """The pairs (a, b) and, for buckets of more than ``hot`` rows, their members (a, null, bucket) of ``rows``, shuffled once by bucket."""
    placed = rows.repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(bucket_pairs(num, den, differ, hot, sided), PAIRS)


def banded_pairs(classes: DataFrame, first: DataFrame, num: int, den: int, differ: int, hot: int, sub: tuple[int, int], sided: bool = False) -> DataFrame:
    """(a, b), distinct: classes that share a bucket of ``first`` (bucket, cid, size, sketch[, side]); hot buckets are banded again.

    ``classes`` has (cid, size, hashes); ``sub`` are the bands and rows of further levels.
    """
    cols = ["cid", "size", "sketch", *(["side"] if sided else [])]
    found = checkpoint(candidates(first, num, den, differ, hot, sided))
    levels = [found.where("b is not null").select("a", "b")]
    about = None
    for level in range(1, LEVELS + 1):
        crowd = found.where("b is null").select(F.col("a").alias("cid"), "bucket")
        if crowd.isEmpty():
            break
        about = about if about is not None else checkpoint(first.join(crowd.select("cid").distinct(), "cid", "left_semi").select(*cols).distinct())
        again = crowd.join(about, "cid").join(classes.select("cid", "hashes"), "cid")
        banded = again.select("cid", "size", "hashes", "bucket", "sketch").mapInArrow(band_batches(*sub, seed=100 + level), "bucket bigint, cid bigint, size int, sketch bigint")
        banded = banded.join(about.select("cid", "side"), "cid") if sided else banded
        found = checkpoint(candidates(banded.select("bucket", *cols), num, den, differ, hot if level < LEVELS else None, sided))
        levels.append(found.where("b is not null").select("a", "b"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.distinct()


def parts_for(rows: int) -> int:
    return min(MAX_PARTS, 1 + rows // PART_ROWS)


def keyed_sets(records: DataFrame, *cols: str) -> DataFrame:
    """(id, cols, set_key, values) of the records with a non-empty set, kept, since classes and members both read it."""
    return _keyed_sets(records, *cols)[0]


def _keyed_sets(records: DataFrame, *cols: str) -> tuple[DataFrame, str]:
    """The table and its folder."""
    parts = parts_for(records.select("id").count())
    some = records.where(F.col("id").isNotNull() & (F.size("values") > 0))
    return in_parts(records.sparkSession, parts, lambda i: some.where(of_part("id", i, parts)).select("id", *cols, set_key("values").alias("set_key"), "values"))


def set_classes(keyed: DataFrame) -> DataFrame:
    """(cid, set_key, values, size, hashes, n): one row per distinct set of ``keyed`` (set_key, values)."""
    parts = parts_for(keyed.count())

    def part(i: int) -> DataFrame:
        return (
            keyed.where(of_part("set_key", i, parts))
            .groupBy("set_key")
            .agg(F.first("values").alias("values"), F.count(F.lit(1)).alias("n"))
            .select("set_key", "values", F.size("values").alias("size"), F.transform("values", lambda v: F.xxhash64(v)).alias("hashes"), "n")
            .withColumn("cid", F.monotonically_increasing_id() * parts + i)
        )

    return in_parts(keyed.sparkSession, parts, part)[0]


def class_members(keyed: DataFrame, classes: DataFrame, *cols: str) -> DataFrame:
    """(cid, id, cols) of every record; classes with very many copies are not shuffled."""
    with cleaned(keyed.sparkSession):
        return checkpoint(hot_split_join(keyed.select("id", *cols, "set_key"), classes.select("set_key", "cid", "n"), "set_key", "n").select("cid", "id", *cols))


def set_key(values: str):
    """128-bit identity of a sorted value set."""
    return F.unhex(F.md5(F.concat_ws("\u0001", values)))


def _over(inter, size_a, size_b, num: int, den: int):
    """|A∩B| · den ≥ num · |A∪B| in integers."""
    return inter * den >= (size_a + size_b - inter) * num


def verified(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those ``pairs`` (a, b) of classes whose sets overlap by num/den or more; of many classes part by part."""
    spark, parts = classes.sparkSession, parts_for(classes.count())
    left = classes.select(F.col("cid").alias("a"), F.col("values").alias("va"))
    right = classes.select(F.col("cid").alias("b"), F.col("values").alias("vb"))
    inter = F.size(F.array_intersect("va", "vb"))
    over = _over(inter, F.size("va"), F.size("vb"), num, den)
    if parts == 1:
        return pairs.join(left, "a").join(right, "b").where(over).select("a", "b")
    pairs, _ = in_parts(spark, 1, lambda i: pairs)
    half, folder = in_parts(spark, parts, lambda i: pairs.where(of_part("a", i, parts)).join(left.where(of_part("a", i, parts)), "a"))
    found, _ = in_parts(spark, parts, lambda i: half.where(of_part("b", i, parts)).join(right.where(of_part("b", i, parts)), "b").where(over).select("a", "b"))
    remove(spark, folder)
    return found


def similar_classes(classes: DataFrame, num: int = 7, den: int = 10, bands: int = BANDS, rows: int = ROWS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b), a < b: pairs of different classes with |A∩B|/|A∪B| ≥ num/den."""
    spark, base = classes.sparkSession, classes.select("cid", "size", "hashes")
    width = max(1, min(bands, PASS_ROWS // max(1, classes.count())))
    if width < bands:  # the sketch is taken once, not in every pass
        base, _ = in_parts(spark, 1, lambda i: classes.select("cid", "size", "hashes").mapInArrow(sketch_batches(bands, rows), "cid bigint, size int, hashes array<bigint>, sketch bigint"))
    pairs = None
    for lo in range(0, bands, width):
        first = base.mapInArrow(band_batches(bands, rows, span=(lo, min(bands, lo + width))), "bucket bigint, cid bigint, size int, sketch bigint")
        with cleaned(spark):
            found = banded_pairs(classes, first, num, den, 64 - SKETCH_AGREE, hot_bucket, (SUB_BANDS, SUB_ROWS))
        pairs = found if pairs is None else pairs.unionByName(found)
    return verified(pairs.distinct() if width < bands else pairs, classes, num, den)


def similar_set_pairs(records: DataFrame, num: int = 7, den: int = 10, **bands) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of distinct ids of ``records`` (id, values) whose sets overlap by num/den or more."""
    keyed, folder = _keyed_sets(records)
    classes = set_classes(keyed)
    members = class_members(keyed, classes)
    remove(records.sparkSession, folder)  # both stand without it
    links = similar_classes(classes, num, den, **bands).unionByName(classes.where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b")))
    pairs = links.join(members.select(F.col("cid").alias("a"), F.col("id").alias("ia")), "a").join(members.select(F.col("cid").alias("b"), F.col("id").alias("ib")), "b")
    same = F.col("a") == F.col("b")
    return (
        pairs.where((~same & (F.col("ia") != F.col("ib"))) | (same & (F.col("ia") < F.col("ib"))))
        .select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
        .distinct()
    )
