"""Encoding of a corpus with a public byte-level BPE, folded by higher-order functions.

Texts are cut into words by the tokenizer's own pattern.  A word's bytes become
an array of one-byte pieces and a fold joins the neighbouring pair of the lowest
rank until none is left.  The ranks are one literal of the plan: an array of
small maps, addressed by a hash of the piece, since a lookup in a map literal is
a linear search.  Pieces are hex texts.

Texts are never shuffled.  The words of the corpus are counted (partial counts
before the shuffle); the WORDS most frequent ones, which hold nearly all places
of any corpus, are folded once and sent to every task, where array code puts
their ids in the place of the words.  Every other word is folded where it stands.
The bound on what is sent changes only where a word is folded, never its ids.

Words longer than LONG_BYTES bytes take the same merges with a heap in Python,
because the fold copies its array at every merge.

Defined cases: null and empty texts give an empty list; special tokens' strings
are ordinary text; a (doc_id, text) given several times gives one row.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint, small_is, spread

#: The tokenizer's word pattern. Java's \s covers ASCII only, hence the explicit class of Unicode white space.
SPACE = r"\t-\r\x20\x{85}\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LONG_BYTES, SLOTS = 256, 4096
#: Words of at most so many bytes that are sent to every task with their ids: about 10 MB, at most 80.
WORDS, WORD_BYTES = 200_000, 64


def word_pattern() -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def tokenizer_dir() -> str:
    return os.environ.get("PALATINE_TOKENIZERS", "/opt/tokenizers")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the piece, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


class RankLiteral:
    """The ranks as a foldable column: array<map<hex piece, rank>>, slot by hash of the piece."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        # the slots are computed by Spark itself so that both sides hash alike; the rank file has a fixed size
        rows = spark.createDataFrame(pd.DataFrame({"p": [k.hex() for k in ranks], "r": list(ranks.values())})).select(_slot(F.col("p"), SLOTS), "p", "r").collect()
        slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
        for s, p, r in rows:
            slots[s][p] = r
        self.column = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def _hexed(word: Column) -> Column:
    return F.lower(F.hex(F.encode(word, "UTF-8")))


def encode_word(hexed: Column, literal: RankLiteral) -> Column:
    """array<int> of a word given as lower-case hex bytes.

    The literal is bound to one lambda variable, so that the plan holds it
    once.  The fold's state is (pieces, ranks of neighbouring pairs); one step
    joins the leftmost pair of the lowest rank and looks up the two pairs it
    changes.
    """
    return F.transform(F.array(literal.column), lambda slots: _fold(hexed, slots))[0]


def _fold(hexed: Column, slots: Column) -> Column:
    none = F.lit(2**31 - 1)
    empty = F.array().cast("array<int>")
    n = (F.length(hexed) / 2).cast("int")

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(slots, _slot(piece, SLOTS) + 1), piece)

    def pair(a: Column, b: Column) -> Column:
        return F.coalesce(rank(F.concat(a, b)), none)

    def pair_ranks(p: Column) -> Column:
        return F.when(F.size(p) < 2, empty).otherwise(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: pair(x, F.element_at(p, (i + 2).cast("int")))))

    def step(s: Column, _: Column) -> Column:
        p, r = s["p"], s["r"]
        low = F.array_min(r)
        at = F.array_position(r, low).cast("int")
        piece = F.concat(F.element_at(p, at), F.element_at(p, at + 1))
        pieces = F.concat(F.slice(p, F.lit(1), at - 1), F.array(piece), F.slice(p, at + 2, F.size(p)))
        before = F.when(at > 1, F.array(pair(F.element_at(p, F.greatest(at - 1, F.lit(1))), piece))).otherwise(empty)
        after = F.when(at + 1 < F.size(p), F.array(pair(piece, F.element_at(p, F.least(at + 2, F.size(p)))))).otherwise(empty)
        ranks = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(r, at + 2, F.size(p)))
        return F.when(F.coalesce(low, none) == none, s).otherwise(F.struct(pieces.alias("p"), ranks.alias("r")))

    start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(hexed, i * 2 + 1, F.lit(2)))
    first = F.transform(F.array(start), lambda p: F.struct(p.alias("p"), pair_ranks(p).alias("r")))[0]
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), first, step)
    return F.transform(done["p"], rank)


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in O(n log n), for very long words."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                p = parts[k] + parts[after[k]]
                if p in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
    return [ranks[p] for p in parts if p is not None]


def frequent_words(cut: DataFrame, literal: RankLiteral, most: int) -> pa.Table:
    """(word, ids) of the ``most`` frequent words of ``cut`` (words)."""
    counts = cut.select(F.explode("words").alias("word")).where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = checkpoint(counts.orderBy(F.desc("n"), "word").limit(most))
    # few bytes but much work: a given number of partitions is not merged into one by adaptive execution
    placed = top.select("word").repartition(2 * cut.sparkSession.sparkContext.defaultParallelism, "word")
    return placed.select("word", encode_word(_hexed(F.col("word")), literal).alias("ids")).toArrow()


def coded_batches(known: Broadcast, ranks: Broadcast):
    """mapInArrow over (doc_id, words): (doc_id, ids, words, parts).

    Where all words are known ``ids`` holds the document's ids; else it is null,
    ``words`` are the words and ``parts`` their ids, null for unknown ones.
    """

    def flat(parts: pa.ListArray, offsets: np.ndarray) -> pa.ListArray:
        """The lists of each stretch of ``parts`` as one."""
        ends = parts.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array((ends[offsets] - ends[0]).astype(np.int32)), parts.flatten())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(known.value).read_all()
        vocabulary, coded = (pa.concat_arrays([*table.column(c).chunks, pa.array([], t)]) for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
        long = None
        for b in batches:
            words = b.column(1)
            offsets = words.offsets.to_numpy()
            offsets, tokens = offsets - offsets[0], words.flatten()
            parts = coded.take(pc.index_in(tokens, value_set=vocabulary)) if len(coded) else pa.nulls(len(tokens), pa.list_(pa.int32()))
            lost = np.flatnonzero(parts.is_null().to_numpy(zero_copy_only=False))
            if len(lost):
                size = pc.binary_length(tokens.take(pa.array(lost))).to_numpy()
                if (size > LONG_BYTES).any():
                    long = long or ranks.value
                    parts = parts.to_pylist()
                    for k in lost[size > LONG_BYTES].tolist():
                        parts[k] = merge_heap(tokens[k].as_py().encode(), long)
                    parts = pa.array(parts, pa.list_(pa.int32()))
                    lost = lost[size <= LONG_BYTES]
            open_ = np.zeros(len(words), bool)
            open_[np.searchsorted(offsets, lost, "right") - 1] = True
            mask = pa.array(open_)
            ids = flat(parts, offsets)
            each = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), parts)
            none = lambda x: pc.if_else(mask, x, pa.scalar(None, x.type))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(pc.invert(mask), ids, pa.scalar(None, ids.type)), none(words), none(each)], names=["doc_id", "ids", "words", "parts"])

    return run


def once(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without repeated rows; only rows whose doc_id recurs are shuffled, if these are few."""
    again = checkpoint(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if not small_is(again):
        return docs.distinct()
    if again.isEmpty():
        return docs.where("doc_id is not null").unionByName(docs.where("doc_id is null").distinct())
    return docs.join(F.broadcast(again), "doc_id", "left_anti").where("doc_id is not null").unionByName(docs.join(F.broadcast(again), docs["doc_id"].eqNullSafe(again["doc_id"]), "left_semi").unionByName(docs.where("doc_id is null")).distinct())


def encode_corpus(docs: DataFrame, ranks: dict[bytes, int], words: int = WORDS) -> DataFrame:
    """(doc_id, ids array<int>) of ``docs`` (doc_id, text), without special tokens."""
    spark = docs.sparkSession
    docs = spread(docs.select("doc_id", "text"))
    literal = RankLiteral(spark, ranks)
    cut = F.coalesce(F.regexp_extract_all("text", F.lit(word_pattern()), F.lit(0)), F.array().cast("array<string>")).alias("words")
    table = frequent_words(docs.select(cut), literal, words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    run = coded_batches(spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), spark.sparkContext.broadcast(ranks))
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = once(docs).select("doc_id", cut).mapInArrow(run, f"doc_id {kind}, ids array<int>, words array<string>, parts array<array<int>>")
    rest = F.transform(F.array(literal.column), lambda slots: F.flatten(F.zip_with("words", "parts", lambda w, p: F.coalesce(p, _fold(_hexed(w), slots)))))[0]
    return coded.select("doc_id", F.when(F.col("ids").isNotNull(), F.col("ids")).otherwise(rest).alias("ids"))


def decode_corpus(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, text): the binary pieces of the ids, concatenated and read as UTF-8."""
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    hexed = F.array_join(F.transform("ids", lambda i: F.element_at(literal, i + 1)), "")
    return coded.select("doc_id", F.decode(F.unhex(hexed), "UTF-8").alias("text"))
