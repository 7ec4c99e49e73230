"""Evaluation texts leaking into training text, by a generalised suffix automaton.

The words of the test items are put into one generalised suffix automaton;
training texts are streamed through it word by word, which gives the longest
run of item words that ends at each position in amortised constant time.  Where
the run reaches the length limit, the items that hold its last words are
reported; the matched spans can be removed.

The automaton is broadcast, so its size is bounded: test items are taken in
blocks of at most MAX_BLOCK_WORDS words, each block its own automaton.  With more
than one block the texts are read once against a bitmap of all runs of items
(a hash per run, so it has no false negatives); only the few that hold a bit of
it are kept for the automata.  Words are maximal runs of letters and digits in
lower case.

Defined cases: null and empty texts and items hold nothing; items shorter than
the limit cannot leak; repeated rows give one row; ties do not arise.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint, spread

MIN_WORDS = 12
#: A state takes about 300 bytes and there are at most two per word.
MAX_BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\W_]+")
#: Bits of the bitmap of all runs.
RUN_BITS = 1 << 30


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers with the items of every state."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[set[int]] = [set()]
        for item, tokens in items:
            last = 0
            for w in tokens:
                last = self._extend(last, self.number.setdefault(w, len(self.number)), ends)
                ends[last].add(item)
        # items of longer runs flow to the shorter ones they end with
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] >= 0:
                ends[self.link[s]] |= ends[s] if self.length[self.link[s]] >= min_words else set()
        self.items = [sorted(e) for e in ends]
    def _add(self, length: int, ends: list[set[int]], nxt: dict[int, int] | None = None, link: int = 0) -> int:
        self.next.append(nxt if nxt is not None else {})
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int, ends: list[set[int]]) -> int:
        clone = self._add(self.length[p] + 1, ends, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, c, ends)
        cur, p = self._add(self.length[last] + 1, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return cur

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) at every position where the current match has min_words words or more."""
        nxt, link, length, number, least = self.next, self.link, self.length, self.number, self.min_words
        s = n = 0
        for i, w in enumerate(tokens):
            c = number.get(w)
            if c is None:
                s = n = 0
                continue
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n >= least:
                yield i + 1, n, s

    def leaked(self, tokens: list[str]) -> dict[int, int]:
        """Item to its longest run of consecutive words in the text, as far as known from min_words on."""
        found: dict[int, int] = {}
        longest: dict[int, int] = {}  # state to the longest match reported of it
        for _, n, s in self.matches(tokens):
            while self.length[s] >= self.min_words and longest.get(s, 0) < min(n, self.length[s]):
                longest[s] = min(n, self.length[s])
                for item in self.items[s]:
                    found[item] = max(found.get(item, 0), longest[s])
                s = self.link[s]  # shorter suffixes may stand in more items
        return found

    def hit(self, tokens: list[str]) -> np.ndarray:
        """Whether each word lies in a run of min_words words or more."""
        hit = np.zeros(len(tokens), bool)
        for end, n, _ in self.matches(tokens):
            hit[end - n : end] = True
        return hit


def _automata(items: DataFrame, min_words: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton after the other; a block's items pass through the driver, no more than one block at a time."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for item, text in items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        tokens = words(text)
        if len(tokens) < min_words:
            continue
        if block and size + len(tokens) > block_words:
            yield SuffixAutomaton(block, min_words)
            block, size = [], 0
        block.append((item, tokens))
        size += len(tokens)
    if block:
        yield SuffixAutomaton(block, min_words)


def run_hashes(tokens: list[str], min_words: int) -> np.ndarray:
    """A hash of every run of min_words words, below RUN_BITS."""
    if len(tokens) < min_words:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in tokens], np.uint64)
    out, n = np.zeros(len(tokens) - min_words + 1, np.uint64), len(tokens) - min_words + 1
    for k in range(min_words):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out & np.uint64(RUN_BITS - 1)).astype(np.int64)


def may_leak(texts: DataFrame, items: DataFrame, min_words: int) -> DataFrame:
    """The rows of ``texts`` (…, text) that hold a run whose bit an item has set: a superset of those that leak."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [run_hashes(words(t.as_py()), min_words) + 1 for t in b.column(0)]  # bit 0 of bucket 1 stands for a 1
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*found, np.zeros(0, np.int64)])))], names=["run"])

    at = items.select("text").where("text is not null").mapInArrow(runs, "run bigint")
    maps = at.groupBy(F.bitmap_bucket_number("run").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("run")).alias("bits"))
    bits = np.zeros(RUN_BITS // 8, np.uint8)  # 128 MB, whatever the items
    for k, b in maps.toLocalIterator():
        bits[(k - 1) * len(b) : k * len(b)] = np.frombuffer(bytes(b), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = shared.value

        def hit(t: str | None) -> bool:
            r = run_hashes(words(t or ""), min_words)
            return bool((set_[r >> 3] >> (r & 7) & 1).any())

        for b in batches:
            yield b.filter(pa.array([hit(t.as_py()) for t in b.column(b.schema.get_field_index("text"))], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def _blocks(items: DataFrame, block_words: int) -> bool:
    """Whether the items need more than one block."""
    n = items.where("text is not null").agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))).first()[0]
    return (n or 0) > block_words


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, run): texts that hold min_words or more consecutive words of an item, with the longest run."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, run int")
    texts = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    if _blocks(items, block_words):
        texts = checkpoint(may_leak(texts, items, min_words))
    for automaton in _automata(items, min_words, block_words):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(automaton))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = pickle.loads(shared.value)
            for b in batches:
                rows = [(d, i, n) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for i, n in a.leaked(words(t.as_py())).items()]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "run"])

        out = out.unionByName(texts.mapInArrow(run, "doc_id bigint, item_id bigint, run int"))
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def cut_words(text: str, gone: list[bool]) -> str:
    """``text`` without the words that are ``gone`` and without what stands between two of them."""
    keep, at, spans = [], 0, [(m.start(), m.end()) for m in WORD.finditer(text)]
    for i, (start, end) in enumerate(spans):
        if gone[i]:
            if not (i and gone[i - 1]):
                keep.append(text[at:start])
            at = end
    return "".join(keep) + text[at:]


def remove_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = 0.5, block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, removed_words, dropped): matched spans cut out; texts whose matched share exceeds ``max_coverage`` are emptied and flagged.

    The spans of all blocks are found in the text as it is and cut at once, so
    that blocks do not change the result.  Words are those of the text as it
    stands, each in lower case.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("gone", F.array().cast("array<boolean>")))
    for automaton in _automata(items, min_words, block_words):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(automaton))

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = pickle.loads(shared.value)
            for b in batches:
                out = []
                for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                    hit = a.hit([w.lower() for w in WORD.findall(t or "")])
                    out.append((hit | np.array(gone, bool) if gone else hit).tolist() if hit.any() else gone)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(out, pa.list_(pa.bool_()))], names=["doc_id", "text", "gone"])

        rows = rows.mapInArrow(mark, "doc_id bigint, text string, gone array<boolean>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, drop = [], [], []
            for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                removed.append(sum(gone))
                drop.append(sum(gone) > max_coverage * len(gone))
                texts.append(t if not gone else "" if drop[-1] else cut_words(t, gone))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(drop, pa.bool_())], names=["doc_id", "text", "removed_words", "dropped"])

    return rows.mapInArrow(cut, "doc_id bigint, text string, removed_words int, dropped boolean")
