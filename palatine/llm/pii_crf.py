"""Personal information in free text, by a skip-chain conditional random field.

Texts are cut into words, numbers and single marks (``token_arrays``), labelled
O, B-kind or I-kind.  Every token of a text is scored.  Tokens on which any
label but O could win, and their surroundings, form linear chains; a token is
left O unasked only if the potentials say so themselves: where even the sum of
each feature's best case for another label stays FAR below O.  Equal and similar
words in different places of a text are tied by skip edges, words of a likely
mention wherever they recur, and loopy message passing, until the messages
settle, lets the mentions of a text agree.  Texts without edges are solved
exactly in one forward-backward pass.

What the corpus says, the name words beside those of the lexicon and the contexts
of names, is counted over all documents in executors.  Only the field's weights
are fitted on the driver, on a bounded sample: at most TRAIN_DOCS documents of at
most TRAIN_CHARS characters, those with the smallest hash.  The labels are
distant: value shapes, shapes after a label word, person spans that the name
lexicon supports, and spans in the contexts which such spans have; a second copy
of each text hides the shapes, so that values of other forms are known by what
stands around them.  Unary, transition and skip potentials are all fitted by the
gradient of the conditional likelihood (observed less expected counts, expected
ones from node, chain-pair and edge beliefs of the same message passing).

All steps work on arrays over the tokens of many texts at once.

Defined cases: null and empty texts have no mentions; a (doc_id, text) given
several times counts once; an empty table or lexicon gives an empty or weaker
result, no error; positions count code points.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint, spread
from palatine.llm.token_arrays import DIGIT, FORMS, ID_WORDS, KINDS, LETTER, MARK, PAD, SHAPES, TITLES, Shapes, Tokens, chunks, isin, mixed, raw_hashes, word_hashes

TRAIN_DOCS, TRAIN_CHARS = 3000, 20_000
#: Counts a task holds before it passes them on.
HELD = 500_000
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
K = len(LABELS)
#: A token is O unasked where the best case of every other label is less than O's by this much; tokens on either side of the others.
FAR, WINDOW = 6.0, 3
#: Messages have settled when they change by less; after so many rounds each step is shorter than the last, so that they do.
TOLERANCE, FULL_STEPS = 1e-3, 20
#: Rounds of messages per gradient, passes over the sample, parts of a pass, step size.
ROUNDS, EPOCHS, PARTS, RATE = 1, 6, 8, 1.0
#: Of the sample's texts without a label one in so many is used; length of the pieces that chains are cut into, where O meets O.
PLAIN, PIECE = 4, 32
#: Tokens that a label word looks ahead.
NEAR = 7
#: Slots of the feature table (a power of two).
SLOTS = 1 << 21
EDGE, TITLE, GIVEN, FAMILY, ONE_UPPER, ONE_LOWER, UPPER, CAPITAL, LOWER, NUMBER = 1, 6, 7, 8, 9, 10, 11, 12, 13, 14  # token classes; 2 to 5 are the value shapes

_TITLES, _ID_WORDS = word_hashes(TITLES), word_hashes(ID_WORDS)


# -- person-like spans


class View:
    """Tokens of one text from ``lo`` to ``hi`` as strings."""

    def __init__(self, t: Tokens, s: Shapes, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.tok = t.strings(np.arange(lo, hi))
        self.low = [x.lower() for x in self.tok]
        self.shaped = s.kind[lo:hi] > 0
        self.broken, self.glued = t.broken[lo : hi + 1], t.glued[lo : hi + 1]

    def titled(self, k: int) -> bool:
        return k >= 1 and (self.low[k - 1] in TITLES or (self.tok[k - 1] == "." and k >= 2 and self.low[k - 2] in TITLES))


def name_spans(v: View, i: int) -> list[tuple[int, int]]:
    """The person-like spans that begin at token i of the view: (first, end).

    Title-less: given [initial.] family[-family], initial. family[-family],
    FAMILY, given.  A single word counts only after a title.
    """
    tok, n = v.tok, len(v.tok)

    def word(k: int) -> bool:
        return k < n and len(tok[k]) > 1 and tok[k][0].isalpha() and not v.shaped[k]

    def near(k: int) -> bool:
        return k < n and not (v.broken[k] and k > i)

    def hyphen(k: int) -> int:
        """End of a word with hyphenated parts that begins at k."""
        while k + 2 < n and tok[k + 1] == "-" and v.glued[k + 1] and v.glued[k + 2] and word(k + 2):
            k += 2
        return k + 1

    def initial(k: int) -> bool:
        return k + 1 < n and len(tok[k]) == 1 and tok[k].isalpha() and not v.shaped[k] and tok[k + 1] == "." and bool(v.glued[k + 1])

    out = []
    if initial(i) and word(i + 2) and near(i + 2):
        out.append((i, hyphen(i + 2)))
    if word(i):
        end = hyphen(i)
        if v.titled(i):
            out.append((i, end))
        if initial(end) and near(end) and word(end + 2) and near(end + 2):
            out.append((i, hyphen(end + 2)))
        elif word(end) and near(end):
            out.append((i, hyphen(end)))
        elif end + 1 < n and tok[end] == "," and word(end + 1) and near(end + 1) and tok[i].isupper():
            out.append((i, hyphen(end + 1)))
    return out


# -- features


class Features:
    """Feature hashes of all tokens, one column per template; 0 stands for a feature a token does not have."""

    def __init__(self, field: Field, t: Tokens, s: Shapes):
        n, step = len(t), t.doc * PAD + PAD
        at, size = np.arange(n) + step, n + PAD * (len(t.texts) + 1)
        cls, word, tight = (np.zeros(size, np.uint64) for _ in range(3))
        cls[:] = EDGE
        cls[at], word[at] = field.classes(t, s), t.low
        tight[at] = (t.broken[:-1] * 1 + t.broken[1:] * 2 + t.glued[:-1] * 4 + t.glued[1:] * 8).astype(np.uint64)
        c = {d: cls[at + d] for d in range(-2, 3)}
        w = {d: word[at + d] for d in range(-4, 5)}
        b = tight[at]
        self.columns: list[Callable[[], np.ndarray]] = []
        shaped = np.flatnonzero(s.kind)

        def add(number: int, *parts: np.ndarray, plain: bool = False) -> None:
            """A template; ``plain`` ones speak only of tokens outside value shapes."""

            def column() -> np.ndarray:
                h = mixed(np.full(n, number, np.uint64), *parts)
                if plain:
                    h[shaped] = 0
                return h

            self.columns.append(column)

        for k, parts in enumerate(((c[0],), (c[-1], c[0]), (c[0], c[1]), (c[-1], c[0], c[1]), (c[-2], c[-1], c[0]), (c[0], c[1], c[2]), (b, c[0]), (b, c[-1], c[0], c[1]))):
            add(k + 1, *parts)
        label = np.flatnonzero(isin(t.low, _ID_WORDS))
        near = np.minimum(label[:, None] + np.arange(1, NEAR + 1), max(n - 1, 0))
        labelled = np.zeros(n, np.uint64)
        labelled[near[t.doc[near] == t.doc[label][:, None]]] = 1
        add(9, labelled, t.kind.astype(np.uint64))
        words = ((w[-1],), (w[-2],), (w[1],), (w[2],), (w[-2], w[-1]), (w[1], w[2]), (w[-1], c[0]), (c[0], w[1]), (w[-3], w[-2], c[0]), (c[0], w[2], w[3]), (c[0], w[3], w[4]), (w[-4], w[-3], c[0]))
        for k, parts in enumerate(words):
            add(k + 11, *parts, plain=True)
        own = mixed(np.full(n, 31, np.uint64), w[0])
        own[shaped] = self._shape_features(t, s, shaped, word, at)
        self.columns.append(lambda: own)

    @staticmethod
    def _shape_features(t: Tokens, s: Shapes, shaped: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Form, whether first, the word before the value, and whether a label word stands within four tokens before it."""
        head = s.head[shaped]
        label = np.zeros(len(shaped), bool)
        for d in range(1, 5):
            label |= isin(word[at[head] - d], _ID_WORDS)
        return mixed(np.full(len(shaped), 32, np.uint64), (s.form[shaped] * 4 + (shaped == head) * 2 + label).astype(np.uint64))


class Table:
    """Feature hashes to weight rows: a slot per hash, checked by a tag; row 0 is that of unknown features."""

    def __init__(self, hashes: np.ndarray):
        self.row, self.tag = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint32)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.row[slot] = np.arange(1, len(hashes) + 1)
        self.tag[slot] = (hashes >> np.uint64(32)).astype(np.uint32)
        self.size = len(hashes) + 1

    def __getstate__(self) -> tuple:
        """Only the slots in use: every broadcast of the table lies on the disks of the driver and of each executor."""
        at = np.flatnonzero(self.row | self.tag)
        return at.astype(np.int32), self.row[at], self.tag[at], self.size

    def __setstate__(self, state: tuple) -> None:
        at, row, tag, self.size = state
        self.row, self.tag = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint32)
        self.row[at], self.tag[at] = row, tag

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        return np.where(self.tag[slot] == (hashes >> np.uint64(32)).astype(np.uint32), self.row[slot], 0)


# -- chains


class Chains:
    """Chains that lie one after another in an array of ``n`` rows, prepared for steps over all of them at once."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        self.lengths, self.start, self.order = lengths[order], start, order
        most = int(lengths.max()) if len(lengths) else 0
        self.alive = np.searchsorted(-self.lengths, -np.arange(most), "left")  # chains longer than each step
        self.n = int(lengths.sum())

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        for k, m in enumerate(self.alive):
            yield k, self.start[:m] + k


def forward_backward(unary: np.ndarray, chains: Chains, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node beliefs, forward, local, backward) of chains with O on either side; all normalised per token."""
    e = np.exp(trans)
    local = np.exp(unary - unary.max(1, keepdims=True, initial=-np.inf))
    fwd, bwd = np.empty_like(local), np.empty_like(local)
    for k, at in chains.steps():
        x = (e[0] if k == 0 else fwd[at - 1] @ e) * local[at]
        fwd[at] = x / (x.sum(1, keepdims=True) + 1e-300)
    last = chains.start + chains.lengths - 1
    bwd[last] = e[:, 0]
    for k in range(len(chains.alive) - 2, -1, -1):
        at = chains.start[: chains.alive[k + 1]] + k
        x = (local[at + 1] * bwd[at + 1]) @ e.T
        bwd[at] = x / (x.sum(1, keepdims=True) + 1e-300)
    node = fwd * bwd
    node /= node.sum(1, keepdims=True) + 1e-300
    return node, fwd, local, bwd


def viterbi(unary: np.ndarray, chains: Chains, trans: np.ndarray) -> np.ndarray:
    """The best labels of the chains."""
    best, back, path = np.empty_like(unary), np.empty(unary.shape, np.int8), np.zeros(len(unary), np.int64)
    for k, at in chains.steps():
        if k == 0:
            best[at] = unary[at] + trans[0]
        else:
            x = best[at - 1][:, :, None] + trans
            back[at] = x.argmax(1)
            best[at] = x.max(1) + unary[at]
    last = chains.start + chains.lengths - 1
    path[last] = (best[last] + trans[:, 0]).argmax(1)
    for k in range(len(chains.alive) - 2, -1, -1):
        at = chains.start[: chains.alive[k + 1]] + k
        path[at] = back[at + 1, path[at + 1]]
    return path


class Messages:
    """Log messages along skip edges (i, j), both ways; a token has one edge to either side at most."""

    def __init__(self, i: np.ndarray, j: np.ndarray):
        self.i, self.j = i, j
        self.to_j, self.to_i = np.zeros((len(i), K)), np.zeros((len(i), K))

    def add_to(self, unary: np.ndarray) -> np.ndarray:
        out = unary.copy()
        out[self.j] += self.to_j
        out[self.i] += self.to_i
        return out

    def pass_on(self, node: np.ndarray, skip: np.ndarray, step: float = 1.0, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """One message over each edge of ``some`` from its ends' beliefs; the largest change of every edge."""
        e = np.exp(skip)
        change = []
        for ends, back, into, way in ((self.i, self.to_i, self.to_j, e), (self.j, self.to_j, self.to_i, e.T)):
            out = np.log(node[ends[some]] + 1e-300) - back[some]
            out = np.exp(out - out.max(1, keepdims=True, initial=-np.inf)) @ way
            out = step * (np.log(out / out.sum(1, keepdims=True) + 1e-12) - into[some])
            change.append(out)
        self.to_j[some] += change[0]
        self.to_i[some] += change[1]
        return np.maximum(np.abs(change[0]).max(1, initial=0), np.abs(change[1]).max(1, initial=0))


class Field:
    """The trained field."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.left: set[tuple[str, str]] = set()
        self.right: set[tuple[str, str]] = set()
        self.table = Table(np.zeros(0, np.uint64))
        self.weights = np.zeros((1, K), np.float32)
        self.bias = np.zeros(K)
        self.allowed = np.array([[y[0] != "I" or (x != "O" and x[2:] == y[2:]) for y in LABELS] for x in LABELS])
        self.trans = np.where(self.allowed, 0.0, -1e4)
        self.skip = np.zeros((K, K))
        self.ready()

    def ready(self) -> None:
        """To be called when words, contexts or weights have changed."""
        sets = ((word_hashes(self.family), FAMILY), (word_hashes(self.given), GIVEN), (_TITLES, TITLE))
        self._words = np.unique(np.concatenate([w for w, _ in sets]))  # known words and their classes; of several the last counts
        self._class = np.zeros(len(self._words), np.int64)
        self._role = np.zeros(len(self._words), np.int64)  # 1 given, 2 family, 3 both
        for w, code in sets:
            self._class[isin(self._words, w)] = code
            self._role[isin(self._words, w)] |= {GIVEN: 1, FAMILY: 2}.get(code, 0)
        self._left, self._right = _pair_hashes(self.left), _pair_hashes(self.right)
        self._best = (self.weights[:, 1:].max(1) - self.weights[:, 0]).astype(np.float32)
        self._bias = float(self.bias[1:].max() - self.bias[0])

    # -- features

    def classes(self, t: Tokens, s: Shapes) -> np.ndarray:
        c = np.where(t.all_upper, UPPER, np.where(t.first_upper, CAPITAL, LOWER))
        one = (t.kind == LETTER) & (t.length == 1)
        c[one] = np.where(t.first_upper[one], ONE_UPPER, ONE_LOWER)
        c = np.where(t.kind == DIGIT, NUMBER + np.minimum(t.length, 6), np.where(t.kind == MARK, 1000 + t.mark, c))
        known = self._known(t)
        c = np.where(known >= 0, self._class[known], c)
        return np.where(s.kind > 0, 1 + s.kind, c).astype(np.uint64)

    def _known(self, t: Tokens) -> np.ndarray:
        """Place of each token among the known words, -1 for others."""
        at = np.minimum(np.searchsorted(self._words, t.low), len(self._words) - 1)
        return np.where(self._words[at] == t.low, at, -1)

    def roles(self, t: Tokens) -> np.ndarray:
        """1 for a given name, 2 for a family name, 3 for both, 0 for other words."""
        known = self._known(t)
        return np.where(known >= 0, self._role[known], 0)

    def named(self, t: Tokens) -> np.ndarray:
        """Whether a token is a name word."""
        return self.roles(t) > 0

    def tied(self, t: Tokens, s: Shapes) -> np.ndarray:
        """Whether a token is a word that may be tied to others; words inside value shapes and titles are not."""
        return (t.kind == LETTER) & (t.length > 2) & (s.kind == 0) & ~isin(t.low, _TITLES)

    def edges(self, t: Tokens, at: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring occurrences of equal or similar words among the tokens ``at`` (ascending) which ``may``: places in ``at``."""
        k = np.flatnonzero(may)
        key = mixed(t.doc[at[k]].astype(np.uint64), t.base[at[k]])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        return k[order[:-1][same]], k[order[1:][same]]

    # -- decoding

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        return self.decode_all([text])[0]

    def decode_all(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of the mentions of each text, in order."""
        out: list[list[tuple[str, int, int]]] = []
        for lo, hi in chunks(texts):
            out += self._decode(texts[lo:hi])
        return out

    def _decode(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        t = Tokens(texts)
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not len(t):
            return found
        s = t.shaped()
        rows = [self.table.rows(c()) for c in Features(self, t, s).columns]
        best = np.full(len(t), self._bias, np.float32)
        for r in rows:
            best += self._best[r]
        hot, tied, named = best > -FAR, self.tied(t, s), self.named(t)
        key = mixed(t.doc.astype(np.uint64), t.base)
        again = np.zeros(len(t), bool)
        while True:
            at, chains = _windows(hot, t.doc)
            if not len(at):
                return found
            unary = np.tile(self.bias, (len(at), 1))
            for r in rows:
                unary += self.weights[r[at]]
            node = forward_backward(unary, chains, self.trans)[0]
            likely = at[(node[:, 0] < 0.5) & tied[at]]
            again |= tied & isin(key, np.unique(key[likely]))
            if not (again & ~hot).any():
                break
            hot |= again
        i, j = self.edges(t, at, tied[at] & (t.first_upper | named | again)[at])
        if len(i):
            unary = self.settle(unary, chains, Messages(i, j))
            node = forward_backward(unary, chains, self.trans)[0]
        doubt = np.add.reduceat(1 - node[:, 0], np.sort(chains.start))[chains.order]  # below a half, all O is the best path
        open_ = np.flatnonzero(doubt >= 0.5)
        if not len(open_):
            return found
        some, sub = _subset(chains, open_)
        path, at = viterbi(unary[some], sub, self.trans), at[some]
        begin = np.flatnonzero((path > 0) & (path % 2 == 1))
        for p in begin.tolist():
            q = p + 1
            while q < len(path) and path[q] == path[p] + 1 and at[q] == at[q - 1] + 1:
                q += 1
            kind = LABELS[path[p]][2:]
            a, b = self._whole(t, s, kind, int(at[p]), int(at[q - 1]) + 1)
            found[t.doc[a]].append((kind, int(t.start[a]), int(t.end[b - 1])))
        return [sorted(set(f), key=lambda x: x[1:]) for f in found]

    def settle(self, unary: np.ndarray, chains: Chains, m: Messages) -> np.ndarray:
        """Pass messages until they settle; ``unary`` with them added."""
        chain = np.zeros(len(unary), np.int64)
        chain[chains.start] = 1
        chain = np.cumsum(chain) - 1  # number of a token's chain, by place
        rank = np.argsort(chains.order)
        active = np.ones(len(m.i), bool)
        step, rounds = 1.0, 0
        while active.any():
            edges = np.flatnonzero(active)
            touched = np.unique(chain[np.concatenate((m.i[edges], m.j[edges]))])
            some, sub = _subset(chains, rank[touched])
            where = np.full(len(unary), -1)
            where[some] = np.arange(len(some))
            node = forward_backward(m.add_to(unary)[some], sub, self.trans)[0]
            full = np.ones((len(unary), K)) if len(some) < len(unary) else np.empty((len(unary), K))
            full[some] = node
            moved = m.pass_on(full, self.skip, step, edges) >= TOLERANCE
            # an edge is asked again if the beliefs at either end may have moved: its chains got a new message
            stirred = np.zeros(len(chains.start) + 1, bool)
            stirred[chain[m.i[edges[moved]]]] = stirred[chain[m.j[edges[moved]]]] = True
            active = stirred[chain[m.i]] | stirred[chain[m.j]]
            rounds += 1
            if rounds > FULL_STEPS:
                step *= 0.9
        return m.add_to(unary)

    def _whole(self, t: Tokens, s: Shapes, kind: str, i: int, j: int) -> tuple[int, int]:
        """The run itself if it has the form of a whole value, else the whole value of that kind it lies in."""
        lo, hi = t.bounds[t.doc[i]], t.bounds[t.doc[i] + 1]
        if kind == "person":
            v = View(t, s, max(lo, i - 4), min(hi, j + 8))
            known = [(a + v.lo, b + v.lo) for k in range(max(0, i - v.lo - 1), i - v.lo + 1) for a, b in name_spans(v, k)]
            more = lambda k: not t.word[k] or isin(t.low[k : k + 1], self._words)[0]
            if longer := [x for x in known if x[0] == i and x[1] >= j and all(map(more, range(j, x[1])))]:  # further name words belong to it
                return max(longer)
        else:
            known = [(a, b) for a, b, k in s.spans.get(int(t.doc[i]), ()) if k == kind]
        if (i, j) in known:
            return i, j
        wider = [x for x in known if x[0] <= i and x[1] >= j]
        if wider:
            return min(wider, key=lambda x: (x[1] - x[0], -x[0]))
        if kind in ("phone", "id_number") and not s.kind[i:j].any():  # a form that is no shape: up to its outer blanks
            inner = lambda k: t.kind[k] != MARK or t.mark[k] in b"-/."
            while i > lo and t.glued[i] and (t.kind[i - 1] != MARK or (i - 1 > lo and inner(i - 1) and t.glued[i - 1] and t.kind[i - 2] != MARK)):
                i -= 1
            while j < hi and t.glued[j] and (t.kind[j] != MARK or (j + 1 < hi and inner(j) and t.glued[j + 1] and t.kind[j + 1] != MARK)):
                j += 1
        return i, j

    # -- corpus statistics

    def neighbour_counts(self, texts: list[str]) -> Counter:
        """(what, word, neighbour): uses and capital uses of every word; given and family names of the lexicon beside it."""
        t = Tokens(texts)
        out: Counter = Counter()
        words = np.flatnonzero(t.kind == LETTER)
        for what, at in (("use", words), ("capital", words[t.first_upper[words]])):
            _, first, n = np.unique(t.low[at], return_index=True, return_counts=True)
            for w, k in zip(t.strings(at[first]), n.tolist()):
                out[what, w.lower(), ""] += k
        s = t.shaped()
        word = np.append(t.word & (s.kind == 0), np.zeros(4, bool))
        joined = np.append(~t.broken[1:-1], np.zeros(5, bool)) if len(t) else np.zeros(4, bool)
        n = len(t)
        single = np.append((t.kind == LETTER) & (t.length == 1), np.zeros(4, bool))
        stop = np.append(t.mark == ord("."), np.zeros(4, bool))
        near = np.flatnonzero(word[:n] & word[1 : n + 1] & joined[:n])
        far = np.flatnonzero(word[:n] & single[1 : n + 1] & stop[2 : n + 2] & word[3 : n + 3] & joined[:n] & joined[1 : n + 1] & joined[2 : n + 2])
        i, j = np.concatenate((near, far)), np.concatenate((near + 1, far + 3))
        roles = self.roles(t)
        given, family = roles & 1 > 0, roles & 2 > 0
        for what, a, b in (("before family", i[family[j]], j[family[j]]), ("before given", i[given[j]], j[given[j]]), ("after given", j[given[i]], i[given[i]])):
            out.update((what, x.lower(), y.lower()) for x, y in zip(t.strings(a), t.strings(b)))
        return out

    def widen_lexicon(self, counts: DataFrame, least: int = 2) -> None:
        """Add the words that stand like given or family names beside words the lexicon has.

        A given name stands before family names (an initial may come between)
        but, unlike a cue word, not before given names; names are often capital.
        ``counts`` (what, a, b, n) are the neighbour counts of all documents.
        """

        def of(what: str, value) -> Column:
            return F.coalesce(F.sum(F.when(F.col("what") == what, value)), F.lit(0))

        one = F.lit(1)
        words = counts.groupBy("a").agg(
            of("use", F.col("n")).alias("uses"), of("capital", F.col("n")).alias("capital"), of("before family", one).alias("families"), of("before family", F.col("n")).alias("hits"), of("before given", F.col("n")).alias("not_given"), of("after given", one).alias("givens")
        )
        found = [r for r in words.where(f"10 * capital >= 3 * uses and (families >= {least} or givens >= {least})").collect() if r.a not in TITLES]
        new_given = {r.a for r in found if r.families >= least and r.a not in self.family and 10 * r.not_given <= r.hits}
        new_family = {r.a for r in found if r.givens >= least and r.a not in self.given | new_given}
        self.given, self.family = self.given | new_given, self.family | new_family
        self.ready()

    def _supported(self, v: View, i: int, j: int) -> bool:
        """Whether the lexicon supports a person-like span."""
        words = [v.low[k] for k in range(i, j) if len(v.tok[k]) > 1 and v.tok[k][0].isalpha()]
        known = sum(w in self.given or w in self.family for w in words)
        form_ok = v.tok[i].isupper() == v.tok[j - 1].isupper() or "," in v.tok[i:j] or len(v.tok[i]) == 1
        return (known == len(words) >= 2 and form_ok) or (known > 0 and (len(v.tok[i]) == 1 or v.titled(i)))

    def strong_spans(self, t: Tokens, s: Shapes) -> Iterator[tuple[int, View, list[tuple[int, int]]]]:
        """(doc, view, spans) of the person-like spans that the lexicon supports."""
        named = np.flatnonzero(self.named(t))
        for d in np.unique(t.doc[named]).tolist():
            v = View(t, s, t.bounds[d], t.bounds[d + 1])
            starts = {k for i in named[t.doc[named] == d].tolist() for k in range(max(0, i - v.lo - 8), i - v.lo + 1)}
            yield d, v, [x for k in sorted(starts) for x in name_spans(v, k) if self._supported(v, *x)]

    def span_contexts(self, texts: list[str]) -> Counter:
        """(side, token, token): the contexts of the supported person spans."""
        t = Tokens(texts)
        out: Counter = Counter()
        for _, v, spans in self.strong_spans(t, t.shaped()):
            for i, j in spans:
                l, r = context(v, i, j)
                out["left", *l] += 1
                out["right", *r] += 1
        return out

    def learn_contexts(self, counts: DataFrame, count: Callable[[Callable[[list[str]], Counter]], DataFrame], least: int = 3) -> None:
        """Contexts that spans often have and that seldom stand elsewhere; ``counts`` as of span_contexts, ``count`` counts over all documents."""
        seen = {(r.what, r.a, r.b): r.n for r in counts.where(F.col("n") >= least).collect()}
        pairs = sorted({(a, b) for _, a, b in seen})
        known = _pair_hashes(pairs, keep_order=True)
        order = np.argsort(known)

        def uses(texts: list[str]) -> Counter:
            t = Tokens(texts)
            code = mixed(t.raw[:-1], t.raw[1:])[t.doc[:-1] == t.doc[1:]] if len(t) > 1 else np.zeros(0, np.uint64)
            code, n = np.unique(code[isin(code, known[order])], return_counts=True)
            return Counter({("use", *pairs[order[p]]): k for p, k in zip(np.searchsorted(known[order], code).tolist(), n.tolist())})

        total = {(r.a, r.b): r.n for r in count(uses).collect()} if pairs else {}
        often = {k for k, n in seen.items() if 10 * n >= 3 * total.get(k[1:], 0)}
        self.left = {(a, b) for side, a, b in often if side == "left" and b != "^"}
        self.right = {(a, b) for side, a, b in often if side == "right" and a != "$"}
        self.ready()

    def learn_corpus(self, texts: DataFrame) -> None:
        """Widen the lexicon and learn the contexts of names from all of ``texts`` (text), repeated texts included."""

        def count(of: Callable[[list[str]], Counter]) -> DataFrame:
            return counted(texts, of)

        self.widen_lexicon(checkpoint(count(self.neighbour_counts)))
        self.learn_contexts(count(self.span_contexts), count)

    # -- training

    def person_labels(self, t: Tokens, s: Shapes) -> dict[int, list[tuple[int, int]]]:
        """Person spans by doc: those supported by the lexicon, then those in the contexts of such spans."""
        good: dict[int, list[tuple[int, int, int, int]]] = {}
        strong = {d: (v, set(spans)) for d, v, spans in self.strong_spans(t, s)}
        pair = mixed(t.raw[:-1], t.raw[1:]) if len(t) > 1 else np.zeros(0, np.uint64)
        after, before = np.flatnonzero(isin(pair, self._left)) + 2, np.flatnonzero(isin(pair, self._right))
        starts: dict[int, set[int]] = {}
        for k in after[after < len(t)].tolist():
            starts.setdefault(int(t.doc[k]), set()).update(range(k, k + 4))  # titles may stand between
        for k in before.tolist():
            starts.setdefault(int(t.doc[k]), set()).update(range(k - 8, k))
        for d in sorted(strong.keys() | starts.keys()):
            v, sure = strong.get(d) or (View(t, s, t.bounds[d], t.bounds[d + 1]), set())
            spans = set(sure)
            for k in starts.get(d, ()):
                if v.lo <= k < v.hi:
                    spans.update(name_spans(v, k - v.lo))
            for i, j in sorted(spans):
                l, r = context(v, i, j)
                edge_l = l in self.left or l[1] in {".", "^", ";", "?", "!"} or bool(v.broken[i])
                edge_r = r in self.right or r[0] in {"$", ".", ",", ";"} or bool(v.broken[j])
                if (i, j) in sure or (l in self.left and edge_r) or (r in self.right and edge_l):
                    good.setdefault(d, []).append(((l in self.left) + (r in self.right), j - i, i + v.lo, j + v.lo))
        out = {}
        for d, spans in good.items():
            taken: list[tuple[int, int]] = []
            for _, _, i, j in sorted(spans, reverse=True):
                if not any(x < j and i < y for x, y in taken):
                    taken.append((i, j))
            out[d] = taken
        return out

    def labels(self, t: Tokens, s: Shapes) -> np.ndarray:
        """Distant labels of all tokens."""
        y = np.zeros(len(t), np.int64)

        def put(i: int, j: int, kind: str) -> None:
            y[i] = LABELS.index(f"B-{kind}")
            y[i + 1 : j] = LABELS.index(f"I-{kind}")

        for spans in self.person_labels(t, s).values():
            for i, j in spans:
                put(i, j, "person")
        label = isin(t.low, _ID_WORDS)
        for d, found in s.spans.items():
            for i, j, kind in found:
                if kind != "id_number" or label[max(t.bounds[d], i - 4) : i].any():
                    put(i, j, kind)
        return y

    def train(self, texts: list[str], epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Fit all potentials to the distant labels of ``texts``: those with labels, and one in PLAIN of the others."""
        rng = np.random.default_rng(3)
        labelled = []
        for lo, hi in chunks(texts):
            t = Tokens(texts[lo:hi])
            y = self.labels(t, t.shaped())
            labelled += [(texts[lo + d], y[t.bounds[d] : t.bounds[d + 1]]) for d in range(hi - lo)]
        used = [x for k, x in enumerate(labelled) if k % PLAIN == 0 or x[1].any()]
        parts = [_Part(self, [used[i] for i in p]) for p in np.array_split(rng.permutation(len(used)), PARTS) if len(p)]
        hashes, counts = np.unique(np.concatenate([p.hashes.ravel() for p in parts] or [np.zeros(0, np.uint64)]), return_counts=True)
        told = np.unique(np.concatenate([p.hashes[p.y > 0].ravel() for p in parts] or [np.zeros(0, np.uint64)]))
        self.table = Table(hashes[(hashes != 0) & ((counts > 1) | isin(hashes, told))])
        self.weights = np.zeros((self.table.size, K), np.float32)
        for form, number in FORMS.items():  # a shape speaks for its kind before anything is learned
            kind = next(k for k, f, _ in SHAPES if f == form)
            for first in (0, 1):
                for label in (0, 1):
                    h = mixed(np.full(1, 32, np.uint64), np.array([number * 4 + first * 2 + label], np.uint64))
                    if r := self.table.rows(h)[0]:
                        self.weights[r, LABELS.index(f"{'B' if first else 'I'}-{kind}")] = 3.0 if kind != "id_number" else 1.0
        squares = np.zeros((self.table.size, 1), np.float32)
        state = {"bias": np.zeros(K), "trans": np.zeros((K, K)), "skip": np.zeros((K, K))}
        for p in parts:
            p.prepare(self.table)
        for _ in range(epochs):
            for k in rng.permutation(len(parts)):
                g = parts[k].gradient(self)
                rows, sums = g.pop("rows"), g.pop("sums")
                squares[rows] += (sums**2).max(1, keepdims=True)
                self.weights[rows] += rate * sums / np.sqrt(squares[rows] + 1.0)
                self.weights[0] = 0
                for name, d in g.items():
                    state[name] += d**2
                    move = rate * d / np.sqrt(state[name] + 1.0)
                    setattr(self, name, getattr(self, name) + (np.where(self.allowed, move, 0) if name == "trans" else move))
        self.ready()


class _Part:
    """Some texts of the sample with their labels: once as they are, once more, where they hold shapes, with the shapes hidden."""

    def __init__(self, field: Field, labelled: list[tuple[str, np.ndarray]]):
        texts = [x for x, _ in labelled]
        t = Tokens(texts)
        s, y = t.shaped(), np.concatenate([y for _, y in labelled])
        copies = [(t, s, y)]
        hidden = [d for d, spans in s.spans.items() if any(k != "email" for _, _, k in spans)]
        if hidden:
            u = Tokens([texts[d] for d in hidden])
            copies.append((u, u.shaped(hide=True), np.concatenate([y[t.bounds[d] : t.bounds[d + 1]] for d in hidden])))
        self.y = np.concatenate([c[2] for c in copies])
        self.hashes = np.concatenate([np.stack([c() for c in Features(field, t, s).columns], 1) for t, s, _ in copies])
        self.chains = Chains(np.concatenate([_pieces(t, y) for t, _, y in copies]))
        edges, base = [], 0
        for t, s, y in copies:
            tied = field.tied(t, s)
            key = mixed(t.doc.astype(np.uint64), t.base)
            again = tied & isin(key, np.unique(key[(y > 0) & tied]))
            edges.append(np.array(field.edges(t, np.arange(len(t)), tied & (t.first_upper | field.named(t) | again))) + base)
            base += len(t)
        self.i, self.j = np.concatenate(edges, 1)

    def prepare(self, table: Table) -> None:
        """The tokens of every feature, in the order of the features."""
        rows = table.rows(self.hashes).astype(np.int32)
        del self.hashes
        self.rows = rows
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 1) :]
        self.token = (order // rows.shape[1]).astype(np.int32)
        self.feature, self.first = np.unique(flat[order], return_index=True)

    def gradient(self, f: Field) -> dict[str, np.ndarray]:
        """Observed less expected counts of features, transitions and skip pairs."""
        unary = np.tile(f.bias, (len(self.y), 1))
        for c in range(self.rows.shape[1]):
            unary += f.weights[self.rows[:, c]]
        m = Messages(self.i, self.j)
        for _ in range(ROUNDS if len(self.i) else 0):
            m.pass_on(forward_backward(m.add_to(unary), self.chains, f.trans)[0], f.skip)
        node, fwd, local, bwd = forward_backward(m.add_to(unary), self.chains, f.trans)
        n, y = len(self.y), self.y
        diff = -node
        diff[np.arange(n), y] += 1
        out = {"bias": diff.sum(0)}
        flat = diff.astype(np.float32)
        out["sums"] = np.add.reduceat(flat[self.token], self.first, axis=0) if len(self.first) else np.zeros((0, K), np.float32)
        out["rows"] = self.feature
        inner = np.ones(n, bool)
        inner[self.chains.start] = False
        at = np.flatnonzero(inner)
        e = np.exp(f.trans)
        seen, expected = np.zeros((K, K)), np.zeros((K, K))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        a, b = fwd[at - 1], local[at] * bwd[at]
        expected += (a / ((a * (b @ e.T)).sum(1, keepdims=True) + 1e-300)).T @ b * e
        last = self.chains.start + self.chains.lengths - 1
        for ends, side in ((self.chains.start, 0), (last, 1)):  # O stands on either side of a chain
            np.add.at(seen[0] if side == 0 else seen[:, 0], y[ends], 1)
            sums = node[ends].sum(0)
            if side == 0:
                expected[0] += sums
            else:
                expected[:, 0] += sums
        out["trans"] = np.where(f.allowed, seen - expected, 0)
        if len(self.i):
            pairs = np.zeros((K, K))
            np.add.at(pairs, (y[self.i], y[self.j]), 1)
            x = np.exp(np.log(node[self.i] + 1e-300) - m.to_i)
            z = np.exp(np.log(node[self.j] + 1e-300) - m.to_j)
            es = np.exp(f.skip)
            joint = (x / ((x * (z @ es.T)).sum(1, keepdims=True) + 1e-300)).T @ z * es
            out["skip"] = pairs + pairs.T - joint - joint.T
        return out


def _pieces(t: Tokens, y: np.ndarray) -> np.ndarray:
    """Lengths of the pieces that the texts are cut into: by PIECE tokens, and further on while a mention goes on."""
    step = np.arange(len(y)) - t.bounds[t.doc]
    cut = (step % PIECE == 0) & ((step == 0) | ((y == 0) & (np.append(0, y[:-1]) == 0)))
    return np.diff(np.append(np.flatnonzero(cut), len(y)))


def context(v: View, i: int, j: int) -> tuple[tuple[str, str], tuple[str, str]]:
    """The two tokens before i and from j on; titles before i do not count."""
    a = i
    while a >= 1 and v.titled(a):
        a -= 1
    left = ("", "^") if a == 0 else (v.tok[a - 2] if a >= 2 else "", v.tok[a - 1])
    right = ("$", "") if j >= len(v.tok) else (v.tok[j], v.tok[j + 1] if j + 1 < len(v.tok) else "$")
    return left, right


def _pair_hashes(pairs, keep_order: bool = False) -> np.ndarray:
    pairs = list(pairs)
    h = mixed(raw_hashes([a for a, _ in pairs]), raw_hashes([b for _, b in pairs])) if pairs else np.zeros(0, np.uint64)
    return h if keep_order else np.unique(h)


def _windows(hot: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, Chains]:
    """The tokens within WINDOW of a hot one of their text, and the chains they form."""
    n = len(hot)
    at = np.flatnonzero(hot)
    near = np.unique((at[:, None] + np.arange(-WINDOW, WINDOW + 1)).ravel())
    near = near[(near >= 0) & (near < n)]
    left = np.searchsorted(at, near, "right") - 1
    prev, after = at[np.maximum(left, 0)], at[np.minimum(left + 1, len(at) - 1)] if len(at) else at
    keep = ((np.abs(near - prev) <= WINDOW) & (doc[prev] == doc[near])) | ((np.abs(after - near) <= WINDOW) & (doc[after] == doc[near]))
    near = near[keep]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(near) > 1) | (np.diff(doc[near]) > 0)))) if len(near) else np.zeros(0, int)
    return near, Chains(np.diff(np.append(cut, len(near))))


def _subset(chains: Chains, ranks: np.ndarray) -> tuple[np.ndarray, Chains]:
    """The rows of the chains of the given ranks, one after another in order, and these as chains of their own."""
    ranks = ranks[np.argsort(chains.start[ranks], kind="stable")]
    lengths = chains.lengths[ranks]
    rows = np.repeat(chains.start[ranks] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return rows, Chains(lengths)


def counted(texts: DataFrame, of: Callable[[list[str]], Counter], held: int = HELD) -> DataFrame:
    """(what, a, b, n): the counts ``of`` lists of texts, added up over ``texts`` (text); tasks pass on sums, not texts."""
    shared = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(of))
    names = ["what", "a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, sums = pickle.loads(shared.value), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if sums:
                cols = list(zip(*((*k, n) for k, n in sums.items())))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=names)
                sums.clear()

        for b in batches:
            some = b.column(0).to_pylist()
            for lo, hi in chunks(some):
                sums.update(f(some[lo:hi]))
                if len(sums) > held:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "what string, a string, b string, n bigint").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def train_field(docs: DataFrame, lexicon: DataFrame, sample: int = TRAIN_DOCS) -> Field:
    """A field that knows the name words and contexts of all ``docs``; its weights are fitted on the ``sample`` documents of the smallest hashes; ``lexicon`` (token, role)."""
    words = [(r[0].lower(), (r[1] or "").lower()) for r in lexicon.select("token", "role").where("token is not null").distinct().collect()]
    field = Field({w for w, r in words if r == "given"}, {w for w, r in words if r != "given"})
    once = docs.select("doc_id", "text").where("doc_id is not null").where(F.length("text") > 0).distinct()  # a document given twice counts once
    once = checkpoint(once.select(F.xxhash64("doc_id", "text").alias("h"), "text"))
    field.learn_corpus(spread(once.select("text")))
    field.train([r[0] for r in once.where(F.length("text") <= TRAIN_CHARS).orderBy("h", "text").limit(sample).select("text").collect()])
    return field


def _decoded(docs: DataFrame, field: Field, schema: str, put: Callable[[list, list[str | None], list], list[pa.Array]]) -> DataFrame:
    """``put`` of the ids, texts and mentions of every batch, as rows of ``schema``."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(field))
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(shared.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(put(ids, texts, f.decode_all([t or "" for t in texts])), names=names)

    return spread(docs).mapInArrow(run, schema)


def mentions(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of every mention."""

    def put(ids: list, texts: list, found: list) -> list[pa.Array]:
        rows = [(d, *m) for d, some in zip(ids, found) for m in some]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))]

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").where(F.length("text") > 0)
    return _decoded(texts, field, "doc_id bigint, kind string, start_pos bigint, end_pos bigint", put).distinct()


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, text): each mention replaced by ``[KIND]``, the rest as it is; null stays null."""

    def put(ids: list, texts: list, found: list) -> list[pa.Array]:
        out = []
        for t, some in zip(texts, found):
            for kind, s, e in reversed(some):
                t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
            out.append(t)
        return [pa.array(ids, pa.int64()), pa.array(out, pa.string())]

    return _decoded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), field, "doc_id bigint, text string", put)
