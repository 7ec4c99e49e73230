"""Tokens of many texts as arrays, and the value shapes found among them.

A token is a run of letters, a run of digits, or a single mark.  All texts of a
batch are cut at once with array operations on their code points; a token is
known by a 64-bit hash of its letters, as written (``raw``) and in lower case
(``low``), so that no token becomes a Python string unless it is asked for.
Two words share a hash with probability 2**-64.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np

SPACE, LETTER, DIGIT, MARK = range(4)
KINDS = ("email", "phone", "id_number", "address", "person")

LETTERS = r"[^\W\d_]"
_W = rf"{LETTERS}+(?:[-’']{LETTERS}+)*"
_S = r"\s{1,3}"
_ZIP = r"\d{5}"

# Street words, label words of identity numbers and titles, in the languages of the texts.
STREET = "Street|Avenue|Lane|Road|Drive|Court|Close|Way|St\\.|Ave\\.|Ln\\.|Rd\\.|Dr\\.|Boulevard|Blvd\\.?"
ID_WORDS = {
    "passport", "identity", "id", "national", "social", "security", "ssn", "tax", "licence", "license", "driver", "insurance",
    "reisepass", "ausweis", "personalausweis", "steuernummer", "ausweisnummer", "steuer",
    "pasaporte", "documento", "nacional", "dni", "nie", "nif", "identidad",
    "passeport", "identité", "carte", "sécurité", "sociale",
}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "sr", "sra", "señor", "señora", "don", "doña", "mme", "mlle", "monsieur", "madame"}

SHAPES: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "plain", re.compile(r"(?<![\w.+-])[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)*\.[^\W\d_]{2,}(?![\w@])")),
    ("email", "spelt", re.compile(r"(?<![\w.+-])[\w.+-]*\w\s?[\[(]\s?at\s?[\])]\s?\w[\w-]*(?:(?:\s?[\[(]\s?dot\s?[\])]\s?|\.)\w[\w-]*)+(?!\w)", re.I)),
    ("address", "box", re.compile(rf"(?<!\w)(?:P\.?{_S[:2]}?O\.?{_S}|Post{_S}Office{_S})?Box{_S}\d+,{_S}(?:{_ZIP}{_S})?{_W}", re.I)),
    ("address", "flat", re.compile(rf"(?<!\w)(?:Flat|Unit|Apartment|Apt\.?|Suite){_S}\d+\w?,{_S}\d+\w?{_S}{_W}{_S}(?:{STREET}),{_S}(?:{_ZIP}{_S})?{_W}(?:{_S}{_ZIP}(?!\d))?", re.I)),
    ("address", "street", re.compile(rf"(?<![\w.,-])\d+[A-Za-z]?{_S}{_W}{_S}(?:{STREET})(?:,{_S}(?:Apt\.?|Flat|Unit|Suite){_S}\d+\w?)?,{_S}(?:{_ZIP}{_S})?{_W}(?:{_S}{_ZIP}(?!\d))?", re.I)),
    ("address", "strasse", re.compile(rf"(?<!\w)(?:{_W}(?:straße|strasse|weg|gasse|allee|ring|damm|ufer)|(?:Am|An{_S}der|Im){_S}{_W}(?:platz|markt|weg|straße)|{_W}platz){_S}\d+[a-z]?,{_S}(?:{_ZIP}{_S})?{_W}", re.I)),
    ("address", "calle", re.compile(rf"(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino){_S}(?:de{_S}(?:la{_S})?)?{_W},?{_S}\d+\w?,{_S}(?:{_ZIP}{_S})?{_W}", re.I)),
    ("address", "rue", re.compile(rf"(?<![\w.,-])\d+\w?,?{_S}(?:rue|avenue|boulevard|place|chemin|allée|quai){_S}(?:(?:de{_S}(?:la{_S})?)|du{_S}|des{_S})?{_W},{_S}(?:{_ZIP}{_S})?{_W}", re.I)),
    ("phone", "plus", re.compile(r"(?<![\w+])\+\d{1,3}(?:[\s./-]?\(?\d{2,4}\)?){2,4}(?![\d-])")),
    ("phone", "area", re.compile(r"(?<![\w.+-])(?:1[\s.-])?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]?\d{4}(?![\w-])")),
    ("phone", "zero", re.compile(r"(?<![\w.+-])0\d{3,4}(?:\s\d{3}\s?\d{3}|/\d{3}-\d{4,6})(?![\w-])")),
    ("id_number", "3-2-4", re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)")),
    ("id_number", "3 2 4", re.compile(r"(?<![\w.+-])\d{3}\s\d{2}\s\d{4}(?![\w-]|\.\d)")),
    ("id_number", "4 4 4", re.compile(r"(?<![\w.+-])\d{4}\s\d{4}\s\d{4}(?![\w-]|\.\d)")),
    ("id_number", "8-A", re.compile(r"(?<![\w.+-])\d{8}-[A-Za-z](?![\w-])")),
    ("id_number", "AA7", re.compile(r"(?<![\w.+-])[A-Za-z]{2}\s?\d{7}(?![\w-])")),
)
FORMS = {form: i + 1 for i, (_, form, _) in enumerate(SHAPES)}
#: Words without which a shape cannot be there; shapes of digits need a run of them instead.
NEEDS = {
    "box": {"box"},
    "flat": {"flat", "unit", "apt", "apartment", "suite"},
    "street": {"street", "avenue", "lane", "road", "drive", "court", "close", "way", "st", "ave", "ln", "rd", "dr", "boulevard", "blvd"},
    "calle": {"calle", "avenida", "plaza", "paseo", "camino"},
    "rue": {"rue", "avenue", "boulevard", "place", "chemin", "allée", "quai"},
    "spelt": {"at"},
}
WORD_SHAPES = [s for s in SHAPES if s[0] in ("email", "address")]
#: Digits that a shape holds at least.
DIGITS = {"plus": 99, "area": 10, "zero": 10, "3-2-4": 9, "3 2 4": 9, "4 4 4": 12, "8-A": 8, "AA7": 7}
DIGIT_SHAPES = [(*s, DIGITS[s[1]]) for s in SHAPES if s[0] in ("phone", "id_number")]
STRASSE = re.compile(r"(?:straße|strasse|weg|gasse|allee|ring|damm|ufer|platz|markt)$", re.I)
#: Empty tokens between two texts, so that no look to either side meets another text.
PAD = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


class _Chars:
    """Properties of code points, found out as they are met."""

    def __init__(self) -> None:
        n = 0x110000
        self.kind = np.full(n, 255, np.uint8)
        self.lower, self.base = np.arange(n, dtype=np.uint32), np.arange(n, dtype=np.uint32)
        self.upper = np.zeros(n, bool)

    def learn(self, codes: np.ndarray) -> None:
        for c in np.unique(codes[self.kind[codes] == 255]).tolist():
            t = chr(c)
            self.kind[c] = SPACE if t.isspace() else DIGIT if t.isdecimal() else LETTER if t.isalnum() else MARK
            low = t.lower()
            self.lower[c], self.upper[c] = ord(low[0]), t.isupper()
            plain = unicodedata.normalize("NFKD", low[0])
            self.base[c] = ord(plain[0])


_chars: list[_Chars] = []


def _known(codes: np.ndarray) -> _Chars:
    if not _chars:
        _chars.append(_Chars())
    _chars[0].learn(codes)
    return _chars[0]


def isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One hash of several hashes, in order."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * _MIX
        h ^= h >> np.uint64(29)
    return h


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted lower-case hashes of those ``words`` that are one token."""
    t = Tokens(list(words))
    return np.unique(t.low[np.isin(t.doc, np.flatnonzero(np.bincount(t.doc, minlength=1) == 1))])


def raw_hashes(tokens: list[str]) -> np.ndarray:
    """Hashes, as written, of texts that are each one token or empty (0)."""
    t = Tokens(tokens)
    out = np.zeros(len(tokens), np.uint64)
    out[t.doc[::-1]] = t.raw[::-1]
    return out


class Tokens:
    """Tokens of ``texts``: doc, start, end (offsets within the doc), low, raw, base, kind and flags."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = _known(codes)
        n = len(codes)
        kind = chars.kind[codes]
        self.codes, self.char_kind = codes, kind
        self.text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        mark = kind == MARK
        start = np.flatnonzero((kind != SPACE) & (change[:-1] | mark))
        end = np.flatnonzero((kind != SPACE) & (change[1:] | mark)) + 1
        self.at, self.to = start, end  # offsets within the joined text
        self.doc = np.searchsorted(self.text_at, start, "right") - 1
        self.start, self.end = start - self.text_at[self.doc], end - self.text_at[self.doc]
        self.kind = kind[start]
        self.length = end - start
        if len(start):
            weight, at = self._weights()
            codes_ = codes[start[0] :]
            one = lambda c: _finish(np.add.reduceat((c.astype(np.uint64) + np.uint64(1)) * weight, at))
            lower = chars.lower[codes_]
            self.low = one(lower)
            base = chars.base[lower]
            last = end - 1 - start[0]
            plural = (self.length > 4) & (base[last] == ord("s"))  # a final s does not count
            weight[last[plural]] = 0
            self.base = one(base)
            self._suffix = np.where(self.length > 1, lower[np.maximum(last - 1, 0)].astype(np.int64) << 32 | lower[last], 0)
            caps = np.add.reduceat(chars.upper[codes_].astype(np.int64), at)
            self.first_upper, self.all_upper = chars.upper[codes[start]], caps == self.length
            breaks = np.cumsum((codes == 10) | (codes == 13))
            self.broken = np.ones(len(start) + 1, bool)  # whether a line ends before the token
            self.broken[1:-1] = breaks[start[1:] - 1] > breaks[end[:-1] - 1]
        else:
            self.low = self.base = np.zeros(0, np.uint64)
            self._suffix = np.zeros(0, np.int64)
            self.first_upper = self.all_upper = np.zeros(0, bool)
            self.broken = np.ones(1, bool)
        self.glued = np.zeros(len(start) + 1, bool)  # whether the token follows the one before at once
        self.glued[1:-1] = start[1:] == end[:-1]
        self.mark = np.where(self.kind == MARK, codes[start], 0)
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.word = (self.kind == LETTER) & (self.length > 1)

    def __len__(self) -> int:
        return len(self.at)

    @cached_property
    def raw(self) -> np.ndarray:
        """Hashes of the tokens as written."""
        if not len(self):
            return np.zeros(0, np.uint64)
        weight, at = self._weights()
        return _finish(np.add.reduceat((self.codes[self.at[0] :].astype(np.uint64) + np.uint64(1)) * weight, at))

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """A factor for every character by its place in its token, 0 for blanks; where the tokens begin."""
        first = self.at[0]
        place = np.arange(len(self.codes) - first) - np.repeat(self.at - first, np.diff(np.append(self.at, len(self.codes))))
        weight = _POWERS[place & 63]
        weight[self.char_kind[first:] == SPACE] = 0
        return weight, self.at - first

    def text(self, i: int) -> str:
        return self.texts[self.doc[i]][self.start[i] : self.end[i]]

    def strings(self, at: np.ndarray) -> list[str]:
        return [self.text(i) for i in at]

    # -- value shapes

    def value_spans(self) -> Iterator[tuple[int, list[tuple[int, int, str, str]]]]:
        """(doc, [(start, end, kind, form)]) of everything that has the shape of a value; overlaps included."""
        wanted: dict[int, set[str]] = {}

        def want(form: str, tokens: np.ndarray) -> None:
            for d in np.unique(self.doc[tokens]).tolist():
                wanted.setdefault(d, set()).add(form)

        known, bits = _need_words()
        hit = np.minimum(np.searchsorted(known, self.low), len(known) - 1)
        needed = np.where(known[hit] == self.low, bits[hit], 0)
        for k, form in enumerate(NEEDS):
            if form != "spelt":
                want(form, needed & (1 << k) > 0)
        want("plain", self.mark == ord("@"))
        if len(self):
            closed = np.append((self.mark[1:] == ord("]")) | (self.mark[1:] == ord(")")), False)
            want("spelt", closed & (needed & (1 << list(NEEDS).index("spelt")) > 0))
            numbered = np.flatnonzero(np.isin(self._suffix[:-1], _STREET_ENDS) & (self.kind[1:] == DIGIT) & ~self.glued[1:-1])
            want("strasse", np.array([i for i in numbered.tolist() if STRASSE.search(self.text(i))], int))
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for d, a, b, n in self._digit_runs():
            runs.setdefault(d, []).append((a, b, n))
        for d in sorted(wanted.keys() | runs.keys()):
            text, forms = self.texts[d], wanted.get(d)
            out = [(m.start(), m.end(), kind, form) for kind, form, rx in WORD_SHAPES if form in forms for m in rx.finditer(text)] if forms else []
            for a, b, n in runs.get(d, ()):
                out += [(m.start(), m.end(), kind, form) for kind, form, rx, least in DIGIT_SHAPES if n >= least for m in rx.finditer(text, a, b)]
            if out:
                yield d, out

    def _digit_runs(self) -> Iterator[tuple[int, int, int, int]]:
        """(doc, start, end, digits) of the stretches of digits, blanks and number marks that hold seven digits, or five and a plus; with three characters on either side."""
        codes, kind = self.codes, self.char_kind
        inside = (kind == DIGIT) | (kind == SPACE) | np.isin(codes, np.array([ord(c) for c in "+-./()"], np.uint32))
        inside[self.text_at[1:] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        digits, plus = np.cumsum(np.append(0, kind == DIGIT)), np.cumsum(np.append(0, codes == ord("+")))
        n = digits[b] - digits[a]
        good = (n >= 7) | ((n >= 5) & (plus[b] > plus[a]))
        a, b, n = a[good], b[good], np.where(plus[b] > plus[a], 99, n)[good]  # after a plus any number of digits may be a phone number
        doc = np.searchsorted(self.text_at, a, "right") - 1
        for d, x, y, k in zip(doc.tolist(), (a - self.text_at[doc]).tolist(), (b - self.text_at[doc]).tolist(), n.tolist()):
            yield d, max(0, x - 3), min(len(self.texts[d]), y + 3), k

    def shaped(self, hide: bool = False) -> "Shapes":
        """The value shapes as arrays over the tokens; ``hide`` leaves all but e-mail addresses out."""
        s = Shapes(len(self))
        for d, spans in self.value_spans():
            lo, hi = self.bounds[d], self.bounds[d + 1]
            taken: list[tuple[int, int]] = []
            for a, b, kind, form in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):  # longest first
                if hide and kind != "email" or any(x < b and a < y for x, y in taken):
                    continue
                i = lo + int(np.searchsorted(self.start[lo:hi], a))
                if i >= hi or self.start[i] != a:
                    continue
                taken.append((a, b))
                j = lo + int(np.searchsorted(self.end[lo:hi], b, "right"))
                j = max(i + 1, j)
                s.kind[i:j], s.form[i:j], s.head[i:j] = KINDS.index(kind) + 1, FORMS[form], i
                s.spans.setdefault(d, []).append((i, j, kind))
        for found in s.spans.values():
            found.sort()
        return s


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@cache
def _need_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all words of NEEDS, and for each the forms that need it, as bits."""
    words = np.unique(np.concatenate([word_hashes(w) for w in NEEDS.values()]))
    bits = np.zeros(len(words), np.int64)
    for k, w in enumerate(NEEDS.values()):
        bits[isin(words, word_hashes(w))] |= 1 << k
    return words, bits


_STREET_ENDS = np.array([ord(x) << 32 | ord(y) for x, y in ("ße", "se", "eg", "ee", "ng", "mm", "er", "tz", "kt")], np.int64)


class Shapes:
    """Per token: kind (1..4, 0 for none), form and first token of the shape it lies in; spans (first, end, kind) by doc."""

    def __init__(self, n: int):
        self.kind, self.form, self.head = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.spans: dict[int, list[tuple[int, int, str]]] = {}


def value_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, form) of the value shapes of one text."""
    return [s for _, spans in Tokens([text]).value_spans() for s in spans]


def chunks(texts: list[str], most: int = 300_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each, at least one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
