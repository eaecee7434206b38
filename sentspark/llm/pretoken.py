"""Splitting whole blocks of text into pre-tokens with numpy, and a cache of their tokens.

Texts are joined to one array of code points with a border after each text. Every code
point has a class (letter, number, white space, other); pre-tokens are runs of one class,
with the exceptions that the two public patterns make:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+      (white space dropped)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from sentspark.llm.rolling import Sums, mix

#: Characters handled at once.
CHARS = 1 << 20
#: Distinct pre-tokens remembered by a worker.
REMEMBERED = 1 << 19

LETTER, NUMBER, SPACE, OTHER, BORDER = range(5)
_BORDER = 0x110000
_U = np.uint64
_QUOTE = 0x27

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point as the public library sees it, and of the border."""
    if not _classes:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, _BORDER))))
        table = np.full(_BORDER + 1, OTHER, np.uint8)
        for kind, others in ((LETTER, r"[^\p{L}]+"), (NUMBER, r"[^\p{N}]+"), (SPACE, r"\S+")):
            for _, (a, b) in Split(Regex(others), "removed").pre_tokenize_str(every):
                at = np.arange(a, b)
                table[np.where(at < 0xD800, at, at + 0x800)] = kind
        table[_BORDER] = BORDER
        _classes.append(table)
    return _classes[0]


def code_points(texts: list[str]) -> np.ndarray:
    """The texts' code points, each text followed by a border."""
    flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    flat[ends] = _BORDER
    return flat


def _contractions(cp: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letters after the quotes at ``starts`` that belong to 's, 't, 're, 've, 'm, 'll, 'd; else 0."""
    after, next_ = cp[np.minimum(starts + 1, len(cp) - 1)], cp[np.minimum(starts + 2, len(cp) - 1)]
    pair = np.zeros(len(starts), bool)
    for a, b in ("re", "ve", "ll"):
        pair |= (after == ord(a)) & (next_ == ord(b))
    single = np.isin(after, [ord(x) for x in "stmd"])
    return np.where(single, 1, np.where(pair, 2, 0))


def spans(cp: np.ndarray, with_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pre-tokens, by the first pattern or (not ``with_space``) the second."""
    kind = classes()[cp]
    n = len(cp)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    if not with_space:
        new |= kind == NUMBER
    quote = np.flatnonzero(new & (cp == _QUOTE))
    if with_space:
        quote = quote[(quote == 0) | (cp[quote - 1] != 0x20)]
    if len(quote):
        letters = _contractions(cp, kind, quote)
        quote, letters = quote[letters > 0], letters[letters > 0]
        new[quote + 1] = False
        two = quote[letters == 2] + 2
        new[two] = False
        rest = quote + 1 + letters
        new[rest[rest < n]] = True
    if with_space:
        # a space joins what follows; the white space before it stays together, and the
        # last white space before a text stands alone if it is another character
        follows = np.zeros(n, bool)
        follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BORDER)
        last = np.flatnonzero(follows)
        new[last] = True
        joins = last[cp[last] == 0x20]
        new[joins + 1] = False
    start = np.flatnonzero(new)
    end = np.r_[start[1:], n]
    keep = kind[start] != BORDER
    if not with_space:
        keep &= kind[start] != SPACE
    return start[keep], end[keep]


def blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHARS`` characters."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        total += n + 1
        if total >= CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


class Cache:
    """Values of pre-tokens by their hash, computed once for each distinct one in a worker.

    A value is a list of integers; they are kept side by side in one growing array.
    """

    def __init__(self, compute: Callable[[str], list[int]]):
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def numbers(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of every span of ``cp``; all of them stay valid until the next call."""
        if not len(start):
            return np.zeros(0, np.int64)
        keys = Sums(mix(cp.astype(np.uint64) + _U(1))).spans(start, end)
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        ok = place < len(self.keys)
        known[ok] = self.keys[place[ok]] == distinct[ok]
        entry = np.empty(len(distinct), np.int64)
        entry[known] = self.where[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            values = [
                self.compute(cp[a:b].astype("<u4").tobytes().decode("utf-32-le"))
                for a, b in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)
            ]
            entry[fresh] = len(self.first) - 1 + np.arange(len(fresh))
            sizes = np.array([len(v) for v in values])
            self.first = np.r_[self.first, self.first[-1] + np.cumsum(sizes)]
            self.flat = np.r_[self.flat, np.array([x for v in values for x in v], np.uint32)]
            self.keys = np.insert(self.keys, place[fresh], distinct[fresh])
            self.where = np.insert(self.where, place[fresh], entry[fresh])
        return entry[inverse]

    def values(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of entries one after the other, and where each begins (and the end)."""
        size = self.first[entry + 1] - self.first[entry]
        begins = np.r_[0, np.cumsum(size)]
        at = np.arange(begins[-1]) + np.repeat(self.first[entry] - begins[:-1], size)
        return self.flat[at], begins


#: Where a text can be cut without changing its pre-tokens.
_CUT = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


def _pieces(text: str, special: regex.Pattern | None) -> Iterator[tuple[str, str | None]]:
    """Parts of a text, with the special token that follows each one (or None)."""
    parts = special.split(text) if special is not None else [text]
    for k in range(0, len(parts), 2):
        part, at = parts[k], 0
        while len(part) - at > 2 * CHARS and (found := _CUT.search(part, at + CHARS)):
            yield part[at : found.start()], None
            at = found.start()
        yield part[at:] if at else part, parts[k + 1] if k + 1 < len(parts) else None


def encoded(
    texts: list[str],
    cache: Cache,
    with_space: bool,
    special: dict[str, int],
    normal: Callable[[str], str] | None = None,
) -> Iterator[np.ndarray]:
    """The ids of every text, in order."""
    marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    pieces, after, owner = [], [], []
    for k, text in enumerate(texts):
        if marks is not None and any(x in text for x in special) or len(text) > CHARS:
            for part, mark in _pieces(text, marks):
                pieces.append(normal(part) if normal else part)
                after.append(mark)
                owner.append(k)
        else:
            pieces.append(normal(text) if normal else text)
            after.append(None)
            owner.append(k)
    now, parts = 0, []
    for a, b in blocks([len(p) for p in pieces]):
        cp = code_points(pieces[a:b])
        start, end = spans(cp, with_space)
        flat, begins = cache.values(cache.numbers(cp, start, end))
        borders = np.r_[0, np.cumsum([len(p) + 1 for p in pieces[a:b]])]
        cuts = begins[np.searchsorted(start, borders)].tolist()
        for k in range(a, b):
            if owner[k] != now:
                yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                now, parts = owner[k], []
            parts.append(flat[cuts[k - a] : cuts[k - a + 1]])
            if after[k] is not None:
                parts.append(np.array([special[after[k]]], np.uint32))
    if parts:
        yield parts[0] if len(parts) == 1 else np.concatenate(parts)
