"""Pre-tokens of many texts at once, and a memory of what each distinct one encodes to.

The pre-token pattern is applied to arrays of character classes: a pre-token starts
where the class changes; the last character of a run of white space that a word
follows stands alone, or leads the word if it is a blank; a run at the end of a text
is whole; an apostrophe that starts a pre-token takes the letters of a contraction.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

# Fixed value: the pre-token pattern of this vocabulary, which cut() applies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The characters that are white space in it.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters of the contractions, after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Blocks of 256 characters that may hold letters and numbers.
ASSIGNED = (*range(0, 0x33000, 256), *range(0xE0000, 0xE1000, 256))
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters that one round of array operations takes (plus one text without a place to cut).
ROUND = 1 << 20
#: Distinct pre-tokens and their ids that a memory holds at most before it starts anew.
ENTRIES, IDS = 1 << 19, 1 << 22
_MIDDLE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_BASE = 0x9E3779B97F4A7C15


def _classes() -> np.ndarray:
    """The class of each character as the tokenizers library sees it (its Unicode version
    is not Python's).  It cuts a text of all characters in a row where the class changes;
    a letter is one pre-token with an "a" before it, a number with a "1"."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)
    for at in ASSIGNED:
        some = "".join([chr(c) for c in range(at, at + 256)])
        for _, (a, b) in split(some) if not 0xD800 <= at < 0xF900 else ():
            last = some[b - 1]
            table[at + a : at + b] = LETTER if len(split("a" + last)) == 1 else NUMBER if len(split("1" + last)) == 1 else OTHER
    table[SPACES] = SPACE
    return table


_tables: list[np.ndarray] = []


def tables(n: int) -> list[np.ndarray]:
    """Character classes, and powers of the hash base up to n and their inverses."""
    if not _tables:
        _tables[:] = [_classes(), np.ones(1, np.uint64), np.ones(1, np.uint64)]
    if len(_tables[1]) < n:
        for i, base in ((1, _BASE), (2, pow(_BASE, -1, 1 << 64))):
            x = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            x[0] = 1
            _tables[i] = np.cumprod(x)
    return _tables


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, the starts of all pre-tokens (and the end), a hash of each, and
    the number of the first pre-token of each text (and the end)."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    kinds, power, inverse = tables(n + 1)
    kind = kinds[codes]
    space = kind == SPACE
    ends = np.cumsum([0, *map(len, texts)])
    first = np.zeros(n + 1, bool)  # the first character of a text, or the end
    first[ends] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[ends] = True
    led = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n else np.empty(0, np.int64)
    start[led] = True
    start[led[codes[led] == 32] + 1] = False
    for a in np.flatnonzero((codes == 39) & start[:n]).tolist():
        for letters in CONTRACTIONS:
            b = a + 1 + len(letters)
            if b <= n and joined.startswith(letters, a + 1) and not first[a + 1 : b].any():
                start[a + 1], start[b] = False, True
                break
    at = np.flatnonzero(start)
    value = (codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=total[1:])
    h = (total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return joined, at, h ^ (h >> np.uint64(29)), np.searchsorted(at, ends)


def taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + sizes[0]], and so on, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class Memory:
    """Ids of texts by their distinct pre-tokens.

    learn(pieces, letters) gives the joined ids of new pre-tokens and the number of each;
    letters says which are a run of letters, perhaps after a blank."""

    def __init__(self, learn: Callable[[list[str], list[bool]], tuple[np.ndarray, np.ndarray]], kind: str):
        self.learn, self.kind = learn, kind
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def _round(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, at, h, firsts = cut(texts)
        distinct, example, which = np.unique(h, return_index=True, return_inverse=True)
        found = list(map(self.known.get, distinct.tolist()))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            if len(self.known) + len(new) > ENTRIES or len(self.flat) > IDS:
                self.forget()
                found, new = [None] * len(distinct), list(range(len(distinct)))
            where = example[new]
            a, b = at[where], at[where + 1]
            pieces = [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            kinds = tables(1)[0]
            letters = [kinds[ord(p[-1])] == LETTER and p[0] != "'" for p in pieces]
            ids, sizes = self.learn(pieces, letters)
            base = len(self.sizes)
            for k, i in enumerate(new):
                found[i] = base + k
            self.known.update(zip(distinct[new].tolist(), range(base, base + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, ids))
        row = np.array(found, np.int64)[which]
        sizes = self.sizes[row]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return taken(self.flat, self.starts[row], sizes), ends[firsts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the texts hold no special tokens."""
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            some, size = [], 0
            while k + len(some) < len(texts) and (not some or size + len(texts[k + len(some)]) <= ROUND):
                some.append(texts[k + len(some)])
                size += len(some[-1])
            if len(some) == 1 and size > ROUND:
                out.append(np.concatenate([self._round([part])[0] for part in parts_of(some[0])]))
            else:
                ids, ends = self._round(some)
                out += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            k += len(some)
        return out


def parts_of(text: str) -> list[str]:
    """A long text in parts, cut before single blanks between words."""
    parts, at = [], 0
    while at < len(text):
        m = _MIDDLE.search(text, at + ROUND)
        end = m.start() if m else len(text)
        parts.append(text[at:end])
        at = end
    return parts
