"""Ratcliff/Obershelp likeness, equal to ``difflib.SequenceMatcher(None, a, b).ratio()``.

The second text is prepared once. From 200 characters on, its popular characters (more than one in
a hundred) begin no match, as in the measure's definition; the few places of the others are then
looked up alone. Below, matches are looked up by three and by two characters, so that single ones
are compared only where nothing longer is left.

Matches follow each other in both texts, so none have more characters than the longest common
subsequence. ``Bounds`` has its length for a text with many others at once, ``Ranked`` the best
likeness by them, for texts of any length.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Characters of the texts whose bounds are held together.
PIECE = 2**17


class Prepared:
    """A second text with the places of its characters, pairs and triples."""

    __slots__ = ("text", "places", "grams")

    def __init__(self, text: str):
        self.text = text
        n = len(text)
        self.places: dict[str, list[int]] | None = None
        self.grams: tuple[dict[str, list[int]], ...] = ()
        if n >= 200:
            where: dict[str, list[int]] = {}
            for j, c in enumerate(text):
                where.setdefault(c, []).append(j)
            most = n // 100 + 1
            self.places = {c: js for c, js in where.items() if len(js) <= most}
        else:
            grams = []
            for g in (3, 2):
                where = {}
                for j in range(n - g + 1):
                    where.setdefault(text[j : j + g], []).append(j)
                grams.append(where)
            self.grams = tuple(grams)


def _longest(rows, size: int, low: int, high: int) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest run of rows (i, places in b), the first of equals."""
    best = bi = bj = 0
    last, run = -2, {}
    for i, js in rows:
        if i != last + 1:
            run = {}
        last = i
        now = {}
        for j in js:
            if j < low:
                continue
            if j >= high:
                break
            k = now[j] = run.get(j - 1, 0) + 1
            if k > best:
                best, bi, bj = k, i - k + 1, j - k + 1
        run = now
    return (best + size - 1 if best else 0), bi, bj


def matched(a: str, prepared: Prepared) -> int:
    """Characters in matching blocks of a and the prepared text."""
    return _sparse(a, prepared) if prepared.places is not None else _dense(a, prepared)


def _sparse(a: str, prepared: Prepared) -> int:
    b, get = prepared.text, prepared.places.get
    total = 0
    stack = [(0, len(a), 0, len(b), [(i, js) for i, js in enumerate(map(get, a)) if js])]
    while stack:
        alo, ahi, blo, bhi, rows = stack.pop()
        size, i, j = _longest(rows, 1, blo, bhi) if rows else (0, alo, blo)
        if not size:
            i, j = alo, blo
        ei, ej = i + size, j + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i -= 1
            j -= 1
        while ei < ahi and ej < bhi and a[ei] == b[ej]:
            ei += 1
            ej += 1
        if ei == i:
            continue
        total += ei - i
        if alo < i and blo < j:
            stack.append((alo, i, blo, j, [r for r in rows if r[0] < i]))
        if ei < ahi and ej < bhi:
            stack.append((ei, ahi, ej, bhi, [r for r in rows if r[0] >= ei]))
    return total


def _dense(a: str, prepared: Prepared) -> int:
    b = prepared.text
    n = len(a)
    rows = []
    for g, where in zip((3, 2), prepared.grams):
        get = where.get
        found = [(i, js) for i in range(n - g + 1) if (js := get(a[i : i + g]))]
        rows.append((g, found, [r[0] for r in found]))
    total = 0
    stack = [(0, n, 0, len(b), 0)]
    while stack:
        alo, ahi, blo, bhi, level = stack.pop()
        size = 0
        while level < 2:
            g, found, starts = rows[level]
            first, end = bisect_left(starts, alo), bisect_left(starts, ahi - g + 1)
            if first < end:
                size, i, j = _longest(found[first:end], g, blo, bhi - g + 1)
                if size:
                    break
            level += 1
        if size:
            total += size
            if alo < i and blo < j:
                stack.append((alo, i, blo, j, level))
            if i + size < ahi and j + size < bhi:
                stack.append((i + size, ahi, j + size, bhi, level))
            continue
        # no two characters in a row: the first of a that comes in b, then what follows both
        for i in range(alo, ahi):
            j = b.find(a[i], blo, bhi)
            if j >= 0:
                total += 1
                blo = j + 1
                if blo >= bhi:
                    break
    return total


def likeness(a: str, prepared: Prepared) -> float:
    size = len(a) + len(prepared.text)
    return 2.0 * matched(a, prepared) / size if size else 1.0


class Bounds:
    """Of prepared texts, upper bounds of their likeness to a text.

    The texts lie one after another in the bits of long integers, a bit that is always 0 after each, where
    carries end: an addition and a subtraction for each character of the other text give its longest common
    subsequence with each of them. In a text whose popular characters begin no match, only those places
    count that a match can hold: a character that isn't popular, the first of both texts, and what can go on
    from these, to the right or left, by pairs and triples that the other text has.
    """

    def __init__(self, texts: list[Prepared]):
        self.sizes = np.array([len(t.text) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])).astype(np.int64)
        whole = "".join(t.text + "\0" for t in texts)
        self.bytes = len(whole) // 8 + 1
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.ones(len(whole), bool)
        inside[self.starts + self.sizes] = False
        self.full = self._bits(inside)
        self.masks = {chr(c): self._bits((codes == c) & inside) for c in np.unique(codes)}
        sparse, rare, first = (np.zeros(len(whole), bool) for _ in range(3))
        for t, at, n in zip(texts, self.starts, self.sizes):
            if t.places is not None:
                sparse[at : at + n], first[at] = True, True
                rare[[at + j for js in t.places.values() for j in js]] = True
        self.free, self.rare, self.first = self._bits(inside & ~sparse), self._bits(rare), self._bits(first)
        self.popular = self._bits(sparse & ~rare)
        # the number of the pair and of the triple that ends at a place, 0 where none does
        self.numbers: list[dict[str, int]] = [{}, {}]
        self.ends = [np.zeros(len(whole), np.int64) for _ in range(2)]
        for g, number, ends in zip((2, 3), self.numbers, self.ends):
            for t, at in zip(texts, self.starts.tolist()):
                if t.places is not None:
                    for j in range(len(t.text) - g + 1):
                        ends[at + j + g - 1] = number.setdefault(t.text[j : j + g], len(number) + 1)

    @staticmethod
    def _bits(flags: np.ndarray) -> int:
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def _places(self, a: str) -> int:
        """The places that a match with the text can hold."""
        if not self.popular or not a:
            return self.full
        ends = []
        for g, number, at in zip((2, 3), self.numbers, self.ends):
            here = np.zeros(len(number) + 1, bool)
            here[[k for x in {a[i : i + g] for i in range(len(a) - g + 1)} if (k := number.get(x))]] = True
            ends.append(self._bits(here[at]))
        two, three = ends
        begun = self.rare | self.first & self.masks.get(a[0], 0)
        out, right, left = begun, (begun << 1) & two & self.popular, (begun >> 1) & (two >> 1) & self.popular
        while right or left:
            out |= right | left
            right, left = (right << 1) & three & self.popular, (left >> 1) & (three >> 2) & self.popular
        return out | self.free

    def of(self, a: str) -> np.ndarray:
        """An upper bound of ``likeness(a, t)`` for each text t."""
        places = self._places(a)
        masks = {c: m & places for c in set(a) if (m := self.masks.get(c))}
        full = left = self.full
        for c in a:
            if m := masks.get(c):
                u = left & m
                left = ((left + u) | (left - u)) & full
        bits = np.unpackbits(np.frombuffer(left.to_bytes(self.bytes, "little"), np.uint8), bitorder="little")
        common = self.sizes - np.add.reduceat(bits, self.starts, dtype=np.int64)
        sizes = self.sizes + len(a)
        return np.where(sizes > 0, 2.0 * common / np.maximum(sizes, 1), 1.0)


class Ranked:
    """Prepared texts by length, in pieces of bounded size: a piece none of whose lengths can be alike
    enough isn't looked at, and bounds are made of a piece when it is first asked. A text that is larger
    than a piece has only the bound by its length."""

    def __init__(self, texts: list[Prepared], piece: int = PIECE):
        self.piece, self.parts, held = piece, [], 0
        for t in sorted(texts, key=lambda t: len(t.text)):
            held += len(t.text)
            if not self.parts or held > piece:
                self.parts.append([])
                held = len(t.text)
            self.parts[-1].append(t)
        self.bounds: list[Bounds | None] = [None] * len(self.parts)

    def _most(self, k: int, n: int) -> float:
        """An upper bound of the likeness of a text of n characters to those of a piece."""
        m = min(max(n, len(self.parts[k][0].text)), len(self.parts[k][-1].text))
        return 2.0 * min(n, m) / (n + m) if n + m else 1.0

    def best(self, a: str, best: float, enough: float) -> float:
        """The best likeness of a text, or ``best`` if that is higher; rated no further from ``enough`` on."""
        by_length = [self._most(k, len(a)) for k in range(len(self.parts))]
        for k in sorted(range(len(self.parts)), key=lambda k: -by_length[k]):
            if by_length[k] <= best or best >= enough:
                break
            part = self.parts[k]
            if len(part[-1].text) > self.piece:
                best = max(best, likeness(a, part[0]))
                continue
            bounds = self.bounds[k] = self.bounds[k] or Bounds(part)
            most = bounds.of(a)
            for j in np.argsort(-most, kind="stable").tolist():
                if most[j] <= best or best >= enough:
                    break
                best = max(best, likeness(a, part[j]))
        return best
