"""External induced suffix sorting with common-prefix values, in NumPy batches.

``suffix_order`` sorts the suffixes of an integer text to a given depth and gives the length of the
common prefix of neighbours, counted up to that depth. It follows induced sorting: suffixes are of
type S (smaller than their successor) or L; the leftmost S suffixes of each run (LMS) are named by
the text up to the next one, ordered by recursion on the names where names repeat (where there
are very many different names, by doubling their prefixes), and all other suffixes are induced from them, first type L upwards, then type S downwards.

The induction takes suffix tuples (first character, place of the successor, position) out of a
priority queue. The queue holds buckets of neighbouring characters; only the current bucket is in
order and in memory, other buckets are appended to and spill to scratch files beyond a limit. Tuples
come out in batches: the longest run whose members cannot be preceded by what they induce. Each
tuple's common prefix with the one before it is one more than the least common prefix between their
successors, looked up in a table of range minima that grows with the output. Arrays made by ``Scratch`` that are
larger than its limit are files mapped to memory; the text's types, names, ranks and the inputs of the
minima are plain arrays, so a text has to fit into memory several times over.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np


class Scratch:
    """Arrays and spill files of one sort: in memory up to a limit each, else under Spark's own local folders."""

    def __init__(self, limit: int = 64 << 20):
        self.limit, self.folder, self.made = limit, None, 0

    def path(self) -> str:
        if self.folder is None:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.folder = tempfile.mkdtemp(prefix="suffix-", dir=local if local and os.path.isdir(local) else None)
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.limit:
            return np.empty(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class BucketQueue:
    """Priority queue of (char, place, position) with increasing (or decreasing) characters.

    Tuples of one character leave in the order in which they came; a bucket holds 2**shift characters.
    """

    def __init__(self, scratch: Scratch, alphabet: int, descending: bool):
        self.shift = max(0, int(alphabet).bit_length() - 8)
        self.sign = -1 if descending else 1
        self.top = (alphabet >> self.shift) + 1
        self.scratch, self.held, self.files, self.size = scratch, {}, {}, 0
        self.current = None
        self.now: list[np.ndarray] | None = None

    def push(self, char: np.ndarray, place: np.ndarray, pos: np.ndarray) -> None:
        if not len(char):
            return
        bucket = (char >> self.shift).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part in np.split(order, cuts):
            b = int(char[part[0]] >> self.shift)
            rows = np.array([char[part], place[part], pos[part]], dtype=np.int32)
            if b == self.current:
                self._insert(rows)
            else:
                self.held.setdefault(b, []).append(rows)
                self.size += rows.nbytes
        if self.size > self.scratch.limit:
            self._spill()

    def _spill(self) -> None:
        for b, parts in self.held.items():
            if b not in self.files:
                self.files[b] = self.scratch.path()
            with open(self.files[b], "ab") as f:
                f.write(np.ascontiguousarray(np.concatenate(parts, axis=1).T).tobytes())
        self.held, self.size = {}, 0

    def _insert(self, rows: np.ndarray) -> None:
        if self.now is not None and self.now.shape[1]:
            rows = np.concatenate([self.now, rows], axis=1)
        # A bucket of one character is in order as it came.
        self.now = rows[:, np.argsort(self.sign * rows[0], kind="stable")] if self.shift else rows

    def open(self, bucket: int) -> None:
        """Make a bucket the current one: read it back and put it in order."""
        parts = []
        if bucket in self.files:
            parts.append(np.fromfile(self.files[bucket], dtype=np.int32).reshape(-1, 3).T)
            os.remove(self.files.pop(bucket))
        for rows in self.held.pop(bucket, []):
            parts.append(rows)
            self.size -= rows.nbytes
        self.current, self.now = bucket, np.zeros((3, 0), dtype=np.int32)
        if parts:
            self._insert(np.concatenate(parts, axis=1))


class RangeMinima:
    """Minima over ranges of an append-only row of small numbers; level k has those of 2**k numbers up to each place."""

    def __init__(self, scratch: Scratch, n: int):
        self.levels = [scratch.array(n, np.uint8) for _ in range(max(1, int(n).bit_length()))]
        self.n = 0

    def append(self, values: np.ndarray) -> None:
        a, b = self.n, self.n + len(values)
        self.levels[0][a:b] = values
        for k in range(1, len(self.levels)):
            half = 1 << (k - 1)
            low, high = self.levels[k - 1], self.levels[k]
            s = max(a, half)
            if a < s:
                high[a : min(s, b)] = low[a : min(s, b)]
            if s < b:
                high[s:b] = np.minimum(low[s:b], low[s - half : b - half])
        self.n = b

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minima over places left + 1 .. right."""
        span = right - left
        level = np.frexp(span.astype(np.float64))[1] - 1
        out = np.empty(len(left), dtype=np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[right[at]], table[left[at] + (1 << int(k))])
        return out


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last character counts as S."""
    change = text[:-1] != text[1:]
    smaller = np.append((text[:-1] < text[1:])[change], True)
    return smaller[_before(change)]


def _before(change: np.ndarray) -> np.ndarray:
    """How many changes come before each character."""
    out = np.zeros(len(change) + 1, dtype=np.int32)
    np.cumsum(change, out=out[1:])
    return out


def _runs(text: np.ndarray, cap: int) -> np.ndarray:
    """How often the first character of each suffix repeats at its start, up to cap."""
    change = text[:-1] != text[1:]
    ends = np.append(np.flatnonzero(change), len(text) - 1).astype(np.int32)
    return np.minimum(ends[_before(change)] - np.arange(len(text), dtype=np.int32) + 1, cap).astype(np.uint8)


def _names(text: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, bool]:
    """The rank of each LMS substring among all, and whether they are all different.

    Substrings are compared several characters at a time. A substring that is a prefix of another is
    the larger one, as its last suffix is of type S; so what follows the end counts as large.
    """
    alphabet = int(text.max()) + 2
    bits = max(1, alphabet.bit_length())
    per = max(1, 62 // bits)
    length = np.append(np.diff(lms) + 1, 1)
    name = np.zeros(len(lms), dtype=np.int64)
    open_ = np.arange(len(lms))
    fill = (1 << bits) - 1
    done = 0
    while len(open_):
        key = np.zeros(len(open_), dtype=np.int64)
        for k in range(done, done + per):
            at = np.minimum(lms[open_] + k, len(text) - 1)
            key = (key << bits) | np.where(k < length[open_], text[at], fill)
        order = np.lexsort((key, name[open_]))
        rows = open_[order]
        key, old = key[order], name[rows]
        new = np.empty(len(rows), dtype=bool)
        new[0] = True
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        # Ranks inside a group of equal names start at that name, which counts all smaller substrings.
        group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        start = np.repeat(group, np.diff(np.append(group, len(rows))))
        name[rows] = old + np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) - start
        done += per
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        tied = np.repeat(size > 1, size) & (length[rows] > done)
        # All of a tied group is kept, as lengths differ only beyond what was compared.
        again = np.repeat(np.logical_or.reduceat(tied, np.flatnonzero(new)), size)
        open_ = rows[again & (np.repeat(size, size) > 1)]
    distinct = len(np.unique(name)) == len(name)
    return name, distinct


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes at a and b, which share their first ``known`` characters."""
    out = np.minimum(known, depth).astype(np.int64)
    live = np.flatnonzero(out < depth)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < len(text)) & (y < len(text))
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        out[live] += 1
        live = live[out[live] < depth]
    return out


def _induce(text, s_type, run, order, lcp, depth, scratch):
    """All suffixes in order, and common prefixes, from the ordered LMS suffixes and theirs."""
    n = len(text)
    top = int(text.max()) + 1
    phases = []
    queue = table = None
    for descending in (False, True):
        del queue, table
        queue = BucketQueue(scratch, top, descending)
        table = RangeMinima(scratch, n + len(order) + 1)
        out_pos, out_lcp, filled = scratch.array(n, np.int32), scratch.array(n, np.uint8), 0
        last_char = last_place = last_pos = -1
        # Given suffixes: LMS ones on the way up, type L ones on the way down; they follow the induced ones of their character.
        given, given_lcp = (order, lcp) if not descending else (phases[0][0][::-1], None)
        if descending:
            up = phases[0][1]
            given_lcp = np.append(np.uint8(0), up[:0:-1]) if len(up) else up
        given_char = text[given]
        g = 0
        buckets = range(queue.top) if not descending else range(queue.top - 1, -1, -1)
        sign = -1 if descending else 1
        for bucket in buckets:
            queue.open(bucket)
            stop = g + np.searchsorted(sign * (given_char[g:] >> queue.shift), sign * bucket, side="right")
            while queue.now.shape[1] or g < stop:
                induced = queue.now
                # The next batch: induced tuples of one character after another, given ones of a character after them.
                if induced.shape[1] and (g >= stop or sign * induced[0, 0] <= sign * given_char[g]):
                    m = induced.shape[1] if g >= stop else int(np.searchsorted(sign * induced[0], sign * given_char[g], side="right"))
                    char, place, pos = induced[:, :m]
                    fresh = True
                else:
                    m = stop - g if not induced.shape[1] else int(np.searchsorted(sign * given_char[g:stop], sign * induced[0, 0], side="left"))
                    char, pos, place = given_char[g : g + m], np.asarray(given[g : g + m]), None
                    fresh = False
                before = pos - 1
                able = before >= 0
                able[able] &= (s_type[before[able]] == descending)
                before_char = np.where(able, text[np.maximum(before, 0)], np.int32(sign * (2**31 - 1)))
                bar = sign * np.minimum.accumulate(sign * before_char)
                # A member may not come after something smaller that an earlier member induces; of its own character,
                # induced ones go before given ones and after induced ones that are there already.
                late = sign * char[1:] > sign * bar[:-1] if fresh else sign * char[1:] >= sign * bar[:-1]
                cut = int(np.argmax(late)) + 1 if late.any() else m
                char, pos, before, able = char[:cut], pos[:cut], before[:cut], able[:cut]
                first = table.n
                values = np.zeros(cut, dtype=np.uint8)
                same = np.append(last_char == char[0], char[1:] == char[:-1]) if cut else np.zeros(0, bool)
                if fresh:
                    place = place[:cut]
                    left = np.append(last_place, place[:-1])
                    linked = same.copy()
                    linked[0] &= last_place >= 0
                    at = np.flatnonzero(linked)
                    if len(at):
                        values[at] = np.minimum(table.between(left[at], place[at]).astype(np.int64) + 1, depth)
                else:
                    values[:] = np.where(same, given_lcp[g : g + cut], 0)
                    if same[0] and last_place >= 0:
                        # Between the types of one character only its repetitions are shared.
                        values[0] = min(run[last_pos], run[pos[0]])
                table.append(values)
                if fresh:
                    out_pos[filled : filled + cut] = pos
                    out_lcp[filled : filled + cut] = values
                    filled += cut
                    queue.now = induced[:, cut:]
                    last_place = int(place[-1])
                else:
                    g += cut
                    last_place = -1
                last_char, last_pos = int(char[-1]), int(pos[-1])
                k = np.flatnonzero(able)
                queue.push(text[before[k]], first + k, before[k])
        phases.append((out_pos[:filled], out_lcp[:filled]))
    return phases


def _by_doubling(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes by ranks of prefixes of doubled length: the end of the recursion."""
    n = len(text)
    ranks, width = [np.unique(text, return_inverse=True)[1]], 1
    while width < depth and ranks[-1].max() < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1])
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            a, b = order[1:] + shared[1:], order[:-1] + shared[1:]
            inside = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            shared[1 + same] += 1 << k
    return order, np.minimum(shared, depth)


#: Texts with more characters than this end the recursion: their batches would be short.
WIDE = 1024


def suffix_order(text: np.ndarray, depth: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes in order to ``depth`` characters, common prefixes with the one before, at most depth.

    The last character has to be the smallest and to occur once. depth is at most 254, and texts
    have less than 2**31 characters.
    """
    own = scratch is None
    scratch = scratch or Scratch()
    try:
        n = len(text)
        if n == 1:
            return np.zeros(1, np.int64), np.zeros(1, np.uint8)
        text = text.astype(np.int32)
        s_type = _types(text)
        lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
        name, distinct = _names(text, lms)
        if distinct:
            rank, shared = np.argsort(name), np.zeros(len(lms), np.int64)
        else:
            name = np.unique(name, return_inverse=True)[1]
            # A name stands for two characters at least.
            half = depth // 2 + 1
            rank, names_shared = suffix_order(name, half, scratch) if name.max() < WIDE else _by_doubling(name, half)
            shared = lms[np.minimum(rank + names_shared, len(lms) - 1)] - lms[rank]
        order = lms[rank]
        lcp = np.zeros(len(order), np.uint8)
        if len(order) > 1:
            lcp[1:] = _extend(text, order[1:], order[:-1], shared[1:], depth)
        run = _runs(text, depth)
        (l_pos, l_lcp), (s_pos, s_lcp) = _induce(text, s_type, run, order, lcp, depth, scratch)
        # The last suffix is induced by none; it is the smallest.
        s_pos, s_lcp = np.append(s_pos, n - 1)[::-1], np.append(s_lcp, 0)
        s_lcp = np.append(np.uint8(0), s_lcp[1:][::-1])
        pos = np.concatenate([l_pos, s_pos])
        common = np.concatenate([l_lcp, s_lcp])
        kind = np.concatenate([np.zeros(len(l_pos), np.int8), np.ones(len(s_pos), np.int8)])
        by = text[pos] * 2 + kind
        by = np.argsort(by.astype(np.uint16) if by.max() < 1 << 16 else by, kind="stable")
        pos, common, kind = pos[by], common[by], kind[by]
        char = text[pos]
        common[0] = 0
        common[1:][char[1:] != char[:-1]] = 0
        edge = np.flatnonzero((char[1:] == char[:-1]) & (kind[1:] != kind[:-1])) + 1
        common[edge] = np.minimum(run[pos[edge]], run[pos[edge - 1]])
        return pos, common
    finally:
        if own:
            scratch.close()
