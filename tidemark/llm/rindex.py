"""A run-length index: run-compressed Burrows-Wheeler transform with samples at run ends.

Matching statistics of many short patterns are streamed through it side by side, from right to left:
a pattern's next character extends its match by one step through the transform, or else the match
moves to the nearest run of that character above or below, whichever shares more with the pattern.
"""

from __future__ import annotations

import numpy as np

BITS, PER_WORD = 10, 6  # symbols below 1024, six of them in a sort key


def suffix_order(text: np.ndarray, depth: int, shared: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first `depth` symbols at least (prefix doubling; 0 lies past the end),
    and where in that order a suffix differs from the one before within the first `shared` symbols."""
    n = text.size
    padded = np.concatenate([text.astype(np.uint64), np.zeros(PER_WORD, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(PER_WORD):
        key = (key << np.uint64(BITS)) | padded[i : i + n]
    del padded
    width, known = PER_WORD, None
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        del ranked
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(new, dtype=np.uint32)
        if width <= shared:
            known = (width, rank)
        if width >= depth or new.all():
            break
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: max(0, n - width)] |= rank[width:]
        width *= 2
    if width < shared or known is None:
        return order, new
    width, rank = known
    differ = np.ones(n, bool)
    late = np.minimum(order + (shared - width), n - 1)
    differ[1:] = (rank[order[1:]] != rank[order[:-1]]) | (rank[late[1:]] != rank[late[:-1]])
    return order, differ


class RunIndex:
    def __init__(self, text: np.ndarray, depth: int, shared: int = 1, values: np.ndarray | None = None):
        """text: symbols from 1, parts separated by 0; patterns of up to `depth` symbols.

        values: one for each place; least(rows) gives the least of all places whose first `shared`
        symbols are those of a row's.
        """
        self.text = np.concatenate([text.astype(np.int32), np.zeros(depth + 1, np.int32)])
        order, differ = suffix_order(text, depth, shared)
        if values is not None:
            self.class_starts = np.flatnonzero(differ)
            self.class_least = np.minimum.reduceat(values[order], self.class_starts)
        bwt = text[order - 1].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.starts, self.heads = starts, bwt[starts]
        self.ends = np.concatenate([starts[1:], [bwt.size]]) - 1
        self.first_sample, self.last_sample = order[starts], order[self.ends]
        r, self.n = starts.size, bwt.size
        counts = np.bincount(bwt, minlength=1 << BITS)
        below = np.concatenate([[0], np.cumsum(counts)[:-1]])
        by_head = np.argsort(self.heads, kind="stable")
        sizes = (self.ends - starts + 1)[by_head]
        before = np.cumsum(sizes) - sizes
        self.step = np.empty(r, np.int64)  # where a run's first row goes
        self.step[by_head] = before  # equal heads are neighbours, so this is the count over all smaller rows
        assert below[self.heads[by_head[0]]] == 0
        self.r = r
        self.run_keys = self.heads[by_head] * r + by_head

    def least(self, rows: np.ndarray) -> np.ndarray:
        return self.class_least[np.searchsorted(self.class_starts, rows, side="right") - 1]

    def matching_statistics(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of patterns (right-aligned; symbols absent from the text match nothing): the
        length of the longest match that starts at each place, and the index row of one such match."""
        m, width = patterns.shape
        patterns = patterns.astype(np.int64)
        row, size = np.zeros(m, np.int64), np.zeros(m, np.int64)
        place = np.full(m, self.first_sample[0], np.int64)
        out, rows = np.zeros((m, width), np.int32), np.zeros((m, width), np.int64)
        for col in range(width - 1, -1, -1):
            c = patterns[:, col]
            run = np.searchsorted(self.starts, row, side="right") - 1
            off = np.flatnonzero(self.heads[run] != c)
            size += 1
            if off.size:
                co = c[off]
                j = np.searchsorted(self.run_keys, co * self.r + run[off])
                up, down = np.maximum(j - 1, 0), np.minimum(j, self.r - 1)
                up_ok = (j > 0) & (self.run_keys[up] // self.r == co)
                down_ok = (j < self.r) & (self.run_keys[down] // self.r == co)
                up_run, down_run = self.run_keys[up] % self.r, self.run_keys[down] % self.r
                tail = patterns[off, col + 1 :]
                held = size[off] - 1
                a = np.where(up_ok, self._shared(self.last_sample[up_run], tail, held), -1)
                b = np.where(down_ok, self._shared(self.first_sample[down_run], tail, held), -1)
                take_up = a >= b
                best = np.maximum(a, b)
                to = np.where(take_up, up_run, down_run)
                new_row = np.where(take_up, self.ends[up_run], self.starts[down_run])
                new_place = np.where(take_up, self.last_sample[up_run], self.first_sample[down_run])
                none = best < 0
                run[off] = np.where(none, 0, to)
                row[off] = np.where(none, self.starts[0], new_row)
                place[off] = np.where(none, self.first_sample[0], new_place)
                size[off] = best + 1
            row = self.step[run] + row - self.starts[run]
            place = place - 1
            place[place < 0] = self.n - 1
            if off.size and none.any():
                lost = off[none]
                row[lost], place[lost], size[lost] = 0, self.first_sample[0], 0
            out[:, col], rows[:, col] = size, row
        return out, rows

    def _shared(self, place: np.ndarray, tail: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Symbols that the text at `place` shares with the pattern's tail, at most `held`."""
        width = min(tail.shape[1], int(held.max(initial=0)))
        if not width:
            return np.zeros(place.size, np.int64)
        same = self.text[np.minimum(place[:, None] + np.arange(width), self.text.size - 1)] == tail[:, :width]
        full = same.all(1)
        return np.minimum(np.where(full, width, np.argmin(same, 1)), held)
