"""A run-compressed Burrows-Wheeler index over many short strings, in numpy.

The suffixes of all strings are sorted (each string ends in a mark of its own,
in the order of the strings).  What is kept is the transform as runs of equal
characters with the suffix positions at the run ends, and the classes of
suffixes that agree in the first ``length`` bytes with the earliest position of
each.  The strings then stream through the index from right to left, all in
step, each character one LF step, which gives their matching statistics against
the whole text: whether the next ``length`` bytes occur earlier.
"""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, rank of each key, number of ranks)."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.empty(len(keys), np.int64)
    new[:1] = 0
    new[1:] = sorted_[1:] != sorted_[:-1]
    np.cumsum(new, out=new)
    rank = np.empty(len(keys), np.int64)
    rank[order] = new
    return order, rank, int(new[-1]) + 1


class RunIndex:
    """Index of strings given as one byte array with the bounds of each; ``length`` is a power of two up to twice as long or less."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int) -> None:
        count, self.length = len(bounds) - 1, length
        sizes = np.diff(bounds)
        #: Place of each string, and of its end mark, in the text with marks.
        self.begin = bounds[:-1] + np.arange(count)
        self.mark = self.begin + sizes
        total = len(data) + count
        is_mark = np.zeros(total, bool)
        is_mark[self.mark] = True
        symbol = np.empty(total, np.int64)
        symbol[~is_mark] = data
        symbol[~is_mark] += count  # the marks sort before all bytes, in the order of the strings
        symbol[is_mark] = np.arange(count)
        order, class_rank = self._sort(symbol, total, count)
        self._compress(symbol, order, class_rank, total, count)

    def _sort(self, symbol: np.ndarray, total: int, count: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Suffix order by doubling, and two ranks that together tell the first ``length`` bytes."""
        def ahead(rank: np.ndarray, by: int) -> np.ndarray:
            moved = np.zeros(total, np.int64)
            moved[:max(0, total - by)] = rank[by:]
            return moved

        # As many symbols as fit one word begin the doubling at once.
        bits = int(count + 256).bit_length()
        reach, keys = 1, symbol
        while reach * 2 <= min(self.length, 63 // bits):
            keys = (keys << (bits * reach)) | ahead(keys, reach)
            reach *= 2
        order, rank, ranks = _dense(keys)
        half = None
        while True:
            if half is None and reach * 2 >= self.length:
                half = (rank, ahead(rank, self.length - reach))
            if ranks == total:
                break
            order, rank, ranks = _dense(rank * np.int64(total + 1) + ahead(rank, reach))
            reach *= 2
        return order, half or (rank, rank)

    def _compress(self, symbol: np.ndarray, order: np.ndarray, class_rank: tuple, total: int, count: int) -> None:
        before = symbol[order - 1]  # the text is read as a ring
        first = np.empty(total, bool)
        first[0] = True
        first[1:] = before[1:] != before[:-1]
        #: Runs of the transform: first row, character, and the suffix positions at both ends.
        self.run_row = np.flatnonzero(first)
        self.run_symbol = before[self.run_row]
        ends = np.append(self.run_row[1:], total) - 1
        self.run_sample = np.stack([order[self.run_row], order[ends]])
        # Row that the first row of a run goes to: rows of smaller characters, then those of earlier runs of its own.
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        sizes = (ends - self.run_row + 1)[by_symbol]
        target = np.empty(len(sizes), np.int64)
        target[by_symbol] = np.cumsum(sizes) - sizes
        self.run_target = target
        a, b = class_rank
        head = np.empty(total, bool)
        head[0] = True
        head[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        #: Classes of rows whose suffixes agree in ``length`` bytes: first row and earliest position.
        self.class_row = np.flatnonzero(head)
        self.class_first = np.minimum.reduceat(order, self.class_row)
        self.marks = count

    def runs(self) -> int:
        return len(self.run_row)

    def repeated(self) -> np.ndarray:
        """A flag per byte of the strings: ``length`` bytes begin here that also begin earlier.

        All strings step together from their end marks to their first bytes.  A
        row's run gives the character before and, with the row's place in the
        run, the next row (LF); the row's class gives the earliest equal start.
        """
        lengths = self.mark - self.begin
        flags = np.zeros(int(lengths.sum()), bool)
        out = self.begin - np.arange(len(self.begin))
        longest_first = np.argsort(-lengths, kind="stable")
        row = longest_first.copy()  # the mark of string t is row t
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-lengths[longest_first], -step, "right"))
            strings, row = longest_first[:active], row[:active]
            run = np.searchsorted(self.run_row, row, "right") - 1
            row = self.run_target[run] + row - self.run_row[run]
            if step >= self.length:
                position = self.mark[strings] - step
                earliest = self.class_first[np.searchsorted(self.class_row, row, "right") - 1]
                hit = earliest < position
                flags[out[strings[hit]] + lengths[strings[hit]] - step] = True
        return flags
