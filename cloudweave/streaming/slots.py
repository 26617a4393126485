"""Free slots of a pool: single ones last in, first out, and contiguous runs by first fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence


class Run(Sequence):
    """Slots that lie together, as their first and the one behind their last; equal to a list of them."""

    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end

    def __len__(self) -> int:
        return self.end - self.first

    def __getitem__(self, k):
        return range(self.first, self.end)[k]

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.first, self.end))

    def __eq__(self, other) -> bool:
        return list(self) == list(other) if isinstance(other, Sequence) else NotImplemented

    def __repr__(self) -> str:
        return f"Run({self.first}, {self.end})"


def runs_of(slots: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Slots in their order as runs that go up by one: first, and behind the last."""
    if isinstance(slots, Run):
        yield from [(slots.first, slots.end)] if len(slots) else []
        return
    first = end = None
    for slot in slots:
        if slot != end:
            if end is not None:
                yield first, end
            first = slot
        end = slot + 1
    if end is not None:
        yield first, end


class FreeSlots:
    """Which slots are free, as runs that don't touch, and in which order single ones are given out.

    Single slots are taken from the top of a stack of released runs, each from its end, with slot 0 there at first. A run
    is the first one in the order of slots that is long enough; its slots leave the stack too, which is noticed when they
    come to its top: what is free lies highest there where it was released last. Runs are kept sorted by their first
    slots, and grow together when what lies between them is released. Nothing is kept or done for each slot of a run.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, capacity
        self._first, self._end = ([0], [capacity]) if capacity else ([], [])
        self._stack: list[tuple[int, int]] = []  # released runs; slots that aren't free any more are passed by
        self._tidy = 0  # how long the stack was when it was last looked through

    def __len__(self) -> int:
        return self.count

    def __contains__(self, slot: int) -> bool:
        k = bisect_right(self._first, slot) - 1
        return k >= 0 and slot < self._end[k]

    @property
    def runs(self) -> list[tuple[int, int]]:
        """First slots of runs and the slots behind their last."""
        return list(zip(self._first, self._end, strict=True))

    def pop(self) -> int:
        """The slot that was released last; those that never were come after them, in order."""
        while self._stack:
            first, end = self._stack.pop()
            k = bisect_left(self._first, end) - 1
            if k >= 0 and self._end[k] > first:
                slot = min(end, self._end[k]) - 1
                if slot > first:
                    self._stack.append((first, slot))
                self._take(slot, slot + 1)
                return slot
        if not self._first:
            raise IndexError("no free slot")
        slot = self._first[0]
        self._take(slot, slot + 1)
        return slot

    def reserve(self, n: int) -> int | None:
        """The first of n slots that lie together, or None; they are taken."""
        if n <= 0:
            return None
        for first, end in zip(self._first, self._end, strict=True):
            if end - first >= n:
                self._take(first, first + n)
                return first
        return None

    def release(self, slots: Sequence[int]) -> None:
        """Frees slots, in the order in which they are put on the stack; free ones stay as they are."""
        for first, end in runs_of(slots):
            if not (first >= 0 and end <= self.capacity):
                raise ValueError(f"slots {first} to {end - 1} of {self.capacity}")
            at = first
            while at < end:
                k = bisect_right(self._first, at) - 1
                if k >= 0 and at < self._end[k]:
                    at = self._end[k]
                    continue
                stop = min(end, self._first[k + 1]) if k + 1 < len(self._first) else end
                self._free(at, stop)
                at = stop
        if len(self._stack) > 2 * self._tidy + 64:
            self._tidied()

    def append(self, slot: int) -> None:
        self.release([slot])

    def _free(self, first: int, end: int) -> None:
        """Frees slots none of which is free."""
        self._stack.append((first, end))
        self.count += end - first
        k = bisect_left(self._first, first)
        left, right = k > 0 and self._end[k - 1] == first, k < len(self._first) and self._first[k] == end
        if left and right:
            self._end[k - 1] = self._end[k]
            del self._first[k], self._end[k]
        elif left:
            self._end[k - 1] = end
        elif right:
            self._first[k] = first
        else:
            self._first.insert(k, first)
            self._end.insert(k, end)

    def _within(self, first: int, end: int) -> list[tuple[int, int]]:
        """What is free of a range."""
        k, parts = max(bisect_right(self._first, first) - 1, 0), []
        while k < len(self._first) and self._first[k] < end:
            if self._end[k] > first:
                parts.append((max(first, self._first[k]), min(end, self._end[k])))
            k += 1
        return parts

    def _tidied(self) -> None:
        """Leaves the last release of each free slot on the stack, and no others."""
        rest, kept = FreeSlots(0), []
        rest._first, rest._end = self._first[:], self._end[:]
        for first, end in reversed(self._stack):
            parts = rest._within(first, end)
            for part in parts:
                rest._take(*part)
            kept += reversed(parts)
        self._stack, self._tidy = kept[::-1], len(kept)

    def _take(self, first: int, end: int) -> None:
        k = bisect_right(self._first, first) - 1
        a, b = self._first[k], self._end[k]
        left, right = [(a, first)] if a < first else [], [(end, b)] if end < b else []
        self._first[k : k + 1] = [x for x, _ in left + right]
        self._end[k : k + 1] = [y for _, y in left + right]
        self.count -= end - first
