import random

import pytest

from cloudweave.streaming.slots import FreeSlots, Run, runs_of


class ByHand:
    """A list of free slots, last in first out, and a scan for runs."""

    def __init__(self, n):
        self.n, self.free = n, list(range(n - 1, -1, -1))

    def pop(self):
        return self.free.pop()

    def reserve(self, n):
        for s in range(self.n - n + 1):
            if n > 0 and all(k in self.free for k in range(s, s + n)):
                self.free = [k for k in self.free if not s <= k < s + n]
                return s
        return None

    def release(self, slots):
        self.free += [s for k, s in enumerate(slots) if s not in self.free and s not in slots[:k]]


@pytest.mark.parametrize("seed", range(8))
def test_random_reserves_and_releases(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 7, 40])
    a, b, taken = FreeSlots(n), ByHand(n), []
    for _ in range(600):
        what = rng.random()
        if what < 0.35 and b.free:
            got = a.pop()
            assert got == b.pop()
            taken.append(got)
        elif what < 0.55:
            size = rng.randint(0, 6)
            got = a.reserve(size)
            assert got == b.reserve(size)
            taken += range(got, got + size) if got is not None else ()
        elif taken:
            rng.shuffle(taken)
            k = rng.randint(1, len(taken))
            back, taken = taken[:k], taken[k:]
            again = back + rng.sample(b.free, min(2, len(b.free)))
            a.release(again)
            b.release(again)
        assert len(a) == len(b.free) and [s for x, y in a.runs for s in range(x, y)] == sorted(b.free)
        assert all(y < x for (_, y), (x, _) in zip(a.runs, a.runs[1:])) and all((s in a) == (s in b.free) for s in range(n))


def test_a_full_and_an_odd_pool():
    a = FreeSlots(3)
    assert [a.pop() for _ in range(3)] == [0, 1, 2] and a.reserve(1) is None and a.runs == []
    with pytest.raises(IndexError):
        a.pop()
    a.release([2, 0, 1])
    assert a.runs == [(0, 3)] and a.reserve(3) == 0
    with pytest.raises(ValueError):
        a.release([3])
    for _ in range(500):  # the stack does not grow with what is reserved over it
        a.release([0, 1, 2])
        assert a.reserve(3) == 0
    assert len(a._stack) <= 4 * 3 + 64 + 3


def test_runs_cost_nothing_for_each_slot():
    a = FreeSlots(1 << 40)
    assert a.reserve(1 << 38) == 0 and a.reserve(1 << 39) == 1 << 38 and a.pop() == 3 << 38
    a.release(Run(0, 1 << 38))
    assert a.pop() == (1 << 38) - 1 and a.reserve(5) == 0 and a.pop() == (1 << 38) - 2 and len(a) == (1 << 39) - 8
    assert Run(2, 5) == [2, 3, 4] and list(runs_of([4, 5, 6, 2, 1, 2])) == [(4, 7), (2, 3), (1, 3)] and list(runs_of(Run(3, 3))) == []


@pytest.mark.parametrize("seed", range(4))
def test_a_stack_that_is_tidied(seed):
    rng, n = random.Random(seed), 300
    a, b, taken = FreeSlots(n), ByHand(n), []
    for _ in range(1500):
        size = rng.randint(1, 12)
        got = a.reserve(size)
        assert got == b.reserve(size)
        taken += [list(range(got, got + size))] if got is not None else []
        if rng.random() < 0.3 and b.free:
            taken.append([a.pop()])
            assert taken[-1] == [b.pop()]
        while taken and (got is None or rng.random() < 0.45):
            got, back = 0, taken.pop(rng.randrange(len(taken)))
            a.release(Run(back[0], back[-1] + 1))
            b.release(back)
    while b.free:
        assert a.pop() == b.pop()
