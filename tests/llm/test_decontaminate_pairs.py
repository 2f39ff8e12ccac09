"""One assignment for all of a pair's windows (op7)."""

import random
from itertools import product

from tagloom.llm import decontaminate as dc
from test_decontaminate import leaks

ITEM = (
    "On a small farm near the river there are 5 goats in the barn and a cat on the roof while the farmer keeps 5 sheep out in the "
    "field and every animal gets some hay before the sun goes down so how many animals must be fed on the farm today"
)


def test_a_value_cannot_become_two(spark):
    """Words inserted between two halves part the diagonals; they do not part the values."""
    parted = ITEM.replace("5 goats", "9 goats").replace("5 sheep", "4 sheep").replace("while the", "and so while the")
    moved = ITEM.replace("while the", "and so while the")
    renamed = moved.replace("5", "9")
    got = leaks(spark, [(1, parted), (2, moved), (3, renamed)], [(1, ITEM)])
    n = got[2, 1][0]
    assert got[2, 1][1] == got[3, 1][1] >= n - 5 and got[2, 1][2] and not got[3, 1][2]
    assert (1, 1) not in got or got[1, 1][1] <= got[3, 1][1] - 4


def test_two_copies_with_other_values_each_count_whole(spark):
    text = ITEM.replace("5", "9") + " . then some words " + ITEM.replace("5", "4")
    n, found, same = leaks(spark, [(1, text)], [(1, ITEM)])[1, 1]
    assert found == n and not same


def test_places_with_several_windows_against_all_assignments(monkeypatch):
    def brute(windows):
        equal = {at for at, slots in windows if all(a == x for a, x in slots)}
        options = {a: {a} for at, slots in windows if all(a == x for a, x in slots) for a, _ in slots}
        kept = set(options)
        for _, slots in windows:
            for a, x in slots:
                if a not in kept:
                    options.setdefault(a, set()).add(x)
        choices = (dict(zip(options, c, strict=True)) for c in product(*options.values()))
        return max(len(equal | {at for at, slots in windows if all(f[a] == x for a, x in slots)}) for f in choices)

    draw = random.Random(5)
    for limit in (100_000, 5, 1):
        monkeypatch.setattr(dc, "MAX_TABLE", limit)
        for _ in range(200):
            windows = [(draw.randint(0, 10), [(draw.randint(1, 5), draw.randint(1, 3)) for _ in range(draw.randint(0, 3))]) for _ in range(draw.randint(1, 16))]
            found = dc.largest_assignment(windows)
            assert len(found) == len(set(found)) == brute(windows), windows


def test_many_copies_with_other_values_are_settled_fast():
    """Three hundred copies of one question, each with its own three values."""
    pairs = [(at, [(1 + at % 3, 10 * c + at % 3), (1 + (at + 1) % 3, 10 * c + (at + 1) % 3)]) for c in range(10, 310) for at in range(30)]
    assert len(dc.largest_assignment(pairs)) == 30
