"""Slots of op7: the rule is written here again, by trying every assignment."""

import random
from itertools import product

from tagloom.llm import decontaminate as dc
from test_decontaminate import leaks

GOATS = (
    "On a small farm near the river there are 5 goats in the barn and a cat on the roof while the farmer keeps 5 sheep out in the "
    "field and every animal gets some hay before the sun goes down so how many animals must be fed on the farm today"
)
SALE = "At the market a woman sells 4 baskets of ripe plums to her neighbour and later that day she also sells 2 baskets of sweet pears to the baker before going home so how many baskets did she sell"


def brute_assignment(windows):
    """The most windows that count: equal ones, and those that agree with one function."""
    equal = {at for at, slots in windows if all(a == x for a, x in slots)}
    options = {a: {a} for at, slots in windows if at in equal for a, _ in slots}
    kept = set(options)
    for _, slots in windows:
        for a, x in slots:
            if a not in kept:
                options.setdefault(a, set()).add(x)
    most = 0
    for choice in product(*options.values()):
        f = dict(zip(options, choice, strict=True))
        most = max(most, len(equal | {at for at, slots in windows if all(f[a] == x for a, x in slots)}))
    return most


def test_one_changed_occurrence_of_a_repeated_value(spark):
    got = leaks(spark, [(1, GOATS.replace("5 sheep", "6 sheep")), (2, GOATS)], [(1, GOATS)])
    assert got[2, 1][0] == got[2, 1][1] and got[2, 1][2]
    n, found, same = got[1, 1]
    assert n - 5 <= found < n and same  # only the windows of the sheep are lost


def test_two_values_become_one(spark):
    n, found, same = leaks(spark, [(1, SALE.replace("4", "6").replace("2", "6"))], [(1, SALE)])[1, 1]
    assert found == n and not same
    # The reverse is no function: one value of the item, two new ones in the document, so only the larger share counts.
    n, found, _ = leaks(spark, [(1, GOATS.replace("5 goats", "7 goats").replace("5 sheep", "8 sheep"))], [(1, GOATS)])[1, 1]
    assert n * 0.8 <= found < n


def test_assignment_against_all_assignments(monkeypatch):
    draw = random.Random(3)
    for _ in range(300):
        windows = [(at, [(draw.randint(1, 4), draw.randint(1, 3)) for _ in range(draw.randint(0, 2))]) for at in range(draw.randint(1, 14))]
        found = dc.largest_assignment(windows)
        assert len(found) == len(set(found)) == brute_assignment(windows), windows
        with monkeypatch.context() as m:
            m.setattr(dc, "MAX_TABLE", 1)
            fewer = dc.largest_assignment(windows)
        assert {at for at, slots in windows if all(a == x for a, x in slots)} <= set(fewer) and len(fewer) <= len(found)
