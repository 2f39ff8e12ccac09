"""Names at the start of sentences and number words (op7)."""

from tagloom.llm import decontaminate as dc
from test_decontaminate import leaks

NAMES = (
    "Tom has 4 red marbles in a small bag. Tom finds 6 more of them under the old bed. Anna takes 2 of the marbles to school with her. "
    "How many marbles are left in the bag at the end of that day"
)
WORDS = "A baker bakes three trays of bread each morning and sells five of the loaves to Mr. Smith who lives near the mill so how many loaves are left at noon"


def test_names_at_the_start_and_number_words(spark):
    other = NAMES.replace("Tom", "Lucy").replace("Anna", "Peter").replace(" 4 ", " 9 ")
    words = WORDS.replace("three", "seven").replace("five", "12").replace("Smith", "Jones")
    inside = "Please note that " + NAMES[0].lower() + NAMES[1:]
    got = leaks(spark, [(1, other), (2, words), (3, NAMES), (4, inside)], [(1, NAMES), (2, WORDS)])
    assert set(got) == {(1, 1), (2, 2), (3, 1), (4, 1)}
    assert [got[k][2] for k in [(1, 1), (2, 2), (3, 1)]] == [False, False, True]
    assert got[1, 1][0] == got[1, 1][1]


def test_readings_keep_the_first_ones():
    codes = dc._TokenCodes()
    at, h, values = dc.template_windows(NAMES, codes)
    rows, hashes, slots, n = dc.readings(NAMES, codes)
    assert n == len(at) == len(set(rows.tolist())) < len(rows)
    assert (rows[:n] == at).all() and (hashes[:n] == h).all() and (slots[:n] == values).all()
    assert ((slots == 0).sum(axis=1) >= dc.LITERALS).all()
