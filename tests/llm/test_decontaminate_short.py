"""Items without a usable window, and scripts without spaces (op7)."""

from test_decontaminate import FILL, leaks

ITEMS = [(1, "Is 17 prime?"), (2, "Who wrote Hamlet?"), (3, "What is 12 + 7 * 3 - 8 / 2 + 45?"), (4, "中国的首都是哪一个城市呢"), (5, "∫ = ?"), (6, " \n"), (7, None), (8, "Is 17 prime?")]


def test_short_items_and_scripts_without_spaces(spark):
    docs = [(i, FILL + t + " " + FILL) for i, t in ITEMS[:5]]
    docs += [(11, FILL + "is 17\nprime? " + FILL), (12, "Is 19 prime?"), (13, "What is 12 + 7 * 3 - 8 / 2 - 45?"), (14, "请问中国的首都是哪一个城市呢谢谢"), (15, "Who wrote Hamlets?"), (16, None), (17, "")]
    got = leaks(spark, docs, ITEMS)
    assert set(got) == {(1, 1), (1, 8), (11, 1), (11, 8), (2, 2), (3, 3), (4, 4), (14, 4), (5, 5)}
    assert all(same for _, _, same in got.values()) and got[3, 3][:2] == (1, 1)
