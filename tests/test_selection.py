"""Scenarios of the selection kernel at 15 samples a second; tests/test_stateful.py has the stream."""

import math

from lodestar.streaming.selection import Config, Debounce, Element, OneEuro, Pinch, Selection, replay, under

C = Config()
DT = 1 / 15


def test_pinch_needs_a_higher_threshold_to_open():
    p = Pinch()
    assert [p.step(i * DT, g * 90, 90, C) for i, g in enumerate((0.5, 0.3, 0.27, 0.3, 0.35))] == [False, False, True, True, True]


def test_pinch_survives_a_flicker_but_not_a_real_opening():
    p = Pinch()
    p.step(0, 20, 90, C)
    assert p.step(DT, 60, 90, C) and p.step(2 * DT, 20, 90, C)
    held = [p.step(1 + i * DT, 60, 90, C) for i in range(6)]
    assert held[0] and not held[-1]


def test_lost_hand_keeps_the_pinch_for_its_grace():
    p = Pinch()
    p.step(0, 20, 90, C)
    assert p.step(0.2, None, None, C)
    assert not p.step(0.31, None, None, C)


def test_unlikely_palm_falls_back_to_millimetres():
    assert Pinch().step(0, 21.9, 20, C) and not Pinch().step(0, 22.1, None, C)


def test_filter_smooths_at_rest_and_ignores_old_samples():
    f = OneEuro()
    assert f.step(0, 10, 10) == (10, 10)
    x, _ = f.step(DT, 11, 10)
    assert 10 < x < 11
    assert f.step(0, 50, 50) == f.at and abs(f.at[0] - x) < 1e-12


def test_debounce_waits_longer_to_change_than_to_enter():
    d = Debounce()
    assert d.step(0, "a", C) is None and d.step(0.061, "a", C) == "a"
    assert d.step(0.1, "b", C) == "a" and d.step(0.19, "b", C) == "a" and d.step(0.221, "b", C) == "b"
    assert d.step(0.3, None, C) == "b" and d.step(0.451, None, C) is None


POINT, LINE, AXIS = Element("p", "s1", "punto", 0, 7, 10, 10), Element("c", "s2", "segmento", 1, 8, 0, 12, 40, 12), Element("e", "", "segmento", 10, 7, 0, 0, 100, 0)


def test_a_point_wins_unless_the_curve_is_much_nearer():
    assert under(10, 11, [POINT, LINE, AXIS], C)[0] == "p"
    assert under(16, 12, [POINT, LINE, AXIS], C)[0] == "c"


def test_rest_wins_only_by_its_margin():
    assert under(60, 1, [LINE, AXIS], C)[0] == "e"
    assert under(20, 6, [LINE, AXIS], C)[0] == "c"


def test_current_element_reaches_further_and_followed_series_is_kept():
    assert under(20, 20.5, [LINE], C)[0] is None and under(20, 20.5, [LINE], C, "c")[0] == "c"
    other = Element("d", "s3", "segmento", 1, 8, 0, 14, 40, 14)
    assert under(20, 13.5, [LINE, other], C)[0] == "d" and under(20, 13.5, [LINE, other], C, None, "s2")[0] == "c"


def test_selection_forgets_a_lost_hand_and_skips_old_samples():
    s, e = Selection(), {x.id: x for x in (POINT, LINE)}
    for i in range(5):
        out = s.step(i * DT, (10, 10), (20, 10), 90, e, C)
    assert out[:2] == (True, "p")
    assert s.step(2 * DT, (10, 10), (20, 10), 90, e, C) is None
    assert s.step(2.0, None, None, None, e, C)[:2] == (False, None)
