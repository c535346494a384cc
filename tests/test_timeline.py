from datetime import datetime

import pytest

from tesselon.functions import timeline as t

LEAP_DAY = "2016-02-29T06:30:15"


def test_steps_from_a_leap_day_come_back_to_it():
    """Every step counts from the start: a shorter month or a common year clips it once, not for good."""
    assert t.instants(LEAP_DAY, "2020-03-01", "yearly") == [datetime(y, 2, 29 if y % 4 == 0 else 28, 6, 30, 15) for y in range(2016, 2021)]
    assert [x.day for x in t.instants("2019-10-31", "2020-03-31", "monthly")] == [31, 30, 31, 31, 29, 31]
    assert [(x.month, x.day) for x in t.instants("2018-11-30", "2019-12-01", "quarterly")] == [(11, 30), (2, 28), (5, 30), (8, 30), (11, 30)]


def test_steps_below_a_month():
    assert [x.isoformat() for x in t.instants("2016-02-28T22:00:00", "2016-02-29T01:30:00", "hourly")] == ["2016-02-28T22:00:00", "2016-02-28T23:00:00", "2016-02-29T00:00:00", "2016-02-29T01:00:00"]
    assert [x.day for x in t.instants("2016-02-22", "2016-03-07", "weekly")] == [22, 29, 7]
    assert [x.day for x in t.instants("2021-02-27", "2021-03-02", "daily")] == [27, 28, 1, 2]


def test_steps_from_the_end():
    assert t.instants("2019-12-10", "2020-03-31", "P1M", from_end=True) == [datetime(2019, 12, 31), datetime(2020, 1, 31), datetime(2020, 2, 29), datetime(2020, 3, 31)]
    assert t.instants("2019-01-01", "2019-01-20", "P7D", from_end=True) == [datetime(2019, 1, d) for d in (6, 13, 20)]


def test_lists():
    assert t.instants("2017", "2015-06", "2017-01-01") == [datetime(2015, 6, 1), datetime(2017, 1, 1)]
    assert len(t.default_instants()) > 200
    with pytest.raises(ValueError):
        t.instants("2018", "2017", "P1Y")


@pytest.mark.parametrize("text", ["2016-2-9", "2016-02-29T00:00:00+01:00", "-2016-02-29", "20:00", "2016-13", "x", ""])
def test_refused(text):
    with pytest.raises(ValueError):
        t.parse_iso(text)


@pytest.mark.parametrize("text", ["P", "P0D", "PT0S", "1D", "P1X", "PT"])
def test_periods_refused(text):
    with pytest.raises(ValueError):
        t.parse_period(text)
