from datetime import date

import pytest

from marketloom.operators.surprises import market_surprises


def day(n):
    return date(2020, 1, n)


def test_moves_on_event_days(spark):
    closes = [("A", 1, 100.0), ("A", 2, 101.0), ("A", 3, None), ("A", 4, 99.99), ("A", 5, 0.0), ("A", 6, 1.0), ("B", 1, 50.0), ("B", 2, 49.0), ("C", 4, 7.0), ("X", 4, 1.0)]
    frame = spark.createDataFrame([(s, day(n), c) for s, n, c in closes], "symbol string, day date, close double")
    # Day 1 has no move, 3 no close, 6 follows a close of 0, 9 has no market; day 2 is announced twice.
    events = spark.createDataFrame([(day(n), n) for n in (1, 2, 2, 3, 4, 6, 9)] + [(None, 0)], "day date, code int")
    got = {r.day: r for r in market_surprises(events, frame, "A", ["B", "C"]).collect()}
    assert set(got) == {day(2), day(4)}
    assert (got[day(2)].surprise, got[day(2)].abs_surprise, got[day(2)].abs_b) == pytest.approx((100.0, 100.0, 200.0)) and got[day(2)].abs_c is None
    # The last close before day 4 is that of day 2.
    assert (got[day(4)].surprise, got[day(4)].abs_surprise) == pytest.approx((-100.0, 100.0)) and got[day(4)].abs_b is None


def test_empty_tables(spark):
    closes = spark.createDataFrame([], "symbol string, day date, close double")
    events = spark.createDataFrame([(day(1),)], "day date")
    assert market_surprises(events, closes, "A", ["B"]).collect() == []
    some = spark.createDataFrame([("A", day(1), 1.0), ("A", day(2), 2.0)], closes.schema)
    assert market_surprises(events.limit(0), some, "A", ["B"]).collect() == []
