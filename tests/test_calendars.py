"""Calendar references against plain Python."""

import datetime
import random

from factloom.operators import calendars

DAY = datetime.date(2024, 1, 1)


def on(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def at(n):
    return None if n is None else datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(days=n)


def newest(versions, calendar, as_of):
    known = sorted((available, v) for c, v, available in versions if c == calendar)
    seen = [v for available, v in known if as_of is not None and available <= as_of]
    return (seen[-1], None) if seen else (None, calendars.VIOLATION if known else calendars.NOT_FOUND)


def test_sessions(spark):
    rng = random.Random(2)
    versions = [("X", 1, at(-50)), ("X", 2, at(30)), ("Y", 1, at(10))]
    days = {(c, v): sorted(rng.sample(range(-40, 90), 60)) for c, v, _ in versions}
    sessions = [(c, v, a, on(d)) for c, v, a in versions for d in [*days[c, v], days[c, v][0]]] + [("X", 1, at(-50), None)]
    refs = [(i, rng.choice(["X", "X", "Y", "Z", None]), rng.choice([None, *range(-60, 100)]), rng.choice([None, 0, 1, -1, -7, 40, -90])) for i in range(300)]
    got = calendars.resolve_sessions(
        spark.createDataFrame([(i, c, at(n), o) for i, c, n, o in refs], "id long, calendar_id string, as_of timestamp_ntz, offset int"), spark.createDataFrame(sessions, "calendar_id string, version int, available_at timestamp_ntz, session_date date")
    )
    found = {r.id: (r.version, r.base_date, r.target_date, r.status) for r in got.collect()}
    for i, c, n, offset in refs:
        version, status = newest(versions, c, at(n))
        base = target = None
        if version:
            own = days[c, version]
            index = sum(d <= n for d in own) - 1
            base = on(own[index]) if index >= 0 else None
            to = index + offset if index >= 0 and offset is not None else -1
            target = on(own[to]) if 0 <= to < len(own) else None
            status = calendars.RESOLVED if target else calendars.OUT_OF_RANGE
        assert found[i] == (version, base, target, status)


def test_periods(spark):
    periods = [("X", 1, at(0), "Q1", on(0), on(9)), ("X", 2, at(5), "Q1", on(0), on(8)), ("X", 2, at(5), "Q2", on(9), on(20))]
    refs = [(1, "X", at(-1), "Q1"), (2, "X", at(0), "Q1"), (3, "X", at(0), "Q2"), (4, "X", at(9), "Q1"), (5, "X", at(9), "Q2"), (6, "W", at(9), "Q2"), (7, "X", None, "Q1"), (8, "X", at(9), None)]
    got = calendars.resolve_periods(spark.createDataFrame(refs, "id long, calendar_id string, as_of timestamp_ntz, period_label string"), spark.createDataFrame(periods, "calendar_id string, version int, available_at timestamp_ntz, period_label string, start_date date, end_date date"))
    assert sorted((r.id, r.version, r.end_date, r.status) for r in got.collect()) == [
        (1, None, None, calendars.VIOLATION), (2, 1, on(9), calendars.RESOLVED), (3, 1, None, calendars.OUT_OF_RANGE), (4, 2, on(8), calendars.RESOLVED),
        (5, 2, on(20), calendars.RESOLVED), (6, None, None, calendars.NOT_FOUND), (7, None, None, calendars.VIOLATION), (8, 2, None, calendars.OUT_OF_RANGE),
    ]
