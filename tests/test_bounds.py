"""Values right at a bound: the same as in SQL."""

import datetime

import duckdb
import pytest

from waymark.plans.catalog import QUERIES, SQL


@pytest.fixture
def same(spark, tmp_path):
    """Checks a query over given events (ts, user_id, event_type, value), in order, against its SQL."""

    def check(name, events):
        rows = ", ".join(f"({i}, timestamp '{ts}', {user}, '{kind}', {value}::double)" for i, (ts, user, kind, value) in enumerate(events))
        db = duckdb.connect()
        db.execute(f"create table events as select * from (values {rows}) as e(event_id, ts, user_id, event_type, value)")
        db.execute(f"copy (select event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type, value from events) to '{tmp_path}/events.parquet'")
        theirs = db.execute(SQL[name])
        columns = [c[0] for c in theirs.description]
        wanted = sorted(theirs.fetchall(), key=repr)
        assert sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=repr) == wanted
        return wanted

    return check


def test_headings_two_degrees_apart_are_sent(same):
    hours = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=10 * i) for i in range(8)]
    sent = same("emit_throttle", [(at, user, "view", heading) for user, from_ in enumerate((0.01, 0.03, 0.05, 0.07)) for at, heading in zip(hours, (from_, from_ + 2), strict=False)])
    assert all(row[-1] for row in sent)


def test_local_days_take_the_nearest_millisecond(same):
    times = ("2024-01-01 00:00:59.9994", "2024-01-01 00:00:59.9995", "2024-01-01 23:59:59.9999", "2024-02-29 00:59:59.999999", "1969-12-31 23:59:59.9996", "1969-07-20 20:17:40", "1969-12-31 00:00:00")
    same("local_days", [(at, 0, "view", 0.0) for at in times])


def test_turns_right_at_a_bound_make_checkpoints(same):
    turns = [(236.02, 256.02), (236.03, 256.03), (405.96, 255.96), (405.97, 255.97), (300.01, 335.01), (300.02, 335.02), (511.9, 546.9)]
    same("route_checkpoints", [("2024-01-01", user, "view", value) for user, pair in enumerate(turns) for value in pair])
