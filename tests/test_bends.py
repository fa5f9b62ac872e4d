"""Queries against their SQL on small tables whose points lie beyond the bends of lanes, where both segments are equally near and rounding decides."""

from __future__ import annotations

import math
import random

import duckdb

from tarnspark.plans import lane_queries, route_queries

from .conftest import sorted_rows


def differing(spark, folder, name: str, module, events: list, suppliers: list) -> list:
    """Rows of one side only, of a query and its SQL; events: (user_id, value, k) in order of time; suppliers: (s_nationkey, s_acctbal) by key."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, user_id BIGINT, value DOUBLE, k INT)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", [(i, *e) for i, e in enumerate(events)])
    con.execute("CREATE TABLE supplier (s_suppkey BIGINT, s_nationkey INT, s_acctbal DOUBLE)")
    con.executemany("INSERT INTO supplier VALUES (?, ?, ?)", [(i, *s) for i, s in enumerate(suppliers)])
    con.execute("""CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, user_id, 'view' AS event_type, value, '{"k": ' || k || '}' AS props FROM e""")
    for t in ("events", "supplier"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    want = con.execute(module.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = module.QUERIES[name](spark, str(folder))
    a, b = (sorted_rows(r, n, sorted(names)) for r, n in (([tuple(r) for r in got.collect()], got.columns), (want.fetchall(), names)))
    assert len(a) == len(b) > 0
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]


def test_logged_states_beyond_a_bend(spark, tmp_path):
    """Egos straight above or below a lane's middle point, which is the bend."""
    draw = random.Random(3)
    suppliers = [(draw.choice((0, 1, 2, 3)), round(draw.uniform(0, 9999), 2)) for _ in range(5 * 150)]
    events = [(7 * scene, x, draw.randint(0, 9) * 10 + y) for scene in range(150) for x, y in ((50.0, 8), (50.0, 2), (83.33, 6), (16.67, 7), (50.0, 5))]
    assert not differing(spark, tmp_path, "m6_logged_states", route_queries, events, suppliers)


def test_wrong_direction_beyond_a_bend(spark, tmp_path):
    """Tracks' points about 3 m beyond the bends of their scenes' lanes."""
    draw = random.Random(5)
    suppliers = [(draw.choice([n for n in range(25) if n % 5 != 4]), round(draw.uniform(0, 9999), 2)) for _ in range(5 * 150)]
    events = []
    for key, (nation, balance) in enumerate(suppliers):
        a = nation * math.pi / 12.5
        out = a + 0.25 - math.pi / 2  # between the two segments' right-hand normals
        x, y = balance % 100 + 40 * math.cos(a) + 3 * math.cos(out), key * 37 % 100 + 40 * math.sin(a) + 3 * math.sin(out)
        if 0 <= round(y) <= 99:
            events.append((7 * (key // 5) + key % 5, round(x, 2), round(y)))
    assert not differing(spark, tmp_path, "m7_wrong_direction", lane_queries, events, suppliers)


def test_start_lanes_beyond_a_bend(spark, tmp_path):
    """Poses 1 m and more above a lane's bend, turned so that one of its segments is within a right angle and the other is not."""
    draw = random.Random(7)
    suppliers = [(draw.choice((0, 1, 2, 3)), round(2 * draw.randint(0, 4000) + draw.uniform(1.2, 2.0), 2) if i % 5 == 0 else draw.randint(0, 999) + 0.0) for i in range(5 * 400)]
    events = [(7 * scene + i, x, k) for scene in range(400) for i, at in enumerate((33.33, 33.34)) for x, k in ((at, 5), (round(draw.uniform(20, 80), 2), draw.randint(0, 99)))]
    assert not differing(spark, tmp_path, "r2_routes", route_queries, events, suppliers)
