"""Arrival operators against loops over small random tables with one very common trip and order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from hubflow.operators import arrivals as A

START = datetime(2024, 1, 1)


def _moment(rng, none=0.1):
    return None if rng.random() < none else START + timedelta(hours=rng.randrange(60))


def _pick(rng, common, others):
    return common if rng.random() < 0.35 else rng.choice(others)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_arrival(table, seed):
    rng = random.Random(seed)
    trips = [None, *[f"t{i}" for i in range(8)]]
    scans = [
        (
            _pick(rng, "o0", [f"o{i}" for i in range(12)]),
            rng.choice([None, 1, 2, 3]),
            _moment(rng),
            _pick(rng, "t0", trips),
            rng.choice(["receive", "receive", "unpack", "export"]),
        )
        for _ in range(300)
    ]
    check_ins = [(_pick(rng, "t0", trips), rng.choice([1, 2, 3]), _moment(rng, 0.3)) for _ in range(40)]
    wanted: dict[tuple, list] = {}
    for order, hub, seen, trip, kind in scans:
        if kind == "export":
            continue
        matches = [c for t, h, c in check_ins if kind == "receive" and trip is not None and t == trip and h == hub]
        arrived = [c if c is not None else seen for c in matches] or [seen]
        wanted.setdefault((order, hub), []).extend(a for a in arrived if a is not None)
    rows = table("order_code string, hub_id bigint, action_time timestamp_ntz, trip_code string, action_category string", *scans)
    events = table("trip_code string, hub_id bigint, check_in_at timestamp_ntz", *check_ins)
    known = A.earliest_check_in(events, ["trip_code", "hub_id"])
    found = {(r.order_code, r.hub_id): r.arrived_at for r in A.first_arrival(rows, known, "trip_code").collect()}
    assert found == {key: min(times, default=None) for key, times in wanted.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_hubs_passed_before_delivery(table, seed):
    rng = random.Random(seed)
    orders = [f"o{i}" for i in range(30)]
    arrived = {(o, h): _moment(rng, 0) for o in orders for h in range(12) if rng.random() < 0.7}
    goals = {(o, rng.randrange(12)) for o in orders for _ in range(rng.choice([1, 1, 2]))}
    transit = {0, 3, 6, 9}
    wanted = {}
    for order in orders:
        passed = {
            h
            for (o, h), at in arrived.items()
            if o == order and h in transit and any(g == order and (g, d) in arrived and at < arrived[g, d] for g, d in goals)
        }
        if passed:
            wanted[order] = len(passed)
    rows = table("order_code string, hub_id bigint, arrived_at timestamp_ntz", *[(o, h, at) for (o, h), at in arrived.items()])
    cohort = table("order_code string, deliver_warehouse_id bigint, lane string", *[(o, h, n) for o, h in goals for n in "ab"])
    found = A.hubs_passed(A.delivery_arrivals(rows, cohort, table("hub_id bigint", *[(h,) for h in transit])))
    assert {r.order_code: r.hubs_passed for r in found.collect()} == wanted
