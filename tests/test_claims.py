"""Values that change hands within a batch, held against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from terminus.operators import claims, entities as en


def loop(holders, requests):
    """One request after the other."""
    now, changed, out = dict(holders), set(), {}
    for request_id, row, value in sorted(requests):
        if value is not None and any(v == value for r, v in now.items() if r != row):
            out[request_id] = "clash"
        elif row in changed:
            out[request_id] = "duplicate_in_batch"
        else:
            out[request_id] = "accepted"
            now[row] = value
            changed.add(row)
    return out


def settled(spark, holders, requests):
    h = spark.createDataFrame(list(holders.items()), "row long, held string")
    c = spark.createDataFrame(requests, "request_id long, row long, value string").repartition(3)
    return {r.request_id: r.outcome for r in claims.settle(h, c).collect()}


def test_a_refused_request_claims_nothing(spark):
    # 1 takes a and is then a duplicate for b, so b stays free for 2
    assert settled(spark, {1: "o1", 2: "o2"}, [(1, 1, "a"), (2, 1, "b"), (3, 2, "b")]) == {
        1: "accepted", 2: "duplicate_in_batch", 3: "accepted"}


def test_a_value_that_was_left_is_free(spark):
    assert settled(spark, {1: "o1", 2: "o2", 3: "o3"}, [(1, 3, "o1"), (2, 1, "new"), (3, 3, "o1"), (4, 2, "o1")]) == {
        1: "clash", 2: "accepted", 3: "accepted", 4: "clash"}


def test_swap_and_own_value(spark):
    assert settled(spark, {1: "a", 2: "b"}, [(1, 1, "b"), (2, 2, "a"), (3, 1, "a"), (4, 2, "c"), (5, 1, "b")]) == {
        1: "clash", 2: "clash", 3: "accepted", 4: "accepted", 5: "duplicate_in_batch"}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 300, []
    real = claims._settled
    monkeypatch.setattr(claims, "_settled", lambda *a: rounds.append(1) or real(*a))
    holders = {i: f"v{i}" for i in range(n)}
    shift = [(i + 1, n - 1 - i, f"v{n - i}") for i in range(n)]  # each takes what the one before has just left
    assert set(settled(spark, holders, shift).values()) == {"accepted"}
    assert len(rounds) <= 12
    blocked = [*shift[1:], (1000, n - 1, "vX")]  # the last holder never moves in time
    assert settled(spark, holders, blocked) == loop(holders, blocked)


@pytest.mark.parametrize("seed", range(4))
def test_random_batches_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    n = 40
    holders = {i: f"v{i}" for i in range(n)}
    if seed == 3:  # values that several rows share before the batch
        holders |= {i: f"v{i % 7}" for i in range(0, n, 3)}
    values = [f"v{i}" for i in range(n)] + ["new1", "new2", "hot", "hot", "hot", None]
    requests = [(i, rng.randrange(n + 4), rng.choice(values)) for i in rng.sample(range(10_000), 160)]
    assert settled(spark, holders, requests) == loop(holders, requests)


def test_vehicle_batch_of_updates_and_creations(spark):
    vehicles = spark.createDataFrame([(1, "AAA 1", 10, "available"), (2, "BBB 2", 10, "retired")],
                                     "vehicle_id long, plate_number string, capacity int, vehicle_status string")
    req = spark.createDataFrame([
        (1, None, "aaa 1", 20),      # plate still in use
        (2, 1, "CCC 3", 11),         # leaves AAA 1
        (3, None, "aaa 1 ", 21),     # now free for a new vehicle
        (4, 2, "AAA 1", 12),         # taken by the new one
        (5, None, "DDD 4", 22),
        (6, 9, "EEE 5", 1),          # unknown vehicle
        (7, None, "EEE 5", 23)], "request_id long, vehicle_id long, plate_number string, capacity int")
    res = en.write_vehicles(vehicles, req)
    assert {r.request_id: (r.kind, r.reason, r.vehicle_id) for r in res.decisions.collect()} == {
        1: ("create", "plate_exists", None), 2: ("update", None, 1), 3: ("create", None, 3), 4: ("update", "plate_exists", 2),
        5: ("create", None, 4), 6: ("update", "unknown_vehicle", 9), 7: ("create", None, 5)}
    assert sorted(tuple(r) for r in res.snapshot.collect()) == [
        (1, "CCC 3", 11, "available"), (2, "BBB 2", 10, "retired"), (3, "aaa 1 ", 21, "available"), (4, "DDD 4", 22, "available"),
        (5, "EEE 5", 23, "available")]


def test_empty_batch(spark):
    users = spark.createDataFrame([(1, "a@x.org")], "user_id long, email string")
    res = en.update_users(users, users.limit(0).withColumn("request_id", F.lit(1).cast("bigint")))
    assert res.decisions.count() == 0 and res.snapshot.count() == 1
