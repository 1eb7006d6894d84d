"""Admin writes under the collation and in batches; validation edge cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from terminus.functions.scalar import folded
from terminus.operators import entities as en
from terminus.operators import quality as qa


def reasons(res, key):
    return {(r.request_id, r[key]): r.reason for r in res.decisions.collect()}


def test_folded_keys(spark):
    df = spark.createDataFrame([("José ", "jose"), ("BT-2025-01", "bt-2025-01"), ("a", "b"), ("Ünï", "uni  ")], "a string, b string")
    assert [r.same for r in df.select((folded("a") == folded("b")).alias("same")).collect()] == [True, True, False, True]


SAME = [("Jose\u0301", "jose"), ("José", "JOSE\u0301"), ("straße", "STRASSE"), ("STRAẞE", "strasse"), 
        ("Ёлка", "елка"), ("Ὀδυσσεύς", "οδυσσευσ"), ("Œuvre", "oeuvre"), ("ẤẦ", "aa"), ("İ", "i"), ("a  ", "A"), ("ñ", "n")]
SHORT_I = [("й", "и"), ("Й", "и\u0306")]  # equal in the reference's collation; Spark's root collation tells them apart
OTHER = [("a", "b"), ("и", "ы"), ("ss", "s"), ("a b", "ab"), (" a", "a"), ("o", "e")]


def test_folded_keys_follow_the_collation(spark):
    """Combining marks, expansions and other scripts; Spark's own collation is the judge."""
    df = spark.createDataFrame([(a, b, True) for a, b in SAME] + [(a, b, False) for a, b in OTHER], "a string, b string, want boolean")
    got = df.select("a", "b", "want", (folded("a") == folded("b")).alias("same"),
                    F.expr("collate(a, 'UNICODE_CI_AI_RTRIM') = collate(b, 'UNICODE_CI_AI_RTRIM')").alias("judge")).collect()
    assert [(r.a, r.b, r.same, r.judge) for r in got] == [(r.a, r.b, r.want, r.want) for r in got]
    short = spark.createDataFrame(SHORT_I, "a string, b string")
    assert [r.same for r in short.select((folded("a") == folded("b")).alias("same")).collect()] == [True, True]


def test_like_and_unique_follow_the_collation(spark):
    from terminus.functions.scalar import ci_contains
    df = spark.createDataFrame([("Jose\u0301 Strauß", "SS", True), ("Йорк", "иор", True), ("Müller", "mu_ler", True), ("Müller", "mu\u0308%R", True),
                                ("Strauß", "s_s", False)], "a string, t string, want boolean")
    assert [r.got for r in df.select(ci_contains(F.col("a"), F.col("t")).alias("got")).collect()] == [True, True, True, True, False]
    users = spark.createDataFrame([(1, "A", "straße@x.org", "active"), (2, "B", "b@x.org", "active")],
                                  "user_id long, firstname string, email string, status string")
    req = spark.createDataFrame([(1, 2, "B", "STRASSE@x.org", "active"), (2, 2, "B", "Jose\u0301@x.org", "active"), (3, 1, "A", "josé@x.org ", "active")],
                                "request_id long, user_id long, firstname string, email string, status string")
    assert reasons(en.update_users(users, req), "user_id") == {(1, 2): "email_in_use", (2, 2): None, (3, 1): "email_in_use"}


def test_user_updates(spark):
    users = spark.createDataFrame([(1, "A", "jose@x.org", "active"), (2, "B", "b@x.org", "active"), (3, "C", "c@x.org", "active")],
                                  "user_id long, firstname string, email string, status string")
    req = spark.createDataFrame([
        (10, 2, "B2", "José@x.org ", "active"),     # another user's address
        (11, 2, "B3", "new@x.org", "blocked"),
        (12, 3, "C2", "NEW@x.org", "active"),       # taken earlier in the batch
        (13, 3, "C3", "C@x.org", "inactive"),       # the own address
        (14, 3, "C4", "d@x.org", "active"),         # second change of user 3
        (15, 9, "Z", "z@x.org", "active")], "request_id long, user_id long, firstname string, email string, status string")
    res = en.update_users(users, req)
    assert reasons(res, "user_id") == {(10, 2): "email_in_use", (11, 2): None, (12, 3): "email_in_use", (13, 3): None,
                                       (14, 3): "duplicate_in_batch", (15, 9): "unknown_user"}
    assert sorted(tuple(r) for r in res.snapshot.collect()) == [
        (1, "A", "jose@x.org", "active"), (2, "B3", "new@x.org", "blocked"), (3, "C3", "C@x.org", "inactive")]


def test_vehicle_creation_is_unique_under_the_collation(spark):
    vehicles = spark.createDataFrame([(2**31, "ABC 1", 14, "retired")], "vehicle_id long, plate_number string, capacity int, vehicle_status string")
    req = spark.createDataFrame([(1, "abc 1", 20), (2, "new", 20), (3, "NEW ", 20)], "request_id long, plate_number string, capacity int")
    res = en.create_vehicles(vehicles, req)
    assert {r.request_id: (r.reason, r.vehicle_id) for r in res.decisions.collect()} == {
        1: ("plate_exists", None), 2: (None, 2**31 + 1), 3: ("duplicate_in_batch", None)}
    assert res.snapshot.filter("plate_number = 'new'").first().vehicle_status == "available"


def test_deletes(spark):
    routes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "route_id long")
    trips = spark.createDataFrame([(1, 1, 7, "waiting"), (2, 2, 8, "arrived"), (3, 4, 8, "full")],
                                  "trip_id long, route_id long, assigned_vehicle_id long, trip_status string")
    req = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4, 5)] + [(6, 3)], "request_id long, route_id long")
    res = en.delete_routes(routes, trips, req)
    assert reasons(res, "route_id") == {(1, 1): "active_trips", (2, 2): "restricted", (3, 3): None, (4, 4): "restricted",
                                        (5, 5): "unknown", (6, 3): "unknown"}
    assert sorted(r[0] for r in res.snapshot.collect()) == [1, 2, 4]
    vehicles = spark.createDataFrame([(7,), (8,)], "vehicle_id long")
    res = en.delete_vehicles(vehicles, trips, spark.createDataFrame([(1, 7), (2, 8)], "request_id long, vehicle_id long"))
    assert reasons(res, "vehicle_id") == {(1, 7): "active_trips", (2, 8): None}
    assert sorted((r.trip_id, r.assigned_vehicle_id) for r in res.extra["trips"].collect()) == [(1, 7), (2, None), (3, None)]
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    req = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 9, 1)], "request_id long, user_id long, requested_by long")
    assert reasons(en.delete_users(users, req), "user_id") == {(1, 1): "own_account", (2, 2): None, (3, 9): "unknown"}


def test_user_cascade_matches_the_counts(spark, tables):
    gone = tables.users.filter(F.col("status") == "blocked")
    none = {n: tables.routes.limit(0) for n in ("routes",)}
    counts = {(r.table_name, r.action): r.rows for r in qa.cascade_delete(
        tables, gone, tables.trips.limit(0), tables.vehicles.limit(0), none["routes"]).collect()}
    rows = {(r.table_name, r.action): r["count"] for r in
            en.cascade_rows(tables, gone).groupBy("table_name", "action").count().collect()}
    for name in ("users", "driver_details", "notifications", "user_notifications"):
        assert rows.get((name, "deleted"), 0) == counts[name, "deleted"]
    assert rows.get(("trips", "set_null"), 0) == counts["trips", "driver_set_null"]
    assert rows.get(("system_log", "set_null"), 0) == counts["system_log", "user_set_null"]


def test_validation_edges(spark):
    def ok(kind, arg, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.ok for r in df.select("i", qa.rule_ok(df, "x", kind, arg).alias("ok")).orderBy("i").collect()]

    assert ok("int", None, ["5", " 5 ", "+7", "-0", "007", "5.0", "", None, "9" * 30]) == [
        True, False, True, True, False, False, False, False, True]
    assert ok("int", (1, 10), ["0", "1", "10", "11"]) == [False, True, True, False]
    assert ok("float", (0, None), ["1.5", " 1.5", "-1", "1e3", "x"]) == [True, False, False, True, False]
    assert ok("iso8601", None, ["2025-02-28", "2025-02-30", "2025-99-99", "2025-01-01T25:00", "2025-01-01T23:59:59Z", "x"]) == [
        True, False, False, False, True, False]
    assert ok("email", None, ["a@b.co", "a b@c.de", "a@b", "a..b@c.de", ".a@c.de", "a@-c.de", "a@c-.de", "a@c.d", "é@c.de",
                              "x" * 65 + "@c.de", "a+b@sub.c.de", None]) == [
        True, False, False, False, False, False, False, False, True, False, True, False]
    df = spark.createDataFrame([("a@b.co", ""), ("bad", "x")], "email string, password string")
    assert [[e.field for e in r.errors] for r in qa.validate_requests(df, "login").collect()] == [["password"], ["email"]]
    route = spark.createDataFrame([("A", "B", Decimal("1.0"), 10, Decimal("5.00"))], "origin string, destination string, "
                                  "distance_km decimal(6,2), estimated_duration_minutes int, fare_price decimal(8,2)")
    assert qa.validate_requests(route, "route").first().valid
