"""Reference quirks (K*) and cross-engine semantics (M*) on small tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from terminus.functions import scalar as S
from terminus.operators import quality as qa
from terminus.operators import reports
from terminus.sources.tables import Tables
from terminus.sources.schemas import SCHEMAS

D = dt.date(2025, 3, 5)
TS = dt.datetime(2025, 3, 5, 9, 0)


def _tables(spark, **rows):
    dfs = {n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS}
    return Tables(**dfs)


def _trip(tid, status, drv=1, sb=0, dep=TS):
    return (tid, 1, None, drv, 1, False, dep, dep, None, 60, 14, sb, 14 - sb, status, Decimal(100))


def _booking(bid, tid, seats, status="paid"):
    return (bid, f"BT-2025-{bid:04d}", tid, "A", "B", "a@b.co", "1", None, seats, "online", status,
            Decimal(100 * seats), TS, TS)


def test_k1_trips_count_counts_booking_rows(spark):
    t = _tables(spark,
                users=[(1, "Drv", "One", "d@x", None, "driver", "active", TS)],
                trips=[_trip(10, "departed"), _trip(11, "arrived")],
                bookings=[_booking(1, 10, 2), _booking(2, 10, 3), _booking(3, 10, 1, "cancelled")])
    (r,) = reports.driver_earnings(t, D).collect()
    assert r.today_trips_count == 3 and r.today_distinct_trips == 2
    assert r.today_earnings == Decimal("500.00") and r.today_passengers == 5


def test_k3_double_payment_counts_seats_twice(spark):
    pay = [(10, 1, 10, "x", Decimal(200), "cash", "R1", TS), (11, 1, 10, "x", Decimal(200), "cash", "R2", TS)]
    t = _tables(spark, routes=[(1, "O", "D", None, 30, Decimal(100), "active")], trips=[_trip(10, "departed")],
                bookings=[_booking(1, 10, 2)], payment_log=pay)
    (r,) = reports.revenue_report(t, D, D).collect()
    assert r.total_bookings == 1 and r.total_seats_sold == 4 and r.total_revenue == Decimal("400.00")
    assert r.average_transaction == 200.0


def test_scalar_semantics(spark):
    df = spark.createDataFrame([("Ann", None, 123456, dt.datetime(2025, 1, 1, 10, 0, 59), "VAN")],
                               "f string, l string, id long, t timestamp_ntz, v string")
    r = df.select(
        S.full_name("f", "l").alias("name"),                                            # M2
        S.ticket_reference(F.col("id"), F.col("t"), wide=False).alias("lit"),          # M11
        S.ticket_reference(F.col("id"), F.col("t"), wide=True).alias("wide"),
        S.minutes_between(F.lit("2025-01-01 10:00:00").cast("timestamp_ntz"), F.col("t")).alias("m"),  # M9
        S.enum_ordinal(F.lower("v"), S.VEHICLE_TYPES).alias("ord"),                     # M4
        S.same_iso_week(F.col("t"), dt.date(2024, 12, 30)).alias("wk"),                 # M10 cross-year week
    ).first()
    assert r.name is None and r.lit == "BT-2025-1234" and r.wide == "BT-2025-123456"
    assert r.m == 0 and r.ord == 1 and r.wk is True


def test_validation_rules(spark):
    df = spark.createDataFrame([
        (1, "A", "B", "a@b.co", "1", "x", 2, "cash", "R"),
        (None, " ", "B", "bad", "", None, 11, "online", ""),
    ], "trip_id long, firstname string, lastname string, email string, phone string, address string, "
       "seat_count int, payment_method string, payment_reference string")
    out = {r.trip_id: r for r in qa.validate_requests(df, "walk_in_booking").collect()}
    assert out[1].valid and out[1].errors == []
    fields = [e.field for e in out[None].errors]
    assert fields == ["trip_id", "firstname", "email", "phone", "address", "seat_count", "payment_method",
                      "payment_reference"]
    counts = {r.field: r.errors for r in qa.validation_error_counts(df, "walk_in_booking").collect()}
    assert counts["lastname"] == 0 and counts["email"] == 1 and counts["*"] == 1


def test_integrity_audit_fixture(tables):
    got = {r.rule: r.violations for r in qa.integrity_audit(tables).collect()}
    assert len(got) == 20
    assert got["fk_trips_route"] == 0 and got["uq_bookings_ticket_reference"] == 0
    assert got["inv_trip_seats_booked_equals_paid_seats"] > 0     # capped fixture seats
