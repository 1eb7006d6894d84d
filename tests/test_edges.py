"""Edges from the test plan: empty inputs, end day inclusive, drivers with
no trip, NULL driver / vehicle."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from terminus.operators import lifecycle as lc
from terminus.operators import reports
from terminus.plans import views
from terminus.sources.schemas import SCHEMAS
from terminus.sources.tables import Tables

TS = dt.datetime(2025, 3, 5, 23, 59, 30)


def _tables(spark, **rows):
    return Tables(**{n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS})


def test_empty_tables_give_empty_or_zero_reports(spark):
    t = _tables(spark)
    assert reports.revenue_report(t, dt.date(2025, 1, 1), dt.date(2025, 12, 31)).count() == 0
    (k,) = reports.dashboard_kpis(t, dt.date(2025, 3, 5)).collect()
    assert k.revenue_today == Decimal("0.00") and k.bookings_today == 0 and k.total_users == 0
    assert views.queue_status(t).count() == 0


def test_empty_requests(spark, tables):
    reqs = spark.createDataFrame([], "request_id long, trip_id long, route_id long, firstname string, "
                                     "lastname string, email string, phone string, address string, "
                                     "seat_count int, booking_type string, payment_method string, "
                                     "payment_reference string, requested_at timestamp_ntz")
    res = lc.admit_bookings(tables.trips, reqs, tables.bookings, tables.payment_log, TS)
    assert res.decisions.count() == 0
    assert res.snapshot.count() == tables.trips.count()


def test_end_day_inclusive_and_unassigned_trip(spark):
    trip = (1, 1, None, None, 1, False, TS, TS, None, 60, 14, 3, 11, "departed", Decimal(100))
    t = _tables(spark,
                routes=[(1, "O", "D", None, 30, Decimal(100), "active")],
                users=[(5, "Drv", "Five", "d@x", None, "driver", "active", TS)],
                driver_details=[(5, "LIC", 0, Decimal(0), 0, "available")],
                trips=[trip])
    (s,) = reports.trip_statistics(t, dt.date(2025, 3, 1), dt.date(2025, 3, 5)).collect()
    assert s.total_trips == 1                     # 23:59:30 on the end day counts
    (d,) = reports.driver_performance_report(t, dt.date(2025, 3, 1), dt.date(2025, 3, 5)).collect()
    assert d.trips_in_period == 0 and d.passengers_transported is None   # driver with no trip kept
    (q,) = views.trip_context(t).select("driver_name", "plate_number").collect()
    assert q.driver_name is None and q.plate_number is None             # NULL driver and vehicle
    (st,) = reports.driver_stats(t, dt.date(2025, 3, 5)).collect()
    assert st.trips_today == 0 and st.average_passengers_per_trip == 0.0
