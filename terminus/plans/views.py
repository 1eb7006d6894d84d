"""The reference's four SQL views as DataFrame functions.

No view sorts: ordering is applied by the caller (or not at all), so filters
on a view push down through it into the scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.functions.scalar import LIVE_TRIP, full_name, money, on_day
from terminus.sources.tables import Tables


def driver_names(t: Tables) -> DataFrame:
    """user_id -> driver_name, phone (the users side of the trip joins)."""
    return t.users.select(F.col("user_id").alias("_uid"),
                          full_name("firstname", "lastname").alias("driver_name"),
                          F.col("phone_number").alias("driver_phone"))


def trip_context(t: Tables, trips: DataFrame | None = None) -> DataFrame:
    """trips JOIN routes LEFT JOIN vehicles LEFT JOIN users (driver)."""
    trips = t.trips if trips is None else trips
    r = t.routes.select("route_id", "origin", "destination", "distance_km",
                        F.col("estimated_duration_minutes").alias("route_duration_minutes"),
                        F.col("fare_price").alias("route_fare_price"),
                        F.col("status").alias("route_status"))
    v = t.vehicles.select(F.col("vehicle_id").alias("_vid"), "plate_number", "vehicle_type",
                          "make", "model", F.col("capacity").alias("vehicle_capacity"))
    d = driver_names(t)
    return (trips.join(r, "route_id")
            .join(v, trips.assigned_vehicle_id == v._vid, "left")
            .join(d, trips.driver_id == d._uid, "left")
            .withColumnsRenamed({"_vid": "vehicle_id", "_uid": "driver_user_id"}))


def active_bookings(t: Tables) -> DataFrame:
    """view_active_bookings: paid bookings on boarding/full/departed trips."""
    b = t.bookings.filter(F.col("payment_status") == "paid")
    trips = t.trips.filter(F.col("trip_status").isin("boarding", "full", "departed"))
    ctx = trip_context(t, trips.select("trip_id", "route_id", "assigned_vehicle_id", "driver_id",
                                       "estimated_departure_time", "trip_status"))
    j = b.join(ctx, "trip_id")
    return j.select(
        "booking_id", "ticket_reference", "trip_id",
        full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"),
        "passenger_email", "passenger_phone", "seat_count", "booking_type", "payment_status",
        "total_amount", "booking_date", "estimated_departure_time", "trip_status", "origin",
        "destination", "plate_number", "driver_name")


def queue_status(t: Tables, *also: str) -> DataFrame:
    """view_queue_status: live trips with route, vehicle and driver (and columns ``also``)."""
    trips = t.trips.filter(F.col("trip_status").isin(*LIVE_TRIP))
    return trip_context(t, trips).select(
        "route_id", "origin", "destination", "trip_id", "queue_position", "trip_status",
        "is_accepting_bookings", "estimated_departure_time", "seats_booked", "seats_available",
        "capacity", "plate_number", "vehicle_type", "driver_name", *also)


def payments_with_context(t: Tables, payments: DataFrame) -> DataFrame:
    """Payments joined to their bookings, aggregated per (booking, payment day),
    then joined to trips -> routes.

    A booking's destination and type are fixed, so each (booking, day) pair
    falls in exactly one report group: COUNT(DISTINCT booking_id) becomes a
    plain count of pairs and no distinct-aggregate expansion is needed. The join
    comes first: it clusters by booking, so the aggregate needs no shuffle of its
    own, and the days' payments can prune the bookings by a Bloom filter.
    """
    p = payments.select("booking_id", F.to_date("payment_datetime").alias("payment_date"), "amount")
    b = t.bookings.select("booking_id", F.col("trip_id").alias("_btrip"), "seat_count", "booking_type")
    per_booking_day = p.join(b, "booking_id").groupBy("booking_id", "payment_date", "_btrip", "seat_count", "booking_type").agg(
        F.count(F.lit(1)).alias("n_payments"), F.sum("amount").alias("amount_sum"))
    tr = t.trips.select(F.col("trip_id").alias("_ttrip"), "route_id")
    r = t.routes.select("route_id", "destination")
    return (per_booking_day.join(tr, F.col("_btrip") == F.col("_ttrip"))
            .join(r, "route_id"))


def revenue_groups(ctx: DataFrame, with_avg: bool) -> DataFrame:
    aggs = [F.count(F.lit(1)).cast("bigint").alias("total_bookings"),
            F.sum(F.col("seat_count") * F.col("n_payments")).cast("bigint").alias("total_seats_sold"),
            money(F.sum("amount_sum")).alias("total_revenue")]
    if with_avg:
        aggs.append(F.round(F.sum("amount_sum").cast("double") / F.sum("n_payments"), 4)
                    .alias("average_transaction"))
    out = ctx.groupBy("payment_date", "destination", "booking_type").agg(*aggs)
    cols = ["payment_date", "destination", "total_bookings", "total_seats_sold", "total_revenue"]
    if with_avg:
        cols.append("average_transaction")
    return out.select(*cols, "booking_type")


def daily_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    """view_daily_revenue for ``as_of`` (CURDATE() made a parameter)."""
    p = t.payment_log.filter(on_day(F.col("payment_datetime"), as_of))
    return revenue_groups(payments_with_context(t, p), with_avg=False)


def driver_performance(t: Tables, as_of: dt.date) -> DataFrame:
    """view_driver_performance: every driver with details, trips departed on ``as_of``.

    Trips are counted per driver before the join (pre-aggregation), so the
    join is drivers x small aggregate rather than drivers x trips.
    """
    today = (t.trips.filter(on_day(F.col("actual_departure_datetime"), as_of))
             .groupBy("driver_id").agg(F.count("trip_id").alias("trips_today")))
    u = t.users.filter(F.col("role") == "driver")
    dd = t.driver_details
    j = (u.join(dd, u.user_id == dd.driver_id)
         .join(today, u.user_id == today.driver_id, "left"))
    return j.select(
        "user_id", full_name("firstname", "lastname").alias("driver_name"), "email",
        "phone_number", "license_number", "trips_completed", "total_distance_driven",
        "delayed_trips", "driver_status",
        F.coalesce(F.col("trips_today"), F.lit(0)).cast("bigint").alias("trips_today"))


def register_views(t: Tables, as_of: dt.date) -> None:
    active_bookings(t).createOrReplaceTempView("view_active_bookings")
    daily_revenue(t, as_of).createOrReplaceTempView("view_daily_revenue")
    driver_performance(t, as_of).createOrReplaceTempView("view_driver_performance")
    queue_status(t).createOrReplaceTempView("view_queue_status")
