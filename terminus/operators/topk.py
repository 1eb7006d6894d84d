"""Sorts, limits and top-k.

A global ``ORDER BY .. LIMIT k`` stays ``orderBy().limit()`` (planned as
TakeOrderedAndProject: each task keeps its own k best rows). The reference's
per-id ``LIMIT k`` becomes a top-k per key: ``min(struct)`` for k = 1 (an
aggregate with map-side partial results) and ``row_number() <= k`` for larger
k (a partial WindowGroupLimit runs before the shuffle). Either way a hot key
sends at most k rows per map task. The primary key is always the last sort
key, because the reference leaves ties open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.functions.scalar import DRIVEN_TRIP, full_name, minutes_between
from terminus.plans import views
from terminus.plans.ranking import top_k_within
from terminus.sources.tables import Tables


def recent_active_bookings(t: Tables, k: int = 10) -> DataFrame:
    ab = views.active_bookings(t)
    return ab.orderBy(F.col("booking_date").desc(), F.col("booking_id").desc()).limit(k)


def recent_bookings_feed(t: Tables, k: int = 20) -> DataFrame:
    """Newest paid bookings on boarding/full trips (the live booking monitor)."""
    b = t.bookings.filter(F.col("payment_status") == "paid").select(
        "booking_id", "ticket_reference",
        full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"),
        "seat_count", "booking_type", "total_amount", "booking_date", F.col("trip_id").alias("_bt"))
    tr = t.trips.filter(F.col("trip_status").isin("boarding", "full")).select(
        "trip_id", "route_id", "estimated_departure_time", "seats_available")
    r = t.routes.select("route_id", "destination")
    j = b.join(tr, b._bt == tr.trip_id).join(r, "route_id")
    return (j.select("booking_id", "ticket_reference", "passenger_name", "seat_count",
                     "booking_type", "total_amount", "booking_date", "trip_id", "destination",
                     "estimated_departure_time", "seats_available")
            .orderBy(F.col("booking_date").desc(), F.col("booking_id").desc()).limit(k))


def cancellation_history(t: Tables, k: int = 50) -> DataFrame:
    b = t.bookings.filter(F.col("payment_status") == "cancelled")
    top = b.orderBy(F.col("updated_at").desc(), F.col("booking_id").desc()).limit(k)
    tr = t.trips.select(F.col("trip_id").alias("_t"), "route_id", "estimated_departure_time")
    r = t.routes.select("route_id", "origin", "destination")
    j = top.join(tr, top.trip_id == tr._t).join(r, "route_id")
    return j.select("booking_id", "ticket_reference",
                    full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"),
                    "passenger_email", "passenger_phone", "seat_count", "total_amount",
                    "booking_date", F.col("updated_at").alias("cancellation_date"), "trip_id",
                    "origin", "destination", "estimated_departure_time")


def latest_payment(t: Tables) -> DataFrame:
    """Latest payment of every booking (payment status verification)."""
    p = t.payment_log
    last = p.groupBy("booking_id").agg(F.max(F.struct(
        "payment_datetime", "payment_id", "amount", "payment_method",
        "payment_reference")).alias("p"))
    b = t.bookings.select("booking_id", "payment_status", "ticket_reference",
                          full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"))
    return last.join(b, "booking_id").select(
        "p.payment_id", "booking_id", "p.amount", "p.payment_method", "p.payment_reference",
        "p.payment_datetime", "payment_status", "ticket_reference", "passenger_name")


NEXT_TRIP_COLUMNS = ["trip_id", "estimated_departure_time", "seats_available", "capacity",
                     "fare_price", "trip_status", "queue_position", "origin", "destination",
                     "estimated_duration_minutes", "vehicle_type", "plate_number", "driver_name"]


def next_trip(t: Tables) -> DataFrame:
    """For every active route: the boarding, accepting trip with the lowest
    queue position among those with an existing vehicle and driver."""
    from terminus.operators.joins import _inner_trip_context
    tr = t.trips.filter(F.col("is_accepting_bookings") & (F.col("trip_status") == "boarding"))
    j = _inner_trip_context(t, tr).filter(F.col("route_status") == "active")
    best = j.groupBy("route_id").agg(F.min(F.struct(
        "queue_position", *[c for c in NEXT_TRIP_COLUMNS if c != "queue_position"])).alias("b"))
    return best.select("route_id", *[F.col("b." + c).alias(c) for c in NEXT_TRIP_COLUMNS])


MAX_SEATS_PER_REQUEST = 10  # fixed value: request validation allows 1..10 seats


def smart_trip_candidate(t: Tables, max_seats: int = MAX_SEATS_PER_REQUEST) -> DataFrame:
    """For every route and every seat count n in 1..max_seats: the first boarding,
    accepting trip by queue position with at least n free seats (the trip
    smart_booking would pick). Each trip is expanded to the n it can serve
    (at most ``max_seats`` rows), then one partial aggregate picks the best."""
    tr = t.trips.filter(F.col("is_accepting_bookings") & (F.col("trip_status") == "boarding")
                        & (F.col("seats_available") >= 1))
    ex = tr.select("route_id", "trip_id", "queue_position", "seats_available",
                   F.explode(F.sequence(F.lit(1), F.least(F.col("seats_available"),
                                                          F.lit(max_seats)))).alias("seats_requested"))
    best = ex.groupBy("route_id", "seats_requested").agg(
        F.min(F.struct("queue_position", "trip_id", "seats_available")).alias("b"))
    return best.select("route_id", F.col("seats_requested").cast("int").alias("seats_requested"),
                       "b.trip_id", "b.queue_position", "b.seats_available")


def current_trip(t: Tables) -> DataFrame:
    """Each driver's earliest waiting/boarding/full/departed trip."""
    tr = t.trips.filter(F.col("trip_status").isin("waiting", "boarding", "full", "departed")
                        & F.col("driver_id").isNotNull())
    # Earliest estimated departure (NULL first, as ASC sorts it), then trip id.
    key = F.struct(F.col("estimated_departure_time").isNotNull().alias("_nn"),
                   "estimated_departure_time", "trip_id")
    first = tr.groupBy("driver_id").agg(F.min(key).alias("k")).select(
        "driver_id", F.col("k.trip_id").alias("trip_id"))
    ctx = views.trip_context(t, t.trips.join(first.select("trip_id"), "trip_id", "left_semi"))
    return ctx.select(
        "driver_id", "trip_id", "queue_position", "estimated_departure_time",
        "actual_departure_datetime", "capacity", "seats_booked", "seats_available", "trip_status",
        "fare_price", "estimated_trip_duration_minutes", "route_id", "origin", "destination",
        "distance_km", "vehicle_id", "plate_number",
        "vehicle_type", "make", "model")


def trip_history(t: Tables, k: int = 20) -> DataFrame:
    """Last ``k`` driven trips per driver, with the actual duration in minutes."""
    tr = t.trips.filter(F.col("trip_status").isin(*DRIVEN_TRIP) & F.col("driver_id").isNotNull())
    top = top_k_within(tr, ["driver_id"], [F.col("actual_departure_datetime").desc_nulls_last(),
                                           F.col("trip_id").desc()], k, out="history_rank")
    ctx = views.trip_context(t, top)
    return ctx.select(
        "driver_id", "history_rank", "trip_id", "actual_departure_datetime",
        "actual_arrival_datetime", "trip_status", "seats_booked", "capacity", "fare_price",
        "origin", "destination", "distance_km", "plate_number", "vehicle_type",
        minutes_between(F.col("actual_departure_datetime"), F.col("actual_arrival_datetime"))
        .cast("bigint").alias("actual_duration_minutes"))


def driver_assignment_history(t: Tables, k: int = 10) -> DataFrame:
    tr = t.trips.filter(F.col("driver_id").isNotNull())
    top = top_k_within(tr, ["driver_id"], [F.col("actual_departure_datetime").desc_nulls_last(),
                                           F.col("trip_id").desc()], k, out="history_rank")
    ctx = views.trip_context(t, top)
    return ctx.select("driver_id", "history_rank", "trip_id", "actual_departure_datetime",
                      "actual_arrival_datetime", "trip_status", "seats_booked", "origin",
                      "destination", "plate_number")


def vehicle_assignment_history(t: Tables, k: int = 10) -> DataFrame:
    tr = t.trips.filter(F.col("assigned_vehicle_id").isNotNull())
    top = top_k_within(tr, ["assigned_vehicle_id"],
                       [F.col("actual_departure_datetime").desc_nulls_last(), F.col("trip_id").desc()],
                       k, out="history_rank")
    ctx = views.trip_context(t, top)
    return ctx.select(F.col("assigned_vehicle_id").alias("vehicle_id"), "history_rank", "trip_id",
                      "actual_departure_datetime", "actual_arrival_datetime", "trip_status",
                      "seats_booked", "origin", "destination", "driver_name")


def notification_inbox(t: Tables, k: int = 20) -> DataFrame:
    """Last ``k`` notifications of every user with creator name and read flag."""
    n = t.notifications
    un = t.user_notifications
    u = t.users.select(F.col("user_id").alias("_cid"),
                       full_name("firstname", "lastname").alias("created_by"))
    j = (un.join(n, "notification_id").join(u, n.creator_id == u._cid))
    top = top_k_within(j, ["user_id"], [F.col("created_at").desc(),
                                        F.col("notification_id").desc()], k, out="inbox_rank")
    return top.select("user_id", "inbox_rank", "notification_id", "title", "body", "created_at",
                      "is_read", "read_at", "created_by")
