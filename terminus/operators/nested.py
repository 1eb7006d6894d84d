"""Nested results: arrays of structs built on the executors.

The reference groups rows into one JSON object per route / per trip on the
client. Here the grouping is a distributed ``collect_list`` + ``array_sort``,
cut into pages of at most ``page_size`` elements: a key with more elements
than that gets several rows (``page`` 0, 1, ...), so no array or task holds an
unbounded group. Positions come from the skew-safe ``sequence_within``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terminus.functions.scalar import full_name
from terminus.plans import views
from terminus.plans.ranking import sequence_within
from terminus.sources.tables import Tables

PAGE_SIZE = 1000


def _pages(seq: DataFrame, keys: list[str], element_cols: list[str], page_size: int, out: str,
           *totals: Column) -> DataFrame:
    """Rows numbered by ``_seq`` within ``keys`` -> one row per key and page."""
    seq = (seq.withColumn("page", ((F.col("_seq") - 1) / page_size).cast("int"))
           .withColumn("_seq", F.col("_seq").cast("int")))  # a position in one key's list
    return seq.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_seq").alias("position"), *element_cols))).alias(out), *totals)


def queue_nested(t: Tables, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per route (and page) with its live trips in queue order, and how
    many live trips the route has over all its pages. Routes are few and long, so
    the positions come from the skew-safe numbering."""
    q = views.queue_status(t)
    seq = sequence_within(q, ["route_id"], [F.col("queue_position").asc(), F.col("trip_id").asc()], out="_seq")
    trips = _pages(seq, ["route_id"], [c for c in q.columns if c not in ("origin", "destination")], page_size, "trips")
    totals = q.groupBy("route_id").agg(F.count(F.lit(1)).cast("bigint").alias("route_trips"))
    r = t.routes.select("route_id", "origin", "destination")
    return trips.join(totals, "route_id").join(r, "route_id").select(
        "route_id", "origin", "destination", "route_trips", "page", "trips")


def queue_nested_summary(t: Tables, page_size: int = PAGE_SIZE) -> DataFrame:
    """Checkable flat form of ``queue_nested``: size and end elements per page."""
    n = queue_nested(t, page_size)
    return n.select("route_id", "origin", "destination", "route_trips", "page",
                    F.size("trips").cast("bigint").alias("n_trips"),
                    F.col("trips")[0]["trip_id"].alias("first_trip_id"),
                    F.element_at("trips", -1)["trip_id"].alias("last_trip_id"),
                    F.col("trips")[0]["queue_position"].alias("first_queue_position"),
                    F.element_at("trips", -1)["queue_position"].alias("last_queue_position"))


PASSENGER_COLUMNS = ["booking_id", "ticket_reference", "passenger_name", "passenger_phone",
                     "passenger_email", "passenger_address", "seat_count", "booking_type",
                     "payment_status", "total_amount", "booking_date"]


def trip_manifest(t: Tables, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per trip (and page): trip_info struct, paid passengers in booking
    order, and the manifest totals (seats and bookings). Trips without paid
    bookings keep a row with an empty passenger list."""
    paid = t.bookings.filter(F.col("payment_status") == "paid").withColumn(
        "passenger_name", full_name("passenger_firstname", "passenger_lastname"))
    # A trip's passengers are bounded by its seats: one plain window per trip
    # numbers and totals them, on the buckets if bookings are bucketed by trip.
    of_trip = Window.partitionBy("trip_id")
    seq = (paid.withColumn("_seq", F.row_number().over(of_trip.orderBy("booking_date", "booking_id")))
           .withColumn("_seats", F.sum("seat_count").over(of_trip)).withColumn("_n", F.count(F.lit(1)).over(of_trip)))
    pages = _pages(seq, ["trip_id"], PASSENGER_COLUMNS, page_size, "passengers",
                   F.first("_seats").alias("total_passengers"), F.first("_n").alias("total_bookings"))
    info = views.trip_context(t).select(
        "trip_id", F.struct("trip_id", "estimated_departure_time", "seats_booked", "capacity", "trip_status",
                            "origin", "destination", "plate_number", "vehicle_type", "driver_id",
                            "driver_name").alias("trip_info"))
    j = info.join(pages, "trip_id", "left")
    return j.select(
        "trip_id", F.coalesce("page", F.lit(0)).alias("page"), "trip_info",
        F.coalesce("passengers", F.array().cast(pages.schema["passengers"].dataType)).alias("passengers"),
        F.coalesce("total_passengers", F.lit(0)).cast("bigint").alias("total_passengers"),
        F.coalesce("total_bookings", F.lit(0)).cast("bigint").alias("total_bookings"))


def trip_manifest_exploded(t: Tables, page_size: int = PAGE_SIZE) -> DataFrame:
    """Checkable flat form of ``trip_manifest``: one row per (trip, passenger),
    one row with NULL passenger fields for a trip without paid bookings."""
    m = trip_manifest(t, page_size)
    ex = m.select("trip_id", "trip_info", "total_passengers", "total_bookings",
                  F.explode_outer("passengers").alias("p"))
    return ex.select("trip_id", "trip_info.origin", "trip_info.destination",
                     "trip_info.plate_number", "trip_info.driver_id", "trip_info.driver_name", "trip_info.trip_status",
                     "total_passengers", "total_bookings",
                     F.col("p.position").alias("position"),
                     *[F.col("p." + c).alias(c) for c in PASSENGER_COLUMNS])
