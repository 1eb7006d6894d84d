"""Operational views built from joins, for all keys at once.

Trips are the fact side; routes, vehicles and users are dimensions. No join
here is forced to broadcast: vehicles and users grow with the data, so the
planner (size threshold) and AQE (runtime sizes) choose broadcast or
shuffle. Filters that the reference writes inside a LEFT JOIN's ON clause are
applied to the right side before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.functions.scalar import DRIVER_STATUSES, LIVE_TRIP, enum_ordinal, folded, full_name
from terminus.plans import views
from terminus.sources.tables import Tables


def queue_status(t: Tables) -> DataFrame:
    return views.queue_status(t)


def queue_by_route(t: Tables, route_ids: DataFrame) -> DataFrame:
    """Queue of each requested route (``route_ids(route_id)``)."""
    return views.queue_status(t).join(route_ids.select("route_id").distinct(), "route_id",
                                      "left_semi")


def active_bookings(t: Tables) -> DataFrame:
    return views.active_bookings(t)


def _inner_trip_context(t: Tables, trips: DataFrame) -> DataFrame:
    """trips JOIN routes JOIN vehicles JOIN users: drops trips without an
    existing vehicle or driver, as the reference's inner joins do."""
    r = t.routes.select("route_id", "origin", "destination", "estimated_duration_minutes",
                        F.col("status").alias("route_status"))
    v = t.vehicles.select(F.col("vehicle_id").alias("_vid"), "vehicle_type", "plate_number")
    u = t.users.select(F.col("user_id").alias("_uid"),
                       full_name("firstname", "lastname").alias("driver_name"))
    return (trips.join(r, "route_id").join(v, trips.assigned_vehicle_id == v._vid)
            .join(u, trips.driver_id == u._uid))


AVAILABLE_COLUMNS = ["trip_id", "estimated_departure_time", "seats_available", "capacity",
                     "fare_price", "trip_status", "route_id", "origin", "destination",
                     "estimated_duration_minutes", "vehicle_type", "plate_number", "driver_name"]


def available_trips(t: Tables) -> DataFrame:
    """get_available_trips: accepting boarding/full trips on active routes."""
    tr = t.trips.filter(F.col("is_accepting_bookings") & F.col("trip_status").isin("boarding", "full"))
    j = _inner_trip_context(t, tr).filter(F.col("route_status") == "active")
    return j.select(*AVAILABLE_COLUMNS, "queue_position")


def trip_details(t: Tables) -> DataFrame:
    """Every trip with route, vehicle and driver (vehicle/driver may be NULL)."""
    return views.trip_context(t).select(
        "trip_id", "queue_position", "is_accepting_bookings", "estimated_departure_time",
        "actual_departure_datetime", "capacity", "seats_booked", "seats_available", "trip_status",
        "fare_price", "route_id", "origin", "destination", "distance_km",
        F.col("route_duration_minutes").alias("estimated_duration_minutes"),
        # Ids of the joined rows: NULL where the trip's reference dangles.
        "vehicle_id", "plate_number", "vehicle_type",
        "vehicle_capacity", F.col("driver_user_id").alias("driver_id"), "driver_name", "driver_phone")


def _booking_context(t: Tables, bookings: DataFrame) -> DataFrame:
    ctx = views.trip_context(t).select(
        F.col("trip_id").alias("_tid"), "estimated_departure_time", "actual_departure_datetime",
        "actual_arrival_datetime", "trip_status", F.col("seats_available").alias("trip_seats_available"),
        F.col("capacity").alias("trip_capacity"), "origin", "destination",
        F.col("route_fare_price").alias("route_fare_price"),
        F.col("route_duration_minutes").alias("estimated_duration_minutes"),
        "plate_number", "vehicle_type", "driver_name", "driver_phone")
    return bookings.join(ctx, bookings.trip_id == ctx._tid)


BOOKING_DETAIL_COLUMNS = [
    "booking_id", "ticket_reference", "trip_id", "passenger_name", "passenger_email",
    "passenger_phone", "passenger_address", "seat_count", "booking_type", "payment_status",
    "total_amount", "booking_date", "estimated_departure_time", "trip_status", "origin",
    "destination", "fare_price", "plate_number", "vehicle_type", "driver_name", "driver_phone"]


def booking_details(t: Tables) -> DataFrame:
    """get_booking_details for every booking."""
    b = t.bookings.withColumn("passenger_name",
                              full_name("passenger_firstname", "passenger_lastname"))
    j = _booking_context(t, b).withColumnRenamed("route_fare_price", "fare_price")
    return j.select(*BOOKING_DETAIL_COLUMNS)


def booking_by_ticket_reference(t: Tables, tickets: DataFrame) -> DataFrame:
    """get_booking_by_ticket_reference for each requested reference (any status).

    References are matched on two narrow columns. Bookings and their context meet by
    trip, so a trip of which all or no bookings are asked for is settled there: only
    the whole rows of the other trips are shuffled by reference."""
    req = tickets.select(folded("ticket_reference").alias("_tr")).distinct()
    asked = (t.bookings.select(F.col("trip_id").alias("_at"), folded("ticket_reference").alias("_ref"))
             .join(req, F.col("_ref") == F.col("_tr"), "left")
             .groupBy("_at").agg(F.count(F.lit(1)).alias("_all"), F.count("_tr").alias("_asked")))
    b = t.bookings.withColumn("passenger_name", full_name("passenger_firstname", "passenger_lastname"))
    j = _booking_context(t, b).withColumnRenamed("route_fare_price", "fare_price").select(*BOOKING_DETAIL_COLUMNS)
    of_trip = F.col("trip_id") == F.col("_at")
    whole = j.join(asked.filter("_asked = _all"), of_trip)
    # An inner join with distinct references: a semi-join would be pushed below the others.
    part = j.join(asked.filter("_asked between 1 and _all - 1"), of_trip).join(req, folded("ticket_reference") == F.col("_tr"))
    return whole.select(*BOOKING_DETAIL_COLUMNS).unionByName(part.select(*BOOKING_DETAIL_COLUMNS))


def booking_tracking(t: Tables) -> DataFrame:
    """Passenger-side tracking view: booking with actual times and seats."""
    b = t.bookings.withColumn("passenger_name",
                              full_name("passenger_firstname", "passenger_lastname"))
    j = _booking_context(t, b)
    return j.select(
        "booking_id", "trip_id", "passenger_name", "passenger_email", "passenger_phone",
        "passenger_address", "seat_count", "booking_type", "payment_status", "total_amount",
        "booking_date", "estimated_departure_time", "actual_departure_datetime",
        "actual_arrival_datetime", "trip_status",
        F.col("trip_seats_available").alias("seats_available"),
        F.col("trip_capacity").alias("capacity"), "origin", "destination",
        F.col("route_fare_price").alias("fare_price"), "estimated_duration_minutes",
        "plate_number", "vehicle_type", "driver_name", "driver_phone")


def seat_availability(t: Tables) -> DataFrame:
    """Seat monitor: boarding/full trips with route and plate."""
    tr = t.trips.filter(F.col("trip_status").isin("boarding", "full"))
    ctx = views.trip_context(t, tr)
    return ctx.select("trip_id", "queue_position", "capacity", "seats_booked", "seats_available",
                      "trip_status", "estimated_departure_time", "origin", "destination",
                      "plate_number", "route_id")


def _driver_users(t: Tables) -> DataFrame:
    return _users_with_details(t).filter(F.col("role") == "driver")


def _users_with_details(t: Tables) -> DataFrame:
    return t.users.join(t.driver_details, t.users.user_id == t.driver_details.driver_id)


def drivers_available(t: Tables) -> DataFrame:
    """Active drivers that are available or off duty, by ENUM order then last name."""
    j = _driver_users(t).filter((F.col("status") == "active")
                                & F.col("driver_status").isin("available", "off_duty"))
    return (j.select("user_id", full_name("firstname", "lastname").alias("driver_name"), "email",
                     "phone_number", "license_number", "driver_status", "trips_completed",
                     "total_distance_driven", "lastname")
            .orderBy(enum_ordinal("driver_status", DRIVER_STATUSES), "lastname", "user_id")
            .drop("lastname"))


CURRENT = ("boarding", "full", "departed")


def driver_status(t: Tables) -> DataFrame:
    """Every user with driver details (whatever the role) and each of their
    current (boarding/full/departed) trips; NULL trip columns without one."""
    cur = t.trips.filter(F.col("trip_status").isin(*CURRENT)).select(
        F.col("driver_id").alias("_d"), "trip_id", "trip_status", "route_id")
    r = t.routes.select("route_id", "origin", "destination")
    j = (_users_with_details(t).join(cur, F.col("user_id") == cur._d, "left")
         .join(r, "route_id", "left"))
    return j.select("user_id", full_name("firstname", "lastname").alias("driver_name"),
                    "phone_number", "driver_status", "trips_completed", "trip_id", "trip_status",
                    "origin", "destination")


def vehicle_status(t: Tables) -> DataFrame:
    """Every vehicle with each of its current trips, route and driver name."""
    cur = t.trips.filter(F.col("trip_status").isin(*CURRENT)).select(
        F.col("assigned_vehicle_id").alias("_v"), "trip_id", "trip_status", "route_id", "driver_id")
    r = t.routes.select("route_id", "origin", "destination")
    u = t.users.select(F.col("user_id").alias("_uid"),
                       full_name("firstname", "lastname").alias("driver_name"))
    j = (t.vehicles.join(cur, F.col("vehicle_id") == cur._v, "left")
         .join(r, "route_id", "left").join(u, F.col("driver_id") == u._uid, "left"))
    return j.select("vehicle_id", "plate_number", "vehicle_type", "capacity", "vehicle_status",
                    "trip_id", "trip_status", "origin", "destination", "driver_name")


def driver_contact(t: Tables) -> DataFrame:
    return _driver_users(t).select("user_id", full_name("firstname", "lastname").alias("driver_name"),
                                   "email", "phone_number", "driver_status")


def upcoming_trips(t: Tables) -> DataFrame:
    """Each driver's waiting/boarding/full trips with route and vehicle."""
    tr = t.trips.filter(F.col("trip_status").isin(*LIVE_TRIP) & F.col("driver_id").isNotNull())
    ctx = views.trip_context(t, tr)
    return ctx.select("driver_id", "trip_id", "queue_position", "estimated_departure_time",
                      "capacity", "seats_booked", "seats_available", "trip_status", "origin",
                      "destination", "distance_km",
                      F.col("route_duration_minutes").alias("estimated_duration_minutes"),
                      "plate_number", "vehicle_type")


def system_logs(t: Tables, limit: int = 100, action_type: str | None = None) -> DataFrame:
    """Newest ``limit`` log rows (optionally one action type) with the user's name."""
    lg = t.system_log
    if action_type is not None:
        lg = lg.filter(F.col("action_type") == action_type)
    u = t.users.select(F.col("user_id").alias("_uid"),
                       full_name("firstname", "lastname").alias("user_name"),
                       F.col("role").alias("user_role"))
    top = lg.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(limit)
    return (top.join(u, top.user_id == u._uid, "left")
            .select("log_id", "action_type", "description", "ip_address", "created_at",
                    "user_name", "user_role"))


def trips_unassigned(t: Tables) -> DataFrame:
    """Live trips that the inner-join views drop: no existing vehicle or driver."""
    live = t.trips.filter(F.col("trip_status").isin(*LIVE_TRIP))
    assigned = _inner_trip_context(t, live.select("trip_id", "route_id", "assigned_vehicle_id",
                                                  "driver_id")).select(F.col("trip_id").alias("_t"))
    q = views.queue_status(t)
    return q.join(assigned, q.trip_id == assigned._t, "left_anti")
