"""Request and change inputs for the bulk lookups and lifecycle jobs.

All of them are derived by Spark from the domain tables (FIXTURES.md "Request
and change inputs"), so their size grows with the data. The matching DuckDB
text is in ``terminus.oracle.requests``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terminus.sources.tables import Tables

# The passenger-name search terms of the fixture (FIXTURES.md).
NAME_TERMS = ["customer#00000012", "FURN", "%99%"]


def name_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in NAME_TERMS], "term string")


def email_requests(t: Tables) -> DataFrame:
    """Every user's e-mail, as the set of addresses searched for."""
    return t.users.select("email")


def ticket_requests(t: Tables) -> DataFrame:
    """Every issued ticket reference."""
    return t.bookings.select("ticket_reference")


def active_route_ids(t: Tables) -> DataFrame:
    return t.routes.filter(F.col("status") == "active").select("route_id")


# ------------------------------------------------------------------ lifecycle
def seat_requests(t: Tables) -> DataFrame:
    """What seat admission reads of ``booking_requests``. A payment adds nothing to
    it but copies of a request, which admission tells by their id."""
    b = t.bookings
    return b.join(t.trips.select(F.col("trip_id").alias("_t")), b.trip_id == F.col("_t")).select(
        F.col("booking_id").alias("request_id"), "trip_id", "seat_count", F.col("booking_date").alias("requested_at"))


def booking_requests(t: Tables) -> DataFrame:
    """Every booking replayed as a create-booking request (request_id =
    booking_id, requested at its booking time, payment fields from its first
    payment row; pending bookings have none)."""
    b = t.bookings
    tr = t.trips.select(F.col("trip_id").alias("_t"), "route_id")
    p = t.payment_log.select(F.col("payment_id").alias("_pid"), "payment_method", "payment_reference")
    j = (b.join(tr, b.trip_id == tr._t)
         .join(p, (b.booking_id * 10) == p._pid, "left"))
    return j.select(
        F.col("booking_id").alias("request_id"), "trip_id", "route_id",
        F.col("passenger_firstname").alias("firstname"), F.col("passenger_lastname").alias("lastname"),
        F.col("passenger_email").alias("email"), F.col("passenger_phone").alias("phone"),
        F.col("passenger_address").alias("address"), "seat_count", "booking_type", "payment_method",
        "payment_reference", F.col("booking_date").alias("requested_at"))


def empty_trips(t: Tables) -> DataFrame:
    """The trips snapshot with no seats booked: the state the replayed
    booking requests are admitted against."""
    return (t.trips.withColumn("seats_booked", F.lit(0))
            .withColumn("seats_available", F.col("capacity")))


def booking_changes(t: Tables) -> DataFrame:
    """Change feed of bookings: an insert per booking (as paid, or pending) at
    its booking time, and for cancelled / refunded bookings a paid -> final
    status change at their update time."""
    ins = F.struct((F.col("booking_id") * 10).alias("event_id"), F.lit(None).cast("string").alias("old_status"),
                   F.when(F.col("payment_status") == "pending", "pending").otherwise("paid").alias("new_status"), F.col("booking_date").alias("ts"))
    chg = F.struct((F.col("booking_id") * 10 + 1).alias("event_id"), F.lit("paid").alias("old_status"), F.col("payment_status").alias("new_status"),
                   F.col("updated_at").alias("ts"))
    # Both events of a booking from one pass over the bookings.
    events = F.when(F.col("payment_status").isin("cancelled", "refunded"), F.array(ins, chg)).otherwise(F.array(ins))
    return t.bookings.select("booking_id", "trip_id", "seat_count", F.explode(events).alias("_e")).select(
        "_e.event_id", "booking_id", "trip_id", "_e.old_status", "_e.new_status", "seat_count", "_e.ts")


def cancel_requests(t: Tables) -> DataFrame:
    """Cancel every booking of a cancelled trip (whatever the booking's status),
    plus one request for a booking id that does not exist."""
    ct = t.trips.filter(F.col("trip_status") == "cancelled").select(F.col("trip_id").alias("_t"))
    b = t.bookings.join(ct, t.bookings.trip_id == ct._t, "left_semi")
    req = b.select(F.col("booking_id").alias("request_id"), "booking_id",
                   F.col("updated_at").alias("ts"))
    unknown = t.routes.agg(F.lit(-1).cast("bigint").alias("request_id"),
                           F.lit(-1).cast("bigint").alias("booking_id"),
                           F.max(F.lit(None).cast("timestamp_ntz")).alias("ts"))
    return req.unionByName(unknown)


def departures(t: Tables, now_ts) -> DataFrame:
    """The head (position 1) of every route's live queue departs at ``now``."""
    return (t.trips.filter(F.col("trip_status").isin("waiting", "boarding", "full")
                           & (F.col("queue_position") == 1))
            .select("trip_id", F.lit(str(now_ts)).cast("timestamp_ntz").alias("ts")))


def arrivals(t: Tables) -> DataFrame:
    """Arrival reports for every departed or arrived trip by its recorded
    driver (arrived ones are rejected as not departed), plus one unknown trip."""
    tr = t.trips.filter(F.col("trip_status").isin("departed", "arrived"))
    rep = tr.select("trip_id", "driver_id",
                    F.coalesce("actual_arrival_datetime",
                               F.timestamp_add("MINUTE", F.col("estimated_trip_duration_minutes"),
                                               F.col("actual_departure_datetime"))).alias("ts"))
    unknown = t.routes.agg(F.lit(-1).cast("bigint").alias("trip_id"),
                           F.lit(-1).cast("bigint").alias("driver_id"),
                           F.max(F.lit(None).cast("timestamp_ntz")).alias("ts"))
    return rep.unionByName(unknown)


def new_trips(t: Tables) -> DataFrame:
    """Every waiting trip re-submitted to the queue."""
    return (t.trips.filter(F.col("trip_status") == "waiting")
            .select(F.col("trip_id").alias("request_id"), "route_id",
                    F.col("assigned_vehicle_id").alias("vehicle_id"), "driver_id",
                    F.col("estimated_departure_time").alias("estimated_departure")))


def reassignments(t: Tables) -> DataFrame:
    """For every waiting trip: move it to the next vehicle id and the next
    driver id (ids past the last one do not exist and are rejected)."""
    return (t.trips.filter(F.col("trip_status") == "waiting")
            .select("trip_id",
                    (F.coalesce("assigned_vehicle_id", F.lit(0)) + 1).cast("bigint").alias("vehicle_id"),
                    (F.coalesce("driver_id", F.lit(0)) + 1).cast("bigint").alias("driver_id")))


def reassignment_sequence(t: Tables) -> DataFrame:
    """Three requests for every waiting trip, one after the other: to the next
    vehicle and driver id, to those after them, and to ids that do not exist."""
    r = reassignments(t)
    step = lambda k, v, d: r.select((F.col("trip_id") * 3 + k).alias("request_id"), "trip_id", v.alias("vehicle_id"), d.alias("driver_id"))
    return (step(0, F.col("vehicle_id"), F.col("driver_id")).unionByName(step(1, F.col("vehicle_id") + 1, F.col("driver_id") + 1))
            .unionByName(step(2, F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))))


def read_marks(t: Tables) -> DataFrame:
    """Every unread notification is opened one day after it was created."""
    un = t.user_notifications.filter(~F.col("is_read"))
    n = t.notifications.select("notification_id", "created_at")
    return (un.join(n, "notification_id")
            .select("user_id", "notification_id",
                    F.timestamp_add("DAY", F.lit(1), F.col("created_at")).alias("ts")))


def status_events(t: Tables) -> DataFrame:
    """Trip status changes: boarding -> departed at the actual departure,
    departed -> arrived at the actual arrival."""
    tr = t.trips.filter(F.col("trip_status").isin("departed", "arrived"))
    cols = ["trip_id", "driver_id", F.col("assigned_vehicle_id").alias("vehicle_id"), "route_id"]
    dep = tr.select((F.col("trip_id") * 10 + 1).alias("event_id"), *cols,
                    F.lit("boarding").alias("old_status"), F.lit("departed").alias("new_status"),
                    F.col("actual_departure_datetime").alias("ts"))
    arr = (tr.filter(F.col("trip_status") == "arrived")
           .select((F.col("trip_id") * 10 + 2).alias("event_id"), *cols,
                   F.lit("departed").alias("old_status"), F.lit("arrived").alias("new_status"),
                   F.col("actual_arrival_datetime").alias("ts")))
    return dep.unionByName(arr)


def registrations(t: Tables) -> DataFrame:
    """One sign-up per booking: walk-in passengers sign up with the address
    already on file (rejected as existing), online passengers with the same
    mailbox on example.net (the first of them per address is new)."""
    b = t.bookings
    email = F.when(F.col("booking_type") == "online",
                   F.regexp_replace("passenger_email", "@example\\.org$", "@example.net")) \
        .otherwise(F.col("passenger_email"))
    return b.select(F.col("booking_id").alias("request_id"),
                    F.col("passenger_firstname").alias("firstname"),
                    F.col("passenger_lastname").alias("lastname"), email.alias("email"),
                    F.col("passenger_phone").alias("phone_number"),
                    F.lit(None).cast("string").alias("role"))


def trip_snapshots(t: Tables) -> DataFrame:
    """Consecutive status snapshots of driven trips: boarding at the planned
    departure, then one snapshot per status change (seq breaks time ties)."""
    tr = t.trips.filter(F.col("trip_status").isin("departed", "arrived"))
    start = tr.select("trip_id", F.lit("boarding").alias("trip_status"),
                      F.col("estimated_departure_time").alias("ts"), F.lit(0).alias("seq"))
    ev = status_events(t).select("trip_id", F.col("new_status").alias("trip_status"), "ts",
                                 (F.col("event_id") % 10).cast("int").alias("seq"))
    return start.unionByName(ev)


# -------------------------------------------------------------- admin writes
def _next(df: DataFrame, key: str, col: str) -> DataFrame:
    """``df`` with ``_next``: ``col`` of the row whose key is one higher."""
    other = df.select((F.col(key) - 1).alias("_nk"), F.col(col).alias("_next"))
    return df.join(other, F.col(key) == F.col("_nk"), "left").drop("_nk")


def user_updates(t: Tables) -> DataFrame:
    """Every user renamed and moved to a new address; every third asks for the
    next user's address, every seventh pair asks for one new address; one
    unknown user."""
    u = _next(t.users, "user_id", "email")
    email = (F.when(F.col("user_id") % 3 == 0, F.coalesce("_next", "email"))
             .when(F.col("user_id") % 7 < 2, F.concat(F.lit("shared"), F.floor(F.col("user_id") / 7).cast("string"), F.lit("@example.net")))
             .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.net"))))
    known = u.select(F.col("user_id").alias("request_id"), "user_id", F.upper("firstname").alias("firstname"), "lastname",
                     email.alias("email"), "phone_number", "role", F.lit("inactive").alias("status"))
    gone = known.limit(0)
    unknown = t.routes.agg(*[(F.lit(-1).cast("bigint") if c.endswith("_id") else F.max(F.lit(None).cast("string"))).alias(c)
                             for c in gone.columns])
    return known.unionByName(unknown)


def route_updates(t: Tables) -> DataFrame:
    """Every route with a higher fare, and a second request for it that comes too late."""
    r = t.routes
    one = r.select(F.col("route_id").alias("request_id"), "route_id", "origin", "destination", "distance_km",
                   "estimated_duration_minutes", (F.col("fare_price") + 5).cast("decimal(8,2)").alias("fare_price"), "status")
    return one.unionByName(one.withColumn("request_id", F.col("request_id") + 1_000_000))


def vehicle_updates(t: Tables) -> DataFrame:
    """Every vehicle with one more seat; every fourth asks for the next one's plate in lower case."""
    v = _next(t.vehicles, "vehicle_id", "plate_number")
    plate = F.when(F.col("vehicle_id") % 4 == 0, F.lower(F.coalesce("_next", "plate_number"))).otherwise(F.col("plate_number"))
    return v.select(F.col("vehicle_id").alias("request_id"), "vehicle_id", plate.alias("plate_number"), "make", "model",
                    "year", "vehicle_type", (F.col("capacity") + 1).cast("int").alias("capacity"), "vehicle_status",
                    "last_maintenance_date")


def _handovers(df: DataFrame, key: str, col: str) -> DataFrame:
    """A batch in which ``col`` changes hands, from the highest key down: every row
    asks for the value of the row above, which has just left it (the last of ten
    moves to a new one); after every fifth, a new row asks for what that one had,
    so the row below finds it taken; every third asks again, for the value of the
    first of its ten. ``request_id, key`` (null: a row to be created), ``col``, and
    the row it stems from as ``_of``."""
    h = _next(df.select(key, col), key, col)
    first = df.select(F.col(key).alias("_fk"), F.col(col).alias("_first"))
    ten = F.floor(F.col(key) / 10)
    h = h.join(first, ten * 10 == F.col("_fk"), "left")
    turn = 4 * (F.lit(1_000_000_000) - F.col(key))
    moved = F.concat(F.lit("moved-"), F.col(key).cast("string"))
    parts = [
        h.select(turn.alias("request_id"), key, F.when(F.col(key) % 10 == 9, moved).otherwise(F.coalesce("_next", moved)).alias(col),
                 F.col(key).alias("_of")),
        h.filter(F.col(key) % 5 == 0).select((turn + 1).alias("request_id"), F.lit(None).cast("bigint").alias(key), F.lower(col).alias(col),
                                            F.col(key).alias("_of")),
        h.filter(F.col(key) % 3 == 0).select((turn + 2).alias("request_id"), key, F.coalesce(
            "_first", F.concat(F.lit("none-"), ten.cast("string"))).alias(col), F.col(key).alias("_of"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vehicle_batch(t: Tables) -> DataFrame:
    """Updates and creations of vehicles whose plates change hands."""
    v = t.vehicles.select(F.col("vehicle_id").alias("_vk"), "make", "model", "year", "vehicle_type", (F.col("capacity") + 1).alias("capacity"))
    h = _handovers(t.vehicles, "vehicle_id", "plate_number")
    return h.join(v, F.col("_of") == F.col("_vk")).drop("_of", "_vk")


def user_batch(t: Tables) -> DataFrame:
    """Profile updates and sign-ups whose addresses change hands."""
    u = t.users.select(F.col("user_id").alias("_uk"), F.upper("firstname").alias("firstname"), "lastname", "phone_number")
    h = _handovers(t.users, "user_id", "email")
    return h.join(u, F.col("_of") == F.col("_uk")).drop("_of", "_uk")


def new_vehicles(t: Tables) -> DataFrame:
    """For every vehicle a sister vehicle; every fifth keeps the plate (refused), and
    pairs of the others share one new plate."""
    plate = F.when(F.col("vehicle_id") % 5 == 0, F.lower("plate_number")).otherwise(
        F.concat(F.lit("NEW-"), F.floor(F.col("vehicle_id") / 2).cast("string")))
    return t.vehicles.select(F.col("vehicle_id").alias("request_id"), plate.alias("plate_number"), "make", "model",
                             "year", "vehicle_type", "capacity")


def new_routes(t: Tables) -> DataFrame:
    """The way back of every route."""
    return t.routes.select(F.col("route_id").alias("request_id"), F.col("destination").alias("origin"),
                           F.col("origin").alias("destination"), "distance_km", "estimated_duration_minutes", "fare_price")


def route_deletes(t: Tables) -> DataFrame:
    return t.routes.select(F.col("route_id").alias("request_id"), "route_id").unionByName(
        t.routes.agg(F.lit(-1).cast("bigint").alias("request_id"), F.lit(-1).cast("bigint").alias("route_id")))


def vehicle_deletes(t: Tables) -> DataFrame:
    return t.vehicles.select(F.col("vehicle_id").alias("request_id"), "vehicle_id")


def user_deletes(t: Tables) -> DataFrame:
    """Every user, asked for by user 1."""
    return t.users.select(F.col("user_id").alias("request_id"), "user_id", F.lit(1).cast("bigint").alias("requested_by"))


def validation_requests(t: Tables, kind: str) -> DataFrame:
    """Requests of each validated kind, as they would be posted for the tables' rows."""
    none = F.lit(None).cast("string")
    if kind in ("walk_in_booking", "passenger_booking", "booking_for_trip"):
        return booking_requests(t)
    if kind == "create_trip":
        return new_trips(t)
    if kind in ("reassign_vehicle", "reassign_driver"):
        return reassignments(t)
    if kind in ("user_update", "user_status"):
        return user_updates(t)
    if kind in ("route", "route_update"):
        return t.routes
    if kind in ("vehicle", "vehicle_update"):
        return t.vehicles
    if kind == "register":
        return registrations(t).withColumn("password", F.col("phone_number"))
    if kind == "login":
        return t.users.select("email", F.when(F.col("status") == "active", F.col("phone_number")).otherwise(none).alias("password"))
    if kind == "email_parameter":
        return t.users.select("email")
    raise ValueError(kind)
