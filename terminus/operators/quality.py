"""Data-quality jobs.

The reference enforces these row by row (foreign keys, UNIQUE indexes,
generated columns, request validators). Here each rule is a set operation
over whole tables: tagged keys that meet in one aggregate for foreign keys,
uniqueness and derived invariants, and array-of-errors columns for request
validation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from terminus.functions.scalar import folded
from terminus.sources.tables import Tables


def _rules(df: DataFrame, table: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """One aggregate pass over ``df`` counting each check; the single result
    row is unpacked into one row per rule."""
    one = df.agg(*[F.count_if(c).cast("bigint").alias(f"c{i}") for i, (_, c) in enumerate(checks)])
    items = [F.struct(F.lit(r).alias("rule"), F.lit(table).alias("table_name"),
                      F.col(f"c{i}").alias("violations")) for i, (r, _) in enumerate(checks)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def _keys(parent: DataFrame, col: str, alias: str) -> DataFrame:
    """Distinct parent keys plus a presence flag, for a left-join probe."""
    return parent.select(F.col(col).alias(alias)).distinct().withColumn(alias + "_hit", F.lit(True))


def _missing(child_col: str, alias: str) -> Column:
    """Child reference set but its parent key absent."""
    return F.col(child_col).isNotNull() & F.col(alias + "_hit").isNull()


# Key spaces of the audit: a parent's keys with the rules that refer to them (the
# rule's place is its counter), or the keys of one UNIQUE rule.
_REFERENCES = {
    "users": (("fk_trips_driver", "trips"), ("fk_user_notifications_user", "user_notifications"),
              ("fk_driver_details_user", "driver_details"), ("fk_notifications_creator", "notifications"),
              ("fk_system_log_user", "system_log")),
    "routes": (("fk_trips_route", "trips"),),
    "vehicles": (("fk_trips_vehicle", "trips"),),
    "bookings": (("fk_payment_log_booking", "payment_log"),),
    "notifications": (("fk_user_notifications_notification", "user_notifications"),),
    "trips": (("fk_payment_log_trip", "payment_log"),),
}
_UNIQUE = {"uq_bookings_ticket_reference": "bookings", "uq_driver_details_license_number": "driver_details",
           "uq_users_email": "users", "uq_vehicles_plate_number": "vehicles",
           "uq_user_notifications_user_notification": "user_notifications"}
_COUNTERS = 5
# Counters of a trip's key beside its reference.
_PAID, _BOOKED, _NEGATIVE, _GENERATED = 1, 2, 3, 4


def _claim(space: str, key: Column | str | None = None, slot: int | None = None, n: Column | None = None, present: bool = False,
           text: Column | None = None, second: Column | str | None = None, when: Column | None = None) -> Column:
    """A tagged key: that it is ``present`` as a parent, or ``n`` more in counter ``slot``."""
    col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    row = F.struct(F.lit(space).alias("space"), col(key).cast("bigint").alias("id"), col(second).cast("bigint").alias("id2"),
                   col(text).cast("string").alias("text"), F.lit(present).alias("present"),
                   F.lit(slot).cast("int").alias("slot"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))
    return row if when is None else F.when(when, row)


def _refers(parent: str, rule: str, key: str) -> Column:
    slot = [r for r, _ in _REFERENCES[parent]].index(rule)
    return _claim(parent, key, slot, when=F.col(key).isNotNull())


def _tagged(df: DataFrame, *claims: Column) -> DataFrame:
    """The claims of each row, from one scan of ``df``."""
    return df.select(F.explode(F.array(*claims)).alias("x")).filter("x is not null").select("x.*")


def integrity_audit(t: Tables) -> DataFrame:
    """One row per rule: foreign keys (11), UNIQUE keys (5) and derived trip /
    booking invariants, with the number of violating rows (or duplicated keys).

    Every table is scanned once and its rows become tagged keys: that a parent
    key is there, that a row refers to one, that a UNIQUE value is taken, that a
    trip has so many paid seats. All tags meet in one aggregate by key, whose
    map-side part also adds up hot keys, and the rules are counted on its groups.
    Only the rule that compares each booking with its trip's fare (and that the
    trip exists) is a join, by which bookings and trips are read a second time; it
    needs no shuffle where both are bucketed by trip. Primary keys are taken to be
    distinct; equal null values of a UNIQUE key count as equal.
    """
    left = F.col("seats_available")
    claims = [
        _tagged(t.users, _claim("users", "user_id", present=True),
                _claim("uq_users_email", slot=0, text=folded("email"))),
        _tagged(t.routes, _claim("routes", "route_id", present=True)),
        _tagged(t.vehicles, _claim("vehicles", "vehicle_id", present=True),
                _claim("uq_vehicles_plate_number", slot=0, text=folded("plate_number"))),
        _tagged(t.driver_details, _refers("users", "fk_driver_details_user", "driver_id"),
                _claim("uq_driver_details_license_number", slot=0, text=folded("license_number"))),
        _tagged(t.trips, _claim("trips", "trip_id", _BOOKED, F.coalesce("seats_booked", F.lit(0)), present=True),
                _claim("trips", "trip_id", _NEGATIVE, when=left < 0),
                _claim("trips", "trip_id", _GENERATED, when=left != F.col("capacity") - F.col("seats_booked")),
                _refers("routes", "fk_trips_route", "route_id"),
                _refers("vehicles", "fk_trips_vehicle", "assigned_vehicle_id"),
                _refers("users", "fk_trips_driver", "driver_id")),
        _tagged(t.bookings, _claim("bookings", "booking_id", present=True),
                _claim("trips", "trip_id", _PAID, F.col("seat_count"),
                       when=F.col("trip_id").isNotNull() & (F.col("payment_status") == "paid")),
                _claim("uq_bookings_ticket_reference", slot=0, text=folded("ticket_reference"))),
        _tagged(t.payment_log, _refers("bookings", "fk_payment_log_booking", "booking_id"),
                _refers("trips", "fk_payment_log_trip", "trip_id")),
        _tagged(t.notifications, _claim("notifications", "notification_id", present=True),
                _refers("users", "fk_notifications_creator", "creator_id")),
        _tagged(t.user_notifications, _refers("users", "fk_user_notifications_user", "user_id"),
                _refers("notifications", "fk_user_notifications_notification", "notification_id"),
                _claim("uq_user_notifications_user_notification", "user_id", 0, second="notification_id")),
        _tagged(t.system_log, _refers("users", "fk_system_log_user", "user_id")),
    ]
    by_key = reduce(DataFrame.unionByName, claims).groupBy("space", "id", "id2", "text").agg(
        F.max("present").alias("present"),
        *[F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(_COUNTERS)])
    of = lambda space: F.col("space") == space
    trip = of("trips") & F.col("present")
    total = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0))
    rules = [(rule, table, total(of(parent) & ~F.col("present"), F.col(f"c{i}")))
             for parent, refs in _REFERENCES.items() for i, (rule, table) in enumerate(refs)]
    rules += [(rule, table, F.count_if(of(rule) & (F.col("c0") > 1))) for rule, table in _UNIQUE.items()]
    rules += [("inv_trip_seats_booked_equals_paid_seats", "trips", F.count_if(trip & (F.col(f"c{_BOOKED}") != F.col(f"c{_PAID}")))),
              ("inv_trip_seats_available_non_negative", "trips", total(trip, F.col(f"c{_NEGATIVE}"))),
              ("inv_trip_seats_available_generated", "trips", total(trip, F.col(f"c{_GENERATED}")))]
    one = by_key.agg(*[c.cast("bigint").alias(f"r{i}") for i, (_, _, c) in enumerate(rules)])
    counted = one.select(F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.col(f"r{i}").alias("violations"))
        for i, (rule, table, _) in enumerate(rules)])).alias("x")).select("x.*")
    fares = t.trips.select(F.col("trip_id").alias("_t"), F.col("fare_price").alias("_fare"), F.lit(True).alias("_t_hit"))
    bookings_rules = _rules(t.bookings.join(fares, F.col("trip_id") == F.col("_t"), "left"), "bookings", [
        ("fk_bookings_trip", _missing("trip_id", "_t")),
        ("inv_booking_amount_equals_fare_times_seats",
         F.col("_t_hit") & (F.col("total_amount") != F.col("_fare") * F.col("seat_count"))),
    ])
    return counted.unionByName(bookings_rules)


def cascade_delete(t: Tables, users: DataFrame, trips: DataFrame, vehicles: DataFrame,
                   routes: DataFrame) -> DataFrame:
    """Effect of deleting the given parent ids (one-column frames of ids):
    rows removed by ON DELETE CASCADE, rows whose reference becomes NULL (SET
    NULL) and trips that keep a route by RESTRICT, as counts per
    (table_name, action). A table's actions are conditional counts over left-join
    probes of the deleted id sets; one that is both child and parent is read once
    per role (trips three times, users twice)."""
    ud = _keys(users, "user_id", "_u")
    td = _keys(trips, "trip_id", "_t")
    vd = _keys(vehicles, "vehicle_id", "_v")
    rd = _keys(routes, "route_id", "_r")
    hit = lambda a: F.col(a + "_hit").isNotNull()

    tr = (t.trips.join(td, F.col("trip_id") == F.col("_t"), "left")
          .join(rd, F.col("route_id") == F.col("_r"), "left")
          .join(vd, F.col("assigned_vehicle_id") == F.col("_v"), "left")
          .join(ud, F.col("driver_id") == F.col("_u"), "left"))
    trips_part = _rules(tr, "trips", [
        ("blocked_by_restrict", hit("_r")),
        ("vehicle_set_null", ~hit("_t") & hit("_v")),
        ("driver_set_null", ~hit("_t") & hit("_u")),
        ("deleted", hit("_t")),
    ])
    blocked = tr.filter(hit("_r")).select(F.col("route_id").alias("_br")).distinct() \
        .withColumn("_br_hit", F.lit(True))
    rt = (t.routes.join(rd, F.col("route_id") == F.col("_r"), "left")
          .join(blocked, F.col("route_id") == F.col("_br"), "left"))
    routes_part = _rules(rt, "routes", [("deleted", hit("_r") & ~hit("_br"))])
    bk = t.bookings.join(td, F.col("trip_id") == F.col("_t"), "left")
    bookings_part = _rules(bk, "bookings", [("deleted", hit("_t"))])
    gone_b = bk.filter(hit("_t")).select(F.col("booking_id").alias("_gb")).withColumn("_gb_hit", F.lit(True))
    pl = (t.payment_log.join(gone_b, F.col("booking_id") == F.col("_gb"), "left")
          .join(td, F.col("trip_id") == F.col("_t"), "left"))
    payments_part = _rules(pl, "payment_log", [("deleted", hit("_gb") | hit("_t"))])
    nt = t.notifications.join(ud, F.col("creator_id") == F.col("_u"), "left")
    notif_part = _rules(nt, "notifications", [("deleted", hit("_u"))])
    gone_n = nt.filter(hit("_u")).select(F.col("notification_id").alias("_gn")).withColumn("_gn_hit", F.lit(True))
    un = (t.user_notifications.join(ud, F.col("user_id") == F.col("_u"), "left")
          .join(gone_n, F.col("notification_id") == F.col("_gn"), "left"))
    un_part = _rules(un, "user_notifications", [("deleted", hit("_u") | hit("_gn"))])
    parts = [
        routes_part, trips_part,
        _rules(t.vehicles.join(vd, F.col("vehicle_id") == F.col("_v"), "left"), "vehicles",
               [("deleted", hit("_v"))]),
        _rules(t.users.join(ud, F.col("user_id") == F.col("_u"), "left"), "users", [("deleted", hit("_u"))]),
        _rules(t.driver_details.join(ud, F.col("driver_id") == F.col("_u"), "left"), "driver_details",
               [("deleted", hit("_u"))]),
        notif_part, un_part,
        _rules(t.system_log.join(ud, F.col("user_id") == F.col("_u"), "left"), "system_log",
               [("user_set_null", hit("_u"))]),
        bookings_part, payments_part,
    ]
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", F.col("rule").alias("action"), F.col("violations").alias("rows"))


# ------------------------------------------------------------------- W19
# The reference's validation chains (field, check, argument,
# message), per request kind, in the order they are declared.
_LOCAL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\u00A1-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF-]+"
EMAIL_PATTERN = (rf"^(?=.{{1,254}}$)(?=[^@]{{1,64}}@){_LOCAL}(\.{_LOCAL})*"
                 r"@([A-Za-z0-9\u00A1-\uFFFF]([A-Za-z0-9\u00A1-\uFFFF-]{0,61}[A-Za-z0-9\u00A1-\uFFFF])?\.)+"
                 r"[A-Za-z\u00A1-\uFFFF]{2,63}$")
ISO8601_PATTERN = (r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
                   r"([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)?)?$")
INT_PATTERN = r"^[-+]?(0|[1-9][0-9]*)$"
FLOAT_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

RULES: dict[str, list[tuple]] = {
    "create_trip": [
        ("route_id", "int", None, "Valid route ID is required"),
        ("vehicle_id", "int", None, "Valid vehicle ID is required"),
        ("driver_id", "int", None, "Valid driver ID is required"),
        ("estimated_departure", "iso8601", None, "Valid departure time is required"),
    ],
    "walk_in_booking": [
        ("trip_id", "int", None, "Valid trip ID is required"),
        ("firstname", "not_empty", None, "First name is required"),
        ("lastname", "not_empty", None, "Last name is required"),
        ("email", "email", None, "Valid email is required"),
        ("phone", "not_empty", None, "Phone number is required"),
        ("address", "not_empty", None, "Address is required"),
        ("seat_count", "int", (1, 10), "Seat count must be between 1 and 10"),
        ("payment_method", "in", ["cash", "gcash", "paymaya", "terminal"], "Invalid payment method"),
        ("payment_reference", "not_empty", None, "Payment reference is required"),
    ],
    "reassign_vehicle": [("vehicle_id", "int", None, "Valid vehicle ID is required")],
    "reassign_driver": [("driver_id", "int", None, "Valid driver ID is required")],
    "passenger_booking": [
        ("route_id", "int", None, "Valid route ID is required"),
        ("firstname", "not_empty", None, "First name is required"),
        ("lastname", "not_empty", None, "Last name is required"),
        ("email", "email", None, "Valid email is required"),
        ("phone", "not_empty", None, "Phone number is required"),
        ("address", "not_empty", None, "Address is required"),
        ("seat_count", "int", (1, 10), "Seat count must be between 1 and 10"),
        ("payment_method", "in", ["cash", "gcash", "paymaya", "online"], "Invalid payment method"),
        ("payment_reference", "not_empty", None, "Payment reference is required"),
    ],
    "user_update": [
        ("firstname", "not_empty", None, "First name is required"),
        ("lastname", "not_empty", None, "Last name is required"),
        ("email", "email", None, "Valid email is required"),
        ("role", "in", ["admin", "dispatcher", "driver", "passenger"], "Invalid role"),
        ("status", "in", ["active", "inactive", "blocked"], "Invalid status"),
    ],
    "user_status": [("status", "in", ["active", "inactive", "blocked"], "Invalid status")],
    "route": [
        ("origin", "not_empty", None, "Origin is required"),
        ("destination", "not_empty", None, "Destination is required"),
        ("distance_km", "float", (0, None), "Valid distance is required"),
        ("estimated_duration_minutes", "int", (1, None), "Valid duration is required"),
        ("fare_price", "float", (0, None), "Valid fare price is required"),
    ],
    "vehicle": [
        ("plate_number", "not_empty", None, "Plate number is required"),
        ("make", "not_empty", None, "Make is required"),
        ("model", "not_empty", None, "Model is required"),
        ("year", "int", (1900, 2100), "Valid year is required"),
        ("vehicle_type", "in", ["van", "mini-bus"], "Invalid vehicle type"),
        ("capacity", "int", (1, None), "Valid capacity is required"),
    ],
    "register": [
        ("firstname", "not_empty", None, "First name is required"),
        ("lastname", "not_empty", None, "Last name is required"),
        ("email", "email", None, "Valid email is required"),
        ("password", "min_length", 6, "Password must be at least 6 characters"),
        ("role", "optional_in", ["admin", "dispatcher", "driver", "passenger"], "Invalid role"),
    ],
}
RULES["booking_for_trip"] = [r for r in RULES["passenger_booking"] if r[0] != "route_id"]
RULES["email_parameter"] = [("email", "email", None, "Valid email is required")]
RULES["login"] = RULES["email_parameter"] + [("password", "some_text", None, "Password is required")]
RULES["route_update"] = RULES["route"] + [("status", "in", ["active", "inactive"], "Invalid status")]
RULES["vehicle_update"] = RULES["vehicle"] + [
    ("vehicle_status", "in", ["available", "in_service", "maintenance", "retired"], "Invalid status")]


def _bounded(v: Column, bounds) -> Column:
    ok = F.lit(True)
    if bounds:
        lo, hi = bounds
        if lo is not None:
            ok = ok & (v >= lo)
        if hi is not None:
            ok = ok & (v <= hi)
    return ok


def rule_ok(df: DataFrame, field: str, kind: str, arg) -> Column:
    """Column that is true when ``field`` passes the check (NULL counts as missing)."""
    c = F.col(field)
    dtype = df.schema[field].dataType
    s = c.cast("string")
    if kind == "int":
        if isinstance(dtype, NumericType):
            v = c
            ok = c.isNotNull() & (c == F.floor(c))
        else:
            ok, v = s.rlike(INT_PATTERN), s.try_cast("decimal(38,0)")  # not trimmed: ' 5 ' is no integer
        return F.coalesce(ok & _bounded(v, arg), F.lit(False))
    if kind == "float":
        if isinstance(dtype, NumericType):
            ok, v = c.isNotNull(), c
        else:
            ok, v = s.rlike(FLOAT_PATTERN), s.try_cast("double")
        return F.coalesce(ok & _bounded(v, arg), F.lit(False))
    if kind == "not_empty":
        return F.coalesce(F.length(F.trim(s)) > 0, F.lit(False))
    if kind == "email":
        return F.coalesce(s.rlike(EMAIL_PATTERN), F.lit(False))
    if kind == "iso8601":
        if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
            return c.isNotNull()
        # A day that the calendar has (no 30 February).
        return F.coalesce(s.rlike(ISO8601_PATTERN) & F.substring(s, 1, 10).try_cast("date").isNotNull(), F.lit(False))
    if kind == "in":
        return F.coalesce(s.isin(*arg), F.lit(False))
    if kind == "optional_in":
        return c.isNull() | s.isin(*arg)
    if kind == "some_text":
        return F.coalesce(F.length(s) > 0, F.lit(False))
    if kind == "min_length":
        return F.coalesce(F.length(s) >= arg, F.lit(False))
    raise ValueError(kind)


def validate_requests(df: DataFrame, kind: str) -> DataFrame:
    """Add ``errors: array<struct<field, msg>>`` (checks that failed, in
    declaration order) and ``valid`` to every request row."""
    rules = RULES[kind]
    errs = F.array(*[F.when(~rule_ok(df, f, k, a), F.struct(F.lit(f).alias("field"), F.lit(m).alias("msg")))
                     for f, k, a, m in rules])
    out = df.withColumn("errors", F.filter(errs, lambda e: e.isNotNull()))
    return out.withColumn("valid", F.size("errors") == 0)


def validation_error_counts(df: DataFrame, kind: str) -> DataFrame:
    """Per rule of ``kind``: how many requests fail it (zero included), plus
    the number of valid requests."""
    checked = validate_requests(df, kind)
    aggs = [F.count_if(~rule_ok(df, f, k, a)).cast("bigint").alias(f"r{i}")
            for i, (f, k, a, m) in enumerate(RULES[kind])]
    aggs.append(F.count_if(F.col("valid")).cast("bigint").alias("valid"))
    one = checked.agg(*aggs)
    rules = RULES[kind]
    items = [F.struct(F.lit(i).alias("rule_no"), F.lit(f).alias("field"), F.lit(m).alias("msg"),
                      F.col(f"r{i}").alias("errors")) for i, (f, k, a, m) in enumerate(rules)]
    items.append(F.struct(F.lit(len(rules)).alias("rule_no"), F.lit("*").alias("field"),
                          F.lit("valid requests").alias("msg"), F.col("valid").alias("errors")))
    # One aggregate pass; the per-rule rows are unpacked from its single row.
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")
