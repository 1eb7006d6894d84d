"""Projections, filters and key lookups, in bulk form.

The reference answers one id or search term per request. Here a lookup takes
a request DataFrame of keys and answers all of them in one join; passing a
single-row request gives back the per-id answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Column, Window

from terminus.functions.scalar import (VEHICLE_STATUSES, VEHICLE_TYPES, ci_contains, enum_ordinal,
                                       folded, full_name, like_literal, like_parts, unaccented)
from terminus.plans import views
from terminus.session import written
from terminus.sources.tables import Tables

USER_COLUMNS = ["user_id", "firstname", "lastname", "email", "phone_number", "role", "status",
                "created_at"]


def users_list(t: Tables, role: str | None = None, status: str | None = None) -> DataFrame:
    """All users without credentials, optional role/status terms, newest first."""
    u = t.users
    if role is not None:
        u = u.filter(F.col("role") == role)
    if status is not None:
        u = u.filter(F.col("status") == status)
    return u.select(*USER_COLUMNS).orderBy(F.col("created_at").desc(), F.col("user_id").desc())


DRIVER_DETAIL_COLUMNS = ["license_number", "trips_completed", "total_distance_driven",
                         "delayed_trips", "driver_status"]


def user_profile(t: Tables, nested: bool = False) -> DataFrame:
    """Every user; drivers carry their driver_details (NULL for other roles).

    ``nested=True`` returns them as one ``driver_details`` struct column, as the
    reference's JSON does; the default flattens them to ``dd_*`` columns.
    """
    dd = t.driver_details
    j = t.users.join(dd, t.users.user_id == dd.driver_id, "left")
    is_driver = F.col("role") == "driver"
    if nested:
        s = F.when(is_driver & F.col("driver_id").isNotNull(),
                   F.struct(*[F.col(c) for c in ["driver_id"] + DRIVER_DETAIL_COLUMNS]))
        return j.select(*USER_COLUMNS, s.alias("driver_details"))
    return j.select(*USER_COLUMNS, *[F.when(is_driver, F.col(c)).alias("dd_" + c)
                                     for c in DRIVER_DETAIL_COLUMNS])


def routes_all(t: Tables) -> DataFrame:
    return t.routes.orderBy("destination", "route_id")


def routes_active(t: Tables) -> DataFrame:
    return (t.routes.filter(F.col("status") == "active")
            .select("route_id", "origin", "destination", "distance_km",
                    "estimated_duration_minutes", "fare_price", "status")
            .orderBy("destination", "route_id"))


def vehicles_all(t: Tables) -> DataFrame:
    return t.vehicles.orderBy("plate_number", "vehicle_id")


def vehicles_available(t: Tables) -> DataFrame:
    """Vehicles available or in maintenance, sorted by ENUM position of status
    and type (not by their text), then plate."""
    v = t.vehicles.filter(F.col("vehicle_status").isin("available", "maintenance"))
    return (v.select("vehicle_id", "plate_number", "make", "model", "year", "vehicle_type",
                     "capacity", "vehicle_status", "last_maintenance_date")
            .orderBy(enum_ordinal("vehicle_status", VEHICLE_STATUSES),
                     enum_ordinal("vehicle_type", VEHICLE_TYPES), "plate_number", "vehicle_id"))


GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n`` (none when ``text`` is shorter)."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))) \
        .otherwise(F.array().cast("array<string>"))


def bookings_by_name(t: Tables, terms: DataFrame) -> DataFrame:
    """Active bookings whose passenger name matches ``%term%`` (case- and
    accent-insensitive, wildcards and escapes as LIKE has them), for every term
    of ``terms(term)`` at once.

    Exact candidate join instead of testing every (booking, term) pair: every run
    of literal characters of a term occurs in a matching name, so a term is joined
    (equi-join) with the names that contain its rarest gram: three characters of
    a run, or the whole run if it is shorter. Grams are taken from the distinct
    names of paid bookings, folded once each, in the lengths that the terms ask for,
    and only kept if some term asks for them. A term of wildcards alone asks for the
    empty gram, which all names have. Candidates are checked with the real LIKE;
    bookings join the names that match.
    """
    passengers = t.bookings.filter(F.col("payment_status") == "paid").select(
        "booking_id", full_name("passenger_firstname", "passenger_lastname").alias("_name")).filter("_name is not null")
    names = written(passengers.select("_name").distinct().withColumn("_low", unaccented("_name")))
    runs = F.transform(F.filter(F.split(like_parts(F.col("term")), "[%_]"), lambda x: F.length(x) > 0), like_literal)
    tl = terms.select("term").distinct().withColumn("_runs", runs)
    per_run = F.flatten(F.transform("_runs", lambda r: F.when(F.length(r) < GRAM, F.array(r)).otherwise(_grams(r, GRAM))))
    asked = tl.select("term", F.explode(F.when(F.size("_runs") > 0, F.array_distinct(per_run))
                                        .otherwise(F.array(F.lit("")))).alias("_g"))
    wanted = asked.select("_g").distinct()
    lengths = sorted(wanted.agg(F.collect_set(F.length("_g"))).first()[0])  # at most GRAM + 1 numbers
    grams = names.select("_name", F.explode(F.concat(*[_grams(F.col("_low"), n) if n else F.array(F.lit("")) for n in lengths or [0]])).alias(
        "_g")).join(wanted, "_g", "left_semi")
    freq = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    pick = (asked.join(freq, "_g", "left").groupBy("term")
            .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_p"))
            .select("term", F.col("_p._g").alias("_g")))
    matching = grams.join(pick, "_g").filter(ci_contains(F.col("_name"), F.col("term"))).select("term", "_name")
    hits = passengers.join(matching, "_name").select("term", "booking_id")
    ab = views.active_bookings(t)
    return hits.join(ab, "booking_id").select("term", *ab.columns)


def bookings_by_email(t: Tables, emails: DataFrame) -> DataFrame:
    """Active bookings for each requested e-mail (``emails(email)``), compared
    under the collation (case, accents, trailing spaces) through an equi-join key."""
    ab = views.active_bookings(t).withColumn("_k", folded("passenger_email"))
    req = emails.select(F.col("email").alias("requested_email")).distinct() \
        .withColumn("_k", folded("requested_email"))
    return req.join(ab, "_k").drop("_k")


def bookings_by_ticket(t: Tables, tickets: DataFrame) -> DataFrame:
    """Active bookings for each requested ticket reference, under the collation."""
    ab = views.active_bookings(t)
    req = tickets.select(folded("ticket_reference").alias("_tr")).distinct()
    return ab.join(req, folded(ab.ticket_reference) == req._tr, "left_semi")


def passenger_contact(t: Tables) -> DataFrame:
    return t.bookings.select(
        "booking_id", full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"),
        "passenger_email", "passenger_phone", "passenger_address")


def trip_bookings(t: Tables) -> DataFrame:
    """Active bookings of every trip with their position in the trip by
    booking time (``booking_seq``); filter ``trip_id`` for one trip."""
    ab = views.active_bookings(t)
    # A trip holds few bookings: a plain window per trip.
    return ab.withColumn("booking_seq", F.row_number().over(
        Window.partitionBy("trip_id").orderBy("booking_date", "booking_id")))
