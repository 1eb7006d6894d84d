"""Aggregation reports, computed for all keys in one job each.

Where the reference issues several statements per request (driver stats: 5,
earnings: 3, dashboard: 5), the rewrite reads each table once and uses
conditional aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.functions.scalar import (ACTIVE_TRIP, DRIVEN_TRIP, LIVE_TRIP, full_name, in_days,
                                       lit_date, money, month_bounds, on_day, same_iso_week,
                                       same_month, week_bounds)
from terminus.plans import views
from terminus.sources.tables import Tables


def revenue_report(t: Tables, start: dt.date, end: dt.date, net_of_cancelled: bool = False) -> DataFrame:
    """get_revenue_report: per day x destination x booking type over the range.

    By default payments of bookings cancelled later stay in (the reference
    never reverses a payment row); ``net_of_cancelled=True`` leaves out
    payments of bookings that are now cancelled or refunded.
    """
    p = t.payment_log.filter(in_days(F.col("payment_datetime"), start, end))
    if net_of_cancelled:
        gone = t.bookings.filter(F.col("payment_status").isin("cancelled", "refunded")).select(
            F.col("booking_id").alias("_gone"))
        p = p.join(gone, p.booking_id == gone._gone, "left_anti")
    return views.revenue_groups(views.payments_with_context(t, p), with_avg=True)


def revenue_total(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """The page's grand total over the revenue report (one row)."""
    rep = revenue_report(t, start, end)
    return rep.agg(money(F.sum("total_revenue")).alias("total_revenue"),
                   F.count(F.lit(1)).cast("bigint").alias("report_rows"))


def daily_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    return views.daily_revenue(t, as_of)


def trip_statistics(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """get_trip_statistics: per destination over driven trips in the range.

    ``occupancy_rate`` is the share of trips that were full, not a seat load factor.
    """
    tr = t.trips.filter(in_days(F.col("actual_departure_datetime"), start, end)
                        & F.col("trip_status").isin(*DRIVEN_TRIP))
    full = F.sum(F.when(F.col("seats_booked") == F.col("capacity"), 1).otherwise(0))
    per_route = (tr.groupBy("route_id")
                 .agg(F.count("trip_id").alias("n"), F.sum("seats_booked").alias("s"),
                      full.alias("f")))
    j = per_route.join(t.routes.select("route_id", "destination"), "route_id")
    g = j.groupBy("destination").agg(F.sum("n").alias("n"), F.sum("s").alias("s"),
                                     F.sum("f").alias("f"))
    return g.select(
        "destination",
        F.col("n").cast("bigint").alias("total_trips"),
        F.col("s").cast("bigint").alias("total_passengers"),
        F.round(F.col("s").cast("double") / F.col("n"), 4).alias("avg_passengers_per_trip"),
        F.col("f").cast("bigint").alias("full_trips"),
        F.round(F.col("f").cast("double") / F.col("n") * 100, 2).alias("occupancy_rate"))


def _drivers(t: Tables) -> DataFrame:
    return t.users.filter(F.col("role") == "driver")


def driver_performance_report(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """get_driver_performance_report: every driver (with details), trips in the
    range counted by a left join whose filter sits in the ON clause."""
    tr = (t.trips.filter(in_days(F.col("actual_departure_datetime"), start, end)
                         & F.col("trip_status").isin(*DRIVEN_TRIP))
          .groupBy("driver_id")
          .agg(F.count("trip_id").alias("n"), F.sum("seats_booked").alias("s")))
    u = _drivers(t)
    dd = t.driver_details
    j = u.join(dd, u.user_id == dd.driver_id).drop(dd.driver_id).join(
        tr, u.user_id == tr.driver_id, "left")
    return j.select(
        "user_id", full_name("firstname", "lastname").alias("driver_name"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("trips_in_period"),
        F.col("s").cast("bigint").alias("passengers_transported"),
        F.round(F.col("s").cast("double") / F.col("n"), 4).alias("avg_passengers_per_trip"),
        F.col("trips_completed").alias("lifetime_trips"),
        F.col("total_distance_driven").alias("lifetime_distance"),
        "delayed_trips")


def driver_performance(t: Tables, as_of: dt.date) -> DataFrame:
    return views.driver_performance(t, as_of)


def users_by_role(t: Tables) -> DataFrame:
    """Active users: total and per role (one row)."""
    u = t.users.filter(F.col("status") == "active")
    return u.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_users"),
        F.count_if(F.col("role") == "driver").cast("bigint").alias("drivers"),
        F.count_if(F.col("role") == "dispatcher").cast("bigint").alias("dispatchers"),
        F.count_if(F.col("role") == "passenger").cast("bigint").alias("passengers"))


def dashboard_kpis(t: Tables, as_of: dt.date) -> DataFrame:
    """Admin dashboard numbers as one row: four one-row aggregates joined."""
    rev = (t.payment_log.filter(on_day(F.col("payment_datetime"), as_of))
           .agg(money(F.coalesce(F.sum("amount"), F.lit(0))).alias("revenue_today")))
    bk = (t.bookings.filter(on_day(F.col("booking_date"), as_of)
                            & (F.col("payment_status") == "paid"))
          .agg(F.count(F.lit(1)).cast("bigint").alias("bookings_today")))
    tr = (t.trips.filter(F.col("trip_status").isin(*ACTIVE_TRIP))
          .agg(F.count(F.lit(1)).cast("bigint").alias("active_trips")))
    # Four one-row aggregates merged into one row (each column is set in
    # exactly one of them), without joining them.
    parts = [rev, bk, tr, users_by_role(t)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    cols = [c for p in parts for c in p.columns]
    return merged.agg(*[F.max(c).alias(c) for c in cols])


def driver_stats(t: Tables, as_of: dt.date) -> DataFrame:
    """Driver statistics for every driver in one scan of trips.

    Lifetime values come from driver_details (defaults 0 / 'available' when a
    driver has no details row); day, ISO week and month counts and the
    average passengers are conditional aggregates over driven trips.
    """
    driven = t.trips.filter(F.col("trip_status").isin(*DRIVEN_TRIP))
    dep = F.col("actual_departure_datetime")
    agg = driven.groupBy("driver_id").agg(
        F.count_if(on_day(dep, as_of)).alias("trips_today"),
        F.count_if(same_iso_week(dep, as_of)).alias("trips_this_week"),
        F.count_if(same_month(dep, as_of)).alias("trips_this_month"),
        F.avg(F.col("seats_booked").cast("double")).alias("_avg"))
    u = _drivers(t).select("user_id")
    dd = t.driver_details
    j = (u.join(dd, u.user_id == dd.driver_id, "left").drop("driver_id")
         .join(agg, u.user_id == agg.driver_id, "left"))
    return j.select(
        F.col("user_id").alias("driver_id"),
        F.coalesce("trips_completed", F.lit(0)).cast("int").alias("trips_completed"),
        F.coalesce("total_distance_driven", F.lit(0)).cast("decimal(10,2)").alias("total_distance_driven"),
        F.coalesce("delayed_trips", F.lit(0)).cast("int").alias("delayed_trips"),
        F.coalesce("driver_status", F.lit("available")).alias("driver_status"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
          for c in ("trips_today", "trips_this_week", "trips_this_month")],
        F.round(F.coalesce(F.col("_avg"), F.lit(0.0)), 2).alias("average_passengers_per_trip"))


EARNING_WINDOWS = ("today", "week", "month")


def driver_earnings(t: Tables, as_of: dt.date) -> DataFrame:
    """Earnings today / this ISO week / this month per driver, one pass.

    ``trips_count`` keeps the reference's count of joined booking rows (a trip
    with three paid bookings counts three, one with none counts one);
    ``distinct_trips`` is the number of trips. Paid bookings are summed per
    trip before the join, so the join is one row per trip and the fan-out
    count is ``max(paid rows, 1)`` per trip: no distinct aggregate needed.
    """
    wk0, wk1 = week_bounds(as_of)
    mo0, mo1 = month_bounds(as_of)
    lo, hi = min(wk0, mo0), max(wk1, mo1)
    dep = F.col("actual_departure_datetime")
    tr = (t.trips.filter(F.col("trip_status").isin(*DRIVEN_TRIP)
                         & (dep >= lit_date(lo).cast("timestamp_ntz"))
                         & (dep < lit_date(hi + dt.timedelta(days=1)).cast("timestamp_ntz"))
                         & F.col("driver_id").isNotNull())
          .select("trip_id", "driver_id", dep.alias("dep")))
    per_trip = (t.bookings.filter(F.col("payment_status") == "paid").groupBy("trip_id")
                .agg(F.count(F.lit(1)).alias("_rows"), F.sum("total_amount").alias("_amount"),
                     F.sum("seat_count").alias("_seats"))
                .withColumnRenamed("trip_id", "_bt"))
    j = tr.join(per_trip, tr.trip_id == per_trip._bt, "left")
    conds = {"today": on_day(F.col("dep"), as_of), "week": same_iso_week(F.col("dep"), as_of),
             "month": same_month(F.col("dep"), as_of)}
    fan_out = F.greatest(F.coalesce(F.col("_rows"), F.lit(0)), F.lit(1))
    aggs = []
    for w in EARNING_WINDOWS:
        c = conds[w]
        aggs += [F.sum(F.when(c, fan_out)).alias(f"{w}_trips_count"),
                 F.count_if(c).alias(f"{w}_distinct_trips"),
                 F.sum(F.when(c, F.col("_amount"))).alias(f"{w}_earnings"),
                 F.sum(F.when(c, F.col("_seats"))).alias(f"{w}_passengers")]
    g = j.groupBy("driver_id").agg(*aggs)
    u = _drivers(t).select(F.col("user_id").alias("driver_id"))
    out = u.join(g, "driver_id", "left")
    cols = ["driver_id"]
    for w in EARNING_WINDOWS:
        cols += [F.coalesce(f"{w}_trips_count", F.lit(0)).cast("bigint").alias(f"{w}_trips_count"),
                 F.coalesce(f"{w}_distinct_trips", F.lit(0)).cast("bigint").alias(f"{w}_distinct_trips"),
                 money(F.coalesce(f"{w}_earnings", F.lit(0))).alias(f"{w}_earnings"),
                 F.coalesce(f"{w}_passengers", F.lit(0)).cast("bigint").alias(f"{w}_passengers")]
    return out.select(*cols)


def manifest_totals(t: Tables) -> DataFrame:
    """Per trip: paid bookings and seats on its passenger manifest."""
    return (t.bookings.filter(F.col("payment_status") == "paid").groupBy("trip_id")
            .agg(F.sum("seat_count").cast("bigint").alias("total_passengers"),
                 F.count(F.lit(1)).cast("bigint").alias("total_bookings")))


def queue_max_position(t: Tables) -> DataFrame:
    """Next free queue position per route: IFNULL(MAX(live position), 0) + 1."""
    live = (t.trips.filter(F.col("trip_status").isin(*LIVE_TRIP)).groupBy("route_id")
            .agg(F.max("queue_position").alias("_m")))
    return (t.routes.select("route_id").join(live, "route_id", "left")
            .select("route_id", (F.coalesce("_m", F.lit(0)) + 1).cast("int").alias("next_position")))


def active_trip_counts(t: Tables) -> DataFrame:
    """Active (boarding/waiting/departed) trips per route and per vehicle,
    the counts behind the delete guards; one scan, two grouping sets."""
    act = t.trips.filter(F.col("trip_status").isin(*ACTIVE_TRIP))
    by = (act.select(F.explode(F.array(
        F.struct(F.lit("route").alias("entity_type"), F.col("route_id").alias("entity_id")),
        F.struct(F.lit("vehicle").alias("entity_type"),
                 F.col("assigned_vehicle_id").alias("entity_id")))).alias("e"))
        .select("e.*").filter(F.col("entity_id").isNotNull()))
    return by.groupBy("entity_type", "entity_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("active_trips"))
