"""Booking, queue and trip lifecycle as set-based jobs.

The reference runs stored procedures and row triggers one request at a time.
Each job here takes snapshot DataFrames plus a request / change DataFrame and
returns DataFrames: a ``decisions`` frame (every request with ``decision`` =
accepted / rejected and a ``reason``), the new snapshot rows, and log rows.
Requests are applied in ``(requested_at, request_id)`` order where order
matters (seat admission); surrogate ids are the current maximum plus a
skew-safe global sequence number, never a driver-side counter.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terminus.functions.scalar import (ACTIVE_TRIP, BOOKABLE_TRIP, LIVE_TRIP, folded, lit_ts,
                                       ticket_reference)
from terminus.plans.ranking import sequence_within
from terminus.session import checkpoint_dir


@dataclass
class JobResult:
    decisions: DataFrame
    snapshot: DataFrame | None = None
    log: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @property
    def accepted(self) -> DataFrame:
        return self.decisions.filter(F.col("decision") == "accepted")

    @property
    def rejected(self) -> DataFrame:
        return self.decisions.filter(F.col("decision") == "rejected").select(
            *[c for c in self.decisions.columns if c != "decision"])


LOG_SCHEMA = "user_id bigint, action_type string, description string, created_at timestamp_ntz"


#: The order in which requests are applied.
REQUEST_ORDER = ["requested_at", "request_id"]


def _decide(ok: Column, reason: Column) -> list[Column]:
    return [F.when(ok, "accepted").otherwise("rejected").alias("decision"),
            F.when(ok, F.lit(None).cast("string")).otherwise(reason).alias("reason")]


def first_per_key(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``_dup``: true for all but the first request of a key in ``order``
    (requests without a key never repeat each other). A batch changes a key
    once; rows that tie on ``order`` are interchangeable."""
    w = Window.partitionBy(key).orderBy(*order)
    return requests.withColumn("_dup", F.col(key).isNotNull() & (F.row_number().over(w) > 1))


def _max_id(df: DataFrame, col: str) -> Column:
    """The current maximum id (0 when empty) as a literal: new ids are this
    offset plus a distributed sequence number. Only the one number reaches
    the driver."""
    return F.lit(_scalar(df.agg(F.max(col)))).cast("bigint")


def _scalar(df: DataFrame) -> int:
    """Read a one-row, one-column aggregate (a bound, never data rows)."""
    v = df.first()[0]
    return int(v) if v is not None else 0


def first_come(requests: DataFrame) -> DataFrame:
    """``requested_at, request_id`` of the requests (trip_id, request_id,
    requested_at, seat_count, ``_avail`` = their trip's free seats) that get seats
    in (requested_at, request_id) order; see ``admit_bookings`` for the bound on
    the lists."""
    # Five narrow columns. A trip may be asked for by a third of all requests, so
    # their rank is counted over ranges, not in one task a trip.
    cand = (sequence_within(requests.select("trip_id", "request_id", "requested_at", "seat_count", "_avail"), ["trip_id", "seat_count"], [F.col(c) for c in REQUEST_ORDER], out="_rk")
            .filter(F.col("_rk") * F.col("seat_count") <= F.col("_avail")))
    lists = cand.groupBy("trip_id", "_avail").agg(F.array_sort(F.collect_list(
        F.struct("requested_at", "request_id", "seat_count"))).alias("_reqs"))
    init = F.struct(F.col("_avail").alias("left"),
                    F.array().cast("array<struct<requested_at:timestamp_ntz,request_id:bigint>>").alias("ok"))
    folded = F.aggregate(
        "_reqs", init,
        lambda acc, x: F.when(x["seat_count"] <= acc["left"], F.struct(
            (acc["left"] - x["seat_count"]).alias("left"),
            F.array_append(acc["ok"], F.struct(x["requested_at"].alias("requested_at"),
                                               x["request_id"].alias("request_id"))).alias("ok"))).otherwise(acc))
    return lists.select(F.inline(folded["ok"]))


# --------------------------------------------------------------------- W01
def admit_bookings(trips: DataFrame, requests: DataFrame, bookings: DataFrame,
                   payments: DataFrame, now: dt.datetime) -> JobResult:
    """create_booking for a batch of requests.

    Per request, in (requested_at, request_id) order per trip: unknown trip ->
    ``unknown_trip``; trip not boarding/full -> ``not_accepting``; fewer free
    seats than asked -> ``not_enough_seats`` (a rejected request uses no seats);
    else accepted as paid, total = fare x seats, with ticket and payment row.

    The order-dependent part is a fold per trip over a bounded candidate list.
    Exact pruning: if a request of size s is rejected, free seats never grow
    back, so every later size-s request of that trip is rejected too. The
    accepted size-s requests are therefore the first ones, at most
    floor(free / s) of them; later ones are rejected without entering the
    fold. A trip's list is thus bounded by its capacity (about 3x free seats
    for s = 1..10), whatever the number of requests for it.
    """
    tr = trips.select(F.col("trip_id").alias("_t"), F.col("trip_status").alias("_st"),
                      F.col("seats_available").alias("_avail"), F.col("fare_price").alias("_fare"))
    r = requests.join(tr, requests.trip_id == tr._t, "left")
    n = F.col("seat_count")
    static = (F.when(F.col("_t").isNull(), "unknown_trip")
              .when(~F.col("_st").isin(*BOOKABLE_TRIP), "not_accepting")
              .when(n.isNull() | (n < 1), "invalid_seat_count")
              .when(n > F.col("_avail"), "not_enough_seats"))
    r = r.withColumn("_static", static)
    elig = r.filter(F.col("_static").isNull()).select("trip_id", "request_id", "requested_at",
                                                      "seat_count", "_avail")
    ok = first_come(elig)
    # The numbered ids are read by every output, so they are written once
    # (three numbers a row); the wide request rows join them.
    checkpoint_dir(r.sparkSession)
    ids = (sequence_within(ok, [], [F.col(c) for c in REQUEST_ORDER], out="_seq")
           .select(F.col("request_id").alias("_rid"),
                   (_max_id(bookings, "booking_id") + F.col("_seq")).alias("booking_id"),
                   (_max_id(payments, "payment_id") + F.col("_seq")).alias("payment_id"))
           .checkpoint(eager=True))
    total = (F.col("_fare") * F.col("seat_count")).cast("decimal(10,2)")
    ok_flag = F.col("booking_id").isNotNull()
    decisions = r.join(ids, r.request_id == ids._rid, "left").select(
        "request_id", "trip_id", "seat_count",
        *_decide(ok_flag, F.coalesce(F.col("_static"), F.lit("not_enough_seats"))),
        "booking_id", F.when(ok_flag, total).alias("total_amount"),
        F.when(ok_flag, ticket_reference(F.col("booking_id"), lit_ts(now)))
        .alias("ticket_reference"))
    accepted = r.join(ids, r.request_id == ids._rid)
    new_bookings = accepted.select(
        "booking_id", ticket_reference(F.col("booking_id"), lit_ts(now)).alias("ticket_reference"),
        "trip_id", F.col("firstname").alias("passenger_firstname"),
        F.col("lastname").alias("passenger_lastname"), F.col("email").alias("passenger_email"),
        F.col("phone").alias("passenger_phone"), F.col("address").alias("passenger_address"),
        "seat_count", "booking_type", F.lit("paid").alias("payment_status"),
        total.alias("total_amount"), F.col("requested_at").alias("booking_date"),
        F.col("requested_at").alias("updated_at"))
    new_payments = accepted.select(
        "payment_id", "booking_id", "trip_id",
        F.concat(F.col("booking_type"), F.lit(" booking - "), F.col("seat_count").cast("string"),
                 F.lit(" seat(s)")).alias("description"),
        total.alias("amount"), "payment_method", "payment_reference",
        F.col("requested_at").alias("payment_datetime"))
    added = accepted.groupBy("trip_id").agg(F.sum("seat_count").alias("_add"))
    snapshot = mark_full(apply_seat_delta(trips, added))
    return JobResult(decisions, snapshot, None,
                     {"bookings": new_bookings, "payments": new_payments})


def apply_seat_delta(trips: DataFrame, delta: DataFrame) -> DataFrame:
    """trips + per-trip seat delta (``delta(trip_id, _add)``), seats_available recomputed."""
    d = delta.select(F.col("trip_id").alias("_dt"), "_add")
    j = trips.join(d, trips.trip_id == d._dt, "left")
    sb = (F.col("seats_booked") + F.coalesce(F.col("_add"), F.lit(0))).cast("int")
    return (j.withColumn("seats_booked", sb)
            .withColumn("seats_available", (F.col("capacity") - F.col("seats_booked")).cast("int"))
            .drop("_dt", "_add"))


def mark_full(trips: DataFrame) -> DataFrame:
    """Rule T5 (W04): a boarding trip whose seats_booked reaches capacity turns
    full; a full trip never turns back to boarding."""
    return trips.withColumn("trip_status", full_or(F.col("trip_status")))


def full_or(status: Column) -> Column:
    """``full`` for a boarding status with no seat left, else the status (T5)."""
    full = (status == "boarding") & (F.col("seats_booked") >= F.col("capacity"))
    return F.when(full, "full").otherwise(status)


# --------------------------------------------------------------------- W02
#: Rows of one cell: requests of a route's slice, trips of a route's block.
SMART_SLICE = 500_000
SMART_BLOCK = 100_000


def _smart_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slice of a route's requests meets one block of its trips: each request
    goes to the first trip (queue order) with enough free seats. ``ptr[n]`` is the
    first trip that can still take n seats; free seats only shrink, so each
    pointer only moves forward. Rows come back with ``seats`` (of a trip: those
    left) and ``to_trip`` (of a request: its trip, if any)."""
    pdf = pdf.sort_values(["is_request", "seq"], ignore_index=True)
    first = int((~pdf["is_request"]).sum())
    seats = pdf["seats"].to_numpy(dtype="int64").copy()
    ids = pdf["id"].to_numpy(dtype="int64")
    ptr: dict[int, int] = {}
    to_trip: list = [None] * len(pdf)
    for i in range(first, len(pdf)):
        n = int(seats[i])
        p = ptr.get(n, 0)
        while p < first and seats[p] < n:
            p += 1
        ptr[n] = p
        if p < first:
            seats[p] -= n
            to_trip[i] = int(ids[p])
    pdf["seats"] = seats
    pdf["to_trip"] = pd.array(to_trip, dtype="Int64")
    return pdf


def _first_fit(open_trips: DataFrame, cand: DataFrame, grp: list[str], slice_rows: int,
               block_rows: int) -> DataFrame:
    """First-fit of requests (``grp``, request_id, seat_count, requested_at) into
    trips (``grp``, trip_id, queue_position, avail): ``request_id, trip_id`` of
    those that found one.

    A request that no trip of a block can take moves on to the next block, so a
    block is a filter that the requests pass in order. Slice s of a route's
    requests meets block b of its trips in step s + b: by then it has left block
    b - 1, and slice s - 1 has left block b. All cells of a step run side by side,
    and none holds more than a slice and a block, whatever a route holds. There
    is one step for a small route, and (slices + blocks - 1) for the largest one.
    """
    def cells(df: DataFrame, order: list, rows: int, is_request: bool, row_id: str, seats: str) -> DataFrame:
        return sequence_within(df, grp, order, out="seq").select(
            *grp, F.lit(is_request).alias("is_request"), F.floor((F.col("seq") - 1) / rows).cast("int").alias("begins"),
            "seq", F.col(row_id).cast("bigint").alias("id"), F.col(seats).cast("bigint").alias("seats"),
            F.lit(None).cast("bigint").alias("to_trip"))

    order = [F.col("queue_position").asc_nulls_last(), F.col("trip_id").asc()]
    todo = (cells(open_trips, order, block_rows, False, "trip_id", "avail")
            .unionByName(cells(cand, [F.col(c) for c in REQUEST_ORDER], slice_rows, True, "request_id", "seat_count")))
    # What a row still meets: a trip all slices, a request all blocks of its route.
    last = todo.groupBy(*[F.col(c).alias("_l_" + c) for c in grp]).agg(
        F.max(F.when(F.col("is_request"), F.col("begins"))).alias("_slice"),
        F.max(F.when(~F.col("is_request"), F.col("begins"))).alias("_block")).filter("_slice is not null and _block is not null")
    on = [todo[c].eqNullSafe(last["_l_" + c]) for c in grp]
    todo = (todo.join(last, on).withColumn("ends", F.col("begins") + F.when(F.col("is_request"), F.col("_block")).otherwise(F.col("_slice")))
            .drop("_slice", "_block", *["_l_" + c for c in grp]))
    checkpoint_dir(todo.sparkSession)
    todo = todo.checkpoint(eager=True)
    found, going = [], todo.filter("false")
    for step in range(_scalar(todo.agg(F.max("ends") + 1))):
        cell = F.when(F.col("is_request"), step - F.col("begins")).otherwise(F.col("begins")).alias("cell")
        now = todo.filter(F.col("begins") == step).unionByName(going)
        done = now.groupBy(*grp, cell).applyInPandas(_smart_cell, todo.schema).checkpoint(eager=True)
        found.append(done.filter("to_trip is not null"))
        going = done.filter((F.col("ends") > step) & F.col("to_trip").isNull())
    return reduce(DataFrame.unionByName, found, todo.filter("false")).select(
        F.col("id").alias("request_id"), F.col("to_trip").alias("trip_id"))


def admit_smart_bookings(trips: DataFrame, requests: DataFrame, by_service_day: bool = False,
                         slice_rows: int = SMART_SLICE, block_rows: int = SMART_BLOCK) -> JobResult:
    """smart_booking for a batch: each request names a route; it goes to the
    first boarding, accepting trip of that route (by queue position) with
    enough free seats, else ``no_trip``. A trip that fills is skipped after.

    The same exact pruning as W01 applies per (route, seat count): accepted
    size-s requests are the first ones, at most sum over the route's trips of
    floor(free / s). They and the route's open trips meet in cells of bounded
    size (``_first_fit``); no route is gathered in one task.

    ``by_service_day=True`` is an opt-in variant, not the reference's answer: a
    request only looks at trips whose planned departure falls on the day it
    was made, so a busy route is folded per (route, day) in parallel.
    """
    grp = ["route_id", "service_day"] if by_service_day else ["route_id"]
    day_t = [F.to_date("estimated_departure_time").alias("service_day")] if by_service_day else []
    day_r = [F.to_date("requested_at").alias("service_day")] if by_service_day else []
    open_trips = trips.filter(F.col("is_accepting_bookings")
                              & (F.col("trip_status") == "boarding")).select(
        "route_id", *day_t, "trip_id", "queue_position", F.col("seats_available").alias("avail"))
    req = requests.select("request_id", "route_id", *day_r, "seat_count", "requested_at")
    sizes = (req.filter(F.col("seat_count") >= 1)
             .select(*[F.col(c).alias("_s_" + c) for c in grp], F.col("seat_count").alias("_s_n")).distinct())
    bounds = (sizes.join(open_trips, [sizes["_s_" + c].eqNullSafe(open_trips[c]) for c in grp])
              .groupBy(*["_s_" + c for c in grp], "_s_n")
              .agg(F.sum(F.floor(F.col("avail") / F.col("_s_n"))).cast("bigint").alias("_bound")))
    cond = [req[c].eqNullSafe(bounds["_s_" + c]) for c in grp] + [req["seat_count"] == bounds["_s_n"]]
    cand = (sequence_within(req.join(bounds, cond).filter("_bound > 0").select(*req.columns, "_bound"), [*grp, "seat_count"],
                            [F.col(c) for c in REQUEST_ORDER], out="_rk")
            .filter(F.col("_rk") <= F.col("_bound")).select(*req.columns))
    assigned = _first_fit(open_trips, cand, grp, slice_rows, block_rows)
    a = assigned.select(F.col("request_id").alias("_rid"), F.col("trip_id").alias("assigned_trip_id"))
    d = requests.join(a, requests.request_id == a._rid, "left")
    ok = F.col("assigned_trip_id").isNotNull()
    reason = (F.when(F.col("seat_count").isNull() | (F.col("seat_count") < 1), "invalid_seat_count")
              .otherwise("no_trip"))
    decisions = d.select("request_id", "route_id", "seat_count", *_decide(ok, reason),
                         F.col("assigned_trip_id").alias("trip_id"))
    added = (d.filter(ok).groupBy(F.col("assigned_trip_id").alias("trip_id"))
             .agg(F.sum("seat_count").alias("_add")))
    return JobResult(decisions, mark_full(apply_seat_delta(trips, added)))


# --------------------------------------------------------------- W03 / W04
def seat_delta(old: Column, new: Column, n: Column) -> Column:
    """Triggers T1-T3: insert as paid +n; paid -> cancelled -n; pending -> paid +n."""
    return (F.when(old.isNull() & (new == "paid"), n)
            .when((old == "paid") & (new == "cancelled"), -n)
            .when((old == "pending") & (new == "paid"), n)
            .otherwise(0)).cast("int")


def seat_ledger_running(changes: DataFrame) -> DataFrame:
    """Per change row: its seat delta and the trip's running seats_booked."""
    c = changes.withColumn("delta", seat_delta(F.col("old_status"), F.col("new_status"),
                                               F.col("seat_count")))
    # A trip has few changes: a plain window per trip.
    w = Window.partitionBy("trip_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("event_id", "trip_id", "booking_id", "ts", "delta",
                    F.sum(F.col("delta").cast("bigint")).over(w).alias("seats_booked_after"))


def seat_ledger(trips: DataFrame, changes: DataFrame) -> DataFrame:
    """seats_booked per trip folded from the change feed (order-free sum)."""
    tot = (changes.groupBy("trip_id").agg(F.sum(seat_delta(
        F.col("old_status"), F.col("new_status"), F.col("seat_count"))).alias("_sb")))
    j = trips.select("trip_id", "capacity").join(tot, "trip_id", "left")
    sb = F.coalesce(F.col("_sb"), F.lit(0)).cast("bigint")
    return j.select("trip_id", sb.alias("seats_booked"), "capacity",
                    (F.col("capacity") - sb).cast("bigint").alias("seats_available"))


def mark_full_trips(trips: DataFrame, changes: DataFrame) -> DataFrame:
    """W04: trips with ledger seats; boarding trips at capacity become full."""
    led = seat_ledger(trips, changes).select(F.col("trip_id").alias("_l"),
                                             F.col("seats_booked").alias("_sb"))
    j = trips.join(led, trips.trip_id == led._l, "left")
    j = (j.withColumn("old_status", F.col("trip_status"))
         .withColumn("seats_booked", F.col("_sb").cast("int"))
         .withColumn("seats_available", (F.col("capacity") - F.col("seats_booked")).cast("int")))
    j = mark_full(j)
    return j.select("trip_id", "seats_booked", "seats_available", "old_status", "trip_status",
                    ((F.col("old_status") != "full") & (F.col("trip_status") == "full"))
                    .alias("became_full"))


# --------------------------------------------------------------------- W05
def enqueue_trips(trips: DataFrame, routes: DataFrame, vehicles: DataFrame, users: DataFrame,
                  requests: DataFrame, now: dt.datetime) -> JobResult:
    """create_trip_in_queue for a batch (applied in request_id order).

    Capacity from the vehicle, fare and duration from the route, position =
    current last live position of the route + rank of the request in the
    route; position 1 boards and accepts, the others wait. Unknown route or
    vehicle is rejected (the reference's insert would fail on NOT NULL), as is
    a driver who is no user (foreign key); a trip may have no driver.
    """
    r = routes.select(F.col("route_id").alias("_r"), "fare_price",
                      F.col("estimated_duration_minutes").alias("estimated_trip_duration_minutes"))
    v = vehicles.select(F.col("vehicle_id").alias("_v"), "capacity")
    base = (trips.filter(F.col("trip_status").isin(*LIVE_TRIP)).groupBy("route_id")
            .agg(F.max("queue_position").alias("_base")).withColumnRenamed("route_id", "_br"))
    j = (requests.join(r, requests.route_id == r._r, "left")
         .join(v, requests.vehicle_id == v._v, "left")
         .join(users.select(F.col("user_id").alias("_u")), requests.driver_id == F.col("_u"), "left"))
    reason = (F.when(F.col("_r").isNull(), "unknown_route").when(F.col("_v").isNull(), "unknown_vehicle")
              .when(F.col("driver_id").isNotNull() & F.col("_u").isNull(), "unknown_driver"))
    j = j.withColumn("_reason", reason)
    acc = j.filter(F.col("_reason").isNull())
    acc = sequence_within(acc, ["route_id"], [F.col("request_id").asc()], out="_rank")
    acc = sequence_within(acc, [], [F.col("request_id").asc()], out="_seq")
    acc = (acc.join(base, acc.route_id == base._br, "left")
           .withColumn("_tmax", _max_id(trips, "trip_id")))
    qp = (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_rank")).cast("int")
    new = acc.select(
        "request_id", (F.col("_tmax") + F.col("_seq")).alias("trip_id"), "route_id",
        F.col("vehicle_id").alias("assigned_vehicle_id"), "driver_id", qp.alias("queue_position"),
        (qp == 1).alias("is_accepting_bookings"),
        F.col("estimated_departure").alias("estimated_departure_time"),
        "estimated_trip_duration_minutes", "capacity", F.lit(0).alias("seats_booked"),
        F.col("capacity").alias("seats_available"),
        F.when(qp == 1, "boarding").otherwise("waiting").alias("trip_status"), "fare_price")
    rej = j.filter(F.col("_reason").isNotNull())
    cols = ["request_id", "route_id", "decision", "reason", "trip_id", "queue_position",
            "trip_status", "is_accepting_bookings", "capacity", "fare_price",
            "estimated_trip_duration_minutes"]
    dec_ok = new.select("request_id", "route_id", F.lit("accepted").alias("decision"),
                        F.lit(None).cast("string").alias("reason"), "trip_id", "queue_position",
                        "trip_status", "is_accepting_bookings", "capacity", "fare_price",
                        "estimated_trip_duration_minutes")
    dec_no = rej.select("request_id", "route_id", F.lit("rejected").alias("decision"),
                        F.col("_reason").alias("reason"),
                        *[F.lit(None).cast(dec_ok.schema[c].dataType).alias(c) for c in cols[4:]])
    log = new.select(F.col("driver_id").alias("user_id"), F.lit("trip_created").alias("action_type"),
                     F.concat(F.lit("New trip created in queue position "),
                              F.col("queue_position").cast("string"), F.lit(" for route "),
                              F.col("route_id").cast("string")).alias("description"),
                     lit_ts(now).alias("created_at"))
    snapshot = new.select(*[F.col(c) if c in new.columns
                            else F.lit(None).cast(trips.schema[c].dataType).alias(c)
                            for c in trips.columns])
    return JobResult(dec_ok.unionByName(dec_no), snapshot, log)


# --------------------------------------------------------------------- W06
def advance_queue(trips: DataFrame, departures: DataFrame, mode: str = "intended") -> JobResult:
    """advance_queue for a batch of departures (``departures(trip_id, ts)``).

    The departing trip becomes departed (actual departure = ts, not accepting).
    ``mode='intended'``: the remaining live trips of each affected route are
    re-numbered 1..n in queue order; the new head boards and accepts, the
    others stop accepting. Any number of departures per route is fine. In both
    modes a trip that is boarding with no seat left turns full (rule T5), and
    of several departures of one trip the earliest counts.
    ``mode='literal'``: the reference's UPDATE as MySQL runs it: on the route,
    waiting/boarding trips behind position 1 move up by one; the assignment
    to queue_position runs first, so the trip that lands on position 2 (not
    1) is opened for boarding. Full trips are not moved. One departure per
    route per batch; more raise an error.
    """
    departures = first_per_key(departures, "trip_id", ["ts"])
    dep = departures.filter(~F.col("_dup")).select(F.col("trip_id").alias("_d"), F.col("ts").alias("_dts"))
    j = trips.join(dep, trips.trip_id == dep._d, "left")
    is_dep = F.col("_d").isNotNull()
    departed = (j.filter(is_dep).withColumn("trip_status", F.lit("departed"))
                .withColumn("actual_departure_datetime", F.col("_dts"))
                .withColumn("is_accepting_bookings", F.lit(False)).drop("_d", "_dts"))
    routes_hit = j.filter(is_dep).groupBy("route_id").agg(F.count(F.lit(1)).alias("_ndep"))
    rest = j.filter(~is_dep).drop("_d", "_dts")
    rest = rest.join(routes_hit.withColumnRenamed("route_id", "_hr"),
                     F.col("route_id") == F.col("_hr"), "left")
    hit = F.col("_hr").isNotNull()
    if mode == "intended":
        live_hit = rest.filter(hit & F.col("trip_status").isin(*LIVE_TRIP))
        other = rest.filter(~(hit & F.col("trip_status").isin(*LIVE_TRIP)))
        ranked = sequence_within(live_hit, ["route_id"], [F.col("queue_position").asc(),
                                                          F.col("trip_id").asc()], out="_newpos")
        head = F.col("_newpos") == 1
        ranked = (ranked.withColumn("queue_position", F.col("_newpos").cast("int"))
                  .withColumn("is_accepting_bookings", head)
                  .withColumn("trip_status", F.when(head & (F.col("trip_status") == "waiting"),
                                                    "boarding").otherwise(F.col("trip_status")))
                  .drop("_newpos"))
        # Rule T5 fires on every row the UPDATE touches.
        ranked = mark_full(ranked)
        after = ranked.unionByName(other)
    elif mode == "literal":
        too_many = F.col("_ndep") > 1
        # WHERE reads the old position; keep that decision before the SET.
        rest = rest.withColumn("_shift", hit & (F.col("queue_position") > 1)
                               & F.col("trip_status").isin("waiting", "boarding"))
        shift = F.col("_shift")
        newpos = (F.when(too_many, F.raise_error(F.lit(
            "literal advance_queue takes one departure per route per batch")))
            .when(shift, F.col("queue_position") - 1).otherwise(F.col("queue_position")))
        after = (rest.withColumn("queue_position", newpos.cast("int"))
                 .withColumn("is_accepting_bookings",
                             F.when(shift, F.col("queue_position") == 2)
                             .otherwise(F.col("is_accepting_bookings")))
                 .withColumn("trip_status", F.when(shift & (F.col("queue_position") == 2), "boarding")
                             .otherwise(F.col("trip_status")))
                 .withColumn("trip_status", F.when(shift, full_or(F.col("trip_status")))
                             .otherwise(F.col("trip_status")))
                 .drop("_shift"))
    else:
        raise ValueError(mode)
    after = after.drop("_hr", "_ndep")
    snapshot = after.unionByName(departed)
    log = (departed.select(F.col("driver_id").alias("user_id"),
                           F.lit("queue_advanced").alias("action_type"),
                           F.concat(F.lit("Queue advanced for route "), F.col("route_id").cast("string"),
                                    F.lit(" after trip "), F.col("trip_id").cast("string"),
                                    F.lit(" departed")).alias("description"),
                           F.col("actual_departure_datetime").alias("created_at")))
    decisions = departures.join(trips.select(F.col("trip_id").alias("_t"), "trip_status"),
                                departures.trip_id == F.col("_t"), "left").select(
        "trip_id", *_decide(F.col("_t").isNotNull() & ~F.col("_dup"),
                            F.when(F.col("_t").isNull(), "unknown_trip").otherwise("duplicate_in_batch")))
    return JobResult(decisions, snapshot, log)


def live_queue_after(result: JobResult) -> DataFrame:
    return (result.snapshot.filter(F.col("trip_status").isin(*LIVE_TRIP))
            .select("trip_id", "route_id", "queue_position", "trip_status", "is_accepting_bookings"))


# --------------------------------------------------------------------- W07
def arrive_trips(trips: DataFrame, arrivals: DataFrame) -> JobResult:
    """mark_trip_arrived with the handler's checks, for a batch of reports
    ``arrivals(trip_id, driver_id, ts)``: unknown trip, trip of another driver
    (a trip with no driver belongs to nobody), trip not departed."""
    tr = trips.select(F.col("trip_id").alias("_t"), F.col("driver_id").alias("_drv"),
                      F.col("trip_status").alias("_st"))
    j = arrivals.join(tr, arrivals.trip_id == tr._t, "left")
    reason = (F.when(F.col("_t").isNull(), "unknown_trip")
              .when(~F.col("_drv").eqNullSafe(F.col("driver_id")) | F.col("_drv").isNull(),
                    "not_your_trip")
              .when(F.col("_st") != "departed", "not_departed"))
    # After the first report that is accepted, the trip is no longer departed.
    good = first_per_key(j.withColumn("_reason", reason).withColumn("_bad", F.col("_reason").isNotNull()),
                         "trip_id", ["_bad", "ts", "driver_id"])
    j = good.withColumn("_reason", F.when(F.col("_reason").isNull() & F.col("_dup"), "not_departed")
                        .otherwise(F.col("_reason")))
    ok = F.col("_reason").isNull()
    decisions = j.select("trip_id", "driver_id", *_decide(ok, F.col("_reason")),
                         F.when(ok, F.col("ts")).alias("actual_arrival_datetime"))
    acc = decisions.filter(F.col("decision") == "accepted").select(
        F.col("trip_id").alias("_a"), F.col("actual_arrival_datetime").alias("_at"))
    s = trips.join(acc, trips.trip_id == acc._a, "left")
    s = (s.withColumn("trip_status", F.when(F.col("_a").isNotNull(), "arrived")
                      .otherwise(F.col("trip_status")))
         .withColumn("actual_arrival_datetime", F.coalesce(F.col("_at"), F.col("actual_arrival_datetime")))
         .drop("_a", "_at"))
    return JobResult(decisions, s)


# --------------------------------------------------------------- W08 - W10
def _transitions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("new_status").isin("departed", "arrived")
                         & (F.col("old_status").isNull() | (F.col("old_status") != F.col("new_status"))))


def driver_rollup(driver_details: DataFrame, events: DataFrame, routes: DataFrame) -> DataFrame:
    """Triggers T6/T7 folded over the status change feed: each arrival adds a
    completed trip and the route distance (0 when unknown); the driver's last
    transition sets the status (departed -> on_trip, arrived -> available)."""
    ev = _transitions(events).filter(F.col("driver_id").isNotNull())
    r = routes.select(F.col("route_id").alias("_r"), "distance_km")
    ev = ev.join(r, ev.route_id == r._r, "left")
    arr = F.col("new_status") == "arrived"
    g = ev.groupBy("driver_id").agg(
        F.count_if(arr).alias("_n"),
        F.sum(F.when(arr, F.coalesce(F.col("distance_km"), F.lit(0)))).alias("_km"),
        F.max_by("new_status", F.struct("ts", "event_id")).alias("_last"))
    g = g.withColumnRenamed("driver_id", "_g")
    j = driver_details.join(g, driver_details.driver_id == g._g, "left")
    return j.select(
        "driver_id", "license_number",
        (F.col("trips_completed") + F.coalesce(F.col("_n"), F.lit(0))).cast("int").alias("trips_completed"),
        (F.col("total_distance_driven") + F.coalesce(F.col("_km"), F.lit(0)))
        .cast("decimal(10,2)").alias("total_distance_driven"),
        "delayed_trips",
        F.when(F.col("_last") == "arrived", "available").when(F.col("_last") == "departed", "on_trip")
        .otherwise(F.col("driver_status")).alias("driver_status"))


def vehicle_rollup(vehicles: DataFrame, events: DataFrame) -> DataFrame:
    """Triggers T8/T9: the vehicle's last transition sets its status
    (departed -> in_service, arrived -> available)."""
    ev = _transitions(events).filter(F.col("vehicle_id").isNotNull())
    g = (ev.groupBy("vehicle_id").agg(F.max_by("new_status", F.struct("ts", "event_id")).alias("_last"))
         .withColumnRenamed("vehicle_id", "_g"))
    j = vehicles.join(g, vehicles.vehicle_id == g._g, "left")
    return j.select("vehicle_id", "plate_number",
                    F.when(F.col("_last") == "arrived", "available")
                    .when(F.col("_last") == "departed", "in_service")
                    .otherwise(F.col("vehicle_status")).alias("vehicle_status"))


def departure_log(events: DataFrame) -> DataFrame:
    """Trigger T4: every change into departed logs ``trip_departed``."""
    d = events.filter((F.col("new_status") == "departed")
                      & (F.col("old_status").isNull() | (F.col("old_status") != "departed")))
    return d.select("event_id", F.col("driver_id").alias("user_id"),
                    F.lit("trip_departed").alias("action_type"),
                    F.concat(F.lit("Trip #"), F.col("trip_id").cast("string"), F.lit(" departed at "),
                             F.col("ts").cast("string")).alias("description"),
                    F.col("ts").alias("created_at"))


def transition_log(snapshots: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Status transitions from consecutive snapshots ``(trip_id, trip_status, ts)``:
    rows whose status differs from the trip's previous snapshot (the first
    snapshot of a trip counts, with ``old_status`` NULL). ``order`` breaks
    ties of ``ts``. A trip has a handful of snapshots, so the per-trip window
    stays small."""
    w = Window.partitionBy("trip_id").orderBy(*(order or ["ts"]))
    s = snapshots.withColumn("old_status", F.lag("trip_status").over(w))
    return s.filter(F.col("old_status").isNull() | (F.col("old_status") != F.col("trip_status")))


# --------------------------------------------------------------------- W11
def cancel_bookings(bookings: DataFrame, requests: DataFrame) -> JobResult:
    """cancel_booking for a batch ``requests(request_id, booking_id, ts)``.

    Unknown booking -> ``unknown_booking``; already cancelled ->
    ``already_cancelled`` (as is a second request for the same booking in
    the batch); otherwise cancelled with a ``booking_cancelled`` log row and a
    change row for the seat ledger.
    """
    first = requests.groupBy("booking_id").agg(F.min(F.struct("ts", "request_id")).alias("_f"))
    first = first.select(F.col("booking_id").alias("_fb"), F.col("_f.request_id").alias("_frid"))
    b = bookings.select(F.col("booking_id").alias("_b"), "trip_id", "seat_count",
                        F.col("payment_status").alias("old_status"))
    j = (requests.join(b, requests.booking_id == b._b, "left")
         .join(first, requests.booking_id.eqNullSafe(first._fb), "left"))
    reason = (F.when(F.col("_b").isNull(), "unknown_booking")
              .when((F.col("old_status") == "cancelled") | (F.col("request_id") != F.col("_frid")),
                    "already_cancelled"))
    j = j.withColumn("_reason", reason)
    ok = F.col("_reason").isNull()
    text = F.concat(F.lit("Booking #"), F.col("booking_id").cast("string"), F.lit(" cancelled. "),
                    F.col("seat_count").cast("string"), F.lit(" seat(s) returned to trip #"),
                    F.col("trip_id").cast("string"))
    decisions = j.select("request_id", "booking_id", *_decide(ok, F.col("_reason")),
                         F.when(ok, text).alias("description"))
    acc = j.filter(ok)
    log = acc.select(F.lit(None).cast("bigint").alias("user_id"),
                     F.lit("booking_cancelled").alias("action_type"), text.alias("description"),
                     F.col("ts").alias("created_at"))
    changes = acc.select("request_id", "booking_id", "trip_id", "old_status",
                         F.lit("cancelled").alias("new_status"), "seat_count", "ts")
    c = acc.select(F.col("booking_id").alias("_c"), F.col("ts").alias("_cts"))
    s = bookings.join(c, bookings.booking_id == c._c, "left")
    s = (s.withColumn("payment_status", F.when(F.col("_c").isNotNull(), "cancelled")
                      .otherwise(F.col("payment_status")))
         # ON UPDATE CURRENT_TIMESTAMP: the row changed when it was cancelled.
         .withColumn("updated_at", F.when(F.col("_c").isNotNull(), F.coalesce("_cts", "updated_at"))
                     .otherwise(F.col("updated_at"))).drop("_c", "_cts"))
    return JobResult(decisions, s, log, {"changes": changes})


# ------------------------------------------------------------- W12 / W13
def _one_change(j: DataFrame, reason: Column, order: str) -> DataFrame:
    """``_reason`` per request. Of the valid requests of a trip the last in
    (requested_at, request_id) order stays, as if they were applied one by one;
    the others are ``superseded``. Without request ids there is no order: the first
    by ``order`` is applied and the others are ``duplicate_in_batch``."""
    j = j.withColumn("_reason", reason).withColumn("_bad", F.col("_reason").isNotNull())
    at = [c for c in ("requested_at", "request_id") if c in j.columns]
    if "request_id" in at:
        last = j.filter("not _bad").groupBy(F.col("trip_id").alias("_lt")).agg(F.max(F.struct(*at)).alias("_last"))
        j = j.join(last, F.col("trip_id") == F.col("_lt"), "left")
        return j.withColumn("_reason", F.when(~F.col("_bad") & ~F.struct(*at).eqNullSafe(F.col("_last")), "superseded")
                            .otherwise(F.col("_reason")))
    j = first_per_key(j, "trip_id", ["_bad", order])
    return j.withColumn("_reason", F.when(~F.col("_bad") & F.col("_dup"), "duplicate_in_batch")
                        .otherwise(F.col("_reason")))


def _ordered(requests: DataFrame, *cols: str) -> list[str]:
    """``cols``, and what gives the requests an order if they have it."""
    return [*[c for c in ("request_id", "requested_at") if c in requests.columns], *cols]


def reassign_vehicles(trips: DataFrame, vehicles: DataFrame, requests: DataFrame) -> JobResult:
    """Set vehicle and capacity of trips (``requests(trip_id, vehicle_id)``).
    The vehicle must exist; booked seats are not checked, so free seats can
    go negative (kept; the integrity audit reports it). A boarding trip that
    has no seat left in its new vehicle turns full (rule T5). Of several valid
    requests for one trip the last by (requested_at, request_id) counts, the
    others are ``superseded``; without a ``request_id`` the one with the smallest
    vehicle id counts."""
    v = vehicles.select(F.col("vehicle_id").alias("_v"), F.col("capacity").alias("_cap"))
    tr = trips.select(F.col("trip_id").alias("_t"), F.col("seats_booked").alias("_sb"),
                      F.col("trip_status").alias("_st"))
    j = (requests.select(*_ordered(requests, "trip_id", "vehicle_id")).join(v, F.col("vehicle_id") == v._v, "left")
         .join(tr, F.col("trip_id") == tr._t, "left"))
    j = _one_change(j, F.when(F.col("_v").isNull(), "unknown_vehicle")
                    .when(F.col("_t").isNull(), "unknown_trip"), "vehicle_id")
    ok = F.col("_reason").isNull()
    status = F.when((F.col("_st") == "boarding") & (F.col("_sb") >= F.col("_cap")), "full").otherwise(F.col("_st"))
    decisions = j.select(*[c for c in ("request_id",) if c in requests.columns], "trip_id", "vehicle_id", *_decide(ok, F.col("_reason")),
                         F.when(ok, F.col("_cap")).alias("capacity"),
                         F.when(ok, (F.col("_cap") - F.col("_sb")).cast("int")).alias("seats_available"),
                         F.when(ok, status).alias("trip_status"))
    acc = decisions.filter(F.col("decision") == "accepted").select(
        F.col("trip_id").alias("_a"), F.col("vehicle_id").alias("_nv"), F.col("capacity").alias("_nc"),
        F.col("trip_status").alias("_ns"))
    s = trips.join(acc, trips.trip_id == acc._a, "left")
    s = (s.withColumn("assigned_vehicle_id", F.coalesce("_nv", "assigned_vehicle_id"))
         .withColumn("capacity", F.coalesce("_nc", "capacity").cast("int"))
         .withColumn("seats_available", (F.col("capacity") - F.col("seats_booked")).cast("int"))
         .withColumn("trip_status", F.coalesce("_ns", "trip_status"))
         .drop("_a", "_nv", "_nc", "_ns"))
    return JobResult(decisions, s)


def reassign_drivers(trips: DataFrame, users: DataFrame, driver_details: DataFrame,
                     requests: DataFrame) -> JobResult:
    """Set the driver of trips; the driver must be a user with role driver and
    a driver_details row (availability is not checked, as in the reference)."""
    drv = (users.filter(F.col("role") == "driver")
           .join(driver_details, users.user_id == driver_details.driver_id, "left_semi")
           .select(F.col("user_id").alias("_u")))
    tr = trips.select(F.col("trip_id").alias("_t"))
    j = (requests.select(*_ordered(requests, "trip_id", "driver_id")).join(drv, F.col("driver_id") == drv._u, "left")
         .join(tr, F.col("trip_id") == tr._t, "left"))
    j = _one_change(j, F.when(F.col("_u").isNull(), "unknown_driver")
                    .when(F.col("_t").isNull(), "unknown_trip"), "driver_id")
    ok = F.col("_reason").isNull()
    decisions = j.select(*[c for c in ("request_id",) if c in requests.columns], "trip_id", "driver_id", *_decide(ok, F.col("_reason")))
    acc = decisions.filter(F.col("decision") == "accepted").select(
        F.col("trip_id").alias("_a"), F.col("driver_id").alias("_nd"))
    s = (trips.join(acc, trips.trip_id == acc._a, "left")
         .withColumn("driver_id", F.coalesce("_nd", "driver_id")).drop("_a", "_nd"))
    return JobResult(decisions, s)


# --------------------------------------------------------------------- W14
def mark_notifications_read(user_notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """Set is_read and read_at (latest mark) for marked (notification, user) pairs."""
    m = (marks.groupBy("user_id", "notification_id").agg(F.max("ts").alias("_ts"))
         .withColumnRenamed("user_id", "_mu").withColumnRenamed("notification_id", "_mn"))
    un = user_notifications
    j = un.join(m, (un.user_id == m._mu) & (un.notification_id == m._mn), "left")
    hit = F.col("_mu").isNotNull()
    return j.select("user_notification_id", "user_id", "notification_id",
                    (hit | F.col("is_read")).alias("is_read"),
                    F.when(hit, F.col("_ts")).otherwise(F.col("read_at")).alias("read_at"))


# --------------------------------------------------------------------- W15
def deletable_entities(routes: DataFrame, vehicles: DataFrame, trips: DataFrame) -> DataFrame:
    """Routes and vehicles with their blocking (waiting/boarding/departed) trip
    count; deletable when none (``full`` trips do not block, as in the
    reference's guard)."""
    act = trips.filter(F.col("trip_status").isin(*ACTIVE_TRIP))
    by_route = act.groupBy(F.col("route_id").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    by_veh = (act.filter(F.col("assigned_vehicle_id").isNotNull())
              .groupBy(F.col("assigned_vehicle_id").alias("_k")).agg(F.count(F.lit(1)).alias("_n")))

    def one(kind: str, ids: DataFrame, counts: DataFrame) -> DataFrame:
        j = ids.join(counts, ids.entity_id == counts._k, "left")
        n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
        return j.select(F.lit(kind).alias("entity_type"), "entity_id", n.alias("blocking_trips"),
                        (n == 0).alias("deletable"))
    return (one("route", routes.select(F.col("route_id").alias("entity_id")), by_route)
            .unionByName(one("vehicle", vehicles.select(F.col("vehicle_id").alias("entity_id")), by_veh)))


def register_users(users: DataFrame, requests: DataFrame, now: dt.datetime) -> JobResult:
    """Registration in bulk ``requests(request_id, firstname, lastname, email,
    phone_number, role)``: an e-mail already registered (under the collation) ->
    ``email_exists``; the same e-mail twice in the batch -> the lowest
    request_id wins, the others get ``duplicate_in_batch``. New users default
    to role passenger and status active; ids continue from the maximum."""
    req = requests.withColumn("_k", folded("email"))
    existing = users.select(folded("email").alias("_ek")).distinct()
    first = req.groupBy("_k").agg(F.min("request_id").alias("_first")).withColumnRenamed("_k", "_fk")
    j = (req.join(existing, req._k == existing._ek, "left")
         .join(first, req._k == first._fk, "left"))
    reason = (F.when(F.col("_ek").isNotNull(), "email_exists")
              .when(F.col("request_id") != F.col("_first"), "duplicate_in_batch"))
    j = j.withColumn("_reason", reason)
    ok = F.col("_reason").isNull()
    acc = sequence_within(j.filter(ok).select("request_id"), [], [F.col("request_id").asc()],
                          out="_seq")
    ids = acc.select(F.col("request_id").alias("_rid"),
                     (_max_id(users, "user_id") + F.col("_seq")).alias("user_id"))
    j = j.join(ids, j.request_id == ids._rid, "left")
    decisions = j.select("request_id", "email", *_decide(ok, F.col("_reason")), "user_id")
    new_users = j.filter(ok).select(
        "user_id", "firstname", "lastname", "email", "phone_number",
        F.coalesce(F.col("role"), F.lit("passenger")).alias("role"), F.lit("active").alias("status"),
        lit_ts(now).alias("created_at"))
    return JobResult(decisions, new_users)


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``UPDATE .. WHERE key`` / insert, as a new snapshot: for keys in
    ``changes`` its columns replace the target's (NULL included), other
    columns and untouched rows pass through, new keys are added. Of several
    changes for one key the smallest row counts (ordered by its columns), so
    the snapshot keeps one row per key."""
    cols = [c for c in target.columns if c != key]
    changed = [c for c in cols if c in changes.columns]
    once = first_per_key(changes, key, changed).filter(~F.col("_dup")) if changed else changes.dropDuplicates([key])
    ch = once.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias("_new_" + c) for c in changed])
    j = target.join(ch, key, "full_outer")
    return j.select(key, *[(F.when(F.col("_hit"), F.col("_new_" + c)).otherwise(F.col(c))
                            if c in changed else F.col(c)).alias(c) for c in cols])
