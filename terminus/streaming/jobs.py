"""Structured Streaming counterparts of the polled monitors.

Each job is ``f(stream, static tables) -> DataStreamWriter``-building code plus a
``run_*`` helper that writes a feed derived from the tables as files, streams the
folder with ``availableNow`` and returns the sink's batch view. Update-mode
aggregations go to a ``KeyedTable``, which rewrites only the buckets of changed
keys (idempotent per micro-batch): reading it folds over no epochs.

Results do not depend on the order of the files, and no event is dropped for
being late: without a ``delay`` the streams keep the ids they have seen. With a
``delay`` (an event-time watermark) that state is bounded, and events later than
the delay are lost; that is the caller's choice. Only admission depends on order:
a request that comes after a later one of its trip was decided gets its own row,
rejected as ``late``.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terminus.functions.scalar import BOOKABLE_TRIP, LIVE_TRIP, full_name
from terminus.operators import lifecycle as lc
from terminus.plans import views
from terminus.sources import requests as rq
from terminus.sources.tables import Tables
from terminus.session import written, written_for
from terminus.streaming.feed import (event_time, feed_size, materialized, read_stream, run_to_end, scratch, state_partitions,
                                     write_feed)
from terminus.streaming.keyed import EventLog, KeyedTable

FILES_PER_BATCH = 4
#: A replay's files come in so many micro-batches, whatever their number: each may
#: touch every bucket of a table, so more of them would write the table more often.
REPLAY_BATCHES = 4


def deduplicated(stream: DataFrame, ts_col: str, key: list[str], delay: str | None = None) -> DataFrame:
    """Events once each, although the source may deliver them more than once.

    ``delay=None`` remembers every key: copies are dropped however late, and no
    event is lost. With a delay, keys are forgotten (and events dropped) once the
    watermark has passed them.
    """
    if delay is None:
        return stream.dropDuplicates(key)
    return stream.withColumn("_et", event_time(F.col(ts_col))).withWatermark("_et", delay).dropDuplicatesWithinWatermark(key)


def _source(t: Tables, feed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The stream of a feed's files, and their bytes."""
    spark = t.bookings.sparkSession
    folder = write_feed(feed, scratch(spark, name + "-feed"))
    files, size = feed_size(spark, folder)
    return read_stream(spark, folder, feed.schema, max(FILES_PER_BATCH, math.ceil(files / REPLAY_BATCHES))), size


def _run(spark: SparkSession, agg: DataFrame, name: str, keys: list[str], feed_bytes: int = 0) -> DataFrame:
    table = KeyedTable(spark, scratch(spark, name + "-out"), agg.schema, keys)
    run_to_end(agg.writeStream.outputMode("update").foreachBatch(table.writer()), scratch(spark, name + "-ckpt"), feed_bytes=feed_bytes)
    return table.snapshot()


# ------------------------------------------- events kept by time, for X01, X08
def counted_once(events: KeyedTable, report: KeyedTable, rows: Callable[[DataFrame], DataFrame]) -> Callable:
    """``foreachBatch`` function that counts every event once, however late it or a
    copy of it comes, and keeps no stream state.

    ``events`` holds the events by id in buckets of time; a copy meets the event of
    its id there. The report of a bucket follows from that bucket's events, so it is
    recomputed (``rows``) for the buckets that the batch touched, and only these are
    read. A batch that was lost between the two tables is finished by its replay."""
    def write(batch: DataFrame, epoch: int) -> None:
        touched = events.upsert(batch, epoch)
        report.upsert(rows(events.buckets(touched)), epoch)
    return write


def _month(col: str) -> Column:
    return F.date_format(col, "yyyy-MM")


# ---------------------------------------------------------------------- X01
def sold(t: Tables) -> DataFrame:
    """What the revenue report needs of each booking."""
    b = t.bookings.select("booking_id", F.col("trip_id").alias("_bt"), "seat_count", "booking_type")
    tr = t.trips.select(F.col("trip_id").alias("_t"), "route_id")
    return b.join(tr, F.col("_bt") == F.col("_t")).join(t.routes.select("route_id", "destination"), "route_id").select(
        "booking_id", "seat_count", "booking_type", "destination")


def daily_revenue_rows(t: Tables, payments: DataFrame, booked: DataFrame | None = None) -> DataFrame:
    """Revenue per day x destination x booking type of ``payments``. Payments are
    added up per (day, booking) before the join, so COUNT(DISTINCT booking) is a
    plain count. ``booked``: ``sold(t)``, if it is at hand."""
    state = payments.groupBy(F.to_date("payment_datetime").alias("payment_date"), "booking_id").agg(
        F.count(F.lit(1)).alias("n_payments"), F.sum("amount").alias("amount_sum"))
    return state.join(sold(t) if booked is None else booked, "booking_id").groupBy("payment_date", "destination", "booking_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_bookings"),
        F.sum(F.col("seat_count") * F.col("n_payments")).cast("bigint").alias("total_seats_sold"),
        F.sum("amount_sum").cast("decimal(18,2)").alias("total_revenue")).select(
        "payment_date", "destination", "total_bookings", "total_seats_sold", "total_revenue", "booking_type")


def daily_revenue_tables(t: Tables, path: str, every: str = "yyyy-MM", booked: DataFrame | None = None) -> tuple[KeyedTable, KeyedTable, Callable]:
    """X01: payments by id, the report by day, both in buckets of time, and the
    ``foreachBatch`` function that applies payments. ``every`` is the bucket's date
    pattern: a batch rewrites the buckets it touches, so many payments ask for
    short ones (a day), and a replay over years for long ones."""
    spark = t.bookings.sparkSession
    pay = t.payment_log.select("payment_id", "booking_id", "amount", "payment_datetime")
    payments = KeyedTable(spark, path + "/payments", pay.schema, ["payment_id"], bucket_by=F.date_format("payment_datetime", every))
    report = KeyedTable(spark, path + "/report", daily_revenue_rows(t, pay, booked).schema, ["payment_date", "destination", "booking_type"],
                        bucket_by=F.date_format("payment_date", every))
    return payments, report, counted_once(payments, report, lambda part: daily_revenue_rows(t, part, booked))


def run_stream_daily_revenue(t: Tables) -> DataFrame:
    """X01: revenue per day x destination x booking type from the payment stream."""
    spark = t.bookings.sparkSession
    pay = t.payment_log.select("payment_id", "booking_id", "amount", "payment_datetime")
    _, report, write = daily_revenue_tables(t, scratch(spark, "x01-out"), "yyyy", materialized(sold(t)))
    # In time order, as a live stream comes (late rows cost their old month only).
    src, _ = _source(t, pay.repartitionByRange("payment_datetime"), "x01")
    run_to_end(src.writeStream.foreachBatch(write), scratch(spark, "x01-ckpt"))
    return report.snapshot()


# ---------------------------------------------------------------------- X02
def seat_changes(changes: DataFrame) -> DataFrame:
    """What the ledger reads of a change."""
    d = lc.seat_delta(F.col("old_status"), F.col("new_status"), F.col("seat_count"))
    return changes.select("event_id", "trip_id", "ts", d.alias("seats"))


def seat_ledger_state(changes: DataFrame, delay: str | None = None) -> DataFrame:
    """X02: seats_booked per trip as an order-free running sum of T1-T3 deltas."""
    e = changes if "seats" in changes.columns else seat_changes(changes)
    return (deduplicated(e, "ts", ["event_id"], delay).groupBy("trip_id")
            .agg(F.sum("seats").cast("bigint").alias("seats_booked")))


def seat_ledger_table(spark: SparkSession, path: str, buckets: int = 16) -> tuple[KeyedTable, Callable]:
    """X02: the seats booked by trip, and the ``foreachBatch`` function that applies
    changes, each once however late a copy comes, without stream state."""
    log = EventLog(spark, path + "/events", "event_id")
    table = KeyedTable(spark, path + "/ledger", spark.createDataFrame([], "trip_id bigint, seats_booked bigint").schema, ["trip_id"],
                       buckets, fold={"seats_booked": F.sum})

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch not in table.committed():
            now, fresh = log.add(seat_changes(batch), epoch)
            table.upsert(seat_ledger_state(fresh), epoch, of=now)
    return table, write


def run_stream_seat_ledger(t: Tables) -> DataFrame:
    spark = t.bookings.sparkSession
    src, size = _source(t, rq.booking_changes(t), "x02")
    table, write = seat_ledger_table(spark, scratch(spark, "x02-out"), state_partitions(spark, size))
    run_to_end(src.writeStream.foreachBatch(write), scratch(spark, "x02-ckpt"), feed_bytes=size)
    j = t.trips.select("trip_id", "capacity").join(table.snapshot(), "trip_id", "left")
    sb = F.coalesce(F.col("seats_booked"), F.lit(0)).cast("bigint")
    return j.select("trip_id", sb.alias("seats_booked"), "capacity",
                    (F.col("capacity") - sb).cast("bigint").alias("seats_available"))


# ---------------------------------------------------------------------- X03
TRANSITION_SCHEMA = ("event_id long, trip_id long, driver_id long, vehicle_id long, route_id long, "
                     "old_status string, new_status string, ts timestamp_ntz")


def trip_transitions(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Status changes, each once. An event carries its old and new status, so
    whether it is a transition needs no state and no order."""
    e = deduplicated(events, "ts", ["event_id"], delay)
    return e.filter(~F.col("old_status").eqNullSafe(F.col("new_status"))).drop("_et")


def _status_feed(t: Tables) -> DataFrame:
    return rq.status_events(t).select(*[c.split()[0] for c in TRANSITION_SCHEMA.split(", ")])


def run_stream_trip_transitions(t: Tables) -> DataFrame:
    """X03: transitions applied from the status stream; returns the
    ``trip_departed`` log rows they produce (= batch W10)."""
    spark = t.bookings.sparkSession
    out = scratch(spark, "x03-out")
    src, size = _source(t, _status_feed(t), "x03")
    run_to_end(trip_transitions(src).writeStream.outputMode("append")
               .format("parquet").option("path", out), scratch(spark, "x03-ckpt"), feed_bytes=size)
    return lc.departure_log(spark.read.schema(TRANSITION_SCHEMA).parquet(out))


def status_state(events: DataFrame, key: str, delay: str | None = None) -> DataFrame:
    """Triggers T6-T9 as order-free state per driver or vehicle: arrivals counted
    and the latest transition by (ts, event_id)."""
    e = trip_transitions(events, delay).filter(
        F.col("new_status").isin("departed", "arrived") & F.col(key).isNotNull())
    arrived = F.col("new_status") == "arrived"
    return e.groupBy(key).agg(
        F.count_if(arrived).alias("arrivals"),
        F.sum(F.when(arrived, F.coalesce("distance_km", F.lit(0)))).alias("km"),
        F.max_by("new_status", F.struct("ts", "event_id")).alias("last"))


def _with_distance(t: Tables, src: DataFrame) -> DataFrame:
    return src.join(materialized(t.routes.select("route_id", "distance_km")), "route_id", "left")


def run_stream_driver_status(t: Tables) -> DataFrame:
    """X03: driver status, completed trips and distance from the status stream (= batch W08)."""
    spark = t.bookings.sparkSession
    src, size = _source(t, _status_feed(t), "x03d")
    got = _run(spark, status_state(_with_distance(t, src), "driver_id"), "x03d", ["driver_id"], size).withColumnRenamed("driver_id", "_g")
    j = t.driver_details.join(got, F.col("driver_id") == F.col("_g"), "left")
    return j.select(
        "driver_id", "license_number",
        (F.col("trips_completed") + F.coalesce("arrivals", F.lit(0))).cast("int").alias("trips_completed"),
        (F.col("total_distance_driven") + F.coalesce("km", F.lit(0))).cast("decimal(10,2)").alias("total_distance_driven"),
        "delayed_trips",
        F.when(F.col("last") == "arrived", "available").when(F.col("last") == "departed", "on_trip")
        .otherwise(F.col("driver_status")).alias("driver_status"))


def run_stream_vehicle_status(t: Tables) -> DataFrame:
    """X03: vehicle status from the status stream (= batch W09)."""
    spark = t.bookings.sparkSession
    src, size = _source(t, _status_feed(t), "x03v")
    got = _run(spark, status_state(_with_distance(t, src), "vehicle_id"), "x03v", ["vehicle_id"], size).withColumnRenamed("vehicle_id", "_g")
    j = t.vehicles.join(got, F.col("vehicle_id") == F.col("_g"), "left")
    return j.select("vehicle_id", "plate_number",
                    F.when(F.col("last") == "arrived", "available").when(F.col("last") == "departed", "in_service")
                    .otherwise(F.col("vehicle_status")).alias("vehicle_status"))


# ---------------------------------------------------------------------- X04
def trip_state(updates: DataFrame) -> DataFrame:
    """Latest row per trip from a stream of trip snapshots (update mode)."""
    vals = [c for c in updates.columns if c not in ("trip_id", "_v")]
    return updates.groupBy("trip_id").agg(
        F.max_by(F.struct(*vals), F.col("_v")).alias("s")).select("trip_id", "s.*")


def _monitored(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` of a monitor for the changed trips, and a deletion for each that it no longer shows."""
    rows = written(rows)
    left = changed.select("trip_id").join(rows.select("trip_id"), "trip_id", "left_anti").withColumn("_gone", F.lit(True))
    return rows.withColumn("_gone", F.lit(False)).unionByName(left, allowMissingColumns=True)


def _queue_rows(t: Tables, batch: DataFrame) -> DataFrame:
    """The queue's rows of changed trips, a deletion for each that it does not show, and versions."""
    live = F.coalesce(F.col("trip_status").isin(*LIVE_TRIP), F.lit(False))
    off = batch.filter(~live).select("trip_id", "_version").unionByName(
        batch.filter(live).join(t.routes.select("route_id"), "route_id", "left_anti").select("trip_id", "_version"))
    return views.queue_status(t.replace(trips=batch), "_version").withColumn("_gone", F.lit(False)).unionByName(
        off.withColumn("_gone", F.lit(True)), allowMissingColumns=True)


def live_queue_table(t: Tables, path: str, history: bool = False, buckets: int = 16) -> tuple[KeyedTable, Callable]:
    """X04: the live queue as a table by trip, and the ``foreachBatch`` function that
    applies changed trips: a live trip's row is put in, another's is taken out. A
    row depends on its own trip and the small tables only, so a batch costs its
    own trips, and after each batch the table is the queue of that moment. Snapshots
    with a version ``_v`` may come in any order and more than once: the table keeps
    each trip's version, so no stream state is needed; others count as they come."""
    table = KeyedTable(t.trips.sparkSession, path, views.queue_status(t).schema, ["trip_id"], buckets, history=history, version="_version")
    apply = table.writer(rows=lambda batch: _queue_rows(t, batch), one_step=True)

    def write(batch: DataFrame, epoch: int) -> None:
        if "_v" in batch.columns:
            batch = trip_state(batch.withColumn("_version", F.col("_v").cast("bigint")))
        else:
            batch = batch.withColumn("_version", F.lit(epoch).cast("bigint"))
        apply(batch.select(*t.trips.columns, "_version"), epoch)
    return table, write


def _queue_feed(t: Tables) -> list[DataFrame]:
    """Two snapshots per trip: as queued (waiting, empty, not accepting) and as it is."""
    now = t.trips.withColumn("_v", F.lit(2))
    queued = (now.withColumn("trip_status", F.lit("waiting")).withColumn("seats_booked", F.lit(0))
              .withColumn("seats_available", F.col("capacity")).withColumn("is_accepting_bookings", F.lit(False))
              .withColumn("_v", F.lit(1)))
    return [queued, now]


def _small(t: Tables) -> Tables:
    """The tables that the monitors join with every batch, computed once."""
    return t.replace(**{n: materialized(getattr(t, n)) for n in ("routes", "vehicles", "users")})


def run_stream_live_queue(t: Tables) -> DataFrame:
    """X04: live queue, kept up to date by every micro-batch of trip snapshots."""
    spark = t.bookings.sparkSession
    t = t.replace(trips=materialized(t.trips))
    queued, now = _queue_feed(t)
    src, size = _source(t, now.unionByName(queued), "x04")
    table, write = live_queue_table(_small(t), scratch(spark, "x04-out"), buckets=state_partitions(spark, size))
    run_to_end(src.writeStream.foreachBatch(write), scratch(spark, "x04-ckpt"), feed_bytes=size)
    return table.snapshot()


def run_stream_live_queue_snapshots(t: Tables) -> DataFrame:
    """X04 as seen after each of two micro-batches: all trips queued, then as they are."""
    spark = t.bookings.sparkSession
    t = t.replace(trips=materialized(t.trips))
    folder, ckpt = scratch(spark, "x04s-feed"), scratch(spark, "x04s-ckpt")
    small, write = _small(t), None
    for part in _queue_feed(t):
        part.write.mode("append").parquet(folder)
        size = feed_size(spark, folder)[1]
        if write is None:
            table, write = live_queue_table(small, scratch(spark, "x04s-out"), history=True, buckets=state_partitions(spark, size))
        run_to_end(read_stream(spark, folder, part.schema).writeStream.foreachBatch(write), ckpt, feed_bytes=size)
    after = [table.snapshot(e).withColumn("micro_batch", F.lit(i)) for i, e in enumerate(table.committed())]
    return after[0].unionByName(after[1])


# ---------------------------------------------------------------------- X05
MONITOR_EVENT = "trip_id bigint, event_id bigint, seats bigint, _v bigint, trip_status string, queue_position int"


def monitor_events(changes: DataFrame, updates: DataFrame) -> DataFrame:
    """Booking changes and trip snapshots (``trip_id, trip_status, queue_position,
    _v``) as one kind of event with ``MONITOR_EVENT``'s columns. A snapshot's id
    comes from its trip and version, below zero."""
    cols = [c.split()[0] for c in MONITOR_EVENT.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in MONITOR_EVENT.split(", ")}
    seats = lc.seat_delta(F.col("old_status"), F.col("new_status"), F.col("seat_count"))
    a = changes.withColumn("seats", seats)
    b = updates.withColumn("event_id", -(F.col("trip_id") * 1000 + F.col("_v")))
    return reduce(DataFrame.unionByName, [
        x.select(*[(F.col(c) if c in x.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in cols]) for x in (a, b)])


def monitor_state(events: DataFrame) -> DataFrame:
    """X05: per trip the seats booked (order-free sum of T1-T3 deltas) and the
    latest status; each event counts once."""
    return events.dropDuplicates(["event_id"]).groupBy("trip_id").agg(
        F.coalesce(F.sum("seats"), F.lit(0)).cast("bigint").alias("seats_booked"),
        F.max(F.when(F.col("_v").isNotNull(), F.struct("_v", "trip_status", "queue_position"))).alias("s"))


def monitor_context(t: Tables) -> DataFrame:
    """What the seat monitor shows of each trip, whatever its seats and status."""
    return views.trip_context(t).select("trip_id", "route_id", "queue_position", "capacity", "trip_status", "origin", "destination", "plate_number")


def seat_monitor(t: Tables, state: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """The seat monitor's rows for trips in ``state``: those that are bookable.
    ``context``: ``monitor_context(t)``, if it is at hand."""
    st = state.select(F.col("trip_id").alias("_m"), F.col("seats_booked").alias("_booked"), "s")
    return _bookable((monitor_context(t) if context is None else context).join(st, F.col("trip_id") == F.col("_m")))


def _bookable(tr: DataFrame) -> DataFrame:
    """The monitor's rows of trips with their context, ``_booked`` seats and latest status ``s``."""
    tr = (tr.withColumn("trip_status", F.coalesce("s.trip_status", "trip_status"))
          .withColumn("queue_position", F.coalesce("s.queue_position", "queue_position")).filter(F.col("trip_status").isin(*BOOKABLE_TRIP)))
    sb = F.col("_booked").cast("bigint")
    return tr.select(
        "trip_id", "route_id", "queue_position", "capacity", sb.alias("seats_booked"), (F.col("capacity") - sb).cast("bigint").alias("seats_available"),
        "trip_status", "origin", "destination", "plate_number")


def seat_monitor_table(t: Tables, path: str, history: bool = False) -> tuple[KeyedTable, Callable]:
    """X05: the seat monitor as a table by trip, and the ``foreachBatch`` function
    that applies the trips whose seats or status changed."""
    none = t.trips.select("trip_id", F.lit(0).cast("bigint").alias("seats_booked"),
                          F.lit(None).cast("struct<_v:bigint,trip_status:string,queue_position:int>").alias("s"))
    context = materialized(monitor_context(t))
    table = KeyedTable(t.trips.sparkSession, path, seat_monitor(t, none, context).schema, ["trip_id"], history=history)
    table.seed(seat_monitor(t, none, context))
    return table, table.writer(rows=lambda batch: _monitored(seat_monitor(t, batch, context), batch))


def seat_monitor_tables(t: Tables, path: str, buckets: int = 16) -> tuple[KeyedTable, Callable, Callable]:
    """X05 without stream state: all trips with their context, seats and latest status
    by trip, the ``foreachBatch`` function that applies events (``MONITOR_EVENT``), each
    once however late a copy comes, and the function that shows the bookable trips."""
    spark = t.trips.sparkSession
    context = monitor_context(t)
    fixed = [c for c in context.columns if c != "trip_id"]
    trips = context.filter("trip_id is not null").select(
        "trip_id", F.struct(*fixed).alias("c"), F.lit(0).cast("bigint").alias("seats_booked"),
        F.lit(None).cast("struct<_v:bigint,trip_status:string,queue_position:int>").alias("s"))
    log = EventLog(spark, path + "/events", "event_id")
    schema = spark.createDataFrame([], trips.schema.simpleString()).schema  # with nulls everywhere
    table = KeyedTable(spark, path + "/trips", schema, ["trip_id"], buckets, fold={"c": F.max, "seats_booked": F.sum, "s": F.max})
    table.seed(trips, of=t.trips)

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch not in table.committed():
            now, fresh = log.add(batch, epoch)
            table.upsert(monitor_state(fresh), epoch, of=now)

    def shown(epoch: int | None = None) -> DataFrame:
        return _bookable(table.snapshot(epoch).filter("c is not null").select("trip_id", "c.*", F.col("seats_booked").alias("_booked"), "s"))
    return table, write, shown


def run_stream_seat_availability(t: Tables) -> DataFrame:
    """X05: seat monitor of bookable trips from the stream of booking changes and
    trip snapshots (first as boarding, then as they are)."""
    spark = t.bookings.sparkSession
    t = t.replace(trips=materialized(t.trips))
    snap = t.trips.select("trip_id", "trip_status", "queue_position", F.lit(2).cast("bigint").alias("_v"))
    boarding = snap.withColumn("trip_status", F.lit("boarding")).withColumn("_v", F.lit(1).cast("bigint"))
    feed = monitor_events(rq.booking_changes(t), boarding.unionByName(snap))
    src, size = _source(t, feed, "x05")
    _, write, shown = seat_monitor_tables(t, scratch(spark, "x05-out"), state_partitions(spark, size))
    run_to_end(src.writeStream.foreachBatch(write), scratch(spark, "x05-ckpt"), feed_bytes=size)
    return shown()


# ---------------------------------------------------------------------- X06
FEED_K = 20


def run_stream_recent_bookings(t: Tables, k: int = FEED_K) -> DataFrame:
    """X06: newest ``k`` paid bookings on boarding/full trips, kept by a
    ``foreachBatch`` top-k merge (previous top-k plus the batch, cut to k). The k
    rows are all that is kept: a copy of one of them is told by its id, and a
    booking that was not among them once can never be again."""
    spark = t.bookings.sparkSession
    src, _ = _source(t, t.bookings.filter(F.col("payment_status") == "paid"), "x06")
    tr = t.trips.filter(F.col("trip_status").isin("boarding", "full")).select(
        F.col("trip_id").alias("_t"), "route_id", "estimated_departure_time", "seats_available")
    r = t.routes.select("route_id", "destination")
    dims = materialized(tr.join(r, "route_id"))
    rows = (src.join(dims, F.col("trip_id") == F.col("_t"))
            .select("booking_id", "ticket_reference",
                    full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"),
                    "seat_count", "booking_type", "total_amount", "booking_date", "trip_id",
                    "destination", "estimated_departure_time", "seats_available"))
    out = scratch(spark, "x06-out")
    order = [F.col("booking_date").desc(), F.col("booking_id").desc()]

    def merge(batch: DataFrame, epoch_id: int) -> None:
        cur = batch
        if epoch_id > 0:  # every epoch writes its top-k; a missing or unreadable one is an error
            prev_path = f"{out}/_epoch={epoch_id - 1}"
            cur = batch.sparkSession.read.schema(batch.schema).parquet(prev_path).unionByName(batch)
        cur.dropDuplicates(["booking_id"]).orderBy(*order).limit(k).write.mode("overwrite").parquet(f"{out}/_epoch={epoch_id}")

    run_to_end(rows.writeStream.foreachBatch(merge), scratch(spark, "x06-ckpt"))
    last = spark.read.parquet(out)
    top = last.agg(F.max("_epoch")).first()[0]
    return last.filter(F.col("_epoch") == top).drop("_epoch")


# ---------------------------------------------------------------------- X07
ADMISSION_OUT = "request_id bigint, trip_id bigint, seat_count int, decision string, reason string"
DECIDED = ADMISSION_OUT + ", requested_at timestamp_ntz"
SEATS = "trip_id bigint, seats_left int, closes timestamp_ntz, last_ts timestamp_ntz, last_id bigint"


def admission_tables(trips: DataFrame, path: str, keep: dt.timedelta | None = None,
                     every: str = "yyyy-MM") -> tuple[KeyedTable, KeyedTable, Callable]:
    """X07: the decisions by request, the free seats by trip, and the
    ``foreachBatch`` function that decides a micro-batch of requests: online
    create_booking, exactly one row per request.

    A batch is decided as a whole by the rule of the batch job, in (requested_at,
    request_id) order, from the seats that earlier batches left, so a trip with a
    third of all requests is spread over tasks as there. What could not be fitted
    in any more, because a later request of its trip was decided before, is
    rejected as ``late`` and takes no seat. A request is told from its copies by
    its id, among the decisions in its own bucket of time (``every``, a date
    pattern): no ids are held in stream state, however late a copy comes.

    With ``keep`` a trip closes that long after its planned departure: later
    requests are rejected as ``departed``. Once a request from after that moment
    has been decided for any trip, the closed trip's seats are no longer held, and
    a request that arrives for it then is ``departed`` or ``late``. A trip without a
    planned departure, or without ``keep``, never closes.

    ``seats`` is written last, and both tables are read as they were before the
    batch, so a replay after a failure at any point decides the same again.
    """
    spark = trips.sparkSession
    decided = KeyedTable(spark, path + "/decisions", spark.createDataFrame([], DECIDED).schema, ["request_id"],
                         bucket_by=F.date_format("requested_at", every))
    seats = KeyedTable(spark, path + "/seats", spark.createDataFrame([], SEATS).schema, ["trip_id"])
    closes = F.lit(None).cast("timestamp_ntz") if keep is None else F.col("estimated_departure_time") + F.lit(keep)
    tr = trips.select(F.col("trip_id").alias("_t"), F.col("trip_status").alias("_st"), F.col("seats_available").cast("int").alias("_free"),
                      closes.cast("timestamp_ntz").alias("_closes"))
    n, at = F.col("seat_count"), F.struct("requested_at", "request_id")

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch not in seats.committed():
            with written_for(spark):
                decide(batch, epoch)

    def decide(batch: DataFrame, epoch: int) -> None:
        # Written first: what follows reads it several times, in the caller's session
        # (a stream's own has its few state partitions and does not adapt them).
        batch = written(batch.select("request_id", "trip_id", "seat_count", "requested_at"), spark).dropDuplicates(["request_id"])
        known = decided.near(batch, epoch - 1).select(F.col("request_id").alias("_k"))
        held = materialized(seats.snapshot(epoch - 1))
        horizon = F.lit(held.agg(F.max("last_ts")).first()[0]).cast("timestamp_ntz")  # one value
        before = held.select(F.col("trip_id").alias("_h"), "seats_left", F.col("last_ts"), F.col("last_id"))
        r = (batch.join(known, F.col("request_id") == F.col("_k"), "left_anti")
             .join(tr, F.col("trip_id") == F.col("_t"), "left").join(before, F.col("trip_id") == F.col("_h"), "left")
             .withColumn("_avail", F.coalesce("seats_left", "_free")))
        late = (F.col("_closes") < horizon) | (F.col("last_id").isNotNull() & (at <= F.struct(F.col("last_ts"), F.col("last_id"))))
        r = materialized(r.withColumn("_why", F.when(F.col("_t").isNull(), "unknown_trip")
                                      .when(~F.col("_st").isin(*BOOKABLE_TRIP), "not_accepting")
                                      .when(F.col("requested_at") > F.col("_closes"), "departed")
                                      .when(late, "late")
                                      .when(n.isNull() | (n < 1), "invalid_seat_count")
                                      .when(n > F.col("_avail"), "not_enough_seats")))
        taken = lc.first_come(r.filter("_why is null")).select(F.col("request_id").alias("_ok"))
        done = materialized(r.join(taken, F.col("request_id") == F.col("_ok"), "left"))
        ok = F.col("_ok").isNotNull()
        decided.upsert(done.select(
            "request_id", "trip_id", "seat_count", F.when(ok, "accepted").otherwise("rejected").alias("decision"),
            F.when(~ok, F.coalesce("_why", F.lit("not_enough_seats"))).alias("reason"), "requested_at"), epoch)
        # Requests that stood in line move their trip on; others leave it as it was.
        asked = done.filter("_why is null or _why in ('invalid_seat_count', 'not_enough_seats')").groupBy("trip_id").agg(
            (F.first("_avail") - F.sum(F.when(ok, n).otherwise(0))).cast("int").alias("seats_left"), F.first("_closes").alias("closes"),
            F.max(at).alias("_last")).select("trip_id", "seats_left", "closes", F.col("_last.requested_at").alias("last_ts"),
                                             F.col("_last.request_id").alias("last_id"))
        rest = held.join(asked.select("trip_id"), "trip_id", "left_anti").withColumn("_old", F.lit(True))
        now = materialized(rest.unionByName(asked.withColumn("_old", F.lit(False))))
        newest = F.lit(now.agg(F.max("last_ts")).first()[0]).cast("timestamp_ntz")  # one value
        gone = F.coalesce(F.col("closes") < newest, F.lit(False))
        seats.upsert(now.filter(~F.col("_old") | gone).withColumn("_gone", gone).drop("_old"), epoch)

    return decided, seats, write


ADMISSION_BATCHES = 4


def in_time_order(feed: DataFrame, ts_col: str, batches: int) -> list[DataFrame]:
    """``feed`` cut at quantiles of ``ts_col`` into ``batches`` parts (equal
    times in one part; nulls in the last)."""
    at = F.unix_timestamp(ts_col)
    cuts = sorted(set(feed.select(at.cast("double").alias("s")).approxQuantile("s", [k / batches for k in range(1, batches)], 0.01)))
    part = sum((F.when(at <= c, 0).otherwise(1) for c in cuts), F.lit(0))
    return [feed.filter(part == k) for k in range(len(cuts) + 1)]


#: How long after its planned departure a trip of the closing variant takes requests.
ADMISSION_KEEP = dt.timedelta(days=30)


def run_stream_admission_closing(t: Tables) -> DataFrame:
    """X07 with trips that close: the decisions, and no more seats are held than those
    of trips that the feed's last request could still have asked for."""
    return run_stream_admission(t, keep=ADMISSION_KEEP)


def run_stream_admission(t: Tables, batches: int = ADMISSION_BATCHES, keep: dt.timedelta | None = None) -> DataFrame:
    """X07 over a feed that arrives in requested_at order, one micro-batch after
    the other: each part is written and the query resumed from its checkpoint, so
    every batch but the first decides from the seats that those before it left.
    The feed spans years, so its decisions lie in buckets of a year."""
    spark = t.bookings.sparkSession
    t = t.replace(trips=materialized(t.trips))
    feed = materialized(rq.seat_requests(t))
    folder, out, ckpt = (scratch(spark, "x07-" + x) for x in ("feed", "out", "ckpt"))
    snap = materialized(rq.empty_trips(t).select("trip_id", "trip_status", "seats_available", "estimated_departure_time"))
    decided, _, write = admission_tables(snap, out, keep, every="yyyy")
    for part in in_time_order(feed, "requested_at", batches):
        part.write.mode("append").parquet(folder)
        src = read_stream(spark, folder, feed.schema)  # all new files: one batch
        run_to_end(src.writeStream.foreachBatch(write), ckpt)
    return decided.snapshot().drop("requested_at")


# ---------------------------------------------------------------------- X08
def action_counts(logs: DataFrame) -> DataFrame:
    """system_log rows per action type per hour (tumbling window)."""
    return logs.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour_start"), "action_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("actions"))


def action_count_tables(spark: SparkSession, schema, path: str) -> tuple[KeyedTable, KeyedTable, Callable]:
    """X08: log rows by id and month, their counts, and the ``foreachBatch`` function."""
    logs = KeyedTable(spark, path + "/logs", schema, ["log_id"], bucket_by=_month("created_at"))
    counts = KeyedTable(spark, path + "/counts", action_counts(spark.createDataFrame([], schema)).schema, ["hour_start", "action_type"],
                        bucket_by=_month("hour_start"))
    return logs, counts, counted_once(logs, counts, action_counts)


def run_stream_action_log(t: Tables) -> DataFrame:
    """X08: actions per hour from the stream of log rows."""
    spark = t.bookings.sparkSession
    rows = t.system_log.select("log_id", "action_type", "created_at")
    _, counts, write = action_count_tables(spark, rows.schema, scratch(spark, "x08-out"))
    src, _ = _source(t, rows.repartitionByRange("created_at"), "x08")
    run_to_end(src.writeStream.foreachBatch(write), scratch(spark, "x08-ckpt"))
    return counts.snapshot()
