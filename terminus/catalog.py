"""Registry of named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Names follow SURVEY §2. Every query reads the domain tables of ``sf_dir``
(derived from the driver tables, or at rest) with the default parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terminus.operators import reports
from terminus.params import DEFAULT_PARAMS as P
from terminus.sources.tables import Tables, load

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(load(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


@register("src_tables")
def _src_tables(t: Tables) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
             .select(F.lit(n).alias("table_name"), "row_count") for n, df in t.as_dict().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("revenue_report")(lambda t: reports.revenue_report(t, P.start_date, P.end_date))
register("revenue_report_net")(
    lambda t: reports.revenue_report(t, P.start_date, P.end_date, net_of_cancelled=True))
register("revenue_total")(lambda t: reports.revenue_total(t, P.start_date, P.end_date))
register("daily_revenue")(lambda t: reports.daily_revenue(t, P.as_of))
register("trip_statistics")(lambda t: reports.trip_statistics(t, P.start_date, P.end_date))
register("driver_performance_report")(
    lambda t: reports.driver_performance_report(t, P.start_date, P.end_date))
register("driver_performance")(lambda t: reports.driver_performance(t, P.as_of))
register("users_by_role")(reports.users_by_role)
register("dashboard_kpis")(lambda t: reports.dashboard_kpis(t, P.as_of))
register("driver_stats")(lambda t: reports.driver_stats(t, P.as_of))
register("driver_earnings")(lambda t: reports.driver_earnings(t, P.as_of))
register("manifest_totals")(reports.manifest_totals)
register("queue_max_position")(reports.queue_max_position)
register("active_trip_counts")(reports.active_trip_counts)

# ---------------------------------------------------------------- §2.2 / §2.3
from terminus.operators import joins, lookups, nested, topk  # noqa: E402
from terminus.sources import requests as rq  # noqa: E402


register("users_list")(lookups.users_list)
register("user_profile")(lookups.user_profile)
register("routes_all")(lookups.routes_all)
register("routes_active")(lookups.routes_active)
register("vehicles_all")(lookups.vehicles_all)
register("vehicles_available")(lookups.vehicles_available)
register("bookings_by_name")(
    lambda t: lookups.bookings_by_name(t, rq.name_terms(t.bookings.sparkSession)))
register("bookings_by_email")(lambda t: lookups.bookings_by_email(t, rq.email_requests(t)))
register("bookings_by_ticket")(lambda t: lookups.bookings_by_ticket(t, rq.ticket_requests(t)))
register("passenger_contact")(lookups.passenger_contact)
register("trip_bookings")(lookups.trip_bookings)

register("queue_status")(joins.queue_status)
register("queue_by_route")(lambda t: joins.queue_by_route(t, rq.active_route_ids(t)))
register("active_bookings")(joins.active_bookings)
register("available_trips")(joins.available_trips)
register("trip_details")(joins.trip_details)
register("booking_details")(joins.booking_details)
register("booking_by_ticket_reference")(
    lambda t: joins.booking_by_ticket_reference(t, rq.ticket_requests(t)))
register("booking_tracking")(joins.booking_tracking)
register("seat_availability")(joins.seat_availability)
register("drivers_available")(joins.drivers_available)
register("driver_status")(joins.driver_status)
register("vehicle_status")(joins.vehicle_status)
register("driver_contact")(joins.driver_contact)
register("upcoming_trips")(joins.upcoming_trips)
register("system_logs")(joins.system_logs)
register("trips_unassigned")(joins.trips_unassigned)

# ---------------------------------------------------------------- §2.5 / §2.6
register("queue_nested")(nested.queue_nested_summary)
register("trip_manifest")(nested.trip_manifest_exploded)
register("recent_active_bookings")(topk.recent_active_bookings)
register("recent_bookings_feed")(topk.recent_bookings_feed)
register("cancellation_history")(topk.cancellation_history)
register("latest_payment")(topk.latest_payment)
register("next_trip")(topk.next_trip)
register("smart_trip_candidate")(topk.smart_trip_candidate)
register("current_trip")(topk.current_trip)
register("trip_history")(topk.trip_history)
register("driver_assignment_history")(topk.driver_assignment_history)
register("vehicle_assignment_history")(topk.vehicle_assignment_history)
register("notification_inbox")(topk.notification_inbox)

# ---------------------------------------------------------------- §2.9 lifecycle
from terminus.operators import lifecycle as lc  # noqa: E402
from terminus.operators import quality as qa  # noqa: E402


@register("admit_bookings")
def _admit(t: Tables) -> DataFrame:
    """W01: every booking replayed as a request against empty trips."""
    return lc.admit_bookings(rq.empty_trips(t), rq.booking_requests(t), t.bookings, t.payment_log,
                             P.now).decisions


@register("admit_smart_bookings")
def _admit_smart(t: Tables) -> DataFrame:
    """W02: every booking replayed as a route-level smart request against empty trips."""
    return lc.admit_smart_bookings(rq.empty_trips(t), rq.booking_requests(t)).decisions


register("seat_ledger")(lambda t: lc.seat_ledger(t.trips, rq.booking_changes(t)))
register("seat_ledger_running")(lambda t: lc.seat_ledger_running(rq.booking_changes(t)))
register("mark_full_trips")(lambda t: lc.mark_full_trips(t.trips, rq.booking_changes(t)))
register("enqueue_trips")(
    lambda t: lc.enqueue_trips(t.trips, t.routes, t.vehicles, t.users, rq.new_trips(t), P.now).decisions)
register("advance_queue")(
    lambda t: lc.live_queue_after(lc.advance_queue(t.trips, rq.departures(t, P.now), "intended")))
register("advance_queue_literal")(
    lambda t: lc.live_queue_after(lc.advance_queue(t.trips, rq.departures(t, P.now), "literal")))
register("arrive_trips")(lambda t: lc.arrive_trips(t.trips, rq.arrivals(t)).decisions)
register("driver_rollup")(lambda t: lc.driver_rollup(t.driver_details, rq.status_events(t), t.routes))
register("vehicle_rollup")(lambda t: lc.vehicle_rollup(t.vehicles, rq.status_events(t)))
register("departure_log")(lambda t: lc.departure_log(rq.status_events(t)))
register("transition_log")(lambda t: lc.transition_log(rq.trip_snapshots(t), ["ts", "seq"]).select(
    "trip_id", "old_status", "trip_status", "ts"))
register("cancel_bookings")(lambda t: lc.cancel_bookings(t.bookings, rq.cancel_requests(t)).decisions)
register("reassign_vehicles")(
    lambda t: lc.reassign_vehicles(t.trips, t.vehicles, rq.reassignments(t)).decisions)
register("reassign_drivers")(
    lambda t: lc.reassign_drivers(t.trips, t.users, t.driver_details, rq.reassignments(t)).decisions)
register("reassign_vehicles_sequence")(
    lambda t: lc.reassign_vehicles(t.trips, t.vehicles, rq.reassignment_sequence(t)).decisions)
register("reassign_drivers_sequence")(
    lambda t: lc.reassign_drivers(t.trips, t.users, t.driver_details, rq.reassignment_sequence(t)).decisions)
register("mark_notifications_read")(
    lambda t: lc.mark_notifications_read(t.user_notifications, rq.read_marks(t)))
register("deletable_entities")(lambda t: lc.deletable_entities(t.routes, t.vehicles, t.trips))
register("upsert_entities")(lambda t: lc.register_users(t.users, rq.registrations(t), P.now).decisions)

register("integrity_audit")(qa.integrity_audit)
register("cascade_delete")(lambda t: qa.cascade_delete(
    t, t.users.filter(F.col("status") == "blocked"), t.trips.filter(F.col("trip_status") == "cancelled"),
    t.vehicles.filter(F.col("vehicle_status") == "retired"), t.routes.filter(F.col("status") == "inactive")))
from terminus.operators import entities as en  # noqa: E402

register("update_users")(lambda t: en.update_users(t.users, rq.user_updates(t)).decisions)
register("update_users_snapshot")(
    lambda t: en.update_users(t.users, rq.user_updates(t)).snapshot.select("user_id", "firstname", "email", "status"))
register("update_user_status")(lambda t: en.update_user_status(t.users, rq.user_updates(t)).snapshot.select("user_id", "status"))
register("create_routes")(lambda t: en.create_routes(t.routes, rq.new_routes(t)).snapshot)
register("update_routes")(lambda t: en.update_routes(t.routes, rq.route_updates(t)).decisions)
register("update_routes_snapshot")(lambda t: en.update_routes(t.routes, rq.route_updates(t)).snapshot)
register("create_vehicles")(lambda t: en.create_vehicles(t.vehicles, rq.new_vehicles(t)).decisions)
register("update_vehicles")(lambda t: en.update_vehicles(t.vehicles, rq.vehicle_updates(t)).decisions)
from terminus.operators import cascade as ca  # noqa: E402


def _cascade(t: Tables) -> DataFrame:
    """Blocked users, cancelled trips, retired vehicles and inactive routes are deleted."""
    return ca.cascade_effects(t, {
        "users": t.users.filter(F.col("status") == "blocked").select("user_id"),
        "trips": t.trips.filter(F.col("trip_status") == "cancelled").select("trip_id"),
        "vehicles": t.vehicles.filter(F.col("vehicle_status") == "retired").select("vehicle_id"),
        "routes": t.routes.filter(F.col("status") == "inactive").select("route_id")})


register("cascade_effects")(_cascade)
register("cascade_trips_after")(lambda t: ca.after_cascade(t, _cascade(t)).trips.select(
    "trip_id", "route_id", "assigned_vehicle_id", "driver_id"))
register("write_vehicles")(lambda t: en.write_vehicles(t.vehicles, rq.vehicle_batch(t)).decisions)
register("write_vehicles_snapshot")(lambda t: en.write_vehicles(t.vehicles, rq.vehicle_batch(t)).snapshot)
register("write_users")(lambda t: en.write_users(t.users, rq.user_batch(t), F.lit(str(P.now)).cast("timestamp_ntz")).decisions)
register("write_users_snapshot")(lambda t: en.write_users(t.users, rq.user_batch(t), F.lit(str(P.now)).cast("timestamp_ntz")).snapshot)
register("delete_routes")(lambda t: en.delete_routes(t.routes, t.trips, rq.route_deletes(t)).decisions)
register("delete_vehicles")(lambda t: en.delete_vehicles(t.vehicles, t.trips, rq.vehicle_deletes(t)).decisions)
register("delete_vehicles_trips")(lambda t: en.delete_vehicles(t.vehicles, t.trips, rq.vehicle_deletes(t)).extra["trips"].select(
    "trip_id", "assigned_vehicle_id"))
register("delete_users")(lambda t: en.delete_users(t.users, rq.user_deletes(t)).decisions)
register("cascade_delete_rows")(lambda t: en.cascade_rows(t, t.users.filter(F.col("status") == "blocked")))


def _validate(kind: str) -> Callable[[Tables], DataFrame]:
    return lambda t: qa.validation_error_counts(rq.validation_requests(t, kind), kind)


for _kind in qa.RULES:
    register(f"validate_{_kind}")(_validate(_kind))
register("validate_requests")(
    lambda t: qa.validation_error_counts(rq.booking_requests(t), "walk_in_booking"))

# ---------------------------------------------------------------- §2.10 streaming
from terminus.streaming import jobs as sj  # noqa: E402

register("stream_daily_revenue")(sj.run_stream_daily_revenue)
register("stream_seat_ledger")(sj.run_stream_seat_ledger)
register("stream_trip_transitions")(sj.run_stream_trip_transitions)
register("stream_driver_status")(sj.run_stream_driver_status)
register("stream_vehicle_status")(sj.run_stream_vehicle_status)
register("stream_live_queue")(sj.run_stream_live_queue)
register("stream_live_queue_snapshots")(sj.run_stream_live_queue_snapshots)
register("stream_seat_availability")(sj.run_stream_seat_availability)
register("stream_recent_bookings")(sj.run_stream_recent_bookings)
register("stream_admission")(sj.run_stream_admission)
register("stream_admission_closing")(sj.run_stream_admission_closing)
register("stream_action_log")(sj.run_stream_action_log)

# ---------------------------------------------------------------- §2.1 / §2.8
from terminus.functions.surface import scalar_surface  # noqa: E402
from terminus.plans import views as vw  # noqa: E402
from terminus.sources import sinks  # noqa: E402
from terminus.streaming.feed import read_stream, run_to_end, scratch, write_feed  # noqa: E402
from terminus.streaming.keyed import KeyedTable  # noqa: E402

register("scalar_surface")(lambda t: scalar_surface(t, P.as_of))


@register("src_views")
def _src_views(t: Tables) -> DataFrame:
    """Register the four views and count their rows through ``spark.sql``."""
    spark = t.bookings.sparkSession
    vw.register_views(t, P.as_of)
    return spark.sql("""
        SELECT 'view_active_bookings' AS view_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM view_active_bookings
        UNION ALL SELECT 'view_daily_revenue', COUNT(*) FROM view_daily_revenue
        UNION ALL SELECT 'view_driver_performance', COUNT(*) FROM view_driver_performance
        UNION ALL SELECT 'view_queue_status', COUNT(*) FROM view_queue_status""")


@register("src_event_stream")
def _src_event_stream(t: Tables) -> DataFrame:
    """The booking change feed written as files and read back as a stream."""
    spark = t.bookings.sparkSession
    feed = rq.booking_changes(t)
    folder = write_feed(feed, scratch(spark, "events-feed"))
    out = scratch(spark, "events-out")
    run_to_end(read_stream(spark, folder, feed.schema, 4).writeStream.format("parquet")
               .option("path", out), scratch(spark, "events-ckpt"))
    return spark.read.schema(feed.schema).parquet(out)


@register("sink_append_log")
def _sink_append_log(t: Tables) -> DataFrame:
    """Cancellation and departure log rows appended to a month-partitioned log."""
    spark = t.bookings.sparkSession
    path = scratch(spark, "system-log")
    sinks.append_log(lc.cancel_bookings(t.bookings, rq.cancel_requests(t)).log, path, "cancellations")
    sinks.append_log(lc.departure_log(rq.status_events(t)).select(*sinks.LOG_COLUMNS), path, "departures")
    return spark.read.parquet(path).select(*sinks.LOG_COLUMNS, "log_month")


@register("sink_append_log_stream")
def _sink_append_log_stream(t: Tables) -> DataFrame:
    """The same rows as a stream of files, appended in micro-batches to a log that is compacted by month."""
    spark = t.bookings.sparkSession
    rows = lc.cancel_bookings(t.bookings, rq.cancel_requests(t)).log.select(*sinks.LOG_COLUMNS).unionByName(
        lc.departure_log(rq.status_events(t)).select(*sinks.LOG_COLUMNS))
    folder = write_feed(rows, scratch(spark, "log-feed"))
    log = sinks.AppendLog(spark, scratch(spark, "log-out"), rows.schema)
    run_to_end(sinks.append_log_stream(read_stream(spark, folder, rows.schema, 4), log, "actions", compact_every=2, most=1),
               scratch(spark, "log-ckpt"))
    return log.read()


@register("sink_upsert")
def _sink_upsert(t: Tables) -> DataFrame:
    """Accepted vehicle reassignments applied to trips by key."""
    res = lc.reassign_vehicles(t.trips, t.vehicles, rq.reassignments(t))
    ch = res.accepted.select("trip_id", F.col("vehicle_id").alias("assigned_vehicle_id"), "capacity",
                             "seats_available", "trip_status")
    return sinks.upsert(t.trips, ch, "trip_id").select(
        "trip_id", "assigned_vehicle_id", "capacity", "seats_booked", "seats_available", "trip_status")


@register("sink_upsert_stream")
def _sink_upsert_stream(t: Tables) -> DataFrame:
    """The same changes as a stream of files into a keyed table that was seeded with the trips."""
    spark = t.bookings.sparkSession
    res = lc.reassign_vehicles(t.trips, t.vehicles, rq.reassignments(t))
    ch = res.accepted.select("trip_id", F.col("vehicle_id").alias("assigned_vehicle_id"), "capacity", "seats_available", "trip_status")
    cols = ["trip_id", "assigned_vehicle_id", "capacity", "seats_booked", "seats_available", "trip_status"]
    table = KeyedTable(spark, scratch(spark, "upsert-out"), t.trips.select(*cols).schema, ["trip_id"])
    table.seed(t.trips)
    folder = write_feed(ch, scratch(spark, "upsert-feed"))
    run_to_end(sinks.upsert_stream(read_stream(spark, folder, ch.schema, 4), table), scratch(spark, "upsert-ckpt"))
    return table.snapshot()


@register("sink_json_report")
def _sink_json_report(t: Tables) -> DataFrame:
    """Each route's queue page as a ``{success, count, data}`` JSON document,
    checked by reading fields back out of the text."""
    docs = sinks.json_report(nested.queue_nested(t), ["route_id", "page"])
    j = F.col("json")
    return docs.select(
        "route_id", "page",
        F.get_json_object(j, "$.success").alias("success"),
        F.get_json_object(j, "$.count").cast("bigint").alias("n_trips"),
        F.get_json_object(j, "$.data.destination").alias("destination"),
        F.get_json_object(j, "$.data.trips[0].trip_id").cast("bigint").alias("first_trip_id"),
        F.length(j).isNotNull().alias("has_body"))
