"""Admin writes in bulk: updates, creations, deletes.

Every function takes snapshots and a request frame and returns a ``JobResult``:
one decision per request and the new snapshot. Requests are applied in
``request_id`` order; a batch changes a row once, later requests for it are
``duplicate_in_batch``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terminus.functions.scalar import ACTIVE_TRIP, folded
from terminus.operators.claims import settle
from terminus.operators.lifecycle import JobResult, _decide, _max_id, first_per_key, upsert
from terminus.plans.ranking import sequence_within
from terminus.session import written
from terminus.sources.tables import Tables


def _known(requests: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``_hit`` tells whether the request's key exists."""
    ids = target.select(F.col(key).alias("_id"), F.lit(True).alias("_hit")).distinct()
    return requests.join(ids, requests[key] == F.col("_id"), "left").drop("_id")


def _update(target: DataFrame, requests: DataFrame, key: str, unknown: str,
            taken: str | None = None, clash: str | None = None) -> JobResult:
    """UPDATE by ``key``. With ``taken`` that column must stay unique under the
    collation: a value that another row holds when its turn comes is refused with
    ``clash``; one that its holder has left before is free (claims.py)."""
    j = _known(requests, target, key)
    if taken:
        claims = j.filter("_hit").select("request_id", F.col(key).alias("row"), folded(taken).alias("value"))
        got = settle(target.select(F.col(key).alias("row"), folded(taken).alias("held")), claims)
        j = j.join(got, "request_id", "left").withColumn(
            "_reason", F.when(F.col("_hit").isNull(), unknown).when(F.col("outcome") == "clash", clash)
            .when(F.col("outcome") != "accepted", F.col("outcome")))
    else:
        j = j.withColumn("_reason", F.when(F.col("_hit").isNull(), unknown)).withColumn("_bad", F.col("_reason").isNotNull())
        j = first_per_key(j, key, ["_bad", "request_id"])
        j = j.withColumn("_reason", F.when(~F.col("_bad") & F.col("_dup"), "duplicate_in_batch").otherwise(F.col("_reason")))
    ok = F.col("_reason").isNull()
    decisions = j.select("request_id", key, *_decide(ok, F.col("_reason")))
    cols = [c for c in target.columns if c in requests.columns and c != key]
    return JobResult(decisions, upsert(target, j.filter(ok).select(key, *cols), key))


def _write(target: DataFrame, requests: DataFrame, key: str, unknown: str, unique: str, clash: str,
           defaults: dict[str, Column]) -> JobResult:
    """Creations (``key`` null) and updates in one batch, in ``request_id`` order:
    a value that an update leaves may go to a row created after it."""
    j = _known(requests, target, key).withColumn("kind", F.when(F.col(key).isNull(), "create").otherwise("update"))
    # A row to be created has no key yet: its request stands for it.
    row = F.struct(F.col(key).isNotNull().cast("int").alias("of"), F.coalesce(F.col(key), F.col("request_id")).cast("bigint").alias("id"))
    claims = j.filter("_hit or kind = 'create'").select("request_id", row.alias("row"), folded(unique).alias("value"))
    held = target.select(F.struct(F.lit(1).alias("of"), F.col(key).cast("bigint").alias("id")).alias("row"), folded(unique).alias("held"))
    j = j.join(settle(held, claims), "request_id", "left").withColumn(
        "_reason", F.when(F.col("outcome").isNull(), unknown).when(F.col("outcome") == "clash", clash)
        .when(F.col("outcome") != "accepted", F.col("outcome")))
    j = written(j)  # the new rows' numbers, the decisions and the snapshot all start from it
    ok = F.col("_reason").isNull()
    new = j.filter(ok & (F.col("kind") == "create"))
    seq = sequence_within(new.select(F.col("request_id").alias("_rid")), [], [F.col("_rid").asc()], out="_seq")
    j = (j.join(seq, F.col("request_id") == F.col("_rid"), "left")
         .withColumn(key, F.coalesce(F.col(key), _max_id(target, key) + F.col("_seq"))))
    decisions = j.select("request_id", "kind", *_decide(ok, F.col("_reason")), key)
    cols = [c for c in target.columns if c in requests.columns and c != key]
    changed = upsert(target, j.filter(ok & (F.col("kind") == "update")).select(key, *cols), key).select(target.columns)
    made = j.filter(ok & (F.col("kind") == "create"))
    for name, value in defaults.items():
        made = made.withColumn(name, value)
    return JobResult(decisions, changed.unionByName(made.select(
        *[F.col(c) if c in made.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns])))


def _create(target: DataFrame, requests: DataFrame, key: str, defaults: dict[str, Column],
            unique: str | None = None, clash: str | None = None) -> JobResult:
    """INSERT with ids that continue from the maximum, in request order."""
    j, reason = requests, F.lit(None).cast("string")
    if unique:
        have = target.select(folded(unique).alias("_have")).distinct()
        first = requests.groupBy(folded(unique).alias("_ff")).agg(F.min("request_id").alias("_first"))
        j = (requests.withColumn("_fold", folded(unique)).join(have, F.col("_fold") == F.col("_have"), "left")
             .join(first, F.col("_fold") == F.col("_ff"), "left"))
        reason = (F.when(F.col("_have").isNotNull(), clash)
                  .when(F.col("request_id") != F.col("_first"), "duplicate_in_batch"))
    j = j.withColumn("_reason", reason)
    ok = F.col("_reason").isNull()
    seq = sequence_within(j.filter(ok).select(F.col("request_id").alias("_rid")), [], [F.col("_rid").asc()], out="_seq")
    j = j.join(seq, F.col("request_id") == F.col("_rid"), "left").withColumn(key, _max_id(target, key) + F.col("_seq"))
    decisions = j.select("request_id", *_decide(ok, F.col("_reason")), key)
    for name, value in defaults.items():
        j = j.withColumn(name, value)
    new = j.filter(ok).select(*[F.col(c) if c in j.columns else F.lit(None).cast(target.schema[c].dataType).alias(c)
                                for c in target.columns])
    return JobResult(decisions, target.unionByName(new))


def update_users(users: DataFrame, requests: DataFrame) -> JobResult:
    return _update(users, requests, "user_id", "unknown_user", "email", "email_in_use")


def update_user_status(users: DataFrame, requests: DataFrame) -> JobResult:
    return _update(users, requests.select("request_id", "user_id", "status"), "user_id", "unknown_user")


def create_routes(routes: DataFrame, requests: DataFrame) -> JobResult:
    return _create(routes, requests, "route_id", {"status": F.lit("active")})


def update_routes(routes: DataFrame, requests: DataFrame) -> JobResult:
    return _update(routes, requests, "route_id", "unknown_route")


def create_vehicles(vehicles: DataFrame, requests: DataFrame) -> JobResult:
    return _create(vehicles, requests, "vehicle_id", {"vehicle_status": F.lit("available")}, "plate_number", "plate_exists")


def update_vehicles(vehicles: DataFrame, requests: DataFrame) -> JobResult:
    return _update(vehicles, requests, "vehicle_id", "unknown_vehicle", "plate_number", "plate_exists")


def write_users(users: DataFrame, requests: DataFrame, now: Column) -> JobResult:
    """Sign-ups (``user_id`` null) and profile updates of one batch."""
    role = F.coalesce(F.col("role"), F.lit("passenger")) if "role" in requests.columns else F.lit("passenger")
    return _write(users, requests, "user_id", "unknown_user", "email", "email_in_use",
                  {"status": F.lit("active"), "role": role, "created_at": now})


def write_vehicles(vehicles: DataFrame, requests: DataFrame) -> JobResult:
    """Creations (``vehicle_id`` null) and updates of one batch."""
    return _write(vehicles, requests, "vehicle_id", "unknown_vehicle", "plate_number", "plate_exists",
                  {"vehicle_status": F.lit("available")})


def _delete(target: DataFrame, requests: DataFrame, key: str, reason: Column, j: DataFrame) -> JobResult:
    """Decisions on ``j`` (the requests with what ``reason`` needs), and the rows that stay."""
    j = j.withColumn("_reason", reason).withColumn("_bad", F.col("_reason").isNotNull())
    j = first_per_key(j, key, ["_bad", "request_id"])
    # The second delete of a row finds nothing.
    j = j.withColumn("_reason", F.when(~F.col("_bad") & F.col("_dup"), "unknown").otherwise(F.col("_reason")))
    ok = F.col("_reason").isNull()
    decisions = j.select("request_id", key, *_decide(ok, F.col("_reason")))
    gone = decisions.filter("decision = 'accepted'").select(key)
    return JobResult(decisions, target.join(gone, key, "left_anti").select(target.columns), None, {"ids": gone})


def _used(trips: DataFrame, column: str) -> DataFrame:
    """Per route or vehicle: has it trips, and active ones?"""
    return (trips.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k"))
            .agg(F.max(F.col("trip_status").isin(*ACTIVE_TRIP)).alias("_active")))


def delete_routes(routes: DataFrame, trips: DataFrame, requests: DataFrame) -> JobResult:
    """A route with active trips is refused by the handler, one with any other
    trip by the foreign key (RESTRICT)."""
    j = _known(requests, routes, "route_id").join(_used(trips, "route_id"), F.col("route_id") == F.col("_k"), "left")
    reason = (F.when(F.col("_hit").isNull(), "unknown").when(F.col("_active"), "active_trips")
              .when(F.col("_k").isNotNull(), "restricted"))
    return _delete(routes, requests, "route_id", reason, j)


def delete_vehicles(vehicles: DataFrame, trips: DataFrame, requests: DataFrame) -> JobResult:
    """A vehicle with active trips is refused; other trips lose their vehicle
    (SET NULL): ``extra["trips"]`` is the trips' new snapshot."""
    j = _known(requests, vehicles, "vehicle_id").join(
        _used(trips, "assigned_vehicle_id"), F.col("vehicle_id") == F.col("_k"), "left")
    res = _delete(vehicles, requests, "vehicle_id",
                  F.when(F.col("_hit").isNull(), "unknown").when(F.col("_active"), "active_trips"), j)
    gone = res.extra["ids"].select(F.col("vehicle_id").alias("_gone"))
    res.extra["trips"] = (trips.join(gone, F.col("assigned_vehicle_id") == F.col("_gone"), "left")
                          .withColumn("assigned_vehicle_id", F.when(F.col("_gone").isNull(), F.col("assigned_vehicle_id")))
                          .drop("_gone"))
    return res


def delete_users(users: DataFrame, requests: DataFrame) -> JobResult:
    """``requests(request_id, user_id, requested_by)``; nobody deletes themselves."""
    reason = (F.when(F.col("_hit").isNull(), "unknown")
              .when(F.col("user_id") == F.col("requested_by"), "own_account"))
    return _delete(users, requests, "user_id", reason, _known(requests, users, "user_id"))


def user_cascade(t: Tables, users: DataFrame) -> dict[str, DataFrame]:
    """All tables after the users of the one-column frame ``users`` are deleted:
    ON DELETE CASCADE removes driver_details, notifications they created and
    user_notifications (of the users and of those notifications); SET NULL
    clears trips.driver_id and system_log.user_id."""
    gone = users.select(F.col("user_id").alias("_gone")).distinct()

    def without(df: DataFrame, key: str, ids: DataFrame = gone, name: str = "_gone") -> DataFrame:
        return df.join(ids, F.col(key) == F.col(name), "left_anti")

    def cleared(df: DataFrame, key: str) -> DataFrame:
        return (df.join(gone, F.col(key) == F.col("_gone"), "left")
                .withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone"))

    notes = t.notifications.join(gone, F.col("creator_id") == F.col("_gone"), "left_semi").select(
        F.col("notification_id").alias("_note"))
    return {
        "users": without(t.users, "user_id"), "driver_details": without(t.driver_details, "driver_id"),
        "notifications": without(t.notifications, "creator_id"),
        "user_notifications": without(without(t.user_notifications, "user_id"), "notification_id", notes, "_note"),
        "trips": cleared(t.trips, "driver_id"), "system_log": cleared(t.system_log, "user_id")}


def cascade_rows(t: Tables, users: DataFrame) -> DataFrame:
    """``user_cascade`` as rows (table_name, row_id, action): deleted or set_null."""
    after = user_cascade(t, users)
    ids = {"users": "user_id", "driver_details": "driver_id", "notifications": "notification_id",
           "user_notifications": "user_notification_id"}
    parts = [getattr(t, n).join(after[n].select(F.col(k).alias("_k")), F.col(k) == F.col("_k"), "left_anti").select(
        F.lit(n).alias("table_name"), F.col(k).alias("row_id"), F.lit("deleted").alias("action")) for n, k in ids.items()]
    for n, k, ref in (("trips", "trip_id", "driver_id"), ("system_log", "log_id", "user_id")):
        now = after[n].filter(F.col(ref).isNull()).select(F.col(k).alias("_k"))
        parts.append(getattr(t, n).filter(F.col(ref).isNotNull()).join(now, F.col(k) == F.col("_k"), "left_semi").select(
            F.lit(n).alias("table_name"), F.col(k).alias("row_id"), F.lit("set_null").alias("action")))
    return reduce(DataFrame.unionByName, parts)
