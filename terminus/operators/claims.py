"""Unique values that change hands within a batch of writes.

A request gives a row (a user, a vehicle) a value (an e-mail, a plate) that no
other row may hold. One by one, in request order, a request is refused if another
row holds its value at that moment (``clash``), or if the row was changed before
in the batch (``duplicate_in_batch``); else the row takes the value and lets go of
the one it had. So a value is held by its first holder until that row's own
request is accepted, then free, then held by the first accepted claim for good.

Whether a request is accepted depends on earlier ones of its row, on earlier
claims of its value, and on earlier requests of the value's holder. The requests
are settled in rounds. A round needs three facts per row and per value, all of
them minima with map-side partial aggregates: when a request was accepted, when
the first undecided one comes, when the holder let go. It decides every request
whose earlier ones are decided as far as they matter. Where only one undecided
request matters (the holder's), the outcome is that request's outcome: such
requests point to it, and pointers are doubled every round, so a chain of n rows
that hand their values on is settled in about log2(n) rounds. Nothing is grouped
by value or by chain: a value that a third of the requests ask for costs a third
of the rows of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terminus.plans.ranking import top_k_within
from terminus.session import written

NEVER = (1 << 63) - 1


def _first(when: Column, at: str = "request_id") -> Column:
    return F.coalesce(F.min(F.when(when, F.col(at))), F.lit(NEVER))


def _facts(state: DataFrame, holders: DataFrame) -> DataFrame:
    """``state`` with what the accepted and undecided requests say about each
    request's row and value. ``_other`` is the earliest time at which the last of
    the value's other first holders may have let go (null: there is none)."""
    accepted, open_, leaves = F.col("ok"), F.col("ok").isNull(), ~F.col("value").eqNullSafe(F.col("held"))
    rows = state.groupBy("row").agg(
        _first(accepted).alias("_row_ok"), _first(open_).alias("_row_open"), F.count_if(open_).alias("_n_open"),
        _first(open_ & leaves).alias("_leave_open"), _first(accepted & leaves).alias("_leave_ok"))
    values = state.filter("value is not null").groupBy("value").agg(
        _first(accepted).alias("_value_ok"), F.max(F.when(accepted, F.col("row"))).alias("_claimed_by"), _first(open_).alias("_value_open"))
    let_go = (holders.join(rows.select("row", "_leave_ok", "_leave_open", "_n_open"), "row", "left")
              .withColumn("_gone", F.coalesce("_leave_ok", F.lit(NEVER)))
              .withColumn("_may_go", F.least("_gone", F.coalesce("_leave_open", F.lit(NEVER)))))
    sure = let_go.groupBy("held").agg(F.count("*").alias("_n_held"), F.count_if(F.col("_gone") < NEVER).alias("_n_gone"))
    last = top_k_within(let_go, ["held"], [F.col("_may_go").desc(), F.col("row")], 2, out="_nth").groupBy("held").agg(
        *[F.max(F.when(F.col("_nth") == n, F.struct("row", "_may_go", "_gone", "_n_open"))).alias(f"_h{n}") for n in (1, 2)])
    last = last.join(sure, "held").withColumnRenamed("held", "_held")
    j = (state.join(rows.select("row", "_row_ok", "_row_open"), "row").join(values, "value", "left")
         .join(last, F.col("value") == F.col("_held"), "left").drop("_held"))
    own = F.coalesce(F.col("_h1.row") == F.col("row"), F.lit(False))
    other = F.when(own, F.col("_h2")).otherwise(F.col("_h1"))
    return (j.withColumn("_holder", other).withColumn("_other", F.col("_holder._may_go"))
            .withColumn("_sure", F.coalesce(F.col("_n_gone") + F.col("value").eqNullSafe(F.col("held")).cast("int") >= F.col("_n_held"), F.lit(True)))
            .withColumn("_n_others", F.coalesce(F.col("_n_held"), F.lit(0)) - F.col("value").eqNullSafe(F.col("held")).cast("int"))
            .drop("_h1", "_h2"))


def _settled(state: DataFrame, holders: DataFrame) -> DataFrame:
    """One round: ``ok`` decided where it can be, else ``points_to`` where one
    undecided request has the same outcome."""
    t = F.col("request_id")
    j = _facts(state, holders)
    claimed, may_be_claimed = F.coalesce(F.col("_value_ok") < t, F.lit(False)), F.coalesce(F.col("_value_open") < t, F.lit(False))
    held = F.coalesce(F.col("_other") >= t, F.lit(False))
    free = F.col("_other").isNull() | ((F.col("_other") < t) & F.col("_sure"))
    clear = (F.col("_row_open") >= t) & ~claimed & ~may_be_claimed
    decided = (F.when(F.col("ok").isNotNull(), F.col("ok")).when((F.col("_row_ok") < t) | claimed | held, F.lit(False))
               .when(clear & free, F.lit(True)))
    one = clear & (F.col("_n_others") == 1) & (F.col("_holder._n_open") == 1) & (F.col("_holder._gone") == NEVER) & (F.col("_other") < t)
    j = j.select("request_id", "row", "value", "held", decided.alias("ok"),
                 F.when(decided.isNull(), F.coalesce("points_to", F.when(one, F.col("_other")))).alias("points_to"))
    target = j.select(F.col("request_id").alias("_to"), F.col("ok").alias("_ok"), F.col("points_to").alias("_next"))
    return (j.join(target, F.col("points_to") == F.col("_to"), "left")
            .select("request_id", "row", "value", "held", F.coalesce("ok", "_ok").alias("ok"), F.coalesce("_next", "points_to").alias("points_to")))


def settle(holders: DataFrame, claims: DataFrame) -> DataFrame:
    """``holders(row, held)`` before the batch and ``claims(request_id, row,
    value)`` -> ``request_id, outcome``: ``accepted``, ``clash`` or
    ``duplicate_in_batch``.

    ``request_id`` is unique and gives the order; rows without a value before (new
    ones) may be absent from ``holders``. A null value clashes with nothing. Values
    that several rows hold before the batch are free once all of them let go.
    """
    held = holders.filter("held is not null").select("row", "held")
    state = (claims.select(F.col("request_id").cast("bigint").alias("request_id"), "row", "value")
             .join(held, "row", "left").withColumn("ok", F.lit(None).cast("boolean")).withColumn("points_to", F.lit(None).cast("bigint")))
    asked = claims.select(F.col("value").alias("held")).distinct()
    holders = written(held.join(asked, "held", "left_semi"))
    state = written(state)
    while state.filter("ok is null").limit(1).count():
        state = written(_settled(state, holders))
    t = F.col("request_id")
    j = _facts(state, holders)
    clash = F.coalesce((F.col("_value_ok") < t) & (F.col("_claimed_by") != F.col("row")), F.lit(False)) | F.coalesce(F.col("_other") >= t, F.lit(False))
    return j.select("request_id", F.when(F.col("ok"), "accepted").when(clash, "clash").otherwise("duplicate_in_batch").alias("outcome"))
