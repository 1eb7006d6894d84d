"""Bookings by ticket reference: trips asked for as a whole, in part and not at all."""

from pyspark.sql import functions as F

from terminus.operators import joins


def _exchanged(plan, column):
    """Rows written by the exchanges (of an executed plan) that carry ``column``."""
    name = plan.nodeName()
    own = 0
    if name == "Exchange" and any(plan.output().apply(i).name() == column for i in range(plan.output().size())):
        own = plan.metrics().apply("shuffleRecordsWritten").value()
    return own + sum(_exchanged(plan.children().apply(i), column) for i in range(plan.children().size()))


def _tables(spark, tables):
    b, t = tables.bookings.checkpoint(), tables.trips.checkpoint()
    ids = [r.trip_id for r in b.groupBy("trip_id").count().filter("count >= 3").orderBy("trip_id").limit(4).collect()]
    first = {i: b.filter(F.col("trip_id") == i).agg(F.min("booking_id")).first()[0] for i in ids}
    lost = b.withColumn("ticket_reference", F.when(F.col("booking_id") == first[ids[3]], F.lit(None)).otherwise(F.col("ticket_reference")))
    twice = lost.unionByName(lost.filter(F.col("trip_id").isin(ids[:2])))
    return tables.replace(bookings=twice.checkpoint(), trips=t, **{n: getattr(tables, n).checkpoint() for n in ("routes", "vehicles", "users")}), ids, first


def test_whole_trips_parts_of_trips_and_odd_references(spark, tables):
    t, ids, first = _tables(spark, tables)
    b = t.bookings
    asked = (b.filter(F.col("trip_id").isin(ids[0], ids[3])).select(F.concat(F.lower("ticket_reference"), F.lit("  ")).alias("ticket_reference"))
             .unionByName(b.filter(F.col("booking_id") == first[ids[1]]).select("ticket_reference"))
             .unionByName(spark.createDataFrame([(None,), ("nobody's",)], "ticket_reference string")))
    got = sorted(map(str, joins.booking_by_ticket_reference(t, asked).collect()))
    want = [str(r) for r in joins.booking_details(t).collect()
            if r.trip_id == ids[0] or r.trip_id == ids[3] and r.ticket_reference or r.booking_id == first[ids[1]]]
    assert got == sorted(want) and sum(f"booking_id={first[ids[1]]}," in r for r in got) == 2
    assert joins.booking_by_ticket_reference(t, asked.limit(0)).count() == 0


def test_bookings_of_whole_trips_are_shuffled_by_trip_only(spark, tables):
    t, _, _ = _tables(spark, tables)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        whole = t.replace(bookings=t.bookings.filter("ticket_reference is not null").checkpoint())
        df = joins.booking_by_ticket_reference(whole, whole.bookings.select("ticket_reference"))
        n = whole.bookings.count()
        assert len(df.collect()) == n
        assert 0 < _exchanged(df._jdf.queryExecution().executedPlan(), "passenger_email") <= n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
