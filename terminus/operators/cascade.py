"""What deleting rows of any table does to all others.

The foreign keys form a graph without cycles. Its tables are visited parents
first; a table is read once, with its keys only, and probed with the ids that are
gone from each of its parents. A row goes if it was asked for or if a parent it
hangs on by CASCADE goes; a row that stays loses the references that SET NULL
clears. Only affected rows are kept between the steps (written once each), so the
work after the scans follows the size of the deletion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.session import checkpoint_dir
from terminus.sources.tables import Tables

# The primary keys and foreign keys of the domain tables.
PRIMARY_KEYS = {
    "users": "user_id", "routes": "route_id", "vehicles": "vehicle_id", "trips": "trip_id", "bookings": "booking_id",
    "payment_log": "payment_id", "driver_details": "driver_id", "notifications": "notification_id",
    "user_notifications": "user_notification_id", "system_log": "log_id",
}
FOREIGN_KEYS = [
    ("bookings", "trip_id", "trips", "CASCADE"),
    ("driver_details", "driver_id", "users", "CASCADE"),
    ("notifications", "creator_id", "users", "CASCADE"),
    ("payment_log", "booking_id", "bookings", "CASCADE"),
    ("payment_log", "trip_id", "trips", "CASCADE"),
    ("system_log", "user_id", "users", "SET NULL"),
    ("trips", "route_id", "routes", "RESTRICT"),
    ("trips", "assigned_vehicle_id", "vehicles", "SET NULL"),
    ("trips", "driver_id", "users", "SET NULL"),
    ("user_notifications", "user_id", "users", "CASCADE"),
    ("user_notifications", "notification_id", "notifications", "CASCADE"),
]
EFFECT = ["table_name", "row_id", "action", "column_name"]


def visit_order(keys: list[tuple[str, str, str, str]] = FOREIGN_KEYS) -> list[str]:
    """Tables, parents before their children."""
    left = {t: {p for c, _, p, _ in keys if c == t} for t in PRIMARY_KEYS}
    out: list[str] = []
    while left:
        ready = [t for t, parents in left.items() if not parents - set(out)]
        if not ready:
            raise ValueError("foreign keys form a cycle")
        out += ready
        left = {t: p for t, p in left.items() if t not in ready}
    return out


def restricted_roots(t: Tables, asked: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table with RESTRICT children: the asked ids that a child row holds.

    Such tables are reached by no CASCADE, so only rows asked for can be held."""
    out = {}
    for child, column, parent, action in FOREIGN_KEYS:
        if action == "RESTRICT" and parent in asked:
            if any(c == parent and a == "CASCADE" for c, _, _, a in FOREIGN_KEYS):
                raise NotImplementedError(f"{parent} is both reached by CASCADE and held by RESTRICT")
            held = getattr(t, child).select(F.col(column).alias("id")).filter("id is not null").distinct()
            held = asked[parent].join(held, "id", "left_semi")
            out[parent] = held if parent not in out else out[parent].union(held).distinct()
    return out


def cascade_effects(t: Tables, roots: dict[str, DataFrame]) -> DataFrame:
    """``roots``: table name -> one-column frame of the ids to delete. Returns one
    row per affected row: ``table_name, row_id, action, column_name``.

    ``deleted``: asked for, or by CASCADE. ``set_null``: the row stays and loses
    ``column_name``. ``restricted``: asked for, but a child holds it by RESTRICT as
    the tables are before the batch; it stays, and nothing follows from it. Ids
    that do not exist, nulls and repeated ids have no effect.
    """
    unknown = set(roots) - set(PRIMARY_KEYS)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    spark = t.users.sparkSession
    checkpoint_dir(spark)
    asked = {n: df.select(F.col(df.columns[0]).alias("id")).filter("id is not null").distinct() for n, df in roots.items()}
    held = restricted_roots(t, asked)
    gone: dict[str, DataFrame] = {}
    effects = []
    for name in visit_order():
        key = PRIMARY_KEYS[name]
        mine = [(c, p, a) for child, c, p, a in FOREIGN_KEYS if child == name and a != "RESTRICT" and p in gone]
        if name not in asked and not mine:
            continue
        j = getattr(t, name).select(F.col(key).alias("row_id"), *[F.col(c).alias(f"fk_{c}") for c, _, _ in mine])
        if name in asked:
            j = j.join(asked[name].select(F.col("id").alias("_id"), F.lit(True).alias("_asked")), F.col("row_id") == F.col("_id"), "left").drop("_id")
            if name in held:
                j = j.join(held[name].select(F.col("id").alias("_id"), F.lit(True).alias("_held")), F.col("row_id") == F.col("_id"), "left").drop("_id")
        for c, p, _ in mine:
            j = j.join(gone[p].select(F.col("id").alias("_id"), F.lit(True).alias(f"hit_{c}")), F.col(f"fk_{c}") == F.col("_id"), "left").drop("_id")
        no = F.lit(False)
        restricted = F.coalesce("_held", no) if name in held else no
        dies = reduce(lambda a, b: a | b, [F.coalesce(f"hit_{c}", no) for c, _, a in mine if a == "CASCADE"],
                      F.coalesce("_asked", no) if name in asked else no)
        acts = [F.when(restricted, F.struct(F.lit("restricted").alias("action"), F.lit(None).cast("string").alias("column_name")))
                .when(dies, F.struct(F.lit("deleted").alias("action"), F.lit(None).cast("string").alias("column_name")))]
        acts += [F.when(~dies & F.coalesce(f"hit_{c}", no), F.struct(F.lit("set_null").alias("action"), F.lit(c).alias("column_name")))
                 for c, _, a in mine if a == "SET NULL"]
        rows = (j.withColumn("_e", F.explode(F.filter(F.array(*acts), lambda e: e.isNotNull())))
                .select(F.lit(name).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), "_e.action", "_e.column_name").checkpoint())
        effects.append(rows)
        gone[name] = rows.filter("action = 'deleted'").select(F.col("row_id").alias("id"))
    if not effects:
        return spark.createDataFrame([], "table_name string, row_id bigint, action string, column_name string")
    return reduce(DataFrame.unionByName, effects)


def after_cascade(t: Tables, effects: DataFrame) -> Tables:
    """The tables after ``effects`` of ``cascade_effects``."""
    def after(name: str) -> DataFrame:
        key, df = PRIMARY_KEYS[name], getattr(t, name)
        mine = effects.filter(F.col("table_name") == name)
        left = df.join(mine.filter("action = 'deleted'").select(F.col("row_id").alias(key)), key, "left_anti").select(df.columns)
        cleared = [c for child, c, _, a in FOREIGN_KEYS if child == name and a == "SET NULL"]
        if cleared:
            per_row = mine.filter("action = 'set_null'").groupBy(F.col("row_id").alias("_rid")).agg(
                *[F.max(F.col("column_name") == c).alias(f"_null_{c}") for c in cleared])
            left = left.join(per_row, F.col(key) == F.col("_rid"), "left").select(
                *[(F.when(~F.coalesce(f"_null_{c}", F.lit(False)), F.col(c)).alias(c) if c in cleared else F.col(c)) for c in df.columns])
        return left

    return t.replace(**{n: after(n) for n in PRIMARY_KEYS})
