"""Integrity audit on tables with planted violations, against plain Python."""

import random

from terminus.operators import quality as qa
from terminus.sources.schemas import SCHEMAS
from terminus.sources.tables import Tables

KEYS = {"users": "user_id", "routes": "route_id", "vehicles": "vehicle_id", "trips": "trip_id", "bookings": "booking_id",
        "notifications": "notification_id"}
REFS = [("fk_trips_route", "trips", "route_id", "routes"), ("fk_trips_vehicle", "trips", "assigned_vehicle_id", "vehicles"),
        ("fk_trips_driver", "trips", "driver_id", "users"), ("fk_bookings_trip", "bookings", "trip_id", "trips"),
        ("fk_payment_log_booking", "payment_log", "booking_id", "bookings"), ("fk_payment_log_trip", "payment_log", "trip_id", "trips"),
        ("fk_driver_details_user", "driver_details", "driver_id", "users"), ("fk_notifications_creator", "notifications", "creator_id", "users"),
        ("fk_system_log_user", "system_log", "user_id", "users"),
        ("fk_user_notifications_user", "user_notifications", "user_id", "users"),
        ("fk_user_notifications_notification", "user_notifications", "notification_id", "notifications")]
UNIQUE = [("uq_bookings_ticket_reference", "bookings", ("ticket_reference",)), ("uq_users_email", "users", ("email",)),
          ("uq_driver_details_license_number", "driver_details", ("license_number",)),
          ("uq_vehicles_plate_number", "vehicles", ("plate_number",)),
          ("uq_user_notifications_user_notification", "user_notifications", ("user_id", "notification_id"))]
TEXTS = ["a", "A ", "\u00c1", "b", "B", "c", "d", None]


def made(rng, n):
    """Random rows; ids are distinct, references go beyond the keys there are."""
    data = {}
    for table, schema in SCHEMAS.items():
        rows = []
        for i in range(n):
            row = dict.fromkeys(schema.fieldNames())
            for c in row:
                if c.endswith("_id"):
                    row[c] = rng.choice([None, *range(n + 3)])
            for c in ("email", "plate_number", "license_number", "ticket_reference"):
                if c in row:
                    row[c] = rng.choice(TEXTS)
            if table == "trips":
                row |= {"capacity": 9, "seats_booked": rng.randrange(4), "seats_available": rng.choice([-1, 6, 7, 8, 9]),
                        "fare_price": rng.choice([10, 20])}
            if table == "bookings":
                row |= {"seat_count": rng.randrange(1, 3), "total_amount": rng.choice([10, 20, 40]),
                        "payment_status": rng.choice(["paid", "cancelled"])}
            if table in KEYS:
                row[KEYS[table]] = i
            rows.append(row)
        data[table] = rows
    return data


def plain(data):
    out = {}
    ids = {t: {r[k] for r in data[t]} for t, k in KEYS.items()}
    for rule, child, column, parent in REFS:
        out[rule] = sum(r[column] is not None and r[column] not in ids[parent] for r in data[child])
    fold = lambda v: v.rstrip().lower().replace("\u00e1", "a") if isinstance(v, str) else v
    for rule, table, columns in UNIQUE:
        values = [tuple(fold(r[c]) for c in columns) for r in data[table]]
        out[rule] = sum(values.count(v) > 1 for v in set(values))
    trips = {r["trip_id"]: r for r in data["trips"]}
    paid = dict.fromkeys(trips, 0)
    for b in data["bookings"]:
        if b["trip_id"] in paid and b["payment_status"] == "paid":
            paid[b["trip_id"]] += b["seat_count"]
    out["inv_trip_seats_booked_equals_paid_seats"] = sum(r["seats_booked"] != paid[i] for i, r in trips.items())
    out["inv_trip_seats_available_non_negative"] = sum(r["seats_available"] < 0 for r in trips.values())
    out["inv_trip_seats_available_generated"] = sum(r["seats_available"] != r["capacity"] - r["seats_booked"] for r in trips.values())
    out["inv_booking_amount_equals_fare_times_seats"] = sum(
        b["total_amount"] != trips[b["trip_id"]]["fare_price"] * b["seat_count"] for b in data["bookings"] if b["trip_id"] in trips)
    return out


def framed(spark, data):
    from decimal import Decimal
    money = {"fare_price", "total_amount"}
    return Tables(**{t: spark.createDataFrame([tuple(Decimal(v) if c in money and v is not None else v for c, v in r.items())
                                               for r in rows], SCHEMAS[t]) for t, rows in data.items()})


def test_audit_equals_plain_counts(spark):
    for seed, n in ((1, 12), (2, 40)):
        data = made(random.Random(seed), n)
        got = {r.rule: r.violations for r in qa.integrity_audit(framed(spark, data)).collect()}
        assert got == plain(data)
        assert sum(v > 0 for v in got.values()) > 14


def test_audit_of_empty_tables(spark):
    empty = Tables(**{t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})
    got = qa.integrity_audit(empty).collect()
    assert len(got) == 20 and all(r.violations == 0 for r in got)


def test_audit_shuffles_once_and_scans_once_per_role(spark, tmp_path):
    from terminus.sources.tables import materialize
    t = materialize(spark, "/root/testdata/sf0.001", str(tmp_path))
    plan = qa.integrity_audit(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [booking_id#") == plan.count("Relation [trip_id#") == 2
    assert plan.count("Relation [") == len(SCHEMAS) + 2
