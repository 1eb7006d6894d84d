"""Explicit schemas of the 10 domain tables (names/types as in Appendix B and FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DateType, DecimalType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType, TimestampNTZType)

_DDL = {
    "routes": "route_id:bigint,origin:string,destination:string,distance_km:decimal(6,2),estimated_duration_minutes:int,fare_price:decimal(8,2),status:string",
    "vehicles": "vehicle_id:bigint,plate_number:string,make:string,model:string,year:int,vehicle_type:string,capacity:int,vehicle_status:string,last_maintenance_date:date",
    "users": "user_id:bigint,firstname:string,lastname:string,email:string,phone_number:string,role:string,status:string,created_at:timestamp_ntz",
    "driver_details": "driver_id:bigint,license_number:string,trips_completed:int,total_distance_driven:decimal(10,2),delayed_trips:int,driver_status:string",
    "bookings": "booking_id:bigint,ticket_reference:string,trip_id:bigint,passenger_firstname:string,passenger_lastname:string,passenger_email:string,passenger_phone:string,passenger_address:string,seat_count:int,booking_type:string,payment_status:string,total_amount:decimal(10,2),booking_date:timestamp_ntz,updated_at:timestamp_ntz",
    "payment_log": "payment_id:bigint,booking_id:bigint,trip_id:bigint,description:string,amount:decimal(10,2),payment_method:string,payment_reference:string,payment_datetime:timestamp_ntz",
    "trips": "trip_id:bigint,route_id:bigint,assigned_vehicle_id:bigint,driver_id:bigint,queue_position:int,is_accepting_bookings:boolean,estimated_departure_time:timestamp_ntz,actual_departure_datetime:timestamp_ntz,actual_arrival_datetime:timestamp_ntz,estimated_trip_duration_minutes:int,capacity:int,seats_booked:int,seats_available:int,trip_status:string,fare_price:decimal(8,2)",
    "system_log": "log_id:bigint,user_id:bigint,action_type:string,description:string,ip_address:string,created_at:timestamp_ntz",
    "notifications": "notification_id:bigint,creator_id:bigint,title:string,body:string,created_at:timestamp_ntz",
    "user_notifications": "user_notification_id:bigint,user_id:bigint,notification_id:bigint,is_read:boolean,read_at:timestamp_ntz",
}


_TYPES = {"bigint": LongType(), "int": IntegerType(), "string": StringType(),
          "boolean": BooleanType(), "date": DateType(), "timestamp_ntz": TimestampNTZType(),
          "double": DoubleType()}


def _type(name: str):
    if name.startswith("decimal("):
        p, s = name[len("decimal("):-1].split(",")
        return DecimalType(int(p), int(s))
    return _TYPES[name]


def _split(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    out.append(cur)
    return out


def struct(ddl: str) -> StructType:
    """``"a:bigint,b:decimal(10,2)"`` -> StructType (no session needed)."""
    return StructType([StructField(c.split(":", 1)[0], _type(c.split(":", 1)[1]), True)
                       for c in _split(ddl)])


SCHEMAS: dict[str, StructType] = {n: struct(d) for n, d in _DDL.items()}
