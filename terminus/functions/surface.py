"""``scalar_surface``: every scalar / client-side function of SURVEY §2.8
applied once per booking, each as a native Spark expression."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.functions import scalar as S
from terminus.operators.quality import EMAIL_PATTERN
from terminus.sources.tables import Tables


def scalar_surface(t: Tables, as_of: dt.date) -> DataFrame:
    tr = t.trips.select(F.col("trip_id").alias("_t"), "fare_price", "trip_status")
    b = t.bookings.join(tr, t.bookings.trip_id == tr._t)
    return b.select(
        "booking_id",
        S.full_name("passenger_firstname", "passenger_lastname").alias("passenger_name"),
        S.ticket_reference(F.col("booking_id"), F.col("booking_date"), wide=False).alias("ticket_literal"),
        S.ticket_reference(F.col("booking_id"), F.col("booking_date"), wide=True).alias("ticket_wide"),
        F.coalesce(F.col("passenger_address"), F.lit("n/a")).alias("address_or_default"),
        F.to_date("booking_date").alias("booking_day"),
        F.year("booking_date").alias("booking_year"),
        F.month("booking_date").alias("booking_month"),
        S.same_iso_week(F.col("booking_date"), as_of).alias("in_as_of_week"),
        S.minutes_between(F.col("booking_date"), F.col("updated_at")).cast("bigint").alias("minutes_to_update"),
        F.round(F.col("total_amount") * F.lit(1.12).cast("decimal(3,2)"), 2).alias("amount_with_tax"),
        (F.col("total_amount") - F.col("fare_price") * F.col("seat_count")).cast("decimal(18,2)").alias("amount_gap"),
        F.when(F.col("booking_type") == "online", "ONL").when(F.col("booking_type") == "walk-in", "WLK")
        .otherwise("UNK").alias("type_code"),
        F.format_string("%.2f", F.col("total_amount").cast("double")).alias("amount_text"),
        F.coalesce(F.col("seat_count"), F.lit(0)).alias("seats_or_zero"),
        F.upper("payment_status").alias("status_label"),
        F.date_format("booking_date", "HH:mm").alias("time_label"),
        (F.length(F.trim(F.col("passenger_phone"))) > 0).alias("phone_present"),
        F.coalesce(F.col("passenger_email").rlike(EMAIL_PATTERN), F.lit(False)).alias("email_valid"),
        F.col("trip_status").isin(*S.BOOKABLE_TRIP).alias("trip_bookable"),
        F.length("passenger_lastname").alias("lastname_length"))
