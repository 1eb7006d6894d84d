"""DuckDB text of the request and change inputs (same rules as
``terminus.sources.requests``)."""

from __future__ import annotations

from terminus.params import DEFAULT_PARAMS as P

BOOKING_REQUESTS = """booking_requests AS (
  SELECT b.booking_id AS request_id, b.trip_id, t.route_id, b.passenger_firstname AS firstname,
         b.passenger_lastname AS lastname, b.passenger_email AS email, b.passenger_phone AS phone,
         b.passenger_address AS address, b.seat_count, b.booking_type, p.payment_method,
         p.payment_reference, b.booking_date AS requested_at
  FROM bookings b JOIN trips t ON b.trip_id = t.trip_id
  LEFT JOIN payment_log p ON p.payment_id = b.booking_id * 10)"""

EMPTY_TRIPS = """empty_trips AS (
  SELECT * REPLACE (0 AS seats_booked, capacity AS seats_available) FROM trips)"""

BOOKING_CHANGES = """booking_changes AS (
  SELECT booking_id * 10 AS event_id, booking_id, trip_id, CAST(NULL AS VARCHAR) AS old_status,
         CASE WHEN payment_status = 'pending' THEN 'pending' ELSE 'paid' END AS new_status,
         seat_count, booking_date AS ts FROM bookings
  UNION ALL
  SELECT booking_id * 10 + 1, booking_id, trip_id, 'paid', payment_status, seat_count, updated_at
  FROM bookings WHERE payment_status IN ('cancelled', 'refunded'))"""

CANCEL_REQUESTS = """cancel_requests AS (
  SELECT booking_id AS request_id, booking_id, updated_at AS ts FROM bookings
  WHERE trip_id IN (SELECT trip_id FROM trips WHERE trip_status = 'cancelled')
  UNION ALL SELECT -1, -1, CAST(NULL AS TIMESTAMP))"""

DEPARTURES = f"""departures AS (
  SELECT trip_id, TIMESTAMP '{P.now}' AS ts FROM trips
  WHERE trip_status IN ('waiting', 'boarding', 'full') AND queue_position = 1)"""

ARRIVALS = """arrivals AS (
  SELECT trip_id, driver_id,
         COALESCE(actual_arrival_datetime,
                  actual_departure_datetime + to_minutes(CAST(estimated_trip_duration_minutes AS BIGINT))) AS ts
  FROM trips WHERE trip_status IN ('departed', 'arrived')
  UNION ALL SELECT -1, -1, CAST(NULL AS TIMESTAMP))"""

NEW_TRIPS = """new_trips AS (
  SELECT trip_id AS request_id, route_id, assigned_vehicle_id AS vehicle_id, driver_id,
         estimated_departure_time AS estimated_departure FROM trips WHERE trip_status = 'waiting')"""

REASSIGNMENTS = """reassignments AS (
  SELECT trip_id, CAST(COALESCE(assigned_vehicle_id, 0) + 1 AS BIGINT) AS vehicle_id,
         CAST(COALESCE(driver_id, 0) + 1 AS BIGINT) AS driver_id FROM trips WHERE trip_status = 'waiting')"""

REASSIGNMENT_SEQUENCE = REASSIGNMENTS + """,
reassignment_sequence AS (
  SELECT trip_id * 3 AS request_id, trip_id, vehicle_id, driver_id FROM reassignments
  UNION ALL SELECT trip_id * 3 + 1, trip_id, vehicle_id + 1, driver_id + 1 FROM reassignments
  UNION ALL SELECT trip_id * 3 + 2, trip_id, -1, -1 FROM reassignments)"""

READ_MARKS = """read_marks AS (
  SELECT un.user_id, un.notification_id, n.created_at + INTERVAL 1 DAY AS ts
  FROM user_notifications un JOIN notifications n ON un.notification_id = n.notification_id
  WHERE NOT un.is_read)"""

STATUS_EVENTS = """status_events AS (
  SELECT trip_id * 10 + 1 AS event_id, trip_id, driver_id, assigned_vehicle_id AS vehicle_id, route_id,
         'boarding' AS old_status, 'departed' AS new_status, actual_departure_datetime AS ts
  FROM trips WHERE trip_status IN ('departed', 'arrived')
  UNION ALL
  SELECT trip_id * 10 + 2, trip_id, driver_id, assigned_vehicle_id, route_id, 'departed', 'arrived',
         actual_arrival_datetime FROM trips WHERE trip_status = 'arrived')"""
