"""DuckDB text of the FIXTURES.md mapping, used by the oracle SQL.

Each oracle query is ``WITH <prelude CTEs>, <query CTEs> SELECT ...`` over the
driver's pre-registered views (region, nation, ..., labels). DuckDB only
evaluates the CTEs a query references.
"""

from __future__ import annotations

PRELUDE_CTES = r"""
routes AS (
  SELECT CAST(n_nationkey AS BIGINT) AS route_id, r_name AS origin, n_name AS destination,
         CAST(CASE WHEN n_nationkey % 12 = 11 THEN NULL ELSE 10 + (n_nationkey * 7) % 90 END AS DECIMAL(6,2)) AS distance_km,
         CAST(30 + (n_nationkey * 13) % 180 AS INT) AS estimated_duration_minutes,
         CAST(50 + (n_nationkey * 25) % 400 AS DECIMAL(8,2)) AS fare_price,
         CASE WHEN n_nationkey % 8 = 7 THEN 'inactive' ELSE 'active' END AS status
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
vehicles AS (
  SELECT p_partkey AS vehicle_id,
         'PLT-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS plate_number,
         p_brand AS make, p_name AS model,
         CAST(1990 + p_size % 35 AS INT) AS year,
         CASE WHEN p_size > 25 THEN 'mini-bus' ELSE 'van' END AS vehicle_type,
         CAST(CASE WHEN p_size > 25 THEN 30 ELSE 14 END AS INT) AS capacity,
         CASE p_size % 10 WHEN 0 THEN 'retired' WHEN 1 THEN 'maintenance' WHEN 2 THEN 'in_service'
              WHEN 3 THEN 'in_service' ELSE 'available' END AS vehicle_status,
         CASE WHEN p_size % 10 = 1 THEN DATE '1998-05-01' ELSE NULL END AS last_maintenance_date
  FROM part
),
users AS (
  SELECT CAST(1000000 * isc + k AS BIGINT) AS user_id, fn AS firstname, nm AS lastname,
         CASE WHEN isc = 0 THEN 'driver' ELSE 'user' END || CAST(k AS VARCHAR) || '@example.org' AS email,
         CASE WHEN k % 6 = 5 THEN NULL ELSE '0917' || lpad(CAST(k AS VARCHAR), 7, '0') END AS phone_number,
         CASE WHEN isc = 0 THEN 'driver' WHEN k % 50 = 0 THEN 'admin' WHEN k % 10 = 1 THEN 'dispatcher'
              ELSE 'passenger' END AS role,
         CASE WHEN k % 11 = 10 THEN 'blocked' WHEN k % 7 = 6 THEN 'inactive' ELSE 'active' END AS status,
         TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(k * 7 AS BIGINT)) AS created_at
  FROM (SELECT s_suppkey AS k, 0 AS isc, s_name AS nm, 'Driver' AS fn FROM supplier
        UNION ALL SELECT c_custkey, 1, c_name, c_mktsegment FROM customer) x
),
driver_details AS (
  SELECT s_suppkey AS driver_id, 'LIC-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS license_number,
         CAST(s_suppkey * 37 % 500 AS INT) AS trips_completed,
         CAST(s_suppkey * 1234 % 100000 AS DECIMAL(10,2)) AS total_distance_driven,
         CAST(s_suppkey % 20 AS INT) AS delayed_trips,
         CASE s_suppkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'on_trip' WHEN 2 THEN 'unavailable'
              ELSE 'off_duty' END AS driver_status
  FROM supplier
),
bookings_raw AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
             l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
           AS booking_id,
         l_orderkey AS trip_id, c_mktsegment AS passenger_firstname, c_name AS passenger_lastname,
         'user' || CAST(o_custkey AS VARCHAR) || '@example.org' AS passenger_email,
         '0917' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS passenger_phone,
         CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE destination END AS passenger_address,
         CAST(1 + CAST(l_quantity AS INT) % 10 AS INT) AS seat_count,
         CASE l_linestatus WHEN 'O' THEN 'online' ELSE 'walk-in' END AS booking_type,
         CASE WHEN l_returnflag = 'N' THEN 'paid'
              WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'pending' ELSE 'paid' END
              ELSE CASE WHEN l_linenumber % 4 = 0 THEN 'refunded' ELSE 'cancelled' END END AS payment_status,
         CAST(fare_price * (1 + CAST(l_quantity AS INT) % 10) AS DECIMAL(10,2)) AS total_amount,
         l_shipdate + to_minutes(CAST(l_partkey % 1440 AS BIGINT)) AS booking_date,
         l_shipdate + to_minutes(CAST(l_partkey % 1440 + 60 + l_linenumber AS BIGINT)) AS updated_at,
         l_linenumber AS line_no, CAST(l_partkey % 5 AS INT) AS method_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN routes ON c_nationkey = route_id
),
bookings AS (
  SELECT booking_id,
         'BT-' || CAST(year(booking_date) AS VARCHAR) || '-' ||
           lpad(CAST(booking_id AS VARCHAR), CAST(greatest(4, length(CAST(booking_id AS VARCHAR))) AS INTEGER), '0') AS ticket_reference,
         trip_id, passenger_firstname, passenger_lastname, passenger_email, passenger_phone,
         passenger_address, seat_count, booking_type, payment_status, total_amount, booking_date, updated_at
  FROM bookings_raw
),
payment_log AS (
  SELECT pid AS payment_id, booking_id, trip_id,
         booking_type || ' booking - ' || CAST(seat_count AS VARCHAR) || ' seat(s)' AS description,
         total_amount AS amount,
         CASE WHEN again = 1 THEN 'cash' WHEN method_no = 0 THEN 'cash' WHEN method_no = 1 THEN 'gcash'
              WHEN method_no = 2 THEN 'paymaya' WHEN method_no = 3 THEN 'online' ELSE 'terminal' END AS payment_method,
         'REF-' || CAST(pid AS VARCHAR) AS payment_reference,
         booking_date + to_minutes(CAST(again * 5 AS BIGINT)) AS payment_datetime
  FROM (SELECT booking_id * 10 AS pid, 0 AS again, b.* FROM bookings_raw b WHERE payment_status <> 'pending'
        UNION ALL
        SELECT booking_id * 10 + 1, 1, b.* FROM bookings_raw b WHERE payment_status <> 'pending' AND line_no = 7) x
),
trips AS (
  SELECT o_orderkey AS trip_id, route_id, vid AS assigned_vehicle_id, drv AS driver_id,
         CAST(row_number() OVER (PARTITION BY route_id, CASE WHEN st IN ('waiting', 'boarding', 'full') THEN 1 ELSE 0 END
                                 ORDER BY edt, o_orderkey) AS INT) AS queue_position,
         (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS is_accepting_bookings,
         edt AS estimated_departure_time,
         CASE WHEN st IN ('departed', 'arrived') THEN edt + to_minutes(CAST(o_orderkey % 45 AS BIGINT)) END
           AS actual_departure_datetime,
         CASE WHEN st = 'arrived' THEN edt + to_minutes(CAST(o_orderkey % 45 + dur + o_orderkey % 31 - 15 AS BIGINT)) END
           AS actual_arrival_datetime,
         dur AS estimated_trip_duration_minutes, cap AS capacity, sb AS seats_booked,
         CAST(cap - sb AS INT) AS seats_available, st AS trip_status, fare_price
  FROM (
    SELECT o_orderkey, o_orderpriority, o_orderstatus,
           o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS edt,
           r.route_id, r.fare_price, r.estimated_duration_minutes AS dur,
           CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(FLOOR(o_custkey / 15) AS BIGINT) END AS drv,
           v.vehicle_id AS vid, CAST(COALESCE(v.capacity, 14) AS INT) AS cap,
           CAST(LEAST(COALESCE(s.seats, 0), COALESCE(v.capacity, 14)) AS INT) AS sb,
           CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'cancelled'
                WHEN o_orderstatus = 'F' THEN 'arrived' WHEN o_orderstatus = 'P' THEN 'departed'
                WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'waiting'
                WHEN COALESCE(s.seats, 0) >= COALESCE(v.capacity, 14) THEN 'full' ELSE 'boarding' END AS st
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN routes r ON c_nationkey = r.route_id
    LEFT JOIN vehicles v ON v.vehicle_id = CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 200 END
    LEFT JOIN (SELECT trip_id AS tid, SUM(seat_count) AS seats FROM bookings_raw WHERE payment_status = 'paid'
               GROUP BY trip_id) s ON s.tid = o_orderkey
  ) x
),
system_log AS (
  SELECT event_id AS log_id,
         CAST(CASE WHEN event_id % 10 = 0 THEN NULL ELSE 1000000 + user_id END AS BIGINT) AS user_id,
         CASE event_type WHEN 'purchase' THEN 'booking_created' WHEN 'error' THEN 'booking_cancelled'
              WHEN 'signup' THEN 'trip_created' WHEN 'view' THEN 'trip_departed' ELSE 'queue_advanced' END AS action_type,
         props AS description, CAST(NULL AS VARCHAR) AS ip_address, ts AS created_at
  FROM events
),
notifications AS (
  SELECT doc_id AS notification_id, CAST(1000000 + doc_id % 150 AS BIGINT) AS creator_id, source AS title,
         text AS body, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents
),
user_notifications AS (
  SELECT doc_id AS user_notification_id, CAST(1000000 + doc_id % 15 AS BIGINT) AS user_id,
         doc_id AS notification_id, (quality = 1) AS is_read,
         CASE WHEN quality = 1 THEN TIMESTAMP '2024-03-01 00:00:00' + to_minutes(doc_id) END AS read_at
  FROM labels
)
"""

# Facts that the queries share, over the tables above.
FACT_CTES = """
people AS (SELECT *, firstname || ' ' || lastname AS full_name FROM users),
driver_files AS (
  SELECT p.* EXCLUDE (status), p.status AS account_status, dd.* EXCLUDE (driver_id)
  FROM people p JOIN driver_details dd ON dd.driver_id = p.user_id WHERE p.role = 'driver'),
trip_facts AS (
  SELECT t.*, CAST(t.actual_departure_datetime AS DATE) AS departed_on,
         t.trip_status IN ('departed', 'arrived') AS is_driven,
         t.trip_status IN ('waiting', 'boarding', 'full') AS is_live,
         t.is_accepting_bookings AND r.status = 'active' AND v.vehicle_id IS NOT NULL AND d.user_id IS NOT NULL AS is_bookable,
         r.origin, r.destination, r.distance_km, r.estimated_duration_minutes, r.fare_price AS route_fare,
         v.vehicle_id, v.plate_number, v.vehicle_type, v.make, v.model, v.capacity AS vehicle_capacity,
         d.user_id AS found_driver, d.full_name AS driver_name, d.phone_number AS driver_phone
  FROM trips t JOIN routes r USING (route_id) LEFT JOIN vehicles v ON v.vehicle_id = t.assigned_vehicle_id
  LEFT JOIN people d ON d.user_id = t.driver_id),
named_bookings AS (
  SELECT *, passenger_firstname || ' ' || passenger_lastname AS passenger_name, payment_status = 'paid' AS is_paid
  FROM bookings),
booking_facts AS (SELECT b.*, f.* EXCLUDE (trip_id) FROM named_bookings b JOIN trip_facts f USING (trip_id)),
sales AS (
  SELECT CAST(p.payment_datetime AS DATE) AS payment_date, p.amount AS paid_amount, b.*
  FROM payment_log p JOIN booking_facts b ON b.booking_id = p.booking_id),
view_active_bookings AS (
  SELECT booking_id, ticket_reference, booking_type, booking_date, payment_status, total_amount, seat_count, passenger_name,
         passenger_email, passenger_phone, trip_id, trip_status, estimated_departure_time, origin, destination,
         plate_number, driver_name
  FROM booking_facts WHERE is_paid AND trip_status IN ('boarding', 'full', 'departed')),
view_queue_status AS (
  SELECT trip_id, trip_status, queue_position, is_accepting_bookings, estimated_departure_time, capacity, seats_booked,
         seats_available, route_id, origin, destination, plate_number, vehicle_type, driver_name
  FROM trip_facts WHERE is_live)
"""


def with_prelude(body_ctes: str | None, select: str, recursive: bool = False) -> str:
    """``WITH [RECURSIVE] prelude[, body_ctes] select``."""
    ctes = PRELUDE_CTES.strip() + ",\n" + FACT_CTES.strip()
    if body_ctes:
        ctes = ctes + ",\n" + body_ctes.strip()
    kw = "WITH RECURSIVE" if recursive else "WITH"
    return f"{kw} {ctes}\n{select.strip()}"
