"""Deleting rows of any table, held against a plain row-by-row cascade."""

import random

import pytest

from terminus.operators import cascade as ca


def plain(data, roots):
    """data: table -> {id: {fk column: value}}; what MySQL does to it."""
    out = set()
    gone = {n: set() for n in data}

    def delete(table, row):
        if row in gone[table] or row not in data[table]:
            return
        gone[table].add(row)
        for child, column, parent, action in ca.FOREIGN_KEYS:
            if parent == table and action == "CASCADE":
                for r, fks in data[child].items():
                    if fks.get(column) == row:
                        delete(child, r)

    for table, ids in roots.items():
        for row in ids:
            if any(p == table and a == "RESTRICT" and any(f.get(c) == row for f in data[child].values())
                   for child, c, p, a in ca.FOREIGN_KEYS):
                if row in data[table]:
                    out.add((table, row, "restricted", None))
            else:
                delete(table, row)
    out |= {(n, r, "deleted", None) for n, rows in gone.items() for r in rows}
    for child, column, parent, action in ca.FOREIGN_KEYS:
        if action == "SET NULL":
            out |= {(child, r, "set_null", column) for r, f in data[child].items()
                    if r not in gone[child] and f.get(column) in gone[parent] and f.get(column) is not None}
    return out


def made(rng):
    sizes = {"users": 8, "routes": 4, "vehicles": 5, "trips": 12, "bookings": 30, "payment_log": 40, "driver_details": 8,
             "notifications": 10, "user_notifications": 30, "system_log": 15}
    data = {}
    for name in ca.visit_order():
        rows = range(1, sizes[name] + 1)
        parents = [(c, p) for child, c, p, _ in ca.FOREIGN_KEYS if child == name]
        data[name] = {i: {c: (i if c == ca.PRIMARY_KEYS[name] else rng.choice([None, *range(1, sizes[p] + 1)])) for c, p in parents} for i in rows}
    return data


class Small:
    """The key columns of the tables."""

    def __init__(self, spark, data):
        for name, rows in data.items():
            key = ca.PRIMARY_KEYS[name]
            cols = [c for child, c, _, _ in ca.FOREIGN_KEYS if child == name and c != key]
            setattr(self, name, spark.createDataFrame([(i, *[f[c] for c in cols], f"x{i}") for i, f in rows.items()],
                                                      ", ".join(f"{c} long" for c in [key, *cols]) + ", note string"))

    def replace(self, **kw):
        self.__dict__.update(kw)
        return self


@pytest.mark.parametrize("seed", range(3))
def test_random_deletions_equal_the_plain_cascade(spark, seed):
    rng = random.Random(seed)
    data = made(rng)
    roots = {"users": [1, 2, 99], "trips": [3, 3, 4], "vehicles": [1, 2], "routes": [1, 2, 3, 4], "notifications": [5]}
    if seed == 2:
        roots = {"routes": [4, 50], "payment_log": [7], "bookings": [2]}
        data["trips"] = {i: {**f, "route_id": 1} for i, f in data["trips"].items()}
    frames = {n: spark.createDataFrame([(i,) for i in [*ids, None]], "id long") for n, ids in roots.items()}
    t = Small(spark, data)
    effects = ca.cascade_effects(t, frames)
    want = plain(data, roots)
    got = [tuple(r) for r in effects.collect()]
    assert set(got) == want and len(got) == len(want)
    after = ca.after_cascade(t, effects)
    nulled = {(n, r, c) for n, r, a, c in want if a == "set_null"}
    gone = {(n, r) for n, r, a, _ in want if a == "deleted"}
    for name in data:
        df = getattr(after, name)
        for r in df.collect():
            i = r[ca.PRIMARY_KEYS[name]]
            assert (name, i) not in gone and r.note == f"x{i}"
            for c, v in data[name][i].items():
                assert r[c] == (None if (name, i, c) in nulled else v)
        assert df.count() == len(data[name]) - sum(n == name for n, _ in gone)


def test_nothing_to_delete(spark, tables):
    assert ca.cascade_effects(tables, {}).count() == 0
    assert ca.cascade_effects(tables, {"users": tables.users.select("user_id").limit(0)}).count() == 0
    with pytest.raises(ValueError):
        ca.cascade_effects(tables, {"nobody": tables.users.select("user_id")})


def test_counts_agree_with_the_report(spark, tables):
    from terminus.operators import quality as qa
    roots = {"users": tables.users.filter("status = 'blocked'").select("user_id"),
             "trips": tables.trips.filter("trip_status = 'cancelled'").select("trip_id"),
             "vehicles": tables.vehicles.filter("vehicle_status = 'retired'").select("vehicle_id"),
             "routes": tables.routes.filter("status = 'inactive'").select("route_id")}
    got = {(r.table_name, r.action, r.column_name): r["count"] for r in
           ca.cascade_effects(tables, roots).groupBy("table_name", "action", "column_name").count().collect()}
    report = {(r.table_name, r.action): r.rows for r in qa.cascade_delete(
        tables, *[roots[n] for n in ("users", "trips", "vehicles", "routes")]).collect()}
    for (name, action), n in report.items():
        if action == "deleted":
            assert got.get((name, "deleted", None), 0) == n
    assert got.get(("trips", "set_null", "driver_id"), 0) == report["trips", "driver_set_null"]
    assert got.get(("trips", "set_null", "assigned_vehicle_id"), 0) == report["trips", "vehicle_set_null"]
