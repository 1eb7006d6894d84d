"""The gram candidate join of the name search equals a LIKE over all pairs."""

import datetime as dt
import re
import unicodedata
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from terminus.operators.lookups import bookings_by_name
from terminus.sources.schemas import SCHEMAS
from terminus.sources.tables import Tables

TS = dt.datetime(2025, 1, 1)
ALPHA = "abcAB1 #%_\\é"


def like(name: str, term: str) -> bool:
    """MySQL: ``name LIKE '%term%'`` without case and accents; backslash escapes."""
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    pattern, k, term = "", 0, fold(term)
    while k < len(term):
        c = term[k]
        if c == "\\" and k + 1 < len(term):
            k += 1
            pattern += re.escape(term[k])
        else:
            pattern += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.search(f"^.*{pattern}.*$", fold(name), re.S) is not None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abcAB1 #%_\\éÉ", min_size=0, max_size=9), min_size=1, max_size=12),
       st.lists(st.text(alphabet=ALPHA, min_size=1, max_size=6), min_size=1, max_size=5))
def test_matches_brute_force(spark, names, terms):
    trips = [(1, 1, None, None, 1, True, TS, None, None, 60, 14, 0, 14, "boarding", Decimal(100))]
    bookings = [(i, f"T{i}", 1, "F", n, "e", "p", None, 1, "online", "paid", Decimal(100), TS, TS)
                for i, n in enumerate(names)]
    dfs = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
    dfs["trips"] = spark.createDataFrame(trips, SCHEMAS["trips"])
    dfs["bookings"] = spark.createDataFrame(bookings, SCHEMAS["bookings"])
    dfs["routes"] = spark.createDataFrame([(1, "O", "D", None, 30, Decimal(1), "active")], SCHEMAS["routes"])
    t = Tables(**dfs)
    tdf = spark.createDataFrame([(x,) for x in terms], "term string")
    got = sorted((r.term, r.booking_id) for r in bookings_by_name(t, tdf).collect())
    assert got == sorted((x, i) for x in set(terms) for i, n in enumerate(names) if like("F " + n, x))


def test_plan_has_no_pair_join(spark, tables):
    t = spark.createDataFrame([("%",), ("a",), ("abcd",), ("\\",)], "term string")
    plan = bookings_by_name(tables, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
