"""Explicit query parameters.

The reference reads ``CURDATE()`` / ``NOW()`` implicitly; here they are always
parameters so that a report is reproducible.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    as_of: dt.date = dt.date(1998, 6, 15)
    now: dt.datetime = dt.datetime(1998, 6, 15, 12, 0, 0)
    start_date: dt.date = dt.date(1998, 1, 1)
    end_date: dt.date = dt.date(1998, 12, 31)


DEFAULT_PARAMS = Params()
