"""terminus: transit-operations analytics (bookings, payments, trips, queues) on Spark.

Every public operator is a pure function ``DataFrame(s) -> DataFrame`` built from
the DataFrame API; parameters such as ``as_of`` are explicit (no implicit clock).
"""

from terminus.params import Params, DEFAULT_PARAMS  # noqa: F401
from terminus.session import build_session, checkpoint_dir  # noqa: F401
