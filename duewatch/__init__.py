"""duewatch — deadline analytics for business-process runs on Apache Spark.

Every run of a process (an activation, a settlement, a delivery) is one row of
the ``runs`` DataFrame: a start, an optional deadline, an outcome and a list of
key/value tags. The sub-packages hold:

* ``sources``   — readers for runs, request bodies and the derived test views,
                  plus the outbox / metrics sinks;
* ``functions`` — ``Column`` builders (classification, durations, JSON, text);
* ``operators`` — ``DataFrame -> DataFrame`` jobs (filters, listing, rollups,
                  scans, lifecycle fold, metrics, rules, time series);
* ``plans``     — the query catalogue that names each job and its SQL twin;
* ``streaming`` — Structured Streaming versions of the scans and the fold.

Every operator takes an explicit ``as_of`` instant instead of reading a clock.
"""

from duewatch.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
