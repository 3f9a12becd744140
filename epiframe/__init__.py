"""Episode-data processing on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) whose heavy work runs on executors as ordinary
DataFrame/SQL plans.
"""

from epiframe.session import get_session, checkpoint_dir, join_small, r6

__all__ = ["get_session", "checkpoint_dir", "join_small", "r6"]
