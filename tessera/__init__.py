"""tessera: Spark-native operators for agent-operations and business-operations data.

Every public operator is ``DataFrame -> DataFrame`` (plus streaming variants) built from
Spark SQL built-ins, so Catalyst can prune, push down and code-generate the whole plan.
"""

from tessera.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
