"""candela: market analytics as Spark DataFrame transforms.

Every public operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``); nothing loops over symbols on the driver and nothing is
collected. See README.md for the module map.
"""

from candela.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
