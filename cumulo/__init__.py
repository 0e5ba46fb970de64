"""Point-set analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from cumulo.session import build_session, ensure_checkpoint_dir

# Grouped functions travel to the workers by value: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "ensure_checkpoint_dir"]
