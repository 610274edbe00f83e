"""Tables that cut lineage, in the folder that all executors share (a cluster has to name it in spark.checkpoint.dir)."""

from marketframe.operators.saved import saved, shared_folder

__all__ = ["saved", "shared_folder"]
