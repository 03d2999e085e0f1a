"""cyclestat: trip-record analytics on Spark DataFrames.

Every public operator is a plain function ``DataFrame -> DataFrame`` built
from Spark's own expressions, so Catalyst can prune, push down and plan it.
No operator creates a session, changes session settings or collects rows.
"""

from cyclestat import schema

__all__ = ["schema"]
__version__ = "0.1.0"
