"""fleetlens: set-based Spark jobs over the records of a fleet of remote Spark sessions.

Inputs are a session registry, a lifecycle log, a request log and launch-configuration
tables. Every operator takes DataFrames and returns lazy DataFrames; the clock is always an
argument (``now``, ``observed_until``), so a rerun over the same tables gives the same rows.
"""

__version__ = "0.1.0"
