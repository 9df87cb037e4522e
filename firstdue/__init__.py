"""Incident-response analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames or Columns and is lazy: no
collect, no driver loop, no row-at-a-time Python.
"""

from firstdue.session import get_session, tune

__all__ = ["get_session", "tune"]
