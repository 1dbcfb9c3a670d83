"""Merge heterogeneous logs by event time, as Spark DataFrame transforms."""

from chronolog.options import Options
from chronolog.plans.normalize import as_lines, normalize, normalize_json, rendered
from chronolog.session import configure

__all__ = ["Options", "as_lines", "configure", "normalize", "normalize_json", "rendered"]
