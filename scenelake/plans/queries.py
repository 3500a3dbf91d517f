"""All registered queries."""

from . import frame_queries, geometry_queries, neighbourhood_queries, raster_queries, run_queries  # noqa: F401
from .catalog import ORACLE, QUERIES  # noqa: F401
