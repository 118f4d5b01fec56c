"""Registry of the core library's queries and their SQL: importing it registers them all."""

from cohortspark.plans import q_cells, q_classes, q_dynamics, q_genetics, q_geo, q_graph, q_joins, q_raster, q_simulate, q_tables, q_tools  # noqa: F401
from cohortspark.registry import ORACLE_SQL, QUERIES  # noqa: F401
