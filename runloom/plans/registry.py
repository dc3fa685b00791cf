"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

from . import (  # noqa: F401
    design_queries, elastic_queries, graph_queries, prep_queries, source_queries, surrogate_queries,
    uq_queries,
)
from .tables import QUERIES, SQL  # noqa: F401
