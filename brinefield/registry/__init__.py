"""Every registered query, with its SQL twin where SQL can express it."""

from brinefield.registry.core import ORACLES, QUERIES
from brinefield.registry.projections import with_ctes


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return {name: with_ctes(*parts) for name, parts in ORACLES.items()}


def _load():
    from brinefield.registry import (  # noqa: F401
        q_collocation, q_exclusion, q_exports, q_fields, q_planning, q_regions, q_scalars, q_selection, q_series, q_sources,
    )
