"""All registered queries by name."""

from pulseframe.catalog import (  # noqa: F401  (imported for registration)
    analytic, cleaning, conversations, governed, joins, maintenance, nights, rollups, scans, streams,
    uploads, workout,
)
from pulseframe.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
