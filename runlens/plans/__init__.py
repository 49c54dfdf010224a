"""Named queries over the supplied tables, each with its reference SQL."""

from runlens.plans import (  # noqa: F401  (importing registers the queries)
    extraction,
    joining,
    patch_checks,
    picking,
    replay,
    reporting,
    rewarding,
    scans,
    streams,
)
from runlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
