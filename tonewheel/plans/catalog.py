"""Imports every plan module, which registers its queries."""

from tonewheel.plans import detection, dims, fitting, ingest, labelling, lifting, scoring, streams, tracking  # noqa: F401
from tonewheel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
