"""Named operators and pipelines described as JSON."""

from . import catalog
from .flows import FLOWS, flow
from .pipeline import Run, check_pipeline, run_pipeline
from .registry import Operator, Param, get_operator, operator, operators

__all__ = [
    "FLOWS",
    "Operator",
    "Param",
    "Run",
    "catalog",
    "check_pipeline",
    "flow",
    "get_operator",
    "operator",
    "operators",
    "run_pipeline",
]
