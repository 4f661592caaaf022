"""Registered queries: importing the modules fills ``REGISTRY``."""

from . import q_active, q_curate, q_drift, q_model, q_stream, q_survey_names  # noqa: F401
from .registry import REGISTRY, Query  # noqa: F401
