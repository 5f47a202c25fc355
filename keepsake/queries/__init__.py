"""The queries of the engine, each with its SQL."""

from . import accounting, appending, cards, dedup, figures, linking, people, plans, profile, scalars, series, services, structures, timeline  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
