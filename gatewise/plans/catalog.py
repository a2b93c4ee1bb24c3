"""Imports every query module so the catalogue is complete."""

from gatewise.plans import (  # noqa: F401
    lane_setup,
    pipelines,
    plate_text,
    reporting,
    scanning,
    sensing,
    storage,
    streams,
    voting,
)
from gatewise.plans.reporting import FLAGSHIP  # noqa: F401
