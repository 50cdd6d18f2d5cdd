"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = (
    "panel_plans", "relational_plans", "inequality_plans", "zonal_plans", "spatial_plans",
    "model_plans", "resampling_plans", "series_plans", "integrity_plans", "polygon_plans", "evaluation_plans",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tesserine.plans.{name}")
