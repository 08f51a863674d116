"""Registered queries: one per operator, over the given tables."""

import importlib

SECTIONS = ("cleaning", "columns", "profiles", "evaluation", "modelling")


def load_registry():
    for section in SECTIONS:
        importlib.import_module(f"tabcal.catalog.{section}")
    from tabcal.catalog.base import REGISTRY

    return REGISTRY
