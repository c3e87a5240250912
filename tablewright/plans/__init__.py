"""The registered queries, one module per family."""

import importlib

from tablewright.plans import registry

FAMILIES = ("diffing", "filtering", "scalars", "grouping", "moving", "searching", "generating", "queueing", "options")


def load():
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return registry.QUERIES, registry.ORACLES
