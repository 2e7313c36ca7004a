"""Sending the few Python task functions to executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions whole, so that executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
