"""Query modules: importing them fills the registry."""

import importlib

MODULES = ("spatial", "scoring", "reviews", "learning", "legends", "datasets", "streams", "drawings", "sheets")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"markset.plans.{name}")
