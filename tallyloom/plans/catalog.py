"""Imports every query module so that the registry is full."""

from importlib import import_module
from pathlib import Path

from tallyloom.plans.registry import ORACLES, QUERIES

for _path in sorted(Path(__file__).parent.glob("q_*.py")):
    import_module(f"tallyloom.plans.{_path.stem}")

__all__ = ["QUERIES", "ORACLES"]
