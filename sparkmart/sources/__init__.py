"""Logical source tables: their schemas, where their rows come from, and files in other formats."""

from .registry import SCHEMAS, Source, contract, from_folder
from .warehouse import from_driver_tables

__all__ = ["SCHEMAS", "Source", "contract", "from_driver_tables", "from_folder"]
