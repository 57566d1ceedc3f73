"""The queries the library is checked with, over tables derived from the driver's data."""

from catalog import q_corpus, q_kpis, q_lifecycle, q_listings, q_merge, q_sheets, q_storage  # noqa: F401
from catalog.registry import ORACLES, QUERIES
from catalog.views import Db

__all__ = ["ORACLES", "QUERIES", "Db"]
