"""Follow-up analytics over reports, findings, proposals and action plans, on Spark DataFrames."""

from rastro.schema import Tables

__all__ = ["Tables"]
