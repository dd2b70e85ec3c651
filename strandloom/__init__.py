"""K-mer analytics on Spark."""

from .params import CountParams

__all__ = ["CountParams"]
