"""tracklode: trajectory patterns, areas and hotspots on PySpark DataFrames."""

__version__ = "0.1.0"
