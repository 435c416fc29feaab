"""blendscope: profile, compare, recommend and fuse tables with Spark DataFrames."""

from . import functions, operators, plans, sources
from .operators import clean, compat, fuse, ml, profile, quality, recommend, report, rowindex, schema, sketch, types, variant
from .sources import catalog, io

__all__ = ["catalog", "clean", "compat", "functions", "fuse", "io", "ml", "operators", "plans", "profile", "quality",
           "recommend", "report", "rowindex", "schema", "sketch", "sources", "types", "variant"]
