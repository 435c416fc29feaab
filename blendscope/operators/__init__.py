from . import clean, compat, fuse, ml, profile, quality, recommend, report, rowindex, schema, sketch, types, variant

__all__ = ["clean", "compat", "fuse", "ml", "profile", "quality", "recommend", "report", "rowindex", "schema", "sketch", "types", "variant"]
