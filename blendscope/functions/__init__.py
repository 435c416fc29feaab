from . import columns, names, values

__all__ = ["columns", "names", "values"]
