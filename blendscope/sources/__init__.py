from . import catalog, io

__all__ = ["catalog", "io"]
