from .commands import count, dump, histo

__all__ = ["count", "dump", "histo"]
