"""Sources: files of many formats as records and field extents."""

from .formats import FORMATS, Field, Format, Parsed, register
from .reader import read

__all__ = ["FORMATS", "Field", "Format", "Parsed", "read", "register"]
