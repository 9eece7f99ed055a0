"""The standard transformations."""

from .base import Operator, chain, make
from .combine import Join, Union
from .projection import Cast, Drop, FillNull, Rename, Select
from .rows import Dedupe, Explode, Filter
from .text import ConcatStr, DateTrunc, Hash, Mask

STANDARD: dict[str, type[Operator]] = {o.name: o for o in (Cast, Rename, Select, Drop, Filter, FillNull, Dedupe, Hash, Mask, Explode, ConcatStr, DateTrunc, Union, Join)}

__all__ = ["STANDARD", "Cast", "ConcatStr", "DateTrunc", "Dedupe", "Drop", "Explode", "FillNull", "Filter", "Hash", "Join", "Mask", "Operator", "Rename", "Select", "Union", "chain", "make"]
