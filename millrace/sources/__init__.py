"""Where rows come from."""

from .arrow import ArrowFileSource, ArrowStreamSource, IteratorSource
from .custom import Source, Split, UserSource
from .parquet import ParquetSource
from .sql import SqlSource
from .tensor import TensorSource

__all__ = ["ArrowFileSource", "ArrowStreamSource", "IteratorSource", "ParquetSource", "Source", "Split", "SqlSource", "TensorSource", "UserSource"]
