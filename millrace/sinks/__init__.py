"""Where rows go. Every sink commits as a whole: readers never see part of a file that is not finished."""

from .files import ArrowFileSink, ParquetSink, TensorSink
from .user import ArrowStreamSink, Sink, UserSink

__all__ = ["ArrowFileSink", "ArrowStreamSink", "ParquetSink", "Sink", "TensorSink", "UserSink"]
