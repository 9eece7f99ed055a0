"""User functions over Arrow batches, frames and columns, and ready-made ones."""

from .check import check_function
from .udf import Function, Skip, function, register_scalar

__all__ = ["Function", "Skip", "check_function", "function", "register_scalar"]
