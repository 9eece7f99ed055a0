"""What can go wrong, by the step that finds it."""


class EngineError(Exception):
    """Base of all errors raised by this package."""


class PlanError(EngineError):
    """A plan, schema or argument that can't work; raised before any Spark job."""


class IoError(EngineError):
    """A source or sink failed to read, write or finish."""


class FunctionError(EngineError):
    """A user function failed or broke its declaration."""


class BudgetError(EngineError):
    """More failures than the error policy allows."""


class ResumeError(EngineError):
    """A checkpoint that doesn't fit the run."""


class ConfigError(EngineError):
    """A setting, job document or run argument that can't be used."""
