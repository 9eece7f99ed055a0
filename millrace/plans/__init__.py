"""Jobs: graphs of sources, functions and sinks, checked before they run."""

from .contracts import Contract, ContractSink, ContractSource
from .document import from_document, run_document
from .job import Argument, Job, run

__all__ = ["Argument", "Contract", "ContractSink", "ContractSource", "Job", "from_document", "run", "run_document"]
