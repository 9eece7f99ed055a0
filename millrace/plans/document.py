"""Jobs as JSON documents, version 1: {"version": 1, "name", "source", "kernels", "sink", "ordered", "staging", "resume", "arguments"}; unknown fields are refused.

``staging`` is {"dir": path, "keep": bool}; ``arguments`` maps names to types, and {"arg": name} stands for one in options and args.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import ConfigError, EngineError
from ..operators.base import make
from ..sinks import ArrowFileSink, ParquetSink, TensorSink
from ..sources import ArrowFileSource, ParquetSource, SqlSource, TensorSource
from .job import Job, Report

SOURCES = {"parquet": ParquetSource, "arrow_ipc": ArrowFileSource, "tensor": TensorSource, "sql": SqlSource}
SINKS = {"parquet": ParquetSink, "arrow_ipc": ArrowFileSink, "tensor": TensorSink}
FIELDS = {"version", "name", "source", "kernels", "sink", "ordered", "staging", "resume", "arguments"}


def _filled(x, known: dict):
    """{"arg": name} becomes the run argument of that name."""
    if isinstance(x, dict) and set(x) == {"arg"}:
        if x["arg"] not in known:
            raise ConfigError(f"no argument {x['arg']!r}")
        return known[x["arg"]]
    if isinstance(x, dict):
        return {k: _filled(v, known) for k, v in x.items()}
    return [_filled(v, known) for v in x] if isinstance(x, list) else x


def _of(kinds: dict, x, what: str, known: dict):
    if not isinstance(x, dict) or set(x) - {"kind", "options"} or x.get("kind") not in kinds:
        raise ConfigError(f"{what} needs a kind ({', '.join(kinds)}) and options")
    try:
        return kinds[x["kind"]](**_filled(x.get("options", {}), known))
    except TypeError as e:
        raise ConfigError(f"{what}: {str(e).replace('__init__() ', '')}") from None


def from_document(text: str) -> tuple[Job, bool]:
    """The job of a document and whether its delivery is ordered."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from None
    if not isinstance(doc, dict) or doc.get("version") != 1:
        raise ConfigError("version must be 1")
    if extra := sorted(set(doc) - FIELDS):
        raise ConfigError(f"unknown field {extra[0]!r}")
    if missing := [f for f in ("source", "sink") if f not in doc]:
        raise ConfigError(f"{missing[0]} is missing")
    job = Job(doc.get("name", "job"))
    try:
        known = {n: job.arg(n, kind) for n, kind in doc.get("arguments", {}).items()}
    except EngineError as e:
        raise ConfigError(str(e)) from None
    last = job.add(_of(SOURCES, doc["source"], "source", known))
    for k in doc.get("kernels", []):
        if not isinstance(k, dict) or set(k) - {"function", "args"} or "function" not in k:
            raise ConfigError("a kernel needs a function and args")
        try:
            last = job.add(make(k["function"], _filled(k.get("args"), known)), last)
        except EngineError as e:
            raise ConfigError(str(e)) from None
    job.add(_of(SINKS, doc["sink"], "sink", known), last)
    return job, bool(doc.get("ordered", False))


def options(text: str) -> dict:
    """The staging directory, resume mode and whether to keep the checkpoint, as ``Job.run`` takes them."""
    doc = json.loads(text)
    staging = doc.get("staging", {})
    if not isinstance(staging, dict) or set(staging) - {"dir", "keep"} or staging and "dir" not in staging:
        raise ConfigError("staging needs a dir, and may have keep")
    return {"staging": staging.get("dir"), "resume": doc.get("resume"), "keep_checkpoint": bool(staging.get("keep", False))}


def run_document(spark: SparkSession, text: str, **arguments) -> Report:
    job, ordered = from_document(text)
    return job.run(spark, ordered=ordered, **options(text), **arguments)
