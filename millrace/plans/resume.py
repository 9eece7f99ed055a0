"""Checkpoints of a job: which sinks are saved and which function outputs are stored, so that another run goes on from there.

A checkpoint is a folder ``millrace-<run id>`` in the staging directory (any file system that Spark knows) with a
``manifest.json`` and the stored tables. It is written after every sink and every opaque function. It belongs to the job
whose digest it holds: the same tasks, wiring, options, arguments and function code.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ResumeError


class Checkpoint:
    """``resume``: None starts anew, "auto" goes on from the newest checkpoint of the job if there is one, else a run id or a path to a manifest."""

    def __init__(self, spark: SparkSession, staging: str, digest: str, resume: str | None):
        self._spark, self._staging, self.resumed = spark, staging.rstrip("/"), False
        self._state = {"digest": digest, "begun": time.time(), "sinks": {}, "tables": {}}
        self.run_id = uuid.uuid4().hex
        if resume == "auto":
            mine = [(s["begun"], r) for r, s in self._all() if s["digest"] == digest]
            if mine:
                self.run_id = max(mine)[1]
        elif resume is not None:
            self.run_id = resume.removesuffix("/manifest.json").rpartition("millrace-")[2]
        found = self._read(self.run_id) if resume is not None else None
        if found is not None:
            if found["digest"] != digest:
                raise ResumeError(f"checkpoint {self.run_id} belongs to another job: its tasks, options, arguments or functions differ")
            self._state, self.resumed = found, True
        elif resume not in (None, "auto"):
            raise ResumeError(f"no checkpoint {resume} in {staging}")

    @property
    def folder(self) -> str:
        return f"{self._staging}/millrace-{self.run_id}"

    def _path(self, path: str):
        p = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), p

    def _all(self) -> list[tuple[str, dict]]:
        fs, p = self._path(self._staging)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        runs = [n.removeprefix("millrace-") for n in names if n.startswith("millrace-")]
        return [(r, s) for r in runs if (s := self._read(r)) is not None]

    def _read(self, run_id: str) -> dict | None:
        fs, p = self._path(f"{self._staging}/millrace-{run_id}/manifest.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self) -> None:
        fs, new = self._path(f"{self.folder}/manifest.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self._state).encode()))
        out.close()
        _, old = self._path(f"{self.folder}/manifest.json")
        fs.delete(old, False)
        fs.rename(new, old)

    def saved(self, sink: str) -> int | None:
        """Rows of a sink that an earlier run has saved."""
        return self._state["sinks"].get(sink)

    def save(self, sink: str, rows: int) -> None:
        self._state["sinks"][sink] = rows
        self._write()

    def table(self, task: str, df: DataFrame) -> DataFrame:
        """The stored output of a task; stored now unless an earlier run did."""
        if task not in self._state["tables"]:
            place = f"{self.folder}/table-{len(self._state['tables'])}"
            df.write.mode("overwrite").parquet(place)
            self._state["tables"][task] = {"path": place, "schema": df.schema.jsonValue()}
            self._write()
        found = self._state["tables"][task]
        return self._spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(found["path"])

    def remove(self) -> None:
        fs, p = self._path(self.folder)
        fs.delete(p, True)
