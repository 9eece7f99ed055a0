"""A job: named tasks wired output to input, checked as a whole, composed into lazy DataFrames, and run sink by sink.

A positional join of branches that are pure projections of one upstream becomes a single select; other branches get row
numbers from a stored upstream. An output that several tasks read is planned once; it is persisted only where it feeds
more than one sink through an opaque function.
"""

from __future__ import annotations

import copy
import datetime as dt
import hashlib
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..arguments import Argument, resolved, waiting
from ..errors import ConfigError, EngineError, IoError, PlanError
from ..functions.udf import Function
from ..operators.base import Operator
from ..operators.combine import Join, numbered
from ..operators.rows import ORDER, Dedupe
from ..session import prepare
from ..shipping import ship
from ..sinks.base import Output
from ..sources.base import Input
from ..storage import drop, stored
from .resume import Checkpoint

NAME = re.compile(r"[A-Za-z0-9_\-.:]{1,128}")
ARGUMENTS = {"string": str, "int": int, "float": float, "bool": bool, "date": dt.date, "timestamp": dt.datetime}


@dataclass
class Task:
    name: str
    task: Input | Operator | Output
    inputs: list[str]


@dataclass
class Report:
    """What a run did. A figure that was not measured is absent, not zero."""

    job: str
    digest: str
    seconds: float = 0.0
    rows: dict[str, int] = field(default_factory=dict)
    excluded: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    outcome: str = "completed"
    run_id: str | None = None
    resumed: bool = False


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


class Job:
    def __init__(self, name: str):
        if not NAME.fullmatch(name):
            raise PlanError(f"{name!r} is no name: 1 to 128 letters, digits, _ - . or :")
        self.name, self.tasks, self.barriers, self.arguments = name, {}, [], {}

    def add(self, task, inputs=None, name: str | None = None) -> str:
        """Add a task and return its name. Inputs are names of earlier or later tasks."""
        if not isinstance(task, (Input, Operator, Output)):
            raise TypeError(f"{task!r} is no source, function or sink")
        base = name or _snake(getattr(task, "label", None) or getattr(task, "name", None) or type(task).__name__)
        if name is None:
            n, k = base, 2
            while n in self.tasks:
                n, k = f"{base}_{k}", k + 1
            name = n
        if not NAME.fullmatch(name):
            raise PlanError(f"{name!r} is no name")
        if name in self.tasks:
            raise PlanError(f"two tasks are called {name!r}")
        inputs = [inputs] if isinstance(inputs, str) else list(inputs or [])
        if isinstance(task, Input) and inputs:
            raise PlanError(f"{name}: a source takes no input")
        if not isinstance(task, Input) and not inputs:
            raise PlanError(f"{name}: needs an input")
        if isinstance(task, Output) and len(inputs) != 1:
            raise PlanError(f"{name}: a sink takes one input")
        self.tasks[name] = Task(name, task, inputs)
        return name

    def barrier(self, after: list[str], before: list[str]) -> None:
        """Nothing of ``before`` starts until all of ``after`` is done: sinks are saved, other tasks' outputs are stored first."""
        self.barriers.append((list(after), list(before)))

    def arg(self, name: str, kind: str) -> Argument:
        if name in ("spark", "ordered", "staging", "resume", "keep_checkpoint"):
            raise PlanError(f"argument {name}: the name is taken")
        if kind not in ARGUMENTS:
            raise PlanError(f"argument {name}: no type {kind!r}; there are {', '.join(ARGUMENTS)}")
        if name in self.arguments:
            raise PlanError(f"two arguments are called {name!r}")
        self.arguments[name] = Argument(name, kind)
        return self.arguments[name]

    def order(self) -> list[str]:
        """Task names, inputs first; PlanError on a cycle or an unknown name."""
        out, state = [], {}

        def visit(n: str, path: tuple) -> None:
            if n not in self.tasks:
                raise PlanError(f"{path[-1]}: no task {n!r}")
            if state.get(n) == 1:
                raise PlanError("a cycle: " + " > ".join([*path[path.index(n) :], n]))
            if n not in state:
                state[n] = 1
                for i in self.tasks[n].inputs:
                    visit(i, (*path, n))
                state[n] = 2
                out.append(n)

        for n in self.tasks:
            visit(n, ())
        return out

    def levels(self) -> list[list[str]]:
        """Tasks by the length of the longest way from a source."""
        depth: dict[str, int] = {}
        for n in self.order():
            depth[n] = 1 + max((depth[i] for i in self.tasks[n].inputs), default=-1)
        return [[n for n in depth if depth[n] == k] for k in range(max(depth.values(), default=-1) + 1)]

    def check(self, spark: SparkSession | None = None) -> None:
        """Every refusal in one PlanError: cycles, names, unread outputs, sinks over sources, barriers; with a session, schemas."""
        found: list[str] = []
        try:
            order = self.order()
        except PlanError as e:
            raise PlanError(str(e)) from None
        read = {i for t in self.tasks.values() for i in t.inputs}
        for n, t in self.tasks.items():
            if not isinstance(t.task, Output) and n not in read:
                found.append(f"{n}: nothing reads its output")
            for i in t.inputs:
                if isinstance(self.tasks[i].task, Output):
                    found.append(f"{n}: reads the sink {i}")
            if isinstance(t.task, Operator):
                try:
                    t.task.check_inputs(len(t.inputs))
                except PlanError as e:
                    found.append(f"{n}: {e}")
        if not any(isinstance(t.task, Output) for t in self.tasks.values()):
            found.append("no sink")
        plain = lambda p: re.sub(r"^file:(//)?", "", p).rstrip("/")
        sources = {plain(p): n for n, t in self.tasks.items() if isinstance(t.task, Input) and not waiting(t.task) for p in t.task.places()}
        for n, t in self.tasks.items():
            if isinstance(t.task, Output) and not waiting(t.task):
                for p in t.task.places():
                    if (s := sources.get(plain(p))) or (s := next((v for k, v in sources.items() if k.startswith(plain(p) + "/")), None)):
                        found.append(f"{n}: writes over its own source {s}")
        place = {n: i for i, n in enumerate(order)}
        for after, before in self.barriers:
            for n in [*after, *before]:
                if n not in place:
                    found.append(f"barrier: no task {n!r}")
            above = {n: self._above(n) for n in [*after, *before] if n in place}
            if any(b == a or b in above.get(a, ()) for a in after for b in before):
                found.append("barrier: a task would have to wait for itself")
        if not found:
            try:
                self._sinks()
            except PlanError as e:
                found.append(str(e))
        if spark is not None and not found:
            found += self._schemas(prepare(spark))
        if found:
            raise PlanError("; ".join(found))

    def _above(self, name: str) -> set[str]:
        out: set[str] = set()
        for i in self.tasks[name].inputs:
            out |= {i} | self._above(i)
        return out

    def _schemas(self, spark: SparkSession) -> list[str]:
        found, schemas = [], {}
        for n in self.order():
            t = self.tasks[n]
            if waiting(t.task):
                continue
            try:
                if isinstance(t.task, Input):
                    if t.task.repeatable:
                        schemas[n] = t.task.load(spark).schema
                elif isinstance(t.task, Operator) and all(i in schemas for i in t.inputs):
                    schemas[n] = t.task.plan(*(schemas[i] for i in t.inputs))
            except EngineError as e:
                found.append(f"{n}: {e}")
        return found

    def digest(self) -> str:
        what = lambda t: repr(t._waiting) if waiting(t) else t.fingerprint() if isinstance(t, Operator) else ",".join(t.places())
        parts = [f"{n}|{type(t.task).__name__}|{what(t.task)}|{','.join(t.inputs)}" for n, t in sorted(self.tasks.items())]
        return hashlib.sha256("\n".join([self.name, *parts]).encode()).hexdigest()

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The lazy DataFrame of every source and function."""
        ordered = any(isinstance(t.task, Dedupe) for t in self.tasks.values()) or self._ordered
        out: dict[str, DataFrame] = {}
        numbered_at: dict[str, DataFrame] = {}
        first = {a for after, _ in self.barriers for a in after}
        for n in self.order():
            t = self.tasks[n]
            if isinstance(t.task, Input):
                out[n] = t.task.load(spark, order=ordered)
            elif isinstance(t.task, Join):
                out[n] = self._join(n, out, numbered_at)
            elif isinstance(t.task, Operator):
                out[n] = self._apply(t.task, [out[i] for i in t.inputs])
            if self._checkpoint and isinstance(t.task, Function):
                out[n] = self._checkpoint.table(n, out[n])
            elif n in first and n in out:
                out[n] = self._keep(out[n], n)
        return out

    #: Tables that a run has stored; None outside of one, where plans are only looked at.
    _stored: list[DataFrame] | None = None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if self._stored is None:
            return df
        self._stored.append(stored(df, name.replace(":", "_")))
        return self._stored[-1]

    def _sinks(self) -> list[Task]:
        """Sinks in the order in which barriers let them be saved."""
        sinks = [t for t in self.tasks.values() if isinstance(t.task, Output)]
        waits = {t.name: {a for after, before in self.barriers if ({t.name} | self._above(t.name)) & set(before) for a in after if isinstance(self.tasks[a].task, Output)} for t in sinks}
        done: list[Task] = []
        while len(done) < len(sinks):
            free = [t for t in sinks if t not in done and waits[t.name] <= {d.name for d in done}]
            if not free:
                raise PlanError("barriers: sinks wait for one another")
            done += free
        return done

    @staticmethod
    def _apply(task: Operator, dfs: list[DataFrame]) -> DataFrame:
        """Apply with the hidden order columns carried along where rows keep theirs."""
        hidden = [c for c in ORDER if all(c in d.columns for d in dfs)]
        if not hidden or isinstance(task, Dedupe) or task.name in ("filter", "explode", "union"):
            return task.apply(*dfs)
        if task.row_wise and task.name != "select":
            return task.apply(*dfs)
        if task.name == "select":
            return type(task)([*task.columns, *[c for c in hidden if c not in task.columns]]).apply(*dfs)
        return task.apply(*[d.drop(*hidden) for d in dfs])

    def _chain(self, name: str) -> tuple[str, list[Operator]]:
        """The nearest upstream that isn't a pure projection, and the projections on the way from it."""
        operators: list[Operator] = []
        while isinstance(self.tasks[name].task, Operator) and self.tasks[name].task.row_wise and len(self.tasks[name].inputs) == 1:
            operators.insert(0, self.tasks[name].task)
            name = self.tasks[name].inputs[0]
        return name, operators

    def _join(self, n: str, out: dict[str, DataFrame], numbered_at: dict[str, DataFrame]) -> DataFrame:
        chains = [self._chain(i) for i in self.tasks[n].inputs]
        if len({c[0] for c in chains}) == 1:
            upstream = out[chains[0][0]]
            return Join.fold(upstream.drop(*[c for c in ORDER if c in upstream.columns]), [c[1] for c in chains])
        shared = set.intersection(*(self._above(i) | {i} for i in self.tasks[n].inputs))
        if not shared:
            raise PlanError(f"{n}: the inputs of a join must be branches of one task")
        top = max(shared, key=self.order().index)
        if top not in numbered_at:
            base = out[top].drop(*[c for c in ORDER if c in out[top].columns])
            numbered_at[top] = self._keep(numbered(base), f"{n}-rows")  # all branches must see the same numbers
        branch: dict[str, DataFrame] = {top: numbered_at[top]}

        def build(m: str) -> DataFrame:
            if m not in branch:
                t = self.tasks[m]
                if not isinstance(t.task, Operator) or isinstance(t.task, Function) or t.task.name in ("explode", "union"):
                    raise PlanError(f"{n}: {m} may change rows between {top} and the join")
                dfs = [build(i) for i in t.inputs]
                branch[m] = type(t.task)([*t.task.columns, "__row_id"]).apply(*dfs) if t.task.name == "select" else t.task.apply(*dfs)
            return branch[m]

        return Join().apply(*[build(i) for i in self.tasks[n].inputs])

    def explain(self, spark: SparkSession | None = None) -> str:
        """Levels and fingerprints; with a session, Spark's plan of every sink's input as well."""
        lines = [f"job {self.name} {self.digest()[:16]}"]
        for k, level in enumerate(self.levels()):
            lines += [f"level {k}: {n} <- {', '.join(self.tasks[n].inputs) or '(source)'}: {self.tasks[n].task!r}" for n in level]
        if spark is not None:
            frames = self.frames(prepare(spark))
            for n, t in self.tasks.items():
                if isinstance(t.task, Output):
                    lines.append(f"sink {n}:\n" + frames[t.inputs[0]]._jdf.queryExecution().toString())
        return "\n".join(lines)

    _ordered = False

    def run(self, spark: SparkSession, ordered: bool = False, staging: str | None = None, resume: str | None = None, keep_checkpoint: bool = False, **arguments) -> Report:
        """Check, bind arguments, and save every sink; rows are counted by the runs themselves.

        With a ``staging`` directory, saved sinks and the outputs of user functions are recorded there; ``resume`` ("auto", a
        run id or a manifest's path) goes on from such a record. It is deleted when the job completes, unless kept. An
        error carries ``run_id``.
        """
        if resume is not None and staging is None:
            raise ConfigError("resume needs a staging directory")
        job = self._bound(arguments)
        ship(prepare(spark))
        job.check()
        digest = hashlib.sha256(f"{job.digest()}|{ordered}|{sorted(arguments.items())!r}".encode()).hexdigest()
        checkpoint = Checkpoint(spark, staging, digest, resume) if staging else None
        try:
            report = job._run(spark, ordered, checkpoint)
        except EngineError as e:
            e.run_id = checkpoint.run_id if checkpoint else None
            raise
        if checkpoint:
            report.run_id, report.resumed = checkpoint.run_id, checkpoint.resumed
            if not keep_checkpoint:
                checkpoint.remove()
        return report

    _checkpoint: Checkpoint | None = None

    def _run(self, spark: SparkSession, ordered: bool, checkpoint: Checkpoint | None) -> Report:
        self._ordered, self._stored, self._checkpoint = ordered, [], checkpoint
        report, began, held = Report(self.name, self.digest()), time.time(), []
        try:
            try:
                frames, sinks = self.frames(spark), self._sinks()
            except EngineError:
                raise
            except Exception as e:
                _raise(e, "plan")
            held = [] if checkpoint else self._persist(frames, sinks)
            for t in sinks:
                if checkpoint and (rows := checkpoint.saved(t.name)) is not None:
                    report.rows[t.name] = rows
                    continue
                seen = Observation(f"{self.name}-{t.name}-{time.time_ns()}")
                df = frames[t.inputs[0]]
                watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
                try:
                    t.task.save(watched, ordered)
                except EngineError:
                    raise
                except Exception as e:
                    _raise(e, t.name)
                report.rows[t.name] = seen.get["rows"]
                if checkpoint:
                    checkpoint.save(t.name, report.rows[t.name])
                report.excluded |= getattr(t.task, "excluded", {})
        finally:
            for d in held:
                d.unpersist()
            for d in self._stored:
                drop(d)
        for t in self.tasks.values():
            if isinstance(t.task, Input):
                report.excluded |= getattr(t.task, "excluded", {})
            if isinstance(t.task, Input) and not t.task.repeatable:
                report.notes.append(f"{t.name}: not repeatable, another run may read other rows")
        report.seconds = time.time() - began
        return report

    def _persist(self, frames: dict[str, DataFrame], sinks: list[Task]) -> list[DataFrame]:
        """Keep opaque functions' outputs that reach several sinks, to run them once."""
        held = []
        for n, t in self.tasks.items():
            if isinstance(t.task, Function) and sum(n in self._above(s.name) for s in sinks) > 1:
                held.append(frames[n].persist())
        return held

    def _bound(self, given: dict) -> Job:
        """A copy of the job whose tasks have these arguments; the job itself stays as it is, for other runs."""
        found = [f"no argument {n!r}" for n in given if n not in self.arguments] + [f"argument {n!r} is missing" for n in self.arguments if n not in given]
        for n, v in given.items():
            if n in self.arguments:
                kind = ARGUMENTS[self.arguments[n].kind]
                if not isinstance(v, kind) or kind in (int, float) and isinstance(v, bool):
                    found.append(f"argument {n!r} must be {self.arguments[n].kind}, not {v!r}")
        if found:
            raise ConfigError("; ".join(found))
        out = copy.copy(self)
        out.tasks = {n: Task(n, resolved(t.task, given) if waiting(t.task) else copy.copy(t.task), t.inputs) for n, t in self.tasks.items()}
        for t in out.tasks.values():
            for k, v in list(vars(t.task).items()):
                if isinstance(v, Argument):  # set on the task after it was built
                    setattr(t.task, k, given[v.name])
            if isinstance(t.task, Function):
                t.task.bind(given, t.task if waiting(self.tasks[t.name].task) else self.tasks[t.name].task)
        return out


def _raise(e: Exception, name: str) -> None:
    """Spark's error as this package's."""
    from ..errors import BudgetError, FunctionError

    text = str(e)
    for kind in (BudgetError, FunctionError, IoError, PlanError):
        if kind.__name__ in text:
            raise kind(next((line for line in text.splitlines() if kind.__name__ in line), text)[:2000]) from e
    raise IoError(f"{name}: {text[:2000]}") from e


def run(spark: SparkSession, source: Input, functions: list, sink: Output, ordered: bool = False, name: str = "job") -> Report:
    """A chain as a job: a source, functions one after another, a sink."""
    job = Job(name)
    last = job.add(source)
    for f in functions:
        last = job.add(f if isinstance(f, Operator) else Function(f), last)
    job.add(sink, last)
    return job.run(spark, ordered=ordered)
