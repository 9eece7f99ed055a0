"""Governed tables: who may read what, which rows are good, and what happens to those that aren't.

A contract has an owner, exposed columns and rules. Expressions know ``ctx.*`` (the caller) and ``row.*`` (columns), the
operators == != < <= > >= && || ! and ``c ? a : b``, text and number literals, true, false, null, and ``hash_sha256(x)``.

Rules: decide (the whole read is refused unless true), admit (rows to keep), assert (row rule; on_fail deny refuses the
read, drop leaves the row out), transform (a column's new value), suppress (no rows under k, unless an expression holds),
noise (Laplace noise of scale sensitivity / epsilon on a column, charged to a budget when planned).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import BudgetError, PlanError
from ..schema import field_of, require
from ..session import column, prepare
from ..sinks.base import Output, in_order
from ..sources.base import Input

TOKEN = re.compile(r"\s*(?:(?P<op>==|!=|<=|>=|&&|\|\||[<>!?:(),])|'(?P<text>[^']*)'|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w.]*))")
BINARY = [("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">=")]


class Expression:
    """A parsed expression; ``value(ctx)`` is a Column over rows, or a plain value if no row is named."""

    def __init__(self, text: str):
        self.text, self._tokens, at = text, [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise PlanError(f"can't read {text[at:].strip()!r}")
            self._tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self._at = 0
        self.tree = self._ternary()
        if self._at < len(self._tokens):
            raise PlanError(f"{self._tokens[self._at][1]!r} is left over in {text!r}")

    def _peek(self) -> tuple[str, str]:
        return self._tokens[self._at] if self._at < len(self._tokens) else ("end", "")

    def _take(self, *values: str) -> tuple[str, str]:
        got = self._peek()
        if values and got[1] not in values:
            raise PlanError(f"{' or '.join(values)} expected in {self.text!r}, not {got[1] or 'the end'!r}")
        self._at += 1
        return got

    def _ternary(self):
        c = self._binary(0)
        if self._peek() != ("op", "?"):
            return c
        self._take("?")
        a = self._ternary()
        self._take(":")
        return ("if", c, a, self._ternary())

    def _binary(self, k: int):
        if k == len(BINARY):
            return self._unary()
        left = self._binary(k + 1)
        while self._peek()[0] == "op" and self._peek()[1] in BINARY[k]:
            left = (self._take()[1], left, self._binary(k + 1))
        return left

    def _unary(self):
        if self._peek() == ("op", "!"):
            self._take()
            return ("!", self._unary())
        kind, value = self._take()
        if (kind, value) == ("op", "("):
            inner = self._ternary()
            self._take(")")
            return inner
        if kind == "text":
            return ("lit", value)
        if kind == "number":
            return ("lit", float(value) if "." in value else int(value))
        if kind == "name" and value in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[value])
        if kind == "name" and value == "hash_sha256":
            self._take("(")
            inner = self._ternary()
            self._take(")")
            return ("hash", inner)
        if kind == "name" and value.startswith(("ctx.", "row.")):
            return (value[:3], value[4:])
        raise PlanError(f"{value or 'the end'!r} makes no sense in {self.text!r}")

    def value(self, ctx: dict, tree=None):
        tree = self.tree if tree is None else tree
        op, *parts = tree
        if op == "lit":
            return parts[0]
        if op == "ctx":
            return ctx.get(parts[0])
        if op == "row":
            return column(parts[0])
        x = [self.value(ctx, p) for p in parts]
        if not any(isinstance(v, Column) for v in x):
            return self._plain(op, x)
        c = [v if isinstance(v, Column) else F.lit(v) for v in x]
        if op == "if":
            return F.when(c[0], c[1]).otherwise(c[2])
        if op == "hash":
            return F.sha2(c[0].cast("string").cast("binary"), 256)
        if op == "!":
            return ~c[0]
        return {"||": lambda a, b: a | b, "&&": lambda a, b: a & b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op](*c)

    @staticmethod
    def _plain(op: str, x: list):
        import hashlib

        if op == "if":
            return x[1] if x[0] else x[2]
        if op == "hash":
            return None if x[0] is None else hashlib.sha256(str(x[0]).encode()).hexdigest()
        if op == "!":
            return not x[0]
        if op in ("||", "&&"):
            return bool(x[0]) or bool(x[1]) if op == "||" else bool(x[0]) and bool(x[1])
        if op in ("==", "!="):
            return (x[0] == x[1]) == (op == "==")
        return None not in x and {"<": x[0] < x[1], "<=": x[0] <= x[1], ">": x[0] > x[1], ">=": x[0] >= x[1]}[op]


RULES = {"decide", "admit", "assert", "transform", "suppress", "noise"}


@dataclass
class Contract:
    """name, location (Parquet) or a DataFrame, owner, exposed columns (all if none), and rules as dicts with ``op``."""

    name: str
    location: str | None = None
    frame: DataFrame | None = None
    owner: str = ""
    expose: list[str] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    spent: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        for r in self.rules:
            if r.get("op") not in RULES:
                raise PlanError(f"{self.name}: no rule {r.get('op')!r}; there are {', '.join(sorted(RULES))}")

    def _of(self, op: str) -> list[dict]:
        return [r for r in self.rules if r["op"] == op]

    def asserts(self, ctx: dict) -> dict[str, Column]:
        """Rule name to a column that is true for rows that break it (unknown breaks it too)."""
        ok = {r.get("name", f"assert_{i}"): Expression(r["expr"]).value(ctx) for i, r in enumerate(self._of("assert"))}
        return {n: ~F.coalesce(c, F.lit(False)) if isinstance(c, Column) else F.lit(not c) for n, c in ok.items()}

    def read(self, spark: SparkSession, caller: dict, watch: Observation | None = None) -> DataFrame:
        """What the caller may see. ``watch`` gets the number of rows that each rule leaves out (a row that breaks several counts for each)."""
        prepare(spark)
        for r in self._of("decide"):
            if not Expression(r["expr"]).value(caller):
                raise PlanError(f"{self.name}: refused for this caller ({r.get('name', r['expr'])})")
        df = self.frame if self.frame is not None else spark.read.parquet(self.location)
        for r in self._of("admit"):
            keep = Expression(r["expr"]).value(caller)
            df = df.where(keep if isinstance(keep, Column) else F.lit(bool(keep)))
        fails = self.asserts(caller)
        dropped = [r.get("name", f"assert_{i}") for i, r in enumerate(self._of("assert")) if r.get("on_fail", "drop") != "deny"]
        if watch is not None and dropped:
            df = df.observe(watch, *[F.count_if(fails[n]).alias(n) for n in dropped])
        for i, r in enumerate(self._of("assert")):
            name = r.get("name", f"assert_{i}")
            if r.get("on_fail", "drop") == "deny":
                df = df.where(F.when(fails[name], F.raise_error(F.lit(f"PlanError: {self.name}: a row breaks {name}")).cast("boolean")).otherwise(F.lit(True)))
            else:
                df = df.where(~fails[name])
        changed = {}
        for r in self._of("transform"):
            field_of(df.schema, r["column"], self.name)
            v = Expression(r["expr"]).value(caller)
            changed[r["column"]] = v if isinstance(v, Column) else F.lit(v)
        for r in self._of("noise"):
            changed[r["column"]] = self._noise(r, caller)
        for n in self.expose:
            field_of(df.schema, n, self.name)
        df = df.select(*[changed.get(n, column(n)).alias(n) for n in self.expose or df.columns])
        for r in self._of("suppress"):
            if not (r.get("unless") and Expression(r["unless"]).value(caller)):
                df = self._suppress(df, int(r["k"]), r.get("by"))
        return df

    @staticmethod
    def _suppress(df: DataFrame, k: int, by) -> DataFrame:
        """Rows of groups of k at least (of ``by``, or all as one): counts are aggregated, then joined back."""
        by = [by] if isinstance(by, str) else by or []
        if not by:
            enough = df.limit(k).agg((F.count(F.lit(1)) >= k).alias("__enough"))
            return df.crossJoin(F.broadcast(enough)).where("__enough").drop("__enough")  # one row
        sizes = df.groupBy(*map(column, by)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k)
        sizes = sizes.select(*[column(n).alias(f"__k{i}") for i, n in enumerate(by)])
        on = None
        for i, n in enumerate(by):
            c = column(n).eqNullSafe(F.col(f"__k{i}"))
            on = c if on is None else on & c
        return df.join(sizes, on, "left_semi")

    def _noise(self, r: dict, caller: dict) -> Column:
        who, epsilon = str(caller.get("id", "")), float(r["epsilon"])
        if self.spent.get(who, 0.0) + epsilon > float(r.get("budget", epsilon)):
            raise BudgetError(f"{self.name}: the noise budget is spent")
        self.spent[who] = self.spent.get(who, 0.0) + epsilon
        u = F.rand(r.get("seed")) - 0.5
        return column(r["column"]) - F.lit(float(r["sensitivity"]) / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def find(contracts: list[Contract], name: str) -> Contract:
    for c in contracts:
        if c.name == name:
            return c
    raise PlanError(f"no contract named {name!r}")


WORD = re.compile(r"""'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|`((?:[^`]|``)+)`|"((?:[^"]|"")+)"|([A-Za-z_]\w*)|([(),.])|\S""", re.S)
#: Words that end a list of tables.
ENDS = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "WINDOW", "UNION", "EXCEPT", "INTERSECT", "MINUS", "SELECT", "QUALIFY", "SORT", "CLUSTER", "DISTRIBUTE"}


def tables_of(sql: str) -> set[str]:
    """Names that stand where SQL names a table: after FROM, JOIN or a comma between tables. Texts and comments name nothing."""
    found, expected, before = set(), False, ""
    levels = [{"select": False, "tables": False}]  # of parentheses
    for m in WORD.finditer(sql):
        quoted, word, mark = m[1] and m[1].replace("``", "`") or m[2] and m[2].replace('""', '"'), m[3], m[4]
        if quoted is None and word is None and mark is None:
            expected = expected and m[0].startswith(("--", "/*"))
            continue
        upper = "" if quoted else (word or "").upper()
        if mark == "(":
            levels.append({"select": False, "tables": expected})
        elif mark == ")":
            levels = levels[:-1] or [{"select": False, "tables": False}]
            expected = False
        elif mark == ",":
            expected = levels[-1]["tables"]
        elif upper == "JOIN" or upper == "TABLE" or upper == "FROM" and levels[-1]["select"] and before != "DISTINCT":
            levels[-1]["tables"] = expected = True
        elif upper in ENDS:
            levels[-1]["tables"] = expected = False
            levels[-1]["select"] |= upper == "SELECT"
        elif upper in ("ON", "USING", "LATERAL", "AS"):
            expected = False
        elif expected and mark is None:
            found.add(quoted or word)
            expected = False
        before = upper
    return found


class ContractSource(Input):
    """Reads a contract, or SQL over contracts (exactly one of them), as a caller."""

    name, repeatable = "contract", False

    def __init__(self, contracts: list[Contract], contract: str | None = None, sql: str | None = None, caller: dict | None = None):
        if (contract is None) == (sql is None):
            raise PlanError("exactly one of contract and sql")
        self._contracts, self.contract, self.sql, self.caller = contracts, contract, sql, caller or {}
        self._watches: dict[str, Observation] = {}

    def _read(self, spark: SparkSession, c: Contract) -> DataFrame:
        if any(r["op"] == "assert" and r.get("on_fail", "drop") != "deny" for r in c.rules):
            self._watches[c.name] = Observation(f"{c.name}-read-{uuid.uuid4().hex}")
        return c.read(spark, self.caller, self._watches.get(c.name))

    @property
    def excluded(self) -> dict[str, int]:
        """After a run: rows that each rule has left out of what was read."""
        return {f"{name}.{rule}" if len(self._watches) > 1 else rule: n for name, w in self._watches.items() for rule, n in w.get.items() if n}

    def places(self):
        named = {self.contract} if self.sql is None else tables_of(self.sql)
        used = [c for c in self._contracts if c.name in named]
        return [c.location for c in used if c.location]

    def load(self, spark, order=False):
        if self.contract is not None:
            return self._read(spark, find(self._contracts, self.contract))
        from ..sources.sql import sql

        named = tables_of(self.sql)
        return sql(spark, self.sql, {c.name: self._read(spark, c) for c in self._contracts if c.name in named})


class ContractSink(Output):
    """Writes a contract as its owner. on_violation: refuse (nothing is written), exclude (bad rows go to ``excluded_url`` with
    ``_violations``), warn (all are written). ``excluded`` has the rows that broke each rule."""

    name = "contract"

    def __init__(self, contracts: list[Contract], contract: str, caller: dict, mode: str = "append", on_violation: str = "refuse", excluded_url: str | None = None):
        if mode not in ("append", "overwrite") or on_violation not in ("refuse", "exclude", "warn"):
            raise PlanError("mode is append or overwrite; on_violation is refuse, exclude or warn")
        self._contract, self.caller, self.mode, self.on_violation, self.excluded_url = find(contracts, contract), caller, mode, on_violation, excluded_url
        self.excluded: dict[str, int] = {}

    def places(self):
        return [self._contract.location] if self._contract.location else []

    def save(self, df, ordered=False):
        c = self._contract
        if self.caller.get("id") != c.owner:
            raise PlanError(f"{c.name}: only its owner writes it")
        df = in_order(df, ordered)
        if c.frame is not None:
            require({f.name: f.dataType for f in c.frame.schema}, df.schema, c.name)
        fails = c.asserts(self.caller)
        broken = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in fails.items()])) if fails else F.array().cast("array<string>")
        counts = [F.count_if(f).alias(n) for n, f in fails.items()]
        if fails and self.on_violation == "refuse":
            found = df.agg(*counts).first().asDict()
            self.excluded = {n: v for n, v in found.items() if v}
            if self.excluded:
                raise PlanError(f"{c.name}: rows break " + ", ".join(f"{n} ({v})" for n, v in self.excluded.items()))
        seen = Observation(f"{c.name}-write") if fails and self.on_violation != "refuse" else None
        judged = df.observe(seen, *counts) if seen else df
        if fails and self.on_violation == "exclude":
            bad = F.size(broken) > 0
            if self.excluded_url:
                df.withColumn("_violations", broken).where(bad).write.mode("append").parquet(self.excluded_url)
            judged = judged.where(~bad)
        judged.write.mode(self.mode).parquet(c.location)
        if seen:
            self.excluded = {n: v for n, v in seen.get.items() if v}
