"""Ready-made functions over text and numbers, as native expressions where Spark has them."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..schema import field_of
from ..session import column

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Parts of a text whose places are summed up together, so that the work stays linear.
TOGETHER = 64
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: What stands between two tokens, or before the first or after the last, unless it is one blank: a run of punctuation is
#: looked through once, from its start. Most characters fail the first class, spelt out since Java has one table for single
#: characters but calls a function for each range.
BETWEEN = (
    f"[^{string.digits}{string.ascii_letters}](?:(?<= )[{PUNCTUATION}{SPACE}]++"
    rf"|(?<={PUNCTUATION})(?<!{PUNCTUATION}{{2}})(?:{PUNCTUATION}*+(?:{SPACE}|\z)|(?<=\A{PUNCTUATION}))[{PUNCTUATION}{SPACE}]*+"
    f"|(?<=[{SPACE}&&[^ ]])[{PUNCTUATION}{SPACE}]*+)"
)


def identity(df: DataFrame) -> DataFrame:
    return df


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tokens between white space, without ASCII punctuation at their ends, lower-cased, joined by one space; null stays."""
    out = df
    for n in columns:
        field_of(df.schema, n, "normalise")
        out = out.withColumn(n, F.lower(F.trim(F.regexp_replace(column(n), BETWEEN, " "))))
    return out


def tokenise(df: DataFrame, text: str, row: str | None = None) -> DataFrame:
    """A row for each token of ``text``: row_id, token_index, token_start and token_end (bytes), token.

    ``row`` names the row number; without it rows are numbered in the order of their partitions. Texts that are null or
    blank give no rows but use up a number.
    """
    number = column(row).cast("long") if row else F.monotonically_increasing_id()
    made = df.select(number.alias("row_id"), F.split(column(text), SPACE).alias("parts"))
    # Every white-space character ends a part, so a part starts after the bytes of those before and one separator each.
    # Places are summed for blocks of parts first, then inside of each block.
    blocks = F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / TOGETHER).cast("int"))
    block = lambda b: F.slice("parts", b * TOGETHER + 1, TOGETHER)
    sizes = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda acc, p: acc + F.octet_length(p) + 1))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    made = made.withColumn("starts", F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), add)["all"])
    start = lambda acc, p: F.struct((acc["at"] + F.octet_length(p) + 1).alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("start"), p.alias("token")))).alias("all"))
    none = F.array().cast("array<struct<start:int,token:string>>")
    each = F.flatten(F.transform(blocks, lambda b: F.aggregate(block(b), F.struct(F.get("starts", b).alias("at"), none.alias("all")), start)["all"]))
    tokens = F.filter(each, lambda s: s["token"] != "")
    each = made.select("row_id", F.posexplode(tokens).alias("token_index", "t"))
    return each.select("row_id", "token_index", F.col("t.start").alias("token_start"), (F.col("t.start") + F.octet_length("t.token")).alias("token_end"), F.col("t.token").alias("token"))


def embed_score(df: DataFrame, columns: list[str], weights: list[list[float]], bias: list[float], output: str = "score") -> DataFrame:
    """Numeric columns times weights plus bias, in doubles; a number if there is one output, else a list. Nulls are an error."""
    if len(weights) != len(columns) or any(len(w) != len(bias) for w in weights):
        raise PlanError("embed_score: weights must be columns x outputs")
    values = [F.when(column(n).isNull(), F.raise_error(F.lit(f"embed_score: {n} is null")).cast("double")).otherwise(column(n).cast("double")) for n in columns]
    scores = [sum((v * F.lit(float(w[k])) for v, w in zip(values, weights)), F.lit(float(b))) for k, b in enumerate(bias)]
    return df.withColumn(output, scores[0] if len(bias) == 1 else F.array(*scores))


def wide_intermediate(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upper triangle of each row's outer product: k columns become k (k + 1) / 2, named p_i_j."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], 1) if b.num_rows else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i] * x[:, j]) for i, j in pairs], [f"p_{i}_{j}" for i, j in pairs])

    schema = T.StructType([T.StructField(f"p_{i}_{j}", T.DoubleType()) for i, j in pairs])
    return df.select(*[column(n).cast("double") for n in columns]).mapInArrow(run, schema)


def amplify(df: DataFrame, row: str, midpoint: int, factor: int = 4) -> DataFrame:
    """Rows numbered below ``midpoint`` once, the others ``factor`` times."""
    times = F.when(column(row) < midpoint, F.lit(1)).otherwise(F.lit(factor))
    return df.withColumn("__times", F.explode(F.array_repeat(F.lit(0), times))).drop("__times")
