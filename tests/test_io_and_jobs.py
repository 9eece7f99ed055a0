import datetime as dt
import io
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.cli import main
from millrace.errors import BudgetError, ConfigError, FunctionError, IoError, PlanError
from millrace.functions import Function, check_function, function
from millrace.operators import Cast, ConcatStr, Dedupe, Explode, Filter, Hash, Join, Mask, Select, Union
from millrace.operators.rows import ORDER
from millrace.plans import Contract, ContractSink, ContractSource, Job, from_document, run
from millrace.plans.contracts import Expression
from millrace.sinks import ArrowFileSink, ArrowStreamSink, ParquetSink, TensorSink, UserSink
from millrace.sources import ArrowFileSource, ArrowStreamSource, IteratorSource, ParquetSource, Source, Split, SqlSource, TensorSource, UserSource
from millrace.sources.tensor import read_tensors
from millrace.streaming import dedupe as stream_dedupe
from millrace.streaming import drain, read


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for k in range(3):
        pq.write_table(pa.table({"id": pa.array(range(k * 10, k * 10 + 10)), "text": [f"row {i % 7}" for i in range(10)]}), d / f"p{k}.parquet")
    (d / "notes.txt").write_text("no data")
    return d


def test_parquet_source(spark, folder):
    df = ParquetSource(str(folder), columns=["text", "id"]).load(spark, order=True)
    assert df.columns == ["id", "text", *ORDER] and df.count() == 30
    assert [r.id for r in Dedupe("text").apply(df).orderBy("id").collect()] == list(range(7))
    assert ParquetSource(str(folder), filters=[("id", "<", 5)]).load(spark).count() == 5
    assert ParquetSource(str(folder), filters=[("id", "<", 5)], exact=False).load(spark).count() == 10
    with pytest.raises(PlanError):
        ParquetSource(str(folder), columns=["nope"]).load(spark)
    pq.write_table(pa.table({"id": ["x"]}), folder / "q.parquet")
    with pytest.raises(PlanError, match="differs"):
        ParquetSource(str(folder)).load(spark)
    with pytest.raises(IoError):
        ParquetSource(str(folder / "nothing")).load(spark)


def test_arrow_files_round_trip(spark, folder, tmp_path):
    df = ParquetSource(str(folder)).load(spark)
    for codec in ("none", "zstd", "lz4"):
        out = tmp_path / codec
        ArrowFileSink(str(out), compression=codec).save(df)
        assert (out / "_SUCCESS").exists() and not list(out.glob("*.tmp"))
        back = ArrowFileSource(str(out), columns=["id"]).load(spark)
        assert sorted(r.id for r in back.collect()) == list(range(30))
        with pa.ipc.open_file(next(out.glob("*.arrow"))) as f:
            assert f.schema.names == ["id", "text"]
    with pytest.raises(PlanError):
        ArrowFileSink(str(out), compression="lz4", level=3)


def test_streams_and_iterators(spark):
    batch = pa.RecordBatch.from_pydict({"x": [1, 2], "s": pa.array(["a", "b"]).dictionary_encode()})
    body = io.BytesIO()
    with pa.ipc.new_stream(body, batch.schema) as w:
        w.write_batch(batch)
    assert [r.s for r in ArrowStreamSource(io.BytesIO(body.getvalue())).load(spark).collect()] == ["a", "b"]
    empty = batch.slice(0, 0)
    assert IteratorSource([empty, batch, empty], {"x": "int64", "s": "string"}).load(spark).count() == 2
    out = io.BytesIO()
    ArrowStreamSink(out).save(spark.range(5).toDF("n"))
    assert pa.ipc.open_stream(io.BytesIO(out.getvalue())).read_all().num_rows == 5


def test_tensors(spark, tmp_path):
    np.save(tmp_path / "w.npy", np.arange(12, dtype="f4").reshape(4, 3, order="F"))
    out = TensorSource(str(tmp_path / "w.npy")).load(spark)
    assert [list(r.w) for r in out.collect()] == np.load(tmp_path / "w.npy").tolist()
    for form, suffix in (("safetensors", ".safetensors"), ("mrb1", ".mrb")):
        TensorSink(str(tmp_path / form), format=form).save(out.coalesce(1))
        file = next((tmp_path / form).glob("*" + suffix))
        assert read_tensors(str(file), file.read_bytes())["w"][1].shape == (4, 3)
        assert TensorSource(str(file)).load(spark).schema["w"].metadata["dtype"] == "F32"
    with pytest.raises(PlanError):
        TensorSource(str(tmp_path)).load(spark)
    with pytest.raises(PlanError):
        TensorSink(str(tmp_path / "z")).save(spark.createDataFrame([("a",)], "s string"))


class Numbers(Source):
    def plan(self):
        return [Split(0, 3), Split(1, 2)]

    def read(self, split_id, start, end):
        return pa.RecordBatch.from_pydict({"n": pa.array(range(start, end)), "split": pa.array([split_id] * (end - start))})


class Short(Numbers):
    def read(self, split_id, start, end):
        return super().read(split_id, start, min(end, 2))


def test_user_source_and_sink(spark):
    assert sorted((r.split, r.n) for r in UserSource(Numbers()).load(spark).collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    with pytest.raises(Exception, match="planned 3"):
        UserSource(Short()).load(spark).collect()
    with pytest.raises(TypeError):
        UserSource(object())

    class Keep:
        def __init__(self):
            self.rows, self.done = 0, 0

        def write(self, batch):
            self.rows += batch.num_rows

        def finish(self):
            self.done += 1

    k = Keep()
    UserSink(k).save(spark.range(25).toDF("n"))
    assert (k.rows, k.done) == (25, 1)


def _double(batch):
    return pa.RecordBatch.from_pydict({"id": batch.column(0), "twice": pa.compute.multiply(batch.column(0), 2)})


def _fails(batch):
    raise ValueError("no")


class _Total:
    def setup(self, context):
        return [context["ports"].get("start", 0)]

    def __call__(self, state, batch):
        state[0] += batch.num_rows

    def finish(self, state):
        return pa.RecordBatch.from_pydict({"n": pa.array([state[0]], pa.int64())})


def test_functions(spark):
    df = spark.range(100).toDF("id")
    assert Function(_double).apply(df).agg({"twice": "sum"}).first()[0] == 9900
    assert Function(_Total(), instances=1, ports={"start": 5}).apply(df).collect()[0].n == 105
    with pytest.raises(PlanError):
        Function(_double, takes={"id": "string"}).apply(df)
    with pytest.raises(Exception, match="declared"):
        Function(_double, gives={"id": "int64"}).apply(df).collect()
    one = df.coalesce(1)
    assert Function(_fails, gives={"id": "int64"}, on_error="skip").apply(one).count() == 0
    with pytest.raises(Exception, match="BudgetError"):
        Function(_fails, gives={"id": "int64"}, on_error=("budget", 0)).apply(one).collect()
    assert set(check_function(function(_double), df.schema).values()) == {"ok"}


def test_job_graph_equals_chain(spark, folder, tmp_path):
    report = run(spark, ParquetSource(str(folder)), [Filter("id >= 10"), Hash("text")], ParquetSink(str(tmp_path / "a")))
    assert report.rows == {"parquet_2": 20} and len(report.digest) == 64
    job = Job("graph")
    s = job.add(ParquetSource(str(folder)), name="in")
    low, high = job.add(Filter("id < 5"), s), job.add(Filter("id >= 25"), s)
    u = job.add(Union(), [low, high])
    left, right = job.add(Select("id"), u), job.add(ConcatStr(["text", "id"]), u)
    right = job.add(Select("concat"), right)
    j = job.add(Join(), [left, right])
    job.add(ParquetSink(str(tmp_path / "b")), j, name="out")
    assert job.run(spark).rows == {"out": 10}
    assert {(r.id, r.concat) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {(i, f"row {i % 10 % 7}{i}") for i in [*range(5), *range(25, 30)]}
    assert job.levels()[0] == ["in"] and "level 0" in job.explain(spark)


def test_job_refusals(spark, folder, tmp_path):
    job = Job("bad")
    s = job.add(ParquetSource(str(folder)))
    job.add(Cast({"id": "string"}), s)
    job.add(ParquetSink(str(folder)), s)
    with pytest.raises(PlanError) as e:
        job.check()
    assert "nothing reads" in str(e.value) and "own source" in str(e.value)
    with pytest.raises(PlanError):
        job.add(Filter("id > 1"))
    with pytest.raises(PlanError):
        Job("no spaces")
    loop = Job("loop")
    loop.add(Mask("text"), "b", name="a")
    loop.add(Mask("text"), "a", name="b")
    with pytest.raises(PlanError, match="cycle"):
        loop.check()
    unknown = Job("unknown")
    unknown.add(ParquetSink(str(tmp_path / "x")), "nowhere")
    with pytest.raises(PlanError, match="nowhere"):
        unknown.check()
    rows = Job("rows")
    s = rows.add(ParquetSource(str(folder)))
    a, b = rows.add(Select("id"), s), rows.add(Explode("text"), s)
    rows.add(ParquetSink(str(tmp_path / "y")), rows.add(Join(), [a, b]))
    with pytest.raises(PlanError):
        rows.run(spark)


def test_arguments(spark, folder, tmp_path):
    job = Job("args")
    expr = job.arg("url", "string")
    s = job.add(ParquetSource(str(folder)))
    sink = ParquetSink(str(tmp_path / "z"))
    sink.url = expr
    job.add(sink, s)
    for bad in ({}, {"url": 3}, {"url": "a", "more": 1}):
        with pytest.raises(ConfigError):
            job.run(spark, **bad)
    assert job.run(spark, url=str(tmp_path / "w")).rows["parquet_2"] == 30


def test_document_and_command_line(spark, folder, tmp_path, capsys):
    doc = {"version": 1, "name": "d", "source": {"kind": "parquet", "options": {"urls": str(folder)}}, "kernels": [{"function": "filter", "args": {"expr": "id < 12"}}], "sink": {"kind": "parquet", "options": {"url": str(tmp_path / "out")}}}
    job, ordered = from_document(json.dumps(doc))
    assert job.run(spark, ordered=ordered).rows["parquet_2"] == 12
    for change in ({"version": 2}, {"extra": 1}, {"source": {"kind": "nope"}}, {"kernels": [{"function": "filter", "args": {}}]}):
        with pytest.raises(ConfigError):
            from_document(json.dumps(doc | change))
    (tmp_path / "bad.json").write_text("{")
    assert main(["run", str(tmp_path / "bad.json")]) == 2


def test_sql_source(spark, folder):
    out = SqlSource('SELECT id % 3 AS k, count(*) AS n FROM "demo/rows" GROUP BY id % 3', {"demo/rows": ParquetSource(str(folder))}).load(spark)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 10), (1, 10), (2, 10)]
    with pytest.raises(PlanError):
        SqlSource("SELECT nope FROM t", {"t": spark.range(1)}).load(spark)


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(i, "EA" if i % 2 == 0 else "WA", f"M{i}", None if i == 3 else i - 1) for i in range(10)], "id long, region string, meter string, kwh long")
    rules = [{"op": "decide", "expr": "ctx.purpose == 'analytics'"}, {"op": "admit", "expr": "ctx.tenant == 'demo' || row.region == 'EA'"}, {"op": "assert", "name": "kwh", "expr": "row.kwh >= 0"}, {"op": "transform", "column": "meter", "expr": "hash_sha256(row.meter)"}]
    c = Contract("demo/readings", frame=df, location=str(tmp_path / "w"), owner="ops", rules=rules)
    with pytest.raises(PlanError, match="refused"):
        c.read(spark, {})
    assert sorted(r.id for r in c.read(spark, {"purpose": "analytics"}).collect()) == [2, 4, 6, 8]
    assert ContractSource([c], contract="demo/readings", caller={"purpose": "analytics", "tenant": "demo"}).load(spark).count() == 8
    assert ContractSource([c], sql='SELECT count(*) AS n FROM "demo/readings"', caller={"purpose": "analytics"}).load(spark).first().n == 4
    with pytest.raises(PlanError, match="no contract"):
        ContractSource([c], contract="x").load(spark)
    with pytest.raises(PlanError):
        ContractSource([c])
    with pytest.raises(PlanError, match="owner"):
        ContractSink([c], "demo/readings", {"id": "me"}).save(df)
    with pytest.raises(PlanError, match="kwh \\(2\\)"):
        ContractSink([c], "demo/readings", {"id": "ops"}).save(df)
    assert not (tmp_path / "w").exists()
    bad = ContractSink([c], "demo/readings", {"id": "ops"}, on_violation="exclude", excluded_url=str(tmp_path / "bad"))
    bad.save(df)
    assert bad.excluded == {"kwh": 2} and spark.read.parquet(str(tmp_path / "w")).count() == 8
    assert [r._violations for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [["kwh"], ["kwh"]]
    ContractSink([c], "demo/readings", {"id": "ops"}, mode="overwrite", on_violation="warn").save(df)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 10
    noisy = Contract("n", frame=df, rules=[{"op": "noise", "column": "kwh", "sensitivity": 1, "epsilon": 0.5, "budget": 0.8, "seed": 1}])
    noisy.read(spark, {"id": "a"})
    with pytest.raises(BudgetError):
        noisy.read(spark, {"id": "a"})
    small = Contract("s", frame=df, rules=[{"op": "suppress", "k": 11}])
    assert small.read(spark, {}).count() == 0
    assert Expression("ctx.a == 1 ? 'x' : 'y'").value({"a": 1}) == "x"
    with pytest.raises(PlanError):
        Expression("row.x ===")


def test_streaming_goes_on_from_its_checkpoint(spark, tmp_path):
    src = tmp_path / "s"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").coalesce(1).write.parquet(str(src))
    df = stream_dedupe(read(spark, str(src), spark.read.parquet(str(src)).schema), ["k"])
    assert drain(df, str(tmp_path / "o"), str(tmp_path / "c")) == 3
    spark.createDataFrame([(2, "d"), (3, "e")], "k long, v string").coalesce(1).write.mode("append").parquet(str(src))
    df = stream_dedupe(read(spark, str(src), spark.read.parquet(str(src)).schema), ["k"])
    assert drain(df, str(tmp_path / "o"), str(tmp_path / "c")) == 2
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3]


def test_parquet_filters_rows_of_other_number_types(spark, tmp_path):
    pq.write_table(pa.table({"x": [1.0, 2.0, 30.0], "k": [1, 2, 30]}), tmp_path / "a.parquet")
    assert [r.x for r in ParquetSource(str(tmp_path), filters=[("x", ">", 10)]).load(spark).collect()] == [30.0]
    assert [r.k for r in ParquetSource(str(tmp_path), filters=[("k", "<", 1.5)]).load(spark).collect()] == [1]
    assert ParquetSource(str(tmp_path), filters=[("x", ">", 100)], exact=False).load(spark).count() == 3


def test_parquet_keeps_the_given_order_of_files(spark, tmp_path):
    for d, v in (("b one", 1), ("a+two", 2), ("c%three", 3)):
        (tmp_path / d).mkdir()
        pq.write_table(pa.table({"id": [v, v + 10]}), tmp_path / d / "part.parquet")
    df = ParquetSource([str(tmp_path / d) for d in ("b one", "a+two", "c%three")]).load(spark, order=True)
    assert [r.id for r in df.orderBy(*ORDER).collect()] == [1, 11, 2, 12, 3, 13]
    some = ParquetSource([str(tmp_path / d) for d in ("b one", "a+two", "c%three")], filters=[("id", ">", 11)], exact=False).load(spark)
    assert sorted(r.id for r in some.collect()) == [2, 3, 12, 13]


class Plus:
    """A class task that reads a run argument, and one that stands for its own attribute."""

    def __init__(self, column):
        self.column = column

    def __call__(self, batch):
        return pa.RecordBatch.from_pydict({"id": pa.compute.add(batch.column(self.column), self.args["by"])})


def test_a_job_runs_again_with_other_arguments(spark, folder, tmp_path):
    job = Job("twice")
    col, by = job.arg("col", "string"), job.arg("by", "int")
    src = job.add(ParquetSource(str(folder)))
    one = job.add(Mask(col), src)
    one = job.add(Filter(job.arg("keep", "string")), one)
    two = job.add(Function(Plus("id"), gives={"id": "int64"}), src)
    job.add(ParquetSink(str(tmp_path / "m")), one, name="m")
    job.add(ParquetSink(str(tmp_path / "p")), two, name="p")
    assert by.kind == "int"
    read_back = lambda n: spark.read.parquet(str(tmp_path / n))
    for arguments, least in (({"col": "text", "by": 5, "keep": "id >= 2"}, 5), ({"col": "text", "by": 7, "keep": "id >= 3"}, 7)):
        for n in ("m", "p"):
            if (tmp_path / n).exists():
                import shutil

                shutil.rmtree(tmp_path / n)
        job.run(spark, **arguments)
        assert read_back("p").agg({"id": "min"}).first()[0] == least and read_back("m").agg({"id": "min"}).first()[0] == int(arguments["keep"][-1])
    with pytest.raises(PlanError):
        job.run(spark, col="nope", by=1, keep="id > 1")
    job.check()
    assert read_back("m").first().text.startswith("*")


def test_join_of_branches_that_filter_pairs_stored_rows(spark, folder, tmp_path):
    job = Job("pairs")
    src = job.add(ParquetSource(str(folder)))
    top = job.add(Function(lambda b: b, gives={"id": "int64", "text": "string"}, name="shuffled"), src)
    one = job.add(Filter("id > 4"), job.add(Select(["id"]), top))
    two = job.add(Select(["text"]), job.add(Filter("id > 4"), top))
    job.add(ParquetSink(str(tmp_path / "o")), job.add(Join(), [one, two]))
    job.run(spark)
    assert sorted((r.id, r.text) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == sorted((i, f"row {i % 10 % 7}") for i in range(5, 30))


def test_barriers_hold_back_what_comes_after(spark, folder, tmp_path):
    job, (first, second) = Job("held"), (tmp_path / "first", tmp_path / "second")

    def late(batch):
        assert (first / "_SUCCESS").exists()
        return batch

    src = job.add(ParquetSource(str(folder)))
    held = job.add(Function(late, gives={"id": "int64", "text": "string"}), src)
    job.add(ParquetSink(str(second)), held, name="second")
    job.add(ParquetSink(str(first)), src, name="first")
    job.barrier(["first"], [held])
    job.run(spark)
    assert spark.read.parquet(str(second)).count() == 30
    job.barrier(["second"], ["first"])
    with pytest.raises(PlanError, match="wait for one another"):
        job.check()
    other = Job("stored")
    src = other.add(ParquetSource(str(folder)))
    a = other.add(Filter("id > 4"), src)
    other.add(ParquetSink(str(tmp_path / "a")), a, name="a")
    other.add(ParquetSink(str(tmp_path / "b")), other.add(Select(["id"]), src, name="s"), name="b")
    other.barrier([a], ["s"])
    assert other.run(spark).rows == {"a": 25, "b": 30}


def test_sql_over_contracts_reads_the_named_ones_only(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    refused = Contract("a", frame=df, rules=[{"op": "decide", "expr": "false"}])
    good = Contract("data", frame=df, rules=[{"op": "assert", "name": "small", "expr": "row.a < 3"}])
    source = ContractSource([refused, good], sql="SELECT a, 'FROM a' AS x FROM data -- JOIN a\nWHERE a IN (SELECT a FROM data)")
    assert [r.a for r in source.load(spark).collect()] == [1]
    from millrace.plans.contracts import tables_of

    assert tables_of('WITH w AS (SELECT * FROM "x/y") SELECT extract(year FROM ts) FROM w LEFT JOIN `b c` USING (k), d WHERE p IS DISTINCT FROM q') == {"x/y", "w", "b c", "d"}
    assert tables_of("SELECT * FROM (a JOIN b ON a.x = b.x), (SELECT * FROM c, e) f, g") == {"a", "b", "c", "e", "g"}


def test_a_run_counts_what_rules_leave_out(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else i - 2) for i in range(10)], "id long, kwh long")
    c = Contract("readings", frame=df, rules=[{"op": "assert", "name": "kwh", "expr": "row.kwh >= 0"}, {"op": "assert", "name": "id", "expr": "row.id != 9"}])
    job = Job("governed")
    job.add(ParquetSink(str(tmp_path / "o")), job.add(ContractSource([c], contract="readings")))
    report = job.run(spark)
    assert report.rows == {"parquet": 6} and report.excluded == {"kwh": 3, "id": 1} and "not repeatable" in report.notes[0]


def test_a_job_goes_on_from_its_checkpoint(spark, folder, tmp_path):
    staging, ran, broken = tmp_path / "staging", tmp_path / "ran", tmp_path / "broken"
    staging.mkdir()
    ran.mkdir()
    broken.touch()

    def slow(batch):
        if batch.num_rows:
            (ran / f"{batch.column('id')[0].as_py()}-{len(list(ran.iterdir()))}").touch()
        return batch

    def weak(batch):
        if broken.exists() and batch.num_rows:
            raise ValueError("not today")
        return batch

    def job(keep="id >= 0"):
        j = Job("again")
        src = j.add(Filter(keep), j.add(ParquetSource(str(folder))))
        first = j.add(Function(slow, gives={"id": "int64", "text": "string"}), src)
        j.add(ParquetSink(str(tmp_path / "a")), first, name="a")
        j.add(ParquetSink(str(tmp_path / "b")), j.add(Function(weak, gives={"id": "int64", "text": "string"}), first), name="b")
        return j

    with pytest.raises(FunctionError) as failed:
        job().run(spark, staging=str(staging))
    calls = len(list(ran.iterdir()))
    assert calls and len(list(staging.iterdir())) == 1
    from millrace.errors import ResumeError

    with pytest.raises(ResumeError, match="another job"):
        job("id > 3").run(spark, staging=str(staging), resume=failed.value.run_id)
    with pytest.raises(ResumeError, match="no checkpoint"):
        job().run(spark, staging=str(staging), resume="0" * 32)
    with pytest.raises(ConfigError):
        job().run(spark, resume="auto")
    broken.unlink()
    report = job().run(spark, staging=str(staging), resume="auto", keep_checkpoint=True)
    assert report.resumed and report.rows == {"a": 30, "b": 30} and len(list(ran.iterdir())) == calls
    again = job().run(spark, staging=str(staging), resume=f"{staging}/millrace-{report.run_id}/manifest.json")
    assert again.resumed and again.rows == report.rows and not list(staging.iterdir())
    assert spark.read.parquet(str(tmp_path / "b")).count() == 30


def test_documents_take_arguments_and_a_checkpoint(spark, folder, tmp_path):
    (tmp_path / "staging").mkdir()
    doc = {"version": 1, "name": "d", "arguments": {"least": "string"}, "staging": {"dir": str(tmp_path / "staging")}, "resume": "auto", "source": {"kind": "parquet", "options": {"urls": str(folder)}}, "kernels": [{"function": "filter", "args": {"expr": {"arg": "least"}}}], "sink": {"kind": "parquet", "options": {"url": str(tmp_path / "out")}}}
    (tmp_path / "job.json").write_text(json.dumps(doc))
    assert main(["run", str(tmp_path / "job.json"), "--arg", "least=id >= 25"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert main(["run", str(tmp_path / "job.json")]) == 2
    for bad in ({"arguments": {"x": "nope"}}, {"arguments": {}}, {"staging": {"keep": True}}):
        (tmp_path / "bad.json").write_text(json.dumps(doc | bad))
        assert main(["run", str(tmp_path / "bad.json"), "--arg", "least=id >= 25"]) == 2
