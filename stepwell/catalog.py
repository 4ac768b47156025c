"""Queries of the engine's own operators over the driver's tables, with SQL for the oracle.

Queries that run steps do so under a folder of their own in the shared checkpoint folder, as a job on a cluster would.
"""

from __future__ import annotations

import contextlib
import datetime
import enum
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stepwell as sw
from stepwell.functions import absolute_error, tag
from stepwell.operators import grid, relational
from stepwell.operators.concat import concat_iter
from stepwell.plans import graph, records
from stepwell.plans.functional import Workflow as FunctionFlow
from stepwell.sources import files, history, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the place that driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        files.cut(spark.range(1))
    return f"{sc.getCheckpointDir()}/flow-{uuid.uuid4().hex}"


@contextlib.contextmanager
def quiet() -> Iterator[None]:
    """Without a run history: a query must not leave one in the folder it is called from."""
    kept = sw.settings.events
    sw.settings.events = False
    try:
        yield
    finally:
        sw.settings.events = kept


def ran(task, spark: SparkSession, sf: str, **params) -> sw.Workflow:
    flow = sw.Workflow(task, {"sf": sf, **params}, scratch(spark))
    with quiet():
        flow.run()
    return flow


class Step(sw.TaskParquet):
    """A step over one of the driver's tables."""

    sf = sw.Parameter(significant=False)

    def read(self, name: str) -> DataFrame:
        return table(files.active(), self.sf, name)


# ------------------------------------------------------------------------------------------ scans, sinks, steps


def _round_trip(target: type, ext: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = target(f"{scratch(spark)}/customer.{ext}")
        t.save(table(spark, sf, "customer"))
        loaded = t.load()
        if ext == "cache":
            loaded = files.cut(loaded)  # so that what is held in memory can go
            t.invalidate()
        return loaded

    return run


for _name, _target, _ext in (
    ("scan_parquet", targets.ParquetTarget, "parquet"), ("scan_csv", targets.CSVTarget, "csv"), ("scan_csv_gz", targets.CSVGZTarget, "csv.gz"),
    ("scan_json", targets.JsonLinesTarget, "jsonl"), ("scan_orc", targets.OrcTarget, "orc"), ("scan_memory", targets.FrameCacheTarget, "cache"),
):
    QUERIES[_name] = _round_trip(_target, _ext)
    ORACLE_SQL[_name] = "select * from customer"


class OpenOrders(Step):
    def run(self):
        self.save(self.read("orders").where("o_orderstatus <> 'P'"))


@sw.requires(OpenOrders)
class PricedOrders(Step):
    least = sw.FloatParameter(default=1000.0)

    def run(self):
        self.save(self.inputLoad().where(F.col("o_totalprice") >= self.least).withColumn("o_double", F.col("o_totalprice") * 2))


@sw.requires(PricedOrders)
class OrdersByPriority(Step):
    def run(self):
        got = self.inputLoad().groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.max("o_double"), 2).alias("most"))
        self.save(got)


@query("select o_orderpriority, count(*) as n, round(max(o_totalprice * 2), 2) as most from orders where o_orderstatus <> 'P' and o_totalprice >= 1000 group by 1")
def task_chain(spark, sf):
    return ran(OrdersByPriority, spark, sf).outputLoad()


class SplitLines(Step):
    persists = ["x", "y"]

    def run(self):
        df = self.read("lineitem")
        keys = ["l_orderkey", "l_linenumber"]
        self.save({"x": df.select(*keys, "l_quantity", "l_discount", "l_tax"), "y": df.select(*keys, "l_extendedprice")})


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem")
def multi_output_split(spark, sf):
    return ran(SplitLines, spark, sf).outputLoad(keys="y")


class SupplierFile(Step):
    external = True
    save_attrib = False


@query("select * from supplier where s_acctbal > 0")
def external_scan(spark, sf):
    root = scratch(spark)
    targets.ParquetTarget(f"{root}/SupplierFile/SupplierFile-data.parquet").save(table(spark, sf, "supplier"))

    @sw.requires(SupplierFile)
    class Positive(Step):
        def run(self):
            self.save(self.inputLoad().where("s_acctbal > 0"))

    flow = sw.Workflow(Positive, {"sf": sf}, root)
    with quiet():
        flow.run()
    return flow.outputLoad()


@query("select 'customer' as name, count(*) as n from customer union all select 'nation', count(*) from nation")
def json_output(spark, sf):
    class Counts(Step):
        target, ext = targets.JsonTarget, "json"

        def run(self):
            self.save({n: self.read(n).count() for n in ("customer", "nation")})

    got = ran(Counts, spark, sf).outputLoad()
    return spark.createDataFrame(sorted(got.items()), "name string, n long")


@query("select r_regionkey as k, upper(r_name) as name from region")
def functional_flow(spark, sf):
    flow = FunctionFlow(scratch(spark))

    @flow.task(sw.TaskParquet)
    def regions(self):
        self.save(table(files.active(), sf, "region"))

    @flow.task(sw.TaskParquet)
    def shouted(self):
        self.save(self.inputLoad().select(F.col("r_regionkey").alias("k"), F.upper("r_name").alias("name")))

    flow.requires(regions)(shouted)
    with quiet():
        flow.run(shouted)
    return flow.outputLoad(shouted)


# ---------------------------------------------------------------------------------------------- tagged union


def _by_status(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    full = table(spark, sf, "orders")
    return [(s, {"status": s, "rank": k}, full.where(F.col("o_orderstatus") == s).select(*orders.columns)) for k, s in enumerate(STATUSES)]


_STATUS_SQL = "select o_orderkey, o_custkey, o_orderstatus as status, cast(case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as integer) as rank from orders"


@query(_STATUS_SQL)
def concat_tagged(spark, sf):
    return concat_iter(_by_status(spark, sf))


@query("select o_orderkey, o_custkey, o_orderstatus as status from orders")
def concat_tagkeys(spark, sf):
    return concat_iter(_by_status(spark, sf), keys=["status"])


@query("select o_orderkey, o_custkey from orders")
def concat_untagged(spark, sf):
    return concat_iter(_by_status(spark, sf), keys=[])


@query("select o_orderkey + 10 * case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as k from orders")
def concat_fn(spark, sf):
    return concat_iter(_by_status(spark, sf), concat_fn=lambda i, p, df: df.select((F.col("o_orderkey") + 10 * p["rank"]).alias("k")))


@query("select n_name, 'nation' as src, cast(n_regionkey as varchar) as n_key, cast(null as varchar) as r_key from nation union all select r_name, 'region', null, cast(r_regionkey as varchar) from region")
def concat_schema_drift(spark, sf):
    nation = table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_key"))
    region = table(spark, sf, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").cast("string").alias("r_key"))
    return concat_iter([("n", {"src": "nation"}, nation), ("r", {"src": "region"}, region)])


@query("select c_custkey, c_name, c_nationkey, c_acctbal, 'ALL' as c_mktsegment from customer")
def concat_tag_collision(spark, sf):
    return concat_iter([("all", {"c_mktsegment": "ALL"}, table(spark, sf, "customer"))])


@query("select o_orderkey, 'first' as part, o_orderstatus as status from orders")
def concat_list(spark, sf):
    items = [(s, {"status": s}, [df.select("o_orderkey"), df.select("o_custkey")]) for s, _, df in _by_status(spark, sf)]
    return concat_iter(items)[0].withColumn("part", F.lit("first"))


@query("select o_custkey, o_orderstatus as status from orders")
def concat_dict(spark, sf):
    items = [(s, {"status": s}, {"keys": df.select("o_orderkey"), "customers": df.select("o_custkey")}) for s, _, df in _by_status(spark, sf)]
    return concat_iter(items)["customers"]


class CustomerParts(Step):
    persists = ["names", "money"]
    segment = sw.Parameter()

    def run(self):
        df = self.read("customer").where(F.col("c_mktsegment") == self.segment)
        self.save([df.select("c_custkey", "c_name"), df.select("c_custkey", "c_acctbal")], from_list=True)


@sw.requires_each(CustomerParts, segment=SEGMENTS)
class AllParts(Step):
    def run(self):
        self.save(self.inputLoadConcat(keys="money", tagkeys=["segment"]))


@query("select c_custkey, c_acctbal, c_mktsegment as segment from customer")
def concat_multi_output(spark, sf):
    return ran(AllParts, spark, sf).outputLoad()


# --------------------------------------------------------------------------------------------------- fan-out


class Segment(Step):
    segment = sw.Parameter()

    def run(self):
        self.save(self.read("customer").where(F.col("c_mktsegment") == self.segment).select("c_custkey", "c_nationkey", "c_acctbal"))


@sw.requires_each(Segment, segment=SEGMENTS)
class BalanceByNation(Step):
    def run(self):
        got = self.inputLoadConcat()
        self.save(got.groupBy("segment", "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("*").alias("n")))


_FANOUT = "select c_mktsegment as segment, c_nationkey, round(sum(c_acctbal), 2) as balance, count(*) as n from customer group by 1, 2"


@query(_FANOUT)
def fanout_concat(spark, sf):
    return ran(BalanceByNation, spark, sf).outputLoad()


class FusedBalance(sw.TaskFused):
    """The same fan-out as one query, stored a partition a segment."""

    sf = sw.Parameter(significant=False)
    tag = "segment"

    def values(self):
        return SEGMENTS

    def build(self, values):
        df = table(files.active(), self.sf, "customer").where(F.col("c_mktsegment").isin(*values))
        return df.groupBy(F.col("c_mktsegment").alias("segment"), "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("*").alias("n"))


@query(_FANOUT)
def fanout_fused(spark, sf):
    return ran(FusedBalance, spark, sf).outputLoad()


class FusedLines(sw.TaskFused):
    """Branches by a tag of any type, null included."""

    sf = sw.Parameter(significant=False)
    kind = sw.ChoiceParameter(choices=["boolean", "double", "date", "text"], default="boolean")
    tag = "tag"

    def values(self):
        return {
            "boolean": [True, False, None],
            "double": [1e-07, 2.5, 1e20, None],
            "date": [datetime.date(2024, 2, 29), datetime.date(1999, 12, 31), None],
            "text": ["a/b=c", "ö %:x", "none here", None],
        }[self.kind]

    def build(self, values):
        chosen = {"boolean": ("true", "false"), "double": ("1e-07D", "2.5D"), "date": ("date'2024-02-29'", "date'1999-12-31'"), "text": ("'a/b=c'", "'ö %:x'")}[self.kind]
        tag = F.expr(f"case l_linenumber % 3 when 0 then {chosen[0]} when 1 then {chosen[1]} end")
        return table(files.active(), self.sf, "lineitem").select("l_orderkey", "l_linenumber", tag.alias("tag"))


@query(
    """
with k as (select l_orderkey, l_linenumber, l_linenumber % 3 as m from lineitem)
select kind, l_orderkey, l_linenumber, case when m = 2 then null else v end as tag from k join (values
  ('boolean', 0, 'true'), ('boolean', 1, 'false'), ('boolean', 2, ''), ('double', 0, '1.0E-7'), ('double', 1, '2.5'), ('double', 2, ''),
  ('date', 0, '2024-02-29'), ('date', 1, '1999-12-31'), ('date', 2, ''), ('text', 0, 'a/b=c'), ('text', 1, 'ö %:x'), ('text', 2, '')) t(kind, n, v) on m = n
"""
)
def fanout_fused_types(spark, sf):
    parts = [ran(FusedLines, spark, sf, kind=k).outputLoad().select(F.lit(k).alias("kind"), "l_orderkey", "l_linenumber", F.col("tag").cast("string").alias("tag")) for k in ("boolean", "double", "date", "text")]
    return reduce(DataFrame.union, parts)


class Cell(Step):
    segment = sw.Parameter()
    status = sw.Parameter()

    def run(self):
        c = self.read("customer").where(F.col("c_mktsegment") == self.segment).select("c_custkey")
        o = self.read("orders").where(F.col("o_orderstatus") == self.status).select("o_custkey")
        self.save(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n")))


@sw.requires_each(Cell, segment=SEGMENTS, status=STATUSES)
class Cells(Step):
    def run(self):
        self.save(self.inputLoadConcat())


@query(
    """
with g as (select * from (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) s(segment), (values ('F'), ('O'), ('P')) t(status))
select segment, status, (select count(*) from orders join customer on o_custkey = c_custkey where c_mktsegment = segment and o_orderstatus = status) as n from g
"""
)
def fanout_grid(spark, sf):
    return ran(Cells, spark, sf).outputLoad()


class Rich(Step):
    segment = sw.Parameter()
    least = sw.IntParameter()

    def run(self):
        self.save(self.read("customer").where((F.col("c_mktsegment") == self.segment) & (F.col("c_acctbal") >= self.least)).select("c_custkey"))


@sw.requires_each(Rich, segment=SEGMENTS, derive={"least": lambda v: 500 * len(v["segment"])})
class AllRich(Step):
    def run(self):
        self.save(self.inputLoadConcat())


@query("select c_custkey, c_mktsegment as segment, cast(500 * length(c_mktsegment) as integer) as least from customer where c_acctbal >= 500 * length(c_mktsegment)")
def fanout_derive(spark, sf):
    return ran(AllRich, spark, sf).outputLoad()


class Nation(Step):
    nation = sw.IntParameter()

    def run(self):
        self.save(self.read("supplier").where(F.col("s_nationkey") == self.nation).select("s_suppkey"))


@sw.requires_each(Nation, nation=lambda task: list(range(task.nations)))
class SomeNations(Step):
    nations = sw.IntParameter(default=3)

    def run(self):
        self.save(self.inputLoadConcat(tagkeys=["nation"]))


@query("select s_suppkey, s_nationkey as nation from supplier")
def fanout_callable(spark, sf):
    return ran(SomeNations, spark, sf, nations=25).outputLoad()


class Nations(Step):
    def run(self):
        self.save(self.read("nation").select("n_nationkey", "n_name"))


@sw.requires(Nations)
@sw.requires_each(Segment, segment=SEGMENTS)
class Named(Step):
    def run(self):
        got = self.inputLoadConcat(task=Segment)
        self.save(got.join(self.inputLoad(task="Nations"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "segment", "n_name"))


@query("select c_custkey, c_mktsegment as segment, n_name from customer join nation on c_nationkey = n_nationkey")
def fanout_shared_dep(spark, sf):
    return ran(Named, spark, sf).outputLoad()


@sw.requires_each({"people": Segment}, segment=SEGMENTS)
@sw.requires_each({"wealth": Rich}, segment=SEGMENTS, derive={"least": lambda v: 3000})
class Groups(Step):
    def run(self):
        got = self.inputLoadConcat(flatten=False)
        parts = [df.select("c_custkey", "segment", tag(name).alias("part")) for name, df in got.items()]
        self.save(parts[0].unionByName(parts[1]))


@query(
    """
select c_custkey, c_mktsegment as segment, 'people' as part from customer
union all select c_custkey, c_mktsegment, 'wealth' from customer where c_acctbal >= 3000
"""
)
def fanout_named_groups(spark, sf):
    return ran(Groups, spark, sf).outputLoad()


@sw.requires_each(Segment, segment=SEGMENTS)
class Pair(sw.TaskAggregator):
    sf = sw.Parameter(significant=False)


@query("select c_custkey, c_nationkey, c_acctbal from customer")
def aggregator_union(spark, sf):
    return reduce(DataFrame.unionByName, ran(Pair, spark, sf).outputLoad())


@query(
    """
select n_regionkey, n_nationkey, round(sum(c_acctbal), 2) as balance, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2
"""
)
def hierarchy_rollup(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = relational.hierarchy(joined, ["n_regionkey", "n_nationkey"], {"balance": F.col("c_acctbal"), "n": F.lit(1).cast("long")})
    return levels["n_nationkey"].withColumn("balance", F.round("balance", 2))


@query("select n_regionkey, round(sum(c_acctbal), 2) as balance, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def hierarchy_top(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = relational.hierarchy(joined, ["n_regionkey", "n_nationkey"], {"balance": F.col("c_acctbal"), "n": F.lit(1).cast("long")})
    return levels["n_regionkey"].withColumn("balance", F.round("balance", 2))


# ----------------------------------------------------------------------------------------------------- flows


class RegionNations(Step):
    region = sw.IntParameter()

    def run(self):
        self.save(self.read("nation").where(F.col("n_regionkey") == self.region).select("n_nationkey", "n_name"))


_REGIONS = "select n_nationkey, n_name, n_regionkey as region from nation"


@query(_REGIONS)
def multiflow_concat(spark, sf):
    flow = sw.WorkflowMulti(RegionNations, {f"r{k}": {"region": k, "sf": sf} for k in range(5)}, scratch(spark))
    with quiet():
        flow.run()
    return flow.outputLoadConcat(tagkeys=["region"])


@query("select n_nationkey, n_name, n_regionkey as region from nation")
def run_iter_concat(spark, sf):
    with quiet():
        got = sw.runIterConcat(RegionNations, [{"region": k, "sf": sf} for k in range(5)], path=scratch(spark))
    return got.drop("sf")


@query("select concat('a_', a, '_b_', b) as key, a, b from (values (1), (2)) x(a), (values ('x'), ('y')) y(b)")
def grid_named(spark, sf):
    return grid.grid_frame(spark, {"b": ["x", "y"], "a": [1, 2]})


@query("select cast(i + 3 * j as integer) as key, a, b from (values (0, 10), (1, 20), (2, 30)) x(i, a), (values (0, 'x'), (1, 'y')) y(j, b)")
def grid_indexed(spark, sf):
    return grid.grid_index_frame(spark, {"a": [10, 20, 30], "b": ["x", "y"]})


@query("select * from (values (0, 'F', 7), (1, 'O', 7), (2, 'P', 7)) t(key, status, base)")
def grid_single(spark, sf):
    got = sw.params_generator_single({"status": STATUSES}, {"base": 7})
    return spark.createDataFrame([(k, v["status"], v["base"]) for k, v in got.items()], "key int, status string, base int")


@query("select n_nationkey as nation, n_name as name, 1 as base from nation where n_regionkey <> 2")
def params_from_rows(spark, sf):
    df = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("name"))
    got = sw.params_generator_df(df, {"base": 1})
    return spark.createDataFrame([(p["nation"], p["name"], p["base"]) for p in got.values()], "nation int, name string, base int")


# ----------------------------------------------------------------------------------------------------- graph


class Base(sw.TaskParquet):
    pass


@sw.requires(Base)
class MidX(sw.TaskParquet):
    pass


@sw.requires(Base)
class MidY(sw.TaskParquet):
    pass


class Other(sw.TaskParquet):
    pass


@sw.requires(MidX, MidY, Other)
class Top(sw.TaskParquet):
    pass


_EDGES = "e(src, dst) as (select * from (values ('Top', 'MidX'), ('Top', 'MidY'), ('Top', 'Other'), ('MidX', 'Base'), ('MidY', 'Base')) v(src, dst))"


@query(f"with {_EDGES} select src, dst from e")
def dag_edges(spark, sf):
    return graph.edges_frame(spark, Top()).select(F.col("src_family").alias("src"), F.col("dst_family").alias("dst"))


def _families(spark, tasks):
    return spark.createDataFrame([(t.task_family,) for t in tasks], "family string")


@query(f"with recursive {_EDGES}, r(n) as (select 'Top' union select e.dst from r join e on e.src = r.n) select n as family from r where n <> 'Top'")
def dag_upstream(spark, sf):
    return _families(spark, sw.Workflow(Top).dependencies())


@query(
    f"""
with recursive {_EDGES}, d(n) as (select 'Top' union select e.dst from d join e on e.src = d.n),
u(n) as (select 'Base' union select e.src from u join e on e.dst = u.n) select n as family from d where n in (select n from u)
"""
)
def dag_band(spark, sf):
    return _families(spark, sw.Workflow(Top).dependents(Base))


@query(f"with recursive {_EDGES}, p(n, path) as (select 'Top', 'Top' union all select e.dst, p.path || '>' || e.dst from p join e on e.src = p.n) select path from p where n = 'Base'")
def dag_paths(spark, sf):
    paths = sw.Workflow(Top).dependents(Base, paths=True)
    return spark.createDataFrame([(">".join(t.task_family for t in p),) for p in paths], "path string")


@query(
    """
with recursive e(src, dst) as (select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
r(n) as (select 'r1' union select e.dst from r join e on e.src = r.n) select n from r
"""
)
def graph_reach(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(
        customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"))
    )
    return relational.reach(edges, spark.createDataFrame([("r1",)], "n string"))


# --------------------------------------------------------------------------------------------------- history


def _log(spark, sf):
    """The events table in the columns of a run history."""
    kinds = {"view": "task_ran", "purchase": "code_accepted", "click": "task_ran", "signup": "code_warning", "error": "task_failed"}
    e = table(spark, sf, "events")
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    family = F.concat(F.lit("f"), (F.col("event_id") % 997).cast("string"))
    return e.select(F.col("event_id").alias("id"), "ts", F.element_at(named, F.col("event_type")).alias("type"), F.col("user_id").alias("task_id"), family.alias("family"))


@query("select event_id as id, ts from events where event_type in ('view', 'click', 'error') order by ts desc, event_id desc limit 20")
def hist_runs(spark, sf):
    return history.runs(_log(spark, sf)).select("id", "ts")


@query("select event_id as id from events where event_type in ('view', 'click', 'error') and event_id % 997 = 5")
def hist_runs_of_family(spark, sf):
    return history.runs(_log(spark, sf), family="f5", limit=None).select("id")


@query(
    """
select 'f' || (event_id % 997) as family, event_id as id, event_type = 'error' as failed from events where event_type in ('view', 'click', 'error')
qualify row_number() over (partition by event_id % 997 order by ts desc, event_id desc) = 1
"""
)
def hist_status_latest(spark, sf):
    return history.status(_log(spark, sf))["latest"].select("family", "id", (F.col("type") == "task_failed").alias("failed"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def hist_latest(spark, sf):
    return history.latest(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query(
    """
with w as (select * from events where event_type = 'signup' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select user_id as task_id, ts from w where not exists (select 1 from events c where c.ts > w.ts and (
  c.event_type in ('view', 'click', 'purchase') and c.user_id = w.user_id or c.event_type = 'purchase' and c.event_id % 997 = w.event_id % 997))
"""
)
def hist_pending(spark, sf):
    return history.warnings(_log(spark, sf)).select("task_id", "ts")


@query("select event_id as id from events where event_type = 'error' order by ts desc, event_id desc limit 10")
def hist_failures(spark, sf):
    return history.status(_log(spark, sf))["failures"].select("id")


# ------------------------------------------------------------------------------------ operators used in steps


@query(
    """
with l as (select *, row_number() over (order by c_custkey) as k from customer), r as (select s_suppkey, s_name, s_acctbal, row_number() over (order by s_suppkey) as k from supplier)
select c_custkey, c_name, cast(s_suppkey as varchar) as s_suppkey, s_name from l left join r using (k)
"""
)
def index_join(spark, sf):
    got = relational.index_join(table(spark, sf, "customer"), table(spark, sf, "supplier"), ["c_custkey"], ["s_suppkey"])
    return got.select("c_custkey", "c_name", F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name")


@query("select a.n_name as n_name_l, b.n_name as n_name_r from (select n_name, row_number() over (order by n_name) k from nation) a join (select n_name, row_number() over (order by n_nationkey) k from nation) b using (k)")
def index_join_suffixes(spark, sf):
    n = table(spark, sf, "nation").select("n_name", "n_nationkey")
    return relational.index_join(n, n, ["n_name"], ["n_nationkey"], "_l", "_r").select("n_name_l", "n_name_r")


@query(
    """
with l as (select * from events where event_type = 'signup'), r as (select user_id, ts, max(value) rv from events where event_type = 'error' group by 1, 2)
select l.event_id, l.user_id, l.ts, r.rv from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts
"""
)
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return relational.asof_join(left, e.where("event_type = 'error'"), "ts", ["user_id"], "value", "rv")


@query("select event_id, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as d from events")
def lag_diff(spark, sf):
    return relational.lag_diff(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], "d").select("event_id", F.round("d", 6).alias("d"))


@query("select event_id, round(case when lag(value) over w <> 0 then value / lag(value) over w - 1 end, 6) as p from events window w as (partition by user_id order by ts, event_id)")
def pct_change(spark, sf):
    return relational.pct_change(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], "p").select("event_id", F.round("p", 6).alias("p"))


@query("select event_id, case when value > 50 then 1 else -1 end as side from events")
def conditional_column(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("value") > 50, 1).otherwise(-1).alias("side"))


@query("select event_type, round(avg(value), 6) as mean from events group by 1")
def group_mean(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("select event_type, count(*) as n from events group by 1")
def group_size(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select event_type, round(avg(value), 6) as mean from events where value > 10 group by 1")
def filter_group_mean(spark, sf):
    return table(spark, sf, "events").where("value > 10").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("select l_returnflag, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) as error from lineitem group by 1")
def group_mean_error(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return df.groupBy("l_returnflag").agg(F.round(F.avg(absolute_error("l_extendedprice", "guess")), 4).alias("error"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def group_quantile(spark, sf):
    got = relational.group_quantiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return got.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 9) as share from orders")
def share_of_total(spark, sf):
    got = relational.share_of_total(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"], "share")
    return got.select("o_orderkey", F.round("share", 9).alias("share"))


@query("select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 6) as z from customer")
def zscore(spark, sf):
    got = relational.zscore(table(spark, sf, "customer"), ["c_acctbal"])
    return got.select("c_custkey", F.round("c_acctbal_z", 6).alias("z"))


@query("select c_custkey, round((select avg(c_acctbal) from customer), 6) as mean from customer")
def global_mean(spark, sf):
    got = relational.with_global_mean(table(spark, sf, "customer"), "c_acctbal", "mean")
    return got.select("c_custkey", F.round("mean", 6).alias("mean"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def topk_desc(spark, sf):
    return relational.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, ["o_orderkey"])


@query("select n_nationkey, cast(nullif(n_regionkey, 4) as varchar) as r from nation order by r desc nulls last, n_nationkey limit 22")
def topk_nulls_last(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(4)).alias("r"))
    return relational.top(df, "r", 22, ["n_nationkey"]).withColumn("r", F.col("r").cast("string"))


@query("select n_nationkey, n_regionkey as r from nation where n_regionkey <> 4")
def drop_null(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(4)).alias("r")).na.drop("any")


@query("select r_regionkey, r_name, 1 as one, r_regionkey * 2 + 1 as odd from region")
def add_column(spark, sf):
    return table(spark, sf, "region").withColumn("one", F.lit(1)).withColumn("odd", F.col("r_regionkey") * 2 + 1)


@query("select l_quantity * 2 as x_q, l_discount * 2 as x_d from lineitem")
def frame_times_scalar(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return relational.times(df, 2, prefix="x_")


@query("select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem")
def select_features(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("select cast(round(sum(s), 0) as bigint) as total from (select sum(l_quantity) as s from lineitem group by l_orderkey)")
def sum_of_sums(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s")).agg(F.round(F.sum("s"), 0).cast("long").alias("total"))


@query("select c_custkey, c_acctbal * (cast(('0x' || substr(md5('7|c_acctbal|' || c_custkey), 1, 13)) as bigint)::double / 4503599627370496 * 2.75 + 0.25) as c_acctbal from customer")
def noise(spark, sf):
    return relational.apply_noise(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 7)


# --------------------------------------------------------------------------------------- reasons and statuses


class First(Step):
    def run(self):
        self.save(self.read("region"))


@sw.requires(First)
class Second(Step):
    def run(self):
        self.save(self.inputLoad().where("r_regionkey > 0"))


@sw.requires(Second)
class Third(Step):
    def run(self):
        self.save(self.inputLoad().limit(1))


@query(
    """
select * from (values ('first run', 'First', 'output missing'), ('first run', 'Second', 'output missing'), ('first run', 'Third', 'output missing'),
('after a reset', 'Second', 'output missing'), ('after a reset', 'Third', 'upstream rerun'), ('after a pin', 'First', 'code change (1 -> 2)'),
('after a pin', 'Second', 'upstream rerun'), ('after a pin', 'Third', 'upstream rerun')) t(step, family, reason)
"""
)
def run_reasons(spark, sf):
    flow, rows = sw.Workflow(Third, {"sf": sf}, scratch(spark)), []
    kept = First.code_version
    try:
        with quiet():
            First.code_version = 1
            for name, before in (("first run", lambda: None), ("nothing changed", lambda: None), ("after a reset", lambda: flow.reset(Second)), ("after a pin", lambda: setattr(First, "code_version", 2))):
                before()
                r = flow.run()
                rows += [(name, t.task_family, r.reasons[t.task_id]) for t in r.ran]
    finally:
        First.code_version = kept
    return spark.createDataFrame(rows, "step string, family string, reason string")


@query("select * from (values ('First', false), ('Second', false), ('Third', false)) t(family, complete)")
def status_matrix(spark, sf):
    flow = ran(Third, spark, sf)
    flow.reset_upstream(only=First)
    return spark.createDataFrame([(t.task_family, flow.complete(t)) for t in graph.traverse(flow.get_task())], "family string, complete boolean")


@query("select * from (values ('First', 1), ('Second', 1), ('Third', 1)) t(family, records)")
def code_records(spark, sf):
    flow = ran(Third, spark, sf)
    return records.records_frame(spark, flow.path).groupBy("family").agg(F.count("*").cast("int").alias("records"))


@query("select * from (values ('complete', 75), ('fingerprint', 75), ('requires', 43)) t(question, executions)")
def traversal_counts(spark, sf):
    """Questions asked by a run with nothing to do, on the shape of 32 leaves, one shared step and 41 branches."""

    class Leaf(sw.TaskCache):
        k = sw.IntParameter(default=0)

        def run(self):
            self.save(self.k)

    @sw.requires_each(Leaf, k=list(range(32)))
    class Shared(sw.TaskCache):
        def run(self):
            self.save(sum(self.inputLoad().values()))

    @sw.requires(Shared)
    class Branch(sw.TaskCache):
        b = sw.IntParameter(default=0)

        def run(self):
            self.save(self.inputLoad() + self.b)

    @sw.requires_each(Branch, b=list(range(41)))
    class Report(sw.TaskCache):
        def run(self):
            self.save(json.dumps(sorted(self.inputLoad().values())))

    flow = sw.Workflow(Report, {}, scratch(spark))
    with quiet():
        flow.run()
        flow.run()
    return spark.createDataFrame(sorted(sw.traversal_stats().items()), "question string, executions int")


# -------------------------------------------------------------------------- other outputs, parameters and questions


class Size(enum.Enum):
    SMALL = 1
    LARGE = 2


class Pickled(sw.TaskPickle):
    sf = sw.Parameter(significant=False)

    def run(self):
        rows = table(files.active(), self.sf, "region").orderBy("r_regionkey").collect()
        self.save({"names": [r.r_name for r in rows], "n": len(rows)})


@query("select r_name as name, (select cast(count(*) as integer) from region) as n from region")
def pickle_output(spark, sf):
    got = ran(Pickled, spark, sf).outputLoad()
    return spark.createDataFrame([(x, got["n"]) for x in got["names"]], "name string, n int")


class Report(sw.TaskMarkdown):
    sf = sw.Parameter(significant=False)

    def run(self):
        n = table(files.active(), self.sf, "nation").count()
        self.save(f"# Nations\n\nThere are {n}.\n")


@query("select '# Nations' || chr(10) || chr(10) || 'There are ' || count(*) || '.' || chr(10) as text from nation")
def markdown_output(spark, sf):
    return spark.createDataFrame([(ran(Report, spark, sf).outputLoad(),)], "text string")


class Described(Step):
    def run(self):
        df = self.read("nation")
        self.save(df)
        self.saveMeta({"rows": df.count(), "columns": df.columns})


@query("select (select cast(count(*) as integer) from nation) as n_rows, name from (select unnest(['n_nationkey', 'n_name', 'n_regionkey']) as name)")
def meta_round_trip(spark, sf):
    meta = ran(Described, spark, sf).outputLoadMeta()
    return spark.createDataFrame([(meta["rows"], c) for c in meta["columns"] if c != "n_comment"], "n_rows int, name string")


class ByRegion(Step):
    region = sw.IntParameter(default=0)

    def run(self):
        self.save(self.read("nation").where(F.col("n_regionkey") == self.region))


class Dynamic(Step):
    """Finds out while it runs what else it needs."""

    def run(self):
        tasks = [ByRegion(path=self.path, sf=self.sf, region=k) for k in (0, 2, 4)]
        yield tasks
        self.save(reduce(DataFrame.union, [t.outputLoad() for t in tasks]).groupBy("n_regionkey").agg(F.count("*").alias("n")))


@query("select n_regionkey, count(*) as n from nation where n_regionkey in (0, 2, 4) group by 1")
def dynamic_requires(spark, sf):
    return ran(Dynamic, spark, sf).outputLoad()


class Broken(Step):
    def run(self):
        raise ValueError("no")


@sw.requires(Broken)
class AfterBroken(Step):
    def run(self):
        self.save(self.inputLoad())


@sw.requires(First, AfterBroken)
class Both(Step):
    def run(self):
        self.save(self.inputLoad()[0])


@query("select * from (values ('First', 'ran', 'output missing'), ('Broken', 'failed', 'run error'), ('AfterBroken', 'failed', 'dependency failed'), ('Both', 'failed', 'dependency failed')) t(family, state, reason)")
def failure_states(spark, sf):
    flow = sw.Workflow(Both, {"sf": sf}, scratch(spark))
    with quiet():
        return flow.run(abort=False).to_df(spark).select("family", "state", "reason")


@query("select * from (values ('none', 'First', true), ('none', 'Second', true), ('none', 'Third', true), ('down', 'First', true), ('down', 'Second', false), ('down', 'Third', false)) t(reset, family, complete)")
def reset_downstream_states(spark, sf):
    flow, rows = ran(Third, spark, sf), []
    for name in ("none", "down"):
        if name == "down":
            with quiet():
                flow.reset_downstream(Second)
        rows += [(name, t.task_family, flow.complete(t)) for t in graph.traverse(flow.get_task())]
    return spark.createDataFrame(rows, "reset string, family string, complete boolean")


class Parameters(sw.TaskCache):
    i = sw.IntParameter(default=3)
    x = sw.FloatParameter(default=0.5)
    b = sw.BoolParameter(default=True)
    d = sw.DateParameter(default=datetime.date(2024, 2, 29))
    l = sw.ListParameter(default=[1, 2])  # noqa: E741
    m = sw.DictParameter(default={"b": 1, "a": 2})
    c = sw.ChoiceParameter(choices=["u", "v"], default="v")
    e = sw.EnumParameter(enum=Size, default=Size.LARGE)


@query("""select * from (values ('i', '3'), ('x', '0.5'), ('b', 'True'), ('d', '2024-02-29'), ('l', '[1, 2]'), ('m', '{"a": 2, "b": 1}'), ('c', 'v'), ('e', 'LARGE')) t(name, text)""")
def parameter_texts(spark, sf):
    return spark.createDataFrame(sorted(Parameters().to_str_params().items()), "name string, text string")


@query("select * from (values (1, 'Third'), (2, 'Second'), (3, 'First')) t(place, family)")
def dag_dfs_paths(spark, sf):
    flow = sw.Workflow(Third, {"sf": sf}, scratch(spark))
    return spark.createDataFrame([(k + 1, t.task_family) for k, t in enumerate(graph.dfs_paths(flow.get_task(), First))], "place int, family string")


@query("select r_regionkey, r_name from region where r_regionkey > 0")
def stub_import(spark, sf):
    """What a flow made, read by stubs that were exported from it."""
    flow = ran(Third, spark, sf)
    folder = tempfile.mkdtemp()
    try:
        sw.FlowExport(flows=flow, save=True, path_export=f"{folder}/stubs_{uuid.uuid4().hex}.py").generate()
        stubs = sw.FlowImport(next(os.path.join(folder, n) for n in os.listdir(folder)), flow.path)
        return stubs.Second(path=flow.path, sf=sf).outputLoad().select("r_regionkey", "r_name")
    finally:
        shutil.rmtree(folder)
