import datetime
import enum
import json
import pickle
import re
import sys
import types
import warnings

import pytest

import stepwell as sw
from stepwell.plans import codeid, graph, lint, params, records, runner
from stepwell.plans.task import Register
from stepwell.sources import files, history, targets


@pytest.fixture(autouse=True)
def clean(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sw.settings, "dirpath", str(tmp_path / "data"))
    monkeypatch.setattr(sw.settings, "events_dir", str(tmp_path / "log"))
    records.clear_cache()
    Register.instances.clear()
    targets._LOADED.clear()
    targets.CacheTarget.store.clear()
    history._waiting.clear()
    yield


def values(df, column="a"):
    return sorted(r[column] for r in df.collect())


class Numbers(sw.TaskParquet):
    n = sw.IntParameter(default=10)

    def run(self):
        self.save(files.active().range(self.n).toDF("a"))


@sw.requires(Numbers)
class Two(sw.TaskCache):
    persists = ["df2", "df4"]

    def run(self):
        df = self.inputLoad()
        self.save({"df2": df.selectExpr("a * 2 as a"), "df4": df.selectExpr("a * 4 as a")})


@sw.requires(Two)
class Last(sw.TaskParquet):
    factor = sw.IntParameter(default=1)

    def run(self):
        a, b = self.inputLoad()
        self.save(a.unionByName(b).selectExpr(f"a * {self.factor} as a"))


class TestParameters:
    def test_ids(self):
        assert type("Task1", (sw.TaskParquet,), {})().task_id == "Task1__99914b932b"
        t = Last(n=3, factor=2)
        assert t.task_id.startswith("Last_2_3_") and Last(factor=2, n=3) is t
        assert [n for n, _ in t.get_params()] == ["n", "factor"]

    def test_errors(self):
        class Need(sw.TaskParquet):
            x = sw.Parameter()

        with pytest.raises(params.MissingParameterError):
            Need()
        with pytest.raises(params.UnknownParameterError):
            Need(1, y=2)
        with pytest.raises(params.DuplicateParameterError):
            Need(1, x=2)
        with pytest.raises(ValueError):
            type("Bad", (sw.TaskParquet,), {"path": sw.Parameter()})

    def test_types(self):
        class Kind(enum.Enum):
            A = 1

        class T(sw.TaskParquet):
            b = sw.BoolParameter()
            d = sw.DateParameter(default=datetime.datetime(2020, 1, 2, 3))
            m = sw.DictParameter(default={"b": 1, "a": 2})
            c = sw.ChoiceParameter(default="x", choices=["x", "y"])
            e = sw.EnumParameter(default=Kind.A, enum=Kind)
            hidden = sw.Parameter(default=5, significant=False)

        t = T(b="TRUE")
        assert t.b is True and t.d == datetime.date(2020, 1, 2)
        assert t.to_str_params(True) == {"b": "True", "d": "2020-01-02", "m": '{"a": 2, "b": 1}', "c": "x", "e": "A"}
        assert T(hidden=6).task_id == T().task_id and T(hidden=6) is not T()
        for wrong in ({"c": "z"}, {"b": "maybe"}):
            with pytest.raises(ValueError):
                T(**wrong)
        with pytest.raises(ValueError):
            Numbers(n="x")


class TestRun:
    def test_chain(self, spark):
        flow = sw.Workflow(Last, {"n": 3, "factor": 10, "other": 1})
        assert not flow.complete()
        r = flow.run()
        assert r and [t.task_family for t in r.ran] == ["Numbers", "Two", "Last"]
        assert set(r.reasons.values()) == {"output missing"}
        assert values(flow.outputLoad()) == [0, 0, 20, 40, 40, 80]
        assert flow.complete() and not flow.run().ran
        assert {x.state for x in r.to_df(spark).collect()} == {"ran"}
        assert "3 ran successfully" in str(r)

    def test_outputs_by_key(self):
        flow = sw.Workflow(Two, {"n": 2})
        flow.run()
        assert values(flow.outputLoad(keys="df4")) == [0, 4]
        assert [values(x) for x in flow.outputLoad(keys=["df4", "df2"])] == [[0, 4], [0, 2]]
        assert flow.outputLoad(as_dict=True).keys() == {"df2", "df4"}
        with pytest.raises(IndexError):
            flow.outputLoad(keys="df")
        with pytest.raises(ValueError):
            Two(n=2).save({"df2": 1})
        assert set(flow.outputPath()) == {"df2", "df4"}

    def test_not_run(self):
        with pytest.raises(RuntimeError):
            sw.Workflow(Numbers).outputLoad()
        with pytest.raises(RuntimeError):
            sw.Workflow().get_task()

    def test_forced_and_reset(self):
        flow = sw.Workflow(Last)
        flow.run()
        assert len(flow.run(forced=Two).ran) == 2 and len(flow.run(forced_all=True).ran) == 1
        assert len(flow.run(forced_all_upstream=True).ran) == 3
        flow.reset_upstream(only=Numbers)
        assert not flow.complete()
        r = flow.run()
        assert {t.task_family: r.reasons[t.task_id] for t in r.ran} == {"Numbers": "output missing", "Two": "upstream rerun", "Last": "upstream rerun"}
        flow.reset_downstream(Two)
        assert [t.task_family for t in flow.run().ran] == ["Two", "Last"]

    def test_failures(self):
        class Bad(sw.TaskParquet):
            def run(self):
                raise KeyError("broken")

        @sw.requires({"bad": Bad, "good": Numbers})
        class Top(sw.TaskParquet):
            def run(self):
                raise AssertionError

        with pytest.raises(RuntimeError, match="broken") as e:
            sw.Workflow(Top).run()
        assert isinstance(e.value.__cause__, KeyError)
        r = sw.Workflow(Top).run(abort=False)
        assert not r and r.failure_of(Bad).reason == "run error" and r.failure_of("Top").reason == "dependency failed"
        assert [t.task_family for t in r.complete] == ["Numbers"]

    def test_external_missing_and_cycle(self):
        class Ext(sw.TaskParquet):
            external = True

        assert sw.run(Ext(), abort=False).failure_of(Ext).reason == "external missing output"

        class A(sw.TaskParquet):
            def requires(self):
                return B()

        class B(sw.TaskParquet):
            def requires(self):
                return A()

        with pytest.raises(ValueError, match="needs itself"), sw.traversal():
            graph.post_order(A())

    def test_dynamic_requirements(self):
        class Dyn(sw.TaskJson):
            def run(self):
                got = yield [Numbers(n=1), Numbers(n=2)]
                one = yield Numbers(n=4)
                self.save([values(x.load()) for x in got] + [values(one.load())])

        assert sw.runLoad(Dyn) == [[0], [0, 1], [0, 1, 2, 3]]

    def test_no_jobs_on_a_no_op(self, spark):
        flow = sw.Workflow(Last)
        flow.run()
        records.clear_cache()
        targets._LOADED.clear()
        tracker, group = spark.sparkContext.statusTracker(), "no-op"
        spark.sparkContext.setJobGroup(group, "")
        assert not flow.run().ran
        flow.outputLoad()
        assert not tracker.getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class TestFormats:
    @pytest.mark.parametrize("base", [sw.TaskParquet, sw.TaskCSV, sw.TaskCSVGZ, sw.TaskJsonLines, sw.TaskOrc, sw.TaskCacheFrame])
    def test_frames(self, spark, base):
        schema = "i int, s string, d double, t date, b boolean"
        rows = [(1, 'a,"b"\nc', 0.1, datetime.date(2020, 1, 1), True), (None, "", None, None, False), (3, None, -1e300, None, None)]

        class T(base):
            def run(self):
                self.save(spark.createDataFrame(rows, schema))

        df = sw.runLoad(T)
        assert df.schema == spark.createDataFrame(rows, schema).schema
        assert sorted(map(str, df.collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))

    def test_objects(self):
        class J(sw.TaskJson):
            def run(self):
                self.save({"test": 1})
                self.saveMetaJson({"columns": 42})
                self.saveMeta({"x": (1, 2)})

        class P(sw.TaskPickle):
            def run(self):
                self.save({(1, 2): {3}})

        class M(sw.TaskMarkdown):
            def run(self):
                self.save("# Title\n\n- a\n- **b**\n\n|x|y|\n|-|-|\n|1|<2>|\n\ntext `c`")

        assert sw.runLoad(J) == {"test": 1} and sw.runLoad(P) == {(1, 2): {3}}
        assert json.loads(files.read_bytes(J().output().path)) == {"data": {"test": 1}}
        assert J().outputLoadMetaJson() == {"columns": 42} and J().outputLoadAllMeta() == {"J": {"x": (1, 2)}}
        assert sw.runLoad(M).startswith("# Title")
        page = files.read_bytes(M().output().page).decode()
        assert "<h1>Title</h1>" in page and "<td>&lt;2&gt;</td>" in page and "<b>b</b>" in page
        for t in (J(), P(), M()):
            t.reset()
            assert not t.complete()
        with pytest.raises(RuntimeError):
            J().outputLoadMeta()

    def test_paths(self):
        class G(Numbers):
            task_group, code_version, keep_versions = "g", 2, True

        assert G().output().path == f"{sw.settings.dirpath}/group=g/G/v2/{G().task_id}-data.parquet"
        assert sw.Workflow(Numbers, path="p", env="dev").outputPath().startswith("p/env=dev/Numbers/")

        class Plain(Numbers):
            save_attrib, target_dir = False, "there"

        assert Plain().output().path.endswith("/there/Plain-data.parquet")

    def test_pandas_frames(self):
        import pandas as pd

        class T(sw.TaskPqPandas):
            def run(self):
                self.save(pd.DataFrame({"a": [1, 2]}))

        assert values(sw.runLoad(T)) == [1, 2]


    def test_models(self, spark):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression

        class Fit(sw.TaskModel):
            def run(self):
                df = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(9)], "x double, y double"))
                self.save(LinearRegression(featuresCol="f", labelCol="y").fit(df))

        model = sw.runLoad(Fit)
        assert abs(model.coefficients[0] - 2) < 1e-6 and abs(model.intercept - 1) < 1e-6
        targets._LOADED.clear()
        assert abs(sw.Workflow(Fit).outputLoad().intercept - 1) < 1e-6

    def test_models_of_other_libraries(self, monkeypatch):
        """With stand-ins that keep the libraries' calls: files are made in memory and come back through the store."""
        torch = types.ModuleType("torch")
        torch.save = lambda obj, f, **options: pickle.dump((obj, options), f)
        torch.load = lambda f, **options: (pickle.load(f), options)
        monkeypatch.setitem(sys.modules, "torch", torch)

        class Net(sw.PyTorch):
            def run(self):
                self.save({"w": [1, 2]}, protocol=3)

        sw.run(Net())
        assert Net().output().path.endswith(".pt")
        assert Net().output().load(weights_only=True) == (({"w": [1, 2]}, {"protocol": 3}), {"weights_only": True})

        class Store:
            def __init__(self, f, mode):
                self.f = f

            def __enter__(self):
                return self

            def __exit__(self, *_):
                pass

        class Model:
            def __init__(self, weights):
                self.weights = weights

            def save(self, store):
                store.f.write(json.dumps(self.weights).encode())

        h5py, keras = types.ModuleType("h5py"), types.ModuleType("tensorflow.keras.models")
        h5py.File, keras.load_model = Store, lambda store: Model(json.loads(store.f.read()))
        for name, module in (("h5py", h5py), ("tensorflow", types.ModuleType("tensorflow")), ("tensorflow.keras", types.ModuleType("k")), ("tensorflow.keras.models", keras)):
            monkeypatch.setitem(sys.modules, name, module)

        class Deep(sw.TaskH5Keras):
            def run(self):
                self.save(Model([3, 4]))

        assert sw.runLoad(Deep).weights == [3, 4]
        assert Deep().output().path.endswith(".hdf5") and not [n for n in files.names(Deep().output().path.rsplit("/", 1)[0]) if n.startswith("_tmp")]

    def test_orphans(self):
        sw.Workflow(Numbers).run()
        sw.Workflow(Numbers, {"n": 2}).run()
        assert [p.rsplit("/", 1)[1] for p in sw.orphans(known=[Numbers()])] == [Numbers(n=2).output().path.rsplit("/", 1)[1]]


class Leaf(sw.TaskParquet):
    state = sw.Parameter()
    size = sw.IntParameter(default=2)
    source = sw.Parameter(default="none")

    def run(self):
        self.save(files.active().range(self.size).toDF("v"))


class TestFanOut:
    def test_each(self):
        @sw.requires_each(Leaf, state=["CA", "NY"])
        class All(sw.TaskParquet):
            def run(self):
                self.save(self.inputLoadConcat())

        assert [n for n, _ in All.get_params()] == ["size", "source"]
        df = sw.runLoad(All, {"size": 3})
        assert sorted((r.v, r.state, r.size) for r in df.collect()) == [(v, s, 3) for v in range(3) for s in ("CA", "NY")]
        assert list(All().requires()) == ["CA", "NY"]

    def test_groups_shared_and_derive(self):
        @sw.requires(Numbers)
        @sw.requires_each({"west": Leaf}, state=["CA", "WA"], derive={"source": lambda v: f"db_{v['state']}"})
        @sw.requires_each({"east": Leaf}, state=lambda t: ["NY"], size=[1, 2])
        class Top(sw.TaskCache):
            def run(self):
                got = self.inputLoad(flatten=False)
                assert list(got) == ["Numbers", "west", "east"] and list(got["east"]) == ["size_1_state_NY", "size_2_state_NY"]
                assert list(self.inputLoad(task="west")) == ["CA", "WA"]
                assert values(self.inputLoad(task="Numbers")) == list(range(10))
                self.save(self.inputLoadConcat(task="west", tagkeys=["source"]))

        assert sorted(Top().requires()) == ["Numbers", "east_size_1_state_NY", "east_size_2_state_NY", "west_CA", "west_WA"]
        assert [n for n, _ in Top.get_params()] == ["n"]
        assert {r.source for r in sw.runLoad(Top).collect()} == {"db_CA", "db_WA"}

    def test_wrong_declarations(self):
        with pytest.raises(ValueError):
            sw.requires_each(Leaf, nothing=[1])
        with pytest.raises(TypeError):
            sw.requires_each(Leaf, state=["a"])(type("X", (sw.TaskParquet,), {"state": sw.Parameter()}))
        with pytest.raises(TypeError):
            sw.requires(Leaf)(type("X", (sw.TaskParquet,), {"requires": lambda self: None}))
        bad = sw.requires_each(Leaf, state=[])(type("X", (sw.TaskParquet,), {}))
        with pytest.raises(ValueError, match="empty"):
            bad().requires()
        twice = sw.requires_each(Leaf, state=["a"])(sw.requires_each(Leaf, state=["a"])(type("Y", (sw.TaskParquet,), {})))
        with pytest.raises(ValueError, match="two dependencies"):
            twice().requires()

    def test_own_requires_with_grid(self):
        class Own(sw.TaskParquet):
            size = sw.IntParameter(default=1)

            def requires(self):
                return self.requires_grid(Leaf, state=["x", "y"])

            def run(self):
                self.save(self.inputLoadConcat(tag=True, tagkeys=["state"]))

        assert sorted((r.v, r.state) for r in sw.runLoad(Own).collect()) == [(0, "x"), (0, "y")]

    def test_input_shapes(self):
        @sw.requires(Two)
        class One(sw.TaskJson):
            def run(self):
                assert [values(x) for x in self.inputLoad()] == [[0, 2], [0, 4]]
                assert self.inputLoad(as_dict=True).keys() == {"df2", "df4"}
                self.save(values(self.inputLoad(keys="df4")))

        @sw.requires(Two, Numbers)
        class Listed(sw.TaskJson):
            def run(self):
                (a, b), c = self.inputLoad()
                self.save([values(a), values(b), values(c), values(self.inputLoad(task=1)), values(self.inputLoad(task=Numbers))])

        @sw.requires({"x": Two, "y": Numbers})
        class Named(sw.TaskJson):
            def run(self):
                got = self.inputLoad()
                self.save([[values(d) for d in got["x"]], values(got["y"]), list(self.inputLoad(keys=["y"]))])

        assert sw.runLoad(One, {"n": 2}) == [0, 4]
        assert sw.runLoad(Listed, {"n": 2}) == [[0, 2], [0, 4], [0, 1], [0, 1], [0, 1]]
        assert sw.runLoad(Named, {"n": 2}) == [[[0, 2], [0, 4]], [0, 1], ["y"]]

    def test_inherits_and_clone(self):
        @sw.inherits(Leaf)
        class Child(sw.TaskParquet):
            def requires(self):
                return self.clone_parent()

        assert Child(state="q", size=7).requires() == Leaf(state="q", size=7)
        assert Leaf(state="q").clone(state="r").state == "r"

    def test_aggregator(self):
        @sw.requires_each(Leaf, state=["a", "b"])
        class Group(sw.TaskAggregator):
            pass

        flow = sw.Workflow(Group)
        assert flow.run() and flow.complete() and len(flow.outputLoad()) == 2
        flow.reset()
        assert not flow.complete()


    def test_fused_branches(self, spark):
        made = []

        class Fused(sw.TaskFused):
            tag = "state"
            states = sw.ListParameter(default=["CA", "N/Y", "none"])

            def values(self):
                return self.states

            def build(self, values):
                made.append(values)
                return spark.createDataFrame([(s, v) for s in ("CA", "N/Y", "TX") for v in range(2)], "state string, v int")

        flow = sw.Workflow(Fused)
        flow.run()
        assert sorted(map(tuple, flow.outputLoad().select("state", "v").collect())) == [("CA", 0), ("CA", 1), ("N/Y", 0), ("N/Y", 1)]
        assert not flow.run().ran
        Fused().reset_branches(["N/Y"])
        assert not flow.complete() and flow.run().ran and flow.outputLoad().count() == 4
        assert made == [["CA", "N/Y", "none"], ["N/Y"]]


    @pytest.mark.parametrize("tags", [[True, False, None], [1e-07, 2.5, 1e20, -0.5, None], [datetime.date(2024, 2, 29), None], [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 3, 4, 5, 600)], ["a/b=c", "ö %:x", "__x", None], [1, -7, None]])
    def test_fused_types(self, spark, tags):
        kind = {bool: "boolean", float: "double", int: "long", str: "string", datetime.date: "date", datetime.datetime: "timestamp"}[type(tags[0])]

        class Typed(sw.TaskFused):
            def values(self):
                return tags

            def build(self, values):
                return spark.createDataFrame([(t, v) for t in tags for v in range(2)], f"tag {kind}, v int")

        flow = sw.Workflow(Typed)
        flow.run()
        want = sorted(str((t, v)) for t in tags for v in range(2))
        assert sorted(str((r.tag, r.v)) for r in flow.outputLoad().collect()) == want and not flow.run().ran
        Typed().reset_branches(tags[:1])
        assert not flow.complete() and flow.run().ran
        assert sorted(str((r.tag, r.v)) for r in flow.outputLoad().collect()) == want

    def test_fused_refuses_what_it_would_lose(self, spark):
        from stepwell.sources.targets import FusedTarget

        with pytest.raises(ValueError, match="empty text"):
            FusedTarget("x", "tag", ["a", ""])
        target = FusedTarget(f"{sw.settings.dirpath}/odd", "tag", ["1", "x"])
        with pytest.raises(ValueError, match="no value of type"):
            target.write(spark.createDataFrame([(1, 2)], "tag int, v int"))
        assert not target.exists()


class TestParallel:
    def test_waves(self, spark):
        import threading

        threads, order = set(), []

        class Leaf(sw.TaskParquet):
            k = sw.IntParameter(default=0)

            def run(self):
                threads.add(threading.current_thread().name)
                order.append(self.k)
                if self.k == 5:
                    raise ValueError("five")
                self.save(spark.range(self.k))

        @sw.requires_each(Leaf, k=list(range(5)))
        class Good(sw.TaskParquet):
            def run(self):
                assert sorted(order)[:5] == [0, 1, 2, 3, 4]
                self.save(self.inputLoadConcat())

        @sw.requires(Good)
        class Top(sw.TaskParquet):
            def run(self):
                self.save(self.inputLoad())

        r = sw.Workflow(Top).run()
        assert [getattr(t, "k", t.task_family) for t in r.ran] == [0, 1, 2, 3, 4, "Good", "Top"] and any("stepwell-step" in t for t in threads)
        assert r.did_run(sw.TaskParquet) and len(r.ran_of(Leaf)) == 5 and r.failure_of(Leaf) is None and len(r.ran_of("Leaf")) == 5
        assert "* 0 failed\n" in r.summary() and r.summary().endswith("because there were no failed tasks or missing dependencies")

        @sw.requires_each(Leaf, k=[5, 6, 7])
        class Bad(sw.TaskParquet):
            def run(self):
                self.save(spark.range(1))

        r = sw.Workflow(Bad).run(abort=False)
        assert [t.k for t in r.ran] == [6, 7] and [f.reason for f in r.failed] == ["run error", "dependency failed"]
        threads.clear()
        assert not sw.Workflow(Bad).run(abort=False, workers=1) and threads == {threading.current_thread().name}


class TestConcat:
    def test_equal_tags_are_silent(self, spark):
        from stepwell.operators.concat import concat_iter

        a = spark.createDataFrame([("x", 1), ("x", 2)], "t string, v int")
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            assert concat_iter([("a", {"t": "x"}, a)]).count() == 2
        with pytest.warns(UserWarning, match="replaces"):
            concat_iter([("a", {"t": "y"}, a)])

    def test_drift_collision_and_function(self, spark):
        a, b = spark.range(2).toDF("x"), spark.range(1).toDF("y")
        got = sw.concat_iter([("i", {"k": 1}, a), ("j", {"k": 2}, b)])
        assert sorted(map(str, ((r.x, r.y, r.k) for r in got.collect()))) == sorted(map(str, [(0, None, 1), (1, None, 1), (None, 0, 2)]))
        with pytest.warns(UserWarning, match="replaces"):
            assert values(sw.concat_iter([("i", {"x": 9}, a)]), "x") == [9, 9]
        assert sw.concat_iter([("i", {"k": 1}, a)], keys=[]).columns == ["x"]
        assert values(sw.concat_iter([("i", {"k": 5}, a)], concat_fn=lambda i, p, df: df.selectExpr(f"x + {p['k']} as x")), "x") == [5, 6]
        assert sw.concat_iter([("i", {"l": [1, 2], "m": {"q": 1}}, a)]).first().l == [1, 2]
        assert sw.concat_iter([]).count() == 0
        parts = sw.concat_iter([("i", {"k": 1}, {"p": a, "q": b}), ("j", {"k": 2}, {"p": a, "q": b})])
        assert parts["p"].count() == 4 and parts["q"].count() == 2

    def test_filter_on_a_tag_prunes_branches(self, spark):
        got = sw.concat_iter([(k, {"k": k}, spark.range(5)) for k in range(3)]).where("k = 1")
        assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()

    def test_generators(self, spark):
        from stepwell.operators import grid

        assert sw.params_generator_single({"a": [1, 2]}, {"b": 0}) == {0: {"b": 0, "a": 1}, 1: {"b": 0, "a": 2}}
        assert list(sw.params_generator_multiple({"b": ["x", "y"], "a": [1, 2]})) == ["a_1_b_x", "a_1_b_y", "a_2_b_x", "a_2_b_y"]
        assert sw.params_generator_dictlist({"a": [1, 2], "b": [3, 4]}, {"a": 9, "c": 0})[1] == {"a": 2, "c": 0, "b": 3}
        assert sw.params_generator_multiple({"a": [1]}) == {"a_1": {"a": 1}}
        df = spark.createDataFrame([(1, "x"), (None, "y")], "a int, b string")
        assert sw.params_generator_df(df, {"c": 1}) == {0: {"c": 1, "a": 1, "b": "x"}}
        assert [r.key for r in grid.grid_frame(spark, {"b": ["x", "y"], "a": [1, 2]}).orderBy("key").collect()] == ["a_1_b_x", "a_1_b_y", "a_2_b_x", "a_2_b_y"]
        want = sw.params_generator_dictlist({"a": [1, 2], "b": [3, 4, 5]})
        assert {r.key: {"a": r.a, "b": r.b} for r in grid.grid_index_frame(spark, {"a": [1, 2], "b": [3, 4, 5]}).collect()} == want


class TestMulti:
    def test_flows(self):
        flow = sw.WorkflowMulti(Leaf, {"state": ["US", "UK"]})
        r = flow.run()
        assert r and len(r.ran) == 2 and list(flow.workflow_objs) == [0, 1]
        assert sorted((x.v, x.state) for x in flow.outputLoadConcat().collect()) == [(v, s) for v in (0, 1) for s in ("UK", "US")]
        assert values(flow.outputLoad(flow=1), "v") == [0, 1] and set(flow.outputPath()) == {0, 1}
        flow.reset(flow=0)
        assert [t.state for t in flow.run().ran] == ["US"]
        assert list(sw.WorkflowMulti(Leaf, {"state": ["a"], "size": [1, 2]}).workflow_objs) == ["size_1_state_a", "size_2_state_a"]
        assert list(sw.WorkflowMulti(Leaf, {"x": {"state": "a"}}).workflow_objs) == ["x"]
        with pytest.raises(Exception, match="at least one"):
            sw.WorkflowMulti(Leaf, {})
        assert sw.runIterConcat(Leaf, [{"state": "p"}, {"state": "q"}]).count() == 4

    def test_attached_flows(self):
        other = sw.Workflow(Numbers, {"n": 3})
        other.run()

        class Uses(sw.TaskJson):
            def run(self):
                self.save(values(self.flows["other"].outputLoad()))

        flow = sw.Workflow(Uses)
        flow.attach_flow(other, "other")
        flow.run()
        assert flow.outputLoad() == [0, 1, 2]


class TestGraph:
    def test_questions(self, spark):
        flow = sw.Workflow(Last)
        assert [t.task_family for t in flow.dependents(Numbers)] == ["Last", "Two", "Numbers"]
        assert [[t.task_family for t in p] for p in flow.dependents(Numbers, paths=True)] == [["Last", "Two", "Numbers"]]
        assert flow.dependents("Nothing") == [] and len(flow.dependencies()) == 2
        assert graph.edges_frame(spark, Last()).count() == 2
        text = flow.preview(print_it=False)
        assert text.count("PENDING") == 3 and text.split("\n")[1].startswith("   +--[Two")

    def test_diamond_paths(self):
        @sw.requires(Numbers)
        class L(sw.TaskParquet):
            pass

        @sw.requires(Numbers)
        class R(sw.TaskParquet):
            pass

        @sw.requires(L, R)
        class T(sw.TaskParquet):
            pass

        assert len(graph.find_paths(T(), Numbers)) == 2 and len(graph.find_deps(T(), Numbers)) == 4
        assert len(graph.find_deps(T(), R)) == 2 and sw.taskflow_upstream(T(), only_complete=True) == []

    def test_one_question_for_each_task(self):
        class Base(sw.TaskCache):
            k = sw.IntParameter(default=0)

            def run(self):
                self.save(1)

        @sw.requires_each(Base, k=list(range(32)))
        class Shared(sw.TaskCache):
            def run(self):
                self.save(2)

        @sw.requires(Shared)
        class Branch(sw.TaskCache):
            b = sw.IntParameter(default=0)

            def run(self):
                self.save(3)

        @sw.requires_each(Branch, b=list(range(41)))
        class Report(sw.TaskCache):
            def run(self):
                self.save(4)

        assert len(sw.Workflow(Report).run().ran) == 75
        want = {"complete": 75, "requires": 43, "fingerprint": 75}
        assert sw.traversal_stats()["requires"] == 43 and sw.traversal_stats()["fingerprint"] == 75
        assert not sw.Workflow(Report).run().ran and sw.traversal_stats() == want
        assert sw.Workflow(Report).complete() and sw.traversal_stats()["complete"] <= 75


SOURCE = '''
import stepwell as sw
from stepwell.sources import files
from helper import factor, unused

class Calc(sw.TaskParquet):
    {pin}
    def run(self):
        {doc}
        self.save(files.active().range(3).selectExpr(f"id * {{factor()}} as a"))

@sw.requires(Calc)
class After(sw.TaskParquet):
    def run(self):
        self.save(self.inputLoad().selectExpr("a + {plus} as a"))
'''
HELPER = "def factor():\n    return {k}\n\ndef unused():\n    return {u}\n"


class TestCode:
    def load(self, tmp_path, monkeypatch, k=1, u=1, plus=0, doc='"""x"""', pin="# no pin"):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src/helper.py").write_text(HELPER.format(k=k, u=u))
        (tmp_path / "src/steps_mod.py").write_text(SOURCE.format(plus=plus, doc=doc, pin=pin))
        monkeypatch.syspath_prepend(str(tmp_path / "src"))
        import importlib
        import linecache

        for m in ("helper", "steps_mod"):
            sys.modules.pop(m, None)
        linecache.clearcache()
        importlib.invalidate_caches()
        monkeypatch.setattr(sys, "dont_write_bytecode", True)
        codeid._parsed.cache_clear()
        Register.instances.clear()
        targets._LOADED.clear()
        return importlib.import_module("steps_mod")

    def test_edits(self, tmp_path, monkeypatch):
        reasons = lambda r: {t.task_family: r.reasons[t.task_id] for t in r.ran}
        m = self.load(tmp_path, monkeypatch)
        assert len(sw.Workflow(m.After).run().ran) == 2
        m = self.load(tmp_path, monkeypatch, doc='"""another text"""  # and a comment', u=5)
        assert not sw.Workflow(m.After).run().ran
        m = self.load(tmp_path, monkeypatch, plus=1)
        assert reasons(sw.Workflow(m.After).run()) == {"After": "code change (auto: steps_mod.py::After)"}
        m = self.load(tmp_path, monkeypatch, plus=1, k=2)
        assert reasons(sw.Workflow(m.After).run()) == {"Calc": "code change (auto: helper.py::factor)", "After": "upstream rerun"}
        assert values(sw.Workflow(m.After).outputLoad()) == [1, 3, 5]
        m = self.load(tmp_path, monkeypatch, plus=1, k=2, pin="code_version = 1")
        assert not sw.Workflow(m.After).run().ran
        with pytest.warns(sw.StalenessWarning):
            m = self.load(tmp_path, monkeypatch, plus=1, k=3, pin="code_version = 1")
            assert not sw.Workflow(m.After).run().ran
        m = self.load(tmp_path, monkeypatch, plus=1, k=3, pin="code_version = 2")
        assert reasons(sw.Workflow(m.After).run())["Calc"] == "code change (1 -> 2)"
        m = self.load(tmp_path, monkeypatch, plus=2, k=3, pin="code_version = 3")
        flow = sw.Workflow(m.After)
        assert not flow.complete() and len(flow.accept_code(m.After())["accepted"]) == 2 and flow.complete()

    def test_file_fallback_and_keys(self, tmp_path, monkeypatch):
        m = self.load(tmp_path, monkeypatch)
        keys = codeid.hashes(m.Calc)
        assert set(keys) == {"helper.py::factor", "steps_mod.py::Calc"}
        root = str(tmp_path / "src")
        assert all(codeid.current_hash(k, root) == v for k, v in keys.items())
        assert codeid.current_hash("helper.py::gone", root) is None and codeid.current_hash("gone.py", root) is None
        assert set(codeid.module_hashes(f"{root}/steps_mod.py")) == {"helper.py", "steps_mod.py"}
        (tmp_path / "src/broken.py").write_text("def (:")
        assert len(codeid.file_hash(f"{root}/broken.py")) == 32

        class Inner(sw.TaskParquet):
            pass

        assert all("::" not in k for k in codeid.hashes(Inner)) and codeid.hashes(Inner)

    def test_expensive_steps_stay(self, tmp_path, monkeypatch):
        m = self.load(tmp_path, monkeypatch)
        sw.Workflow(m.Calc).run()
        t = m.Calc()
        records.put(t, records.get(t) | {"duration_s": 9999})
        m = self.load(tmp_path, monkeypatch, k=7)
        with warnings.catch_warnings(record=True) as got:
            warnings.simplefilter("always")
            assert not sw.Workflow(m.Calc).run().ran
        assert any(issubclass(w.category, sw.StalenessWarning) for w in got)

    def test_missing_record_counts_as_fresh(self, tmp_path, monkeypatch):
        m = self.load(tmp_path, monkeypatch)
        sw.Workflow(m.Calc).run()
        files.delete(f"{sw.settings.dirpath}/{records.FILE}")
        records.clear_cache()
        assert not sw.Workflow(m.Calc).run().ran and records.get(m.Calc())


class TestHistory:
    def test_log_and_status(self, spark):
        class Bad(sw.TaskParquet):
            def run(self):
                self.logger.info("hello %s", "you", rows=5)
                raise ValueError("no")

        sw.Workflow(Last).run()
        sw.run(Bad(), abort=False)
        kinds = {r.type for r in history.events().collect()}
        assert {"run_started", "task_ran", "run_finished", "task_failed", "task_log"} <= kinds
        assert history.runs().count() == 4 and history.runs(family="Bad").first().type == "task_failed" and history.runs(family="Two").first().reason == "output missing"
        got = history.status()
        assert got["latest"].count() == 4 and got["failures"].first().error == "no" and got["pending"].count() == 0
        assert got["latest"].where("family = 'Bad'").first().type == "task_failed"
        shown = history.print_status()
        assert "FAILED" in shown and re.search(r"Two  \S+  output missing  \d+\.\d\ds", shown)
        assert history.events(type="run_started").first().roots and history.events(type="task_log").first().extra == {"rows": "5"}
        history.append("code_warning", task_id=Last().task_id, family="Last", message="old")
        history.append("code_warning", task_id="x", family="X", message="m")
        assert {r.task_id for r in history.warnings().collect()} == {Last().task_id, "x"}
        history.append("code_accepted", task_id="x", family="X")
        assert {r.task_id for r in history.warnings().collect()} == {Last().task_id}
        history.append("code_accepted", task_id="another", family="Last")
        assert history.warnings().count() == 0

    def test_parameters_are_kept(self, spark):
        class Called(sw.TaskParquet):
            x = sw.IntParameter(default=1)

            def run(self):
                self.save(spark.range(self.x))

        sw.Workflow(Called, {"x": 3}).run()
        assert history.runs(family="Called").first().params == {"x": "3"}

    def test_never_stops_a_run(self, tmp_path, monkeypatch):
        (tmp_path / "blocked").write_text("")
        monkeypatch.setattr(sw.settings, "events_dir", str(tmp_path / "blocked"))
        assert sw.Workflow(Numbers).run()
        monkeypatch.setattr(sw.settings, "events", False)
        history._waiting.clear()
        assert sw.Workflow(Numbers).run() and not history._waiting

    def test_stream(self, spark):
        from stepwell import streaming

        sw.Workflow(Numbers).run()
        q = streaming.activity(streaming.events_stream(spark)).writeStream.outputMode("complete").format("memory").queryName("activity").start()
        q.processAllAvailable()
        q.stop()
        assert {r.type for r in spark.table("activity").collect()} >= {"task_ran"}


class TestLint:
    def test_verdicts(self):
        @sw.requires(Numbers)
        class Ignores(sw.TaskJson):
            def run(self):
                self.save(1)

        @sw.requires({"x": Numbers, "y": Two})
        class Half(sw.TaskJson):
            def run(self):
                self.save(self.inputLoad(task="x").count())

        @sw.requires(Numbers)
        class Meant(sw.TaskJson):
            # stepwell: input-unused
            def run(self):
                self.save(1)

        one = lambda c: {f.dependency: f.verdict for f in lint.check_class(c)}
        assert one(Ignores) == {"Numbers": "unused"} and one(Half) == {"x": "clean", "y": "unused"}
        assert one(Meant) == {} and one(Last) == {"Two": "clean"} and one(Numbers) == {}
        with pytest.raises(ValueError, match="Ignores"):
            sw.Workflow(Ignores).check_inputs(raise_on_unused=True, print_it=False)
        with pytest.warns(sw.UnusedInputWarning):
            assert "UNUSED INPUTS" in sw.Workflow(Ignores).preview(print_it=False)


class TestStubsAndFunctions:
    def test_export_and_import(self, tmp_path):
        sw.Workflow(Last, {"n": 2}).run()
        path = str(tmp_path / "stubs.py")
        text = sw.FlowExport(flows=sw.Workflow(Last, {"n": 2}), save=True, path_export=path).generate()
        assert text.rindex("class Last") > text.rindex("class Numbers") and "def run" not in text
        got = sw.FlowImport(path)
        assert values(got.flow(got.Last).outputLoad()) == [0, 0, 2, 4]
        assert not got.flow(got.Last).run().ran

    def test_functional(self):
        from stepwell.plans.functional import Workflow

        flow = Workflow()

        @flow.task(sw.TaskCache)
        def first(self):
            self.save({"hello": self.n})

        flow.params(n=1)(first)

        @flow.task(sw.TaskCache)
        def second(self):
            self.save(self.inputLoad()["hello"] + 1)

        flow.requires(first)(second)
        flow.run(second, params={"n": 4})
        assert flow.outputLoad(second) == 5 and flow.outputLoadAll(second) == {"first": {"hello": 4}, "second": 5}
        r = flow.run(second, multi_params={"a": {"n": 1}, "b": {"n": 2}})
        assert r and flow.outputLoad(second) == {"a": 2, "b": 3}
        flow.resetAll()
        assert "PENDING" in flow.preview(second, {"n": 4})
        with pytest.raises(TypeError):
            flow.task(Numbers)

    def test_git_info_never_raises(self):
        assert len(runner.git_info()) == 2
