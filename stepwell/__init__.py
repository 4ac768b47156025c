"""stepwell: reproducible, incremental data pipelines on Spark DataFrames."""

from stepwell.operators.concat import concat_iter
from stepwell.operators.grid import (
    generate_exps_for_multi_param,
    params_generator_df,
    params_generator_dictlist,
    params_generator_multiple,
    params_generator_single,
)
from stepwell.operators.relational import apply_noise
from stepwell.plans.flow import (
    Workflow,
    WorkflowMulti,
    invalidate_downstream,
    invalidate_upstream,
    orphans,
    preview,
    runIt,
    runIterConcat,
    runLoad,
    show,
    taskflow_downstream,
    taskflow_upstream,
)
from stepwell.plans.graph import find_deps, find_paths, traverse
from stepwell.plans.ident import flatten
from stepwell.plans.lint import InputFinding, UnusedInputWarning
from stepwell.plans.log import disable_logging, enable_logging
from stepwell.plans.params import (
    BoolParameter,
    ChoiceParameter,
    DateParameter,
    DictParameter,
    EnumParameter,
    FloatParameter,
    IntParameter,
    ListParameter,
    Parameter,
)
from stepwell.plans.records import StalenessWarning
from stepwell.plans.runner import MultiRunResult, RunResult, TaskFailure, build, run
from stepwell.plans.stubs import FlowExport, FlowImport, dotdict
from stepwell.plans.task import (
    Task,
    TaskAggregator,
    TaskCache,
    TaskCacheFrame,
    TaskCSV,
    TaskCSVGZ,
    TaskData,
    TaskExcel,
    TaskExcelSingle,
    TaskFused,
    TaskJson,
    TaskJsonLines,
    TaskKeras,
    TaskMarkdown,
    TaskModel,
    TaskOrc,
    TaskParquet,
    TaskPickle,
    TaskTorch,
    inherits,
    requires,
    requires_each,
    traversal,
    traversal_stats,
)
from stepwell.settings import enable_cloud_storage, enable_gcs, set_dir, settings
from stepwell.sources import history
from stepwell.sources.targets import to_parquet

# Names that users of pandas-based task libraries know; frames are Spark frames.
TaskCachePandas = TaskCacheFrame
TaskPqPandas = TaskParquet
TaskCSVPandas = TaskCSV
TaskCSVGZPandas = TaskCSVGZ
TaskExcelPandas = TaskExcel
TaskExcelPandasSingle = TaskExcelSingle
TaskH5Pandas = TaskDatatable = TaskParquet  # frames that were kept as HDF5 or by H2O are kept as parquet
TaskH5Keras = TaskKeras
PyTorch = TaskTorch

__all__ = [n for n in dir() if not n.startswith("_")]
