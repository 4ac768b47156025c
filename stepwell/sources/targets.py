"""Targets: handles on one stored output each, with exists, load, save and invalidate.

A frame is a directory that Spark writes beside its place and that is moved there when it is whole, with its schema in
it, so that opening it starts no job and a text format gives back the types that were saved.
"""

from __future__ import annotations

import html
import io
import json
import pickle
import posixpath
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwell.settings import located, settings
from stepwell.sources import files

SCHEMA, PARTITIONS = "_schema.json", "_partitions.json"
#: Rows that a driver-only format (a spreadsheet) takes at most.
DRIVER_ROWS = 1_000_000


def as_frame(data: Any) -> DataFrame:
    """A Spark frame of what was saved: Spark frames as they are, pandas frames by Arrow."""
    return data if isinstance(data, DataFrame) else files.active().createDataFrame(data)


class Target:
    """An output that exists or not."""

    def exists(self) -> bool:
        raise NotImplementedError

    def invalidate(self) -> bool:
        raise NotImplementedError


class LocalTarget(Target):
    """A target with a path, in any store that Spark reads."""

    def __init__(self, path: Any):
        self.path = str(path)

    def exists(self) -> bool:
        return files.exists(self.path)

    def invalidate(self) -> bool:
        _LOADED.pop(self.path, None)
        return files.delete(self.path)


#: What this process has loaded or saved, by path.
_LOADED: dict[str, Any] = {}


class DataTarget(LocalTarget):
    """load and save of one kind of data; subclasses give ``read`` and ``write``."""

    def read(self, **options: Any) -> Any:
        raise NotImplementedError

    def write(self, data: Any, **options: Any) -> None:
        raise NotImplementedError

    def load(self, cached: bool = False, **options: Any) -> Any:
        """Used from memory if both ``cached`` and settings.cached hold, kept in memory if either does."""
        if cached and settings.cached and self.path in _LOADED:
            return _LOADED[self.path]
        if not self.exists():
            raise RuntimeError(f"target doesn't exist, run the task first: {self.path}")
        data = self.read(**options)
        if cached or settings.cached:
            _LOADED[self.path] = data
        return data

    def save(self, data: Any, **options: Any) -> str:
        self.write(data, **options)
        _LOADED.pop(self.path, None)
        return self.path


class FrameTarget(DataTarget):
    """A frame in one of Spark's file formats."""

    format = "parquet"
    write_options: dict[str, Any] = {"compression": "zstd"}
    read_options: dict[str, Any] = {}

    def exists(self) -> bool:
        return files.exists(posixpath.join(self.path, "_SUCCESS"))

    def read(self, **options: Any) -> DataFrame:
        schema = StructType.fromJson(json.loads(files.read_bytes(posixpath.join(self.path, SCHEMA))))
        return files.active().read.format(self.format).schema(schema).options(**self.read_options, **options).load(located(self.path))

    def write(self, data: Any, partition_by: list[str] | None = None, **options: Any) -> None:
        df = as_frame(data)
        beside = f"{posixpath.dirname(self.path)}/_tmp.{uuid.uuid4().hex}"
        try:
            writer = df.write.format(self.format).mode("overwrite").options(**self.write_options, **options)
            (writer.partitionBy(*partition_by) if partition_by else writer).save(located(beside))
            files.put_bytes(f"{beside}/{SCHEMA}", json.dumps(df.schema.jsonValue()).encode())
            files.rename(beside, self.path)
        except BaseException:
            files.delete(beside)
            raise


class ParquetTarget(FrameTarget):
    pass


class OrcTarget(FrameTarget):
    format = "orc"
    write_options = {"compression": "zlib"}


class CSVTarget(FrameTarget):
    format = "csv"
    #: Null is written as \\N, so that an empty string comes back as such.
    write_options = {"header": True, "nullValue": "\\N", "escape": '"'}
    read_options = {"header": True, "nullValue": "\\N", "escape": '"', "multiLine": True, "enforceSchema": True}


class CSVGZTarget(CSVTarget):
    write_options = CSVTarget.write_options | {"compression": "gzip"}


class JsonLinesTarget(FrameTarget):
    format = "json"
    write_options = {"ignoreNullFields": False}


class CacheTarget(Target):
    """An output kept by this process only: a frame is persisted in the cluster, other objects are held as they are."""

    store: dict[str, Any] = {}

    def __init__(self, path: Any):
        self.path = str(path)

    def exists(self) -> bool:
        return self.path in self.store

    def invalidate(self) -> bool:
        data = self.store.pop(self.path, None)
        if isinstance(data, DataFrame):
            data.unpersist()
        return data is not None

    def load(self, cached: bool = False) -> Any:
        if not self.exists():
            raise RuntimeError(f"target doesn't exist, run the task first: {self.path}")
        return self.store[self.path]

    def save(self, data: Any) -> str:
        self.invalidate()
        if isinstance(data, DataFrame):
            data = data.persist()
            data.count()  # so that "has run" means what it says
        self.store[self.path] = data
        return self.path


class FrameCacheTarget(CacheTarget):
    def save(self, data: Any) -> str:
        return super().save(as_frame(data))


class FusedTarget(FrameTarget):
    """The branches of a fan-out in one frame, a partition for each value of a tag column. A branch is there when its
    partition is, so branches can be added or made anew one by one; an empty branch is an empty partition. Partitions
    have the names that Spark gives them; they are noted beside the schema, so that looking for them starts no job."""

    def __init__(self, path: Any, tag: str, values: list):
        super().__init__(path)
        self.tag, self.values = tag, list(values)
        if any(isinstance(v, str) and not v for v in self.values):
            raise ValueError(f"{tag}: an empty text can't be told from null in the name of a partition")

    def noted(self) -> dict[str, str]:
        """The partition of each value that was ever written, by the value's repr."""
        return json.loads(files.read_bytes(f"{self.path}/{PARTITIONS}")) if files.exists(f"{self.path}/{PARTITIONS}") else {}

    def named(self, df: DataFrame, values: list) -> dict[str, str]:
        """The names that Spark gives to the partitions of values."""
        kind = df.schema[self.tag].dataType
        utils = files.active()._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        texts = files.active().range(1).select(*[F.lit(v).try_cast(kind).cast("string").alias(f"v{k}") for k, v in enumerate(values)]).first() if values else ()
        out = {repr(v): utils.getPartitionPathString(self.tag, t) for v, t in zip(values, texts, strict=True)}
        for v, t in zip(values, texts, strict=True):
            if t is None and v is not None:
                raise ValueError(f"{self.tag}: {v!r} is no value of type {kind.simpleString()}")
        if len(set(out.values())) < len(out):
            raise ValueError(f"{self.tag}: two values have one partition: {sorted(out)}")
        return out

    def missing(self) -> list:
        there = set(files.names(self.path))
        noted = self.noted() if SCHEMA in there and PARTITIONS in there else {}
        return [v for v in self.values if noted.get(repr(v)) not in there]

    def exists(self) -> bool:
        return not self.missing()

    def _of(self, df: DataFrame, values: list) -> Any:
        some = df[self.tag].isin(*[v for v in values if v is not None])
        return some | df[self.tag].isNull() if any(v is None for v in values) else some

    def read(self, **options: Any) -> DataFrame:
        schema = StructType.fromJson(json.loads(files.read_bytes(posixpath.join(self.path, SCHEMA))))
        df = files.active().read.schema(schema).option("basePath", located(self.path)).options(**options).parquet(located(self.path))
        return df.where(self._of(df, self.values))  # prunes partitions of other values

    def write(self, data: Any, **options: Any) -> None:
        """Write the branches that are missing; rows of others are left out."""
        df, todo = as_frame(data), self.missing()
        beside = f"{posixpath.dirname(self.path)}/_tmp.{uuid.uuid4().hex}"
        try:
            names = self.named(df, todo)
            df.where(self._of(df, todo)).write.options(**self.write_options, **options).partitionBy(self.tag).parquet(located(beside))
            made = {n for n in files.names(beside) if not n.startswith(("_", "."))}
            if lost := made - set(names.values()):
                raise RuntimeError(f"{self.path}: no branch claims the partitions {sorted(lost)}")
            for name in names.values():
                if name in made:
                    files.rename(f"{beside}/{name}", f"{self.path}/{name}")
                else:
                    files.write_bytes(f"{self.path}/{name}/_empty", b"")
            files.write_bytes(f"{self.path}/{PARTITIONS}", json.dumps(self.noted() | names).encode())
            files.write_bytes(posixpath.join(self.path, SCHEMA), json.dumps(df.schema.jsonValue()).encode())
        finally:
            files.delete(beside)

    def forget(self, values: list) -> None:
        """Remove some branches."""
        noted = self.noted()
        for v in values:
            if repr(v) in noted:
                files.delete(f"{self.path}/{noted[repr(v)]}")
        _LOADED.pop(self.path, None)


class JsonTarget(DataTarget):
    """Any JSON value, under the key 'data'."""

    def read(self, **options: Any) -> Any:
        return json.loads(files.read_bytes(self.path), **options)["data"]

    def write(self, data: Any, **options: Any) -> None:
        files.write_bytes(self.path, json.dumps({"data": data}, indent=4, **options).encode())


class PickleTarget(DataTarget):
    """Any Python object. Only load files that your own tasks wrote."""

    def read(self, **options: Any) -> Any:
        return pickle.loads(files.read_bytes(self.path), **options)

    def write(self, data: Any, **options: Any) -> None:
        files.write_bytes(self.path, pickle.dumps(data, **options))


class MarkdownTarget(DataTarget):
    """Markdown text, and beside it a page of HTML for the reader."""

    @property
    def page(self) -> str:
        return self.path.removesuffix(".md") + ".html"

    def read(self, **options: Any) -> str:
        return files.read_bytes(self.path).decode()

    def write(self, data: str, title: str = "", **options: Any) -> None:
        files.write_bytes(self.path, data.encode())
        style = "body{max-width:50em;margin:2em auto;font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em}"
        files.write_bytes(self.page, f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{style}</style>{to_html(data)}".encode())

    def invalidate(self) -> bool:
        files.delete(self.page)
        return super().invalidate()


def to_html(text: str) -> str:
    """Headings, lists, tables, code blocks and paragraphs of Markdown, with emphasis, code and links inside."""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        for pattern, made in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<b>\1</b>"), (r"\*([^*]+)\*", r"<i>\1</i>"), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>')):
            s = re.sub(pattern, made, s)
        return s

    out, lines, k = [], text.split("\n"), 0
    while k < len(lines):
        line = lines[k]
        if line.startswith("```"):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append("<pre>" + html.escape("\n".join(lines[k + 1 : end])) + "</pre>")
            k = end
        elif m := re.match(r"(#{1,6}) (.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif re.match(r"[-*] ", line):
            end = next((j for j in range(k, len(lines)) if not re.match(r"[-*] ", lines[j])), len(lines))
            out.append("<ul>" + "".join(f"<li>{inline(x[2:])}</li>" for x in lines[k:end]) + "</ul>")
            k = end - 1
        elif line.startswith("|"):
            end = next((j for j in range(k, len(lines)) if not lines[j].startswith("|")), len(lines))
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines[k:end] if not re.fullmatch(r"[|\s:-]+", x)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
            k = end - 1
        elif line.strip():
            end = next((j for j in range(k, len(lines)) if not lines[j].strip()), len(lines))
            out.append(f"<p>{inline(' '.join(lines[k:end]))}</p>")
            k = end - 1
        k += 1
    return "\n".join(out)


class ExcelTarget(DataTarget):
    """One sheet a file. Runs on the driver, so rows are bounded; needs openpyxl."""

    def read(self, **options: Any) -> DataFrame:
        import pandas as pd

        return as_frame(pd.read_excel(io.BytesIO(files.read_bytes(self.path)), **options))

    def write(self, data: Any, **options: Any) -> None:
        self._write({"data": data}, **options)

    def _write(self, sheets: dict[str, Any], **options: Any) -> None:
        import pandas as pd

        out = io.BytesIO()
        with pd.ExcelWriter(out) as writer:
            for name, data in sheets.items():
                got = as_frame(data).limit(DRIVER_ROWS + 1).toPandas()
                if len(got) > DRIVER_ROWS:
                    raise ValueError(f"a sheet takes at most {DRIVER_ROWS} rows")
                got.to_excel(writer, sheet_name=name, index=False, **options)
        files.write_bytes(self.path, out.getvalue())


class ExcelSheetsTarget(ExcelTarget):
    """All outputs of a task in one file, a sheet each."""

    def load(self, keys: Any = None, cached: bool = False, **options: Any) -> Any:
        if not self.exists():
            raise RuntimeError(f"target doesn't exist, run the task first: {self.path}")
        return self.read(keys, **options)

    def read(self, keys: Any = None, **options: Any) -> Any:
        import pandas as pd

        got = pd.read_excel(io.BytesIO(files.read_bytes(self.path)), sheet_name=keys, **options)
        return {k: as_frame(v) for k, v in got.items()} if isinstance(got, dict) else as_frame(got)

    def write(self, data: dict[str, Any], **options: Any) -> None:
        self._write(data, **options)


class ModelTarget(DataTarget):
    """A fitted pyspark.ml model, through its own writer and reader."""

    def exists(self) -> bool:
        return files.exists(posixpath.join(self.path, "metadata"))

    def read(self, **options: Any) -> Any:
        from pyspark.ml.util import DefaultParamsReader

        spark = files.active()
        meta = DefaultParamsReader.loadMetadata(located(self.path), spark)
        name = meta["class"].replace("org.apache.spark", "pyspark")
        module, _, cls = name.rpartition(".")
        loader = getattr(__import__(module, fromlist=[cls]), cls)
        return loader.load(located(self.path))

    def write(self, data: Any, **options: Any) -> None:
        data.write().overwrite().save(located(self.path))


class TorchTarget(DataTarget):
    """A torch model or any object that torch saves. Runs on the driver; needs torch. Options go to torch.save or load."""

    def read(self, **options: Any) -> Any:
        import torch

        return torch.load(io.BytesIO(files.read_bytes(self.path)), **options)

    def write(self, data: Any, **options: Any) -> None:
        import torch

        out = io.BytesIO()
        torch.save(data, out, **options)
        files.write_bytes(self.path, out.getvalue())


class KerasTarget(DataTarget):
    """A Keras model in HDF5, made in memory. Runs on the driver; needs tensorflow and h5py."""

    def read(self, **options: Any) -> Any:
        import h5py
        from tensorflow.keras.models import load_model

        with h5py.File(io.BytesIO(files.read_bytes(self.path)), "r") as store:
            return load_model(store, **options)

    def write(self, data: Any, **options: Any) -> None:
        import h5py

        out = io.BytesIO()
        with h5py.File(out, "w") as store:
            data.save(store, **options)
        files.write_bytes(self.path, out.getvalue())


def to_parquet(df: Any, path: str, **options: Any) -> str:
    """Write a frame as parquet at a path of one's own choice."""
    return ParquetTarget(path).save(df, **options)
