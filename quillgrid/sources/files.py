"""Sources by path, dataset names and registry, and sinks."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.datasets import sample_rows
from ..operators.packs import row_numbers
from ..operators.rows import renamed

FORMATS = {"jsonl": "json", "txt": "text"}


def read_path(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or folder by its ending: jsonl, json (one array), csv, txt, parquet, orc, arrow (a stream
    or a file of record batches). Empty CSV cells stay '' instead of null."""
    kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    kind = FORMATS.get(kind, kind)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        df = reader.csv(path, header=True, multiLine=True, escape='"')
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    if kind == "json":
        return reader.json(path, multiLine=not path.endswith("jsonl"))
    if kind in ("text", "parquet", "orc"):
        return getattr(reader, kind)(path)
    if kind == "arrow":
        return read_arrow(spark, path)
    raise ValueError(f"no reader for {path}")


def _arrow_reader(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, each read by one task; all have the first one's schema."""
    from pyspark.sql.pandas.types import from_arrow_schema

    found = spark.read.format("binaryFile").load(path).select("content")
    first = found.limit(1).collect()
    if not first:
        raise ValueError(f"no Arrow files in {path}")

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                reader = _arrow_reader(data)
                yield from (reader.get_batch(k) for k in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

    return found.mapInArrow(run, from_arrow_schema(_arrow_reader(bytes(first[0]["content"])).schema))


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """(value variant) of JSON lines that may hold any value; lines that aren't JSON are null."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("value"))


def path_kind(spark: SparkSession, path: str) -> str | None:
    """'file', 'folder' or None, by the file system that the path names; None also for what is no path."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    except Py4JJavaError:
        return None
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return "file" if fs.getFileStatus(at).isFile() else "folder"


def image_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the lines of a list file, or of the jpg and png files of a folder; contents aren't read."""
    if path_kind(spark, path) == "file":
        return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(path)
    return files.select("path")


def read_splits(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """Splits of a saved dataset, one under the other; columns that one lacks are null."""
    out = None
    for s in splits:
        df = spark.read.parquet(f"{folder}/{s}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


@dataclass
class DatasetName:
    """[hub::]id_or_path[:subset/subset][#n]; an existing path wins over splitting."""

    path: str
    hub: str | None = None
    subsets: list[str] = field(default_factory=list)
    sample: int | None = None

    @classmethod
    def parse(cls, text: str, exists=os.path.exists) -> DatasetName:
        rest, hub, sample, subsets = text, None, None, []
        if not exists(rest) and "::" in rest:
            head, tail = rest.split("::", 1)
            if head.lower() in ("hf", "ms"):
                hub, rest = head.lower(), tail
        if not exists(rest) and "#" in rest:
            rest, n = rest.rsplit("#", 1)
            sample = int(n)
        if not exists(rest) and ":" in rest:
            rest, s = rest.rsplit(":", 1)
            subsets = [x for x in s.split("/") if x]
        return cls(rest, hub, subsets, sample)


@dataclass
class Entry:
    """A registered dataset: where it lies, how its columns are named, its subsets and its step."""

    path: str
    columns: dict[str, str] = field(default_factory=dict)
    subsets: dict[str, dict] = field(default_factory=dict)
    step: object = None
    load: object = None
    tags: list[str] = field(default_factory=list)


class Registry:
    """Datasets by id; an id matches exactly, else by its last path component."""

    def __init__(self):
        self.entries: dict[str, Entry] = {}

    def register(self, name: str, entry: Entry, exist_ok: bool = False) -> None:
        if name in self.entries and not exist_ok:
            raise ValueError(f"{name} is registered")
        self.entries[name] = entry

    def register_json(self, source: str) -> list[str]:
        """Entries of a JSON file (relative paths from its folder) or of a JSON text."""
        base = ""
        if os.path.isfile(source):
            base = os.path.dirname(os.path.abspath(source))
            with open(source, encoding="utf-8") as f:
                source = f.read()
        names = []
        for item in json.loads(source):
            path = item["path"]
            path = path if os.path.isabs(path) or not base else os.path.join(base, path)
            name = item.get("name", path)
            self.register(name, Entry(path, item.get("columns", {}), item.get("subsets", {}), tags=item.get("tags", [])), exist_ok=True)
            names.append(name)
        return names

    def find(self, name: str) -> Entry | None:
        if name in self.entries:
            return self.entries[name]
        last = name.rstrip("/").rsplit("/", 1)[-1]
        hits = [v for k, v in self.entries.items() if k.rstrip("/").rsplit("/", 1)[-1] == last]
        return hits[0] if hits else None

    def subsets(self, entry: Entry, wanted: list[str]) -> list[str]:
        """'all' gives every subset not marked weak; none gives the only one or 'default'; other names are taken as they are."""
        if wanted == ["all"]:
            return [k for k, v in entry.subsets.items() if not v.get("weak")]
        if wanted:
            return wanted
        if len(entry.subsets) == 1:
            return list(entry.subsets)
        if not entry.subsets or "default" in entry.subsets:
            return ["default"]
        raise ValueError("name a subset: " + ", ".join(entry.subsets))

    def load(self, spark: SparkSession, text: str) -> DataFrame:
        """The rows of a dataset name, renamed, drawn to the number it asks for, and stepped as registered."""
        name = DatasetName.parse(text, lambda p: path_kind(spark, p) is not None)
        entry = self.find(name.path) or Entry(name.path)
        df = entry.load(spark, name) if entry.load else read_path(spark, entry.path)
        if name.subsets and "subset" in df.columns:
            df = df.where(F.col("subset").isin(self.subsets(entry, name.subsets)))
        df = renamed(df, entry.columns)
        if name.sample is not None:
            df = drawn_rows(df, name.sample)
        return df.transform(entry.step) if entry.step else df


def drawn_rows(df: DataFrame, n: int) -> DataFrame:
    """n rows of a table without a key, drawn by the hash of the whole row; more than there are begin again."""
    keyed = df.withColumn("__key", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return sample_rows(keyed, "__key", n).drop("__key", "copy")


def write_split(df: DataFrame, path: str, is_val: str = "is_val", kind: str = "parquet") -> None:
    """Both parts of a split, in the folders train and val; the held-out part as JSON lines if so asked."""
    for name, rows in (("train", df.where(~F.col(is_val))), ("val", df.where(is_val))):
        rows.drop(is_val).write.mode("overwrite").format(kind).save(f"{path}/{name}")


def json_array(df: DataFrame, order: list[str]) -> DataFrame:
    """(part, json) of a table as one JSON array in order: its parts one after another are the array.

    Only a table that is meant to be one file is written so; a part is a range partition.
    """
    rows = row_numbers(df, order)
    total = F.broadcast(rows.agg(F.max("rn").alias("__last")))  # one row
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    line = F.concat(F.when(F.col("rn") == 1, "[").otherwise(""), text, F.when(F.col("rn") == F.col("__last"), "]").otherwise(","))
    return rows.join(total).select(F.col("rn").alias("part"), line.alias("json"))


def write_json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't in the table yet, so that a broken run resumes; the number of rows added.

    The sink is read once, its keys only; what is written is counted as it is written.
    """
    spark = df.sparkSession
    if path_kind(spark, path):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def _safe(col: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.when(col.isNotNull(), F.lit("<<<bytes>>>"))
    if isinstance(kind, T.StringType) and re.search("_token", name, re.I):
        return F.lit(None).cast("string")
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_safe(col[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _safe(x, kind.elementType, name))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        hidden = (lambda k, v: F.when(~F.lower(k).contains("_token"), v)) if isinstance(kind.valueType, T.StringType) else (lambda k, v: _safe(v, kind.valueType, name))
        return F.transform_values(col, hidden)
    return col


def safe_json(df: DataFrame) -> DataFrame:
    """(json) of each row: bytes as '<<<bytes>>>', string values whose name holds '_token' as null, at any depth."""
    out = [_safe(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*out)).alias("json"))


def write_results(df: DataFrame, path: str) -> None:
    """Rows as JSON lines files; each partition writes its own."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
