"""Sheets, file trees, run logs and sinks, on any store that Spark reads."""

from __future__ import annotations

import hashlib
import io
import json
import re
import time
import uuid
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from quernstone.functions import scalar as S


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, allow_empty: bool = False) -> DataFrame:
    """A CSV table with a header; an empty one raises unless allowed."""
    df = spark.read.csv(path, header=True, schema=schema)
    df = df.select(*columns) if columns else df
    if not allow_empty and df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def label_sheet(df: DataFrame, unit: str, time: str, left: str, right: str, texts: Sequence[str] = ()) -> DataFrame:
    """A clean sheet: unit_id, date, codes and names of both sides, joined text; first row of a (unit, date).

    Missing text columns are empty. Rows without a unit go.
    """
    lc, ln = S.parse_code_name(F.col(left))
    rc, rn = S.parse_code_name(F.col(right))
    parts = [F.col(t) if t in df.columns else F.lit("") for t in texts] or [F.lit("")]
    text = parts[0]
    for p in parts[1:]:
        text = S.join_text(text, p)
    out = df.select(S.lenient_double(F.col(unit)).try_cast("long").alias("unit_id"), S.lenient_date(F.col(time)).alias("date"), lc.alias("left_code"), ln.alias("left_name"), rc.alias("right_code"), rn.alias("right_name"), S.clean_text(text).alias("report_text")).dropna(subset=["unit_id"])
    from quernstone.operators.relational import keep_first

    return keep_first(out, ["unit_id", "date"], [F.col(c).asc_nulls_last() for c in ("left_code", "right_code", "left_name", "right_name", "report_text")])


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def tree(files: DataFrame, root: str, extension: str = ".dcm") -> DataFrame:
    """(date, unit, series, n_items, bytes) of ``root/date/unit/series/file`` trees: dates of eight digits or
    with dashes, whole-number units, no hidden folders, one extension in any case."""
    parts = F.split(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), "/")
    named = files.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("date", "unit", "series", "file"))], "length")
    good = F.col("date").rlike(r"^\d{4}-?\d{2}-?\d{2}$") & F.col("unit").rlike(r"^\d+$") & ~F.col("series").startswith(".") & F.lower("file").endswith(extension)
    return named.where(good).groupBy("date", F.col("unit").cast("long").alias("unit"), "series").agg(F.count(F.lit(1)).alias("n_items"), F.sum("length").alias("bytes"))


def census(files: DataFrame, root: str) -> DataFrame:
    """Folders at depth one to three and files below, in one pass."""
    tail = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.split(tail, "/")
    depth = lambda n: F.count_distinct(F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")))
    return files.agg(depth(1).alias("depth1"), depth(2).alias("depth2"), depth(3).alias("depth3"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def folder_dates(files: DataFrame, root: str) -> DataFrame:
    """(unit, dates): the dates under which each unit is stored, sorted; a unit has few."""
    return tree(files, root).groupBy("unit").agg(F.array_sort(F.collect_set("date")).alias("dates"))


def data_root(spark: SparkSession, base: str, levels: int = 5) -> str:
    """The folder below ``base`` whose children are date folders.

    Down a chain of single folders for up to ``levels``, else the first child of ``base``, or of its children,
    by name that has some; ``base`` itself where there are none. Only listings, on any store Spark reads.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def children(path: str) -> list[str]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("."))

    def holds_dates(path: str) -> bool:
        return any(re.fullmatch(r"\d{4}-?\d{2}-?\d{2}", c.rsplit("/", 1)[-1]) for c in children(path))

    at = base
    for _ in range(levels + 1):
        if holds_dates(at):
            return at
        below = children(at)
        if len(below) != 1:
            break
        at = below[0]
    near = children(base)
    return next((c for c in [*near, *(g for c in near for g in children(c))] if holds_dates(c)), base)


#: Metrics of an epoch that a run report carries.
METRICS = ("macro_f1", "val_loss", "accuracy", "macro_recall", "macro_specificity", "weighted_f1")
RUN_LOG = "epoch long, batch_size long, hparams struct<label_task:string>, train struct<loss:double,acc:double>, val struct<loss:double,acc:double>, val_metrics struct<macro_f1:double,val_loss:double,auroc:double,accuracy:double,macro_recall:double,macro_specificity:double,weighted_f1:double>, _corrupt string"


def run_logs(spark: SparkSession, path: str, pattern: str = "metrics.jsonl") -> DataFrame:
    """Lines of JSON run logs with their run, the folder of the file: epoch, the METRICS, batch size and task.

    Blank lines are skipped; broken ones stay, marked in _corrupt, and make their run's status. A missing
    val_loss is the loss of val, and ``metric`` is the first of macro F1 and accuracy that a writer gives.
    """
    reader = spark.read.schema(RUN_LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    lines = reader.json(path).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    cells = {m: F.col(f"val_metrics.{m}") for m in METRICS} | {"val_loss": F.coalesce("val_metrics.val_loss", "val.loss"), "metric": F.coalesce("val_metrics.macro_f1", "val.acc"), "label_task": F.col("hparams.label_task")}
    return lines.withColumns(cells).drop("hparams")


def run_folders(files: DataFrame, root: str, report: str = "metrics.jsonl") -> DataFrame:
    """(run, model, task, pct, has_log, checkpoints, last_checkpoint) of every folder right below ``root``.

    ``files`` is an ``inventory``; a folder without files is not seen.
    """
    tail = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    rows = files.where(F.contains(tail, F.lit("/"))).select(F.substring_index(tail, "/", 1).alias("run"), F.regexp_replace(tail, "^[^/]+/", "").alias("rest"))
    found = rows.groupBy("run").agg(F.max(F.col("rest") == report).alias("has_log"), F.max(F.startswith("rest", F.lit("checkpoints/"))).alias("checkpoints"), F.max(F.col("rest") == "checkpoints/last.pt").alias("last_checkpoint"))
    model, task, pct = parse_model_run(F.col("run"))
    return found.select("run", model.alias("model"), task.alias("task"), pct.alias("pct"), "has_log", "checkpoints", "last_checkpoint")


def report_folders(files: DataFrame, report: str) -> DataFrame:
    """(folder, path): every folder at any depth that holds a report file."""
    return files.where(F.substring_index("path", "/", -1) == report).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), "path").distinct()


def report_documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """JSON documents, one a file, parsed by ``schema``: path, status and the fields.

    status is ok, empty or parse_error, and the fields of the latter are null; one bad file spoils no other.
    """
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.input_file_name().alias("path"), "value")
    broken = F.try_parse_json("value").isNull()
    status = F.when(F.trim("value") == "", "empty").when(broken, "parse_error").otherwise("ok")
    parsed = texts.select("path", status.alias("status"), F.from_json("value", schema).alias("r"))
    return parsed.select("path", "status", "r.*")


def parse_model_run(name: Column) -> tuple[Column, Column, Column]:
    """Model, task and percentage of ``<model>__<task>_<n>pct``, of ``<model>_<n>pct`` without a task; a name of
    neither form is the model, with percentage -1."""
    pattern = r"^(.*?)_(\d+)pct(?:_.*)?$"
    fits, prefix = name.rlike(pattern), F.regexp_extract(name, pattern, 1)
    two = F.contains(prefix, F.lit("__"))
    model = F.when(fits, F.when(two, F.substring_index(prefix, "__", 1)).otherwise(prefix)).otherwise(name)
    task = F.when(fits & two, F.substring(prefix, F.length(F.substring_index(prefix, "__", 1)) + 3, F.length(prefix)))
    return model, task, F.when(fits, F.regexp_extract(name, pattern, 2).try_cast("int")).otherwise(-1)


def parse_run(name: Column) -> tuple[Column, Column, Column, Column]:
    """Backbone, task, percentage and seed of ``<backbone>_<task>_<n>pct[_seed<n>]``."""
    pattern = r"^([^_]+)_(.+?)_(\d+)pct(?:_seed(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return part(1), part(2), part(3).try_cast("int"), part(4).try_cast("int")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="errorifexists")


def flatten(df: DataFrame, key: str, nested: str) -> DataFrame:
    """A row for each element of a nested array of structs."""
    return df.select(key, F.inline(nested))


def write_json_report(df: DataFrame, path: str) -> None:
    """A small report as one pretty-printed UTF-8 JSON document: a list of its rows."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    _put(df.sparkSession, path, (json.dumps(rows, ensure_ascii=False, indent=2) + "\n").encode())


def write_nested(df: DataFrame, key: str, columns: Sequence[str], path: str, name: str = "items") -> None:
    """JSON lines with one record a unit: the key, and its rows as an array sorted by ``columns``. A unit's rows are few."""
    nested = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    nested.write.json(path, mode="errorifexists")


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any store, whole or not at all: written beside, then renamed; an existing one is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    out = fs.create(beside)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not fs.rename(beside, target):
        fs.delete(beside, False)
        raise FileExistsError(path)


def _claim(fs, path, data: bytes) -> bool:
    """Create a small file that is not there yet; False if another writer was first."""
    try:
        out = fs.create(path, False)
    except Exception as e:  # noqa: BLE001  each store has an exception of its own for a file that exists
        if fs.exists(path):
            return False
        raise e
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return True


def _told(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def cached(df: DataFrame, root: str, **parameters) -> DataFrame:
    """A table kept under a hash of its parameters: written once, read afterwards.

    Every writer writes a folder ``run=<own>`` below ``<hash>``; the marker ``_TABLE``, which is created only where it is not yet
    there, names the one that counts, and readers follow it. No folder is renamed, so the store needs no rename. A writer
    that comes second deletes what it wrote and reads the first one's. Its parameters stand in ``<hash>.json`` beside it.
    Every parameter that shapes the table belongs in ``parameters``.
    """
    spec = ":".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    name = hashlib.md5(spec.encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}"
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    marker = at(f"{path}/_TABLE")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        own = f"run={uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{path}/{own}")
        if not _claim(fs, marker, own.encode()):
            fs.delete(at(f"{path}/{own}"), True)
        else:
            _put(spark, f"{path}.json", (json.dumps({k: str(v) for k, v in sorted(parameters.items())}, ensure_ascii=False, indent=2) + "\n").encode())
    # a marker that was just created may still be empty
    for _ in range(100):
        if told := _told(fs, marker):
            return spark.read.schema(df.schema).parquet(f"{path}/{told}")
        time.sleep(0.1)
    raise FileNotFoundError(f"{path}/_TABLE names no table: its writer was lost; delete it")


def warm(train: DataFrame, val: DataFrame, keys: Sequence[str], root: str, **parameters) -> DataFrame:
    """The cached table of the distinct union of train and val by key."""
    from quernstone.operators.relational import distinct_union

    rest = [F.col(c) for c in train.columns if c not in keys]
    return cached(distinct_union([train, val], keys, rest), root, **parameters)


def recompress(spark: SparkSession, source: str, target: str, codec: str = "zstd") -> DataFrame:
    """A Parquet table rewritten with another codec; an existing target is an error."""
    spark.read.parquet(source).write.option("compression", codec).mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def markdown(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> str:
    """A Markdown table of a small report; with ``limit`` a last line says how many rows are not shown."""
    frame = df.select(*columns)
    rows = (frame if limit is None else frame.limit(limit + 1)).collect()
    more = limit is not None and len(rows) > limit
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in (rows[:limit] if more else rows))]
    return "\n".join([*lines, f"_{df.count() - limit} more rows_"] if more else lines)


EMBEDDINGS = "unit_id long, side string, label_code long, emb array<float>"


def read_npz(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Embedding rows (EMBEDDINGS) of .npz files with the arrays emb, exam_id, side and label_code.

    Arrays are cast; emb must have two dimensions, and ``width`` columns if given. A file is one task's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def load(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    emb = np.asarray(z["emb"], np.float32)
                    if emb.ndim != 2 or (width is not None and emb.shape[1] != width):
                        raise ValueError(f"{name}: emb has the shape {emb.shape}")
                    yield pd.DataFrame({"unit_id": np.asarray(z["exam_id"]).astype(np.int64), "side": np.asarray(z["side"]).astype(str), "label_code": np.asarray(z["label_code"]).astype(np.int64), "emb": list(emb)})

    return files.mapInPandas(load, EMBEDDINGS)


def write_npz(df: DataFrame, path: str, rows: int = 65_536, **meta) -> int:
    """Embedding rows as compressed .npz files of at most ``rows`` rows, with the meta data as JSON in each; returns how many.

    Parquet is the format for large sets; these files are for readers of NumPy. Tasks write them where they belong,
    through Arrow's file systems, each beside its name first; a task that is run again writes the same names. An
    existing file of another run is an error.
    """
    text, run = json.dumps(meta, ensure_ascii=False, sort_keys=True), uuid.uuid4().hex

    def put(batches):
        store, root = pa_fs.FileSystem.from_uri(path) if ":/" in path else (pa_fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        part, n = TaskContext.get().partitionId(), 0

        def write(b: pd.DataFrame) -> str:
            name = f"{root}/part-{part:05d}-{n:05d}.npz"
            out = io.BytesIO()
            np.savez_compressed(out, emb=np.stack(b["emb"].to_numpy()).astype(np.float32), exam_id=b["unit_id"].to_numpy(np.int64), side=b["side"].to_numpy(str), label_code=b["label_code"].to_numpy(np.int64), meta=np.array(text), run=np.array(run))
            if store.get_file_info(name).type == pa_fs.FileType.File:
                with store.open_input_file(name) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
                    if "run" not in z or str(z["run"]) != run:
                        raise FileExistsError(name)
            beside = f"{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(beside) as f:
                f.write(out.getvalue())
            store.move(beside, name)
            return name

        held: list[pd.DataFrame] = []
        for b in batches:
            for at in range(0, len(b), rows):
                held.append(b.iloc[at : at + rows])
                while sum(map(len, held)) >= rows:
                    whole = pd.concat(held)
                    yield pd.DataFrame({"name": [write(whole.iloc[:rows])]})
                    held, n = [whole.iloc[rows:]] if len(whole) > rows else [], n + 1
        if held:
            yield pd.DataFrame({"name": [write(pd.concat(held))]})

    return df.select("unit_id", "side", "label_code", "emb").mapInPandas(put, "name string").count()


def read_xlsx(spark: SparkSession, path: str, columns: dict[str, str], optional: Sequence[str] = (), sheet: int = 1) -> DataFrame:
    """A sheet of .xlsx files as text columns; ``columns`` maps names in its first row to those wanted.

    Missing optional columns are empty texts, other missing ones raise. A workbook is one task's and read
    with the standard library: shared and inline strings, numbers as written, blanks as nulls.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    schema = ", ".join(f"`{c}` string" for c in columns.values())

    def load(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                head, *rows = sheet_rows(bytes(content), sheet) or [{}]
                place = {v: k for k, v in head.items()}
                if lost := [c for c in columns if c not in place and c not in optional]:
                    raise ValueError(f"{name} lacks the columns {lost}")
                yield pd.DataFrame({new: [r.get(place[old]) if old in place else "" for r in rows] for old, new in columns.items()}, dtype="object")

    return files.mapInPandas(load, schema)


def sheet_rows(content: bytes, sheet: int = 1) -> list[dict[str, str]]:
    """Rows of a workbook's sheet as {column letters: text}; rows without cells are left out."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        out = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{space}row"):
            cells = {}
            for c in row.iter(f"{space}c"):
                value = c.findtext(f"{space}v")
                if c.get("t") == "s" and value is not None:
                    value = strings[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{space}t"))
                if value is not None:
                    cells[re.match("[A-Z]+", c.get("r", "A"))[0]] = value
            if cells:
                out.append(cells)
    return out
