"""JSON receipts on disk: written, scanned, pruned; JSON-lines logs; bundles of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = r"receipt_cycle_(\d+)_.*\.json$"


def receipt_name(cycle: Column, label: Column) -> Column:
    """File name of a receipt; characters that may not be in one become ``_``."""
    number = F.format_string("%04d", F.coalesce(cycle, F.lit(0)).cast("long"))
    safe = F.regexp_replace(F.coalesce(label, F.concat(F.lit("cycle_"), number)), r"[^a-zA-Z0-9._-]", "_")
    return F.concat(F.lit("receipt_cycle_"), number, F.lit("_"), safe, F.lit(".json"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_receipts(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(cycle, path) of the receipts under a folder by cycle; none if it isn't there."""
    import re

    fs, p = _fs(spark, root)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    names = [s.getPath().toString() for s in fs.listStatus(p) if s.isFile()]
    found = [(int(m[1]), n) for n in names if (m := re.search(RECEIPT, n))]
    return sorted(found)


def read_receipts(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame | None:
    """The receipts with ``file_name`` and ``file_cycle``; None if there are none."""
    paths = [p for _, p in list_receipts(spark, root)]
    if not paths:
        return None
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(paths)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumns({"file_name": name, "file_cycle": F.regexp_extract(name, RECEIPT, 1).cast("int")})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever store the path names."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_receipt(spark: SparkSession, root: str, receipt: dict) -> str:
    import json
    import re

    cycle = receipt.get("cycle_index") or 0
    label = re.sub(r"[^a-zA-Z0-9._-]", "_", str(receipt.get("run_label") or f"cycle_{cycle:04d}"))
    path = f"{root.rstrip('/')}/receipt_cycle_{cycle:04d}_{label}.json"
    write_text(spark, path, json.dumps(receipt, indent=2))
    return path


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Deletes all but the newest ``keep`` receipts; returns what went."""
    gone = [p for _, p in list_receipts(spark, root)][: -keep or None] if keep else [p for _, p in list_receipts(spark, root)]
    for path in gone:
        fs, p = _fs(spark, path)
        fs.delete(p, False)
    return gone


def append_lines(df: DataFrame, path: str) -> None:
    """A JSON-lines log."""
    df.write.mode("append").json(path)


def bundle(summary: DataFrame, **tables: DataFrame) -> DataFrame:
    """One JSON document a stream: its summary and its rows of each table, in the order of their columns."""
    out = summary.select("stream_id", F.struct(*summary.columns).alias("summary"))
    for name, df in tables.items():
        rows = df.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "stream_id"]))).alias(name))
        out = out.join(rows, "stream_id", "left")
    return out.select("stream_id", F.to_json(F.struct("summary", *tables)).alias("document"))


def bundles(spark: SparkSession, root: str, cases: set[str] | None = None, name: str = "workbench.json") -> list[tuple[str, str]]:
    """(case, path) of the bundles under a folder by case: its own is ``default``, a subfolder's has the subfolder's name."""
    fs, top = _fs(spark, root)
    if not fs.exists(top):
        return []
    found = [("default", f"{root.rstrip('/')}/{name}")] + [(s.getPath().getName(), f"{root.rstrip('/')}/{s.getPath().getName()}/{name}") for s in fs.listStatus(top) if s.isDirectory()]
    return sorted((case, path) for case, path in found if (not cases or case in cases) and fs.exists(_fs(spark, path)[1]))


def run_stamp(at: Column) -> Column:
    """A time as part of a folder's name: ISO 8601 in UTC with milliseconds, ``:`` and ``.`` as ``-``."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")


def faults(spark: SparkSession, document: dict, name: str, **constants: str) -> list[str]:
    """The paths of one document that break the format ``name``."""
    import json

    from ..functions.schemas import broken

    return spark.createDataFrame([(json.dumps(document),)], "document string").select(broken(F.col("document"), name, **constants)).first()[0]


def write_checked(spark: SparkSession, path: str, document: dict, name: str, **constants: str) -> dict:
    """Writes a document that keeps its format; refuses one that breaks it."""
    import json

    if found := faults(spark, document, name, **constants):
        raise ValueError(f"INVALID_{name.upper()}: {', '.join(found)}")
    write_text(spark, path, json.dumps(document, indent=2) + "\n")
    return document


def read_checked(spark: SparkSession, path: str, name: str, **constants: str) -> tuple[dict, list[str]]:
    """(a document, the paths that break its format)."""
    import json

    document = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    return document, faults(spark, document, name, **constants)
