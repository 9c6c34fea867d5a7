"""Tabular sources and sinks: parquet and CSV corpora, feeds, snapshots, JDBC, feature files, manifests, archives."""

from __future__ import annotations

import json
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.corpus import mapped_labels

MAIL_CSV = "sender string, receiver string, date string, subject string, body string, urls string, label string"
CANONICAL = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "record_id", "source_dataset", "source_record_id", "original_label", "normalized_label", "threat_type", "subject", "body", "sender", "recipient",
        "cc", "reply_to", "date", "message_id", "raw_file_path", "dataset_version", "license", "content_hash", "raw_hash")],
    *[T.StructField(n, T.BooleanType()) for n in ("raw_email_available", "has_html", "has_headers")],
    *[T.StructField(n, T.IntegerType()) for n in ("url_count", "attachment_count")],
])


def read_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.limit(limit) if limit is not None else df


def read_csv(spark: SparkSession, path: str, schema: str = MAIL_CSV) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """Two columns, `Email Text` and `Email Type`; labelled by type, rejected where the text is null or blank."""
    raw = read_csv(spark, path, "`Email Text` string, `Email Type` string")
    label, threat = mapped_labels(F.lower("Email Type"), ["phishing email", "phishing"], ["spam"])
    rows = raw.select(F.col("Email Text").alias("body"), F.col("Email Type").alias("original_label"), label.alias("normalized_label"), threat.alias("threat_type"))
    return rows.filter(F.trim(F.coalesce("body", F.lit(""))) != "")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line."""
    return spark.read.text(path).filter(F.col("value").startswith("http")).distinct()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int) -> DataFrame:
    """A table of a database, read in ranges of a number column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions)


def read_features(spark: SparkSession, path: str, names: list[str], forbidden: list[str]) -> DataFrame:
    """Feature files in the registry's order; fails on leaked, missing, NaN or infinite columns."""
    df = spark.read.parquet(path)
    leaked, missing = set(df.columns) & set(forbidden), [n for n in names if n not in df.columns]
    if leaked or missing:
        raise ValueError(f"leaked {sorted(leaked)}, missing {missing[:5]}")
    bad = df.agg(*[F.count_if(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))).alias(n) for n in names]).first()
    if any(bad):
        raise ValueError(f"not finite: {[n for n in names if bad[n]][:5]}")
    return df.select(*[c for c in df.columns if c not in names], *names)


def write_splits(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("split").parquet(path)


def write_canonical(records: DataFrame, path: str) -> None:
    """The canonical schema, absent columns null."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CANONICAL.fields]
    records.select(*cols).write.mode("overwrite").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report of one or few rows as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a table; one of more than `most` rows is an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} rows")
    head = f"| {' | '.join(report.columns)} |\n|{'---|' * len(report.columns)}\n"
    return head + "".join(f"| {' | '.join(str(v) for v in r)} |\n" for r in rows)


def schema_json(names: list[str]) -> str:
    return json.dumps(json.loads(T.StructType([T.StructField(n, T.DoubleType()) for n in names]).json()), indent=1)


def raw_evidence(raw: DataFrame, sha256: str) -> DataFrame:
    """The bytes whose hash is given, with the hash."""
    return raw.withColumn("sha256", F.sha2("content", 256)).filter(F.col("sha256") == sha256).select("path", "content", "sha256")


def safe_extract(archive: str, folder: str, most_files: int = 100_000, most_bytes: int = 1 << 30, most_each: int = 100 << 20) -> list[str]:
    """Extracts a tar or zip on the driver: no path outside the folder, no links, bounds on count and size."""
    root = Path(folder).resolve()
    root.mkdir(parents=True, exist_ok=True)
    out, total = [], 0

    def target(name: str, size: int) -> Path:
        nonlocal total
        path = (root / name).resolve()
        total += size
        if root not in path.parents:
            raise ValueError(f"{name} leads out of the folder")
        if len(out) >= most_files or size > most_each or total > most_bytes:
            raise ValueError("the archive exceeds its bounds")
        path.parent.mkdir(parents=True, exist_ok=True)
        out.append(str(path))
        return path

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for i in z.infolist():
                if i.external_attr >> 28 == 0xA:
                    raise ValueError(f"{i.filename} is a link")
                if not i.is_dir():
                    target(i.filename, i.file_size).write_bytes(z.read(i))
    else:
        with tarfile.open(archive) as t:
            for m in t:
                if m.issym() or m.islnk() or m.isdev():
                    raise ValueError(f"{m.name} is a link or device")
                if m.isfile():
                    target(m.name, m.size).write_bytes(t.extractfile(m).read())
    return out
