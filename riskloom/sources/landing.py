"""Landing packages: CSV files addressed by their content, manifests, and source-aligned rows with lineage."""

from __future__ import annotations

import csv
import hashlib
import json
import shutil
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from riskloom.sources.scratch import stash

MANIFEST_VERSION = "1.0.0"


@dataclass(frozen=True)
class Manifest:
    manifest_version: str
    dataset_name: str
    source_id: str
    source_object_path: str
    landed_object_path: str
    source_format: str
    source_sha256: str
    source_contract_version: str
    source_size_bytes: int
    source_record_count: int
    source_columns: list[str]
    has_header: bool = True
    request_window: None = None
    generation: dict | None = None

    def to_json(self) -> str:
        body = {k: v for k, v in asdict(self).items() if k != "generation" or v is not None}
        return json.dumps(body, indent=2, sort_keys=True) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))


def _measured(path: str) -> tuple[str, int]:
    """SHA-256 and size of a file, read in pieces."""
    found, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            found.update(piece)
            size += len(piece)
    return found.hexdigest(), size


def build_manifest(path: str, dataset: str, source_id: str, contract_version: str, landed_path: str = "", generation: dict | None = None) -> Manifest:
    """Describe a CSV file, read row by row. ValueError for an empty file, repeated or blank headers, and rows of another width."""
    sha256, size = _measured(path)
    with open(path, encoding="utf-8", newline="") as f:
        rows = csv.reader(f)
        header = next(rows, None)
        if header is None:
            raise ValueError("the file has no header")
        if len(set(header)) != len(header) or not all(h.strip() for h in header):
            raise ValueError("headers must be unique and not blank")
        count = 0
        for row in rows:
            if len(row) != len(header):
                raise ValueError("a row has another number of fields than the header")
            count += 1
    return Manifest(MANIFEST_VERSION, dataset, source_id, path, landed_path, "csv", sha256, contract_version, size, count, header, generation=generation)


def land(path: str, root: str, dataset: str, source_id: str, contract_version: str) -> Manifest:
    """Copy a file to <root>/<dataset>/<sha256>/ beside its manifest; landing the same content again changes nothing."""
    found = build_manifest(path, dataset, source_id, contract_version)
    folder = Path(root) / dataset / found.source_sha256
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / Path(path).name
    found = replace(found, landed_object_path=str(target))
    if not target.exists():
        shutil.copyfile(path, target)
        (folder / "manifest.json").write_text(found.to_json())
    return found


def reconcile(manifest: Manifest, data: bytes, columns: list[str], rows: int) -> list[str]:
    """The manifest's statements that the landed bytes don't bear out."""
    checks = {
        "SOURCE_SHA256": manifest.source_sha256 == hashlib.sha256(data).hexdigest(),
        "SOURCE_SIZE": manifest.source_size_bytes == len(data),
        "SOURCE_COLUMNS": manifest.source_columns == columns,
        "RECORD_COUNT": manifest.source_record_count == rows,
        "MANIFEST_VERSION": manifest.manifest_version == MANIFEST_VERSION,
        "SOURCE_FORMAT": manifest.source_format == "csv",
    }
    return sorted(k for k, ok in checks.items() if not ok)


def reconcile_file(manifest: Manifest) -> list[str]:
    """``reconcile`` of the landed file, read in pieces."""
    try:
        found = build_manifest(manifest.landed_object_path, manifest.dataset_name, manifest.source_id, manifest.source_contract_version)
    except (OSError, ValueError):
        return ["LANDED_FILE"]
    checks = {
        "SOURCE_SHA256": manifest.source_sha256 == found.source_sha256,
        "SOURCE_SIZE": manifest.source_size_bytes == found.source_size_bytes,
        "SOURCE_COLUMNS": manifest.source_columns == found.source_columns,
        "RECORD_COUNT": manifest.source_record_count == found.source_record_count,
        "MANIFEST_VERSION": manifest.manifest_version == MANIFEST_VERSION,
        "SOURCE_FORMAT": manifest.source_format == "csv",
    }
    return sorted(k for k, ok in checks.items() if not ok)


def read_landed(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """The landed rows, all columns text."""
    schema = StructType([StructField(c, StringType()) for c in manifest.source_columns])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(manifest.landed_object_path)


def raw_record(columns: list[str]) -> Column:
    """The row as one line of comma-separated values: fields with a comma, quote or line break are quoted, the empty text
    is a pair of quotes and null is nothing, so that different rows give different lines."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        parts.append(F.when(text.isNull(), "").when((text == "") | text.rlike('[",\r\n]'), quoted).otherwise(text))
    return F.concat_ws(",", *parts)


def with_lineage(rows: DataFrame, columns: list[str], order: list[str], batch_id: str, source_id: str, source_path: str, source_sha256: str, contract_version: str, ingested_at: str) -> DataFrame:
    """Add batch, source, 1-based row number in the order given, record id (batch:number), the raw record and its hash.

    Rows are numbered by ranges: sorted partitions are counted and each starts after the ones before, so no task sees all rows.
    """
    return numbered(rows.withColumn("raw_record", raw_record(columns)), order, "source_row_number").withColumns(
        {
            "batch_id": F.lit(batch_id),
            "source_id": F.lit(source_id),
            "source_record_id": F.concat_ws(":", F.lit(batch_id), F.col("source_row_number").cast("string")),
            "source_object_path": F.lit(source_path),
            "source_sha256": F.lit(source_sha256),
            "source_record_sha256": F.sha2("raw_record", 256),
            "contract_version": F.lit(contract_version),
            "ingested_at_utc": F.lit(ingested_at).cast("timestamp"),
        }
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add a gapless number from 1 in the given total order, by one range sort.

    The range partitions are written before they are counted: their bounds come from a sample, and counting and numbering
    must see the same bounds, also when an executor is lost.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stash(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    starts = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return within.join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__p", "__at", "__before")


def ingestion_plan(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Per request (dataset_name, source_id, source_sha256): WRITE, SKIPPED_DUPLICATE with the earlier batch, or ERROR."""
    keys = ["dataset_name", "source_id", "source_sha256"]
    prior = log.where("status = 'SUCCEEDED'").groupBy(*keys).agg(F.count(F.lit(1)).alias("prior_batches"), F.min("batch_id").alias("prior_batch_id"))
    rows = requests.join(prior, keys, "left").withColumn("prior_batches", F.coalesce("prior_batches", F.lit(0)))
    decision = F.when(F.col("prior_batches") == 0, "WRITE").when(F.col("prior_batches") == 1, "SKIPPED_DUPLICATE").otherwise("ERROR")
    effective = F.when(decision == "WRITE", F.col("request_id")).when(decision == "SKIPPED_DUPLICATE", F.col("prior_batch_id"))
    return rows.withColumn("decision", decision).withColumn("effective_batch_id", effective)


def prepare(manifests: list[Manifest], statuses: dict[str, str]) -> list[dict]:
    """Landing entries approved for publication; ValueError unless all extracts succeeded and their bytes are unchanged."""
    out = []
    for m in manifests:
        if statuses.get(m.dataset_name) != "SUCCEEDED":
            raise ValueError(f"{m.dataset_name}: the extract did not succeed")
        again = build_manifest(m.source_object_path, m.dataset_name, m.source_id, m.source_contract_version)
        if (again.source_sha256, again.source_record_count) != (m.source_sha256, m.source_record_count):
            raise ValueError(f"{m.dataset_name}: the file has changed since its extract")
        out.append({**asdict(m), "publication_status": "APPROVED"})
    return out


def one_snapshot(entries: list[dict]) -> str:
    """The snapshot that all entries share; ValueError if they differ."""
    found = {e.get("snapshot_sha256") for e in entries}
    if len(found) != 1 or None in found:
        raise ValueError("the datasets are of different snapshots")
    return found.pop()
