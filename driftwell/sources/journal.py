"""A journal of frozen predictions and their later evaluations, as Parquet tables.

Rows are inserted if their key is new; snapshots are replaced only where both the journal and the call allow it. One
writer at a time holds the journal's lock file, so that two cannot both find a key missing. Payloads are JSON text in
canonical form.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOADS = ("parameters", "model_outputs", "ou_outputs", "probability_outputs", "diagnostic_outputs", "consensus_outputs")
SNAPSHOTS = "prediction_id string, created_at timestamp, data_cutoff timestamp, target_ticker string, frequency string, current_price double, model_version string, data_source string, parameter_hash string, notes string, " + ", ".join(f"{p} string" for p in PAYLOADS)
EVALUATIONS = (
    "prediction_id string, evaluation_timestamp timestamp, evaluation_horizon string, realized_price double, exit_reached boolean, stop_reached boolean, fraction_reverted double, maximum_favorable_excursion double, maximum_adverse_excursion double, "
    "elapsed_trading_days int, live_prices map<string,double>, current_residual double, distance_to_entry double, distance_to_exit double, distance_to_stop double, realized_pnl double, notes string"
)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def parameter_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def new_snapshot(*, target_ticker: str, current_price: float, data_cutoff, created_at, frequency: str, data_source: str, model_version: str, outputs: dict[str, dict], notes: str = "") -> dict:
    """A snapshot row with an id of its own and the hash of its frozen outputs."""
    if current_price <= 0 or data_cutoff > created_at or set(outputs) - set(PAYLOADS):
        raise ValueError("a snapshot needs a positive price, a cutoff not after its creation, and known payloads")
    row = {"prediction_id": f"prediction-{uuid.uuid4()}", "created_at": created_at, "data_cutoff": data_cutoff, "target_ticker": target_ticker, "frequency": frequency, "current_price": float(current_price), "model_version": model_version, "data_source": data_source, "parameter_hash": parameter_hash(outputs), "notes": notes}
    return row | {p: canonical(outputs.get(p, {})) for p in PAYLOADS}


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, one for each key."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


@dataclass(frozen=True)
class Journal:
    spark: SparkSession
    root: str
    allow_overwrite: bool = False

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextlib.contextmanager
    def _locked(self):
        path, fs = self._path("_lock")
        fs.mkdirs(path.getParent())
        try:
            fs.create(path, False).close()  # fails if it is there
        except Exception as e:
            raise RuntimeError(f"another writer holds {path}; remove it if that writer is gone") from e
        try:
            yield
        finally:
            fs.delete(path, False)

    def _rows(self, rows: list[dict] | DataFrame, schema: str) -> DataFrame:
        """The rows in the journal's columns and kinds; columns that are not the journal's raise."""
        if not isinstance(rows, DataFrame):
            return self.spark.createDataFrame(rows, schema)
        kinds = self.spark.createDataFrame([], schema).schema
        if other := set(rows.columns) - set(kinds.names):
            raise ValueError(f"not columns of the journal: {sorted(other)}")
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))

    def _append(self, name: str, schema: str, rows: DataFrame, keys: list[str], replace: bool = False) -> None:
        with self._locked():
            there = self._read(name, schema)
            new = f"{name}-new"
            rows.write.mode("overwrite").parquet(f"{self.root}/{new}")  # computed once
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{new}")
            old, fs = self._path(new)
            try:
                if rows.groupBy(*keys).count().where("count > 1").take(1):
                    raise FileExistsError(f"{name}: a key stands twice")
                if not rows.join(there, keys, "left_semi").take(1):
                    rows.write.mode("append").parquet(f"{self.root}/{name}")
                elif not replace:
                    raise FileExistsError(f"{name}: a row with that key is there already")
                else:
                    there.join(rows, keys, "left_anti").select(*rows.columns).unionByName(rows).write.mode("overwrite").parquet(f"{self.root}/{name}-whole")
                    whole, table = self._path(f"{name}-whole")[0], self._path(name)[0]
                    fs.delete(table, True)
                    fs.rename(whole, table)
            finally:
                fs.delete(old, True)

    def save_snapshots(self, rows: list[dict] | DataFrame, *, overwrite: bool = False) -> None:
        """Inserts snapshots; known ones are replaced if ``overwrite`` is asked for here and allowed by the journal."""
        self._append("snapshots", SNAPSHOTS, self._rows(rows, SNAPSHOTS), ["prediction_id"], overwrite and self.allow_overwrite)

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOTS)

    def load_snapshot(self, prediction_id: str) -> dict:
        row = self.snapshots().where(F.col("prediction_id") == prediction_id).first()
        if row is None:
            raise KeyError(prediction_id)
        return row.asDict() | {p: json.loads(row[p]) for p in PAYLOADS}

    def list_snapshots(self) -> DataFrame:
        return self.snapshots().select("prediction_id").orderBy("prediction_id")

    def save_evaluations(self, rows: list[dict] | DataFrame) -> None:
        df = self._rows(rows, EVALUATIONS)
        known = df.join(self.snapshots().select("prediction_id"), "prediction_id", "left_anti")
        if known.take(1):
            raise KeyError("an evaluation needs its snapshot")
        self._append("evaluations", EVALUATIONS, df, ["prediction_id", "evaluation_timestamp"])

    def evaluations(self, prediction_id: str | None = None) -> DataFrame:
        df = self._read("evaluations", EVALUATIONS)
        return (df if prediction_id is None else df.where(F.col("prediction_id") == prediction_id)).orderBy("evaluation_timestamp")
