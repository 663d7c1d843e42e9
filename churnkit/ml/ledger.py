"""Ledger of fits (M12-M14, S6, S7, S10): every (candidate, fold) fit is committed by itself, and a run that starts again fits only what
is missing.

A fit's folder counts once its description, written last, is complete.  Events are appended to a table; the state of a run is its
latest event.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.ml import ensemble
from churnkit.ml.ensemble import Model
from churnkit.sources import artifacts

EVENTS = ("run_id string, run_name string, event string, ts timestamp, params map<string,string>, metrics map<string,double>, "
          "tags map<string,string>")


class Ledger:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str, fit: int) -> str:
        return f"{self.folder}/fits/{name}/{fit}"

    def has(self, name: str, fit: int) -> bool:
        return ensemble.saved(self.spark, self.path(name, fit))

    def missing(self, wanted: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return [x for x in wanted if not self.has(*x)]

    def commit(self, name: str, fit: int, model: Model, params: dict) -> None:
        ensemble.save(self.spark, model, self.path(name, fit))
        self.event(name, "fitted", params, {}, {"fit": str(fit)})

    def load(self, name: str, fit: int) -> Model:
        if not self.has(name, fit):
            raise FileNotFoundError(f"{name} has no fit {fit} in {self.folder}; run the training job first")
        return ensemble.load(self.spark, self.path(name, fit))

    def event(self, run_name: str, event: str, params: dict | None = None, metrics: dict | None = None, tags: dict | None = None) -> None:
        """Append an event; only int/float (never bool) values become metrics."""
        numeric = {k: float(v) for k, v in (metrics or {}).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        at = _dt.datetime.now(_dt.timezone.utc)
        row = {"run_id": uuid.uuid4().hex, "run_name": run_name, "event": event, "ts": at.isoformat(), "params": {k: str(v) for k, v in (params or {}).items()},
               "metrics": numeric, "tags": {k: str(v) for k, v in (tags or {}).items()}}
        artifacts.write_bytes(self.spark, f"{self.folder}/events/{at.strftime('%Y%m%dT%H%M%S%f')}-{row['run_id']}.json", json.dumps(row).encode())

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).json(f"{self.folder}/events")

    def runs(self) -> DataFrame:
        """The latest event of each run."""
        row = F.struct(*[x.split()[0] for x in EVENTS.split(", ")])
        return self.events().groupBy("run_name").agg(F.max_by(row, F.struct("ts", "run_id")).alias("r")).select("r.*")

    def note(self, name: str, value: dict) -> None:
        """Write a small JSON document, complete or not at all."""
        artifacts.write_bytes(self.spark, f"{self.folder}/{name}.json", json.dumps(value).encode())

    def noted(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}.json"
        return json.loads(artifacts.read_bytes(self.spark, path)) if artifacts.path_exists(self.spark, path) else None
