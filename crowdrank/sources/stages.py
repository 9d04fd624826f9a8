"""S7 + S8: named stages that a later run picks up.

A stage is written once, under a name made of the run's query and the stage
(``Mozart_Violin_comments``), with a manifest beside it: the fingerprint of
all that went into it, the data folder, its rows and columns.  The manifest is
the commit: it is written after the data and put in place by one rename, so
a run that dies leaves the stage as it was.  A later run that asks for the stage
with the same fingerprint reads it and does not build it.

A fingerprint covers the stage's settings, the fingerprints of the stages
before it, and name, size and time of each input file, so a change anywhere
rebuilds what depends on it, and nothing else.  Inputs that are gone cannot be
compared: then a finished stage stands.  Data that a new version replaces is
deleted after the commit; ``clean`` removes what dead runs left.

The folder must be one that all executors see (the default is below the
shared checkpoint folder).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdrank.session import checkpoint_root, file_system
from crowdrank.sources.files import stage_name

MANIFEST = "manifest.json"
GONE = "gone"


@dataclass
class StageStore:
    """Stages of one run (``query``) under ``root``."""

    spark: SparkSession
    query: str
    root: str | None = None
    built: list[str] = field(default_factory=list)   # by this object, in order
    reused: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.root is None:
            self.root = f"{checkpoint_root(self.spark).rstrip('/')}/stages"

    def folder(self, stage: str) -> str:
        return f"{self.root.rstrip('/')}/{stage_name(self.query, stage)}"

    # --- manifests -----------------------------------------------------------

    def manifest(self, stage: str) -> dict | None:
        """The stage's manifest; None when it was never finished."""
        fs, path = file_system(self.spark, f"{self.folder(stage)}/{MANIFEST}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, stage: str, manifest: dict) -> None:
        """Write the manifest aside and rename it over the old one."""
        jvm = self.spark._jvm
        fs, aside = file_system(self.spark, f"{self.folder(stage)}/.{MANIFEST}-{uuid.uuid4().hex}")
        stream = fs.create(aside)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            aside.toUri(), self.spark._jsc.hadoopConfiguration()
        )
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{self.folder(stage)}/{MANIFEST}"), options)

    # --- fingerprints ----------------------------------------------------------

    def _files(self, path: str) -> str:
        """Names, sizes and times of the files of an input, hashed; ``gone``
        when there is none."""
        fs, at = file_system(self.spark, path)
        if not fs.exists(at):
            return GONE
        found, files = [], fs.listFiles(at, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()

    def fingerprint(self, settings: object, inputs: Sequence[str], after: Sequence[str]) -> tuple[str, bool]:
        """(hash of all that goes into a stage, whether an input is gone)."""
        files = [self._files(path) for path in inputs]
        before = []
        for stage in after:
            manifest = self.manifest(stage)
            if manifest is None:
                raise ValueError(f"stage {stage!r} is not finished")
            before.append(manifest["fingerprint"])
        told = json.dumps([settings, files, before], sort_keys=True, default=str)
        return hashlib.sha256(told.encode()).hexdigest(), GONE in files

    # --- stages ------------------------------------------------------------------

    def read(self, stage: str) -> DataFrame:
        """A finished stage, by name."""
        manifest = self.manifest(stage)
        if manifest is None:
            raise FileNotFoundError(self.folder(stage))
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.folder(stage)}/{manifest['data']}")

    def stage(
        self, name: str, build: Callable[[], DataFrame], settings: object = None,
        inputs: Sequence[str] = (), after: Sequence[str] = (),
    ) -> DataFrame:
        """The stage ``name``: read if it was finished with the same
        ``settings``, input files and earlier stages (``after``), else built,
        written and committed."""
        wanted, gone = self.fingerprint(settings, inputs, after)
        old = self.manifest(name)
        if old is not None and (old["fingerprint"] == wanted or (gone and old["settings"] == _told(settings))):
            self.reused.append(name)
            return self.read(name)
        if gone:
            raise FileNotFoundError(f"an input of stage {name!r} is gone, and the stage was not finished")
        data = f"data-{uuid.uuid4().hex}"
        df = build()
        obs = Observation()
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder(name)}/{data}")
        self._commit(name, {
            "stage": name, "query": self.query, "fingerprint": wanted, "settings": _told(settings), "data": data,
            "rows": int(obs.get["rows"]), "schema": json.loads(df.schema.json()),
        })
        if old is not None:
            self._delete(f"{self.folder(name)}/{old['data']}")
        self.built.append(name)
        return self.read(name)

    def report(self, stages: Sequence[str]) -> DataFrame:
        """(stage, rows, columns) of finished stages, from their manifests."""
        found = [m for m in map(self.manifest, stages) if m is not None]
        rows = [(m["stage"], m["rows"], len(m["schema"]["fields"])) for m in found]
        return self.spark.createDataFrame(rows, "stage string, rows long, columns int")

    # --- clean-up ------------------------------------------------------------------

    def _delete(self, path: str) -> None:
        fs, at = file_system(self.spark, path)
        fs.delete(at, True)

    def clean(self, stage: str) -> int:
        """Delete the stage's data that no manifest names (left by dead runs);
        returns how many folders went.  Not while another run writes it."""
        manifest = self.manifest(stage) or {"data": None}
        fs, folder = file_system(self.spark, self.folder(stage))
        if not fs.exists(folder):
            return 0
        left = [
            s.getPath() for s in fs.listStatus(folder)
            if s.getPath().getName().startswith(("data-", f".{MANIFEST}")) and s.getPath().getName() != manifest["data"]
        ]
        for path in left:
            fs.delete(path, True)
        return len(left)


def _told(settings: object) -> str:
    return json.dumps(settings, sort_keys=True, default=str)
