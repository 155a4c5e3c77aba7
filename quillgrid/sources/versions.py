"""Sets of Parquet tables that change together: reload, append and snapshots, published by one manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class TableSet:
    """Tables under ``root``, each a list of Parquet folders named by the newest manifest.

    ``commit`` writes all new folders first and then publishes one manifest,
    so readers see every change of a commit or none, and a commit that fails
    leaves nothing behind but unnamed folders, which it deletes. Folders are
    never written twice: a table may be reloaded from itself, and older
    versions stay readable. One writer at a time; where another has published
    in between, the commit fails and nothing of it is seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest manifest; 0 if nothing was committed."""
        fs, folder = self._fs(), self._path(f"{self.root}/manifests")
        held = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in held if n.endswith(".json") and not n.startswith(("_", "."))), default=0)

    def state(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of every table."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/data/{p}" for p in self.state(version)[name]))

    def commit(self, reload: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Replace the tables of ``reload`` whole, add the rows of ``append``, and return the new version."""
        base, fs = self.version(), self._fs()
        state, written = self.state(base), []
        try:
            for tables, keep in ((reload or {}, False), (append or {}, True)):
                for name, df in tables.items():
                    written.append(f"{name}/{uuid.uuid4().hex}")
                    df.write.option("compression", "zstd").parquet(f"{self.root}/data/{written[-1]}")
                    state[name] = [*(state.get(name, []) if keep else []), written[-1]]
            self._publish(fs, base + 1, state)
        except Exception:
            for path in written:
                fs.delete(self._path(f"{self.root}/data/{path}"), True)
            raise
        return base + 1

    def _publish(self, fs, version: int, state: dict[str, list[str]]) -> None:
        """A manifest appears whole, by rename, and never over another."""
        target, draft = (self._path(f"{self.root}/manifests/{n}") for n in (f"{version:09d}.json", f"_{uuid.uuid4().hex}"))
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True), "utf-8"))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} was published by another writer")
