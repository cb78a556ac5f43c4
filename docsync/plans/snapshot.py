"""Tracked state as versioned parquet snapshots.

A version is a base, written whole, and the deltas since: rows that replace those of their
key, or drop them. It becomes visible when its file is created in `commits`, after its data is
complete. Nothing is overwritten, so a run that dies leaves the last committed version in place.

Several writers may share a store: only one of them can create the file of a version. Another
one that changed other keys goes on with the next version; one whose keys were changed since it
read them is refused, as its decisions are out of date.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.schemas import SYNC_STATE

COMMIT = "version bigint, tag string, location string, kind string, n_rows bigint"
KEY = ["kb_id", "file_key"]
# Deltas are folded into a new base once they hold this share of its rows, or are this many.
COMPACT_SHARE = 0.25
COMPACT_DELTAS = 20
# Versions that older readers may still be using.
KEEP_VERSIONS = 3
# Changed keys that may be broadcast, at about 150 bytes each.
BROADCAST_CHANGES = 500_000


class StaleStateError(RuntimeError):
    """The state was changed by another writer after it was read."""


class SnapshotStore:
    """State rows of `schema` under `path`, a folder that all executors share.

    `kb_id` and `file_key` are the key of a row.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = SYNC_STATE):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = [field.split()[0] for field in schema.split(", ")]
        self.delta_schema = schema + ", _dropped boolean, _version bigint"
        self._staged: list[str] = []
        # The version that decisions of this store object rest on.
        self._seen: int | None = None

    def _fs(self, location: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{location}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _remove(self, location: str) -> None:
        files, path = self._fs(location)
        files.delete(path, True)

    def _commits(self) -> DataFrame:
        """The commit log. Its folder is made before any data, so a folder that holds snapshots
        without it is damaged, and must not read as empty; an empty one had no commit yet."""
        files, path = self._fs("commits")
        if files.exists(path):
            return self.spark.read.schema(COMMIT).json(path.toString())
        files, path = self._fs("snapshots")
        if files.exists(path):
            raise FileNotFoundError(f"{self.path} holds snapshots but no commit log")
        return self.spark.createDataFrame([], COMMIT)

    def _log(self) -> list:
        """Commits of the current base and its deltas, in order; at most COMPACT_DELTAS + 1."""
        commits = self._commits()
        base = commits.filter("kind <> 'delta'").agg(F.max("version")).first()[0]
        if base is None:
            return []
        return sorted(commits.filter(F.col("version") >= base).collect(), key=lambda r: r["version"])

    def version(self) -> int:
        return self._commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def has_tag(self, tag: str) -> bool:
        return not self._commits().filter(F.col("tag") == tag).isEmpty()

    def read(self) -> DataFrame:
        log = self._log()
        self._seen = log[-1]["version"] if log else 0
        if not log:
            return self.spark.createDataFrame([], self.schema)
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/{log[0]['location']}")
        deltas = [f"{self.path}/{r['location']}" for r in log[1:] if r["kind"] == "delta"]
        if not deltas:
            return base
        changes = self.spark.read.schema(self.delta_schema).parquet(*deltas)
        if len(deltas) > 1:
            # Of several changes to a key the latest holds.
            others = [c for c in changes.columns if c not in KEY]
            changes = changes.groupBy(*KEY).agg(F.max_by(F.struct(*others), "_version").alias("_last"))
            changes = changes.select(*KEY, "_last.*")
        fits = sum(r["n_rows"] for r in log[1:]) <= BROADCAST_CHANGES
        met = changes.select(*KEY)
        kept = base.join(F.broadcast(met) if fits else met, KEY, "left_anti")
        return kept.unionByName(changes.filter("NOT _dropped").select(*self.columns))

    def _claim(self, version: int, tag: str, location: str, kind: str, n_rows: int) -> bool:
        """Create the file of a version, unless another writer has; whole or not at all."""
        row = {"version": version, "tag": tag, "location": location, "kind": kind, "n_rows": n_rows}
        text = json.dumps(row).encode()
        files, final = self._fs(f"commits/{version:020d}.json")
        _, temp = self._fs(f"commits/_{uuid.uuid4().hex}")
        if files.getScheme() == "file":
            name = temp.toUri().getPath()
            with open(name, "xb") as f:
                f.write(text)
            try:
                os.link(name, final.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                os.unlink(name)
            return True
        out = files.create(temp)
        out.write(text)
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, final, how)
        except Py4JJavaError as e:
            files.delete(temp, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def _begin(self) -> None:
        files, path = self._fs("commits")
        files.mkdirs(path)

    def _write_base(self, state: DataFrame, version: int, tag: str, kind: str) -> bool:
        self._begin()
        location = f"snapshots/v{version}-{uuid.uuid4().hex}"
        # Sorted, so that reading one knowledge base skips row groups of the others.
        ordered = state.select(*self.columns).sortWithinPartitions(*KEY)
        ordered.write.parquet(f"{self.path}/{location}")
        n_rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{location}").count()
        if not self._claim(version, tag, location, kind, n_rows):
            self._remove(location)
            return False
        self._seen = version
        self._expire()
        return True

    def commit(self, state: DataFrame, tag: str = "") -> int:
        """Write a new base and make it the latest. A tag that is already committed is not
        written again, so a repeated batch has no effect. A base replaces all keys, so any commit
        since the state was read refuses it."""
        if tag and self.has_tag(tag):
            return self.version()
        version = (self.version() if self._seen is None else self._seen) + 1
        if version <= self.version() or not self._write_base(state, version, tag, "base"):
            raise StaleStateError(f"version {version} of {self.path} was committed by another writer")
        return version

    def _check_keys(self, keys: DataFrame, since: int) -> None:
        """Refuse keys that commits after `since` have changed."""
        later = self._commits().filter((F.col("version") > since) & (F.col("kind") != "fold")).collect()
        if any(r["kind"] == "base" for r in later):
            raise StaleStateError(f"{self.path} was written anew after version {since}")
        if later:
            paths = [f"{self.path}/{r['location']}" for r in later]
            others = self.spark.read.schema(self.delta_schema).parquet(*paths).select(*KEY)
            if not keys.join(others, KEY, "left_semi").isEmpty():
                raise StaleStateError(f"keys were changed in {self.path} after version {since}")

    def commit_changes(self, rows: DataFrame, tag: str = "", dropped: DataFrame | None = None) -> int:
        """Commit changed rows and dropped keys alone; the rest of the state is not read.
        Deltas that have grown large against their base are folded into a new one. While other
        writers take a version first, the next one is tried."""
        if tag and self.has_tag(tag):
            return self.version()
        since = self.version() if self._seen is None else self._seen
        if not self._log():
            return self.commit(rows, tag)
        delta = rows.select(*self.columns, F.lit(False).alias("_dropped"))
        if dropped is not None:
            gone = dropped.select(*KEY, F.lit(True).alias("_dropped"))
            delta = delta.unionByName(gone, allowMissingColumns=True).select(*delta.columns)
        tried = ""
        while True:
            log = self._log()
            version = log[-1]["version"] + 1
            location = f"snapshots/d{version}-{uuid.uuid4().hex}"
            delta.withColumn("_version", F.lit(version).cast("bigint")).write.parquet(f"{self.path}/{location}")
            if tried:
                self._remove(tried)
            written = self.spark.read.schema(self.delta_schema).parquet(f"{self.path}/{location}")
            delta, tried, n_rows = written.drop("_version"), location, written.count()
            self._check_keys(delta.select(*KEY), since)
            if self._claim(version, tag, location, "delta", n_rows):
                break
        self._seen = version
        changed = n_rows + sum(r["n_rows"] for r in log[1:])
        if len(log) > COMPACT_DELTAS or changed > COMPACT_SHARE * log[0]["n_rows"]:
            # A fold changes nothing; if another writer comes first, a later commit folds.
            whole = self.read()
            if self._write_base(whole, self._seen + 1, "", "fold"):
                return self._seen
        return version

    def _expire(self) -> None:
        """Remove data that only versions before the last KEEP_VERSIONS bases use. Their
        log rows stay, as they hold the tags."""
        bases = self._commits().filter("kind <> 'delta'").orderBy(F.col("version").desc())
        recent = [r["version"] for r in bases.limit(KEEP_VERSIONS).collect()]
        if len(recent) < KEEP_VERSIONS:
            return
        old = self._commits().filter(F.col("version") < recent[-1]).orderBy(F.col("version").desc())
        # Each commit expires at most what one base and its deltas held.
        for row in old.limit(COMPACT_DELTAS + 2).collect():
            self._remove(row["location"])

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write an intermediate result next to the snapshots and read it back."""
        location = f"staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{location}")
        self._staged.append(location)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{location}")

    def drop_staged(self) -> None:
        """Remove what this store object has staged; tables read from it are gone."""
        for location in self._staged:
            self._remove(location)
        self._staged = []
