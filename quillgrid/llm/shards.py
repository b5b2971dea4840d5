"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards that are never changed. A compaction
groups shards into tiers by size; a tier with at least ``fan_in`` shards is merged, in
order of arrival, into runs of about ``target`` bytes. All runs of a compaction are
written by one Spark job, one task for each run. A commit writes the next manifest
under a name that must not exist yet and renames it into place; readers see either the
old version or the new one, and a lost executor or driver leaves only unlisted files.

Defined results: rows are kept as they are, repeated or null ones included; an empty
arrival adds no shard; a commit that lost a race raises FileExistsError; extra columns stay.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.scratch import BROADCAST_ROWS, filesystem

TARGET, FAN_IN, GROWTH = 64 << 20, 4, 4


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: int
    merges: int = 0
    rows: int = 0


def tier_of(size: int, growth: int = GROWTH, smallest: int = 1 << 16) -> int:
    """Tier 0 holds shards up to ``smallest`` bytes; each further one those up to ``growth`` times as large."""
    return 0 if size <= smallest else 1 + int(math.log(size / smallest, growth))


def plan(shards: list[Shard], target: int = TARGET, fan_in: int = FAN_IN, growth: int = GROWTH) -> list[list[Shard]]:
    """Runs to merge: within each tier, shards under ``target`` by arrival, packed up to ``target`` bytes."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < target:
            tiers.setdefault(tier_of(s.bytes, growth), []).append(s)
    runs = []
    for _, members in sorted(tiers.items()):
        if len(members) < fan_in:
            continue
        run: list[Shard] = []
        for s in sorted(members, key=lambda s: (s.arrival, s.path)):
            if run and sum(x.bytes for x in run) + s.bytes > target:
                runs.append(run)
                run = []
            run.append(s)
        runs.append(run)
    return [r for r in runs if len(r) > 1]


class Store:
    """A folder with shards/ and manifests/; every method is safe to repeat after a failure."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.top = filesystem(spark, self.root)
        self.jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))], default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path("manifests", f"{version:020d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], base: int) -> int:
        """Publish ``shards`` as version base + 1, if nobody has published it yet."""
        body = json.dumps({"version": base + 1, "base": base, "shards": [asdict(s) for s in shards]}, sort_keys=True)
        final = self._path("manifests", f"{base + 1:020d}.json")
        draft = self._path("manifests", f"_{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.top.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise FileExistsError(f"version {base + 1} is already committed") from e
            raise
        return base + 1

    def _written(self, folder: str) -> list[tuple[str, int, int]]:
        """(path, bytes, rows) of the Parquet files under ``folder`` that hold rows; rows come from the files' own counts."""
        # By path: one task gives its files in several runs' folders the same name.
        counts = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
        rows = {unquote(r["f"]).split(f"/{folder}/")[-1]: r["n"] for r in counts.collect()}
        files, found = self.fs.listFiles(self._path(*folder.split("/")), True), []
        while files.hasNext():
            s = files.next()
            tail = s.getPath().toString().split(f"/{folder}/")[-1]
            if tail in rows:
                found.append((f"{folder}/{tail}", s.getLen(), rows[tail]))
        return sorted(found)

    def append(self, arrival: DataFrame, rows_each: int = 2_000) -> int:
        """Write an arrival as shards of at most ``rows_each`` rows, as its own tasks produce them, and commit them."""
        base = self.version()
        folder = f"shards/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").option("maxRecordsPerFile", rows_each).parquet(f"{self.root}/{folder}")
        now = self.shards(base)
        start = max([s.arrival for s in now], default=0) + 1
        new = [Shard(p, size, start + i, 0, n) for i, (p, size, n) in enumerate(self._written(folder))]
        return self.commit(now + new, base)

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN, growth: int = GROWTH) -> int:
        """One round of merges; returns the version after it, which is the present one if nothing is to merge."""
        base = self.version()
        now = self.shards(base)
        runs = plan(now, target, fan_in, growth)
        if not runs:
            return base
        schema = self.spark.read.parquet(f"{self.root}/{now[0].path}").schema
        # A run is written by its own task: the n-th run's rows go to the n-th partition, for any number of runs.
        folder = f"shards/{uuid.uuid4().hex}"
        number = {s.path: i for i, r in enumerate(runs) for s in r}
        order = {s.path: s.arrival for r in runs for s in r}
        listing = self.spark.createDataFrame([(f, number[f], order[f]) for f in sorted(number)], "_qg_file string, _qg_run int, _qg_arrival long")
        files = [f"{self.root}/{s.path}" for r in runs for s in r]
        rows = self.spark.read.schema(schema).parquet(*files)
        names = [f"_qg_{i}" for i in range(len(schema))]
        rows = rows.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(schema, names, strict=True)), F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"(shards/.*)$", 1).alias("_qg_file"), F.col("_metadata.file_block_start").alias("_qg_block"))
        # The listing is that of the manifest, one short row a shard: few, unless shards are many.
        rows = rows.join(F.broadcast(listing) if len(number) <= BROADCAST_ROWS else listing, "_qg_file").repartitionByRange(len(runs), "_qg_run").sortWithinPartitions("_qg_run", "_qg_arrival", "_qg_block")
        rows = rows.select(*(F.col(n).alias(f.name) for f, n in zip(schema, names, strict=True)), "_qg_run")
        rows.write.option("compression", "zstd").partitionBy("_qg_run").parquet(f"{self.root}/{folder}")
        merged = []
        for p, size, n in self._written(folder):
            r = runs[int(p.split("/_qg_run=")[1].split("/")[0])]
            merged.append(Shard(p, size, min(s.arrival for s in r), 1 + max(s.merges for s in r), n))
        if sum(s.rows for s in merged) != sum(s.rows for r in runs for s in r):
            raise RuntimeError("a merge changed the number of rows; nothing was committed")
        gone = {s.path for r in runs for s in r}
        return self.commit([s for s in now if s.path not in gone] + merged, base)

    def vacuum(self) -> int:
        """Delete shard files that the present version does not list; only when no reader uses an older one."""
        keep = {s.path for s in self.shards()}
        files, n = self.fs.listFiles(self._path("shards"), True), 0
        root = self.fs.makeQualified(self.top).toString().rstrip("/")
        while files.hasNext():
            p = files.next().getPath()
            name = p.toString().split(root + "/")[-1]
            if name.endswith(".parquet") and name not in keep:
                self.fs.delete(p, False)
                n += 1
        return n

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.shards(version)
        if not shards:
            raise FileNotFoundError(f"{self.root} has no shards")
        return self.spark.read.parquet(*(f"{self.root}/{s.path}" for s in shards))
