"""One commit over many tables: folders are written first, a manifest last, by a rename.

Below ``root`` a table's folder holds one folder of Parquet files per commit; ``_commits`` holds numbered manifests
that name them. A reader sees the folders that manifests name, so that a writer that dies between two tables
changes nothing, and a batch that was committed is not written again. Of two writers one
gets a number and the other takes the next. Tables are logs of upserts: ``current`` folds them by the rules of
``operators.upsert``, in the order of commits; ``compact`` replaces the logs by what they fold to. A log of one commit
that holds every key once is read as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import RULES

_NUMBER = "%012d.json"


class CommittedTables:
    """The tables below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).getFileSystem(conf).getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._written: list[tuple[str, str, DataFrame]] = []

    def manifests(self) -> list[dict]:
        """Those that count, oldest first: a compaction hides what was before it."""
        folder = self._path(f"{self.root}/_commits")
        if not self._files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._files.listStatus(folder) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))
        if not names:
            return []
        found = sorted((json.loads(self._text(f"{self.root}/_commits/{n}")) for n in names), key=lambda m: m["number"])
        first = max((i for i, m in enumerate(found) if m.get("compacted")), default=0)
        hidden = [b for m in found[:first] for b in m["batches"]]
        for m in found[first : first + 1]:
            m["batches"] = hidden + m["batches"]
        return found[first:]

    def _text(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def committed(self, batch: str) -> bool:
        return any(batch in m["batches"] for m in self.manifests())

    def commit(self, batch: str, tables: Mapping[str, DataFrame], compacted: bool = False, keys: Mapping[str, Sequence[str]] | None = None) -> bool:
        """Writes rows of several tables as one; False if the batch is there already. Each table is a job of its own, so
        what several are made from should be a written table (``write``). keys: the key columns of tables that hold
        every key once because of how they were made; that is not checked."""
        if self.committed(batch):
            return False
        folders = {}
        for name, rows in tables.items():
            found = [w for w in self._written if w[0] == name and w[2] is rows]
            self._written = [w for w in self._written if w not in found]  # a folder belongs to one commit
            folders[name] = found[0][1] if found else self._write(name, rows)
        while True:
            known = self.manifests()
            if any(batch in m["batches"] for m in known):
                return False
            number = known[-1]["number"] + 1 if known else 0
            if self._publish({"number": number, "batches": [batch], "tables": folders, "compacted": compacted, "keys": {n: sorted(k) for n, k in (keys or {}).items() if n in folders}}):
                return True

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"commit-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as a written table that no reader sees. A commit of this result as the table ``name`` takes over its folder."""
        folder = self._write(name, rows)
        found = self.spark.read.parquet(f"{self.root}/{name}/{folder}")
        self._written.append((name, folder, found))
        return found

    def _publish(self, manifest: dict) -> bool:
        """The step that counts: the whole manifest appears under its number, or another one has it."""
        path, target = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_commits/{_NUMBER % manifest['number']}")
        out = self._files.create(path)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        try:
            self._context.rename(path, target, self._no_overwrite)
        except Exception as error:
            self._files.delete(path, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def read(self, name: str) -> DataFrame | None:
        """All committed rows of a table with ``__commit``, the number of their commit; None if there are none."""
        return self._log(name, self.manifests())

    def _log(self, name: str, manifests: Sequence[dict]) -> DataFrame | None:
        numbers = {m["tables"][name]: m["number"] for m in manifests if name in m["tables"]}
        if not numbers:
            return None
        found = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{name}/{folder}" for folder in numbers])
        folder = F.regexp_extract("_metadata.file_path", r"/(commit-[0-9a-f]+)/", 1)
        order = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
        return found.withColumn("__commit", F.element_at(order, folder).cast("long"))

    def current(self, name: str, keys: Sequence[str], rules: Mapping[str, str]) -> DataFrame | None:
        """What the log folds to, by the rules of the columns that it has; None if there is none."""
        manifests = [m for m in self.manifests() if name in m["tables"]]
        rows = self._log(name, manifests)
        if rows is None:
            return None
        rules = {c: r for c, r in rules.items() if c in rows.columns}
        once = all(m.get("keys", {}).get(name) == sorted(keys) for m in manifests)
        return alone(rows, keys, rules) if once and len(manifests) == 1 else folded(rows, keys, rules, once=once)

    def compact(self, batch: str, tables: Mapping[str, tuple[Sequence[str], Mapping[str, str]]]) -> bool:
        """Folds all tables into one commit that hides the earlier ones; their folders can be removed later."""
        rows = {name: now for name, (keys, rules) in tables.items() if (now := self.current(name, keys, rules)) is not None}
        return self.commit(batch, rows, compacted=True, keys={name: keys for name, (keys, _) in tables.items()})


def _check(rules: Mapping[str, str]) -> None:
    unknown = set(rules.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")


def alone(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """What ``folded`` gives where no key has a second row: nothing is moved."""
    _check(rules)

    def value(c: str, rule: str) -> Column:
        if rule == "match":
            return F.lit(None).cast(rows.schema[c].dataType)
        return F.array_distinct(F.coalesce(c, F.array().cast(rows.schema[c].dataType))) if rule == "append_distinct" else F.col(c)

    return rows.select(*keys, *[value(c, r).alias(c) for c, r in rules.items()])


def folded(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: str = "__commit", once: bool = False) -> DataFrame:
    """What upserts one after another give: one row per key. Several rows of a key in one commit are taken in the
    order of their values, so that the result is the same on every run. once: no commit has a key twice, so that grouping
    before the shuffle would join next to nothing and is left out."""
    _check(rules)
    turn = F.col(order)

    def value(c: str, rule: str) -> Column:
        held = F.struct(turn.alias("t"), F.col(c).alias("v"))
        if rule == "create":
            return F.min(held)["v"]
        if rule in ("always", "match"):
            latest = F.max(held)["v"]
            return latest if rule == "always" else F.when(F.count("*") > 1, latest)
        if rule == "coalesce":
            return F.max(F.when(F.col(c).isNotNull(), held))["v"]
        if rule in ("max", "min"):
            return (F.max if rule == "max" else F.min)(c)
        lists = F.array_sort(F.collect_list(F.struct(turn.alias("t"), F.col(c).alias("v"))))
        return F.array_distinct(F.flatten(F.filter(F.transform(lists, lambda x: x["v"]), lambda v: v.isNotNull())))

    if not rules:
        return rows.select(*keys).distinct()
    # Keys often begin alike; with a hash before them the sort of the grouping seldom compares them whole.
    rows = rows.withColumn("__hash", F.xxhash64(*keys))
    rows = rows.repartition("__hash") if once else rows
    return rows.groupBy("__hash", *keys).agg(*[value(c, r).alias(c) for c, r in rules.items()]).drop("__hash")
