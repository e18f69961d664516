"""A change to many records in pages: planned, approved by the fingerprint of its report, applied page by page.

A plan has one row per record: record_id, source, code_system, status (``already_normalized``, ``resolvable``, ``unresolved``,
``conflict``, ``invalid_coordinate``), and the new values in a column ``change`` (null: nothing to write). ``approve``
stores the plan in pages of the order of record_id, beside the fingerprint of its report; ``apply`` writes each page and
its line in the control table as one commit. So a run that stops goes on with the next page, a page
is never half applied, and what was approved is what is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import CommittedTables
from .measures import fingerprint

STATUSES = ("already_normalized", "resolvable", "unresolved", "conflict", "invalid_coordinate")


def report(plan: DataFrame) -> DataFrame:
    """Counts by source, by code system, and of all records, by status: dimension, value, status, records, writes. One pass."""
    sets = plan.groupingSets([["source", "status"], ["code_system", "status"], ["status"]], "source", "code_system", "status")
    counted = sets.agg(F.count("*").alias("records"), F.count("change").alias("writes"), F.grouping("source").alias("s"), F.grouping("code_system").alias("c"))
    dimension = F.when(F.col("s") == 0, "source").when(F.col("c") == 0, "code_system").otherwise("all")
    return counted.select(dimension.alias("dimension"), F.when(F.col("s") == 0, F.col("source")).when(F.col("c") == 0, F.col("code_system")).alias("value"), "status", "records", "writes")


def approval(plan: DataFrame) -> str:
    """What an operator approves: a hash of the report and of every planned change, in whatever order they come."""
    parts = [fingerprint(t, *t.columns).first()["fingerprint"] for t in (report(plan), plan.select("record_id", "status", F.to_json(F.struct("change")).alias("change")))]
    return "-".join(parts)


def jobs(previous: str | None, current: str, lanes: list[str]) -> list[tuple[str, str]]:
    """(lane, revision) of each lane, sorted and once, if the revision changed; else none."""
    return [] if previous == current else [(lane, current) for lane in sorted(set(lanes))]


class PagedChange:
    """One job over a store: its plan, pages and control table."""

    def __init__(self, store: CommittedTables, job: str, target: str):
        self.store, self.job, self.target = store, job, target

    def approve(self, plan: DataFrame, approved: str, pages: int) -> None:
        """Stores the plan; refused where it is not the one that was approved, or where records are unnamed. Once only."""
        if self.store.committed(f"{self.job}:plan"):
            return
        if approval(plan) != approved:
            raise ValueError("the plan drifted from the approved one")
        if not plan.where("record_id is null").isEmpty():
            raise ValueError("the plan is incomplete: records without an id")
        paged = plan.where("change is not null").repartitionByRange(pages, "record_id").withColumn("page", F.spark_partition_id())
        self.store.commit(f"{self.job}:plan", {f"plan-{self.job}": paged})

    def apply(self, most_pages: int | None = None) -> int:
        """Applies the pages that are not yet applied, in order; how many that were."""
        plan = self.store.read(f"plan-{self.job}")
        if plan is None:
            raise ValueError("no approved plan")
        done = 0
        for page in sorted(r["page"] for r in plan.select("page").distinct().collect()):
            if most_pages is not None and done == most_pages:
                break
            rows = plan.where(F.col("page") == page)
            control = rows.groupBy("page").agg(F.max("record_id").alias("cursor"), F.count("*").alias("writes")).withColumn("job", F.lit(self.job))
            done += self.store.commit(f"{self.job}:{page}", {self.target: rows.select("record_id", "change.*"), "control": control})
        return done

    def progress(self) -> DataFrame | None:
        """The control table's lines of this job: page, cursor, writes."""
        control = self.store.read("control")
        return None if control is None else control.where(F.col("job") == self.job).select("page", "cursor", "writes")
