"""A client of the engine in one object: requests by job, metadata, descriptions, housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.execute import execute
from gridloom.plans.kernels import describe, discovered
from gridloom.sources.catalog import Catalog, Jobs
from gridloom.sources.tables import removed, shared_folder


class Client:
    """Runs requests against a catalog; results are lazy tables, kept by job until they are dropped or too many came after them."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, masks: dict | None = None, most: int = 128):
        discovered()
        self.spark, self.masks = spark, masks or {}
        self.catalog = catalog or Catalog(shared_folder(spark))
        self.jobs = Jobs(most)

    def execute(self, request: str, run: dict | None = None, load=None) -> str:
        """Plan a request; the id of its job. A request that can't be planned is a failed job."""
        return self.jobs.submit(lambda: execute(request, load or self.catalog.loader(self.spark), self.catalog, self.masks, run))

    def status(self, job: str) -> str:
        return self.jobs.status(job)

    def result(self, job: str) -> dict[str, DataFrame]:
        return self.jobs.result(job)

    def capabilities(self, what: str = "kernels") -> DataFrame:
        return self.catalog.metadata(self.spark, what, self.jobs)

    def describe(self, kernel: str) -> dict:
        return describe(kernel)

    def util(self, command: str) -> str:
        """``clearCache`` drops results and fragments; ``dcol|id``, ``dfrag|id`` and ``dres|job`` drop one (dcol and dfrag with their files)."""
        word, _, name = command.replace(":", "|").partition("|")
        word = word.lower().removeprefix("util.")
        if word == "clearcache":
            self.jobs.clear()
            self.catalog.clear(self.spark, "fragment")
        elif word in ("dcol", "dfrag"):
            self.catalog.drop(name, self.spark)
        elif word == "dres":
            self.jobs.results.pop(name, None)
        else:
            raise ValueError(f"no command {command}")
        return "done"

    def shutdown(self) -> None:
        """Forget all jobs and delete the folders of intermediate tables; the session goes on."""
        self.jobs.clear()
        removed(self.spark)
