"""The register of repositories: a log of changes, and what it says now.

Changes are appended and never rewritten; the state of a repository is the last value of each field.
So a job's stages, its failure and a registration never wait for one another.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodestar.functions import text as T

FIELDS = ("owner", "name", "url", "status", "stage", "error", "commit_sha", "stats")
LOG = "repo string, at bigint, " + ", ".join(f"{f} string" for f in FIELDS)


def replayed(log: DataFrame) -> DataFrame:
    """One row a repository: the last value of each field of its changes (repo, at, FIELDS); null leaves a field as it is, an empty text clears it."""
    last = [F.nullif(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))), F.lit("")).alias(f) for f in FIELDS]
    return log.groupBy("repo").agg(*last, F.max("at").alias("updated_at"))


class Register:
    """Repositories of a folder that all jobs share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/status"
        self._last = 0

    def log(self) -> DataFrame:
        """All changes."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part-*")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(self.folder)

    def note(self, repo: str, **fields: str) -> None:
        """Appends a change; fields not given stay as they are."""
        self._last = max(self._last + 1, time.time_ns() // 1_000)
        row = (repo, self._last, *(fields.pop(f, None) for f in FIELDS))
        if fields:
            raise ValueError(f"no fields {sorted(fields)}")
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(self.folder)

    def all(self) -> DataFrame:
        """The state of every repository, in order of their ids."""
        return replayed(self.log()).orderBy("repo")

    def get(self, repo: str) -> dict | None:
        """The state of one repository, with its stats as a dict; None if it is unknown."""
        row = replayed(self.log().where(F.col("repo") == repo)).first()
        return {**row.asDict(), "stats": json.loads(row["stats"]) if row["stats"] else {}} if row else None

    def register(self, url: str) -> str:
        """Queues the repository of an address and gives its id: its name, or owner and name if another owner has that."""
        found = self.spark.range(1).select(*T.repo_parts(F.lit(url))).first()
        owner, name = found[0], found[1]
        if not owner or not name:
            raise ValueError(f"no repository address: {url!r}")
        repo = name.lower()
        held = self.get(repo)
        if held and (held["owner"] or "").lower() != owner.lower():
            repo = f"{owner}-{name}".lower()
        self.note(repo, owner=owner, name=name, url=f"https://github.com/{owner}/{name}", status="queued", stage="Queued", error="")
        return repo

    def ready(self, repo: str) -> bool:
        """Whether a repository can be searched: it was indexed once, even if it is being indexed again."""
        held = self.get(repo)
        return bool(held and held["stats"])

    def recover(self) -> list[str]:
        """After a restart: what was queued or under way has failed. Gives the repositories concerned."""
        lost = [r["repo"] for r in self.all().where(F.col("status").isin("queued", "ingesting")).select("repo").collect()]
        for repo in lost:
            self.note(repo, status="failed", error="interrupted")
        return lost


class StageListener(StreamingQueryListener):
    """Writes the batches of streaming queries into the register, as stages of the repository that a query is named after."""

    def __init__(self, register: Register):
        self.register = register

    def onQueryStarted(self, event) -> None:
        if event.name:
            self.register.note(event.name, status="ingesting", stage="Started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name and p.numInputRows:
            self.register.note(p.name, stage=f"Batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
