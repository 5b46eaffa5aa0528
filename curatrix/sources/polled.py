"""A stream of polled lists: a service's answers, kept as files of one folder, read one after the other with an offset that survives restarts.

    spark.dataSource.register(PolledLists)
    spark.readStream.format("polled_lists").option("path", folder).load()

Whoever polls the service writes each answer under a name that sorts behind all earlier ones (a time or a padded number), complete, by renaming it into
place.  The offset is the last name read, so an answer is read once, also after a restart from the same checkpoint; files that appear behind the offset's
name late are never read.  An answer that is no JSON has a row with its text; the Columns below give no rows for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from curatrix.packing import ship
from curatrix.sources.store import opened


@dataclass
class Answer(InputPartition):
    name: str


class PolledLists(DataSource):
    """Options: path, suffix, most (answers of a batch; all if 0)."""

    @classmethod
    def name(cls) -> str:
        return "polled_lists"

    def schema(self) -> str:
        return "poll string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return PolledReader(self.options)


class PolledReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix, self.most = options["path"], options.get("suffix", ".json"), int(options.get("most", 0))
        self.after = ""

    def _names(self) -> list[str]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        new = [n for n in self._names() if n > self.after]
        if new:
            self.after = new[min(len(new), self.most or len(new)) - 1]
        return {"after": self.after}

    def partitions(self, start: dict, end: dict) -> list[Answer]:
        self.after = max(self.after, end["after"])
        return [Answer(n) for n in self._names() if start["after"] < n <= end["after"]]

    def read(self, partition: Answer) -> Iterator[tuple]:
        store, root = opened(self.path)
        with store.open_input_stream(f"{root}/{partition.name}") as f:
            yield partition.name, f.read().decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


def polled(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """poll and value of the answers that appear in a folder."""
    ship(spark)
    spark.dataSource.register(PolledLists)
    return spark.readStream.format("polled_lists").option("path", path).option("most", most).load()


def algorithms(answers: DataFrame) -> DataFrame:
    """poll, pos, id, name and fields (JSON) of lists of algorithms: entries that are no objects or have no id are left out; the id stands for a missing name."""
    rows = answers.select("poll", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw"))
    field = lambda name: F.get_json_object("raw", f"$.{name}")
    named = rows.select("poll", "pos", F.coalesce(field("render_id"), F.lit("")).alias("id"), field("name").alias("name"), F.coalesce(F.nullif(field("algorithm_fields"), F.lit("null")), F.lit("[]")).alias("fields"))
    return named.filter("id <> ''").withColumn("name", F.coalesce("name", "id"))


def job_state(value: Column) -> Column:
    """The state that a status answer tells: done, failed (the service says so, or the job does) or what it says, else ''."""
    success, status = F.get_json_object(value, "$.success"), F.coalesce(F.get_json_object(value, "$.status"), F.lit(""))
    return F.when(~F.coalesce(success, F.lit("false")).isin("true", "1"), "failed").otherwise(status)
