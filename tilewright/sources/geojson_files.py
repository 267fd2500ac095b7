"""A Spark data source that writes one GeoJSON array a file, any number of tasks filling the same file at places known before."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.sampling import running_counts

#: Bytes that a task gathers before it writes them.
BUFFER = 1 << 20
COLUMNS = "name string, at long, total long, value string"


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task put into each file, and each file's full length."""

    bytes: dict[str, int] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


class ArrayWriter(DataSourceWriter):
    """Writes (name, at, total, value): ``value`` at byte ``at`` of a file of ``total`` bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].removeprefix("file://")
        # files of this job end so until it is committed
        self.mark = f".{options['job']}.part"

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        done, name, begin, held, size = Written(), None, 0, [], 0

        def put() -> None:
            if held:
                file = os.open(os.path.join(self.folder, name + self.mark), os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    data, at = memoryview(b"".join(held)), begin
                    while data:
                        n = os.pwrite(file, data, at)
                        data, at = data[n:], at + n
                finally:
                    os.close(file)

        for row in iterator:
            raw = row.value.encode()
            if row.name != name or row.at != begin + size or size >= BUFFER:
                put()
                name, begin, held, size = row.name, row.at, [], 0
            held.append(raw)
            size += len(raw)
            done.bytes[name] = done.bytes.get(name, 0) + len(raw)
            done.totals[name] = row.total
        put()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Files that are whole get their names; a task that ran twice has written the same bytes twice."""
        bytes_, totals = {}, {}
        for m in messages:
            for name, n in (m.bytes if m else {}).items():
                bytes_[name] = bytes_.get(name, 0) + n
                totals[name] = m.totals[name]
        short = [name for name, n in bytes_.items() if n != totals[name] or os.path.getsize(os.path.join(self.folder, name + self.mark)) != n]
        if short:
            self.abort(messages)
            raise RuntimeError(f"files are not whole: {sorted(short)[:5]}")
        for name in bytes_:
            os.replace(os.path.join(self.folder, name + self.mark), os.path.join(self.folder, name))

    def abort(self, messages: list[Written | None]) -> None:
        for path in glob.glob(os.path.join(glob.escape(self.folder), "*" + glob.escape(self.mark))):
            os.remove(path)


class ArraySource(DataSource):
    """``df.write.format("geojson_array")``."""

    @classmethod
    def name(cls) -> str:
        return "geojson_array"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options)


def file_name(stem: Column, tag: str, threshold: float) -> Column:
    """``{stem}-{tag}-thresh-{threshold}.json``."""
    return F.concat(stem.cast("string"), F.lit(f"-{tag}-thresh-{threshold}.json"))


def placed(features: DataFrame, name: Column, order: list[Column], column: str = "feature") -> DataFrame:
    """(name, at, total, value): the text of each feature with what stands around it, and its place in its file.

    The first has ``[`` before it, each has a comma after it, the last ``]``.
    """
    rows = features.select(name.alias("name"), F.col(column).alias("value"), *[o.alias(f"by{k}") for k, o in enumerate(order)])
    counted = running_counts(rows, ["name"], [F.col(f"by{k}") for k in range(len(order))], {"k": F.lit(1), "end": F.octet_length("value") + 1})
    first, last = F.col("k") == 1, F.col("k") == F.col("total_k")
    text = F.concat(F.when(first, "[").otherwise(""), "value", F.when(last, "]").otherwise(","))
    at = F.when(first, F.lit(0)).otherwise(F.col("end") - F.octet_length("value"))
    return counted.select("name", at.cast("long").alias("at"), (F.col("total_end") + 1).alias("total"), text.alias("value"))


def write_geojson_arrays(features: DataFrame, folder: str, tag: str = "detections", threshold: float = 0.5, stem: str = "image_id", order: tuple[str, ...] = ("feature",), column: str = "feature") -> None:
    """One file of a JSON array for each image in ``folder``, which all executors mount, named by :func:`file_name`.

    ``order`` gives the order of features, ties by their text. Running lengths
    say where each feature stands in its file, so any number of tasks fill one
    file and none holds an image. Files get their names when all are whole; a
    lost task is run again and writes the same bytes, and a job that fails leaves
    nothing. Null features are left out.
    """
    spark = features.sparkSession
    spark.dataSource.register(ArraySource)
    rows = placed(features.where(F.col(column).isNotNull()), file_name(F.col(stem), tag, threshold), [*[F.col(c) for c in order], F.col(column)], column)
    rows.sortWithinPartitions("name", "at").write.format("geojson_array").option("job", uuid.uuid4().hex).mode("append").save(folder)
