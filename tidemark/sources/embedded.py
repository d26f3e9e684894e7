"""Read-only Derby databases in the shared folder, made by the tasks that hold the rows, which any process may read at once.

A Derby database that is written to belongs to one process, and a cluster's executors are several. Here each task fills a database
of its own from its rows, by Derby's own command line tool, and leaves it as an archive; archives need no lock.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..storage import new_path

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_TYPES = {"long": "BIGINT", "integer": "INT", "double": "DOUBLE", "string": "VARCHAR(32672)"}


def _command(spark: SparkSession) -> list[str]:
    """Derby's tool in the Java that runs Spark; an executor has both at the driver's paths."""
    jvm = spark._jvm
    jars = [jvm.java.lang.Class.forName(c).getProtectionDomain().getCodeSource().getLocation().getPath() for c in (DRIVER, "org.apache.derby.shared.common.error.StandardException", "org.apache.derby.tools.ij")]
    return [f"{jvm.System.getProperty('java.home')}/bin/java", "-Xmx256m", "-cp", os.pathsep.join(dict.fromkeys(jars)), "org.apache.derby.tools.ij"]


def write_databases(df: DataFrame, name: str, parts: int = 4) -> list[str]:
    """URLs of ``parts`` databases (none for an empty ``df``) whose table ``name`` has a share of the rows each."""
    unknown = [f.name for f in df.schema if f.dataType.typeName() not in _TYPES]
    if unknown:
        raise ValueError(f"no Derby type for {unknown}")
    command, folder = _command(df.sparkSession), new_path(df.sparkSession, "databases").removeprefix("file://")
    columns = ", ".join(f'"{f.name}" {_TYPES[f.dataType.typeName()]}' for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own:
            own = os.path.realpath(own)
            lines, rows = f"{own}/rows.csv", 0
            with open(lines, "wb") as sink:
                for batch in batches:  # NULLs stay bare, so that they aren't empty strings
                    pyarrow.csv.write_csv(batch, sink, pyarrow.csv.WriteOptions(include_header=False, quoting_style="all_valid"))
                    rows += batch.num_rows
            load = f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{lines}', NULL, NULL, 'UTF-8', 0);\n" if rows else ""
            script = f"CONNECT 'jdbc:derby:{own}/db;create=true';\nCREATE TABLE {name} ({columns});\n{load}SELECT 'rows', count(*) FROM {name};\nCONNECT 'jdbc:derby:{own}/db;shutdown=true';\nEXIT;\n"
            said = subprocess.run(command, input=script, cwd=own, capture_output=True, text=True, check=False).stdout
            if f"rows|{rows}" not in said.replace(" ", ""):
                raise RuntimeError(f"Derby did not take {rows} rows: {said[-2000:]}")
            os.makedirs(folder, exist_ok=True)
            context = TaskContext.get()
            path = f"{folder}/{context.partitionId()}-{context.attemptNumber()}.jar"
            with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:  # pages are sought in it
                for at, _, files in os.walk(f"{own}/db"):
                    for file in files:
                        archive.write(f"{at}/{file}", os.path.relpath(f"{at}/{file}", own))
        yield pa.RecordBatch.from_pydict({"url": [f"jdbc:derby:jar:({path})db"]})

    return sorted(r["url"] for r in df.repartition(parts).mapInArrow(run, "url string").collect())
