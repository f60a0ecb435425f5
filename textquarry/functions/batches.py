"""Arrow batches of bounded size: Spark fills them by rows, 10,000 unless told otherwise, whatever the rows hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that goes to a Python task. Smaller settings of the session stay.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Bytes of a part that is turned into Python objects at once; these take several times as much.
PART = 1 << 20


def limit(spark: SparkSession) -> None:
    """Lowers the session's batch limits to LIMITS, which changes no result."""
    for name, most in LIMITS.items():
        now = spark.conf.get(name, None)
        now = int(now) if now and now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def parts(batches: Iterable[pa.RecordBatch], most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in parts of ``most`` bytes or of a single row."""
    for b in batches:
        todo = [b]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > most:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
            else:
                yield x
