"""The batch job: recordings are read, sorted all at once, and written beside each other.

python -m spikeloom.jobs.sort_files SOURCE TARGET
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from spikeloom.jobs import sorting
from spikeloom.operators.held import held
from spikeloom.operators.model import spike_table
from spikeloom.sources import io


def run(spark: SparkSession, source: str, target: str, step: int | None = None) -> DataFrame:
    """Sorts the recordings in a Parquet folder (io.SPIKES) into another, and returns what was written."""
    spikes = spike_table(io.read_spikes(spark, source).drop("label"), "spike_id")
    io.write_sorted(sorting.sort(spikes.transform(held), step), target)
    return spark.read.parquet(target)


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("sort-files").getOrCreate()
    if named := spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(named)
    run(spark, *arguments)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
