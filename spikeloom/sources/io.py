"""Reading recordings and stimuli, writing sorted results."""

from __future__ import annotations

import io as bytes_io
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.operators.held import held

SPIKES = "recording_id string, spike_id long, time double, waveform array<double>, label int"
STIMULI = "recording_id string, category string, stim_id long, start_time double"


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Parquet folders by recording; only the declared columns are read."""
    return spark.read.schema(SPIKES).parquet(path)


#: Name of an array file: the recording, quoted, and the row of the recording that it starts at.
PART = re.compile(r"^(.*?)(?:\.(\d+))?\.npy$")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """NumPy array files, one recording each or one part of it (named by its first row, as write_arrays
    does): (recording_id, row, values). Nothing is unpickled."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch[["path", "content"]].itertuples(index=False):
                x = np.load(bytes_io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1).astype("float64")
                recording, first = PART.match(unquote(name.rsplit("/", 1)[-1])).groups()
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    yield pd.DataFrame({"recording_id": unquote(recording), "row": np.arange(at, at + len(part)) + int(first or 0), "values": list(part)})

    return files.mapInPandas(load, "recording_id string, row long, values array<double>")


def write_arrays(spikes: DataFrame, path: str, values: str = "waveform", rows: int = 65_536) -> DataFrame:
    """NumPy array files of a vector column, in the order of spike_id, `rows` spikes of a recording at
    most in each. Returns (recording_id, first, n) of the files, once they are written; a task that
    runs again writes the same file."""

    def save(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("spike_id", kind="stable")
        system, root = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        system.create_dir(root)
        recording, first = g["recording_id"].iat[0], int(g["spike_id"].iat[0])
        content = bytes_io.BytesIO()
        np.save(content, np.stack(g[values].to_numpy()), allow_pickle=False)
        with system.open_output_stream(f"{root}/{quote(recording, safe='')}.{first:012d}.npy") as out:
            out.write(content.getvalue())
        return pd.DataFrame({"recording_id": [recording], "first": [first], "n": [len(g)]})

    dealt = spikes.select("recording_id", "spike_id", values).withColumn("_file", F.floor(F.col("spike_id") / rows))
    return held(dealt.groupBy("recording_id", "_file").applyInPandas(save, "recording_id string, first long, n long"))


def _numbered(stimuli: DataFrame) -> DataFrame:
    """Stimuli with an id: their place in time, from 0, in the recording and category."""
    order = Window.partitionBy("recording_id", "category").orderBy("start_time")
    return stimuli.withColumn("stim_id", (F.row_number().over(order) - 1).cast("long")).select("recording_id", "category", "stim_id", "start_time")


def read_stimulus_csv(spark: SparkSession, path: str, recording_id: str = "recording") -> DataFrame:
    """Start times from CSV: all playback, as STIMULI."""
    rows = spark.read.schema("start_time double").option("header", True).option("enforceSchema", False).csv(path)
    return _numbered(rows.select(F.lit(recording_id).alias("recording_id"), F.lit("playback").alias("category"), "start_time"))


def stimuli_of_records(records: DataFrame) -> DataFrame:
    """STIMULI from nested records (recording_id, playback and live: arrays of structs with start_time)."""
    one = lambda c: records.select("recording_id", F.lit(c).alias("category"), F.inline(c)).select("recording_id", "category", "start_time")
    return _numbered(one("playback").unionByName(one("live")))


def write_sorted(spikes: DataFrame, path: str) -> None:
    """Results by recording; a rewrite replaces only the recordings it holds."""
    spikes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(path)
