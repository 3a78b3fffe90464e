"""Frame image listings and the guid -> media path dimension files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.operators.frames import frame_file_name, parse_frame_name
from credline.schemas import PATH_DIM
from credline.session import ship_package


def write_frames(frames: DataFrame, folder: str) -> int:
    """Frame images (guid, frame_num, content) as one ``<guid>.<frame>.png`` file each in a folder
    of any file system Arrow knows. Rows without content write nothing; a repeated task
    writes the same files again. Returns the number of files."""
    uri = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def run(batches):
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with files.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    ship_package(frames.sparkSession)
    named = frames.filter(F.col("content").isNotNull()).select(frame_file_name("guid", "frame_num").alias("name"), "content")
    return named.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def list_frames(spark: SparkSession, image_dir: str, with_content: bool = False) -> DataFrame:
    """Frame files ``<guid>.<frame>[...].png`` of a folder: guid, frame_num, path, length (and
    content when asked; otherwise the bytes are pruned from the scan)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.png")
          .option("recursiveFileLookup", "false").load(image_dir))
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    guid, frame = parse_frame_name(name)
    cols = [guid.alias("guid"), frame.alias("frame_num"), F.col("path"), F.col("length")]
    if with_content:
        cols.append(F.col("content"))
    return df.select(*cols)


def read_path_dim(spark: SparkSession, glob: str) -> DataFrame:
    """All ``*paths.csv`` files (guid, path). ``file_ord`` orders the rows by file, then by
    place in the file, so a later file overrides an earlier one and a later row an earlier
    one of its file."""
    return (spark.read.option("header", "true").schema(PATH_DIM).csv(glob)
            .select("guid", "path", F.struct(
                F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row")).alias("file_ord")))
