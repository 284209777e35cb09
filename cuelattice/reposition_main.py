"""For spark-submit: move the captions of a file, or of a folder of files, away from text in the picture."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.files import reposition_files
from .settings import read_settings
from .sources.files import read_captions, write_artifacts


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Write the moved captions and return the folder they are in."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--video", required=True, help="name of the video; what it says of text in the picture counts")
    parser.add_argument("--subs", required=True, help="a caption file, or a folder of them")
    parser.add_argument("--out", help="name of the result; else one that follows from its content")
    parser.add_argument("--processed-dir", default=read_settings().processed_dir, help="folder of the results")
    parser.add_argument("--sample-rate", type=float, default=1.0, help="frames a second to look at, once there is a reader of frames")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    files = read_captions(spark, given.subs).withColumn("video", F.lit(given.video))
    moved = reposition_files(files, F.lit(given.out) if given.out else None)
    write_artifacts(moved.select("name", "content"), given.processed_dir)
    return given.processed_dir


if __name__ == "__main__":
    print(main())
