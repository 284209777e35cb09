"""What becomes of caption files: checked and mended, generated and translated, repositioned. Rows in, rows (name, content) out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comma_list, generated_captions, tag_translation, universal_newlines
from ..operators.quality import counted_and_corrected
from ..operators.reposition import repositioned
from ..sources.files import artifact_name


def quality_check(files: DataFrame, enforce: bool = True, with_video: Column | None = None) -> DataFrame:
    """All columns of files (content) and n_cues, n_long_lines, findings, corrected, name.

    Counts are made where there is a video to hold the captions against, else they are null; unless told by with_video,
    there is one everywhere. With `enforce` captions are cut to two lines. A null content counts as empty.
    """
    seen = F.lit(True) if with_video is None else F.coalesce(with_video, F.lit(False))
    own = files.columns
    found = files.withColumn("content", F.coalesce("content", F.lit("")))
    found = found.select(*own, counted_and_corrected(F.col("content"), enforce).alias("__found"))
    out = found.select(*own, *[F.when(seen, F.col(f"__found.{c}")).alias(c) for c in ("n_cues", "n_long_lines", "findings")], F.col("__found.corrected").alias("corrected"))
    return out.withColumn("name", artifact_name(F.col("corrected"), "corrected"))


def post_fix(files: DataFrame, fix: Callable[[Column], Column] = lambda content: content) -> DataFrame:
    """The last step ahead of the sink: rows (name, content) with content after `fix`, which by default leaves it alone."""
    content = fix(F.col("content"))
    return files.withColumn("content", content).withColumn("name", artifact_name(content, "postfix"))


def generate(videos: DataFrame) -> DataFrame:
    """Rows (media_id, nth, language, name, content) of videos (media_id, language, translate_to).

    The captions in the language of the video come first (nth 0), then their translations in the order of the comma list.
    """
    made = generated_captions(F.col("language"))
    spoken = F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))
    first = F.array(F.struct(spoken.alias("language"), artifact_name(made, "generated", spoken).alias("name"), made.alias("content")))
    more = F.transform(comma_list(F.coalesce("translate_to", F.lit(""))), lambda t: F.struct(t.alias("language"), artifact_name(tag_translation(made, t), "translated", t).alias("name"), tag_translation(made, t).alias("content")))
    return videos.select("media_id", F.posexplode(F.concat(first, more)).alias("nth", "x")).select("media_id", "nth", "x.*")


def reposition_files(files: DataFrame, output: Column | None = None) -> DataFrame:
    """Rows (path, position, name, content) of files (path, video, content), in the format they came in.

    The name is the given output, or follows from the content. Files without a video or a content are left out.
    """
    moved = repositioned(files.filter("video is not null and content is not null"))
    given = F.lit(None).cast("string") if output is None else output
    name = F.concat(F.lit("temp_"), F.substring(F.sha2("moved", 256), 1, 32), F.lit("_repositioned."), F.col("fmt"))
    return moved.select("path", "position", F.coalesce(given, name).alias("name"), F.col("moved").alias("content"))


def uploaded(content: Column) -> Column:
    """A content as it is read: line ends as line feeds."""
    return universal_newlines(F.coalesce(content, F.lit("")))
