"""Moving captions to the top or bottom, where the picture holds text already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, blocks, is_timing, lines, reposition_format, strip, universal_newlines


def text_in_picture(name: Column) -> Column:
    """struct<bottom, top>, from the name of a video: a stand-in for reading its frames."""
    n = F.lower(name)
    top, bottom = F.contains(n, F.lit("top")), F.contains(n, F.lit("bottom"))
    return F.struct((~top | bottom).alias("bottom"), top.alias("top"))


def caption_position(found: Column) -> Column:
    """Away from the text in the picture; at the top if it is at both ends or nowhere."""
    return F.when(found["top"] & ~found["bottom"], "bottom").otherwise("top")


def reposition_srt(content: Column, position: Column) -> Column:
    note = F.array(F.concat(F.lit("NOTE: position="), position))

    def moved(p: Column) -> Column:
        number = F.get(p, F.lit(0)).rlike(rf"(?U)^\d+{SPACE.removeprefix('(?U)')}*$")
        timed = is_timing(F.coalesce(F.get(p, F.lit(1)), F.lit("")))
        head = F.when(~number, 0).when(timed, 2).otherwise(1)
        return F.array_join(F.concat(F.slice(p, F.lit(1), head), note, F.slice(p, head + 1, F.size(p))), "\n")

    parts = F.filter(F.transform(blocks(content), lines), lambda p: F.size(p) > 0)
    return F.concat(F.array_join(F.transform(parts, moved), "\n\n"), F.lit("\n"))


def _last_newline(content: Column) -> Column:
    """A final line feed is put out only where the text had none."""
    return F.when(F.endswith(content, F.lit("\n")), "").otherwise("\n")


def reposition_vtt(content: Column, position: Column) -> Column:
    setting = F.concat(F.lit("line:"), F.when(position == "top", "0").otherwise("90"))

    def moved(x: Column) -> Column:
        known = F.contains(x, F.lit("line:"))
        return F.when(~is_timing(x), x).when(known, F.regexp_replace(x, F.lit(r"(?U)line:\s*\d+"), setting)).otherwise(F.concat(strip(x), F.lit(" "), setting))

    return F.concat(F.array_join(F.transform(lines(content), moved), "\n"), _last_newline(content))


def reposition_ass(content: Column, position: Column) -> Column:
    """The alignment of the default style, in a styles section; where there is none to change, a note at the end."""
    code = F.when(position == "top", "8").otherwise("2")
    flag = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        bare = F.lower(strip(x))
        opens = bare.isin("[v4+ styles]", "[v4 styles]")
        closes = acc["inside"] & F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]")) & ~opens
        style = acc["inside"] & ~closes & x.rlike(r"(?i)^style:\s*default[,;]")
        fields = F.split(F.regexp_extract(x, "(?s)^[^:]*: (.*)$", 1), ",", -1)
        named = style & F.contains(x, F.lit("Alignment="))
        listed = style & ~named & (F.size(fields) >= 10) & F.contains(x, F.lit(": "))
        ninth = F.concat(F.slice(fields, 1, 8), F.array(code), F.slice(fields, 10, F.greatest(F.size(fields), F.lit(1))))
        renamed = F.when(F.lower(F.get(fields, F.lit(0))) == "default", F.concat(F.lit("Style: Default,"), F.array_join(F.slice(ninth, 2, F.greatest(F.size(ninth), F.lit(1))), ","))).otherwise(F.concat(F.lit("Style: "), F.array_join(ninth, ",")))
        line = F.when(named, F.regexp_replace(x, F.lit(r"Alignment=\d+"), F.concat(F.lit("Alignment="), code))).when(listed, renamed).otherwise(x)
        return F.struct((opens | (acc["inside"] & ~closes)).alias("inside"), (acc["done"] | named | listed).alias("done"), F.concat(acc["out"], F.array(line)).alias("out"))

    def end(acc: Column) -> Column:
        note = F.array(F.concat(F.lit("; NOTE: desired_alignment="), code, F.lit(" (top=8,bottom=2)")))
        return F.array_join(F.when(acc["done"], acc["out"]).otherwise(F.concat(acc["out"], note)), "\n")

    return F.concat(F.aggregate(lines(content), flag, step, end), _last_newline(content))


def repositioned(files: DataFrame, position: Column | None = None) -> DataFrame:
    """All columns of files (path, video, content) and fmt, position, moved. The position follows from the video's name."""
    position = position if position is not None else caption_position(text_in_picture(F.col("video")))
    rows = files.withColumn("fmt", reposition_format(F.col("path"))).withColumn("position", position)
    c, p = universal_newlines(F.col("content")), F.col("position")
    moved = F.when(F.col("fmt") == "vtt", reposition_vtt(c, p)).when(F.col("fmt").isin("ass", "ssa"), reposition_ass(c, p)).otherwise(reposition_srt(c, p))
    return rows.withColumn("moved", moved)
