"""Checks of caption files: structure, lines per caption, characters per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ODD_LINE_END, blocks, capped, clean_lines, is_timing, let, lines, parsed_blocks, strip, two_line_cap


def _head_ok(parts: Column, least: int) -> Column:
    return (F.size(parts) >= least) & (is_timing(F.get(parts, F.lit(0))) | is_timing(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))


def _text_lines(parts: Column) -> Column:
    return F.filter(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda x: strip(x) != "")


def _issues(parts: Column, number: Column, max_chars: int, max_lines: int) -> Column:
    """Issues of one block in the order of the rules."""
    block = F.concat(F.lit("Block "), number.cast("string"))
    nothing = F.array().cast("array<string>")

    def found(texts: Column) -> Column:
        none = F.when(F.size(texts) == 0, F.array(F.concat(block, F.lit(" has no text.")))).otherwise(nothing)
        many = F.when(F.size(texts) > max_lines, F.array(F.concat(block, F.lit(" exceeds max lines ("), F.size(texts).cast("string"), F.lit(f" > {max_lines}).")))).otherwise(nothing)
        long = F.transform(F.filter(texts, lambda x: F.length(x) > max_chars), lambda x: F.concat(block, F.lit(" line exceeds max chars ("), F.length(x).cast("string"), F.lit(f" > {max_chars}).")))
        return F.concat(none, many, long)

    return F.when(_head_ok(parts, 2), let(_text_lines(parts), found)).otherwise(F.array(F.concat(block, F.lit(" has invalid header/timing."))))


def validate(files: DataFrame, max_chars: int = 42, max_lines: int = 2) -> DataFrame:
    """All columns of files (content) and issues array<string>, valid boolean. Row by row; nothing is shuffled."""
    issues = F.flatten(F.transform(parsed_blocks(F.col("content")), lambda x, i: _issues(x["parts"], i + 1, max_chars, max_lines)))
    return files.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def timing_rules(cues: DataFrame, least: float | None = None, most: float | None = None, most_cps: float | None = None) -> DataFrame:
    """Extension: cues (start_s, end_s, text) that are too short, too long or too fast to read; rules that aren't given are off."""
    length = F.col("end_s") - F.col("start_s")
    rules = []
    if least is not None:
        rules.append(F.when(length < least, "too short"))
    if most is not None:
        rules.append(F.when(length > most, "too long"))
    if most_cps is not None:
        rules.append(F.when(F.length("text") > most_cps * length, "too fast"))
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return cues.withColumn("rule_breaks", found)


def _counted(cues: Column) -> Column:
    """struct<n_cues, n_long_lines, findings> of the lines of each cue."""
    finding = lambda x: F.concat(F.lit("Long line ("), F.length(x).cast("string"), F.lit(" chars): "), F.substring(x, 1, 60), F.lit("..."))
    long = F.filter(F.flatten(F.transform(cues, lambda p: F.slice(p, 3, F.greatest(F.size(p), F.lit(1))))), lambda x: (F.length(x) > 42) & (strip(x) != ""))
    return let(long, lambda x: F.struct(F.size(cues).cast("long").alias("n_cues"), F.size(x).cast("long").alias("n_long_lines"), F.transform(F.slice(x, 1, 5), finding).alias("findings")))


def _cues(parsed: Column) -> Column:
    return F.transform(F.filter(parsed, lambda x: _head_ok(x["parts"], 3)), lambda x: x["parts"])


def counters(files: DataFrame) -> DataFrame:
    """n_cues, n_long_lines and up to five findings of each file, as the sync summary has them."""
    found = files.select(*files.columns, let(_cues(parsed_blocks(clean_lines(F.col("content")))), _counted).alias("__found"))
    return found.select(*files.columns, "__found.*")


def counted_and_corrected(content: Column, enforce: bool = True) -> Column:
    """struct<n_cues, n_long_lines, findings, corrected>: `counters` and `corrected_content` of a file that is cleaned and parsed once."""
    with_counts = lambda cleaned, parsed: let(_cues(parsed), lambda cues: let(_counted(cues), lambda c: F.struct(c["n_cues"].alias("n_cues"), c["n_long_lines"].alias("n_long_lines"), c["findings"].alias("findings"), (capped(parsed) if enforce else cleaned).alias("corrected"))))
    return let(clean_lines(content), lambda cleaned: let(parsed_blocks(cleaned), lambda parsed: with_counts(cleaned, parsed)))


def corrected_content(content: Column, enforce: bool = True) -> Column:
    """A file with its lines cleaned and, if asked for, captions cut to two lines."""
    cleaned = clean_lines(content)
    return two_line_cap(cleaned) if enforce else cleaned


def cue_table(files: DataFrame) -> DataFrame:
    """Extension: the cues of SRT and VTT files (media_id, content) in seconds; blocks without a timing are left out."""
    # Outer explodes, here and below: of a plain one Spark tests the array's size too, which works it out once more.
    b = files.select("media_id", F.posexplode_outer(blocks(F.regexp_replace("content", "\r\n?", "\n"))).alias("cue_idx", "block"))
    return cues_of_blocks(b)


def _cue(block: Column) -> Column:
    """struct<start_s, end_s, text> of a block, or null. Lines are split once, and the timing is matched once."""
    time = r"(?:\d+:)?\d+:\d+[,.]\d{1,3}"
    stamp = rf"{time}\s*-->\s*{time}"
    nothing = F.lit(None).cast("struct<start_s:double,end_s:double,text:string>")

    def seconds(which: Column) -> Column:
        numbers = lambda x: sum((F.coalesce(F.get(x, F.size(x) - k).try_cast("double"), F.lit(0.0)) * f for k, f in ((4, 3600.0), (3, 60.0), (2, 1.0), (1, 0.001))), F.lit(0.0))
        return let(F.split(which, "[:,.]", -1), numbers)

    def timed(parts: Column, at: Column) -> Column:
        text = F.array_join(F.slice(parts, at + 1, F.size(parts)), "\n")
        both = lambda x: F.when(F.size(x) == 2, F.struct(seconds(F.get(x, F.lit(0))).alias("start_s"), seconds(F.get(x, F.lit(1))).alias("end_s"), text.alias("text"))).otherwise(nothing)
        return let(F.split(F.regexp_extract(F.get(parts, at - 1), stamp, 0), r"\s*-->\s*", -1), both)

    def found(parts: Column) -> Column:
        at = F.when(is_timing(F.get(parts, F.lit(0))), 1).when(is_timing(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), 2)
        return let(at, lambda k: F.when(k.isNotNull(), timed(parts, k)).otherwise(nothing))

    return F.when(is_timing(block), let(F.when(block.rlike(ODD_LINE_END), lines(block)).otherwise(F.split(F.regexp_replace(block, "\n\\z", ""), "\n", -1)), found)).otherwise(nothing)


def cues_of_blocks(rows: DataFrame) -> DataFrame:
    """Cues (all columns but block, start_s, end_s, text) of blocks; those without a timing are left out."""
    own = [c for c in rows.columns if c != "block"]
    found = rows.select(*own, F.explode_outer(F.array(_cue(F.col("block")))).alias("__cue")).filter("__cue is not null")
    return found.select(*own, "__cue.*")
