"""Text, time and name functions over columns. All are built-in expressions but for `normalize_text` (NFKC)."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the caption tools see it: Unicode's, and the four separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: The same for use in a negated class, without flags.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The same, one by one, for what trims.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Letters and digits of ASCII, and its other characters but for the zero.
ASCII_LETTERS = string.ascii_letters + string.digits
ASCII_OTHERS = "".join(c for c in map(chr, range(1, 128)) if c not in ASCII_LETTERS)

# Words taken for each other when captions are compared.
SYNONYMS = {
    "yeah": "yes",
    "ya": "yes",
    "yep": "yes",
    "nope": "no",
    "okay": "ok",
    "alright": "ok",
    "alrighty": "ok",
    "gonna": "going",
    "wanna": "want",
    "gotta": "got",
    "kinda": "kind",
    "sorta": "sort",
    "cannot": "can't",
    "okey": "ok",
    "thanks": "thank",
    "thankyou": "thank",
    "tho": "though",
    "through": "thru",
}
# Extensions that uploads may have.
UPLOAD_EXTENSIONS = (".srt", ".vtt", ".ass", ".ssa", ".sbv", ".txt")


def collapse_space(c: Column) -> Column:
    """Runs of white space as one space, none at either end; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


#: Bytes of text that are normalised at once.
NFKC_BYTES = 4 << 20


def nfkc_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in NFKC, null ones empty, in consecutive parts of about NFKC_BYTES or one text, so that no more than a part is there as Python strings.

    Arrow's own normalisation leaves what it takes apart uncomposed.
    """
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + NFKC_BYTES, "right")))
        yield pa.array([unicodedata.normalize("NFKC", x or "") for x in texts[start:stop].to_pylist()], pa.string())
        start = stop


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    parts = list(nfkc_parts(texts))
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else pa.array([], pa.string())


def normalize_text(c: Column) -> Column:
    return collapse_space(_nfkc(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def tokens(c: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), lambda t: t != "")


def core_parts(token: Column) -> Column:
    """struct<lead, core, trail>: the core runs from the first letter or digit to the last; none leaves all in lead."""
    pattern = r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    return F.struct(*[F.regexp_extract(token, pattern, i).alias(x) for i, x in enumerate(("lead", "core", "trail"), 1)])


def cores(text: Column) -> Column:
    """Lower-cased cores of the words of a text that is normalised already."""
    return F.filter(F.transform(tokens(text), lambda t: F.lower(core_parts(t)["core"])), lambda x: x != "")


def n_cores(text: Column) -> Column:
    """How many cores a text has: words that hold a letter or digit, each found from its first one on."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}][^" + SPACE_CLASS + "]*"))


def canonical_word(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.element_at(table, word), word)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two arrays; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def safe_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def finite(c: Column, other: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), other).otherwise(c)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; null, NaN and negative times are zero, halves of a millisecond go to the even one."""
    ms = F.rint(F.greatest(F.coalesce(F.nanvl(seconds, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) * 1000).cast("long")
    part = lambda unit, of: F.floor(ms / unit) % of
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000)


def language_code(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def clean_lines(c: Column) -> Column:
    """Line ends as line feeds, no white space at the end of a line, at most one empty line in a row."""
    trimmed = F.transform(F.split(universal_newlines(c), "\n", -1), lambda x: F.rtrim(x, F.lit(SPACE_CHARS)))
    return F.regexp_replace(F.array_join(trimmed, "\n"), "\n{3,}", "\n\n")


#: What ends a line for line-wise rewriting, beside the line feed.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ODD_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    body = F.regexp_replace(c, rf"(?:{LINE_END})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def blocks(c: Column) -> Column:
    """Blocks between blank lines; an empty text is one empty block."""
    return F.split(strip(c), r"(?U)\n\s*\n", -1)


def is_timing(line: Column) -> Column:
    return F.contains(line, F.lit("-->"))


def parsed_blocks(c: Column) -> Column:
    """array<struct<block, parts>>: blocks and their lines. A text without other line ends than line feeds, as most are, is split at these alone."""
    parsed = lambda split: F.transform(blocks(c), lambda b: F.struct(b.alias("block"), split(b).alias("parts")))
    plain = lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, "\n", -1))
    return F.when(c.rlike(ODD_LINE_END), parsed(lines)).otherwise(parsed(plain))


def two_line_cap(c: Column) -> Column:
    """Captions cut to two lines of text."""
    return let(parsed_blocks(c), capped)


def capped(parsed: Column) -> Column:
    """`two_line_cap` of blocks that are parsed already."""
    cut = F.transform(parsed, lambda x: F.when(F.size(x["parts"]) > 4, F.array_join(F.slice(x["parts"], 1, 4), "\n")).otherwise(x["block"]))
    return F.concat(F.array_join(cut, "\n\n"), F.lit("\n"))


def tag_translation(c: Column, language: Column) -> Column:
    """Every line of text with the language behind it; numbers, timings and blank lines stay."""
    kept = lambda x: x.rlike(r"(?U)^\d+\n?\z") | is_timing(x) | (strip(x) == "")
    tagged = F.transform(lines(c), lambda x: F.when(kept(x), x).otherwise(F.concat(x, F.lit(" ["), language, F.lit("]"))))
    return F.concat(F.array_join(tagged, "\n"), F.lit("\n"))


def suffix(name: Column) -> Column:
    """The last extension with its dot, lower-cased; none for names that only start with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def upload_allowed(name: Column) -> Column:
    return F.coalesce(suffix(name).isin(*UPLOAD_EXTENSIONS), F.lit(False))


def guess_format(name: Column, content: Column) -> Column:
    ext = suffix(name)
    numbered = F.coalesce(strip(F.get(lines(universal_newlines(content)), F.lit(0))).rlike(r"(?U)^\d+$"), F.lit(False))
    return (
        F.when(ext == ".srt", "srt").when(ext == ".vtt", "vtt").when(ext.isin(".ass", ".ssa"), "ass/ssa").when(ext == ".sbv", "sbv")
        .when((ext == ".txt") & numbered, "srt-txt").when(ext == ".txt", "plain").otherwise("unknown")
    )


def reposition_format(name: Column) -> Column:
    ext = suffix(name)
    return F.when(ext == ".vtt", "vtt").when(ext == ".ass", "ass").when(ext == ".ssa", "ssa").otherwise("srt")


def file_size_label(size: Column) -> Column:
    """Bytes in the largest unit of 1024 steps, two decimals at most, without trailing zeros."""
    unit = F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(1024.0)) + 1e-12)).otherwise(0).cast("int")
    number = F.regexp_replace(F.format_string("%.2f", F.round(size / F.pow(F.lit(1024.0), unit.cast("double")), 2)), r"\.?0+$", "")
    return F.when(size == 0, "0 Bytes").otherwise(F.concat_ws(" ", number, F.element_at(F.array(*[F.lit(x) for x in ("Bytes", "KB", "MB", "GB")]), unit + 1)))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def password_ok(password: Column, again: Column) -> Column:
    rules = [F.length(password) >= 8, password == again, *(password.rlike(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))]
    ok = F.lit(True)
    for r in rules:
        ok = ok & r
    return ok


def letter_profile(text: Column) -> Column:
    """struct<ascii, other>: letters and digits inside and outside ASCII."""
    # What is ASCII goes by translate, as a pattern would match once or twice a word.
    rest = F.translate(text, ASCII_LETTERS, "")
    other = F.length(F.regexp_replace(F.translate(rest, ASCII_OTHERS, ""), r"[^\p{L}\p{Nd}]+", ""))
    return F.struct((F.length(text) - F.length(rest)).cast("long").alias("ascii"), other.cast("long").alias("other"))


def generated_captions(language: Column) -> Column:
    """The placeholder captions of speech recognition that isn't there."""
    tag = F.coalesce(F.nullif(language, F.lit("")), F.lit("en"))
    return F.format_string(
        "1\n00:00:00,000 --> 00:00:02,000\nGenerated subtitle line 1 (%s)\n\n2\n00:00:02,500 --> 00:00:05,000\nGenerated subtitle line 2 (%s)\n", tag, tag
    )
