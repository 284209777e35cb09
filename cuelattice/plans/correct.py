"""Correction of captions after a transcript: plain, with a stand-in for audio, and the hybrid of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import SAME_MEANING, corrected, seq_ratio
from ..functions.text import language_code, let, letter_profile, normalize_text
from ..lineage import cut, spread
from ..operators.align import best_windows, refined_times, span_parts
from ..operators.timeline import enforce_constraints, keep_first, locate_spans, media_end, normalized_cues, normalized_segments, overlapping_text, renumbered, uncovered_runs

#: Texts this alike are one, as far as the language guard can tell.
SCRIPT_GAP = 0.6
SAMPLE_CHARS, SAMPLE_CUES = 2000, 10


def opening(rows: DataFrame, number: str, most: int) -> DataFrame:
    """(media_id, text): the first `most` characters of a medium's texts, joined by spaces in the order of a whole number.

    What is kept of consecutive rows is their first characters and least number; two of these merge by being joined and cut
    again. Rows merge by their number, 256 numbers into one, twice, and then by medium, so no group holds many texts.
    """
    part = rows.filter(F.col("text").isNotNull()).select("media_id", F.col(number).cast("long").alias("at"), F.substring("text", 1, most).alias("text"))
    for width in (1 << 8, 1 << 16, None):
        key = ["media_id"] if width is None else ["media_id", F.floor(F.col("at") / width).alias("run")]
        texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
        part = part.groupBy(*key).agg(F.min("at").alias("at"), F.substring(F.array_join(texts, " "), 1, most).alias("text")).select("media_id", "at", "text")
    return part.select("media_id", "text")


def same_language(cues: DataFrame, segments: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """(media_id, same): false where both name a language and these differ, or where one text is ASCII and the other isn't.

    cues may have a language; languages (media_id, language) are those of the transcripts.
    """
    said = opening(segments, "seg_idx", SAMPLE_CHARS).withColumnRenamed("text", "said")
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("cue_idx"))
    shown = cues.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_CUES)
    first = F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "text"))), lambda x: x["text"])
    own = language_code(F.col("language")) if "language" in cues.columns else F.lit(None).cast("string")
    shown = shown.groupBy("media_id").agg(F.substring(F.array_join(first, " "), 1, SAMPLE_CHARS).alias("shown"), F.min_by(own, "cue_idx").alias("cue_language"))
    both = shown.join(said, "media_id", "left")
    both = both.join(languages.select("media_id", language_code(F.col("language")).alias("language")), "media_id", "left") if languages is not None else both.withColumn("language", F.lit(None).cast("string"))
    share = lambda c: let(letter_profile(F.coalesce(c, F.lit(""))), lambda p: F.when(p["ascii"] + p["other"] > 0, p["ascii"] / (p["ascii"] + p["other"])))
    named = F.coalesce(F.col("language") != F.col("cue_language"), F.lit(False))
    gap = F.coalesce(F.abs(share(F.col("said")) - share(F.col("shown"))) > SCRIPT_GAP, F.lit(False))
    return both.select("media_id", (~(named | gap)).alias("same"))


def correct(cues: DataFrame, segments: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Rows (media_id, pos, start_s, end_s, text, kind, meta): cues after their transcript, and cues made for what none covers.

    kind is aligned, generated or untouched (no transcript, or another language). Times may overlap, as the cues keep
    those of the speech. meta tells what became of each word.
    """
    return _correct(cues, _segments(segments), languages)


def _segments(segments: DataFrame) -> DataFrame:
    """What a correction needs of segments, with their lineage cut: its steps read them again and again."""
    return cut(segments.select("media_id", "seg_idx", "start_s", "end_s", "text"))


def _correct(cues: DataFrame, segments: DataFrame, languages: DataFrame | None) -> DataFrame:
    """`correct` after segments whose lineage is cut."""
    guard = same_language(cues, segments, languages).filter("same").select("media_id", F.lit(True).alias("usable"))
    with_speech = segments.select("media_id").distinct()
    asked = cut(cues.join(guard.join(with_speech, "media_id", "left_semi"), "media_id", "left"))
    usable = asked.filter("usable").drop("usable")
    matched = span_parts(best_windows(usable, segments, materialised=True), segments)
    # Keys in another order than the joins have: Spark leaves an exchange out that deals rows as they lie, and joins theirs into few tasks.
    fixed = spread(matched, "cue_idx", "media_id").withColumn("meta", corrected("text", "span_text"))
    times = refined_times(F.col("parts"), F.col("match.token_start"), F.col("match.token_end"))
    aligned = fixed.select("media_id", F.col("cue_idx").cast("long").alias("pos"), times.alias("t"), F.col("meta.text").alias("text"), F.lit("aligned").alias("kind"), "meta", F.col("match.i").alias("i"), F.col("match.j").alias("j"))
    aligned = cut(aligned.select("media_id", "pos", "t.start_s", "t.end_s", "text", "kind", "meta", "i", "j"))
    heard = segments.join(usable.select("media_id").distinct(), "media_id", "left_semi")
    made = uncovered_runs(heard, aligned.select("media_id", "i", "j"))
    made = made.select("media_id", (F.lit(1 << 40) + F.col("i")).alias("pos"), "start_s", "end_s", "text", F.lit("generated").alias("kind"), F.lit(None).cast(aligned.schema["meta"].dataType).alias("meta"))
    all_ = keep_first(aligned.drop("i", "j").unionByName(made))
    ends = media_end(segments)
    clamped = all_.join(ends, "media_id").filter("start_s < media_end").withColumn("end_s", F.least("end_s", "media_end")).drop("media_end")
    rest = asked.filter("usable is null").select("media_id", F.col("cue_idx").cast("long").alias("pos"), "start_s", "end_s", "text", F.lit("untouched").alias("kind"), F.lit(None).cast(aligned.schema["meta"].dataType).alias("meta"))
    return clamped.unionByName(rest)


def correct_inputs(transcripts: DataFrame, loose_cues: DataFrame) -> DataFrame:
    """`correct` from transcripts (media_id, language, segments) and cues of any time convention, both normalised (NFKC) first."""
    cues = cut(normalized_cues(loose_cues, normalize_text))
    return correct(cues, normalized_segments(transcripts, normalize_text), transcripts.select("media_id", "language"))


def mean_audio_score(text: Column, embeddings: Column) -> Column:
    """The mean of the scores against each of several stretches of sound; without any, null."""
    total = F.aggregate(embeddings, F.lit(0.0), lambda acc, e: acc + audio_score(text))
    return F.when(F.size(embeddings) > 0, total / F.size(embeddings))


def audio_score(text: Column) -> Column:
    """A stand-in for how well a text fits the sound: longer texts fit better, up to a point."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0.4).otherwise(F.least(F.lit(0.9), F.lit(0.5) + F.least(F.length(text), F.lit(60)) / 200.0))


def audio_pick(cue: Column, transcript: Column, has_audio: Column, similarity: Column) -> Column:
    """The caption's or the transcript's words: what fits the sound better, the caption where they are close; without sound, by similarity."""
    a, b = audio_score(cue), audio_score(transcript)
    heard = F.when(F.abs(a - b) <= 0.05, cue).when(a > b, cue).otherwise(transcript)
    return F.when(has_audio, heard).otherwise(F.when(similarity >= SAME_MEANING, cue).otherwise(transcript))


def _with_reference(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ref_text and similarity of rows of `correct`."""
    keyed = rows.withColumnRenamed("pos", "cue_idx")
    ref = overlapping_text(keyed, segments).select("media_id", F.col("cue_idx").alias("pos"), "ref_text")
    return spread(rows.join(ref, ["media_id", "pos"]), "pos", "media_id").withColumn("similarity", seq_ratio("text", "ref_text"))


def correct_with_audio(cues: DataFrame, segments: DataFrame, languages: DataFrame | None = None, has_audio: bool = False) -> DataFrame:
    """`correct`, and the words of unlike cues decided by sound, or without it by the transcript."""
    segments = _segments(segments)
    rows = _with_reference(cut(_correct(cues, segments, languages)), segments)
    unlike = (F.col("ref_text") != "") & (F.col("similarity") < SAME_MEANING)
    return rows.withColumn("text", F.when(unlike, audio_pick(F.col("text"), F.col("ref_text"), F.lit(has_audio), F.col("similarity"))).otherwise(F.col("text"))).drop("ref_text", "similarity")


def problematic(text: Column, ref_text: Column, similarity: Column, length: Column) -> Column:
    return (ref_text != "") & ((F.trim(text) == "") | (similarity < 0.70) | (length < 0.6) | (length > 9.0))


def hybrid(cues: DataFrame, segments: DataFrame, languages: DataFrame | None = None, has_audio: bool = False, enforce: bool = True, fmt: str = "srt") -> DataFrame:
    """Rows (media_id, index, start, end, text, format): `correct`, sound for what looks wrong, and durations without overlaps.

    Cues whose times are those of segments stay locked to them; the others get the least duration and give way.
    """
    segments = _segments(segments)
    rows = _correct(cues, segments, languages)
    if has_audio:
        rows = _with_reference(cut(rows), segments)
        wrong = problematic(F.col("text"), F.col("ref_text"), F.col("similarity"), F.col("end_s") - F.col("start_s"))
        rows = rows.withColumn("text", F.when(wrong, audio_pick(F.col("text"), F.col("ref_text"), F.lit(True), F.col("similarity"))).otherwise(F.col("text")))
    rows = cut(rows.select("media_id", "pos", "start_s", "end_s", "text"))
    if enforce:
        at = locate_spans(rows.withColumnRenamed("pos", "cue_idx"), segments).select("media_id", F.col("cue_idx").alias("pos"), F.lit(True).alias("locked"))
        rows = enforce_constraints(rows.join(at, ["media_id", "pos"], "left"), ends=media_end(segments), respect_locks=True)
    return renumbered(rows).select("media_id", "index", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", F.lit(fmt).alias("format"))


def run_summary(cues: DataFrame, corrected_rows: DataFrame) -> DataFrame:
    """(media_id, n_cues, n_retimed, n_reworded, n_overlong, n_generated) of a run of `correct`."""
    before = cues.select("media_id", F.col("cue_idx").cast("long").alias("pos"), F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col("text").alias("t"))
    x = corrected_rows.join(before, ["media_id", "pos"], "left")
    retimed = (F.abs(F.col("start_s") - F.col("s")) > 1e-9) | (F.abs(F.col("end_s") - F.col("e")) > 1e-9)
    return x.groupBy("media_id").agg(
        F.count_if(F.col("kind") != "generated").alias("n_cues"),
        F.count_if(retimed).alias("n_retimed"),
        F.count_if(F.col("text") != F.col("t")).alias("n_reworded"),
        F.count_if(F.col("end_s") - F.col("start_s") > 8.0).alias("n_overlong"),
        F.count_if(F.col("kind") == "generated").alias("n_generated"),
    )
