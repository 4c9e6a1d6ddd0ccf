"""Intervals and runs: overlap joins by time bucket, gap merging, hopping windows, dialogue history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.ordering import gap_merge, runs, with_runs  # noqa: F401


def overlap_join(a: DataFrame, b: DataFrame, width: float, least: float = 0.0) -> DataFrame:
    """Pairs of intervals (id, start, end) that overlap by more than `least`, with the clipped interval.

    Intervals are copied to the buckets of `width` that they touch and joined by bucket; a pair counts in the bucket
    in which its overlap begins, so no pair comes twice and none needs a comparison of all with all.
    """

    def bucketed(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "start", "end")])
        lo, hi = (F.floor(F.col(f"{p}_{c}") / width) for c in ("start", "end"))
        return named.withColumn("bucket", F.explode(F.sequence(lo, hi)))

    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    joined = bucketed(a, "a").join(bucketed(b, "b"), "bucket").filter((end - start > least) & (F.floor(start / width) == F.col("bucket")))
    return joined.select("a_id", "b_id", start.alias("start"), end.alias("end"))


def history(rows: DataFrame, key: str, order: str, text: Column, most: int = 16) -> Column:
    """The texts of up to `most` rows before this one."""
    return F.collect_list(text).over(Window.partitionBy(key).orderBy(order).rowsBetween(-most, -1))


def grouped_runs(rows: DataFrame, key: list[str], order: list[str], value: str, text: str) -> DataFrame:
    """A row per run of equal values: key, run, value, n and the run's texts in order, one per line.

    A run is one row in the end, so its texts must fit a task; finding runs has no such bound.
    """
    said = F.sort_array(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t"))))
    return with_runs(rows, key, order, value).groupBy(*key, "run", value).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(said, lambda s: s["_t"]), "\n").alias(text))


def meetings(rows: DataFrame) -> DataFrame:
    """Consecutive rows of a file that share an audio as one row: file, line (of the first), audio, segments (start, end,
    speaker; each once, in order) and utterances (id from 0, source_sample_id, start, end, speaker, text).

    rows: file, line, audio, sample_id, start, end, speaker, text; those without a text are no part of a meeting and
    don't part one. A segment needs both times and a speaker. A meeting is one row in the end, so it must fit a task.
    """
    stem = F.regexp_replace(F.regexp_replace("audio", "^.*/", ""), "[.][^.]*$", "")
    runs_ = with_runs(rows.filter("text is not null"), ["file"], ["line"], "audio")
    said = F.sort_array(F.collect_list(F.struct("line", "sample_id", "start", "end", "speaker", "text")))
    met = runs_.groupBy("file", "run", "audio").agg(F.min("line").alias("line"), said.alias("said")).withColumn("_stem", F.coalesce(F.nullif(stem, F.lit("")), F.lit("meeting")))
    timed = F.filter("said", lambda u: u["start"].isNotNull() & u["end"].isNotNull() & (F.coalesce(u["speaker"], F.lit("")) != ""))
    segments = F.array_distinct(F.transform(timed, lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["speaker"].alias("speaker"))))
    name = lambda u, k: F.coalesce(F.nullif(u["sample_id"], F.lit("")), F.concat("_stem", F.lit("_"), F.lpad(k.cast("string"), 5, "0"))).alias("source_sample_id")
    utterances = F.transform("said", lambda u, k: F.struct(k.cast("string").alias("id"), name(u, k), u["start"].alias("start"), u["end"].alias("end"), u["speaker"].alias("speaker"), u["text"].alias("text")))
    return met.select("file", "line", "audio", segments.alias("segments"), utterances.alias("utterances"))


def speech_windows(segments: DataFrame, key: list[str], width: float = 30.0, step: float = 20.0, least_speakers: int = 2, least_speech: float = 4.0) -> DataFrame:
    """(key, window_start, speakers, speech) of windows from 0 on, every `step`, that end within the key's last segment, in
    which enough speakers speak long enough: the summed lengths of segments (start, end, speaker) clipped to the window.

    A segment goes to the windows that it touches; a window's sums combine before the shuffle.
    """
    start, end = F.col("start"), F.col("end")
    first = F.greatest(F.ceil((start - width) / step), F.lit(0))
    touched = segments.withColumn("_w", F.explode(F.when(end > 0, F.sequence(first, F.greatest(first, F.floor(end / step))))))
    at = F.col("_w") * step
    clipped = touched.withColumn("_s", F.least(end, at + width) - F.greatest(start, at)).filter("_s > 0")
    per = clipped.groupBy(*key, "_w", "speaker").agg(F.sum("_s").alias("_s")).groupBy(*key, "_w").agg(F.count(F.lit(1)).alias("speakers"), F.sum("_s").alias("speech"))
    last = segments.groupBy(*key).agg(F.max("end").alias("_last"))
    kept = per.join(last, key).filter((at + width <= F.col("_last") + 1e-6) & (F.col("speakers") >= least_speakers) & (F.col("speech") >= least_speech))
    return kept.select(*key, at.cast("double").alias("window_start"), "speakers", "speech")
