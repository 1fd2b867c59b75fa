"""Segment state as keyed tables: joins, filters and merges instead of record-by-record updates.

Every operation takes and returns DataFrames keyed by (book_id, segment_id); joins on that key leave
the strategy to the optimizer, so either side may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import heard, polish_cjk, refused, speech_of

KEY = ["book_id", "segment_id"]
STATUSES = ("pending", "in_progress", "completed", "skipped", "error")


def with_state(segments: DataFrame, state: DataFrame) -> DataFrame:
    """Every segment with its record; without one it is pending."""
    return segments.join(state, KEY, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def chosen(segments: DataFrame, files: DataFrame | None) -> DataFrame:
    """Segments of the listed files (book_id, file_path); without a list those that aren't skipped."""
    if files is None:
        return segments.where("skip_reason is null")
    return segments.join(files.select("book_id", "file_path").distinct(), ["book_id", "file_path"], "left_semi")


def pending(segments: DataFrame, state: DataFrame) -> DataFrame:
    """Segments without a completed record: errors and skipped ones are tried again."""
    return segments.join(state.where("status = 'completed'"), KEY, "left_anti")


def orphans(segments: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(segments, KEY, "left_anti")


def injectable(segments: DataFrame, state: DataFrame) -> DataFrame:
    """Segments with a translation made by a provider; copied text stays as it is."""
    good = state.where("status = 'completed' and translation <> '' and provider_name is not null")
    return segments.join(good, KEY)


def ensured(segments: DataFrame, state: DataFrame, same_settings: bool = True) -> DataFrame:
    """State with a pending record for every segment; other settings start all over."""
    columns = state.columns
    fresh = segments.select(*KEY).distinct()
    missing = fresh.join(state, KEY, "left_anti") if same_settings else fresh
    blank = missing.select(*(F.col(c) if c in KEY else F.lit("pending" if c == "status" else None).cast(state.schema[c].dataType).alias(c) for c in columns))
    return state.unionByName(blank) if same_settings else blank


def merged(state: DataFrame, updates: DataFrame, insert: bool = True) -> DataFrame:
    """Records replaced by those of ``updates``; unknown ids are inserted or left out."""
    kept = state.join(updates.select(*KEY), KEY, "left_anti")
    new = updates if insert else updates.join(state.select(*KEY), KEY, "left_semi")
    return kept.unionByName(new.select(*state.columns))


def reset(state: DataFrame, condition: Column, clear: tuple[str, ...] = ()) -> DataFrame:
    """Records that meet a condition become pending, with the given columns cleared."""
    cleared = {c: F.when(condition, F.lit(None)).otherwise(F.col(c)) for c in clear}
    return state.withColumns({"status": F.when(condition, F.lit("pending")).otherwise(F.col("status")), **cleared})


def reset_errors(state: DataFrame, ids: list[str] | None = None, none_means_all: bool = False) -> DataFrame:
    """Errors become pending; with ids only those (an empty list means none, or all if asked for)."""
    hit = F.col("status") == "error"
    if ids is not None and not (none_means_all and not ids):
        hit = hit & (F.col("segment_id").isin(*ids) if ids else F.lit(False))
    return reset(state, hit, ("error_message",))


def purged(state: DataFrame) -> DataFrame:
    """Records whose translation declines the task become pending again."""
    return reset(state, refused(F.col("translation")), ("translation", "provider_name"))


def polished(state: DataFrame) -> DataFrame:
    """Completed Chinese translations in uniform typography."""
    fits = (F.col("status") == "completed") & F.col("translation").isNotNull()
    return state.withColumn("translation", F.when(fits, polish_cjk(F.col("translation"))).otherwise(F.col("translation")))


def resume(segments: DataFrame, state: DataFrame) -> DataFrame:
    """(book_id, segment_id, kind): each segment as remaining, completed or skipped."""
    full = with_state(segments.select(*KEY), state.select(*KEY, "status"))
    kind = F.when(F.col("status").isin("completed", "skipped"), F.col("status")).otherwise("remaining")
    return full.select(*KEY, kind.alias("kind"))


def resume_counts(segments: DataFrame, state: DataFrame) -> DataFrame:
    """(book_id, remaining, completed, skipped, first_completed): counts of a book's segments, and the least completed id."""
    found, is_ = resume(segments, state), lambda k: F.col("kind") == k
    return found.groupBy("book_id").agg(
        *(F.count_if(is_(k)).alias(k) for k in ("remaining", "completed", "skipped")), F.min(F.when(is_("completed"), F.col("segment_id"))).alias("first_completed")
    )


def invalidated(audio: DataFrame, old: dict, new: dict) -> DataFrame:
    """Completed audio becomes pending where a setting that shapes sound has changed; a cover doesn't."""
    shaping = ("voice", "language", "rate", "volume", "tts_provider", "tts_model", "tts_speed")
    if all(old.get(k) == new.get(k) for k in shaping):
        return audio
    return reset(audio, F.col("status") == "completed", ("audio_path", "duration_seconds"))


def audio_plan(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Each segment with what is spoken, or why it is skipped.

    Texts are made ready before the join, so that a plan that doesn't ask for them joins without them.
    """
    said = speech_of(F.col("__heard"), F.col("element_type"), F.col("order_in_file"), F.col("segment_id"), F.col("xpath"))
    ready = segments.withColumn("__heard", heard(F.col("source_content"))).withColumn("spoken", said).drop("__heard").withColumn("__silent", F.col("spoken").isNull())
    full = ready.join(translations.select(*KEY, F.col("status").alias("translation_status")), KEY, "left")
    reason = (
        F.when(F.col("translation_status") == "skipped", F.lit("translation skipped"))
        .when(F.col("skip_reason").isNotNull(), F.concat(F.lit("file skipped: "), F.col("skip_reason")))
        .when(F.col("__silent"), F.lit("nothing to speak"))
    )
    return full.withColumn("skipped_because", reason).drop("__silent")


def audio_pending(plan: DataFrame, audio: DataFrame, files: DataFrame) -> DataFrame:
    """Speakable segments without audio; completed ones only count while their file is there."""
    there = audio.where("status = 'completed'").join(files.select(F.col("path").alias("audio_path")).distinct(), "audio_path", "left_semi")
    return plan.where("skipped_because is null").join(there, KEY, "left_anti").join(audio.where("status = 'skipped'"), KEY, "left_anti")


def stamped(state: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Audio records replaced or added, with the time of the change in ``updated_at``."""
    marked = updates.withColumn("updated_at", F.current_timestamp() if now is None else now)
    return merged(state, marked, insert=True)


def audio_missing(plan: DataFrame, audio: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, n_missing, first_missing): what a finished audio book still lacks."""
    todo = audio_pending(plan, audio, files)
    return todo.groupBy("book_id").agg(F.count("*").alias("n_missing"), F.min(F.struct("spine_index", "order_in_file", "segment_id"))["segment_id"].alias("first_missing"))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Each event with the length of the run of failures it ends; a success resets it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("failed", failed).withColumn("island", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "island").orderBy(*order)
    return marked.withColumn("run", F.sum(F.col("failed").cast("long")).over(inside)).drop("island")
