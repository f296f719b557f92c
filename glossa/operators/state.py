"""Readers' state: sets and maps as columns, defaults, progress, and states folded from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.geometry import percent
from glossa.functions.text import trim_script
from glossa.session import shared_folder


def distinct(xs: Column) -> Column:
    """First-seen order is kept."""
    return F.array_distinct(xs)


def add(xs: Column, x: Column) -> Column:
    return F.when(F.array_contains(xs, x), xs).otherwise(F.array_append(xs, x))


def toggle(xs: Column, x: Column) -> Column:
    return F.when(F.array_contains(xs, x), F.array_remove(xs, x)).otherwise(F.array_append(xs, x))


def put(notes: Column, key: Column, value: Column) -> Column:
    """Sets one entry of a map."""
    return merged(notes, F.create_map(key, value))


def merged(a: Column, b: Column) -> Column:
    """Both maps' entries; b's win."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def unset(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def correct(corrections: Column, segment: Column, exhibit: Column, action: Column) -> Column:
    """Sets a correction (include, exclude), or takes it back where action is null; a map of maps."""
    own = F.coalesce(F.try_element_at(corrections, segment), F.from_json(F.lit("{}"), "map<string,string>"))
    new = F.when(action.isNull(), unset(own, exhibit)).otherwise(merged(own, F.create_map(exhibit, F.coalesce(action, F.lit("")))))
    return merged(corrections, F.create_map(segment, new))


def pruned(state: DataFrame, segments: DataFrame, shown: DataFrame) -> DataFrame:
    """State without ids that are gone: seen keeps visible ids (once each), understood and bookmarks all ids that exist,
    notes those of existing ids. A reader has few ids, a paper may have many: ids are looked up by a join."""
    key = ["paper_id", "reader_id"]
    alive = segments.select("paper_id", "id").join(shown.select("paper_id", "id", F.lit(True).alias("is_shown")), ["paper_id", "id"], "left")
    lists = state.select(*key, F.explode(F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("seen", "understood", "bookmarks")), F.coalesce(F.map_keys("notes"), F.array().cast("array<string>"))))).alias("id"))
    found = lists.join(alive, ["paper_id", "id"]).groupBy(*key).agg(F.collect_set("id").alias("__all"), F.collect_set(F.when(F.col("is_shown"), F.col("id"))).alias("__shown"))
    rows = state.join(found, key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("__all", "__shown")})
    held = lambda c: F.filter(F.col(c), lambda x: F.array_contains(F.col("__all"), x))
    return rows.withColumns({
        "seen": F.array_distinct(F.filter("seen", lambda x: F.array_contains(F.col("__shown"), x))),
        "understood": held("understood"), "bookmarks": held("bookmarks"),
        "notes": F.map_filter("notes", lambda k, v: F.array_contains(F.col("__all"), k) & v.isNotNull()),
    }).drop("__all", "__shown")


def with_defaults(stored_json: Column, default: Column, fields: dict[str, str]) -> Column:
    """Fields (name to type) of stored JSON over defaults (a struct): what the text has wins, an explicit null too; what it
    lacks, or all where it isn't an object, is the default."""
    kind = ", ".join(f"{k}: {t}" for k, t in fields.items())
    own, keys = F.from_json(stored_json, f"struct<{kind}>"), F.json_object_keys(stored_json)
    return F.struct(*(F.when(F.coalesce(F.array_contains(keys, f), F.lit(False)), own[f]).otherwise(default[f]).alias(f) for f in fields))


def progress(seen: DataFrame, shown: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, seen, visible, percent) of distinct seen ids among the visible ones."""
    n = shown.groupBy(key).agg(F.count(F.lit(1)).alias("visible"))
    have = seen.select(key, "id").distinct().join(shown.select(key, "id"), [key, "id"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("seen"))
    return n.join(have, key, "left").select(key, F.coalesce("seen", F.lit(0)).alias("seen"), "visible", percent(F.coalesce("seen", F.lit(0)), F.col("visible")).alias("percent"))


def last_actions(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key: overwriting actions folded."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def toggled(events: DataFrame, key: list[str]) -> DataFrame:
    """Keys toggled an odd number of times are on."""
    return events.groupBy(*key).agg((F.count(F.lit(1)) % 2 == 1).alias("is_on"))


def folded_notes(events: DataFrame, reader: str, key: str, note: str, order: list[str]) -> DataFrame:
    """(reader, notes): a map of each reader's last notes; blank ones are dropped."""
    last = last_actions(events, [reader, key], order, note).filter(F.length(trim_script(note)) > 0)
    return last.groupBy(reader).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, note)))).alias("notes"))


def restored(state: DataFrame, shown: DataFrame, resolved: DataFrame) -> DataFrame:
    """Reading positions: what the stored id leads to, else the first visible segment. resolved: (paper_id, wanted, resolved)."""
    first = shown.groupBy("paper_id").agg(F.min_by("id", "order").alias("__first"))
    at = resolved.select("paper_id", F.col("wanted").alias("currentSegmentId"), "resolved")
    return state.join(at, ["paper_id", "currentSegmentId"], "left").join(first, "paper_id", "left").withColumn("currentSegmentId", F.coalesce("resolved", "__first")).drop("resolved", "__first")


def sanitised(states: DataFrame, segments: DataFrame, shown: DataFrame, resolved: DataFrame) -> DataFrame:
    """States as a reader continues with them: ids that are gone are dropped, the position is one that can be shown, and it
    counts as seen. resolved: (paper_id, wanted, resolved)."""
    own = restored(pruned(states, segments, shown), shown, resolved)
    seen = F.when(F.col("currentSegmentId").isNotNull(), F.array_distinct(F.array_append("seen", F.col("currentSegmentId")))).otherwise(F.array().cast("array<string>"))
    return own.withColumn("seen", seen)


def imported(backups: DataFrame, papers: DataFrame, segments: DataFrame, shown: DataFrame, resolved: DataFrame) -> DataFrame:
    """Backups that belong to a paper as it is now (version, paper, source hash), sanitised. backups: (reader_id, version,
    paperId, sourceSha256, currentSegmentId, seen, understood, bookmarks, notes)."""
    own = backups_for(backups, papers).withColumn("paper_id", F.col("paperId"))
    return sanitised(own, segments, shown, resolved)


def back_stack(visits: DataFrame, reader: str, order: list[str], target: str) -> DataFrame:
    """(reader, depth, target): the positions to go back to, the last at the greatest depth, from visits in (unique) order; a
    null target takes the last one off, if there is one.

    A visit is still there unless the stack was lower later. Depths are running sums that don't fall below zero. Visits are
    dealt by ranges of (reader, order), so that a reader's log may lie in many blocks: a block tells how many positions it
    takes off from before and which it leaves, and a second pass over these pairs tells which of them later blocks take."""
    rows = visits.select(F.col(reader).alias("__reader"), F.struct(*order).alias("__at"), F.col(target).alias("__target"))
    path = shared_folder(visits.sparkSession)
    rows.repartitionByRange("__reader", "__at").withColumn("__block", F.spark_partition_id()).write.parquet(path)
    placed = visits.sparkSession.read.parquet(path)
    own, back = Window.partitionBy("__reader", "__block").orderBy("__at"), Window.partitionBy("__reader", "__block").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    sofar = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = placed.withColumn("sum", F.sum(F.when(F.col("__target").isNotNull(), 1).otherwise(-1)).over(sofar))
    walked = walked.withColumn("low", F.least(F.min("sum").over(sofar), F.lit(0))).withColumn("depth", F.col("sum") - F.col("low"))
    kept = walked.withColumn("later", F.min("depth").over(back)).filter(F.col("__target").isNotNull() & (F.col("later").isNull() | (F.col("later") >= F.col("depth"))))
    # Each block as so many positions off, then so many on; the same walk over blocks.
    blocks = walked.groupBy("__reader", "__block").agg(F.max(-F.col("low")).alias("off"), F.max_by("depth", "__at").alias("on"))
    every, after = Window.partitionBy("__reader").orderBy("__block"), Window.partitionBy("__reader").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    upto = every.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("left", F.sum(F.col("on") - F.col("off")).over(upto) - F.col("on"))
    blocks = blocks.withColumn("base", F.col("left") - F.least(F.min("left").over(upto), F.lit(0)))
    blocks = blocks.withColumn("most", F.min("base").over(after)).select(F.col("__reader").alias("r"), F.col("__block").alias("b"), "base", "most")
    found = kept.join(blocks, F.col("__reader").eqNullSafe(F.col("r")) & (F.col("__block") == F.col("b")))
    found = found.withColumn("depth", F.col("base") + F.col("depth")).filter(F.col("most").isNull() | (F.col("depth") <= F.col("most")))
    return found.select(F.col("__reader").alias(reader), "depth", F.col("__target").alias(target))


def backups_for(backups: DataFrame, papers: DataFrame) -> DataFrame:
    """Backups of version 1 whose paper and source hash are current."""
    return backups.filter("version = 1").join(papers.select(F.col("paper_id").alias("paperId"), F.col("source_sha256").alias("sourceSha256")), ["paperId", "sourceSha256"], "left_semi")


def mark_understood(states: DataFrame) -> DataFrame:
    """The current segment joins the understood ones, once."""
    ids = F.coalesce("understood", F.array().cast("array<string>"))
    return states.withColumn("understood", F.when(F.col("currentSegmentId").isNull(), ids).otherwise(add(ids, F.col("currentSegmentId"))))
