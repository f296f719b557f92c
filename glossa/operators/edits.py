"""Edits of segments: every one is a new frame; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.labels import translation_status
from glossa.functions.text import filled, is_blank, trim_script


def unique_ids(wanted: DataFrame, taken: DataFrame, base: str = "base") -> DataFrame:
    """(paper_id, base, id): base itself if free, else the first free of base-2, base-3, ... A taken name counts for itself as
    base and, where it ends in a number, for what stands before; the two meet by equality, and the first gap in the
    numbers is one window pass."""
    rows = wanted.select("paper_id", F.col(base).alias("base")).distinct()
    number = F.regexp_extract("id", "-([1-9][0-9]{0,17})$", 1).try_cast("long")
    ways = F.array(F.struct(F.col("id").alias("base"), F.lit(1).cast("long").alias("n")), F.struct(F.regexp_replace("id", "-[0-9]+$", "").alias("base"), F.when(number >= 2, number).alias("n")))
    near = taken.select("paper_id", F.explode(ways).alias("w")).select("paper_id", "w.base", "w.n").filter("n is not null").join(rows, ["paper_id", "base"], "left_semi").distinct()
    after = F.lead("n").over(Window.partitionBy("paper_id", "base").orderBy("n"))
    gaps = near.withColumn("gap", F.when(~after.eqNullSafe(F.col("n") + 1), F.col("n") + 1)).groupBy("paper_id", "base").agg(F.min("n").alias("least"), F.min("gap").alias("gap"))
    free = F.when(F.col("least") == 1, F.concat("base", F.lit("-"), F.col("gap").cast("string"))).otherwise(F.col("base"))
    return rows.join(gaps, ["paper_id", "base"], "left").select("paper_id", "base", free.alias("id"))


def named(rows: DataFrame, new: Column, others: DataFrame) -> DataFrame:
    """Rows whose id is new (a flag) get a free one; others: (paper_id, id) of the paper before the edit."""
    names = unique_ids(rows.filter(new).select("paper_id", F.col("id").alias("base")), others).select("paper_id", F.col("base").alias("id"), F.col("id").alias("__free"))
    marked = rows.withColumn("__new", new)
    fresh = marked.filter("__new").join(names, ["paper_id", "id"], "left").withColumn("id", F.coalesce("__free", "id")).drop("__free")
    return marked.filter("not __new").unionByName(fresh).drop("__new").select(*rows.columns)


def merge_with_next(rows: DataFrame, key: list[str], order: str, at: Column, *, id_col: str = "id", text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Rows where `at` holds are joined with their successor, which disappears: `{id}-merged`, trimmed texts with one space
    between, the least confidence and at most .5, to be reviewed again. A row whose predecessor is merged isn't a start."""
    w = Window.partitionBy(*key).orderBy(order)
    wants = F.coalesce(at, F.lit(False)) & F.lead(order).over(w).isNotNull()
    marked = rows.withColumns({"__want": wants, "__text": F.lead(text).over(w), "__conf": F.lead(confidence).over(w)})
    # In a stretch of wanting rows every second one starts a merge.
    marked = marked.withColumn("__gap", F.sum(F.when(F.col("__want"), 0).otherwise(1)).over(w)).withColumn("__nth", F.sum(F.col("__want").cast("int")).over(Window.partitionBy(*key, "__gap").orderBy(order)))
    starts = F.col("__want") & (F.col("__nth") % 2 == 1)
    marked = marked.withColumn("__start", starts).withColumn("__eaten", F.coalesce(F.lag("__start").over(w), F.lit(False)))
    return marked.filter(~F.col("__eaten")).select(
        *(c for c in rows.columns if c not in (id_col, text, confidence)),
        F.when(F.col("__start"), F.concat(F.col(id_col).cast("string"), F.lit("-merged"))).otherwise(F.col(id_col).cast("string")).alias(id_col),
        F.when(F.col("__start"), F.concat_ws(" ", filled(trim_script(text)), filled(trim_script("__text")))).otherwise(F.col(text)).alias(text),
        F.when(F.col("__start"), F.least(confidence, "__conf", F.lit(0.5))).otherwise(F.col(confidence)).alias(confidence),
        F.col("__start").alias("was_merged"),
    )


def _translation(rows: DataFrame, **fields: Column) -> Column:
    """The translation column with those of these fields that it has."""
    out = F.col("translation")
    for name, value in fields.items():
        if name in rows.schema["translation"].dataType.fieldNames():
            out = out.withField(name, value)
    return out


def merge_segments(rows: DataFrame, order: str, at: Column) -> DataFrame:
    """Whole segments (paper_id, id, sourceText, fragments, confidence, excluded, reviewStatus, translation, ...) where `at`
    holds become one with their successor: free id `{id}-merged`, trimmed texts with one space between, both's boxes, the
    least confidence and at most .5, excluded only if both are, translations in paragraphs, to be reviewed again. What else
    a segment has is the first one's."""
    w = Window.partitionBy("paper_id").orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    more = {"__fragments": nxt("fragments"), "__excluded": nxt("excluded"), "__translation": nxt("translation")}
    got = merge_with_next(rows.withColumns(more), ["paper_id"], order, at, text="sourceText")
    hit = F.col("was_merged")
    both = lambda f: F.concat_ws("\n\n", filled(f"translation.{f}"), filled(f"__translation.{f}"))
    joined = _translation(rows, faithfulZh=both("faithfulZh"), plainZh=both("plainZh"), status=F.lit("ai-draft"), reviewedAt=F.lit(None).cast("string"), generatedBy=F.lit("local-curator"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    got = got.withColumns({
        "fragments": F.when(hit, F.concat("fragments", "__fragments")).otherwise(F.col("fragments")), "excluded": F.when(hit, yes("excluded") & yes("__excluded")).otherwise(F.col("excluded")),
        "reviewStatus": F.when(hit, "needs-review").otherwise(F.col("reviewStatus")), "translation": F.when(hit, joined).otherwise(F.col("translation")),
    })
    return named(got.select(*rows.columns, "was_merged"), hit, rows.select("paper_id", "id")).drop("was_merged")


def utf16_prefix(text: Column, units: Column) -> Column:
    """How many code points the first `units` UTF-16 units of a text are; a pair that would be parted is left out."""
    code = F.encode(text, "UTF-16BE")
    # The first byte of a pair's first half lies between D8 and DB.
    parted = F.hex(F.substring(code, 2 * units - 1, F.lit(1))).between("D8", "DB")
    whole = units - F.when(parted, 1).otherwise(0)
    return F.length(F.decode(F.substring(code, F.lit(1), 2 * whole), "UTF-16BE"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def split_at(rows: DataFrame, key: list[str], order: str, at: Column, *, id_col: str = "id", text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Rows are cut after `at` characters (null: not cut) into `{id}-a` and `{id}-b`, where both sides have text; pieces are
    numbered by `piece`."""
    name, low = F.col(id_col).cast("string"), F.least(confidence, F.lit(0.45))
    piece = lambda k, i, t, c: F.struct(F.lit(k).alias("piece"), i.alias("i"), t.alias("t"), c.alias("c"))
    whole = F.array(piece(0, name, F.col(text), F.col(confidence)))
    parts = lambda h: F.array(piece(1, F.concat(name, F.lit("-a")), h["a"], low), piece(2, F.concat(name, F.lit("-b")), h["b"], low))
    # Elements of arrays, so that the cut and both trimmed sides are made once each.
    side = lambda start, size: trim_script(F.substring(F.col(text), start, size))
    sides = F.transform(F.array(at), lambda n: F.when(n.isNotNull(), F.struct(side(F.lit(1), n).alias("a"), side(n + 1, F.length(text)).alias("b"))))
    pieces = F.transform(sides, lambda h: F.when((F.length(h["a"]) > 0) & (F.length(h["b"]) > 0), parts(h)).otherwise(whole))
    out = rows.withColumn("__p", F.explode(F.element_at(pieces, 1)))
    return out.select(*(c for c in rows.columns if c not in (id_col, text, confidence)), F.col("__p.i").alias(id_col), F.col("__p.t").alias(text), F.col("__p.c").alias(confidence), F.col("__p.piece").alias("piece"))


def split_segments(rows: DataFrame, order: str, at: Column) -> DataFrame:
    """Whole segments are cut after `at` UTF-16 units (null, none or all of them: not cut) into two of the same boxes, where both
    sides have text: free ids `{id}-a` and `{id}-b`, confidence at most .45, untranslated, to be reviewed. `piece` numbers
    them (0: not cut)."""
    points = F.when((at > 0) & (at < utf16_length(F.col("sourceText"))), utf16_prefix(F.col("sourceText"), at))
    got = split_at(rows, ["paper_id"], order, points, text="sourceText")
    hit = F.col("piece") > 0
    blank = _translation(rows, faithfulZh=F.lit(""), plainZh=F.lit(""), status=F.lit("untranslated"), reviewedAt=F.lit(None).cast("string"), generatedBy=F.lit("local-curator"))
    got = got.withColumns({"translation": F.when(hit, blank).otherwise(F.col("translation")), "reviewStatus": F.when(hit, "needs-review").otherwise(F.col("reviewStatus"))})
    return named(got.select(*rows.columns, "piece"), hit, rows.select("paper_id", "id"))


def toggled_exclusion(segments: DataFrame, at: Column) -> DataFrame:
    hit = F.coalesce(at, F.lit(False))
    return segments.withColumns({"excluded": F.when(hit, ~F.coalesce("excluded", F.lit(False))).otherwise(F.col("excluded")), "reviewStatus": F.when(hit, "needs-review").otherwise(F.col("reviewStatus"))})


def with_source_text(segments: DataFrame, at: Column, text: Column) -> DataFrame:
    hit = F.coalesce(at, F.lit(False))
    status = translation_status(F.col("translation.faithfulZh"), F.col("translation.plainZh"))
    redone = F.col("translation").withField("status", status).withField("reviewedAt", F.lit(None).cast("string"))
    return segments.withColumns({"sourceText": F.when(hit, text).otherwise(F.col("sourceText")), "translation": F.when(hit, redone).otherwise(F.col("translation")), "reviewStatus": F.when(hit, "needs-review").otherwise(F.col("reviewStatus"))})


def with_translation(segments: DataFrame, at: Column, field: str, value: Column) -> DataFrame:
    new = F.col("translation").withField(field, value)
    new = new.withField("status", translation_status(new["faithfulZh"], new["plainZh"])).withField("reviewedAt", F.lit(None).cast("string"))
    hit = F.coalesce(at, F.lit(False))
    return segments.withColumns({"translation": F.when(hit, new).otherwise(F.col("translation")), "reviewStatus": F.when(hit, "needs-review").otherwise(F.col("reviewStatus"))})


def reviewed(segments: DataFrame, at: Column, now: Column) -> DataFrame:
    """Only a segment with both translations can be marked."""
    ok = F.coalesce(at, F.lit(False)) & ~is_blank("translation.faithfulZh") & ~is_blank("translation.plainZh")
    done = F.col("translation").withField("status", F.lit("reviewed")).withField("reviewedAt", now)
    return segments.withColumns({"translation": F.when(ok, done).otherwise(F.col("translation")), "reviewStatus": F.when(ok, "reviewed").otherwise(F.col("reviewStatus"))})


def with_section(segments: DataFrame, at: Column, section: Column) -> DataFrame:
    hit = F.coalesce(at, F.lit(False))
    return segments.withColumns({"section": F.when(hit, section).otherwise(F.col("section")), "reviewStatus": F.when(hit, "needs-review").otherwise(F.col("reviewStatus"))})


def swapped(rows: DataFrame, order: str, at: int) -> DataFrame:
    """The row at this order and its successor change places."""
    return rows.withColumn(order, F.when(F.col(order) == at, at + 1).when(F.col(order) == at + 1, at).otherwise(F.col(order)))


def edited(document: DataFrame) -> DataFrame:
    """Any edit makes a document a draft of now."""
    return document.withColumns({"publicationStatus": F.lit("draft"), "generatedAt": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})


def reverted(stored: DataFrame, paper_ids: list[str]) -> DataFrame:
    """Stored documents without those whose local edits are discarded."""
    return stored.filter(~F.col("paper_id").isin(paper_ids))
