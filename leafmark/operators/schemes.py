"""Counting schemes: one running index of tokens, and lists of verse starts in it; look-ups, spans, checks and reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import dealt

#: Chapters whose sizes one window adds up; the sums of these groups are added up in a second, smaller one.
GROUP = 1024


def number(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")


def first_tokens(verses: DataFrame) -> DataFrame:
    """Verses (chapter, verse, n_words) with `start`: 1 + the tokens before them in the whole text.

    Sizes are added up in three levels (verses in a chapter, chapters in a group, groups), so no window holds the text."""
    size = verses.groupBy("chapter").agg(F.sum("n_words").alias("size")).withColumn("group", F.floor(F.col("chapter") / GROUP))
    upto = (Window.unboundedPreceding, -1)
    in_group = F.coalesce(F.sum("size").over(Window.partitionBy("group").orderBy("chapter").rowsBetween(*upto)), F.lit(0))
    groups = size.groupBy("group").agg(F.sum("size").alias("whole"))
    offset = F.coalesce(F.sum("whole").over(Window.orderBy("group").rowsBetween(*upto)), F.lit(0))  # one row for each GROUP chapters
    chapters = size.withColumn("in_group", in_group).join(groups.select("group", offset.alias("offset")), "group")
    in_chapter = F.coalesce(F.sum("n_words").over(Window.partitionBy("chapter").orderBy("verse").rowsBetween(*upto)), F.lit(0))
    return verses.withColumn("in_chapter", in_chapter).join(chapters.select("chapter", (F.col("offset") + F.col("in_group")).alias("before")), "chapter").select("chapter", "verse", "n_words", (1 + F.col("before") + F.col("in_chapter")).alias("start"))


def _counts(scheme: str = "scheme") -> Column:
    return F.array_contains(F.split("counted_by", ","), F.col(scheme))


def scheme_starts(starts: DataFrame, deltas: DataFrame, schemes: list[str], parts: int | None = None) -> DataFrame:
    """(scheme, chapter, number, start): where each scheme's verses start.

    A verse stops at each end that the scheme doesn't opt out of and at each split that it opts in to; the next starts there. A
    chapter always ends where it ends, so numbers and starts are found chapter by chapter."""
    found = deltas.groupBy("chapter", "verse").agg(F.collect_list(F.struct("kind", "after_position", "counted_by")).alias("found"))
    first = F.min("start").over(Window.partitionBy("chapter"))
    rows = starts.filter("chapter is not null").select("chapter", "verse", "start", "n_words", first.alias("first")).join(found.hint("shuffle_hash"), ["chapter", "verse"], "left")
    rows = dealt(rows, parts, "chapter")
    rows = rows.select("*", F.explode(F.array(*(F.lit(s) for s in schemes))).alias("scheme"))
    of = lambda kind: F.filter("found", lambda d: d["kind"] == kind)
    counts = lambda d: F.array_contains(F.split(d["counted_by"], ","), F.col("scheme"))
    end = F.col("start") + F.col("n_words")
    ends = F.transform(F.filter(of("end"), lambda d: d["counted_by"].isNull() | counts(d)), lambda d: end)
    inside = F.transform(F.filter(of("internal"), counts), lambda d: F.col("start") + d["after_position"])
    # a verse without deltas, as most are, ends where it ends
    stops = F.when(F.col("found").isNull(), F.array(end)).otherwise(F.concat(F.when(F.size(of("end")) == 0, F.array(end)).otherwise(ends), inside))
    rows = rows.select("scheme", "chapter", "first", F.explode(stops).alias("stop"))
    w = Window.partitionBy("scheme", "chapter").orderBy("stop")
    return rows.select("scheme", "chapter", number(["scheme", "chapter"], ["stop"]).alias("number"), F.coalesce(F.lag("stop").over(w), "first").alias("start"))


def open_chapters(starts: DataFrame, deltas: DataFrame, schemes: list[str]) -> DataFrame:
    """(scheme, chapter, verse) of last verses that a scheme opts out of: an error, as no verse runs into the next chapter."""
    last = starts.groupBy("chapter").agg(F.max("verse").alias("verse"))
    named = F.explode(F.array(*(F.lit(s) for s in schemes))).alias("scheme")
    ends = deltas.filter("kind = 'end'").join(last, ["chapter", "verse"], "left_semi").select("chapter", "verse", "counted_by", named)
    return ends.filter(~_counts()).select("scheme", "chapter", "verse")


def with_ends(starts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Verse starts with `last`, their last token: the one before the next start, or the chapter's last one. chapters: (chapter, last_token)."""
    following = F.lead("start").over(Window.partitionBy("scheme", "chapter").orderBy("start"))
    return starts.withColumn("next", following).join(chapters, "chapter", "left").select(*starts.columns, F.coalesce(F.col("next") - 1, F.col("last_token")).alias("last"))


def resolved_spans(spans: DataFrame, verses: DataFrame, parts: int | None = None) -> DataFrame:
    """Spans (scheme, from_chapter, from_number, to_chapter, to_number) with status and tokens. verses: see with_ends.

    A missing verse and a span that runs backwards are told apart."""
    a = verses.select("scheme", F.col("chapter").alias("from_chapter"), F.col("number").alias("from_number"), F.col("start").alias("first_token"))
    b = verses.select("scheme", F.col("chapter").alias("to_chapter"), F.col("number").alias("to_number"), F.col("last").alias("last_token"))
    both = spans
    for side, key in ((a, ["scheme", "from_chapter", "from_number"]), (b, ["scheme", "to_chapter", "to_number"])):
        both = dealt(both, parts, *key).join(dealt(side, parts, *key), key, "left")
    status = F.when(F.col("first_token").isNull(), "missing_start").when(F.col("last_token").isNull(), "missing_end").when(F.col("last_token") < F.col("first_token"), "backwards").otherwise("ok")
    return both.withColumn("status", status).withColumn("n_tokens", F.when(F.col("status") == "ok", F.col("last_token") - F.col("first_token") + 1))


def verses_between(spans: DataFrame, verses: DataFrame) -> DataFrame:
    """(span_id, chapter, verse) of the verses from one to another, both included; chapters may be crossed."""
    each = spans.withColumn("chapter", F.explode(F.sequence("from_chapter", "to_chapter")))
    inside = F.struct("chapter", "verse").between(F.struct(F.col("from_chapter"), F.col("from_verse")), F.struct(F.col("to_chapter"), F.col("to_verse")))
    return each.join(verses.select("chapter", "verse"), "chapter").filter(inside).select("span_id", "chapter", "verse")


def tiling_problems(starts: DataFrame, schemes: list[str], chapters: DataFrame, parts: int | None = None) -> DataFrame:
    """(scheme, problem, n): starts that don't begin at 1 or repeat, schemes without verses, chapters without a first verse, and
    chapters that start on different tokens in different schemes (scheme null)."""
    each = dealt(starts, parts, "scheme", "start").groupBy("scheme", "start").agg(F.count("*").alias("n"))
    by = each.groupBy("scheme").agg(F.min("start").alias("first"), F.sum(F.col("n") - F.when(F.col("start").isNull(), 0).otherwise(1)).alias("repeats"))
    first = by.filter("first <> 1").select("scheme", F.lit("first_start").alias("problem"), F.col("first").alias("n"))
    repeats = by.filter("repeats > 0").select("scheme", F.lit("repeated_start").alias("problem"), F.col("repeats").alias("n"))
    wanted = starts.sparkSession.createDataFrame([(s,) for s in schemes], "scheme string")
    lost = wanted.join(by, "scheme", "left_anti").select("scheme", F.lit("no_verses").alias("problem"), F.lit(0).cast("long").alias("n"))
    begins = starts.filter("number = 1").groupBy("chapter").agg(F.count_distinct("start").alias("places"))
    moved = begins.filter("places > 1").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("scheme"), F.lit("chapter_start").alias("problem"), "n")
    none = chapters.join(begins, "chapter", "left_anti").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("scheme"), F.lit("no_first_verse").alias("problem"), "n")
    return first.unionAll(repeats).unionAll(lost).unionAll(moved).unionAll(none)


def chain(editions: DataFrame, traditions: DataFrame, schemes: DataFrame) -> DataFrame:
    """Editions with their tradition and its scheme; either may be missing, which is flagged."""
    both = editions.join(F.broadcast(traditions), "tradition_id", "left").join(F.broadcast(schemes), "scheme", "left")
    return both.select("edition", "tradition", F.when(F.col("known"), F.col("scheme")).alias("scheme"), F.coalesce("known", F.lit(False)).alias("has_scheme"))


def chapter_counts(chapters: DataFrame, starts: DataFrame, editions: DataFrame) -> DataFrame:
    """Each edition's chapters with their number of verses in its scheme, null where the scheme is unknown."""
    n = starts.groupBy("scheme", "chapter").agg(F.count("*").alias("n_verses"))
    every = chapters.select("chapter").crossJoin(F.broadcast(editions.select("edition", "scheme")))  # a few editions
    return every.join(n, ["scheme", "chapter"], "left").select("edition", "chapter", "n_verses")


def scheme_totals(starts: DataFrame) -> DataFrame:
    return starts.groupBy("scheme").agg(F.count("*").alias("n_verses"), F.count_distinct("chapter").alias("n_chapters"))


def next_verses(starts: DataFrame) -> DataFrame:
    """Each verse with the one after it: in its chapter, or the first of the next chapter; null at the end."""
    rolled = starts.select("scheme", "chapter").distinct().select("scheme", (F.col("chapter") - 1).alias("chapter"), F.col("chapter").alias("rolled"))
    last = F.max("number").over(Window.partitionBy("scheme", "chapter"))
    # one row a chapter is hashed, the verses stream past it
    both = starts.withColumn("last_number", last).join(rolled.hint("shuffle_hash"), ["scheme", "chapter"], "left")
    inside = F.col("number") < F.col("last_number")
    return both.select("scheme", "chapter", "number", F.when(inside, F.col("chapter")).otherwise(F.col("rolled")).alias("next_chapter"), F.when(inside, F.col("number") + 1).when(F.col("rolled").isNotNull(), F.lit(1)).cast("long").alias("next_number"))


def count_differences(built: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Two sets of counts side by side where they differ, either side null where it has none."""
    both = built.select(*keys, F.col("n").alias("built")).join(expected.select(*keys, F.col("n").alias("expected")), keys, "full")
    return both.filter(~F.col("built").eqNullSafe(F.col("expected")))


def seed_totals(words: DataFrame, index: DataFrame, starts: DataFrame) -> DataFrame:
    """(total, n) of what was built: word rows, their pieces, the running index's end, and each scheme's verses.

    words: word rows with pieces; index: verses with start and n_words; starts: scheme, number."""
    one = words.agg(F.count("*").alias("words"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"))
    out = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("total"), F.col(c).cast("long").alias("n")) for c in ("words", "pieces")))).alias("t")).select("t.*")
    end = index.agg(F.coalesce(F.max(F.col("start") + F.col("n_words") - 1), F.lit(0)).alias("n")).select(F.lit("index").alias("total"), F.col("n").cast("long").alias("n"))
    return out.unionAll(end).unionAll(starts.groupBy("scheme").agg(F.count("*").alias("n")).select(F.concat(F.lit("verses:"), "scheme").alias("total"), "n"))


def missing_members(required: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Required members that aren't held."""
    return required.select(key).exceptAll(held.select(key).distinct()).distinct()


def problem_list(**parts: DataFrame) -> DataFrame:
    """Problems of several checks as one list (kind, subject, detail)."""
    out = None
    for kind, df in parts.items():
        subject, *rest = df.columns
        one = df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.concat_ws(" ", *(F.col(c).cast("string") for c in rest)).alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def compared_places(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each of our boundaries, by (chapter, verse, kind, word), with the other source's place: agree, shifted or missing.

    Both: chapter, verse, kind, word, position; of several of theirs with one key the last counts, and each of ours is looked up."""
    key = ["chapter", "verse", "kind", "word"]
    last = theirs.groupBy(*key).agg(F.max("position").alias("theirs"))
    both = ours.select(*key, F.col("position").alias("ours")).join(last, key, "left")
    return both.withColumn("state", F.when(F.col("theirs").isNull(), "missing").when(F.col("ours") == F.col("theirs"), "agree").otherwise("shifted"))


def place_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """How many of our boundaries of each kind agree with another source, are shifted, or missing there, and how many of theirs we lack."""
    key = ["chapter", "verse", "kind", "word"]
    rows = compared_places(ours, theirs).select("kind", "state").unionAll(theirs.select(*key).distinct().join(ours, key, "left_anti").select("kind", F.lit("lacking").alias("state")))
    n = lambda s: F.count_if(F.col("state") == s)
    return rows.groupBy("kind").agg(n("agree").alias("agree"), n("shifted").alias("shifted"), n("missing").alias("missing_theirs"), n("lacking").alias("missing_ours"))


def stream_starts(tokens: DataFrame) -> DataFrame:
    """Positions of a chapter's stream at which a verse begins, and its end as one more row without a verse."""
    w = Window.partitionBy("chapter").orderBy("pos")
    begins = tokens.withColumn("before", F.lag("verse").over(w)).filter(~F.col("before").eqNullSafe(F.col("verse"))).select("chapter", "pos", "verse")
    ends = tokens.groupBy("chapter").agg((F.max("pos") + 1).alias("pos")).withColumn("verse", F.lit(None).cast("long"))
    return begins.unionByName(ends)


def numbered_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """chapter|verse|text lines as (line, chapter, verse, words, error); blank lines and those that begin with # are left out.

    A missing part, a key that isn't digits or a text without words names an error instead of stopping the read."""
    row = F.trim(F.regexp_replace(value, r"^[ \t\r]+|[ \t\r]+$", ""))
    parts = lines.withColumn("line", row).filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("parts", F.split("line", r"\|", 3))
    key = [F.get("parts", F.lit(k)) for k in range(3)]
    words = F.regexp_extract_all(F.coalesce(key[2], F.lit("")), F.lit(r"[^ \t\n\r]+"), F.lit(0))
    error = F.when(key[2].isNull(), "missing_part").when(~key[0].rlike("^[0-9]+$") | ~key[1].rlike("^[0-9]+$"), "bad_key").when(F.size(words) == 0, "no_words")
    return parts.select("line", F.when(error.isNull(), key[0].try_cast("long")).alias("chapter"), F.when(error.isNull(), key[1].try_cast("long")).alias("verse"), F.when(error.isNull(), words).alias("words"), error.alias("error"))


def read_numbered_text(spark, path: str) -> DataFrame:
    """A file or folder of numbered text; order comes from the keys, not from the file."""
    return numbered_text(spark.read.text(path))


def boundary_rows(documents: DataFrame, value: str = "value") -> DataFrame:
    """Boundary documents in JSON as one row for each scheme that counts a boundary."""
    shape = "struct<chapter:bigint,verse:bigint,kind:string,after_position:bigint,counted_by:array<string>>"
    return documents.select(F.from_json(value, shape).alias("b")).select("b.chapter", "b.verse", "b.kind", "b.after_position", F.posexplode("b.counted_by").alias("ord", "scheme"))


def upsert(old: DataFrame, new: DataFrame, known: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """old with the rows of new put in by natural key: rows held keep their id, and rows of an unknown group are skipped."""
    fresh = new.join(F.broadcast(known.select(group).distinct()), group, "left_semi").select(key, F.col("id").alias("new_id"), F.col(value).alias("new_value"))
    both = old.select(key, F.col("id").alias("old_id"), F.col(value).alias("old_value")).join(fresh, key, "full")
    action = F.when(F.col("old_id").isNull(), "inserted").when(F.col("new_id").isNull(), "kept").otherwise("updated")
    return both.select(key, F.coalesce("old_id", "new_id").alias("id"), F.coalesce("new_value", "old_value").alias(value), action.alias("action"))


def listing(editions: DataFrame, language: str = "own") -> DataFrame:
    """Editions in the order of their names without regard to case, with the label in a language, empty where there is none."""
    label = F.coalesce(F.col("label_own") if language == "own" else F.col("label_other"), F.lit(""))
    return editions.select(number([], [F.lower("name"), "name"]).alias("place"), "name", label.alias("label"))


def dropped_marks(tokens: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions that count tokens without letters too, corrected to count words only."""
    # only whether a token has letters goes to its verse
    lettered = tokens.select("chapter", "verse", "pos", F.col("token").rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]").alias("lettered"))
    words = lettered.groupBy("chapter", "verse").agg(F.sort_array(F.collect_list(F.struct("pos", "lettered"))).alias("t"))
    n = F.size(F.filter(F.slice("t", 1, F.col("position").cast("int")), lambda x: x["lettered"])).cast("long")
    return positions.join(words, ["chapter", "verse"]).select("chapter", "verse", "position", n.alias("corrected"))
