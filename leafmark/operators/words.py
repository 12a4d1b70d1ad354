"""Words on lines: coherence of their order, stretches, protected lines, as-of joins to verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(tokens: DataFrame, starts: DataFrame, scheme: str, token: str, start: str, carried: list[str], width: int = 1 << 16) -> DataFrame:
    """Each token with the last start at or before it in its scheme; null before the first.

    Tokens and starts fall into ranges of `width` numbers, and windows stay in a range; the last start before a range comes from one
    window over the ranges of a scheme, which are a `width`th of its tokens at most. No range join, no broadcast."""
    held = F.struct(F.col(start).alias("at"), *carried)
    right = starts.select(F.col(scheme), F.floor(F.col(start) / width).alias("range"), held.alias("held"))
    left = tokens.withColumn("range", F.floor(F.col(token) / width))
    last = right.groupBy(scheme, "range").agg(F.max("held").alias("last"))
    ranges = left.select(scheme, "range").distinct().join(last, [scheme, "range"], "full")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(scheme).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carry = ranges.select(scheme, "range", before.alias("before"))
    both = left.select(scheme, "range", F.col(token).alias("at"), F.struct(*tokens.columns).alias("row"), F.lit(None).cast(right.schema["held"].dataType).alias("held"))
    both = both.unionByName(right.select(scheme, "range", F.col("held.at").alias("at"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), "held"))
    # a start comes before the tokens with its number
    w = Window.partitionBy(scheme, "range").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.last("held", ignorenulls=True).over(w)).filter("row is not null").join(carry, [scheme, "range"])
    value = F.coalesce("inside", "before")
    return found.select("row.*", *(value[c].alias(c) for c in carried))


def out_of_sequence(words: DataFrame) -> DataFrame:
    """Labelled words that come before a smaller id of their line's order."""
    w = Window.partitionBy("page_id", "line_number").orderBy("position")
    some = words.filter("word_id is not null").withColumn("previous", F.lag("word_id").over(w))
    return some.filter("word_id < previous").select("page_id", "line_number", "position", "word_id", "previous")


def overlaps(words: DataFrame) -> DataFrame:
    """Words of a page met on an earlier line too, with the latest such line."""
    w = Window.partitionBy("page_id", "word_id").orderBy("line_number").rangeBetween(Window.unboundedPreceding, -1)
    some = words.filter("word_id is not null").withColumn("earlier_line", F.max("line_number").over(w))
    return some.filter("earlier_line is not null").select("page_id", "line_number", "position", "word_id", "earlier_line")


def line_gaps(words: DataFrame, most: int = 20) -> DataFrame:
    """Ids missing between the last word of a line and the first of the next, the first `most` of them listed."""
    line = words.filter("word_id is not null").groupBy("page_id", "line_number").agg(F.min_by("word_id", "position").alias("first_id"), F.max_by("word_id", "position").alias("last_id"))
    w = Window.partitionBy("page_id").orderBy("line_number")
    line = line.withColumn("before", F.lag("last_id").over(w)).filter("first_id > before + 1")
    return line.select("page_id", "line_number", "before", "first_id", (F.col("first_id") - F.col("before") - 1).alias("n_missing"), F.array_join(F.sequence(F.col("before") + 1, F.least(F.col("first_id") - 1, F.col("before") + most)).cast("array<string>"), ",").alias("missing"))


def stretches(words: DataFrame, span: int = 50) -> DataFrame:
    """Runs of words of one verse (word_id div span) in reading order; unlabelled words join the run before."""
    order = Window.partitionBy("page_id").orderBy("line_number", "position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    verse = F.last(F.floor(F.col("word_id") / span), ignorenulls=True).over(upto)
    rows = words.withColumn("verse", verse)
    changed = F.when(F.lag("verse").over(order).eqNullSafe(F.col("verse")), 0).otherwise(1)
    runs = rows.withColumn("changed", changed).withColumn("stretch", F.sum("changed").over(upto))
    return runs.groupBy("page_id", "stretch").agg(F.first("verse").alias("verse"), F.count("*").alias("drawn"), F.count("word_id").alias("pinned"), F.min("word_id").alias("least_id"), F.max("word_id").alias("greatest_id"))


def unprotected(lines: DataFrame, status: DataFrame, words: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Lines that no human edit, unstated words or confirmed page protects."""
    key = ["page_id", "line_number"]
    edited = status.filter("edited").select(*key)
    unstated = words.select(*key).distinct().join(status, key, "left_anti")
    return lines.join(edited.unionByName(unstated).distinct(), key, "left_anti").join(confirmed, "page_id", "left_anti")


_ROW = "struct<word_id:bigint,start_x:bigint,end_x:bigint,ord:bigint>"


def placed(labelled: DataFrame, free: DataFrame, key: list[str]) -> DataFrame:
    """All words of each line with their position: labelled ones by id, each unlabelled one before the first word that ends left of it,
    or last; those put in take part for the ones after.

    Both frames: key, word_id, start_x, end_x, ord (which decides between equal ids, and the order in which unlabelled words come).
    A place depends on the words put in before, so this is a fold over a line's few unlabelled words."""

    a = labelled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_id", "ord", "start_x", "end_x"))).alias("a"))
    b = free.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", F.lit(None).cast("long").alias("word_id"), "start_x", "end_x"))).alias("b"))

    none = F.expr(f"cast(array() AS array<{_ROW}>)")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["word_id"].alias("word_id"), x["start_x"].alias("start_x"), x["end_x"].alias("end_x"), x["ord"].alias("ord")))

    def step(acc, x):
        before = F.array_position(F.transform(acc, lambda r: r["end_x"] < x["end_x"]), F.lit(True))
        at = F.when(before > 0, before - 1).otherwise(F.size(acc)).cast("int")
        return F.concat(F.slice(acc, F.lit(1), at), F.array(x), F.slice(acc, at + 1, F.size(acc)))

    both = a.join(b, key, "full").select(*key, F.coalesce(plain("a"), none).alias("a"), F.coalesce(plain("b"), none).alias("b"))
    made = both.select(*key, F.posexplode(F.aggregate("b", F.col("a"), step)).alias("position", "r"))
    return made.select(*key, F.col("position").cast("long").alias("position"), "r.word_id", "r.start_x", "r.end_x")


KEY = ["page_id", "line_number"]


def saved_placements(held: DataFrame, fresh: DataFrame, lines: DataFrame, protected: DataFrame, first: int, last: int, origin: int) -> tuple[DataFrame, DataFrame]:
    """Words of the touched lines after a run's placements are saved, and each touched line's status.

    Protected lines stay out. On the others the run's word range is cleared, whatever it found again; unlabelled words that end where a
    fresh one does go; the rest keep their place among the fresh ones. A line counts as edited if unlabelled words survive on it.
    fresh: (page_id, line_number, word_id, start_x, end_x) in image x; lines: (page_id, line_number, status) of the run."""
    touched = lines.join(protected, KEY, "left_anti")
    new = fresh.join(touched.select(*KEY), KEY, "left_semi").select(*KEY, "word_id", (F.col("start_x") + origin).alias("start_x"), (F.col("end_x") + origin).alias("end_x"), F.lit(-1).cast("long").alias("ord"))
    on = held.join(touched.select(*KEY), KEY, "left_semi").select(*KEY, "word_id", "start_x", "end_x", F.col("position").cast("long").alias("ord"))
    kept = on.filter(~F.coalesce(F.col("word_id").between(first, last), F.lit(False)))
    free = kept.filter("word_id is null").join(new.select(*KEY, "end_x"), [*KEY, "end_x"], "left_anti").select(*KEY, "word_id", "start_x", "end_x", "ord")
    words = placed(kept.filter("word_id is not null").unionByName(new), free, KEY)
    edited = free.select(*KEY).distinct().withColumn("edited", F.lit(True))
    n = new.groupBy(*KEY).agg(F.count("*").alias("written"))
    status = touched.join(edited, KEY, "left").join(n, KEY, "left").select(*KEY, "status", F.coalesce("edited", F.lit(False)).alias("edited"), F.coalesce("written", F.lit(0)).alias("written"), ((F.col("status") == "unresolved") & F.col("written").isNull()).alias("open"))
    return words, status


def replaced_words(held: DataFrame, lines: DataFrame) -> DataFrame:
    """All words after those of the named lines are replaced by given ones in their order; these lines are marked edited.

    lines: (page_id, line_number, words), an array of (word_id, start_x, end_x); an empty one clears a line."""
    new = lines.select(*KEY, F.posexplode("words").alias("position", "w")).select(*KEY, F.col("position").cast("int").alias("position"), "w.word_id", "w.start_x", "w.end_x", F.lit(True).alias("edited"))
    old = held.join(lines.select(*KEY), KEY, "left_anti").select(*KEY, "position", "word_id", "start_x", "end_x", F.lit(False).alias("edited"))
    return old.unionByName(new)


def relabelled(words: DataFrame, pins: DataFrame) -> DataFrame:
    """Labelled slots of each stretch counted on from its pin; beyond the last pinned id, and without a pin, slots lose their id.

    words: (page_id, stretch, line_number, position, word_id), null for unlabelled slots, which keep none; pins: (page_id, stretch, first, last)."""
    w = Window.partitionBy("page_id", "stretch").orderBy("line_number", "position").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("word_id").over(w)
    both = words.withColumn("n", n).join(pins, ["page_id", "stretch"], "left").withColumn("next", F.col("first") + F.col("n"))
    new = F.when(F.col("word_id").isNotNull() & (F.col("last").isNull() | (F.col("next") <= F.col("last"))), F.col("next"))
    return both.select("page_id", "stretch", "line_number", "position", new.alias("word_id"))


def archived(history: DataFrame, words: DataFrame, hand_made: DataFrame) -> DataFrame:
    """New rows of the history: hand-made lines whose words differ from the last archived ones. history: (page_id, line_number, number, digest)."""
    one = F.sort_array(F.collect_list(F.struct("position", F.coalesce("word_id", F.lit(-1)).alias("word_id"), "start_x", "end_x")))
    now = words.join(hand_made, KEY, "left_semi").groupBy(*KEY).agg(F.sha2(F.to_json(one), 256).alias("digest"))
    last = history.groupBy(*KEY).agg(F.max(F.struct("number", "digest")).alias("h"))
    both = now.join(last, KEY, "left").filter(~F.col("h.digest").eqNullSafe(F.col("digest")))
    return both.select(*KEY, (F.coalesce("h.number", F.lit(0)) + 1).alias("number"), "digest")


def overlaid(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines with the last edit of each put over what was read: the last editor of a line wins. edits: (page_id, line_number, edited_at, value)."""
    last = edits.groupBy(*KEY).agg(F.max(F.struct("edited_at", F.col("value").alias("new_value"))).alias("e"))
    both = lines.join(last, KEY, "left")
    return both.select(*KEY, F.coalesce("e.new_value", "value").alias("value"), F.col("e").isNotNull().alias("by_hand"))
