"""Review of measured ink: edges and boxes of words, flags, checks of edits, what a confirmation must acknowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.ranges import range_join_binned

#: Scores that are neither clearly a body's nor clearly a mark's; most pieces of one body.
UNCERTAIN, MOST_PIECES = range(6, 10), 8
EXCEPTIONS = ["", "flagged", "damaged", "unreadable"]


def edges_from_ink(allocations: DataFrame) -> DataFrame:
    """(line, word_id, start_x, end_x): each word's right and left edge from its ink; words without room have none.

    In ink shared with the word before, a word starts at its middle; in ink shared with the word after, it ends there."""
    w = Window.partitionBy("line", "label")
    rows = allocations.withColumns({"first": F.min("word_id").over(w), "last": F.max("word_id").over(w), "middle": F.col("x") + F.floor(F.col("w") / 2)})
    right = F.when(F.col("first") < F.col("word_id"), F.col("middle")).otherwise(F.col("x") + F.col("w"))
    left = F.when(F.col("last") > F.col("word_id"), F.col("middle")).otherwise(F.col("x"))
    return rows.groupBy("line", "word_id").agg(F.max(right).alias("start_x"), F.min(left).alias("end_x")).filter("start_x > end_x")


def fitted_words(words: DataFrame, allocations: DataFrame) -> DataFrame:
    """Boxes of words, widened to the ink that each owns alone; unlabelled words stay."""
    w = Window.partitionBy("line", "label")
    alone = allocations.withColumn("owners", F.max("word_id").over(w) - F.min("word_id").over(w)).filter("owners = 0")
    own = alone.groupBy("line", "word_id").agg(F.max(F.col("x") + F.col("w")).alias("right"), F.min("x").alias("left"))
    both = words.join(own, ["line", "word_id"], "left")
    return both.select("line", "word_id", F.greatest("start_x", "right").alias("start_x"), F.least("end_x", "left").alias("end_x"))


def eligible(components: DataFrame) -> DataFrame:
    """Components that may be examples: bodies and marks without an exception; a body with owners only if its pieces are one."""
    text = F.col("role").isin("body", "mark") & (F.coalesce("exception", F.lit("")) == "")
    pieces = F.aggregate("allocations", F.lit(0).cast("long"), lambda s, a: s + a["pieces"])
    return components.filter(text & ((F.col("role") != "body") | (F.size("allocations") == 0) | (pieces == 1)))


def typed(components: DataFrame) -> DataFrame:
    """Marks with a type that a person gave; a type without a note of who gave it counts as given."""
    return components.filter((F.col("role") == "mark") & (F.coalesce("subtype", F.lit("")) != "") & F.coalesce("subtype_explicit", F.lit(True)))


def hand_made(lines: DataFrame, status: DataFrame, words: DataFrame) -> DataFrame:
    """Lines that a hand edited, or that have words without a status."""
    key = ["page_id", "line_number"]
    held = words.select(*key).distinct().withColumn("has_words", F.lit(True))
    both = lines.select(*key).join(status.select(*key, "status", "edited"), key, "left").join(held, key, "left")
    return both.filter(F.coalesce("edited", F.lit(False)) | (F.col("status").isNull() & F.coalesce("has_words", F.lit(False)))).select(*key)


def attention(components: DataFrame) -> DataFrame:
    """(line, label, flags): why a component deserves a look, in fixed order."""
    text = F.col("role").isin("body", "mark") & ~(F.col("explicit") | F.col("ownership_explicit"))
    flags = F.array_compact(F.array(
        F.when(text & F.col("body_score").isin(*UNCERTAIN), "uncertain"),
        F.when(text & ~F.col("explicit") & (F.col("role") != F.col("initial_role")), "search-override"),
        F.when(text & (F.col("proposed_role") != F.col("role")), "calibration-disagreement"),
        F.when(text & F.col("ambiguous"), "ambiguous"),
        F.when(F.col("cut"), "span-boundary"),
        F.when(F.col("conflict"), "constraint-conflict"),
        F.when(F.col("released") & ~F.col("explicit"), "released-lock"),
    ))
    return components.select("line", "label", flags.alias("flags"))


def edit_faults(edits: DataFrame) -> DataFrame:
    """(line, label, faults) of refused edits. edits: initial_role, role, exception, allocations of (word_id, pieces, place, verse); an
    unknown word has no place."""
    structural = F.col("initial_role").isin("ornament", "symbol")
    a = F.col("allocations")
    ids, places = F.transform(a, lambda x: x["word_id"]), F.transform(a, lambda x: x["place"])
    distinct_verses = F.size(F.array_distinct(F.transform(a, lambda x: x["verse"])))
    together = (F.col("role") == "body") & (F.array_max(places) - F.array_min(places) + 1 == F.size(a)) & (distinct_verses == 1)
    faults = F.array_compact(F.array(
        F.when((structural & (F.col("role") != F.col("initial_role"))) | (~structural & ~F.col("role").isin("body", "mark")), "role"),
        F.when(~F.coalesce("exception", F.lit("")).isin(*EXCEPTIONS), "exception"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_word"),
        F.when(F.exists(places, lambda p: p.isNull()), "unknown_word"),
        F.when((F.size(a) > 1) & ~F.coalesce(together, F.lit(False)), "not_joinable"),
        F.when(F.exists(a, lambda x: ~x["pieces"].between(0, MOST_PIECES) | ((F.col("role") != "body") & (x["pieces"] != 0))), "pieces"),
    ))
    return edits.select("line", "label", faults.alias("faults")).filter(F.size("faults") > 0)


def edit_set_faults(stored: DataFrame, incoming: DataFrame, words: DataFrame) -> DataFrame:
    """(line, fault, item): components missing from or strange to the stored set, words given twice, and boxes without width."""
    both = stored.select("line", "label", F.lit(1).alias("s")).join(incoming.select("line", "label", F.lit(1).alias("i")).distinct(), ["line", "label"], "full")
    sets = both.filter("s is null or i is null").select("line", F.when(F.col("s").isNull(), "strange").otherwise("missing").alias("fault"), F.col("label").cast("long").alias("item"))
    twice = words.filter("word_id is not null").groupBy("line", "word_id").agg(F.count("*").alias("n")).filter("n > 1").select("line", F.lit("word_twice").alias("fault"), F.col("word_id").alias("item"))
    thin = words.filter("start_x <= end_x").select("line", F.lit("no_width").alias("fault"), F.coalesce("word_id", F.lit(-1)).alias("item"))
    return sets.unionAll(twice).unionAll(thin)


def partitioned(components: DataFrame, spans: DataFrame) -> DataFrame:
    """Components by the first span that holds their centre, right to left: span, group and bodies before the group; all null if none does.

    A group ends where the span changes or a component outside all spans comes between. spans: (line, ord, left, right)."""
    centre = 2 * F.col("x") + F.col("w")
    s = spans.select("line", "ord", "left", "right")
    held = components.join(s, "line").filter(centre.between(2 * F.col("left"), 2 * F.col("right"))).groupBy("line", "label").agg(F.min("ord").alias("span"))
    order = Window.partitionBy("line").orderBy(F.desc(F.col("x") + F.col("w")), "label")
    rows = components.join(held, ["line", "label"], "left").withColumn("new", F.when(F.col("span").isNotNull() & ~F.lag("span").over(order).eqNullSafe(F.col("span")), 1).otherwise(0))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    outside = F.sum(F.when(F.col("span").isNull() & (F.col("role") == "body"), 1).otherwise(0)).over(upto)
    inside = F.col("span").isNotNull()
    return rows.withColumns({"group": F.when(inside, F.sum("new").over(upto)), "bodies_before": F.when(inside, outside)}).select("line", "label", "span", "group", "bodies_before")


def outside_verse(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Labelled words whose left edge lies outside their verse's segment of the line, where it has one; of several the last counts."""
    key = ["page_id", "line_number", "verse"]
    last = segments.filter("verse is not null").groupBy(*key).agg(F.max_by(F.struct("x", "w"), "segment_order").alias("s"))
    both = words.filter("word_id is not null").join(last, key)
    left, right = F.col("s.x"), F.col("s.x") + F.col("s.w")
    return both.filter(~F.col("end_x").between(left, right)).select(*key, "position", "word_id", "end_x", left.alias("left"), right.alias("right"))


def confirmation_exceptions(components: DataFrame, allocations: DataFrame, words: DataFrame, status: DataFrame) -> DataFrame:
    """(line, kind, item, detail): flagged components, words whose pieces don't add up, and lines that stayed open."""
    flagged = components.filter("exception <> ''").select("line", F.lit("flagged").alias("kind"), F.col("label").cast("long").alias("item"), F.col("exception").alias("detail"))
    got = allocations.filter("role = 'body'").groupBy("line", "word_id").agg(F.sum("pieces").alias("got"))
    counts = words.filter("word_id is not null").join(got, ["line", "word_id"], "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got <> expected")
    counts = counts.select("line", F.lit("pieces").alias("kind"), F.col("word_id").alias("item"), F.concat_ws("/", F.col("got").cast("string"), F.col("expected").cast("string")).alias("detail"))
    open_ = status.filter("status in ('partial', 'unresolved')").select("line", F.lit("open").alias("kind"), F.lit(None).cast("long").alias("item"), F.coalesce("reason", F.lit("")).alias("detail"))
    return flagged.unionAll(counts).unionAll(open_)


def line_rollup(commits: DataFrame) -> DataFrame:
    """Each line's cost, ties, deviations, reasons and status from the pieces of reading committed to it."""
    reasons = F.array_compact(F.array(F.when(F.col("missed"), "boundary missed"), F.when(F.col("deviations") > 0, F.concat_ws(" ", F.col("deviations").cast("string"), F.lit("word(s) off count"))), F.when(F.col("ties") > 1, F.concat_ws(" ", F.col("ties").cast("string"), F.lit("equal readings")))))
    each = commits.withColumn("reasons", reasons)
    by = each.groupBy("line").agg(F.max("cost").alias("cost"), F.max("ties").alias("ties"), F.sum("deviations").alias("deviations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("r"))
    return by.select("line", "cost", "ties", "deviations", F.when(F.size("r") > 0, F.array_join("r", "; ")).alias("reason"), F.when(F.size("r") > 0, "scored").otherwise("exact").alias("status"))


def reading_events(components: DataFrame, ornaments: DataFrame) -> DataFrame:
    """Components, ornaments and line ends as one sequence from the right; an ornament goes first at an equal edge."""
    a = components.select("line", (F.col("x") + F.col("w")).alias("right"), F.lit(1).alias("kind"), F.col("label").cast("long").alias("item"))
    b = ornaments.select("line", "right", F.lit(0).alias("kind"), F.col("ord").alias("item"))
    ends = components.select("line").distinct().select("line", F.lit(None).cast("long").alias("right"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("item"))
    order = Window.partitionBy("line").orderBy(F.col("right").desc_nulls_last(), "kind", "item")
    return a.unionByName(b).unionByName(ends).withColumn("event", F.row_number().over(order).cast("long"))


def exact_alignment(bodies: DataFrame, words: DataFrame, verse: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(verse, label and place of a body, word): the n-th body of a verse, over all its lines, belongs to the word whose pieces hold n; and verses
    whose numbers of bodies and pieces differ, with both.

    bodies: the columns of `verse`, those that `order` names (reading order), and others, which are kept; words: verse, word (in reading order), pieces."""
    numbered = bodies.withColumn("n", F.row_number().over(Window.partitionBy(*verse).orderBy(*order)))
    upto = F.sum("pieces").over(Window.partitionBy(*verse).orderBy("word").rowsBetween(Window.unboundedPreceding, 0))
    spans = words.withColumn("upto", upto).select(*verse, "word", (F.col("upto") - F.col("pieces")).alias("after"), "upto")
    held = range_join_binned(numbered, spans, verse, "n", "after", "upto").drop("n", "after", "upto")
    found = bodies.groupBy(*verse).agg(F.count("*").alias("found"))
    expected = words.groupBy(*verse).agg(F.sum("pieces").alias("expected"))
    report = expected.join(found, verse, "full").select(*verse, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).filter("expected <> found")
    return held, report


def preferred(top: Column, bottom: Column, peak: Column, y: Column, h: Column) -> Column:
    """A component's role by where it stands: over the densest row a body, touching the band a mark, else a mark only."""
    return F.when((y <= peak) & (peak < y + h), "body").when((y <= bottom) & (y + h > top), "mark").otherwise("mark-only")


def dots_missing(words: DataFrame, marks: DataFrame) -> DataFrame:
    """(line, word_id, seen_above, seen_below) of words with fewer marks above or below the densest row than their letters have dots.

    words: (line, word_id, left, right, above, below, peak); marks: (line, x, y, w, h)."""
    some = words.filter("above > 0 or below > 0")
    inside = (2 * F.col("x") + F.col("w")).between(2 * F.col("left"), 2 * F.col("right"))
    high = 2 * F.col("y") + F.col("h") < 2 * F.col("peak")
    met = some.join(marks, "line").filter(inside).groupBy("line", "word_id").agg(F.count_if(high).alias("seen_above"), F.count_if(~high).alias("seen_below"))
    both = some.join(met, ["line", "word_id"], "left").fillna(0, ["seen_above", "seen_below"])
    return both.filter("seen_above < above or seen_below < below").select("line", "word_id", "seen_above", "seen_below")
