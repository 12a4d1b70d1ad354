"""Closures over small graphs: connected groups, fused units, and what an edit reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import stored


def connected(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, root): the least id that links (a, b) reach from each id in one.

    A round hooks each root to the least root beside it, shortens hooks by doubling until they end, and keeps only links between
    different roots: half of the linked roots go at least, so rounds grow with the logarithm of the ids. More than most_rounds is
    an error, never a wrong result."""
    key = links.schema["a"].dataType
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = None
    for _ in range(most_rounds):
        hooks = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), "hooks")
        for _ in range(most_rounds):
            moved = Observation()
            beyond = hooks.select(F.col("id").alias("root"), F.col("root").alias("far"))
            shorter = hooks.join(beyond, "root").select("id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
            hooks = stored(shorter.observe(moved, F.count_if(F.col("moved")).alias("n")), "hooks").select("id", "root")
            if not moved.get["n"]:
                break
        else:
            raise RuntimeError(f"connected: hooks didn't end after {most_rounds} doublings")
        lower = hooks.select(F.col("id").cast(key).alias("root"), F.col("root").alias("low"))
        found = hooks if found is None else stored(found.join(lower, "root", "left").select("id", F.coalesce("low", "root").alias("root")), "roots")
        left = Observation()
        ends = [hooks.select(F.col("id").alias(c), F.col("root").alias(f"to_{c}")) for c in ("a", "b")]
        across = edges.join(ends[0], "a").join(ends[1], "b").filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        edges = stored(across.observe(left, F.count(F.lit(1)).alias("n")), "edges")
        if not left.get["n"]:
            return found
    raise RuntimeError(f"connected: links were left after {most_rounds} rounds")


def fused_units(shared: DataFrame, words: DataFrame) -> DataFrame:
    """(line, unit, word_id): words that shared bodies join to one unit, named by its first word.

    shared: (line, label, word_id) of bodies that a hand gave to several words; words: (line, word_id, place, verse). Only groups of
    consecutive words of one verse are kept."""
    key = F.struct("line", "word_id")
    members = shared.join(words.select("line", "word_id"), ["line", "word_id"], "left").groupBy("line", "label").agg(F.min("word_id").alias("least"), F.count_distinct("word_id").alias("n"))
    known = shared.join(words, ["line", "word_id"], "left_anti").select("line", "label").distinct()
    whole = members.filter("n > 1").join(known, ["line", "label"], "left_anti")
    links = shared.join(whole, ["line", "label"]).filter("word_id <> least").select(key.alias("a"), F.struct("line", F.col("least").alias("word_id")).alias("b"))
    found = connected(links).select("id.line", "id.word_id", F.col("root.word_id").alias("root")).join(words, ["line", "word_id"])
    groups = found.groupBy("line", "root").agg(F.count("*").alias("n"), (F.max("place") - F.min("place") + 1).alias("reach"), F.count_distinct("verse").alias("verses"), F.min_by("word_id", "place").alias("unit"))
    return found.join(groups.filter("n > 1 and reach = n and verses = 1"), ["line", "root"]).select("line", "unit", "word_id")


def unit_words(units: DataFrame, words: DataFrame) -> DataFrame:
    """Each unit read as one word: texts joined in reading order, pieces and dots added."""
    both = units.join(words, ["line", "word_id"])
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    return both.groupBy("line", "unit").agg(texts.alias("text"), F.sum("pieces").alias("pieces"), F.sum("above").alias("above"), F.sum("below").alias("below"))


def split_units(components: DataFrame, units: DataFrame) -> DataFrame:
    """(line, unit, label, word_id): a unit's components given back to its words.

    From right to left a component goes to the word reached so far; a shared one moves on to the latest word that it
    belongs to and is itself left out. components: (line, unit, label, right, owners)."""
    place = F.row_number().over(Window.partitionBy("line", "unit").orderBy("word_id"))
    members = units.withColumn("member", place)
    latest = components.select("line", "unit", "label", "right", F.explode_outer("owners").alias("word_id")).join(members, ["line", "unit", "word_id"], "left")
    each = latest.groupBy("line", "unit", "label", "right").agg(F.count_distinct("word_id").alias("owners"), F.max("member").alias("reaches"))
    w = Window.partitionBy("line", "unit").orderBy(F.desc("right"), "label").rowsBetween(Window.unboundedPreceding, 0)
    at = F.coalesce(F.max(F.when(F.col("owners") > 1, F.col("reaches"))).over(w), F.lit(1))
    own = each.withColumn("member", at).filter("owners < 2").drop("owners", "reaches")
    return own.join(members, ["line", "unit", "member"]).select("line", "unit", "label", "word_id")


def affected(changes: DataFrame, edited: DataFrame) -> DataFrame:
    """Verses that an edit changes: the edited ones and all that ink changing hands links to them.

    changes: (ink, verse, after): owners before (after false) and after; only ink whose owners differ links its verses."""
    by = changes.groupBy("ink").agg(F.sort_array(F.collect_set(F.when(~F.col("after"), F.col("verse")))).alias("was"), F.sort_array(F.collect_set(F.when(F.col("after"), F.col("verse")))).alias("now"))
    group = by.filter("was <> now").select(F.array_sort(F.array_union("was", "now")).alias("verses"))
    links = group.select(F.explode("verses").alias("a"), F.get("verses", F.lit(0)).alias("b"))
    roots = connected(links)
    touched = roots.join(edited.select(F.col("verse").alias("id")).distinct(), "id", "left_semi").select("root").distinct()
    return roots.join(touched, "root", "left_semi").select(F.col("id").alias("verse")).unionAll(edited.select("verse")).distinct()


def merged_readings(old: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """Words of the new reading for verses in scope, of the old one elsewhere; unlabelled old words stay. Both: (line, word_id, verse, start_x, end_x)."""
    taken = new.filter("word_id is not null").join(scope, "verse", "left_semi").withColumn("taken", F.lit("new"))
    kept = old.filter("word_id is not null").join(scope, "verse", "left_anti").withColumn("taken", F.lit("old"))
    free = old.filter("word_id is null").withColumn("taken", F.lit("free"))
    columns = ["line", "word_id", "verse", "start_x", "end_x", "taken"]
    return taken.select(*columns).unionAll(kept.select(*columns)).unionAll(free.select(*columns))
