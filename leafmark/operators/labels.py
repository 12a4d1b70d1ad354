"""Labels from examples: folded examples, gated proposals of roles, guesses of types, and how proposals compare with what was confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.neighbours import nearest, nearest_of_all

_PAGE = ["collection_id", "page_number"]

#: Neighbours, least groups and pages, greatest distance, least margin to the other role, greatest ratio to it; weights of the two
#: blocks of features and where the second begins.
NEIGHBOURS, SUPPORT, PAGES, FAR, MARGIN, RATIO = 5, 5, 2, 0.15, 0.10, 0.5
WEIGHTS, SECOND = (0.5, 0.5), 58
#: Nearest groups of a type, the distance beyond which they say nothing, and when a guess is sure.
PER_TYPE, TYPE_FAR, SURE_RATIO, SURE_SUPPORT, EXACT = 3, 0.35, 0.85, 2, 1e-6


def _collected(df: DataFrame) -> DataFrame:
    """Rows without a collection belong to one."""
    return df if "collection_id" in df.columns else df.withColumn("collection_id", F.lit(0).cast("long"))


def folded(examples: DataFrame, by: str) -> DataFrame:
    """A collection's examples with equal features and equal `by` as one group, with its first id and all references; groups of different
    `by` stay apart.

    examples: collection_id, sample_id, by, features, snapshot_id, page_number. Adding 0.0 makes both zeros equal."""
    rows = _collected(examples).withColumn("features", F.transform("features", lambda x: x + F.lit(0.0)))
    refs = F.sort_array(F.collect_list(F.struct("sample_id", "snapshot_id", "page_number")))
    return rows.groupBy("collection_id", by, "features").agg(F.min("sample_id").alias("group_id"), F.count("*").alias("copies"), refs.alias("refs"))


def conflicting(examples: DataFrame) -> DataFrame:
    """Sample ids that stand for different contents."""
    digest = F.sha2(F.to_json(F.struct("role", "features", "snapshot_id", "page_number")), 256)
    return examples.groupBy("sample_id").agg(F.count_distinct(digest).alias("contents")).filter("contents > 1")


def _near(queries: DataFrame, groups: DataFrame, by: str, k: int) -> DataFrame:
    """(query_id, group) with distances: each query's k nearest groups of each `by` in its collection.

    Groups whose every snapshot a query excludes (its own) don't count, nor do such references, nor those from its page `before` on."""
    if "collection_id" not in queries.columns and "before" not in queries.columns:
        return nearest_of_all(queries, groups, by, k, WEIGHTS, SECOND)
    queries = _collected(queries)
    asked = queries if "before" in queries.columns else queries.withColumn("before", F.lit(None).cast("long"))
    return nearest(asked, groups, by, k, WEIGHTS, SECOND)


def matched_pages(pages: Column, most: int = NEIGHBOURS) -> Column:
    """How many of some groups can each have a page of their own, for an array of each group's pages: the size of a maximum matching.

    By Hall's theorem that is the number of groups less the greatest lack of pages of any subset; there are 2**most subsets at most."""
    n = F.size(pages)
    chosen = lambda s: F.filter(pages, lambda p, i: F.expr("1").bitwiseAND(F.floor(s / F.pow(F.lit(2), i)).cast("int")) == 1)
    lack = lambda s: F.size(chosen(s)) - F.size(F.array_distinct(F.flatten(chosen(s))))
    return n - F.array_max(F.transform(F.sequence(F.lit(0), F.lit((1 << most) - 1)), lambda s: F.when(s < F.pow(F.lit(2), n), lack(s)).otherwise(0)))


def role_proposals(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """A role for each query from its nearest groups, or the reasons for none.

    The nearest must agree, be enough, stand on enough different pages and be near; the nearest group of the other role must be known and
    clearly farther. Confidence is the least of the gates' strengths."""
    # the nearest of each role hold the nearest of all
    near = _near(queries, groups, "role", NEIGHBOURS)
    w = Window.partitionBy("query_id").orderBy("distance", "group_id")
    best = near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= NEIGHBOURS)
    pages = F.transform(F.sort_array(F.collect_list(F.struct("k", F.transform("refs", lambda r: r["page_number"]).alias("p")))), lambda x: F.array_distinct(x["p"]))
    top = best.groupBy("query_id").agg(F.min_by("role", "k").alias("candidate"), F.count_distinct("role").alias("roles"), F.count("*").alias("n"), F.max("distance").alias("farthest"), matched_pages(pages).alias("pages"))
    roles = near.groupBy("query_id").agg(F.min(F.when(F.col("role") == "body", F.col("distance"))).alias("body"), F.min(F.when(F.col("role") == "mark", F.col("distance"))).alias("mark"))
    rows = queries.select("query_id").join(top, "query_id", "left").join(roles, "query_id", "left")
    one = F.coalesce(F.col("roles") == 1, F.lit(False))
    rows = rows.withColumns({"support": F.when(one, F.col("n")).otherwise(0), "pages": F.when(one, F.col("pages")).otherwise(0).cast("long"), "opposite": F.when(F.col("candidate") == "body", F.col("mark")).when(F.col("candidate") == "mark", F.col("body"))})
    rows = rows.withColumns({"margin": F.round(F.col("opposite") - F.col("farthest"), 9), "ratio": F.when(F.col("opposite") > 0, F.round(F.col("farthest") / F.col("opposite"), 9))})
    reasons = F.array_compact(F.array(
        F.when(F.col("candidate").isNull(), "no_examples").when(~one, "mixed_neighbors"),
        F.when(F.col("support") < SUPPORT, "insufficient_support"),
        F.when(F.col("pages") < PAGES, "insufficient_pages"),
        F.when(F.col("farthest") >= FAR, "too_far"),
        F.when(F.col("opposite").isNull(), "missing_opposite").when(F.col("margin") <= MARGIN, "insufficient_margin"),
        F.when(F.col("opposite").isNotNull() & (F.col("ratio").isNull() | (F.col("ratio") >= RATIO)), "insufficient_ratio"),
    ))
    rows = rows.withColumn("reasons", reasons)
    passed = F.size("reasons") == 0
    strength = F.least(1 - F.col("farthest") / FAR, 1 - MARGIN / F.col("margin"), 1 - F.col("ratio") / RATIO)
    return rows.select("query_id", F.when(passed, F.col("candidate")).alias("role"), F.when(passed, F.round(strength, 6)).otherwise(0.0).alias("confidence"), F.col("support").cast("long").alias("support"), "pages", F.array_join("reasons", ",").alias("reasons"))


def _types(few: DataFrame) -> DataFrame:
    """(query_id, subtype) with the mean of the type's nearest groups, the nearest, and how many are close."""
    return few.groupBy("query_id", "subtype").agg(F.round(F.avg("distance"), 9).alias("score"), F.min("distance").alias("nearest"), F.count_if(F.col("distance") < TYPE_FAR).alias("close"))


def type_guesses(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """The likeliest type of each query: each type is judged by its own nearest groups, so a common one can't outvote a closer rare one.

    One type with an exact match wins; a guess is sure if it is that one, or clearly nearer than the next with enough close groups."""
    ranked = _types(_near(queries, groups, "subtype", PER_TYPE))
    order = F.struct("score", (-F.col("close")).alias("few"), "subtype", "nearest", "close")
    by = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("r"), F.min("nearest").alias("any"))
    near = F.filter("r", lambda x: x["close"] > 0)
    exact = F.filter(near, lambda x: x["nearest"] <= EXACT)
    rows = by.withColumns({"near": near, "single": F.size(exact) == 1, "first": F.when(F.size(exact) == 1, F.get(exact, F.lit(0))).otherwise(F.get(near, F.lit(0)))})
    rows = rows.withColumn("rival", F.get(F.filter("r", lambda x: x["subtype"] != F.col("first.subtype")), F.lit(0)))
    guess = F.col("first").isNotNull()
    score, runner = F.col("first.score"), F.col("rival.score")
    confidence = F.when(F.col("single") | runner.isNull(), 1.0).when(runner > 0, F.greatest(F.lit(0.0), 1 - score / runner)).otherwise(0.0)
    clear = runner.isNull() | (score <= SURE_RATIO * runner)
    sure = F.col("single") | (clear & (F.col("first.close") >= SURE_SUPPORT))
    found = rows.select("query_id", F.coalesce("first.subtype", F.lit("")).alias("subtype"), F.when(guess, F.round(confidence, 4)).otherwise(0.0).alias("confidence"), F.when(guess, F.col("first.close")).otherwise(0).alias("support"), F.round(F.when(guess, F.col("first.nearest")).otherwise(F.col("any")), 4).alias("distance"), (guess & sure).alias("sure"), F.when(guess, F.coalesce("rival.subtype", F.lit(""))).otherwise("").alias("runner_up"), F.when(guess, F.round(runner, 4)).alias("runner_distance"))
    none = {"subtype": "", "confidence": 0.0, "support": 0, "sure": False, "runner_up": ""}
    return queries.select("query_id").join(found, "query_id", "left").fillna(none)


def type_evidence(queries: DataFrame, groups: DataFrame, types: int = 3) -> DataFrame:
    """The nearest examples of the nearest types of each query: types by rounded score and name, examples by distance and group."""
    w = Window.partitionBy("query_id", "subtype").orderBy("distance", "group_id")
    few = _near(queries, groups, "subtype", PER_TYPE).withColumn("example", F.row_number().over(w).cast("long"))
    few = few.withColumn("score", F.round(F.round(F.avg("distance").over(Window.partitionBy("query_id", "subtype")), 9), 4))
    ranked = few.withColumn("place", F.dense_rank().over(Window.partitionBy("query_id").orderBy("score", "subtype")).cast("long")).filter(F.col("place") <= types)
    return ranked.select("query_id", "place", "subtype", "score", "example", F.col("refs")[0]["sample_id"].alias("sample_id"), F.round("distance", 4).alias("distance"), F.size("refs").cast("long").alias("copies"))


def type_suggestions(queries: DataFrame, examples: DataFrame, page: int) -> DataFrame:
    """Suggestions for untyped queries of one page of each collection, from all examples and those of the page; doubts of typed ones, from
    other pages only.

    A typed one is doubted if another type is guessed for sure, and its own is known elsewhere."""
    others = examples.filter(F.col("page_number") != page)
    untyped = queries.filter("subtype = ''")
    suggested = type_guesses(untyped, folded(examples, "subtype")).filter("subtype <> ''").select("query_id", F.lit("suggestion").alias("kind"), "subtype", "sure")
    typed = queries.filter("subtype <> ''")
    known = typed.select("query_id", "collection_id", F.col("subtype").alias("own_type")).join(others.select("collection_id", F.col("subtype").alias("own_type")).distinct(), ["collection_id", "own_type"], "left_semi").drop("collection_id")
    doubted = type_guesses(typed, folded(others, "subtype")).join(known, "query_id").filter("sure and subtype <> own_type")
    return suggested.unionAll(doubted.select("query_id", F.lit("doubt").alias("kind"), "subtype", "sure"))


def training_samples(approved: DataFrame, components: DataFrame, features: DataFrame) -> DataFrame:
    """Examples of approved pages: their components that may be examples (see review.eligible) with their features."""
    return components.join(approved, "page_number", "left_semi").join(features, "sample_id").select("sample_id", "page_number", "role", "features")


def profiles(approvals: DataFrame, pages: DataFrame, settings: DataFrame, version: int, config: str) -> DataFrame:
    """(collection_id, page_number, signature, min_pages, revisions): for each page a digest of what its proposals rest on, the feature version, the
    configuration and the approved revisions of earlier pages in page order, and these. Opting in to experiments lets one page be enough.

    approvals: collection_id, page_number, revision_id, one for each page; settings: collection_id, experimental. Pages with the same approvals
    before them have one signature."""
    marks = approvals.select(*_PAGE, "revision_id", F.lit(1).alias("kind")).unionByName(pages.select(*_PAGE, F.lit(None).cast(approvals.schema["revision_id"].dataType).alias("revision_id"), F.lit(0).alias("kind")))
    # a page stands before the approval of its own
    w = Window.partitionBy("collection_id").orderBy("page_number", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("revisions", F.collect_list("revision_id").over(w)).filter("kind = 0")
    rows = rows.join(settings.select("collection_id", "experimental"), "collection_id", "left")
    least = F.when(F.coalesce("experimental", F.lit(False)), 1).otherwise(PAGES)
    signature = F.sha2(F.concat_ws("|", F.lit(str(version)), F.lit(config), F.concat(F.lit("pages="), least), F.array_join("revisions", ",")), 256)
    return rows.select(*_PAGE, signature.alias("signature"), least.alias("min_pages"), "revisions")


def rebuilt_examples(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """(collection_id, signature) with the samples of exactly the revisions that a profile records, whatever is approved now. samples: revision_id and others."""
    recorded = profiles.select("collection_id", "signature", "revisions").dropDuplicates(["collection_id", "signature"])
    return recorded.select("collection_id", "signature", F.explode("revisions").alias("revision_id")).join(samples, "revision_id")


def role_errors(found: DataFrame, truth: DataFrame, group: list[str]) -> DataFrame:
    """Bodies read as marks and marks read as bodies, against confirmed roles."""
    both = found.join(truth.select("id", F.col("role").alias("true_role")), "id")
    wrong = lambda a, b: F.count_if((F.col("true_role") == a) & (F.col("role") != a))
    return both.groupBy(*group).agg(wrong("body", "mark").alias("body_as_mark"), wrong("mark", "body").alias("mark_as_body"))


def word_errors(found: DataFrame, truth: DataFrame, tolerance: int = 3) -> DataFrame:
    """How each page's placed words differ from the confirmed ones: moved, wrong line, missing, duplicated, extra.

    Both: page_id, word_id, line_number, start_x, end_x, ord. The first confirmed place of a word is the truth; of several found places
    the first on its line is compared."""
    key = ["page_id", "word_id"]
    t = truth.groupBy(*key).agg(F.min_by(F.struct("line_number", "start_x", "end_x"), "ord").alias("t"))
    f = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", "line_number", "start_x", "end_x"))).alias("f"))
    both = t.join(f, key, "full")
    same = F.get(F.filter("f", lambda p: p["line_number"] == F.col("t.line_number")), F.lit(0))
    both = both.withColumn("same", same)
    held, there = F.col("t").isNotNull(), F.col("f").isNotNull()
    far = (F.abs(F.col("same.start_x") - F.col("t.start_x")) > tolerance) | (F.abs(F.col("same.end_x") - F.col("t.end_x")) > tolerance)
    return both.groupBy("page_id").agg(F.count_if(held & far).alias("moved"), F.count_if(held & there & F.col("same").isNull()).alias("wrong_line"), F.count_if(held & ~there).alias("missing"), F.count_if(held & (F.size("f") > 1)).alias("duplicated"), F.count_if(~held).alias("extra"))


def proposal_quality(rows: DataFrame) -> DataFrame:
    """Proposals made and wrong for each role, and released locks, of rows whose truth is known."""
    known = rows.filter("truth is not null")
    return known.groupBy("predicted").agg(F.count("*").alias("made"), F.count_if(F.col("truth") != F.col("predicted")).alias("wrong"), F.count_if("exception").alias("released"))


def prequential(examples: DataFrame) -> DataFrame:
    """Every page's roles proposed from the pages before it in its collection, and judged by what was confirmed: for each page, each
    collection and all, components, and proposals made and wrong for each role.

    A page sees groups by their references on earlier pages only, so no page helps to judge itself or those before it.
    examples: collection_id, sample_id, role, features, snapshot_id, page_number; sample ids are distinct."""
    queries = examples.select(F.col("sample_id").alias("query_id"), "collection_id", "features", "snapshot_id", F.col("page_number").alias("before"))
    found = role_proposals(queries, folded(examples, "role")).select(F.col("query_id").alias("sample_id"), F.col("role").alias("proposed"))
    rows = examples.select("sample_id", "collection_id", "page_number", "role").join(found, "sample_id", "left")
    made = lambda r: F.count_if(F.col("proposed") == r)
    wrong = lambda r: F.count_if((F.col("proposed") == r) & (F.col("role") != r))
    by = rows.rollup("collection_id", "page_number").agg(F.grouping_id().alias("level"), F.count("*").alias("components"), made("body").alias("bodies"), wrong("body").alias("wrong_bodies"), made("mark").alias("marks"), wrong("mark").alias("wrong_marks"))
    scope = F.element_at(F.create_map(F.lit(0), F.lit("page"), F.lit(1), F.lit("collection"), F.lit(3), F.lit("all")), F.col("level").cast("int"))
    return by.select("collection_id", "page_number", scope.alias("scope"), "components", "bodies", "wrong_bodies", "marks", "wrong_marks")


def side_by_side(readings: DataFrame, names: list[str]) -> DataFrame:
    """Each line's words in several readings in one row. readings: reading, line, n_words, first_word, last_word."""
    out = readings.groupBy("line").pivot("reading", names).agg(F.first("n_words").alias("n"), F.first("first_word").alias("a"), F.first("last_word").alias("z"))
    return out.fillna(0, [f"{n}_n" for n in names])


def compared_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two reports' words by line: how many are in both, how many boxes widened, and by how much (median, ninth decile, greatest)."""
    key = ["line", "word_id"]
    both = old.select(*key, F.col("start_x").alias("s"), F.col("end_x").alias("e")).join(new.select(*key, "start_x", "end_x"), key)
    by = F.greatest(F.col("start_x") - F.col("s"), F.lit(0)) + F.greatest(F.col("e") - F.col("end_x"), F.lit(0))
    rows = both.select(by.alias("d"), (F.col("line") % 10).alias("part"))
    some = F.when(F.col("d") > 0, F.col("d"))
    return rows.groupBy("part").agg(F.count("*").alias("words"), F.count_if(F.col("d") > 0).alias("widened"), F.percentile(some, 0.5).alias("median"), F.percentile(some, 0.9).alias("p90"), F.max(some).alias("greatest"))


def evidence_bands(rows: DataFrame) -> DataFrame:
    """Components of each score by role, and whether both roles occur there."""
    by = rows.groupBy("score").pivot("role", ["body", "mark"]).count().fillna(0)
    return by.select("score", F.col("body").alias("bodies"), F.col("mark").alias("marks"), ((F.col("body") > 0) & (F.col("mark") > 0)).alias("contested"))
