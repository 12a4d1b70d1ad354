"""What one task holds doesn't grow with the input: rows go to as many partitions as they need, and nothing makes rows that nobody asks for."""

import re

import pytest

import __spark_entry__ as entry
from leafmark.operators import schemes, transfers, trees
from leafmark.sources import views

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial(df):
    return plan(df).split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name, by", [
    ("e05_numbering_walk", "collection_id"), ("a09_verse_rectangles", "collection_id"), ("d11_d23_held_chapters", "collection_id"), ("e10_anchored_warnings", "collection_id"), ("e15_gaps", "collection_id"), ("e20_stretches", "l_orderkey"),
    ("e02_scheme_starts", "chapter"), ("e03_tiling_problems", "chapter"), ("c03_resolved_spans", "chapter"), ("d09_next_verses", "chapter"), ("d08_chapter_counts", "chapter"),
])
def test_partitions_grow_with_the_input(spark, monkeypatch, name, by):
    monkeypatch.setattr(views, "ROWS", 100)
    monkeypatch.setattr(views, "CHARS", 2_000)
    counts = [int(n) for n in re.findall(rf"hashpartitioning\({by}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(entry.queries()[name](spark, SMOKE)))]
    assert counts and min(counts) > 20


def test_a_walk_sorts_an_island_once(spark):
    sorts = re.findall(r"Sort \[collection_id#\d+L? ASC NULLS FIRST, island#\d+L? ASC NULLS FIRST, page_number#\d+ ASC NULLS FIRST, line", initial(entry.queries()["e05_numbering_walk"](spark, SMOKE)))
    assert len(sorts) == 1


def test_free_names_follow_held_ones(spark):
    taken = [("a", n) for n in ("x", "x (copy)", "x (copy 2)", "x (copy 4)", "y (copy 1)", "y (copy)", "z (copy 02)", "z", "w\n (copy)", "w\n")] + [("b", "x"), (None, "x"), ("a", "x")]
    wanted = [("a", n) for n in ("x", "y", "z", "w\n", "x (copy)", None)] + [("b", "x"), ("c", "x"), (None, "x")]
    df = trees.free_names(spark.createDataFrame(wanted, "owner string, name string"), spark.createDataFrame(taken, "owner string, name string"))
    got = {(r.owner, r.name): r.free_name for r in df.collect()}
    assert got == {("a", "x"): "x (copy 3)", ("a", "y"): "y", ("a", "z"): "z (copy)", ("a", "w\n"): "w\n (copy 2)", ("a", "x (copy)"): "x (copy) (copy)", ("a", None): None, ("b", "x"): "x (copy)", ("c", "x"): "x", (None, "x"): "x"}
    # a candidate for each name that an owner holds is too many
    assert "sequence(" not in plan(df)


def test_several_deltas_of_a_verse(spark):
    starts = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 6, 6), (2, 1, 3, 12)], "chapter long, verse long, n_words long, start long")
    deltas = spark.createDataFrame([(1, 1, "end", 0, "a"), (1, 2, "internal", 2, "b"), (1, 2, "internal", 4, "a,b"), (2, 1, "internal", 1, "c")], "chapter long, verse long, kind string, after_position long, counted_by string")
    got = sorted((r.scheme, r.chapter, r.number, r.start) for r in schemes.scheme_starts(starts, deltas, ["a", "b"], 3).collect())
    assert got == [("a", 1, 1, 1), ("a", 1, 2, 6), ("a", 1, 3, 10), ("a", 2, 1, 12), ("b", 1, 1, 1), ("b", 1, 2, 8), ("b", 1, 3, 10), ("b", 2, 1, 12)]


def test_page_trees_stay_where_their_pages_are_dealt(spark):
    found = initial(entry.queries()["a05_a11_page_trees"](spark, SMOKE))
    # rows of lineitem move once, by page; after that only one row a page does
    assert "hashpartitioning(l_orderkey" not in found and len(re.findall("ENSURE_REQUIREMENTS", found)) <= 1


def test_parts_of_trees_read_a_document_once(spark):
    assert "Union" not in initial(entry.queries()["a06_tree_parts"](spark, SMOKE))


@pytest.mark.parametrize("name", ["e07_renumbered_from", "a06_tree_words"])
def test_rows_are_dealt_out_by_page(spark, monkeypatch, name):
    monkeypatch.setattr(views, "ROWS", 100)
    found = plan(entry.queries()[name](spark, SMOKE))
    counts = [int(n) for n in re.findall(r"hashpartitioning\(collection_id#\d+L?, page_number#\d+, (\d+)\), REPARTITION_BY_NUM", found)]
    assert counts and min(counts) > 20


def test_segments_of_text_lines_alone_count(spark):
    lines = spark.createDataFrame([(1, 1, 1, "text", 1), (1, 1, 2, "basmala", 1), (1, 2, 1, "text", 1)], "collection_id long, page_number int, line_number int, type string, chapter long")
    segments = spark.createDataFrame([(1, 1, 1, 1, True, 1), (1, 1, 2, 1, True, 2), (1, 1, 3, 1, True, 3), (1, 2, 1, 1, True, 4)], "collection_id long, page_number int, line_number int, segment_order int, closes boolean, verse long")
    got = transfers.page_rows(lines, segments, only=spark.createDataFrame([(1, 1)], "collection_id long, page_number int"), keep=("type",))
    assert sorted((r.line_number, r.segment_order or 0, r.type) for r in got.collect()) == [(1, 0, "text"), (1, 1, None), (2, 0, "basmala")]


def test_units_read_their_ink_once(spark):
    assert "l_partkey" not in plan(entry.queries()["i04_split_units"](spark, SMOKE))
