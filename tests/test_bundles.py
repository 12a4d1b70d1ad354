"""Trees and histories that travel: export, import and export again; ids, numbers and lines that become the target's own."""

import json

from leafmark.operators import bundles as B

KEY = {"collection_id": 1, "page_number": 4}


def test_export_import_export_is_the_same(spark):
    line = {"type": "text", "chapter": 2, "x": 1, "y": 2, "w": 3, "h": 4}
    document = {"schema": "page-tree/v2", "source_page": 9, "x": 0, "y": 0, "w": 100, "h": 200, "reviewed": True, "lines": [
        {"line_number": 1, **line, "segments": [{"segment_order": 1, "x": 5, "w": 6, "closes": True, "verse": 7}, {"segment_order": 2, "x": 1, "w": 2, "closes": False, "verse": None}], "strokes": [{"size": 3, "points": [[1, 2], [3, 4]]}, {"size": 1, "points": []}],
         "words": [{"word_id": None, "position": 0, "start_x": 9, "end_x": 8}, {"word_id": 12, "position": 1, "start_x": 8, "end_x": 5}], "status": {"status": "partial", "reason": "a,b", "deviations": 2, "ties": 0, "edited": True}},
        {"line_number": 2, "type": "header", "chapter": None, "x": 1, "y": 2, "w": 3, "h": 4, "segments": [], "strokes": [], "words": [], "status": None}]}
    empty = {"schema": "page-tree/v1", "source_page": None, "x": None, "y": None, "w": None, "h": None, "reviewed": False, "lines": []}
    docs = spark.createDataFrame([(1, 4, json.dumps(document)), (1, 5, json.dumps(empty)), (1, 6, '{"schema": "page-tree/v9", "lines": []}'), (1, 7, "no tree"), (1, 8, None)], "collection_id long, page_number int, document string")
    t = B.imported_trees(docs)
    again = B.exported_trees(*(t[k] for k in ("pages", "lines", "segments", "strokes", "words", "status"))).select("page_number", B.tree_json().alias("d"))
    got = {r.page_number: json.loads(r.d) for r in again.collect()}
    assert got == {4: document, 5: {**empty, "schema": "page-tree/v2"}}
    assert sorted((r.page_number, r.schema) for r in t["refused"].collect() if r.schema) == [(6, "page-tree/v9")] and t["refused"].count() == 3
    assert t["pages"].filter("last_run is not null").count() == 0


def test_what_may_be_left_out(spark):
    bare = {"schema": "page-tree/v1", "lines": [{"line_number": 3, "type": "text", "x": 0, "y": 0, "w": 1, "h": 1, "segments": [{"x": 4, "w": 1}, {"x": 2, "w": 1, "segment_order": 9}], "strokes": [{}], "words": [{"start_x": 4, "end_x": 3}, {"start_x": 3, "end_x": 1, "position": 7}]}]}
    t = B.imported_trees(spark.createDataFrame([(1, 4, json.dumps(bare))], "collection_id long, page_number int, document string"))
    assert sorted((r.segment_order, r.x, r.closes, r.verse) for r in t["segments"].collect()) == [(1, 4, False, None), (9, 2, False, None)]
    assert sorted((r.position, r.word_id, r.start_x) for r in t["words"].collect()) == [(0, None, 4), (7, None, 3)]
    assert [(r.size, r.points) for r in t["strokes"].collect()] == [(12, [])] and t["status"].count() == 0 and not t["pages"].first().reviewed


def test_a_history_becomes_the_targets_own(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    incoming = {
        "snapshots": make([(1, "s1", 4, 1, "far1", "f1"), (1, "s2", 4, 2, "far2", "f2")], "collection_id long, snapshot_id string, page_number int, line_number int, source_line_id string, fingerprint string"),
        "revisions": make([(1, 4, "r1", 1, "processed", None, "q1"), (1, 4, "r2", 2, "approval", 1, "q2")], "collection_id long, page_number int, revision_id string, number long, kind string, made_from long, request_id string"),
        "rows": make([("r1", 0, "s1", 4, 1, "far1"), ("r1", 1, "gone", 4, 9, "far9"), ("r2", 0, "s2", 4, 2, "far2")], "revision_id string, ord int, snapshot_id string, page_number int, line_number int, line_id string"),
        "reviews": make([(1, 4, 2, 2), (1, 5, 0, None)], "collection_id long, page_number int, revision long, confirmed long"),
        "profiles": make([(1, "sig", ["r2", "lost"], {"mode": "live", "k": "5", "approved_at": "now"})], "collection_id long, signature string, approvals array<string>, payload map<string,string>"),
    }
    held = {
        "snapshots": make([(1, "mine", "f1")], "collection_id long, snapshot_id string, fingerprint string"),
        "reviews": make([(1, 4, 3, 3), (1, 5, 1, 1)], "collection_id long, page_number int, revision long, confirmed long"),
        "requests": make([(1, 4, "q1")], "collection_id long, page_number int, request_id string"),
        "lines": make([(1, 4, 1, "own1"), (1, 4, 2, "far2")], "collection_id long, page_number int, line_number int, line_id string"),
        "settings": make([(1, True, 8)], "collection_id long, experimental boolean, revision long"),
    }
    got = B.restored(incoming, held)
    snaps = {r.fingerprint: r for r in got["snapshots"].collect()}
    assert snaps["f1"].snapshot_id == "mine" and not snaps["f1"].created and snaps["f2"].created and snaps["f1"].source_line_id == "own1"
    revs = {r.number: r for r in got["revisions"].collect()}
    assert {(n, r.kind, r.made_from, r.request_id) for n, r in revs.items()} == {(4, "processed", None, None), (5, "approval", 4, "q2")}
    rows = {(r.revision_id, r.ord): (r.snapshot_id, r.line_id, r.source_line_id) for r in got["rows"].collect()}
    assert rows == {(revs[4].revision_id, 0): ("mine", "own1", "far1"), (revs[4].revision_id, 1): ("gone", "far9", None), (revs[5].revision_id, 0): (snaps["f2"].snapshot_id, "far2", None)}
    assert {(r.page_number, r.revision, r.confirmed) for r in got["reviews"].collect()} == {(4, 5, 5), (5, 1, 1)}
    profile = got["profiles"].first()
    assert profile.mode == "shadow" and profile.payload == {"k": "5"} and set(profile.approvals) == {revs[5].revision_id, "lost"}
    assert got["settings"].first()[1:] == (False, 9)
    assert {(r.kind, r.id) for r in got["unresolved"].collect()} == {("snapshot", "gone"), ("approval", "lost")}
