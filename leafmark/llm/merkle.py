"""Merkle manifest of a table: a tree for each language, one over their roots, and multiproofs by leaf partition.

1. A leaf is the sha256 of a row's fields, each with its length in front. Rows are sorted by tree and id over range partitions; a leaf's
   place in its tree is its place in its partition plus the rows of the tree in partitions before (one number for each partition and tree).
2. Every RUN consecutive nodes hash to their parent. Blocks of RUN ** LEVELS nodes climb LEVELS levels at once, so a tree of any size
   takes ceil(height / LEVELS) rounds, and a group holds RUN ** LEVELS digests at most.
3. Octopus multiproof: the leaves of a block together need only the nodes that they can't derive themselves: level by level, what the
   runs of known nodes lack (`missing`). Each block asks for the union of these coordinates once, receives the digests, derives all
   interior nodes that its leaves share, and then expands each leaf's own proof, its checksum and the folded root locally.
4. The roots of the trees are the leaves of one more tree, whose proofs are made in the same way and go to the blocks with the rest.

Cases: null fields are "-"; a null language has a tree of its own, the first; rows of equal ids are ordered by leaf, and equal rows are
interchangeable; a null id comes first and counts as empty text where ids are checked; a tree of one leaf is that leaf; an empty table
gives an empty result; texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, ship, written
from leafmark.llm.spelling import crc32_sql

RUN, LEVELS = 8, 4
BLOCK = RUN**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows whose id's checksum this divides are tampered with before they are verified.
TAMPERED = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = "!"


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // RUN), h + 1
    return h


def leaf(values: list[Column]) -> Column:
    """sha256 of fields; integers in decimal."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tree_of(name: str) -> Column:
    """A tree's name, never null, in the order of its values: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("+"), F.col(name).cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, from 0 in the order of its tree, and n, the tree's rows. rows: tree and other columns.

    Partitions are ranges; equal rows are told apart by where they were read, so that many of them may be split."""
    keys = ["tree", *order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    kept = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves").withColumn("_part", F.shiftright("_at", 33))
    counts = kept.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a row for each range of a tree
    whole = Window.partitionBy("tree").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), n.alias("n"))
    return kept.join(starts, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _grouped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy("tree", "block").applyInArrow(run, schema)


def nodes(leaves: DataFrame) -> DataFrame:
    """(tree, level, place, digest, n) of all nodes, leaves included. leaves: (tree, place, n, leaf)."""
    level, n = 0, leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    now = leaves.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest"), "n")
    every = now
    while level < height(n):
        base = level

        def climb(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            size, first = table.column("n")[0].as_py(), table.column("place")[0].as_py()
            row, out = table.column("digest").to_pylist(), {"level": [], "place": [], "digest": []}
            for up in range(base + 1, min(base + LEVELS, height(size)) + 1):
                row, first = [_digest(row[i : i + RUN]) for i in range(0, len(row), RUN)], first // RUN
                out["level"] += [up] * len(row)
                out["place"] += range(first, first + len(row))
                out["digest"] += row
            k = len(out["digest"])
            return pa.table({"tree": pa.array([key[0].as_py()] * k, pa.string()), "level": pa.array(out["level"], pa.int32()), "place": pa.array(out["place"], pa.int64()), "digest": pa.array(out["digest"], pa.string()), "n": pa.array([size] * k, pa.int64())})

        above = written(_grouped(now.withColumn("block", F.floor(F.col("place") / BLOCK)), climb, "tree string, level int, place long, digest string, n long"), "merkle-nodes")
        every, level = every.unionAll(above), level + LEVELS
        now = above.filter(F.col("level") == level)
    return every


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the nodes that the leaves at these places need and can't derive: the least such set."""
    known, level, out = np.unique(places), 0, []
    while n > 1:
        parents = np.unique(known // RUN)
        wanted = (parents[:, None] * RUN + np.arange(RUN)).ravel()
        out += [(level, int(p)) for p in np.setdiff1d(wanted[wanted < n], known)]
        known, n, level = parents, -(-n // RUN), level + 1
    return out


class Multiproof:
    """What the leaves of one block derive from their digests and the nodes that were missing."""

    def __init__(self, places: list[int], digests: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.rows, self.runs = [dict(zip(places, digests, strict=True))], []
        for level in range(height(n)):
            known = self.rows[-1]
            known |= {p: d for (at, p), d in fetched.items() if at == level}
            runs, above = {}, {}
            for parent in {p // RUN for p in known}:
                run = [known[p] for p in range(parent * RUN, min(parent * RUN + RUN, n)) if p in known]
                # a run that isn't whole belongs to a node above that was fetched
                if len(run) == min(RUN, n - parent * RUN):
                    runs[parent], above[parent] = run, _digest(run)
            self.runs.append(runs)
            self.rows.append(above)
            n = -(-n // RUN)
        self.root = next(iter(self.rows[-1].values()))
        self._after: dict[tuple[int, int], str] = {}

    def path(self, place: int) -> list[tuple[int, list[str]]]:
        """For each level the run that holds the leaf's ancestor, and where it stands in it."""
        out = []
        for runs in self.runs:
            out.append((place % RUN, runs[place // RUN]))
            place //= RUN
        return out

    def siblings(self, level: int, place: int) -> str:
        """All siblings from a node up to the root, as text; what is above a run is made once."""
        if level == len(self.runs):
            return ""
        if (level, place) not in self._after:
            run, at = self.runs[level][place // RUN], place % RUN
            text = "".join(run[:at] + run[at + 1 :]) + self.siblings(level + 1, place // RUN)
            if level == 0:  # each leaf's is asked for once
                return text
            self._after[level, place] = text
        return self._after[level, place]


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and the siblings of its path make."""
    for at, run in path:
        digest = _digest([*run[:at], digest, *run[at + 1 :]])
    return digest


def _multiproofs(leaves: DataFrame, every: DataFrame, expand: Callable[[pa.Table, Multiproof, pa.Table], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
    """expand(leaves of a block, their multiproof, what was fetched) for each block, as rows of schema.

    leaves: (tree, place, n, leaf) and other columns; more: (tree, digest, path), which goes to each block of the tree."""
    blocks = leaves.withColumn("block", F.floor(F.col("place") / BLOCK))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        wanted = [*missing(table.column("place").to_numpy(), n), (height(n), 0)]  # and the root as it was published
        k = len(wanted)
        return pa.table({"tree": pa.array([key[0].as_py()] * k, pa.string()), "block": pa.array([key[1].as_py()] * k, pa.int64()), "level": pa.array([w[0] for w in wanted], pa.int32()), "place": pa.array([w[1] for w in wanted], pa.int64())})

    path = "array<struct<at:int,run:array<string>>>"
    asked = _grouped(blocks.select("tree", "block", "place", "n"), ask, "tree string, block long, level int, place long")
    got = asked.join(every.select("tree", "level", "place", "digest"), ["tree", "level", "place"]).select("tree", "block", "level", "place", "digest", F.lit(None).cast(path).alias("path"))
    if more is not None:
        got = got.unionByName(blocks.select("tree", "block").distinct().join(more, "tree").select("tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), "digest", F.col("path").cast(path).alias("path")))

    def meet(mine: pa.Table, fetched: pa.Table) -> pa.Table:
        found = {(a, p): d for a, p, d in zip(*(fetched.column(c).to_pylist() for c in ("level", "place", "digest")), strict=True)}
        n = mine.column("n")[0].as_py()
        known = {k: d for k, d in found.items() if 0 <= k[0] < height(n)}
        return expand(mine, Multiproof(mine.column("place").to_pylist(), mine.column("leaf").to_pylist(), n, known), fetched)

    return blocks.groupBy("tree", "block").cogroup(got.groupBy("tree", "block")).applyInArrow(meet, schema)


def proof_paths(leaves: DataFrame, every: DataFrame) -> DataFrame:
    """(tree, place, digest of the root, path) of every leaf: for each level where it stands in its run, and the run."""

    def expand(mine: pa.Table, proof: Multiproof, fetched: pa.Table) -> pa.Table:
        paths = [[{"at": at, "run": run} for at, run in proof.path(p)] for p in mine.column("place").to_pylist()]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))
        return pa.table({"tree": mine.column("tree"), "place": mine.column("place"), "digest": pa.array([proof.root] * len(paths), pa.string()), "path": pa.array(paths, kind)})

    return _multiproofs(leaves, every, expand, "tree string, place long, digest string, path array<struct<at:int,run:array<string>>>")


def manifest(docs: DataFrame, id_col: str = "doc_id", tree: str = "lang", fields: list[str] | None = None, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A row's proof is checked with the row as it is, or, where `where` holds, with `changed` values of some fields in place of its own."""
    fields = fields or FIELDS
    now = leaf([(changed or {}).get(f, F.col(f"`{f}`")) for f in fields])
    own = leaf([F.col(f"`{f}`") for f in fields])
    seen = F.when(where, now) if changed and where is not None else F.lit(None).cast("string")
    rows = docs.select(tree_of(f"`{tree}`").alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), own.alias("leaf"), seen.alias("seen"))
    leaves = placed(rows, ["doc_id", "leaf"])
    every = nodes(leaves)
    tops = every.filter(F.col("place") == 0).groupBy("tree").agg(F.max(F.struct("level", "digest")).alias("top"))
    top_leaves = placed(tops.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("of"), F.col("top.digest").alias("leaf")), ["of"])
    top_paths = proof_paths(top_leaves.drop("of"), nodes(top_leaves))
    more = written(top_leaves.join(top_paths.select("place", "digest", "path"), "place").select(F.col("of").alias("tree"), "digest", "path"), "merkle-tops")
    kind = docs.schema[id_col].dataType

    def expand(mine: pa.Table, proof: Multiproof, fetched: pa.Table) -> pa.Table:
        levels, digests = fetched.column("level").to_pylist(), fetched.column("digest").to_pylist()
        at_top = levels.index(-1)
        top = [(x["at"], x["run"]) for x in fetched.column("path")[at_top].as_py()]
        root, subroot = digests[at_top], digests[levels.index(len(proof.runs), 0)] if len(proof.runs) in levels else proof.root
        above = "".join("".join(run[:at] + run[at + 1 :]) for at, run in top)
        derived = fold(proof.root, top)
        proofs, folded = [], []
        for place, other in zip(mine.column("place").to_pylist(), mine.column("seen").to_pylist(), strict=True):
            proofs.append(hashlib.sha256((proof.siblings(0, place) + above).encode()).hexdigest())
            folded.append(derived if other is None or other == proof.rows[0][place] else fold(other, [*proof.path(place), *top]))
        n = len(proofs)
        return pa.table({"doc_id": mine.column("doc_id"), "leaf": mine.column("leaf"), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})

    return _multiproofs(leaves, every, expand, f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", more)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = {"text": F.translate("text", _UPPER, _LOWER)}
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % TAMPERED == 0
    return manifest(documents(spark, sf_dir), changed=lowered, where=chosen)


def _sql(most: int = 8) -> str:
    """The rule in SQL, a step for each level up to RUN ** most leaves of a tree."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    own = "sha256(" + " || ".join(map(field, FIELDS)) + ")"
    seen = "sha256(" + " || ".join(field(f"translate(text, '{_UPPER}', '{_LOWER}')" if c == "text" else c) for c in FIELDS) + ")"
    out = [f"r0 AS MATERIALIZED (SELECT doc_id, lang, {own} AS leaf, CASE WHEN {crc32_sql('coalesce(CAST(doc_id AS VARCHAR), '')')} % {TAMPERED} = 0 THEN {seen} ELSE {own} END AS seen FROM documents)"]
    out += ["r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM r0)"]
    # a tree's nodes by level, then those of the tree over the roots
    for name, leaves, of in (("a", "SELECT lang, place AS i, leaf AS d FROM r", "lang"), ("t", "SELECT 0 AS lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS i, d FROM sub", "0")):
        out.append(f"{name}0 AS MATERIALIZED ({leaves})")
        for k in range(most):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT lang, i // {RUN} AS p, list(d ORDER BY i) AS run FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}s{k} AS MATERIALIZED (SELECT lang, count(*) AS size FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT q.lang, p AS i, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM {name}r{k} q JOIN {name}s{k} s ON q.lang IS NOT DISTINCT FROM s.lang)")
        if name == "a":
            out.append(f"sub AS MATERIALIZED (SELECT lang, d FROM a{most} WHERE i = 0)")
            out.append("rank AS MATERIALIZED (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS t FROM sub)")
    out.append("f0 AS MATERIALIZED (SELECT r.doc_id, r.lang, leaf, subroot, place, t, seen AS v, '' AS proof FROM r JOIN rank ON r.lang IS NOT DISTINCT FROM rank.lang)")
    k = 0
    for name, at, key in (("a", "place", "f.lang IS NOT DISTINCT FROM {0}.lang"), ("t", "t", "true")):
        for level in range(most):
            w, s = f"{name}r{level}", f"{name}s{level}"
            spot = f"(({at} // {RUN**level}) % {RUN})"
            left, right = f"run[1:{spot}]", f"run[{spot} + 2:]"
            out.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (v, proof), CASE WHEN size > 1 THEN sha256(array_to_string({left}, '') || v || array_to_string({right}, '')) ELSE v END AS v, CASE WHEN size > 1 THEN proof || array_to_string({left}, '') || array_to_string({right}, '') ELSE proof END AS proof FROM f{k} f JOIN {w} ON {key.format(w)} AND p = {at} // {RUN ** (level + 1)} JOIN {s} ON {key.format(s)})")
            k += 1
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, (SELECT d FROM t{most} WHERE i = 0) AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = (SELECT d FROM t{most} WHERE i = 0) AS verified FROM f{k}"


OP13_SQL = _sql()
