"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Documents with the same words in the same order are one class from the start; the least id stands for it.
2. A shingle is SHINGLE consecutive words (a shorter text is one shingle of all its words); its weight is its count in the text times
   1 + RARE * ln((1 + texts) / (1 + texts with it)) / ln(1 + texts), between 1 and 1 + RARE, so that a word changed in one copy of
   many doesn't outweigh all that the copies share. Numbers of texts come to the texts through lookup.py, so no table of shingles is broadcast.
3. A text can be THRESHOLD similar to another only if shingles that others have too hold that share of its weight; other texts
   are alone, exactly. The rest get BANDS * ROWS consistent weighted samples, ROWS to a band.
4. Texts that share a band bucket are candidates, and their weighted Jaccard similarity is verified; links join texts to
   components. Not all pairs are made: in each of ROUNDS rounds every text outside the largest component of a bucket is
   compared with one text, the least (in an order that changes with the round) that its buckets offer from their largest
   components. Where a bucket still holds several components after that, its texts outside the largest one are compared with
   all of other components that could be similar, block by block: similar texts share one of the rarest shingles that hold
   1 - THRESHOLD of their weights (`prefix`), and only blocks with such a shingle in common meet, so no pair that could join two
   components is left out.

Cases: null and empty texts have no shingles and are one class; a text under SHINGLE words is like others with the same words only;
equal texts are one class; rows with one id and different texts are different nodes with that id; a null id is kept, with the
class of its text, or a null class if no row of the class has an id; other columns are ignored or carried and may have any names;
an empty table gives an empty result; ties go to the least id; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import Slice, documents, give_back, lookup_join, mapped, mix, range_hashes, slices, sums, word_bounds, written, written_n
from leafmark.llm.lookup import bucket_number, bucket_of, counted_blocks, get, low_bits

SHINGLE, THRESHOLD = 5, 0.8
#: What a shingle that no other text has weighs more than one that all have.
RARE = 0.25
#: A pair at the threshold shares no band with probability (1 - 0.8**3)**20 < 1e-6.
BANDS, ROWS = 20, 3
#: Rounds in which a text is compared with one other before all that are left.
ROUNDS = 2
#: Texts, and bytes of their vectors, that are compared with another block's at a time.
BLOCK_TEXTS, BLOCK_BYTES = 256, 16 << 20


def shingles(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and shingles before each text."""
    starts, ends, first = word_bounds(part)
    words = np.diff(first)
    word = range_hashes(part.data, starts, ends)
    n = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)
    end = np.minimum(begin + SHINGLE, np.repeat(first[1:], n))
    return range_hashes(word, begin, end), at


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles with their counts, and how many stand before each text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    by = np.lexsort((hashes, doc))
    h, d = hashes[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), np.searchsorted(d[first], np.arange(len(at)))


_SEEDS = mix((np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_SCALE = np.float32(2.0**-32)
#: Shingles times samples that are drawn at a time: about what a processor's cache holds.
CELLS = 1 << 15


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS consistent weighted samples (shingle and quantised weight, hashed) of one text.

    A shingle and a sample draw r and c from Gamma(2, 1), each minus the logarithm of a product of two uniform numbers, and b from [0, 1);
    t = floor(ln w / r + b), and the shingle of least ln c - r (t - b) - r is taken with its t."""
    log_w = np.log(weights).astype(np.float32)
    best = np.full(len(_SEEDS), np.inf, np.float32)
    out = np.zeros(len(_SEEDS), np.uint64)
    columns = np.arange(len(_SEEDS))
    step = max(1, CELLS // len(_SEEDS))
    for k in range(0, len(hashes), step):
        some = hashes[k : k + step]
        x = mix(some[:, None] ^ _SEEDS[None, :])
        u = x.view("<u2").reshape(*x.shape, 4).astype(np.float32)
        u += np.float32(0.5)
        less_r, ln_c = np.log(u[..., 0] * u[..., 1] * _SCALE), np.log(-np.log(u[..., 2] * u[..., 3] * _SCALE))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        b = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(b - log_w[k : k + step, None] / less_r)
        ln_c += less_r * (t - b + np.float32(1))
        at = ln_c.argmin(0)
        low = ln_c[at, columns]
        new = low < best
        best[new] = low[new]
        out[new] = (some[at] ^ mix(t[at, columns].astype(np.int64).view(np.uint64)))[new]
    return mix(out)


def bands_of(sample: np.ndarray) -> np.ndarray:
    """One key for each band, different in different bands."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in sample.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(31) + row)
    return key.view(np.int64)


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sparse vectors."""
    at = np.searchsorted(ha, hb)
    inside = at < len(ha)
    same = np.zeros(len(hb), bool)
    same[inside] = ha[at[inside]] == hb[inside]
    low = np.minimum(wa[at[same]], wb[same]).sum()
    whole = wa.sum() + wb.sum() - low
    return float(low / whole) if whole else 0.0


def prefix(hashes: np.ndarray, weights: np.ndarray, texts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shared ones among a text's rarest shingles that a text as similar as the threshold must share one of, and the weight of
    the shingles before each.

    What two such texts share weighs the threshold's part of either at least. So the first shingle that they share, in an order that
    is the same for all texts, stands where less than that has been left out of both."""
    by = np.lexsort((hashes, texts))
    before = np.cumsum(weights[by]) - weights[by]
    end = np.searchsorted(before, (1 - threshold) * weights.sum() * (1 + 1e-6), "right")
    some = np.flatnonzero(texts[by[:end]] > 1)
    return hashes[by[some]], before[some]


def _wide_key(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bucket and low bits of a hash in one number."""
    return (bucket.astype(np.uint64) << np.uint64(40)) | low


def _signed(docs: DataFrame, texts: int, size: int, threshold: float) -> DataFrame:
    """(id, total, bands, rare, before, hashes, weights) of the texts that can have a partner; id is the md5 of a text's words.

    docs: (doc_id, id, text, chosen) with a row of chosen = true without text for each (doc_id, id) whose text counts, besides the texts."""
    buckets = bucket_number(size)

    def prepare(table: pa.Table) -> pa.Table:
        marks = table.column("chosen")
        keys = list(zip(table.column("doc_id").to_pylist(), table.column("id").to_pylist(), strict=True))
        chosen = {k for k, mark in zip(keys, marks.to_pylist(), strict=True) if mark}
        keep = []
        for k, mark in zip(keys, marks.to_pylist(), strict=True):
            keep.append(not mark and k in chosen)
            if keep[-1]:
                chosen.discard(k)
        return table.filter(pa.array(keep, pa.bool_()))

    def none(part: Slice, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def items(part: Slice, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, _, at = distinct(*shingles(part))
        return h, np.ones(len(h), np.int64)

    def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
        """Shingles of two texts or more with their numbers of texts."""
        some = counts > 1
        return hashes[some].tobytes() + counts[some].tobytes()

    def finish(rows: pa.Table, _hashes: np.ndarray, _counts: np.ndarray, packed: list) -> pa.Table:
        out = {k: [] for k in ("id", "total", "bands", "rare", "before", "hashes", "weights")}
        keys, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for bucket, raw in packed:
            n = len(raw) // 16
            keys.append(_wide_key(np.full(n, bucket), np.frombuffer(raw, np.uint64, n)))
            numbers.append(np.frombuffer(raw, np.int64, n, 8 * n))
        keys, numbers = np.concatenate(keys), np.concatenate(numbers)
        by = np.argsort(keys)
        keys, numbers = keys[by], numbers[by]
        for part in slices(rows.column("text")) if rows.num_rows else ():
            h, tf, at = distinct(*shingles(part))
            df = np.maximum(get(keys, numbers, _wide_key(bucket_of(h, buckets), low_bits(h))), 1)
            w = tf * (1 + RARE * np.log((1 + texts) / (1 + df)) / np.log(1 + max(texts, 1)))
            shared = sums(np.where(df > 1, w, 0.0), at)
            total = sums(w, at)
            for k in np.flatnonzero((shared >= threshold * total * (1 - 1e-9)) & (total > 0)):
                some = slice(at[k], at[k + 1])
                out["id"].append(rows.column("id")[part.at + int(k)].as_py())
                out["total"].append(float(total[k]))
                out["bands"].append(bands_of(samples(h[some], w[some])).tolist())
                rare, before = prefix(h[some], w[some], df[some], threshold)
                out["rare"].append(rare.view(np.int64).tolist())
                out["before"].append(before.tolist())
                out["hashes"].append(h[some].tobytes())
                out["weights"].append(w[some].astype(np.float32).tobytes())
        types = [pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
        return pa.table([pa.array(out[k], t) for k, t in zip(out, types, strict=True)], names=list(out))

    schema = "id string, total double, bands array<long>, rare array<long>, before array<double>, hashes binary, weights binary"
    return counted_blocks(docs.withColumn("block_key", F.struct("doc_id", "id")), none, finish, schema, size, pairs=items, pack=pack, prepare=prepare)


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs at least threshold similar. Both joins are on ids, and Spark splits a hot leader's side."""
    a = vectors.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    b = vectors.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, wa, hb, wb = (batch.column(batch.schema.get_field_index(c)) for c in ("ha", "wa", "hb", "wb"))
            keep = [similarity(np.frombuffer(ha[i].as_py(), np.uint64), np.frombuffer(wa[i].as_py(), np.float32).astype(np.float64), np.frombuffer(hb[i].as_py(), np.uint64), np.frombuffer(wb[i].as_py(), np.float32).astype(np.float64)) >= threshold for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = vectors.schema["id"].dataType.simpleString()
    return mapped(pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "wa", "hb", "wb"), run, f"a {kind}, b {kind}")


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component): the least id reachable over links (a, b), for every id in a link.

    Each round hooks every root to the least root next to it, follows hooks to their ends by doubling, and leaves links
    between different roots only. Of linked roots half at most are left, so rounds, and doublings in a round, grow with the
    logarithm of the ids; more than most_rounds of either is an error."""
    edges = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    for _ in range(most_rounds):
        roots = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
        for _ in range(most_rounds):
            jump = roots.select(F.col("id").alias("label"), F.col("label").alias("lower"))
            moved = Observation()
            following = roots.join(jump, "label").select("id", F.col("lower").alias("label"), F.col("label").alias("old"))
            roots = written(following.observe(moved, F.count_if(F.col("label") != F.col("old")).alias("n")), "labels").select("id", "label")
            if not moved.get["n"]:
                break
        else:
            raise RuntimeError(f"components: hooks didn't end after {most_rounds} doublings")
        if labels is None:
            labels = roots
        else:
            higher = roots.select(F.col("id").alias("label"), F.col("label").alias("lower"))
            labels = written(labels.join(higher, "label", "left").select("id", F.coalesce("lower", "label").alias("label")), "labels")
        ends = roots.select(F.col("id").alias("a"), F.col("label").alias("la")), roots.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        edges, left = written_n(edges.join(ends[0], "a").join(ends[1], "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        if not left:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components: links were left after {most_rounds} rounds")


def extended(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """found, components as of `components`, with more links (a, b): only these and the components that they join are gone through again."""
    if found is None:
        return components(links)
    ends = [found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    low, high = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    joined = components(links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(low.alias("a"), high.alias("b")).filter("a <> b").distinct())
    new = joined.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    lower = joined.select(F.col("id").alias("component"), F.col("component").alias("lower"))
    return written(found.unionByName(new).join(lower, "component", "left").select("id", F.coalesce("lower", "component").alias("component")), "components")


def _held(banded: DataFrame, found: DataFrame | None) -> DataFrame:
    """Texts by bucket with their components; a text without links is one."""
    if found is None:
        return banded.withColumn("component", F.col("id"))
    return banded.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def similar(vectors: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame | None:
    """(id, component) of texts with links among those that share a bucket; None if there are no links. vectors: see _signed."""

    def fits(a: str, b: str):
        return F.least(a, b) >= threshold * F.greatest(a, b) * (1 - 1e-6)

    banded = written(vectors.select("id", "total", F.explode("bands").alias("key")), "bands")
    found = None
    for k in range(rounds):
        held = _held(banded, found)
        groups = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "total")).alias("next"))
        mixed = groups.groupBy("key").agg(F.max(F.struct("n", "component", "next")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
        offers = mixed.select("key", F.col("most.component").alias("largest"), F.col("most.next").alias("next"))
        met = held.join(offers, "key").filter((F.col("component") != F.col("largest")) & fits("total", "next.total"))
        pairs, n = written_n(met.groupBy("id").agg(F.min("next").alias("next")).select(F.col("id").alias("a"), F.col("next.id").alias("b")), "pairs")
        if not n:
            break
        more, n = written_n(_verified(pairs, vectors, threshold), "links")
        if n:
            found = extended(found, more)
    # what is left, exactly
    held = _held(banded, found)
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
    open_ = held.join(mixed.select("key", F.col("most.component").alias("largest")), "key")
    open_ = open_.groupBy("id", "component").agg(F.bool_or(F.col("component") != F.col("largest")).alias("outside"))
    links = _linked_blocks(open_, vectors, threshold)
    return found if links is None else extended(found, links)


def _linked_blocks(open_: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) between texts of different components, of which one is outside: for any two components with such a pair, at least one;
    None if there are none. open_: (id, component, outside).

    Texts meet by blocks, not one by one: a text belongs to the shingle of its prefix that most of these texts share, and such a cluster is
    split by hash into blocks of BLOCK_TEXTS texts or BLOCK_BYTES of vectors. Two blocks meet if they share a shingle of prefixes from
    which on enough weight is left in both, and then all their texts are compared. So rows grow with blocks that have something to
    compare, and a vector moves once for each such block, not for each pair."""
    one = F.transform("rare", lambda x, i: F.struct(x.alias("shingle"), F.get("before", i).alias("before")))
    size = (F.octet_length("hashes") + F.octet_length("weights")).cast("long")
    some = open_.join(vectors.select("id", "total", size.alias("size"), F.explode(one).alias("s")), "id")
    some = written(some.select("id", "component", "total", "outside", "size", "s.shingle", (F.col("total") - F.col("s.before")).alias("left")), "rare-shingles")
    counts = some.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("last"), F.bool_or("outside").alias("any"))
    shared = counts.filter("least <> last and any").select("shingle", "n", F.col("n").alias("texts"))
    some = written(lookup_join(some, shared, "shingle", "n", ["texts"]).filter("texts is not null"), "shared-shingles")
    texts = some.groupBy("id").agg(*(F.first(c).alias(c) for c in ("component", "total", "outside", "size")), F.max(F.struct("texts", "shingle"))["shingle"].alias("cluster"))
    clusters = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    texts = lookup_join(texts, clusters, "cluster", "n", ["blocks"])
    texts = written(texts.withColumn("block", F.xxhash64("cluster", F.pmod(F.xxhash64("id"), F.col("blocks")))).select("id", "component", "total", "outside", "block"), "blocks")
    by = some.select("id", "shingle", "left").join(texts, "id").groupBy("shingle", "block").agg(F.max("left").alias("left"), F.min("total").alias("total"), F.bool_or("outside").alias("outside"), F.min("component").alias("low"), F.max("component").alias("high"))
    by = written(by, "block-shingles")
    a, b = (by.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "left", "total", "outside", "low", "high"))) for side in "ab")
    enough = F.least("left_a", "left_b") >= (F.col("total_a") + F.col("total_b")) * (threshold / (1 + threshold) * (1 - 1e-6))
    differ = (F.col("low_a") != F.col("high_b")) | (F.col("high_a") != F.col("low_b"))
    meet = (a["shingle"] == b["shingle"]) & (F.col("block_a") <= F.col("block_b")) & (F.col("outside_a") | F.col("outside_b")) & differ & enough
    pairs, n = written_n(a.join(b, meet).select("block_a", "block_b").distinct(), "block-pairs")
    if not n:
        return None
    members = written(texts.join(vectors.select("id", "hashes", "weights"), "id"), "members")
    sides = [pairs.join(members.withColumnRenamed("block", f"block_{side}"), f"block_{side}").select(F.col("block_a").alias(f"x{side}"), F.col("block_b").alias(f"y{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "outside", "hashes", "weights"))) for side in "ab"]
    kind = vectors.schema["id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        out, seen = {"a": [], "b": []}, set()
        if left.num_rows and right.num_rows:
            ids, parts = right.column("id_b").to_pylist(), right.column("component_b").to_pylist()
            vectors_b = [(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(w.as_py(), np.float32).astype(np.float64)) for h, w in zip(right.column("hashes_b"), right.column("weights_b"), strict=True)]
            index = Postings(vectors_b)
            free = np.array(right.column("outside_b").to_pylist())
            for i, (name, part, outside) in enumerate(zip(*(left.column(c).to_pylist() for c in ("id_a", "component_a", "outside_a")), strict=True)):
                h, w = np.frombuffer(left.column("hashes_a")[i].as_py(), np.uint64), np.frombuffer(left.column("weights_a")[i].as_py(), np.float32).astype(np.float64)
                for k in np.flatnonzero((index.similarities(h, w) >= threshold) & (outside | free)):
                    link = (min(part, parts[k]), max(part, parts[k]))
                    if part != parts[k] and link not in seen:
                        seen.add(link)
                        out["a"].append(name)
                        out["b"].append(ids[k])
        return pa.table({c: pa.array(out[c], left.schema.field("id_a").type) for c in "ab"})

    links, n = written_n(sides[0].groupBy("xa", "ya").cogroup(sides[1].groupBy("xb", "yb")).applyInArrow(compare, f"a {kind}, b {kind}"), "links")
    return links if n else None


class Postings:
    """Sparse vectors by shingle, for the weighted Jaccard similarities of one more vector to all of them at once."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        hashes = np.concatenate([h for h, _ in vectors])
        by = np.argsort(hashes, kind="stable")
        owner_ = np.repeat(np.arange(len(vectors)), [len(h) for h, _ in vectors])
        self.owner, self.weights = owner_[by], np.concatenate([w for _, w in vectors])[by]
        self.hashes, self.first = np.unique(hashes[by], return_index=True)
        self.ends = np.append(self.first[1:], len(hashes))
        self.totals = np.array([w.sum() for _, w in vectors])

    def similarities(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        some = np.flatnonzero(at < len(self.hashes))
        some = some[self.hashes[at[some]] == hashes[some]]
        first, n = self.first[at[some]], self.ends[at[some]] - self.first[at[some]]
        # all postings of the shared shingles, one after the other
        place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(some) else np.zeros(0, np.int64)
        low = np.bincount(self.owner[place], np.minimum(self.weights[place], np.repeat(weights[some], n)), len(self.totals))
        whole = self.totals + weights.sum() - low
        return np.divide(low, whole, out=np.zeros(len(low)), where=whole > 0)


def _copy(text: str):
    """Hash of a text's words; a null text is an empty one."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def _classes(docs: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """(doc_id, copy, class_id, class_copy) of every row; class_copy is the copy whose text stands for the class."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _copy(text).alias("copy"))
    keys = written(rows.select("doc_id", "copy", F.octet_length("text").alias("size")), "copies")
    first = written(keys.groupBy("copy").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"), F.count("*").alias("n")), "first-copies")
    r = first.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    marks = first.select(F.col("least").alias("doc_id"), F.col("copy").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("chosen"))
    marked = rows.select("doc_id", F.col("copy").alias("id"), "text", F.lit(False).alias("chosen")).unionAll(marks)
    found = similar(written(_signed(marked, r["n"] or 0, r["size"] or 0, threshold), "vectors"), threshold)
    nodes = _held(first.withColumnRenamed("copy", "id"), found)
    # the least id of a class; a null one only if there is no other
    heads = nodes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("head"), F.count("*").alias("rows"))
    named = lookup_join(nodes.select("id", "n", F.xxhash64("component").alias("of")), heads.select(F.xxhash64("component").alias("of"), "head", "rows"), "of", "rows", ["head"])
    table = written(named.select(F.xxhash64("id").alias("of"), F.col("n").alias("rows"), F.col("head.least").alias("class_id"), F.col("head.id").alias("class_copy")), "classes")
    return lookup_join(keys.select("doc_id", "copy", F.xxhash64("copy").alias("of")), table, "of", "rows", ["class_id", "class_copy"]).drop("of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least id of its class) of every row."""
    return _classes(docs, id_col, text, threshold).select("doc_id", "class_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without all rows but those with the least id and the text that stand for a class; rows without an id are kept."""
    kept = _classes(docs, id_col, text, threshold).filter("doc_id = class_id and copy = class_copy").select(F.col("doc_id").alias("kept_id"), F.col("copy").alias("kept_copy")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), _copy(text).alias("copy"))
    named = rows.filter("doc_id is not null").join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("copy") == F.col("kept_copy")), "left_semi")
    return named.select("row.*").unionAll(rows.filter("doc_id is null").select("row.*"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
