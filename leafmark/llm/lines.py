"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Lines of LEAST characters or more that are equal, or within THRESHOLD edits of each other (links; classes are their
components), are one class; so are equal shorter lines, unless they are blank: in lines that short two edits can make another
statement ("Chapter 3", "Chapter 4"), so only exact repeats count there. The first line of a class by document and line
number stays, the others go.

Repeats are folded before anything else: the join works on distinct lines, so a line that stands in a third of all documents is
one row. A line falls into THRESHOLD + 1 segments; of two lines within THRESHOLD edits, one holds a segment of the other at
nearly its place. So each line is indexed by its segments (with length and number), and probes, for its own and each smaller
length that is near enough, the substrings that can stand for a segment (`shifts`). Lines that meet in a key are compared with the
key's least line (the leader), and keys that then still hold several classes compare the lines outside the largest class with
the others, where letter counts allow a link: all pairs of a key are never made, yet no link is lost. Pairs are verified by a
banded bit-parallel edit distance: one word holds, for each number of edits, the diagonals of the band that are within it, and a
letter moves all of them at once. It runs over the first and the last letters of a pair before it runs over whole lines.

Cases: null and empty texts and blank lines have no such lines; an empty table gives an empty result; rows with one id and one
text are one document, rows with one id and different texts are different ones, ordered by a hash of the text; repeated lines
of one document count like those of two; of equal lines the first stays; a null id sorts first; lines may be of any length;
other columns are carried and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import documents, lookup_join, written, written_n
from leafmark.llm.weighted_minhash import components, extended

THRESHOLD, LEAST = 2, 40
#: Letters at either end of a line that are compared before the whole line.
ENDS = 16
#: The bitmap of line hashes has 2**BITMAP bits, 512 KB, whatever the corpus.
BITMAP = 22
#: Letters whose counts are compared before the edit distance.
LETTERS = "etaoinsrhldcumpgwbyvfk.,"


def shifts(threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a segment of a line shorter by the difference can stand in a longer one.

    The edits before a segment move it by at most their number, and those after it must make up the rest of the difference."""
    found = []
    for less in range(threshold + 1):
        for k in range(1, threshold + 2):
            left, right = k - 1, threshold + 1 - k
            found += [(less, k, o) for o in range(max(-left, less - right), min(left, less + right) + 1)]
    return found


def _key(line: Column, length: Column, k: int, shift: int, threshold: int) -> Column:
    """Hash of the substring at the place of segment k (moved by shift) of a line of that length."""
    parts = threshold + 1
    size, longer = F.floor(length / parts), length % parts
    # the last `longer` segments have one character more
    extra = F.greatest(F.lit(0), longer - (parts - (k - 1)))
    start = size * (k - 1) + extra + 1
    width = size + F.when(F.lit(k) > parts - longer, 1).otherwise(0)
    return F.xxhash64(F.substring(line, start + shift, width), length, F.lit(k))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, copy, line_no, line) of the lines of `least` characters or more, and of shorter ones that aren't blank."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return rows.filter((F.char_length("line") >= least) | F.col("line").rlike(r"\S"))


class Band:
    """The bit-parallel band: field e of a word says by bit d + threshold that the letters of a so far and d more of b are within e edits."""

    def __init__(self, threshold: int):
        if not 1 <= threshold <= 3:
            raise ValueError("the band's fields fit into 64 bits for one to three edits")
        self.threshold, self.width = threshold, 3 * threshold + 2
        self.bits = (1 << (2 * threshold + 1)) - 1
        self.every = self._fields(self.bits, 0)
        self.start = sum(((1 << (threshold + 1 + e)) - (1 << threshold)) << (self.width * e) for e in range(threshold + 1))

    def _fields(self, value: int, first: int) -> int:
        return sum(value << (self.width * e) for e in range(first, self.threshold + 1))

    def after(self, a: str, b: str) -> str:
        """SQL of the word after all letters of a, an array of letters; b has `threshold` empty ones on both sides."""
        t, w = self.threshold, self.width
        equal = " + ".join(f"CASE WHEN get({b}, i + {d}) = c THEN {self._fields(1 << d, 0)}L ELSE 0L END" for d in range(2 * t + 1))
        # kept diagonals; a letter of a replaced or left out against field e - 1; then letters of b passed over, which reach further fields
        moved = f"((s & m) | (shiftleft(s, {w}) & {self._fields(self.bits, 1)}L) | (shiftleft(shiftright(s, 1) & {self.every}L, {w}) & {self._fields(self.bits, 1)}L))"
        passed = " | ".join([moved, *(f"(shiftleft({moved}, {e * (w + 1)}) & {self._fields(self.bits, e)}L)" for e in range(1, t + 1))])
        return f"aggregate(transform({a}, (c, i) -> {equal}), {self.start}L, (s, m) -> CASE WHEN s = 0L THEN 0L ELSE {passed} END)"

    def edits(self, word: str) -> str:
        """SQL of the least number of edits that any diagonal of a word is within, or threshold + 1."""
        cases = " ".join(f"WHEN ({word} & {self.bits << (self.width * e)}L) <> 0L THEN {e}" for e in range(self.threshold + 1))
        return f"CASE {cases} ELSE {self.threshold + 1} END"

    def padded(self, letters: str) -> str:
        pad = f"array_repeat('', {self.threshold})"
        return f"concat({pad}, {letters}, {pad})"


def within(a: str, b: str, threshold: int = THRESHOLD) -> Column:
    """Whether two lines are within the threshold. One-element arrays bind what the fold reads many times."""
    band = Band(threshold)
    end = f"(char_length({b}) - char_length({a}) + {threshold})"  # the bit of the diagonal in which both lines end
    word = band.after("p.a", "p.b")
    last = f"shiftright(transform(array(named_struct('a', split({a}, ''), 'b', {band.padded(f"split({b}, '')")})), p -> {word})[0], {band.width * threshold} + {end}) & 1"
    # an empty line has no letters to split
    return F.expr(f"CASE WHEN {end} NOT BETWEEN 0 AND {2 * threshold} THEN false WHEN {a} = '' THEN char_length({b}) <= {threshold} ELSE ({last}) = 1 END")


def ends_allow(a: str, b: str, threshold: int = THRESHOLD) -> Column:
    """Whether the first and the last ENDS letters of a, against what can stand for them in b, leave room for a link: their edits
    are edits of different letters, so they add up. Lines too short for two ends are let through."""
    band = Band(threshold)
    near = ENDS + threshold

    def edits(x: str, y: str) -> str:
        word = band.after("p.a", "p.b")
        bound = f"transform(array(named_struct('a', split({x}, ''), 'b', {band.padded(f"split({y}, '')")})), p -> {word})[0]"
        return f"transform(array({bound}), q -> {band.edits('q')})[0]"

    head = edits(f"substring({a}, 1, {ENDS})", f"substring({b}, 1, {near})")
    tail = edits(f"reverse(right({a}, {ENDS}))", f"reverse(right({b}, {near}))")
    return F.expr(f"char_length({a}) < {2 * ENDS} OR (char_length({b}) >= {near} AND ({head}) + ({tail}) <= {threshold}) OR char_length({b}) < {near}")


def _bitmap(ids: DataFrame) -> DataFrame:
    """One row: the low BITMAP bits of all ids as an array of 64-bit words. Its size is fixed."""
    low = F.col("id").bitwiseAND((1 << BITMAP) - 1)
    words = ids.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = ids.sparkSession.range(1 << (BITMAP - 6)).withColumnRenamed("id", "word").join(words, "word", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("words"))
    return one.select(F.col("words.bits").alias("bitmap"))


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, letters) of the distinct lines whose ids are given, and a few more whose ids have the same low bits.

    The bitmap only saves the move of lines that are in no pair; where the pairs fill it, lines move like others."""
    held = F.expr(f"(shiftright(bitmap[cast(shiftright(id & {(1 << BITMAP) - 1}L, 6) AS int)], cast(id & 63 AS int)) & 1) = 1")
    some = lines.crossJoin(F.broadcast(_bitmap(ids))).filter(held)  # one row of 512 KB
    return written(some.select("id", "line", F.array(*(F.char_length("line") - F.char_length(F.replace("line", F.lit(c), F.lit(""))) for c in LETTERS)).alias("letters")), "pair-lines")


def _alike(a: str, b: str, threshold: int) -> Column:
    """Whether letter counts allow the threshold: an edit changes two counts by one at most."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x) <= 2 * threshold


def _parities() -> Column:
    """One bit for each letter: whether its count is odd."""
    bits = [F.get("letters", F.lit(i)).bitwiseAND(1) * (1 << i) for i in range(len(LETTERS))]
    return sum(bits[1:], bits[0])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): the pairs of line hashes within the threshold."""
    a = texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("letters").alias("ha"))
    b = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("letters").alias("hb"))
    both = pairs.join(a, "a").join(b, "b").filter(_alike("ha", "hb", threshold))
    return both.filter(ends_allow("la", "lb", threshold)).filter(within("la", "lb", threshold)).select("a", "b").distinct()


def line_links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, component) of the lines that have links to different ones. lines: distinct (id, line)."""
    line, length = F.col("line"), F.char_length("line")
    own = [F.struct(_key(line, length, k, 0, threshold).alias("key"), F.lit(True).alias("indexed")) for k in range(1, threshold + 2)]
    other = [F.struct(_key(line, length - less, k, o, threshold).alias("key"), F.lit(False).alias("indexed")) for less, k, o in shifts(threshold) if (less, o) != (0, 0)]
    members = lines.select("id", F.explode(F.array(*own, *other)).alias("k")).select("id", "k.key", "k.indexed")
    index = lines.select("id", F.explode(F.array(*(F.struct(x["key"].alias("key")) for x in own))).alias("k")).select("id", "k.key")
    leaders = index.groupBy("key").agg(F.min("id").alias("leader"))
    met = written(members.join(leaders.hint("shuffle_hash"), "key").filter("id <> leader").select("key", "id", "indexed", "leader").distinct(), "met-lines")
    tried = written(met.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "line-pairs")
    texts = _texts(lines, tried.select(F.col("a").alias("id")).unionAll(tried.select(F.col("b").alias("id"))))
    links = written(_verified(tried, texts, threshold), "line-links")
    found = components(links)
    # keys that still hold several classes
    all_members = met.select("key", "id", "indexed").unionAll(met.select("key", F.col("leader").alias("id"), F.lit(True).alias("indexed")).distinct())
    held = all_members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    kinds = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = kinds.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("kinds"), F.sum("n").alias("n")).filter("kinds > 1 and n > 2")
    open_ = written(held.join(mixed.select("key", "largest"), "key").join(texts.select("id", "letters", _parities().alias("parity")), "id"), "open-keys")
    outside = open_.filter("component <> largest").select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("indexed").alias("ia"), F.col("letters").alias("ha"), F.col("parity").alias("pa"))
    others = open_.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("indexed").alias("ib"), F.col("letters").alias("hb"), F.col("parity").alias("pb"))
    # part of the join: pairs that can't be links aren't made. An edit changes two parities at most, which is seen at once
    fits = F.expr(f"bit_count(pa ^ pb) <= {2 * threshold} and ca <> cb and (ia or ib)") & _alike("ha", "hb", threshold)
    rest = outside.join(others, (outside["key"] == others["key"]) & fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest, n = written_n(rest.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "line-pairs")
    if n:
        more, n = written_n(_verified(rest, texts, threshold), "line-links")
        if n:
            found = extended(found, more)
    return found


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(doc_id, copy, line_no, first_doc, first_line, near): the lines that go, and the one that stays for each; copy hashes the text."""
    lines = line_rows(docs, id_col, text, least).withColumn("id", F.xxhash64("line"))
    long = written(lines.filter(F.char_length("line") >= least).select("id", "line").distinct(), "lines")
    found = line_links(long, threshold)
    rows = written(lines.select("doc_id", "copy", "line_no", "id"), "line-rows")
    place = F.struct("doc_id", "copy", "line_no")
    each = rows.groupBy("id").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    each = written(each.join(found, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component"), "line-classes")
    first = each.groupBy("class").agg(F.min(F.struct("at", "id")).alias("first"), F.sum("n").alias("n"), F.count("*").alias("kinds")).filter("n > 1")
    stays = written(lookup_join(each.select("id", "class", "n"), first.select("class", "first", F.col("kinds").alias("rows")), "class", "rows", ["first"]).filter("first is not null"), "line-firsts")
    gone = lookup_join(rows, stays.select("id", "first", F.col("n").alias("rows")), "id", "rows", ["first"]).filter(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first.at")))
    return gone.select("doc_id", "copy", "line_no", F.col("first.at.doc_id").alias("first_doc"), F.col("first.at.line_no").alias("first_line"), (F.col("id") != F.col("first.id")).alias("near"))


def _by_document(gone: DataFrame, *key: str) -> DataFrame:
    return gone.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("line_no", "first_doc", "first_line", "near"))).alias("removed"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chars: str | None = "n_chars", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """docs with the lines that go cut from their texts. A document that had only such lines goes as a whole."""
    by = _by_document(removals(docs, id_col, text, threshold, least), "doc_id", "copy")
    by = by.select(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy"), F.col("removed.line_no").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    old = F.col("row")[text]
    joined = rows.join(by, F.col("row")[id_col].eqNullSafe(F.col("gone_id")) & (F.xxhash64(old) == F.col("gone_copy")), "left")
    kept = F.array_join(F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = joined.select("row", F.col("gone").isNotNull().alias("cut"), F.when(F.col("gone").isNull(), old).otherwise(kept).alias("kept"))
    joined = joined.filter(~F.col("cut") | F.col("kept").rlike(r"\S"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("kept").alias(c)
        if c == chars:
            return F.when(F.col("cut"), F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return joined.select(*map(column, docs.columns))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    by = _by_document(removals(docs.select("doc_id", "text")), "doc_id")
    counts = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = counts.join(by, "doc_id", "left")
    removed = F.coalesce("removed", F.expr("cast(array() AS array<struct<line_no:int,first_doc:bigint,first_line:int,near:boolean>>)"))
    out = out.withColumn("removed", removed)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.size(F.filter("removed", lambda x: x["near"])).cast("long").alias("n_near"), F.col("removed.line_no").alias("line_nos"), F.col("removed.first_doc").alias("first_docs"))
