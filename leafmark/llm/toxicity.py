"""Toxicity by a fuzzy lexicon: Levenshtein automata intersected with a trie, and scores of context windows.

Terms are learned from a bounded sample of labelled rows: words, or beginnings of words, that stand in toxic texts
and hardly in others; copies of one text count once. The trie of the terms
and the Levenshtein automaton of each (one edit of a code point for whole words of FUZZY_LENGTH letters or more) are intersected
into one deterministic automaton, which reads all tokens of a batch at once. Each hit's weight is the share of toxic texts among
the sample's texts with such a hit; a hit that its window of words shows as quoted counts for little (QUOTED), and
hits of a text add up as independent evidence.

Cases: null and empty texts have no tokens and score as texts without hits; unknown labels are not learned from;
without toxic rows there are no terms and every score is the base rate; equal texts score alike; rows with equal
ids are scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import Slice, documents, give_back, in_fold, labels, mapped, slices, word_bounds
from leafmark.llm.compression import labelled_sample

#: Most rows of each class and most terms that the lexicon is made from; least texts (as a number and as a share of the
#: toxic ones) and least odds of a term.
SAMPLE, TERMS, SUPPORT, SUPPORT_SHARE, ODDS = 2000, 64, 3, 0.02, 40.0
FUZZY_LENGTH, PREFIXES = 5, range(4, 9)
#: Words on either side of a hit that are looked at, and what is left of a quoted hit's weight.
CONTEXT, QUOTED = 6, 0.25
THRESHOLD = 0.3
_QUOTES = ('"', "“", "”", "«", "»", "„")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words less the marks around them: starts, ends (a word of marks alone is empty), and words before each text."""
    starts, ends, first = word_bounds(part)
    n = len(part.data)
    core = np.flatnonzero(_CORE[part.data])
    if not len(core):
        return starts, starts.copy(), first
    following = np.append(core, n)[np.searchsorted(core, starts)]
    last = np.concatenate([[-1], core])[np.searchsorted(core, ends)] + 1
    left = np.minimum(following, ends)
    return left, np.maximum(last, left), first


def points(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """A slice's code points, A-Z lower-cased, and for each byte how many code points begin before it."""
    letters = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    small = np.where((letters >= 65) & (letters <= 90), letters + np.uint32(32), letters)
    return small, np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])


class Term:
    __slots__ = ("edits", "prefix", "text")

    def __init__(self, text: str, prefix: bool):
        self.text, self.prefix = text, prefix
        self.edits = int(not prefix and len(text) >= FUZZY_LENGTH)


class Automaton:
    """The deterministic automaton of all strings within a term's edits of it (or beginning with it).

    A state is a set of (trie node, edits) pairs, or the finding of a beginning, which no letter changes."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        room = [0]  # most edits of any term below a node
        for k, term in enumerate(terms):
            node = 0
            room[0] = max(room[0], term.edits)
            for letter in map(ord, term.text):
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    ends.append(-1)
                    room.append(0)
                node = children[node][letter]
                room[node] = max(room[node], term.edits)
            ends[node] = k
        letters = sorted({ord(c) for t in terms for c in t.text})
        self.letter = np.zeros(max(letters, default=0) + 2, np.int64)  # 0: in no term, and the last for all letters beyond
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.longest = max((len(t.text) + t.edits for t in terms), default=0)

        def closed(found: dict[int, int]) -> frozenset:
            todo = list(found.items())
            while todo:
                node, e = todo.pop()
                for child in children[node].values():
                    if e + 1 <= room[child] and found.get(child, 9) > e + 1:
                        found[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(found.items())

        def stays(state: frozenset) -> int:
            hit = [ends[node] for node, e in state if e == 0 and ends[node] >= 0 and terms[ends[node]].prefix]
            return hit[0] if hit else -1

        def step(state: frozenset, letter: int) -> frozenset:
            found: dict[int, int] = {}
            for node, e in state:
                if (child := children[node].get(letter)) is not None and e <= room[child]:
                    found[child] = min(found.get(child, 9), e)
                if e < room[node]:
                    found[node] = min(found.get(node, 9), e + 1)
                for other, child in children[node].items():
                    if other != letter and e + 1 <= room[child]:
                        found[child] = min(found.get(child, 9), e + 1)
            return closed(found)

        dead = frozenset()
        start = closed({0: 0})
        number = {dead: 0, start: 1}
        order = [dead, start]
        rows: list[list[int]] = [[0] * (len(letters) + 1)]
        at = 1
        while at < len(order):
            state = order[at]
            if stays(state) >= 0:
                rows.append([at] * (len(letters) + 1))
            else:
                row = []
                for letter in [-1, *letters]:
                    following = step(state, letter)
                    if following not in number:
                        number[following] = len(order)
                        order.append(following)
                    row.append(number[following])
                rows.append(row)
            at += 1
        self.moves = np.array(rows, np.int32)
        self.term = np.full(len(order), -1, np.int32)
        self.edits = np.zeros(len(order), np.int32)
        for k, state in enumerate(order):
            if (fixed := stays(state)) >= 0:
                self.term[k] = fixed
                continue
            hits = [(e, ends[node]) for node, e in state if ends[node] >= 0 and e <= terms[ends[node]].edits and not terms[ends[node]].prefix]
            if hits:
                self.edits[k], self.term[k] = min(hits)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state in which each token ends. data: code points, A-Z lower-cased; starts and ends count these."""
        state = np.ones(len(starts), np.int32)
        alive = np.flatnonzero(ends > starts)
        state[ends <= starts] = 0
        for k in range(self.longest + 1):
            alive = alive[starts[alive] + k < ends[alive]]
            if not len(alive):
                break
            state[alive] = self.moves[state[alive], self.letter[np.minimum(data[starts[alive] + k], len(self.letter) - 1)]]
            alive = alive[state[alive] > 0]
        return state


def _words(text: str) -> list[str]:
    raw = text.encode()
    starts, ends, _ = tokens(Slice(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    lower = raw.translate(bytes(_LOWER))
    return [lower[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _copies(texts: list[list[str]], minima: int = 8) -> list[int]:
    """A group number for each of a sample's texts: texts that share one of their smallest pair hashes are copies."""
    group = list(range(len(texts)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    first: dict[int, int] = {}
    for k, words in enumerate(texts):
        for h in sorted({zlib.crc32(" ".join(words[i : i + 2]).encode()) for i in range(max(1, len(words) - 1))})[:minima]:
            group[root(k)] = root(first.setdefault(h, k))
    return [root(k) for k in range(len(texts))]


def learn_terms(sample: list[tuple[str, int]], most: int = TERMS, support: int = SUPPORT, odds: float = ODDS) -> list[Term]:
    """Words and beginnings that mark toxic texts, by the (text, word) pairs that they newly explain."""
    toxic = [_words(t) for t, label in sample if label]
    n_toxic, n_clean = len(toxic), sum(1 for _, label in sample if not label)
    if not n_toxic or not n_clean:
        return []

    def beginnings(w: str) -> list[tuple[str, bool]]:
        return [(w, False), *((w[:m], True) for m in PREFIXES if m < len(w))]

    of_copy: dict[int, set] = defaultdict(set)
    for d, words in zip(_copies(toxic), toxic, strict=True):
        of_copy[d].update(w for w in words if len(w) >= 3)
    del toxic
    n = len(of_copy)
    support = max(support, round(SUPPORT_SHARE * n))
    often = Counter(c for words in of_copy.values() for w in words for c in beginnings(w))
    inside: dict[tuple[str, bool], set] = {c: set() for c, k in often.items() if k >= support}
    del often
    for d, words in of_copy.items():
        for w in words:
            pair = (d, w)
            for c in beginnings(w):
                if c in inside:
                    inside[c].add(pair)
    fit = {c: pairs for c, pairs in inside.items() if len({d for d, _ in pairs}) >= support}
    clean_df = Counter()
    for text, label in sample:
        if not label:
            clean_df.update({c for w in set(_words(text)) for c in beginnings(w) if c in fit})

    def worth(c: tuple[str, bool], pairs: set) -> float:
        """Pairs explained less the clean texts that it would accuse, each as ten."""
        return len(pairs) - 10.0 * clean_df[c] * n_toxic / n_clean

    fit = {c: p for c, p in fit.items() if (len({d for d, _ in p}) + 0.5) / (n + 1) / ((clean_df[c] + 0.5) / (n_clean + 1)) >= odds}
    chosen, done = [], set()
    for c in sorted(fit, key=lambda c: (-worth(c, fit[c]), c[1], -len(c[0]), c[0])):
        if len(chosen) == most:
            break
        new = fit[c] - done
        if len({d for d, _ in new}) >= support and worth(c, new) > 0:
            chosen.append(Term(*c))
            done |= fit[c]
    return chosen


def quoted(before: bytes, after: bytes) -> bool:
    """Whether the words before a hit open a quotation that the words after it close."""
    left, right = before.decode(errors="ignore"), after.decode(errors="ignore")
    return sum(left.count(q) for q in _QUOTES) % 2 == 1 and any(q in right for q in _QUOTES)


class ToxicityModel:
    def __init__(self, terms: list[Term], base_rate: float):
        self.automaton = Automaton(terms)
        self.weight = np.zeros((len(terms), 2))
        self.none = base_rate

    def hits(self, part: Slice) -> tuple[list[list[tuple[int, int, bool]]], np.ndarray]:
        """(term, edits, quoted) of the hits of each text, and words before each text."""
        found: list[list[tuple[int, int, bool]]] = [[] for _ in range(part.n)]
        raw_starts, raw_ends, first = word_bounds(part)
        starts, ends, _ = tokens(part)
        letters, before = points(part)
        state = self.automaton.run(letters, before[starts], before[ends])
        at = np.flatnonzero(self.automaton.term[state] >= 0)
        of = np.searchsorted(first, at, "right") - 1
        for k, d in zip(at.tolist(), of.tolist(), strict=True):
            lo, hi = max(first[d], k - CONTEXT), min(first[d + 1] - 1, k + CONTEXT)
            inside = quoted(bytes(part.data[raw_starts[lo] : starts[k]]), bytes(part.data[ends[k] : raw_ends[hi]]))
            found[d].append((int(self.automaton.term[state[k]]), int(self.automaton.edits[state[k]]), inside))
        return found, first

    def score(self, hits: list[tuple[int, int, bool]]) -> float:
        clean = 1.0 - self.none
        for term, edits, inside in hits:
            clean *= 1.0 - float(self.weight[term, edits]) * (QUOTED if inside else 1.0)
        return 1.0 - clean

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], counts: dict[int, int]) -> ToxicityModel:
        n = Counter(label for _, label in sample)
        whole = counts.get(0, 0) + counts.get(1, 0)
        model = cls(learn_terms(sample), 0.0)
        ratio = [counts.get(k, 0) / max(1, n[k]) for k in (0, 1)]
        seen = np.zeros((len(model.weight), 2, 2))
        silent = [0.0, 0.0]
        hits = [h for part in slices(pa.array([t for t, _ in sample], pa.string())) for h in model.hits(part)[0]]
        for found, (_, label) in zip(hits, sample, strict=True):
            for term, edits in {(t, e) for t, e, _ in found}:
                seen[term, edits, label] += ratio[label]
            if not found:
                silent[label] += ratio[label]
        base = counts.get(1, 0) / whole if whole else 0.0
        prior = np.array([0.5, 0.35])  # of an exact and of a fuzzy hit that the sample never shows
        total = seen.sum(axis=2)
        model.weight = np.clip((seen[:, :, 1] + 2 * prior) / (total + 2), 0, 0.995)
        model.none = silent[1] / sum(silent) if sum(silent) else base
        give_back()
        return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as a struct `row` (or its id alone) with score, hits and fuzzy (hits with an edit)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    whole = id_col is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch.column(0).field(text) if whole else batch.column(1)):
                found, _ = model.hits(part)
                columns = [pa.array([model.score(h) for h in found], pa.float64()), pa.array([len(h) for h in found], pa.int64()), pa.array([sum(e for _, e, _ in h) for h in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.at, part.n), *columns], names=["row", "score", "hits", "fuzzy"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")) if whole else docs.select(F.col(id_col).alias("row"), F.col(text).alias("text"))
    return mapped(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, score double, hits long, fuzzy long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample, counts = labelled_sample(docs, labels(spark, sf_dir).filter(~in_fold("doc_id", 4, 2)), "toxic", SAMPLE)
    scored = score_documents(docs, ToxicityModel.fit(sample, counts))
    return scored.select(F.col("row").alias("doc_id"), in_fold("row", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "fuzzy")
