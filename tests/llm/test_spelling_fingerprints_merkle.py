"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import fingerprints, merkle, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    near = {w: [v for v in words if v != w and one_apart(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 10 * words[w] else None for w, v in form.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def texts_with_variants():
    rng = np.random.default_rng(7)
    stems = ["".join(rng.choice(list("abcdefé"), rng.integers(7, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa", "ÀBCDEFG", "straßen", "strassen"]
    rows = []
    for i in range(60):
        words = []
        for s in rng.choice(stems, 40):
            k, c = int(rng.integers(0, len(s))), str(rng.choice(list("abcdefé")))
            words += [str(s)] * int(rng.integers(1, 12)) + [s[:k] + c + s[k + 1 :], s[:k] + s[k + 1 :], s[:k] + c + s[k:]]
        rows.append((i, " ".join(words)))
    return [*rows, rows[3], (None, rows[5][1]), (61, None), (62, ""), (63, "short one"), (64, "Capital " * 900 + "capitel " * 5 + "kapital " * 4 + "capxital " * 80 + "capxitai " * 3)]


def test_spelling_equals_brute_force(spark):
    rows = texts_with_variants()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    words = plain_words(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(spelling.word_counts(docs)).collect()}
    want = plain_groups(words)
    assert got == want and sum(f is not None for f, *_ in want.values()) > 50
    assert any(root not in (w, form) and form for w, (form, root, *_) in want.items())  # a chain of two forms
    assert spelling.spelling_groups(spelling.word_counts(docs.filter("1 = 0"))).count() == 0


def test_pivots_are_disjoint_and_cheapest(spark):
    words = spark.createDataFrame([(w, 2) for w in ("abcdefg", "aaaaaaa", "abababab", "zxyabcd", "bcdefga", "xxxxxxyz")], "word string, n long")
    for r in spelling.signatures(words).collect():
        a, b = (p.place for p in r.pivots)
        assert abs(a - b) >= spelling.GRAM
        cells = [(g.cost, g.place) for g in r.prefix]
        assert sum(p.cost for p in r.pivots) == min(x + y for x, i in cells for y, j in cells if j - i >= spelling.GRAM)
        assert len(r.prefix) >= spelling.GRAM * spelling.EDITS + 1 and all(p in r.prefix for p in r.pivots)


# --- fingerprints


def weighted_terms(text, k=fingerprints.SHINGLE):
    w = WORD.findall(text)
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    a, b = weighted_terms(a), weighted_terms(b)
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def test_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{k}é" for k in range(50)], int(n))) for n in rng.integers(1, 400, 40)]
    texts = [*base, base[0], base[0], None, "", " \n", "odd", "z " * 30_000, "z " * 20_000 + base[1]]
    ids = [int(i) for i in rng.permutation(len(texts))]
    rows = [(i, t, "c", 0.5) for i, t in zip(ids, texts)] + [(None, "no id at all", "c", 0.5), (5, "another five", "c", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, near_next double")
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    ordered = sorted(((-1 if i is None else i), t or "") for i, t, *_ in rows)
    want = {}
    for k, (i, t) in enumerate(ordered):
        want.setdefault(i, []).append((t, [ordered[(k + 1) % len(ordered)][1]]))
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        fits = []
        for t, _ in want[key]:
            for following in {u for _, u in ordered}:
                e = fingerprints.edited(t, following)
                if len(t) == r.n_chars and hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256:
                    fits.append((t, following, e))
        assert fits, r.doc_id
        if len(want[key]) == 1:
            t, (following,) = want[key][0]
            if key != 4 or len(want[5]) == 1:  # before two rows of one id, either may follow
                e = fingerprints.edited(t, following)
                assert hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256
                assert abs(r.near_edited - jaccard(t, e)) < 0.25 and abs(r.near_next - jaccard(t, following)) < 0.25
            by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == by_text[" \n"] and len(by_text) == len({v for f in by_text.values() for v in f}) + 1
    assert fingerprints.fingerprints(docs.filter("1 = 0")).count() == 0
    one = fingerprints.fingerprints(docs.filter("text = 'odd'")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"odo").hexdigest()


def test_collision_rate_is_the_likeness():
    rng = np.random.default_rng(11)
    errors = []
    for _ in range(120):
        words = [f"t{k}" for k in range(60)]
        a = {w: int(rng.integers(0, 6)) for w in words}
        b = {w: max(0, a[w] + int(rng.integers(-2, 3))) for w in words}
        keys = [np.array([i for i, w in enumerate(words) if x[w]], np.uint64) for x in (a, b)]
        weights = [np.array([x[w] for w in words if x[w]], np.int64) for x in (a, b)]
        signs = fingerprints.signatures(np.concatenate(keys), np.concatenate(weights), np.array([0, len(keys[0]), len(keys[0]) + len(keys[1])]), 512)
        errors.append((signs[0] == signs[1]).mean() - sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words))
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.03


def test_long_texts_are_drawn_alike():
    n = fingerprints.LONG + 5
    keys, weights = np.arange(n, dtype=np.uint64), np.ones(n, np.int64)
    weights[::7] = 3
    whole = fingerprints.signatures(keys, weights, np.array([0, n]), 16)
    table = fingerprints.drawn(keys, weights, 16).min(0) & np.uint64(0xFFFF)
    assert (whole[0] == table).all()


# --- merkle


def plain_manifest(rows):
    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)

    def climb(row):
        levels = [row]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, at):
        out = []
        for row in levels[:-1]:
            first = at // 8 * 8
            out.append((row[first:at], row[at + 1 : first + 8]))
            at //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for v in langs}
    levels = {v: climb([leaf(r) for r in t]) for v, t in trees.items()}
    top = climb([levels[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for at, r in enumerate(trees[v]):
            path = siblings(levels[v], at) + siblings(top, k)
            changed = (*r[:4], r[4].translate(UPPER) if r[4] is not None else None)
            folded = leaf(changed if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 else r)
            for left, right in path:
                folded = h([*left, folded, *right])
            out.append((r[0], leaf(r), levels[v][-1][0], top[-1][0], h(x for left, right in path for x in left + right), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("run", [(8, 4), (8, 1)])
def test_manifest_equals_plain_trees(spark, monkeypatch, run):
    monkeypatch.setattr(merkle, "LEVELS", run[1])
    monkeypatch.setattr(merkle, "BLOCK", run[0] ** run[1])
    rows = [(i, f"s{i % 3}", ["en", "de", None, "é", "en"][i % 5], i * 7, f"Text {i} " + "É" * (i % 3)) for i in range(200)]
    rows += [(None, None, "en", None, None), (3, "s0", "de", 1, ""), (3, "s0", "de", 1, ""), (4, "s0", "one", 1, "A" * 70_000), (5, None, "two", -4, "lower only")]
    rows += [(300 + i, "s", f"l{i}", i, "Aa") for i in range(12)]
    docs = spark.createDataFrame([(*r, "leaf", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place int")
    lowered = {"text": F.translate("text", merkle._UPPER, merkle._LOWER)}
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    got = merkle.manifest(docs, changed=lowered, where=chosen).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}
    assert all(r.verified for r in merkle.manifest(docs).collect())
    assert merkle.manifest(docs.filter("1 = 0")).count() == 0


def test_missing_is_the_least_set():
    rng = np.random.default_rng(5)
    for n in (1, 2, 8, 9, 64, 65, 700):
        for k in (1, min(3, n), n):
            places = np.sort(rng.choice(n, k, replace=False))
            wanted = merkle.missing(places, n)
            digests = [f"{i:064x}" for i in range(n)]
            rows = [digests]
            while len(rows[-1]) > 1:
                rows.append([merkle._digest(rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
            proof = merkle.Multiproof(places.tolist(), [digests[p] for p in places], n, {(a, p): rows[a][p] for a, p in wanted})
            assert proof.root == rows[-1][0]
            # no wanted node can be made from the leaves and the others
            made = {(0, int(p)) for p in places} | set(wanted)
            for level in range(merkle.height(n)):
                size = len(rows[level])
                made |= {(level + 1, p) for p in range(-(-size // 8)) if all((level, c) in made for c in range(p * 8, min(p * 8 + 8, size)))}
            for a, p in wanted:
                assert a == 0 or not all((a - 1, c) in made for c in range(p * 8, min(p * 8 + 8, len(rows[a - 1]))))
