"""The five stages on a small table with nulls, empty and repeated texts, repeated ids and clashing names, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from leafmark.llm import compression, lines, mixing, pieces, toxicity, weighted_minhash
from leafmark.llm.common import documents, labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvwé", k=rng.randint(3, 9))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    shared = sentence(14)
    texts = [None, "", " \n ", "short", shared, "x" * 60]
    for k in range(60):
        body = "\n".join(sentence(rng.randint(6, 25)) for _ in range(rng.randint(1, 5)))
        texts.append(body + ("\n" + shared if k % 7 == 0 else ""))
    for k in range(8):  # near copies of texts and lines
        words = texts[10 + k].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[30 + k].replace(".", "!", 1))
    texts += texts[20:24]
    for k in range(20):
        insult = rng.choice(["grobulon", "grobulom", "grobulons", "vintrix"])
        texts.append(f"{sentence(9)} you {insult} {sentence(8)}")
    texts.append(sentence(30_000))
    return texts


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    texts = _texts()
    rows = [(k if k != 9 else 8, t, ["en", None, "de"][k % 3], ["web", "book", None, "web", "web"][k % 5], len(t or ""), "extra", -k) for k, t in enumerate(texts)]
    rows += [(None, "a row without an id", "en", "web", 19, "extra", 0), rows[40], rows[0]]
    path = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, `gone` long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    toxic = lambda t: int(bool(re.search("grobulo|vintrix", t or "")))
    spark.createDataFrame([(r[0], 1, toxic(r[1])) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").distinct().write.parquet(f"{path}/labels.parquet")
    return str(path)


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _classes(items, near):
    """Components of items under a test of pairs."""
    of = {x: x for x in items}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if near(a, b):
                of[root(b)] = root(a)
    return {x: root(x) for x in items}


def test_toxicity_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = _rows(corpus_pipeline.drop_toxic(spark, docs, sf_dir))
    model = toxicity.ToxicityModel.fit(*compression.labelled_sample(docs, labels(spark, sf_dir), "toxic", toxicity.SAMPLE))
    terms = model.automaton.terms
    assert terms

    def hits(text):
        found = []
        for w in WORD.findall(text or ""):
            w = re.sub(r"^[^0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff]+$", "", w).translate({c: c + 32 for c in range(65, 91)})
            prefix = [k for k, t in enumerate(terms) if t.prefix and w.startswith(t.text)]
            near = sorted((_distance(w, t.text), k) for k, t in enumerate(terms) if not t.prefix)
            if prefix:
                found.append((prefix[0], 0, False))
            elif near and near[0][0] <= terms[near[0][1]].edits:
                found.append((near[0][1], near[0][0], False))
        return found

    want = [r for r in _rows(docs) if model.score(hits(r["text"])) < toxicity.THRESHOLD]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and list(got[0]) == docs.columns
    assert len(got) < docs.count()
    assert not any("grobulon" in (r["text"] or "") for r in got)


def test_line_dedup_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = Counter((r["doc_id"], r["text"], r["n_chars"], r["gone"]) for r in _rows(corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir)))
    rows = _rows(docs)
    held = defaultdict(set)
    order = {(r["doc_id"], r["text"]): None for r in rows}
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in _rows(docs.selectExpr("doc_id", "text", "xxhash64(text) AS h"))}
    place = lambda d: (d[0] is not None, d[0] or 0, hashes[d])
    for d in order:
        for k, line in enumerate((d[1] or "").split("\n")):
            if d[1] is not None and (len(line) >= lines.LEAST or re.search(r"\S", line)):
                held[line].add((place(d), k))
    long = [x for x in held if len(x) >= lines.LEAST and len(x) < 5000]
    of = _classes(long, lambda a, b: abs(len(a) - len(b)) <= 2 and _near(a, b))
    stays = defaultdict(set)
    for line, at in held.items():
        stays[of.get(line, line)] |= at
    first = {c: min(at) for c, at in stays.items()}
    want = Counter()
    for r in rows:
        d = (r["doc_id"], r["text"])
        parts = (r["text"] or "").split("\n")
        kept = [x for k, x in enumerate(parts) if x not in held or first[of.get(x, x)] == (place(d), k)]
        if len(kept) == len(parts):
            want[*d, r["n_chars"], r["gone"]] += 1
        elif re.search(r"\S", text := "\n".join(kept)):
            want[r["doc_id"], text, len(text), r["gone"]] += 1
    assert got == want


def _near(a, b):
    """Within two edits, by what is left between common ends."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) < 200 and _distance(a, b) <= 2


def test_near_dedup_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = Counter((r["doc_id"], r["text"]) for r in _rows(corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)))
    rows = _rows(docs)
    words = lambda t: tuple(WORD.findall(t or ""))
    least = {}
    for r in rows:
        w = words(r["text"])
        ids = [x for x in (least.get(w), r["doc_id"]) if x is not None]
        least[w] = min(ids) if ids else None
    grams = {w: Counter(w[k : k + 5] for k in range(max(1, len(w) - 4))) if w else Counter() for w in least}
    n, texts = len(least), Counter(g for c in grams.values() for g in c)
    weight = {w: {g: k * (1 + weighted_minhash.RARE * math.log((1 + n) / (1 + texts[g])) / math.log(1 + n)) for g, k in c.items()} for w, c in grams.items()}

    def near(a, b):
        x, y = weight[a], weight[b]
        both = sum(min(v, y[g]) for g, v in x.items() if g in y)
        return both and both / (sum(x.values()) + sum(y.values()) - both) >= weighted_minhash.THRESHOLD

    of = _classes(list(least), near)
    heads = {}
    for w in least:
        c = of[w]
        if least[w] is not None and (c not in heads or least[w] < least[heads[c]]):
            heads[c] = w
    want = Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is None or (heads[of[words(r["text"])]] == words(r["text"]) and least[words(r["text"])] == r["doc_id"]))
    assert got == want and sum(got.values()) < len(rows)


def test_mixing_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = Counter((r["doc_id"], r["text"], r["gone"]) for r in _rows(corpus_pipeline.mix_sources(spark, docs, sf_dir)))
    rows = _rows(docs)
    tokens = Counter()
    for r in rows:
        tokens[r["source"] or ""] += len(WORD.findall(r["text"] or ""))
    _, alpha = mixing.mixed(docs, gain=0.25, budget="cover")
    power = {s: n**alpha for s, n in tokens.items()}
    z = sum(power.values())
    budget = max(n / power[s] for s, n in tokens.items()) * z
    own = -sum(n / sum(tokens.values()) * math.log(n / sum(tokens.values())) for n in tokens.values())
    mixed = -sum(p / z * math.log(p / z) for p in power.values())
    assert mixed >= own + 0.25 * (math.log(len(tokens)) - own) - 1e-6
    times = Counter((r["doc_id"], r["text"], r["gone"]) for r in rows)
    spent = Counter()
    for r in rows:
        k = (r["doc_id"], r["text"], r["gone"])
        passes = math.floor(math.floor(power[r["source"] or ""] / z * budget + 1e-6) / tokens[r["source"] or ""])
        assert passes * times[k] <= got[k] <= (passes + 1) * times[k]
        spent[r["source"] or ""] += got[k] / times[k] * len(WORD.findall(r["text"] or ""))
    for s, n in spent.items():  # a quota is missed by less than one document
        assert n <= power[s] / z * budget + 1 and set(times) == set(got)


def test_pieces_stage(spark, sf_dir):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    docs = documents(spark, sf_dir)
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["n_tokens"], r["restored"], r["parity"]) for r in _rows(corpus_pipeline.encode_pieces(spark, docs, sf_dir)))
    want = Counter()
    for r in _rows(docs):
        ids = tuple(reference.encode(r["text"] or ""))
        want[r["doc_id"], r["source"], ids, len(ids), True, True] += 1
    assert got == want


def test_stages_follow_each_other(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    docs = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "pieces"]


def test_an_empty_table_stays_empty(spark, tmp_path, sf_dir):
    documents(spark, sf_dir).filter("1 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, sf_dir).filter("1 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
