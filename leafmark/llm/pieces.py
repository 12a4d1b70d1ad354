"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is parsed here, field by field, and rebuilt: normaliser (its character map, space rules and dummy
prefix), the metaspace mark, unigram scores or pair merges (whichever the model is), and byte fallback. Batches are
encoded by the library's own threads. No piece of such a pair model holds the mark after another character (checked), so
words can be cut before each run of marks without changing the result, which lets the library cache them.

Parity: every text is decoded again and compared, and its ids with those of the sentencepiece library: where words are cut
apart, each distinct word once (and the whole text for one class of hashes, PARITY, and texts with byte pieces); all other texts whole.

Cases: null and empty texts have no ids and decode to an empty text; equal texts get equal ids; ids and other columns
pass through; an empty table gives an empty result. Text that the model's normaliser changes decodes to the normalised text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import SLICE_BYTES, documents, mapped, slices, sums

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts cut into words whose crc32 has this remainder 0 are also encoded whole by both libraries.
PARITY = 64
#: Words that the library itself keeps; the codec keeps its own, and the library's are many times as large.
CACHE = 1_000
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 pairs
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n


def parse(raw: bytes) -> PieceModel:
    """The message's fixed numbers: 1 pieces (1 text, 2 score, 3 type), 2 training (3 kind, 35 byte fallback), 3 normaliser
    (2 character map, 3 dummy prefix, 4 removal of extra spaces, 5 escape of spaces)."""
    m = PieceModel()
    for number, value in _fields(raw):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def merges(m: PieceModel) -> list[tuple[str, str]]:
    """All ways to make a piece of two, best pieces first."""
    usable = {t: (-s, i) for i, (t, s, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    found = []
    for text, rank in usable.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in usable and right in usable:
                found.append((rank, usable[left][1], usable[right][1], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(m: PieceModel):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not m.escape:
        raise ValueError("models that don't escape spaces aren't supported")
    unknown = next((t for t, _, kind in m.pieces if kind == UNKNOWN), None)
    number = next((i for i, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN), None)
    if m.kind == 1:
        model = models.Unigram([(t, s) for t, s, _ in m.pieces], unk_id=number, byte_fallback=m.byte_fallback)
    elif m.kind == 2:
        model = models.BPE({t: i for i, (t, _, _) in enumerate(m.pieces)}, merges(m), unk_token=unknown, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=CACHE)
    else:
        raise ValueError(f"model kind {m.kind} isn't supported")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Replace(" ", SPACE)]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    t.normalizer = normalizers.Sequence(steps)
    if m.kind == 2 and not any(SPACE in p.lstrip(SPACE) for p, _, _ in m.pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    t.encode_special_tokens = True
    return t


class Codec:
    """A worker's tools of one model: the tokenizers pipeline, the sentencepiece processor, and each piece's bytes.

    Where the model lets words be encoded apart (see `apart`), plain texts are cut at spaces and each distinct word of a
    slice is encoded once; others are encoded whole. Decoding joins the pieces' bytes: marks are spaces, byte pieces
    their bytes, and the dummy prefix goes."""

    WORDS = 100_000  # kept from slice to slice

    def __init__(self, raw: bytes):
        import sentencepiece

        m = parse(raw)
        self.model, self.tokenizer = m, build(m)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.is_byte = np.array([kind == BYTE for *_, kind in m.pieces])
        as_bytes = [bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace(SPACE, " ").encode() for t, _, kind in m.pieces]
        self.size = np.array([len(b) for b in as_bytes])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.apart = m.kind == 2 and m.dummy_prefix and not m.squeeze and not m.charsmap and not any(SPACE in p.lstrip(SPACE) for p, _, _ in m.pieces)
        self.marked = np.array([t.startswith(SPACE) for t, _, _ in m.pieces])
        self._forget()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> np.ndarray:
        """Numbers of words in the pool of ids. New words are encoded many to a text, which falls apart at the marks."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.WORDS:
            self._forget()
            new = words
        if new:
            groups = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
            ids = np.concatenate([np.array(i, np.int32) for i in self._whole(groups)])
            first = np.flatnonzero(self.marked[ids])
            assert len(first) == len(new)
            theirs = self.reference.encode(new)
            ends = np.append(first[1:], len(ids))
            same = np.array([t == ids[a:b].tolist() for t, a, b in zip(theirs, first, ends, strict=True)])
            self.agrees = np.concatenate([self.agrees, same])
            self.first = np.concatenate([self.first[:-1], first + len(self.pool), [len(self.pool) + len(ids)]])
            self.pool = np.concatenate([self.pool, ids])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.agrees = np.zeros(0, bool)  # of each word, whether sentencepiece gives the same ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin, whether it was cut into words, and if so whether sentencepiece agrees on each."""
        plain = np.zeros(len(texts), bool)
        if self.apart:
            odd = pc.match_substring_regex(texts, f"^$|^ |  |{SPACE}| $")
            plain = ~odd.to_numpy(zero_copy_only=False)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        agree = np.ones(len(texts), bool)
        if plain.any():
            split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            coded = split.values.dictionary_encode()
            word = coded.indices.to_numpy()
            word = self._words(coded.dictionary.to_pylist())[word]
            each = self.first[word + 1] - self.first[word]
            out = self.pool[ragged(self.first[word], each)]
            ends = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy()]
            agree[plain] = sums((~self.agrees[word]).astype(np.int64), split.offsets.to_numpy()) == 0
            if plain.all():
                return out, ends, plain, agree
            for k, (a, b) in zip(np.flatnonzero(plain), zip(ends[:-1], ends[1:], strict=True), strict=True):
                found[k] = out[a:b]
        rest = np.flatnonzero(~plain)
        for k, i in zip(rest, self._whole(texts.take(pa.array(rest)).to_pylist()), strict=True):
            found[k] = np.array(i, np.int32)
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(f) for f in found])]), plain, agree

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each text's begin."""
        each = self.size[ids]
        out = self.bytes[ragged(self.start[ids], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[first]
        if self.model.dummy_prefix:  # the first byte of each text that has ids
            some = np.flatnonzero(first[1:] > first[:-1])
            keep = np.ones(len(out), bool)
            keep[ends[some]] = out[ends[some]] != 32
            dropped = np.zeros(len(first), np.int64)
            dropped[some + 1] = ~keep[ends[some]]
            return out[keep], ends - np.cumsum(dropped)
        return out, ends


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


_codecs: dict[int, Codec] = {}


def codec(raw: bytes) -> Codec:
    """A worker builds a model's tools once."""
    if (key := zlib.crc32(raw)) not in _codecs:
        _codecs[key] = Codec(raw)
    return _codecs[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text", parity: int = PARITY) -> DataFrame:
    """doc_id, ids, n_tokens, byte_tokens, restored (the decoded text is the text) and parity (sentencepiece gives the same ids)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_tokens long, byte_tokens long, restored boolean, parity boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        tools = codec(sent.value)
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES // 4):
                texts = pc.fill_null(batch.column(1).slice(part.at, part.n), "").cast(pa.string())
                ids, first, cut, agree = tools.encode(texts)
                back, ends = tools.decode(ids, first)
                same_size = np.diff(ends) == np.diff(part.first)
                if same_size.all():
                    restored = sums((back != part.data).astype(np.int64), part.first) == 0
                else:
                    restored = np.array([bytes(back[a:b]) == bytes(part.data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], part.first[:-1], part.first[1:], strict=True)])
                n_bytes = sums(tools.is_byte[ids].astype(np.int64), first)
                lines = sums((part.data == 10).astype(np.int64), part.first)
                compared = agree
                for k in range(part.n):
                    if agree[k] and (not cut[k] or n_bytes[k] > lines[k] or zlib.crc32(part.data[part.first[k] : part.first[k + 1]]) % parity == 0):
                        compared[k] = tools.reference.encode(texts[k].as_py()) == ids[first[k] : first[k + 1]].tolist()
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.at, part.n), lists, pa.array(np.diff(first)), pa.array(n_bytes), pa.array(restored), pa.array(compared, pa.bool_())], names=["doc_id", "ids", "n_tokens", "byte_tokens", "restored", "parity"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, schema)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(documents(spark, sf_dir), model_bytes())
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return found.select("doc_id", "n_tokens", "byte_tokens", digest.alias("ids_sha256"), "restored", "parity")
