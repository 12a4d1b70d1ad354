"""Four-grams of the bytes of UTF-8 texts.

A symbol is a byte of a text, each of the 256 one of its own, or the bounds of a text (0). Nothing is merged: case, digits, marks and all
scripts stay apart, and a text's symbols don't depend on the texts beside it. Only four-grams that occur are held, sorted by their code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from leafmark.llm.common import SLICE_BYTES, Slice

SYMBOLS, ORDER = 257, 4


def four_grams(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four-grams that end at each symbol and at the end of each text, and each text's first code."""
    n, texts = len(symbols), len(first) - 1
    padded = np.zeros(n + ORDER * texts, np.int64)
    text = np.repeat(np.arange(texts), np.diff(first))
    at = np.arange(n) + ORDER * text + ORDER - 1
    padded[at] = symbols
    ends = first[1:] + ORDER * np.arange(1, texts + 1) - 1
    code = np.zeros(len(padded), np.int64)
    for back in range(ORDER):
        code[ORDER - 1 :] += padded[ORDER - 1 - back : len(padded) - back] * SYMBOLS**back
    wanted = np.zeros(len(padded), bool)
    wanted[at] = wanted[ends] = True
    return code[wanted], first + np.arange(texts + 1)


def _added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    by = np.argsort(code)
    code = code[by]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n[by], first)


def count_batches(pick: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable:
    """For mapInArrow: the four-grams of a partition with their counts. pick gives a batch's symbols and texts' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for symbols, first in pick(batch):
                codes, _ = four_grams(symbols, first)
                found += [np.unique(codes[at : at + SLICE_BYTES], return_counts=True) for at in range(0, len(codes), SLICE_BYTES)]
                if len(found) >= 32:
                    found = [_added(*map(np.concatenate, zip(*found, strict=True)))]
        if found:
            some, counts = _added(*map(np.concatenate, zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts)], names=["code", "n"])

    return run


def key(order: int, code: np.ndarray) -> np.ndarray:
    """The 64-bit hash under which an n-gram is stored."""
    from leafmark.llm.common import mix

    return mix(code.astype(np.uint64) * np.uint64(8) + np.uint64(order))


class Scores:
    """Each four-gram's log10 probability; those that stand more than once in a slice of text are looked up once."""

    def __init__(self, look_up: Callable[[np.ndarray], np.ndarray]):
        self.look_up = look_up

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = np.empty(len(codes), np.float32)
        for at in range(0, len(codes), SLICE_BYTES):
            some, which = np.unique(codes[at : at + SLICE_BYTES], return_inverse=True)
            found[at : at + SLICE_BYTES] = self.look_up(some)[which]
        return found


def doc_symbols(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    return part.data.astype(np.int64) + 1, part.first
