"""Word shingles and b-bit MinHash signatures of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64


class Sketcher:
    """Signatures of texts: `bands` band keys of `rows` minima each, and `bits` low bits of every minimum.

    Words are maximal runs of letters and digits in lower case; shingles are distinct runs of `words` of them.
    """

    def __init__(self, words: int = 3, rows: int = 4, bands: int = 36, bits: int = 4, seed: int = 11):
        import regex

        self.words, self.rows, self.bands, self.bits = words, rows, bands, bits
        self.find = regex.compile(r"[^\W_]+").findall
        rng = np.random.default_rng(seed)
        k = rows * bands
        self.mul = (rng.integers(1, 2**63, k, dtype=np.uint64) << U(1)) | U(1)
        self.mix = (rng.integers(1, 2**63, words, dtype=np.uint64) << U(1)) | U(1)
        self.tag = rng.integers(1, 2**63, bands, dtype=np.uint64)
        self.fold = (rng.integers(1, 2**63, rows, dtype=np.uint64) << U(1)) | U(1)
        self.known: dict[str, int] = {}

    def word_ids(self, text: str) -> np.ndarray:
        import xxhash

        known, out = self.known, []
        for w in self.find(text.lower()):
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted hashes of the distinct shingles."""
        return np.unique(self.hashes(self.word_ids(text)))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of all shingles of a text, in order."""
        n = len(ids) - self.words + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        h = ids[:n] * self.mix[0]
        for i in range(1, self.words):
            h ^= h >> U(31)
            h += ids[i : i + n]
            h *= self.mix[i]
        h ^= h >> U(29)
        return h

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        # multiply-shift over well mixed 64-bit values; in blocks, so that very long texts stay small in memory
        best = None
        for i in range(0, len(shingles), 4096):
            x = shingles[None, i : i + 4096] * self.mul[:, None]
            m = x.min(axis=1)
            best = m if best is None else np.minimum(best, m)
        return best

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        k = (minima.reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64) ^ self.tag
        k ^= k >> U(32)
        k *= U(0xD6E8FEB86659FD93)
        return k ^ (k >> U(32))

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low `bits` bits of each minimum, 64 / bits to a word; the low bits of a product with an odd number are weak, so the value is folded first."""
        v = minima ^ (minima >> U(33))
        v *= U(0xFF51AFD7ED558CCD)
        v = (v >> U(40)) & U((1 << self.bits) - 1)
        per = 64 // self.bits
        v = np.concatenate([v, np.zeros(-len(v) % per, dtype=np.uint64)]).reshape(-1, per)
        return (v << (np.arange(per, dtype=np.uint64) * U(self.bits))).sum(axis=1, dtype=np.uint64)


SKETCH = "id bigint, set_key bigint, n int, bands array<bigint>, bits array<bigint>"


def sketches(table: DataFrame, id_col: str, text_col: str, **params) -> DataFrame:
    """One row per non-null text: set_key (equal for texts with the same shingles; of texts without shingles, for equal texts),
    number of shingles, band keys and packed signature (both empty without shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        s = Sketcher(**params)
        none = np.empty(0, dtype=np.int64)
        for b in batches:
            keys, ns, bands, bits = [], [], [], []
            for text in b["text"]:
                sh = s.shingles(text)
                ns.append(len(sh))
                if len(sh):
                    m = s.minima(sh)
                    keys.append(xxhash.xxh64_intdigest(sh.tobytes(), seed=1))
                    bands.append(s.band_keys(m).view(np.int64))
                    bits.append(s.packed(m).view(np.int64))
                else:
                    keys.append(xxhash.xxh64_intdigest(text, seed=2))
                    bands.append(none)
                    bits.append(none)
            yield pd.DataFrame({"id": b["id"], "set_key": np.array(keys, dtype=np.uint64).view(np.int64), "n": np.array(ns, dtype=np.int32), "bands": bands, "bits": bits})

    return table.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, SKETCH)


def shingle_sets(table: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id, shingles array<bigint>) of every non-null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Sketcher(words=words)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "shingles": [s.shingles(t).view(np.int64) for t in b["text"]]})

    return table.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id bigint, shingles array<bigint>")


def estimate(a: str, b: str, hashes: int, bits: int = 4):
    """Collision-corrected similarity of two packed 4-bit signatures: equal positions are counted by bit operations."""
    assert bits == 4
    ones = "1229782938247303441L"  # 0x1111111111111111
    x = f"zip_with({a}, {b}, (p, q) -> p ^ q)"
    nib = f"transform({x}, v -> bit_count((v | shiftrightunsigned(v, 1) | shiftrightunsigned(v, 2) | shiftrightunsigned(v, 3)) & {ones}))"
    differ = f"aggregate({nib}, 0, (s, v) -> s + v)"
    chance = 2.0**-bits
    return (1 - F.expr(differ) / F.lit(float(hashes)) - chance) / (1 - chance)
