"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from the letter's code point.
A trigram's vector binds its letters by position: the element-wise product of
the first letter's vector permuted (rolled) twice, the second's permuted once
and the third's. A text's vector bundles (sums) its trigram vectors, a language
prototype bundles the texts of that language, and a text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrospark.llm.common import byte_slices, without

UNKNOWN = "und"
_SPACE = 32
_COLUMNS = 2048  # trigrams of 1,024 elements bound at a time


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # one unit row per language
    dim: int
    seed: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class _Binder:
    """Trigram vectors, with the letter vectors met so far."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed, self.known = dim, seed, {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) > 8192:
                self.known.clear()
            v = np.random.default_rng((self.seed, code)).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            self.known[code] = v.astype(np.float32)
        return self.known[code]

    def bind(self, keys: np.ndarray) -> np.ndarray:
        mask, out = (1 << 21) - 1, None
        for place, shift in ((2, 42), (1, 21), (0, 0)):
            codes, inv = np.unique((keys >> shift) & mask, return_inverse=True)
            table = np.stack([np.roll(self._letter(c), place) for c in codes.tolist()])
            out = table[inv] if out is None else np.multiply(out, table[inv], out=out)
        return out


def _trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every trigram of letters and word boundaries; other
    characters become a boundary, runs of boundaries one."""
    lowered = ["" if t is None else t.decode("utf-8", "replace").lower().replace("\0", " ") for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(f" {t} " for t in lowered) + "\0").encode("utf-32-le", "replace"),
                          dtype="<u4").astype(np.int64)
    end = codes == 0
    codes = np.where(_letters()[codes] | end, codes, _SPACE)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    codes, end = codes[keep], end[keep]
    if len(codes) < 3:
        return np.array([], int), np.array([], int)
    row = np.cumsum(end) - 1
    ok = ~(end[:-2] | end[1:-1] | end[2:])
    key = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return row[:-2][ok], key[ok]


def _bundles(binder: _Binder, group: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Sum of trigram vectors per group. Whole numbers, so exact in any order."""
    out = np.zeros((n, binder.dim), dtype=np.float64)
    grams, inv = np.unique(keys, return_inverse=True)
    columns = max(256, _COLUMNS * 1024 // binder.dim)  # the same memory at any size
    for lo in range(0, len(grams), columns):
        part = grams[lo:lo + columns]
        sel = slice(None) if len(grams) <= columns else (inv >= lo) & (inv < lo + columns)
        counts = np.bincount(group[sel] * len(part) + (inv[sel] - lo), minlength=n * len(part))
        out += counts.reshape(n, len(part)).astype(np.float32) @ binder.bind(part)
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, dim: int = 1024,
        seed: int = 7, max_languages: int = 4096) -> Model:
    """Prototypes from all rows of ``docs`` with a non-null language (and
    ``where``, if given).

    Every task bundles its rows per language; the partial vectors are summed
    by (language, element), so no task holds a language and the result is the
    same however rows are partitioned. The driver gets one vector per language;
    over ``max_languages`` languages is an error, not a cut.
    """
    import pyarrow as pa

    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def partial(batches):
        binder, sums = _Binder(dim, seed), {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for start, texts in byte_slices(b.column(1)):
                own = langs[start:start + len(texts)]
                names = sorted(set(own))
                at = np.array([names.index(x) for x in own])
                row, keys = _trigrams(texts)
                for name, v in zip(names, _bundles(binder, at[row], keys, len(names)), strict=True):
                    sums[name] = sums[name] + v if name in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "v"])

    parts = rows.mapInArrow(partial, "lang string, v array<double>")
    sums = (parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
                                 .alias("v")))
    got = sorted((r["lang"], r["v"]) for r in sums.limit(max_languages + 1).collect())
    if len(got) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    protos = np.array([v for _, v in got], dtype=np.float64).reshape(len(got), dim)
    norms = np.linalg.norm(protos, axis=1, keepdims=True) if len(got) else np.ones((0, 1))
    return Model(tuple(k for k, _ in got), protos / np.where(norms > 0, norms, 1), dim, seed)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` plus ``lang_pred`` and ``score``.

    ``score`` is the largest cosine, cut to 0..1. Null texts, texts without
    letters and everything under a model without languages get ``und`` and 0.
    A tie goes to the first language by name; repeated rows get equal results.
    Whole texts are read, in slices
    of bounded size; one very long text is processed alone. Input columns named
    ``lang_pred`` or ``score`` are replaced. An empty table stays empty.
    """
    import pyarrow as pa

    base = without(docs, "lang_pred", "score")
    index = base.columns.index(text_col)

    def run(batches):
        binder = _Binder(model.dim, model.seed)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for b in batches:
            pred, score = [], []
            for _, texts in byte_slices(b.column(index), 64):
                row, keys = _trigrams(texts)
                h = _bundles(binder, row, keys, len(texts))
                best, cos = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                if len(names) > 1:
                    norm = np.linalg.norm(h, axis=1)
                    sims = (h @ model.prototypes.T) / np.where(norm > 0, norm, 1)[:, None]
                    seen = np.bincount(row, minlength=len(texts)) > 0
                    best = np.where(seen, sims.argmax(axis=1), best)
                    cos = np.where(seen, np.clip(sims.max(axis=1), 0, 1), 0)
                pred.extend(names[best].tolist())
                score.extend(cos.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)
