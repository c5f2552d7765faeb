"""Text embedding (E1) with a plug-in point, and vector normalisation.

The built-in model is feature hashing: lowered letter/digit words, bucket =
md5(word) prefix mod ``dim``, sign from the next hex digit; the signed counts
are L2-normalised.  It runs as the same Arrow-batched ``mapInArrow`` step a
neural model would (one task per partition, no shuffle); dense rows are built
with a vectorised numpy ``bincount``.

A neural model plugs in through ``embedder``: a callable taking a pyarrow
string array and returning an ``(n, dim)`` float array.  It is called once per
Arrow batch inside ``mapInArrow`` (set
``spark.sql.execution.arrow.maxRecordsPerBatch`` to the model batch size, e.g.
512) and may load its model lazily once per Python worker.  The callable is
pickled to the executors: define it in a module the executors can import (or
ship with ``--py-files``), or as a closure, which is shipped by value.
"""

from __future__ import annotations

from collections.abc import Callable

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 384
WORD_PATTERN = r"[\p{L}\p{N}]+"


def model_id(embedder: Callable | None = None, dim: int = DEFAULT_DIM) -> str:
    """Identifier of the model that fills a store; queries must use the same."""
    if embedder is None:
        return f"hashing-md5-{dim}"
    return str(getattr(embedder, "model_id", getattr(embedder, "__name__", "plugin")))


def hash_words(text: Column) -> Column:
    """Lowered letter/digit runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def signed_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """array<int> of ``sign * (bucket + 1)`` per word."""

    def code(w):
        h = F.md5(w)
        bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim))
        sign = F.when(F.substring(h, 9, 1) < F.lit("8"), F.lit(1)).otherwise(F.lit(-1))
        return (sign * (bucket + 1)).cast("int")

    return F.transform(hash_words(text), code)


_WORD_RE = None
# Codes by word, for each dimension, and how many a worker remembers; words past that are hashed again.
_CODE_CACHE: dict[int, dict[str, int]] = {}
_CACHE_CAP = 1 << 17
# Cells of the matrix and letters of the texts that a worker holds at a time.
CELLS = 1 << 18
LETTERS = 1 << 20


def _word_codes(text: str, dim: int) -> list[int]:
    """Python twin of ``signed_buckets`` for one text, with a per-worker cache."""
    global _WORD_RE
    if _WORD_RE is None:
        import regex

        _WORD_RE = regex.compile(r"[\p{L}\p{N}]+")
    out = []
    cache = _CODE_CACHE.setdefault(dim, {})
    for w in _WORD_RE.findall(text.lower()):
        c = cache.get(w)
        if c is None:
            h = hashlib.md5(w.encode("utf-8")).hexdigest()
            c = (1 if h[8] < "8" else -1) * (int(h[:8], 16) % dim + 1)
            if len(cache) < _CACHE_CAP:
                cache[w] = c
        out.append(c)
    return out


def _slices(batches, dim: int, src: str):
    """Slices of the batches, of at most ``CELLS`` cells and (but for a row of its own) ``LETTERS`` letters or items."""
    rows = max(1, CELLS // dim)
    for rb in batches:
        arr = rb.column(src)
        sizes = pc.list_value_length(arr) if pa.types.is_list(arr.type) else pc.binary_length(arr)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < rb.num_rows:
            most = (ends[lo - 1] if lo else 0) + LETTERS
            hi = max(lo + 1, min(lo + rows, rb.num_rows, int(np.searchsorted(ends, most, side="right"))))
            yield rb.slice(lo, hi - lo)
            lo = hi


def _hashing_model(dim: int, text: str, out: str, keep: list[str]):
    def fn(batches):
        for rb in _slices(batches, dim, text):
            m = np.zeros((rb.num_rows, dim))
            for i, t in enumerate(rb.column(text)):
                codes = np.asarray(_word_codes(t.as_py() or "", dim), dtype=np.int64)
                m[i] = np.bincount(np.abs(codes) - 1, weights=np.sign(codes), minlength=dim)
            yield _with_embedding(rb, m, out, keep)

    return fn


def _with_embedding(rb, m, out, keep):
    n, dim = m.shape
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    m = m / np.where(norms == 0, 1.0, norms)
    emb = pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)),
        pa.array(m.astype(np.float32).ravel()),
    )
    cols = [rb.column(c) for c in keep] + [emb]
    return pa.RecordBatch.from_arrays(cols, names=keep + [out])


def _dense_from_codes(dim: int, src: str, out: str, keep: list[str]):
    def fn(batches):
        for rb in _slices(batches, dim, src):
            n = rb.num_rows
            arr = rb.column(src)
            vals = pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = pc.list_parent_indices(arr).to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.bincount(rows * dim + (np.abs(vals) - 1), weights=np.sign(vals).astype(np.float64),
                            minlength=n * dim).reshape(n, dim)
            yield _with_embedding(rb, m, out, keep)

    return fn


def _plugin(embedder: Callable, text: str, out: str, keep: list[str]):
    def fn(batches):
        for rb in batches:
            m = np.asarray(embedder(rb.column(text)), dtype=np.float64)
            norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = m / np.where(norms == 0, 1.0, norms)
            n, dim = m.shape if m.ndim == 2 else (rb.num_rows, 0)
            emb = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)),
                pa.array(m.astype(np.float32).ravel()),
            )
            cols = [rb.column(c) for c in keep] + [emb]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [out])

    return fn


def embed_text(
    df: DataFrame,
    text: str = "chunk_text",
    out: str = "embedding",
    dim: int = DEFAULT_DIM,
    embedder: Callable | None = None,
    keep_text: bool = True,
    hashing_in_jvm: bool = False,
) -> DataFrame:
    """E1 + E2: append a unit-norm ``array<float>`` embedding of ``text``.

    The built-in hashing model runs inside the Arrow worker with a per-worker
    word -> code cache (measured ~4x faster than hashing every word in JVM
    lambdas); ``hashing_in_jvm=True`` computes the codes with Spark
    expressions instead and only densifies in Python.  Both give identical
    vectors."""
    keep = [c for c in df.columns if keep_text or c != text]
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.FloatType()), True)])
    if embedder is not None:
        cols = keep if text in keep else keep + [text]
        return df.select(*cols).mapInArrow(_plugin(embedder, text, out, keep), schema)
    if hashing_in_jvm:
        src = "_codes"
        coded = df.select(*keep, signed_buckets(F.col(text), dim).alias(src))
        return coded.mapInArrow(_dense_from_codes(dim, src, out, keep), schema)
    cols = keep if text in keep else keep + [text]
    return df.select(*cols).mapInArrow(_hashing_model(dim, text, out, keep), schema)
