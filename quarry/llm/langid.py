"""Language ID by hyperdimensional profiles.

Every letter has a random +1/-1 vector seeded by its code point.  A trigram is
bound as twice-rotated first x once-rotated second x third letter vector; a
text is the bundle (sum) of its trigram vectors, and a language's prototype the
bundle of the unit vectors of its training texts.  A text gets the language of
the prototype with the largest cosine.

Scale: two map-only passes over the texts.  Training sends one vector per
language and task; prototypes (labels x ``DIMS`` floats) are the only thing the
driver sees.  Trigram vectors are kept in a table of bounded size per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_bucket, pick, positional

DIMS = 512
MAX_LABELS = 4096
UND = "und"
#: trigram vectors a task keeps (x DIMS x 4 bytes)
TABLE_ROWS = 40_000


class Encoder:
    """Texts to hypervectors."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.letters: dict[int, np.ndarray] = {}
        self.keys = np.empty(0, dtype=np.int64)  # sorted
        self.slots = np.empty(0, dtype=np.int64)  # their rows in the table
        self.table = np.empty((TABLE_ROWS, dims), dtype=np.float32)
        self.alpha = np.array([chr(i).isalpha() for i in range(0x10000)])

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = (np.random.default_rng(code).integers(0, 2, self.dims) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigram keys and counts over lower-case letters, one gap for any run of others; None without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        is_letter = self.alpha[np.minimum(codes, 0xFFFF)]
        if codes.size and codes.max() > 0xFFFF:
            high = codes > 0xFFFF
            is_letter[high] = [chr(c).isalpha() for c in codes[high].tolist()]
        if not is_letter.any():
            return None
        codes[~is_letter] = 0
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        seq = np.concatenate(([0], codes[keep], [0] if is_letter[-1] else []))
        seq = seq.astype(np.int64)
        return np.unique((seq[:-2] << 42) | (seq[1:-1] << 21) | seq[2:], return_counts=True)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted trigram keys; unknown trigrams are bound and added."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = keys[~known]
            if len(self.keys) + len(new) > TABLE_ROWS:
                self.keys, self.slots, new = self.keys[:0], self.slots[:0], keys
            first = len(self.keys)
            for i, k in enumerate(new.tolist()):
                a, b, c = self.letter(k >> 42), self.letter((k >> 21) & 0x1FFFFF), self.letter(k & 0x1FFFFF)
                self.table[first + i] = np.roll(a, 2) * np.roll(b, 1) * c
            merged = np.concatenate((self.keys, new))
            order = np.argsort(merged, kind="stable")
            self.keys, self.slots = merged[order], np.concatenate((self.slots, np.arange(first, first + len(new))))[order]
            at = np.searchsorted(self.keys, keys)
        return self.table[self.slots[at]]

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit hypervector of a text; None if it is null or has no letter."""
        grams = self.trigrams(text) if text else None
        if grams is None or not len(grams[0]):
            return None
        keys, counts = grams
        out = np.zeros(self.dims, dtype=np.float64)
        for lo in range(0, len(keys), 8192):  # bounded copies of table rows for very long texts
            out += counts[lo : lo + 8192].astype(np.float32) @ self.rows(keys[lo : lo + 8192])
        norm = np.linalg.norm(out)
        return out / norm if norm else None


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype per label of ``docs`` (lang, text); rows without a label or a letter teach nothing."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = Encoder(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                v = enc.vector(text.as_py())
                if v is not None:
                    sums[lang] = sums[lang] + v if lang in sums else v
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(bundle, "lang string, v array<double>")
    total = (
        parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    rows = total.limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: the label column isn't a language column")
    out = {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in sorted(rows, key=lambda r: r["lang"])}
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in out.items()}


def predict(docs: DataFrame, protos: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (cosine clipped to 0..1) at the end.

    Null texts, texts without a letter, and all texts when nothing was learned
    get ``und`` with score 0.  Ties go to the first label by name.
    """
    base, at = positional(docs)
    labels, matrix = list(protos), np.array(list(protos.values()))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields], "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at[text_col]):
                v = enc.vector(text.as_py()) if labels else None
                if v is None:
                    langs.append(UND)
                    scores.append(0.0)
                else:
                    cos = matrix @ v
                    best = int(cos.argmax())
                    langs.append(labels[best])
                    scores.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema).toDF(*docs.columns, "lang_pred", "score")


def held_out(doc_id):
    return crc_bucket(doc_id, 5) == 0


def learned(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return prototypes(rows.where(~held_out(F.col("doc_id"))))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, learned from the rows that aren't held out.

    Repeated rows are learned from and answered one by one; an empty table gives no rows.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    out = predict(rows, learned(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
