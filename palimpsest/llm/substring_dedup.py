"""Substring dedup over words: windows around shared seeds.

Documents are joined on winnowed anchors (five-word seeds, the smallest hash of
every window), the windows around the seed are compared whole, word for word (no
extension of pairs of documents), and what is kept as a repeat is the union of all
windows of ``LENGTH`` words that start in a document with a smaller id. Hashes find
seeds, words decide.

Defined results: null and empty texts have no words; a document shorter than the
threshold loses nothing; null ids neither remove nor are removed; rows that
repeat an id do not remove each other's words, but lose what smaller ids hold;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import grams, hashed_words, pieces_of
from .repeats import Windows, covered, runs

LENGTH, SEED = 13, 5


def _windows(stretch: bytes, length: int) -> Iterator[bytes]:
    """Every ``length`` words of a stretch, as one string with a space between."""
    starts, at = [0], stretch.find(b" ")
    while at >= 0:
        starts.append(at + 1)
        at = stretch.find(b" ", at + 1)
    starts.append(len(stretch) + 1)
    return (stretch[a : b - 1] for a, b in zip(starts, starts[length:]))


def word_windows(length: int = LENGTH, seed: int = SEED) -> Windows:
    return Windows(
        length=length,
        k=seed,
        within=False,
        symbols=hashed_words,
        hashes=grams,
        units=bytes.split,
        stretch=lambda words, first, count: b" ".join(words[first : first + count + length - 1]),
        keys=lambda stretch: _windows(stretch, length),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` (words joined by one space)."""
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    found = runs(texts, word_windows(length, seed))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 1):
                n, gone, kept = [], [], []
                for body, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = (body or b"").split()
                    mask = covered(len(words), own, length)
                    n.append(len(words))
                    gone.append(int(mask.sum()))
                    kept.append(b" ".join(w for w, m in zip(words, mask.tolist()) if not m))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    joined = texts.join(found, ["doc", "tag"], "left").select("doc", "text", "runs")
    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text binary")
