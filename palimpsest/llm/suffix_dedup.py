"""Substring dedup over bytes by grouped anchors, as in op4: no suffix array.

Removes every byte covered by a ``LENGTH``-byte string that also starts earlier
(smaller id, or the same document and an earlier start). No suffix is ordered by
its bytes; there are no name ranks, common-prefix values, induction or queues:

* anchors are ``SAMPLE`` bytes at content-defined places (smallest hash of every
  window); those whose hash occurs once are discarded;
* the rest are shuffled by hash and sorted by document and start, each with its
  stretch of text;
* inside an anchor's group whole windows are looked up, and all but the first of
  equal ones are repeats.

Windows are compared byte by byte. Defined results: null and empty texts have no
bytes; texts shorter than ``LENGTH`` lose nothing; bytes of a cut character may
stay; null ids neither remove nor are removed; rows that repeat id and text are
one place and do not remove each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_VALUES, MIX_A, mix, pieces_of
from .repeats import Windows, covered, runs

LENGTH, SAMPLE = 100, 32


def rolling(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` neighbours, joined from hashes of powers of two."""
    if len(a) < k:
        return np.zeros(0, np.uint64)
    done, h = 0, None
    size, part, factor = 1, a, np.array([MIX_A])
    while True:
        if k & size:
            n = len(a) - (done + size) + 1
            h = part[:n] if h is None else h[:n] * factor + part[done : done + n]
            done += size
        if done == k:
            return mix(h)
        part = part[:-size] * factor + part[size:]
        factor = factor * factor
        size *= 2


def _bytes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)])


def byte_windows(length: int = LENGTH, sample: int = SAMPLE) -> Windows:
    return Windows(
        length=length,
        k=sample,
        within=True,
        symbols=_bytes_of,
        hashes=rolling,
        units=lambda text: text,
        stretch=lambda text, first, count: text[first : first + count + length - 1],
        keys=lambda payload: (payload[i : i + length] for i in range(len(payload) - length + 1)),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (remaining bytes)."""
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    found = runs(texts, byte_windows(length, sample))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 1):
                rows = []
                for body, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    body = body or b""
                    mask = covered(len(body), own, length)
                    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[:1].any())
                    rows.append((len(body), int(mask.sum()), spans, np.frombuffer(body, np.uint8)[~mask].tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(found, ["doc", "tag"], "left").select("doc", "text", "runs")
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
