"""Term counts of documents, kept as postings of bounded blocks.

A block is some neighbouring documents of one task, two million words at most or one
document. It keeps each of its terms once, with the documents that hold the term
and how often, three or four bytes a posting. Only terms and blocks then meet (a
term once per block, not once per document), and a block's postings travel once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK = 1 << 21  # words a block
_BYTES = 8  # a word counts as one for so many of its bytes, if it is longer
_DOCS = 1 << 16  # documents a block, numbered in two bytes
_TERMS = 64  # terms a row
_ROWS = 10_000  # rows a batch of results
_HEAD = -1  # the number of the row with a block's keys


def _sizes(lists: pa.ListArray) -> np.ndarray:
    """The words of each list, or their bytes where these are many."""
    cuts = lists.offsets.to_numpy().astype(np.int64)
    words, values = np.diff(cuts), lists.values
    if not words.any():
        return words
    bytes_before = np.frombuffer(values.buffers()[1], np.int32)[values.offset + cuts]
    return np.maximum(words, np.diff(bytes_before) // _BYTES)


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """Rows of ``key, terms`` dealt in blocks; a block is exceeded by one document at most."""
    held, last, total = [], 0, 0
    room = max(words, _DOCS)
    for batch in batches:
        if not batch.num_rows:
            continue
        # a document weighs a little whatever it holds, which bounds their number
        ends = total + np.cumsum(_sizes(batch.column(1)) * (room // words) + math.ceil(room / _DOCS))
        block = ends // room
        start = 0
        for end in [*np.flatnonzero(np.diff(block, prepend=last)).tolist(), batch.num_rows]:
            if end > start:
                held.append(batch.slice(start, end - start))
            if end < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            start = end
        last, total = block[-1], ends[-1]
    if held:
        yield pa.Table.from_batches(held)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as one binary value per run; ``ends`` begins with 0."""
    offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(values)])


def posted(docs: DataFrame, words: int = BLOCK) -> DataFrame:
    """``block, no, terms, n, docs, counts, keys`` of rows ``key, terms``, no key twice.

    Row ``no`` >= 0 of a block holds its terms from that number on: in how many
    documents each is, in which (two bytes each) and how often (as many bytes as the
    block's largest count takes). Row -1 has the documents' keys, in their order.
    """
    columns = "block bigint, no int, terms array<string>, n array<int>, docs binary, counts binary"
    schema = T.StructType.fromDDL(columns).add("keys", T.ArrayType(docs.schema["key"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for table in _blocks(batches, words):
            keys, lists = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            terms = coded.dictionary
            if not len(terms):
                continue
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pairs, counts = np.unique(coded.indices.to_numpy() * np.int64(len(sizes)) + doc, return_counts=True)
            n = np.bincount(pairs // len(sizes), minlength=len(terms))
            first = np.append(np.arange(0, len(terms), _TERMS), len(terms))
            cuts = pa.array(first, pa.int32())
            ends = np.append(0, np.cumsum(n))[first]
            rows = [
                pa.array(np.full(len(first) - 1, block)),
                pa.array(first[:-1], pa.int32()),
                pa.ListArray.from_arrays(cuts, terms),
                pa.ListArray.from_arrays(cuts, pa.array(n, pa.int32())),
                _packed((pairs % len(sizes)).astype(np.uint16), ends),
                _packed(counts.astype(np.min_scalar_type(counts.max())), ends),
                pa.nulls(len(first) - 1, pa.list_(keys.type)),
            ]
            head = [pa.nulls(1, c.type) for c in rows]
            head[0], head[1] = pa.array([block]), pa.array([_HEAD], pa.int32())
            head[-1] = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            for columns in (head, rows):
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            block += 1

    return docs.select("key", "terms").mapInArrow(run, schema)


def in_blocks(posts: DataFrame) -> DataFrame:
    """``block, no, term, n``: every term of every block, and in how many of its documents it is."""
    each = posts.filter("no >= 0").select("block", "no", F.posexplode(F.arrays_zip("terms", "n")).alias("i", "of"))
    return each.select("block", (F.col("no") + F.col("i")).alias("no"), F.col("of.terms").alias("term"), F.col("of.n").cast("bigint").alias("n"))


def keys_in_blocks(posts: DataFrame) -> DataFrame:
    """``block, no, key``: every document, numbered from -1 downwards."""
    return posts.filter("no < 0").select("block", F.posexplode("keys").alias("i", "key")).select("block", (-1 - F.col("i")).alias("no"), "key")


def scaled(posts: DataFrame, weights: DataFrame, key: str, some: bool) -> DataFrame:
    """``key, term, weight``: counts times the term's weight, each document scaled to
    unit length, of postings and ``block, no, weight``. With ``some``, only of
    documents whose number is there too."""
    schema = T.StructType().add(key, posts.schema["keys"].dataType.elementType).add("term", "string").add("weight", "double")

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        block = block.sort_by("no").combine_chunks()  # the keys first, then the terms by number
        keys, terms = block["keys"].combine_chunks().flatten(), block["terms"].combine_chunks().flatten()
        n = block["n"].combine_chunks().flatten().to_numpy()
        doc = np.frombuffer(b"".join(block["docs"].to_pylist()[1:]), np.uint16)
        counts = b"".join(block["counts"].to_pylist()[1:])
        counts = np.frombuffer(counts, f"u{len(counts) // len(doc)}")
        at, weight = given["at"].to_numpy(), np.zeros(len(terms))
        weight[at[at >= 0]] = given["weight"].to_numpy()[at >= 0]
        term = np.repeat(np.arange(len(terms), dtype=np.int32), n)
        w = counts * weight[term]
        w /= np.sqrt(np.bincount(doc, w * w, minlength=len(keys)))[doc]
        order = np.argsort(doc, kind="stable")
        if some:
            asked = np.zeros(len(keys), bool)
            asked[-1 - at[at < 0]] = True
            order = order[asked[doc[order]]]
        columns = [keys.take(pa.array(doc[order])), terms.take(pa.array(term[order])), pa.array(w[order])]
        out = pa.table(columns, names=[key, "term", "weight"])
        return pa.Table.from_batches(out.to_batches(_ROWS), out.schema)

    weights = weights.select(F.col("block").alias("of"), F.col("no").alias("at"), "weight")
    return posts.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(run, schema)
