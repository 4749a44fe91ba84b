"""Exact dedup by Patricia tries over whole byte strings.

Every map task inserts its texts into a compressed radix trie whose terminal
nodes hold the owner (id and remaining columns) and the number of rows, so a
text leaves a task once however many copies it has. The rows left are
partitioned by length and content hash, sorted, and inserted again; the
terminal nodes then hold the final owners.

Memory: a trie keeps at most ``BUDGET`` bytes of edges. When a map-side trie
is full its heaviest subtree is spilled: its terminals go out as partial rows
that meet again behind the shuffle. Behind the shuffle rows are sorted by hash
and length, so a full trie is finished as soon as the next pair begins.

Defined results: null counts as the empty text, the two are equal; a null id is
smaller than any other; rows that repeat both id and text count one each in
``group_size`` and leave one row in ``keep_one``; an empty table gives an empty
result. Other columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free_name

BUDGET = 48 << 20
_OUT_BYTES = 4 << 20


class Trie:
    """A Patricia trie: node = [edge, children by first byte, terminal]."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0
        self.weight: dict[int, int] = {}

    def insert(self, key: bytes, value, better: Callable) -> None:
        """Store ``better(old, value)`` at the key's terminal."""
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                node[2] = value if node[2] is None else better(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.size += n - at + 200
                self.weight[key[0]] = self.weight.get(key[0], 0) + n - at + 200
                return
            edge = child[0]
            if not key.startswith(edge, at):
                common = len(os.path.commonprefix([edge, key[at : at + len(edge)]]))
                upper = [edge[:common], {edge[common]: child}, None]
                child[0] = edge[common:]
                node[1][key[at]] = upper
                self.size += 200
                self.weight[key[0]] += 200
                child, edge = upper, upper[0]
            node, at = child, at + len(edge)

    def _walk(self, node: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node[0]
            if node[2] is not None:
                yield whole, node[2]
            stack += [(c, whole) for c in node[1].values()]

    def items(self) -> Iterator[tuple[bytes, object]]:
        return self._walk(self.root, b"")

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Give out and forget the heaviest subtree below the root."""
        first = max(self.weight, key=self.weight.get)
        self.size -= self.weight.pop(first)
        return self._walk(self.root[1].pop(first), b"")


def _merge(largest: bool) -> Callable:
    """Owner and count of two groups of rows with one text; value = [id, row, count]."""

    def better(a: list, b: list) -> list:
        x, y = (a[0] is not None, a[0]), (b[0] is not None, b[0])
        if x[0] != y[0]:
            wins = (y > x) == largest
        else:
            wins = y[0] and (y[1] > x[1] if largest else y[1] < x[1])
        owner = b if wins else a
        return [owner[0], owner[1], a[2] + b[2]]

    return better


def _rows(found: Iterable[tuple[bytes, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[], [], [], [], [], []]
    held = 0
    for text, (owner, row, count) in found:
        digest = hashlib.sha256(text).digest()
        for column, value in zip(columns, (len(text), int.from_bytes(digest[:8], "big", signed=True), text, owner, row, count)):
            column.append(value)
        held += len(text) + 100
        if held > _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            columns, held = [[], [], [], [], [], []], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def owners(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", payload: bool = True) -> DataFrame:
    """One row per distinct text: ``length, hash, text`` (binary), ``owner`` (id
    that stays), ``row`` (struct of the owner's other columns) and ``group_size``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in docs.columns if c not in (id_col, text_col)] if payload else []
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(True).alias(free_name("_present", docs)))
    given = docs.select(
        F.lit(0).cast("bigint").alias("length"),
        F.lit(0).cast("bigint").alias("hash"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.col(id_col).alias("owner"),
        row.alias("row"),
        F.lit(1).cast("bigint").alias("group_size"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in given.schema])
    out = to_arrow_schema(schema)
    better = _merge(keep == "largest")

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            flat = [batch.column(i) for i in range(6)]
            rows = flat[4].to_pylist()
            for i, (n, h, text, owner, count) in enumerate(zip(*(flat[j].to_pylist() for j in (0, 1, 2, 3, 5)))):
                yield n, h, text, [owner, rows[i], count]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def spilled() -> Iterator[tuple[bytes, list]]:
            for _, _, text, value in feed(batches):
                trie.insert(text, value, better)
                while trie.size > BUDGET and trie.weight:
                    yield from trie.spill()
            yield from trie.items()

        yield from _rows(spilled(), out)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def finished() -> Iterator[tuple[bytes, list]]:
            last = None
            for n, h, text, value in feed(batches):
                if trie.size > BUDGET and (n, h) != last:
                    yield from trie.items()
                    trie.clear()
                trie.insert(text, value, better)
                last = (n, h)
            yield from trie.items()

        yield from _rows(finished(), out)

    partial = given.mapInArrow(combine, schema)
    placed = partial.repartition("length", "hash").sortWithinPartitions("hash", "length")
    return placed.mapInArrow(settle, schema)


def keep_one(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row per text, all columns as they were (a null text
    that stays comes back as the empty text)."""
    final = owners(docs, keep, id_col, text_col)
    return final.select(
        *[
            F.col("owner").alias(c) if c == id_col
            else F.col("text").cast("string").alias(c) if c == text_col
            else F.col("row").getField(c).alias(c)
            for c in docs.columns
        ]
    )


def report(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    sha = lambda c: F.sha2(c, 256)
    classes = owners(docs, keep, id_col, text_col, payload=False).select(
        sha(F.col("text")).alias("text_sha256"), F.col("owner").alias("keep_id"), "group_size"
    )
    each = docs.select(
        F.col(id_col).alias("doc_id"), sha(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_sha256")
    )
    return each.join(classes, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
