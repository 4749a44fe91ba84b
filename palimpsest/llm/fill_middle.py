"""Fill-in-the-middle by piece tables.

A text is an immutable buffer and a document a list of descriptors ``(buffer,
start, stop)`` over it and over the sentinels. Cutting splits descriptors, an
arrangement permutes them with sentinels between, and the inverse permutation
restores the text from the output and its form alone. Hashes are fed descriptor
by descriptor, so the arranged text exists only where it is asked for.

A text is cut into lines (a line keeps its line feed); two keyed hash numbers give
the cuts, a third whether the document is rearranged at all, a fourth the
arrangement:

* ``plain``: the text (empty, holds a sentinel, or not chosen),
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

The sentinels do not overlap each other or themselves, so the first occurrence of
each in an output is the one that was put there.

Defined results: null texts are empty and plain, with no lines; a null id is hashed
as the word ``null``; rows that repeat give equal rows; other columns are ignored;
an empty table gives none. Everything is per row: no shuffle, memory is one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces_of, quoted

#: The sentinels, and the order of the parts of each arrangement
#: (0 prefix, 1 middle, 2 suffix).
SENTINELS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


class PieceTable:
    """Descriptors over immutable buffers."""

    __slots__ = ("pieces",)

    def __init__(self, pieces: list[tuple[bytes, int, int]]):
        self.pieces = pieces

    @classmethod
    def over(cls, text: bytes) -> PieceTable:
        return cls([(text, 0, len(text))])

    def cut(self, *places: int) -> list[PieceTable]:
        """Split at ascending places (counted over all pieces) into ``len(places) + 1`` tables."""
        out, own, done = [], [], 0
        left = list(places)
        for buffer, start, stop in self.pieces:
            while left and left[0] <= done + stop - start:
                middle = start + left.pop(0) - done
                own.append((buffer, start, middle))
                out.append(PieceTable(own))
                done, start, own = done + middle - start, middle, []
            done += stop - start
            own.append((buffer, start, stop))
        return [*out, PieceTable(own)]

    def arranged(self, form: str, *places: int) -> PieceTable:
        """Cut in three, permute, a sentinel before each part."""
        parts = self.cut(*places)
        return PieceTable([p for k in ORDERS[form] for p in [(SENTINELS[k], 0, len(SENTINELS[k])), *parts[k].pieces]])

    @classmethod
    def restored(cls, output: bytes, form: str) -> PieceTable:
        """The text's descriptors over an output: sentinels found in the form's
        order, the parts between them put back by the inverse permutation."""
        if form == "plain":
            return cls.over(output)
        order, start, spans = ORDERS[form], 0, []
        for k in order:
            at = output.index(SENTINELS[k], start)
            start = at + len(SENTINELS[k])
            spans.append((at, start))
        ends = [at for at, _ in spans[1:]] + [len(output)]
        inverse = sorted(range(len(order)), key=order.__getitem__)
        return cls([(output, spans[k][1], ends[k]) for k in inverse])

    def views(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.pieces:
            yield memoryview(buffer)[start:stop]

    def digest(self) -> str:
        out = sha256()
        for view in self.views():
            out.update(view)
        return out.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.views())


def characters(text: bytes, start: int, stop: int) -> int:
    """Code points between two places."""
    return len(text[start:stop].decode("utf-8", "replace"))


def line_ends(text: bytes) -> list[int]:
    """Where each line ends, its line feed included; 0 first."""
    ends, at = [0], text.find(b"\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find(b"\n", at + 1)
    if ends[-1] < len(text):
        ends.append(len(text))
    return ends


def plan(doc_id: int | None, text: bytes, rate: int, spm: int, seed: int) -> tuple[int, str, int, int]:
    """Lines, form, and where the middle starts and stops."""
    ends = line_ends(text)
    n = len(ends) - 1
    key = f"{seed}:{'null' if doc_id is None else doc_id}".encode()
    digest = sha256(key).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", 0, 0
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm else "psm", ends[first], ends[last]


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, output``.
    ``rate``: per cent of documents rearranged; ``spm``: per cent of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 1):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = text or b""
                    n, form, start, stop = plan(doc, text, rate, spm, seed)
                    table = PieceTable.over(text)
                    counts = None, None
                    if form != "plain":
                        table = table.arranged(form, start, stop)
                        counts = characters(text, 0, start), characters(text, start, stop)
                    rows.append((n, form, *counts, table.digest(), table.text()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "output"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = texts.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(arranged: DataFrame, output_col: str = "output", form_col: str = "form", digest_only: bool = False) -> DataFrame:
    """Adds ``restored_sha256`` and, unless only the digest is asked for,
    ``restored``, rebuilt from output and form alone; the output is left out.
    Columns of the input that have one of these names are replaced."""
    added = ["restored_sha256"] if digest_only else ["restored_sha256", "restored"]
    others = [c for c in arranged.columns if c not in (output_col, *added)]
    kinds = dict(arranged.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 0):
                outputs, forms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                tables = [PieceTable.restored(o or b"", f or "plain") for o, f in zip(outputs, forms)]
                columns = [pa.array([t.digest() for t in tables], pa.string())]
                if not digest_only:
                    columns.append(pa.array([t.text() for t in tables], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(2 + i) for i in range(len(others))), *columns], names=others + added)

    given = arranged.select(F.col(quoted(output_col)).cast("binary").alias("_text"), F.col(quoted(form_col)).alias("_form"), *(F.col(quoted(c)) for c in others))
    schema = ", ".join(f"{quoted(c)} {kinds[c]}" for c in others) + (", " if others else "") + "restored_sha256 string"
    out = given.mapInArrow(run, schema if digest_only else schema + ", restored binary")
    return out if digest_only else out.withColumn("restored", F.col("restored").cast("string"))
