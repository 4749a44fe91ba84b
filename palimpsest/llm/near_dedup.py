"""Near-duplicate grouping by SuperMinHash signatures.

A document's set holds its distinct five-word shingles as 64-bit hashes. Its
signature gives every shingle a random permutation of the slots and takes per
slot the smallest *rank + uniform* value over all shingles (SuperMinHash): ranks
of one shingle differ between slots, which lowers the variance, and a slot that
was reached at rank k needs no rank above k, so the ranks are drawn level by
level and stop when all slots of a document are filled.

Signatures are cut into bands. Within a band key every set is compared with the
key's smallest set, then, for keys that still hold several components, all sets
of different components are compared in blocks; nothing is left out whatever the
key's size, and no list of pairs within a key is emitted. A link always rests on
the exact overlap of the full shingle sets. Links are grouped by union-find.

A pair of similarity s meets in a band with probability
``1 - (1 - s^ROWS)^BANDS``: at 0.75 all but 6 in 10 million.

Defined results: null, empty and blank texts have no shingles and no links; a
shorter text than five words is one shingle; equal sets are linked whatever
their number; rows that repeat a doc_id count as one document (a text linked to
either of its texts is linked to it); a null doc_id stays by itself unless its
component's smallest id is asked for, which is then its own null; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MIX_A, MIX_B, WordHashes, free_name, grams, lists, mix, pieces_of, written
from .components import components

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 26, 3
_CHUNK = 60_000  # shingles sketched together
_BLOCK = 256  # sets compared with each other in one block


def shingles(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z lower-cased, split at ASCII white space."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    a = hashes.of(parts)
    return np.unique(grams(a, min(words, len(a))))


def signatures(values: np.ndarray, sizes: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of several sets laid end to end; one row of ``rank * 2^32 + draw`` per set."""
    n_sets = len(sizes)
    out = np.full(n_sets * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n_sets, dtype=np.int64), sizes)
    order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots < 256 else np.int32), (len(values), slots))
    mine = None  # permutations are copied once documents with many shingles are done
    first: list[np.ndarray] = []
    for level in range(slots):
        if not len(values):
            break
        r = mix(values + np.uint64((int(MIX_A) * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = level + (((r >> np.uint64(40)) * np.uint64(slots - level)) >> np.uint64(24)).astype(np.int64)
        if mine is None:  # trace the slot back through the swaps made so far
            slot = at
            for step in range(level - 1, -1, -1):
                slot = np.where(slot == first[step], step, slot)
            first.append(at)
        else:
            rows = np.arange(len(values))
            slot = mine[rows, at].astype(np.int64)
            mine[rows, at] = mine[:, level]
        value = (np.uint64(level) << np.uint64(32)) | (mix(r ^ MIX_B) >> np.uint64(32))
        np.minimum.at(out, owner * slots + slot, value)
        if level + 1 < slots:
            reached = out.reshape(n_sets, slots).max(axis=1) < np.uint64(level + 1) << np.uint64(32)
            stay = ~reached[owner]
            if not stay.all():
                values, owner = values[stay], owner[stay]
                if mine is None:
                    first = [f[stay] for f in first]
                else:
                    mine = mine[stay]
            if mine is None and level >= 5:
                mine = order[: len(values)].copy()
                rows = np.arange(len(values))
                for step, f in enumerate(first):
                    mine[rows, step], mine[rows, f] = mine[rows, f], mine[rows, step].copy()
    return out.reshape(n_sets, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band and set."""
    keys = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = mix(keys * MIX_A + parts[:, :, r])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * MIX_B)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for batch in pieces_of(whole, 1, 1 << 20):
            sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = np.zeros((len(sets), BANDS), np.uint64)
            filled = np.flatnonzero(sizes)
            start = 0
            while start < len(filled):
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[filled[start:]]), _CHUNK, "right")))
                some = filled[start:end]
                if len(some) == 1 and sizes[some[0]] > _CHUNK:  # a huge set: minimum over its parts
                    s = sets[some[0]]
                    parts = [signatures(s[i : i + _CHUNK], np.array([len(s[i : i + _CHUNK])])) for i in range(0, len(s), _CHUNK)]
                    signature = np.minimum.reduce(parts)
                else:
                    signature = signatures(np.concatenate([sets[i] for i in some]), sizes[some])
                keys[some] = band_keys(signature)
                start = end
            prints = [(int((s * MIX_A).sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))) if len(s) else (0, 0) for s in sets]
            signed = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            held = sizes > 0
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n": pa.array(sizes),
                    "p": pa.array(signed[:, 0]),
                    "q": pa.array(signed[:, 1]),
                    "keys": lists(keys[held].view(np.int64).ravel(), np.where(held, BANDS, 0), pa.int64()),
                }
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for batch in pieces_of(whole, 1, 1 << 20):
            sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column(0), "shingles": lists(flat.view(np.int64), [len(s) for s in sets], pa.int64())}
            )


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Exact test on sorted distinct sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < threshold * max(n, m):
        return False
    if n > m:
        a, b, n, m = b, a, m, n
    at = np.searchsorted(b, a)
    at[at == m] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= threshold * (n + m - common)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, i, j, side, node, label, shingles`` sorted by the first three:
    compare sets of different components inside each block."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        crossed = rows[0][1] >= 0  # key of main block x other block; else others among themselves
        left = [r for r in rows if r[3] == 0] if crossed else rows
        for i, x in enumerate(left):
            for y in [r for r in rows if r[3] == 1] if crossed else rows[i + 1 :]:
                if find(x[5]) != find(y[5]) and similar(x[6], y[6]):
                    root[max(find(x[5]), find(y[5]))] = min(find(x[5]), find(y[5]))
                    yield x[4], y[4]

    def grouped() -> Iterator[tuple[int, int]]:
        held: list[tuple] = []
        for batch in batches:
            flat = batch.column(6).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(len(v) for v in batch.column(6))])
            for i, head in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if held and held[0][:3] != head[:3]:
                    yield from links(held)
                    held = []
                held.append((*head, flat[ends[i] : ends[i + 1]].view(np.uint64)))
        if held:
            yield from links(held)

    found = list(grouped())
    yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sketch = written(texts.mapInArrow(_sketch, "doc_id bigint, n bigint, p bigint, q bigint, keys array<bigint>"), "sketch")
    known = sketch.filter("n > 0 and doc_id is not null")

    # equal sets: all rows of a fingerprint are linked to its smallest id, which stands for the set
    prints = written(known.groupBy("p", "q", "n").agg(F.min("doc_id").alias("node")), "prints")
    same = known.select("doc_id", "p", "q", "n").join(prints, ["p", "q", "n"]).filter("doc_id <> node")
    nodes = known.join(prints.withColumnRenamed("node", "doc_id"), ["p", "q", "n", "doc_id"], "left_semi")
    banded = nodes.select(F.col("doc_id").alias("node"), "n", F.explode("keys").alias("key"))

    # first pass: every set against the smallest one of each key
    shared = written(
        banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).filter("first < last"),
        "keys",
    )
    members = written(banded.join(shared.select("key", "first", "size"), "key"), "members")
    stars = members.filter("node <> first").select("node", "first", "n").distinct()
    first_n = nodes.groupBy(F.col("doc_id").alias("first")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fit = (F.col("hi") * 100 >= F.col("n") * THRESHOLD) & (F.col("n") * 100 >= F.col("lo") * THRESHOLD)
    stars = written(stars.join(first_n, "first").filter(fit).select("node", "first").distinct(), "stars")
    wanted = members.select("node").distinct()
    sets = written(
        texts.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(_sets, "node bigint, shingles array<bigint>"), "sets"
    )
    left = sets.select(F.col("node"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("first"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    compared = stars.join(left, "node").join(right, "first").withColumn("c", common)
    close = compared.filter(F.col("c") * 100 >= (F.size("x") + F.size("y") - F.col("c")) * THRESHOLD)
    links = written(
        close.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))),
        "links",
    )
    labels = components(links)

    # second pass: keys that hold three or more sets in several components
    labelled = members.filter("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    tally = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = tally.groupBy("key").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("total"), F.count("*").alias("parts"))
    mixed = written(mixed.filter("parts > 1").select("key", F.col("main.label").alias("main"), F.col("main.c").alias("inside"), "total"), "mixed")
    blocks_in = F.ceil(F.col("inside") / _BLOCK).cast("int")
    blocks_out = F.ceil((F.col("total") - F.col("inside")) / _BLOCK).cast("int")
    own = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), blocks_in)).otherwise(F.pmod(F.xxhash64("node"), blocks_out)).cast("int")
    many = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    to = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    inside = many(blocks_out, lambda j: to(F.col("own"), j, 0))
    outside = F.concat(
        many(blocks_in, lambda i: to(i, F.col("own"), 1)),
        many(blocks_out, lambda j: to(-1 - F.least(F.col("own"), j), F.greatest(F.col("own"), j), 1)),
    )
    placed = labelled.join(mixed, "key").withColumn("own", own)
    placed = placed.withColumn("to", F.explode(F.when(F.col("label") == F.col("main"), inside).otherwise(outside)))
    blocks = placed.select("key", "to.i", "to.j", "to.side", "node", "label").join(sets, "node")
    blocks = blocks.select("key", "i", "j", "side", "node", "label", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = written(blocks.mapInArrow(_blocks, "a bigint, b bigint"), "links2")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    each = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(labels, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("label", "doc_id")
    return each.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without the documents whose group holds a smaller id."""
    name = free_name("_gone", docs)
    gone = written(groups(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "near_copies")
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col(name), "left_anti")
