"""Best-fit packing by minimum bin slack.

Documents become token ids, those longer than a sequence are cut, and the
pieces are packed. Pieces of one length are alike, so the search needs only the
count of each length, at most ``capacity`` numbers however large the corpus.
Bin by bin, a subset-sum program over bit sets finds the fullest combination of
the lengths left that holds the longest one; it is taken as often as its lengths
allow, which is what bin after bin would repeat. Each combination uses up a
length, so there are at most ``capacity`` of them.

Pieces are numbered inside their length (range-partitioned, so that a length
which a third of the pieces share spans many tasks) and look their number up in
the table of combinations: sequence and offset follow by arithmetic.

Defined results: null and empty texts are the single end-of-text id; rows that
repeat are packed one by one; pieces of equal length are interchangeable and
ordered by id, piece and checksum; other columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import group_rank
from .common import pieces_of, written

CAPACITY = 2048
END = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: What a byte is to the tokenizer. Letters, here and below, are those of one or two
#: bytes whose case and composed form are plain: A-Z, and À-ÿ but for the signs × and ÷.
#: Of other characters beyond ASCII nothing is assumed.
SPACE, LETTER, DIGIT, STOP, QUOTE, OTHER = range(6)
_KINDS = np.full(256, STOP, np.uint8)
_KINDS[128:] = OTHER
_KINDS[list(b" \n")] = SPACE
_KINDS[list(b"0123456789")] = DIGIT
_KINDS[list(b"'")] = QUOTE
_KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
#: The first byte of the letters of two bytes, their second ones and those of capitals.
_LEAD = 0xC3
_SECOND, _CAPITAL_SECOND = np.zeros((2, 256), bool)
_SECOND[[i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)]] = True
_CAPITAL_SECOND[[i for i in range(0x80, 0x9F) if i != 0x97]] = True

#: ``_CUTS[8 * a + b]``: a chunk ends between a byte of kind ``a`` and one of kind ``b``,
#: since the tokenizer parts them wherever they stand. A quote may open a contraction
#: with the letters behind it and belongs to the stops beside it.
_CUTS = np.zeros((32, 8), bool)
_CUTS[:6, 1:6] = True
_CUTS[range(6), range(6)] = False
_CUTS[OTHER] = _CUTS[1:, OTHER] = False
_CUTS[QUOTE, LETTER] = _CUTS[QUOTE, STOP] = _CUTS[STOP, QUOTE] = False

#: Words whose ids follow from the vocabulary's merges alone.
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


def chunks(texts: pa.Array, added: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All texts (large binary, no nulls) cut where the tokenizer never joins, spaces
    and line feeds at the end of what they follow, and where each text's chunks begin
    (with the end). Letters become lower case, but for those before a character that may
    combine with them. One of the ``added`` tokens and what adjoins it stay as they are."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return pa.array([], pa.large_binary()), np.zeros(len(ends), np.int64)
    data = bytes(memoryview(texts.buffers()[2])[ends[0] : ends[-1]])
    body, ends = np.frombuffer(data, np.uint8), ends - ends[0]
    kinds = np.frombuffer(bytearray(data).translate(_KINDS.tobytes()), np.uint8)
    leads = np.flatnonzero(body[:-1] == _LEAD)
    leads = leads[_SECOND[body[leads + 1]]]
    kinds[leads] = kinds[leads + 1] = LETTER
    for token in added:
        at = data.find(token)
        while at >= 0:
            kinds[at : at + len(token)] = OTHER
            at = data.find(token, at + 1)
    capital = (body - np.uint8(65)) < 26
    capital[leads + 1] = _CAPITAL_SECOND[body[leads + 1]]
    capital[:-1] &= (body[1:] < 128) | (body[1:] == _LEAD)
    capital &= kinds == LETTER
    lower = body | (capital.view(np.uint8) << 5)
    cut = np.ones(len(body) + 1, bool)
    cut[1:-1] = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(_CUTS.tobytes()), bool)
    cut[ends] = True
    starts = np.flatnonzero(cut)
    buffers = [None, pa.py_buffer(starts), pa.py_buffer(lower)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers), np.searchsorted(starts, ends)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class WordIds:
    """Ids of the chunks of texts as little-endian 32-bit numbers.

    A text's ids are those of its chunks; tests hold this against whole texts. A batch
    is cut and numbered by its different chunks in columns, so that Python sees each of
    these once a batch. Most are words of lower-case letters, and one word to the
    tokenizer: the vocabulary's merges are run on them alone, many in one string, where
    the last id of a word is one that ends words.
    """

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.known: dict[str, bytes] = {}
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.added = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.letters = {chr(b): c for b, c in byte_letters().items() if b > 127 and c != chr(b)}

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks in one call; it tells each id's chunk."""
        known = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(known.ids, "<u4")
        ends = np.searchsorted(np.array(known.word_ids, np.int64), np.arange(len(chunks)), "right")
        self._store(chunks, ids, ends)

    def _store(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        offsets = np.append(0, 4 * ends)
        packed = pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        self.known.update(zip(chunks, packed.to_numpy(zero_copy_only=False).tolist()))

    def _learn_letters(self, words: list[str]) -> None:
        """The same for words of lower-case letters."""
        line = " ".join(words)
        if not line.isascii():
            line = line.encode().decode("latin-1")
            for byte, letter in self.letters.items():
                line = line.replace(byte, letter)
        ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words):
            self._store(words, ids, ends)
        else:  # a vocabulary that does not mark the ends of words
            self._learn(words)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Where the table is full, it starts again with these."""
        ids = list(map(self.known.get, chunks))
        new = list(dict.fromkeys(c for c, i in zip(chunks, ids) if i is None))
        if len(self.known) + len(new) > self.most:
            self.known = {c: i for c, i in zip(chunks, ids) if i is not None}
        letters = list(filter(_LETTERS, new))
        if letters:
            self._learn_letters(letters)
        others = [c for c in new if c not in self.known]
        if others:
            self._learn(others)
        return [self.known[c] if i is None else i for c, i in zip(chunks, ids)]

    def of(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text, and behind them the end of text."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        parts, first = chunks(texts.cast(pa.large_binary()).fill_null(b""), self.added)
        found = parts.dictionary_encode()
        words = found.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False)
        ids = pa.array(self._ids([w.rstrip(" \n") for w in words]), pa.large_binary()).take(found.indices)
        packed, end = memoryview(ids.buffers()[2] or b""), END.to_bytes(4, "little")
        at = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist() if len(ids) else first
        return [bytes(packed[a:b]) + end for a, b in zip(at, at[1:])]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The ``WordIds`` of a Python worker: Spark gives a worker one task after the
    other, and the chunks that one has met need not be encoded in the next."""
    return WordIds(path, most=500_000)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents; with ``ids`` also their token ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        step = 4 * capacity
        for whole in batches:
            for batch in pieces_of(whole, 1):
                rows: list[tuple] = []
                for doc, packed in zip(batch.column(0).to_pylist(), words.of(batch.column(1))):
                    for piece, at in enumerate(range(0, len(packed), step)):
                        part = packed[at : at + step]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            arrays.append(pa.array([np.frombuffer(r[5], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, PIECES + (", ids array<int>" if ids else ""))


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """``(length, times)`` with the largest sum up to ``room``; of equal sums one
    with long parts. Bit ``s`` of a set says that sum ``s`` can be reached."""
    mask = (1 << (room + 1)) - 1
    sets, parts = [1], []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, .. copies reach every number of copies
            take = min(take, left)
            now = (sets[-1] | sets[-1] << take * length) & mask
            sets.append(now)
            parts.append((length, take))
            left -= take
            take *= 2
            if now >> room & 1:
                break
        if sets[-1] >> room & 1:
            break
    total = sets[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(parts) - 1, -1, -1):
        if not sets[i] >> total & 1:  # the sum needs this part
            length, take = parts[i]
            total -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def combinations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(bins, [(length, times), ..])`` until every piece is in a bin."""
    counts = {k: n for k, n in histogram.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        inside = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        bins = min(counts[x] // n for x, n in inside.items())
        for x, n in inside.items():
            counts[x] -= bins * n
            if not counts[x]:
                del counts[x]
        out.append((bins, sorted(inside.items(), reverse=True)))
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    starts: dict[int, list[int]] = {}
    spots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for bins, inside in combinations(histogram, capacity):
        offset = 0
        for length, times in inside:
            starts.setdefault(length, []).append(used.get(length, 0))
            spots.setdefault(length, []).append((first, times, offset))
            used[length] = used.get(length, 0) + bins * times
            offset += length * times
        first += bins

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist()):
                k = bisect_right(starts[length], rank) - 1
                base, times, at = spots[length][k]
                own, slot = divmod(rank - starts[length][k], times)
                sequence.append(base + own)
                offset.append(at + slot * length)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1] + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    ranked = group_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "_rank")
    ranked = ranked.select(*pieces.columns, "_rank")
    kinds = ", ".join(f"{n} {k}" for n, k in pieces.dtypes)
    return ranked.mapInArrow(look_up, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: ``doc_id, piece, start, length, ids_crc32
    [, ids], sequence_id, offset``."""
    return place(written(tokenized(docs, tokenizer, capacity, ids, id_col, text_col), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from pieces with ids.
    A sequence holds at most ``capacity`` ids, so its group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
