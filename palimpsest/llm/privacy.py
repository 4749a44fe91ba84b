"""Personal data: patterns for direct identifiers, corpus co-occurrence for the rest.

The patterns find emails, ip addresses, cards and phone numbers. Each value found
is a protected entity. What else gives it away is learnt from the whole corpus: a
term that stands near an entity in some document discloses it by

    PMI(entity; term) / IC(entity)
        = (ln N + ln n_both - ln n_entity - ln n_term) / (ln N - ln n_entity)

(1: whoever reads the term knows the entity; 0: nothing is learnt). Counts are of
documents: N all, n_term those that hold the term anywhere, n_entity and n_both
those that hold the entity, or it with the term near. Near means among the
``WINDOW`` terms before or after a mention. Pairs seen in fewer than ``TEXTS``
different texts are no evidence. Near its entity a term of disclosure ``GENERALISE``
or more is replaced by its class, from ``REMOVE`` on it goes. Only documents that
hold the entity are touched, so a document without personal data is left alone.

Steps: one pass finds base spans and the terms near them (written; small), one pass
counts candidate terms in all texts behind a bit map of 2**20 bits, whatever their
number, and one keyed join brings the disclosing pairs back to their places. Pairs
are at most ``2 * WINDOW`` a mention and are aggregated before they are shuffled.

Defined results: null and empty texts have no spans; rows are told apart by id, text
hash and text length, so that rows that repeat get equal spans, each of them counts,
and null ids are kept; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, pieces_of, quoted, written

#: The patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, TEXTS, GENERALISE, REMOVE = 8, 3, 0.85, 0.95
_TERM, _DIGIT = re.compile(TERM), re.compile("[0-9]")
_BITS = 1 << 20
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before an ``@`` (which is none
    of them), so one look at each ``@`` finds what a scan from the left would."""
    done, at = 0, text.find("@")
    while at >= 0:
        part = text[done:at]
        size = len(part) - len(part.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if size else None
        done = found.end() if found else at + 1
        if found:
            yield at - size, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, entity)`` of the direct identifiers of a text."""
    out = []
    if "@" in text:
        out += [("email", s, e, text[s:e].translate(_LOWER)) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end(), m[0]))
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end(), digits))
        for m in PHONE.finditer(text) if "+" in text else ():
            digits = _NOT_DIGIT.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return out


def near_terms(text: str, spans: list[tuple[str, int, int, str]], window: int) -> set[tuple[str, str, int, int]]:
    """``(entity, term, start, end)`` near each span; what a span holds is no term."""
    taken = sorted((s, e) for _, s, e, _ in spans)
    terms, k, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            terms.append((m.start(), m.end()))
    starts = np.array([s for s, _ in terms], np.int64)
    out = set()
    for kind, s, _, value in spans:
        k = int(np.searchsorted(starts, s))
        for a, b in terms[max(0, k - window) : k + window]:
            out.add((f"{kind}:{value}", text[a:b].translate(_LOWER), a, b))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string())])
_NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = (
    "doc_id bigint, tag bigint, chars bigint, base array<struct<kind:string,start:bigint,end:bigint,entity:string>>, "
    "near array<struct<entity:string,term:string,start:bigint,end:bigint>>"
)
KEY = ("doc_id", "tag", "chars")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tag"), F.char_length(text).cast("bigint").alias("chars"), text.alias("text"))


def found(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Base spans of every text, and the terms near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 3):
                base, near = [], []
                for text in batch.column(3).to_pylist():
                    spans = base_spans(text)
                    base.append([dict(zip(("kind", "start", "end", "entity"), s)) for s in spans])
                    near.append([dict(zip(("entity", "term", "start", "end"), n)) for n in sorted(near_terms(text, spans, window))] if spans else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(base, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR))],
                    names=[*KEY, "base", "near"],
                )

    return texts.mapInArrow(run, _FOUND)


def _bit(terms: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(t) % _BITS for t in terms), np.int64, len(terms))


def bit_map(candidates: DataFrame) -> bytes:
    """``_BITS`` bits, those of the candidates' hashes set: 128 KB, whatever their
    number. Tasks send at most one map each, and the driver joins two at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BITS, bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_pylist())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(_BITS // 8, np.uint8)
    for row in candidates.select("term").coalesce(32).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def term_counts(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``term, n_term``: in how many documents of the corpus each candidate stands."""
    packed = bit_map(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        known: dict[str, bool] = {}
        for whole in batches:
            for batch in pieces_of(whole, 0):
                counts: Counter[str] = Counter()
                for text in batch.column(0).to_pylist():
                    terms = set(_TERM.findall(text.translate(_LOWER) if not text.isascii() else text.lower()))
                    new = list(terms.difference(known))
                    if len(known) + len(new) > 400_000:
                        known.clear()
                        new = list(terms)
                    known.update(zip(new, bits[_bit(new)].tolist()))
                    counts.update(t for t in terms if known[t])
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    counted = texts.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(candidates, "term", "left_semi")


def disclosures(texts: DataFrame, marks: DataFrame, least: float = GENERALISE, min_texts: int = TEXTS) -> DataFrame:
    """``entity, term, disclosure`` of the pairs that disclose enough, from the
    written table of ``found``."""
    of_row = marks.filter(F.size("near") > 0).select("tag", F.explode(F.array_distinct(F.transform("near", lambda n: F.struct(n["entity"].alias("entity"), n["term"].alias("term"))))).alias("p"))
    # one row per pair and text first: the copies of a text are counted, not shipped
    by_text = of_row.groupBy("p.entity", "p.term", "tag").agg(F.count("*").alias("n"))
    pairs = by_text.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_both")).filter(F.col("texts") >= min_texts)
    pairs = written(pairs.drop("texts"), "disclosing")
    candidates = written(pairs.select("term").distinct(), "candidates")
    entity = F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), s["entity"]))
    entities = marks.filter(F.size("base") > 0).select(F.explode(F.array_distinct(entity)).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = math.log(max(1, marks.count()))
    ic = F.lit(n) - F.log("n_entity")
    scored = pairs.join(term_counts(texts, candidates), "term").join(entities, "entity")
    scored = scored.withColumn("disclosure", F.when(ic > 0, (F.lit(n) + F.log("n_both") - F.log("n_entity") - F.log("n_term")) / ic).otherwise(F.lit(0.0)))
    return written(scored.filter(F.col("disclosure") >= least).select("entity", "term", "disclosure"), "disclosures")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: float = GENERALISE, min_texts: int = TEXTS) -> DataFrame:
    """``doc_id, tag, chars, base, terms``: direct identifiers (``kind, start, end,
    entity``), and disclosing terms (``start, end, disclosure``; the highest one
    counts), both by place, for every row."""
    texts = _texts(docs, id_col, text_col)
    marks = written(found(texts, window), "marks")
    known = disclosures(texts, marks, least, min_texts)
    near = marks.filter(F.size("near") > 0).dropDuplicates(list(KEY)).select(*KEY, F.explode("near").alias("x")).select(*KEY, "x.*")
    kept = near.join(known, ["entity", "term"]).groupBy(*KEY, "start", "end").agg(F.max("disclosure").alias("disclosure"))
    # a row's terms lie within `window` of its own mentions
    own = kept.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEY]
    both = marks.drop("near").alias("m").join(own.alias("o"), same[0] & same[1] & same[2], "left")
    return both.select(*(f"m.{k}" for k in KEY), "m.base", F.coalesce("o.terms", F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")).alias("terms"))


def generalised(term: str) -> str:
    """The class that stands for a term."""
    if any(c.isdigit() for c in term):
        return "<number>"
    return "<name>" if term[:1].isupper() else "<term>"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """The documents with ``text_col`` sanitised, one row per row; all other columns
    stay (the row travels as one struct, so that no name can clash). Identifiers
    become ``<kind>``; where spans overlap, the one that starts first (the longer, if
    several do) covers the others that start inside it."""
    marks = spans(docs, id_col, text_col, **options).dropDuplicates(list(KEY)).filter((F.size("base") > 0) | (F.size("terms") > 0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.char_length(text).cast("bigint").alias("c"), F.col(text_col).alias("t"))
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("tag")) & (F.col("c") == F.col("chars")), "left")

    @F.pandas_udf("string")
    def cut(texts, base, terms):
        import pandas as pd

        out = []
        for text, direct, other in zip(texts, base, terms):
            if direct is not None:
                places = [(s["start"], -s["end"], f"<{s['kind']}>") for s in direct]
                places += [(s["start"], -s["end"], "" if s["disclosure"] >= remove else generalised(text[s["start"] : s["end"]])) for s in other]
                parts, done = [], 0
                for start, end, instead in sorted(places):
                    if start >= done:
                        parts += [text[done:start], instead]
                        done = -end
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    clean = F.when(F.col("base").isNotNull(), cut("t", "base", "terms")).otherwise(F.col("t"))
    return joined.withColumn("t", clean).select(F.col("row").withField(quoted(text_col), F.col("t")).alias("row")).select("row.*")
