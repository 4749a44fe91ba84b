"""The two irreducible sequence algorithms, as Arrow-batched helpers.

Diffing and span alignment are per-row dynamic programs; everything around
them (pre-filters, tag choice, labels, records) stays in native expressions.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_INT = T.IntegerType()
OPS_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("tag", T.StringType())] + [T.StructField(c, _INT) for c in ("i1", "i2", "j1", "j2")]
    )
)
SPAN_TYPE = T.StructType(
    [T.StructField("cost", T.LongType()), T.StructField("borders", T.ArrayType(_INT))]
)
STEPS_TYPE = T.StructType(
    [
        T.StructField("cost", T.LongType()),
        T.StructField("steps", T.ArrayType(T.StructType([T.StructField(c, _INT) for c in ("token", "before", "j1", "j2")]))),
    ]
)


def opcodes(a, b) -> list[tuple]:
    return SequenceMatcher(None, a, b).get_opcodes()


def _once(fn):
    """Keep the optimizer from copying a costly call into each of its uses."""
    return fn.asNondeterministic()


@_once
@F.pandas_udf(OPS_TYPE)
def diff_ops(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp spans over two token arrays."""
    names = ["tag", "i1", "i2", "j1", "j2"]
    return pd.Series(
        [
            None if x is None or y is None else [dict(zip(names, op)) for op in opcodes(list(x), list(y))]
            for x, y in zip(a, b)
        ]
    )


@_once
@F.pandas_udf(OPS_TYPE)
def diff_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over the characters of two strings."""
    names = ["tag", "i1", "i2", "j1", "j2"]
    return pd.Series(
        [None if x is None or y is None else [dict(zip(names, op)) for op in opcodes(x, y)] for x, y in zip(a, b)]
    )


def changed(ops: Column, side: str) -> Column:
    """Sorted 0-based positions touched on the source (``i``) or target (``j``) side."""
    hit = ["delete", "replace"] if side == "i" else ["insert", "replace"]
    return F.flatten(
        F.transform(
            F.filter(ops, lambda o: o["tag"].isin(hit)),
            lambda o: F.sequence(o[f"{side}1"], o[f"{side}2"] - 1),
        )
    )


def edit_distances(pattern: str, text: str) -> list[int]:
    """Levenshtein distance of ``pattern`` to every prefix of ``text``.

    Bit-parallel over the pattern: a few integer operations per text character.
    """
    m = len(pattern)
    if m == 0:
        return list(range(len(text) + 1))
    bits: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        bits[ch] = bits.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, [m]
    for ch in text:
        eq = bits.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += 1 if ph & top else (-1 if mh & top else 0)
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        out.append(score)
    return out


def _transforms(s: str, t: str, verbs: frozenset) -> bool:
    """Whether a tag turns the token ``s`` into the single word ``t`` (may be '')."""
    if s == t or s + "s" == t or s == t + "s" or (s, t) in verbs:
        return True
    if s.lower() != t.lower() or not s:
        return False
    return (
        t in (s.lower(), s.capitalize(), s.upper())
        or (s[0] == t[0] and s[1:].capitalize() == t[1:])
        or (s[-1] == t[-1] and s[:-1].upper() == t[:-1])
    )


GAP = "   "  # fixed value: words of a group are priced joined by three spaces
_FAR = 1_000_000_000
_CELLS = 20_000  # target characters advanced together
_PRICES = 1 << 20  # prices of an own cost function held at a time
_BACK = 1 << 20  # traceback cells held at a time
_LONG = 1_000  # target words from which a span is advanced alone


class _Span:
    """One source span against one target span."""

    def __init__(self, source: list[str], targets: list[str], verbs: frozenset):
        self.source, self.targets, self.verbs = source, targets, verbs
        self.n, self.m = len(source), len(targets)
        self.text = GAP.join(targets)
        lengths = np.array([len(t) for t in targets], dtype=np.int64)
        self.ends = np.cumsum(lengths + len(GAP)) - len(GAP)
        self.starts = self.ends - lengths
        self.longest = max(map(len, source), default=0)
        self.exact: dict[str, list[int]] = {}
        self.lower: dict[str, list[int]] = {}
        self.free: dict[str, list[tuple[int, int]]] = {}
        for j, w in enumerate(targets):
            self.exact.setdefault(w, []).append(j)
            self.lower.setdefault(w.lower(), []).append(j)

    def free_groups(self, s: str) -> list[tuple[int, int]]:
        """``(j, k)`` of the groups a transform makes of the token ``s``."""
        if s not in self.free:
            near = set(self.lower.get(s.lower(), ())) | set(self.exact.get(s + "s", ()))
            if s.endswith("s"):
                near.update(self.exact.get(s[:-1], ()))
            if self.verbs:
                near.update(j for j, w in enumerate(self.targets) if (s, w) in self.verbs)
            found = [(j, j + 1) for j in near if _transforms(s, self.targets[j], self.verbs)]
            parts = s.split("-")
            if len(parts) > 1:
                found += [(j, j + len(parts)) for j in self.exact.get(parts[0], ()) if self.targets[j : j + len(parts)] == parts]
            self.free[s] = found
        return self.free[s]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)


class _Together:
    """Several spans, advanced token by token and character by character.

    The Levenshtein table of a token against the whole target text is entered at
    every word with the cost of the split before it and left at every word's end,
    so a token costs time in its length times the text's, however long the
    groups are. Cells hold ``cost * many + start word``: the least is the cheapest,
    earliest start first. They are stored less ``many`` times their place in the
    text, which makes taking in a text character free, that is a running
    minimum; and each span lies ``apart`` below the one before it, so that none
    takes a value of its neighbours. Spans come with the most tokens first.

    ``price(token, text)`` replaces the Levenshtein distance, for one span at a
    time. Rows kept now and then are advanced again on the way back, so that the
    traceback held is bounded.
    """

    def __init__(self, spans: list[_Span], insertions: int, price=None):
        self.spans, self.insertions, self.price = spans, insertions, price
        count = np.arange(len(spans))
        words = np.array([x.m for x in spans])
        self.sizes = np.array([len(x.text) + 1 for x in spans])  # places of a text
        self.places, self.words, self.slots = (np.concatenate([[0], np.cumsum(x)]) for x in (self.sizes, words, words + 1))
        self.many = int(words.max()) + 1
        farthest = int(self.sizes.max()) + 2 * max(sum(map(len, x.source)) for x in spans) + 8
        self.down = count * farthest * self.many
        self.letters = np.concatenate([_codes("\n" + x.text) for x in spans])
        self.letters[self.places[:-1]] = -2  # nothing ends at the first place
        self.local = np.arange(self.slots[-1]) - np.repeat(self.slots[:-1], words + 1)
        self.word = np.arange(self.words[-1]) - np.repeat(self.words[:-1], words)
        self.slot = self.word + np.repeat(self.slots[:-1], words)
        starts, ends = (np.concatenate([getattr(x, c) for x in spans]) for c in ("starts", "ends"))
        self.start, self.end = (x + np.repeat(self.places[:-1], words) for x in (starts, ends))
        down = np.repeat(self.down, words)
        self.enter, self.leave = starts * self.many + down, ends * self.many + down
        self.hits: dict[int, np.ndarray] = {}

    def _inserted(self, best: np.ndarray) -> np.ndarray:
        """Keys per end word after words put in with no token, priced by their length."""
        key = best * self.many + self.local
        if len(self.slot):
            run = np.minimum.accumulate(best[self.slot] * self.many + self.word - self.enter)
            key[self.slot + 1] = np.minimum(key[self.slot + 1], run + self.leave)
        return key

    def _layers(self, best: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Costs after 0, 1, .. insertions behind the last token."""
        rows = [best]
        for q in range(self.insertions):
            key = self._inserted(rows[-1])
            rows.append(key // self.many)
            if back is not None:
                back[q] = key % self.many
        return np.array(rows)

    def _advance(self, cells: np.ndarray, tokens: list[str]) -> np.ndarray:
        """The cells of the first ``len(tokens)`` spans after all their tokens' characters."""
        live, many = len(tokens), self.many
        if live == 1:
            for ch in _codes(tokens[0]).tolist():
                if ch not in self.hits:
                    if len(self.hits) * len(cells) > _BACK:
                        self.hits.clear()
                    self.hits[ch] = (self.letters[1 : len(cells)] == ch) * many
                new = cells + many
                np.minimum(new[1:], cells[:-1] - self.hits[ch], out=new[1:])
                cells = np.minimum.accumulate(new, out=new)
            return cells
        lengths = np.array([len(s) for s in tokens])
        chars = np.full((int(lengths.max()), live), -1, dtype=np.int32)
        first = np.cumsum(lengths) - lengths
        chars[np.arange(int(lengths.sum())) - np.repeat(first, lengths), np.repeat(np.arange(live), lengths)] = _codes("".join(tokens))
        sizes, letters = self.sizes[:live], self.letters[: len(cells)]
        for row in chars:  # a token that is through adds nothing and meets no letter
            new = cells + np.repeat((row >= 0) * many, sizes)
            hit = letters[1:] == np.repeat(row, sizes)[1:]
            np.minimum(new[1:], cells[:-1] - hit * many, out=new[1:])
            cells = np.minimum.accumulate(new, out=new)
        return cells

    def _own_prices(self, s: str, best: np.ndarray, key: np.ndarray) -> None:
        """Put the groups of the only span's token ``s`` into ``key``, by ``price``."""
        span = self.spans[0]
        for j in range(span.m):
            text = span.text[span.starts[j] :]
            for lo in range(j, span.m, _PRICES):
                ends = span.ends[lo : lo + _PRICES]
                costs = np.array([self.price(s, text[:e]) for e in ends - span.starts[j]], dtype=np.int64)
                some = key[lo + 1 : lo + 1 + len(ends)]
                np.minimum(some, (best[j] + costs) * self.many + j, out=some)

    def _match(self, i: int, best: np.ndarray) -> np.ndarray:
        """Per end word the key of the cheapest group of token ``i``, after prefixes
        that cost ``best``, over the spans that have such a token."""
        many = self.many
        tokens = [x.source[i] for x in self.spans if x.n > i]
        live = len(tokens)
        words, slots = int(self.words[live]), int(self.slots[live])
        nothing = [
            0 if _transforms(s, "", x.verbs) else len(s) if self.price is None else self.price(s, "")
            for s, x in zip(tokens, self.spans)
        ]
        key = (best[:slots] + np.repeat(nothing, np.diff(self.slots[: live + 1]))) * many + self.local[:slots]
        slot = self.slot[:words]
        if self.price is not None:
            self._own_prices(tokens[0], best, key)
        elif words:
            cells = np.full(int(self.places[live]), np.iinfo(np.int64).max, dtype=np.int64)
            cells[self.places[:live]] = best[self.slots[:live]] * many - self.down[:live]
            cells[self.start[:words]] = best[slot] * many + self.word[:words] - self.enter[:words]
            cells = self._advance(np.minimum.accumulate(cells), tokens)
            key[slot + 1] = np.minimum(key[slot + 1], cells[self.end[:words]] + self.leave[:words])
        for b, s in enumerate(tokens):
            base = int(self.slots[b])
            for j, k in self.spans[b].free_groups(s):
                key[base + k] = min(key[base + k], int(best[base + j]) * many + j)
        return key

    def solve(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Per span its cheapest split as steps ``(token, j, k)`` in order (token
        -1 - i: words put in before token i)."""
        slots, n, extra = int(self.slots[-1]), self.spans[0].n, self.insertions
        block = max(1, min(n, _BACK // (slots * (extra + 1))))
        best = np.full(slots, _FAR, dtype=np.int64)
        best[self.slots[:-1]] = 0
        kept = []

        def room(rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return (
                np.zeros((rows, slots), dtype=np.int32),
                np.zeros((rows, slots if extra else 0), dtype=np.int16),
                np.zeros((rows, extra, slots), dtype=np.int32),
            )

        def rows(best: np.ndarray, lo: int, hi: int, trace=None) -> np.ndarray:
            best = best.copy()
            for i in range(lo, hi):
                layers = self._layers(best, trace and trace[2][i - lo])
                key = self._match(i, layers.min(axis=0))
                if trace:
                    trace[0][i - lo, : len(key)] = key % self.many
                    if extra:
                        trace[1][i - lo] = layers.argmin(axis=0)
                best[: len(key)] = key // self.many
            return best

        trace = room(n) if n <= block else None  # one block: its traceback is kept at once
        for lo in range(0, n, block):
            kept.append(best)
            best = rows(best, lo, min(lo + block, n), trace)
        last = np.zeros((extra, slots), dtype=np.int32)
        layers = self._layers(best, last)
        steps: list[list[tuple[int, int, int]]] = [[] for _ in self.spans]

        def put_in(b: int, i: int, k: int, q: int, at: np.ndarray) -> int:
            for layer in range(q, 0, -1):
                j = int(at[layer - 1, self.slots[b] + k])
                steps[b].append((-1 - i, j, k))
                k = j
            return k

        totals, places = [], []
        for b, span in enumerate(self.spans):
            ends = layers[:, self.slots[b] + span.m]
            totals.append(int(ends.min()))
            places.append(put_in(b, span.n, span.m, int(ends.argmin()), last))
        for number in range(len(kept) - 1, -1, -1):
            lo, hi = number * block, min((number + 1) * block, n)
            if n > block:
                trace = room(hi - lo)
                rows(kept.pop(), lo, hi, trace)
            back, layer, puts = trace
            for b, span in enumerate(self.spans):
                base, k = int(self.slots[b]), places[b]
                for i in range(min(hi, span.n) - 1, lo - 1, -1):
                    j = int(back[i - lo, base + k])
                    steps[b].append((i, j, k))
                    k = put_in(b, i, j, int(layer[i - lo, base + j]), puts[i - lo]) if extra else j
                places[b] = k
        return [(total, found[::-1]) for total, found in zip(totals, steps)]


def _batches(spans: list[tuple[int, _Span]], alone: bool):
    """Spans to advance together: long ones by themselves, the others with spans
    of tokens about as many and as long, the most tokens first."""
    part, places, kind = [], 0, None
    for i, x in sorted(spans, key=lambda x: (x[1].longest.bit_length(), x[1].n), reverse=True):
        if alone or x.m > _LONG:
            yield [(i, x)]
            continue
        if part and (places + len(x.text) > _CELLS or x.longest.bit_length() != kind):
            yield part
            part, places = [], 0
        part.append((i, x))
        places, kind = places + len(x.text) + 1, x.longest.bit_length()
    if part:
        yield part


def align_steps(
    pairs: list[tuple[list[str], list[str]]],
    verbs: frozenset = frozenset(),
    reach: int = 5,
    insertions: int = 0,
    price=None,
) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cheapest split of each target span into one group per source token.

    Returns cost and steps ``(token, j, k)``: the token takes the words ``j`` to
    ``k``. With ``insertions`` up to that many groups between two tokens (and
    before the first, after the last) belong to no token and cost the length of
    their text; their step has token ``-1 - i``, ``i`` the next token.
    ``price(token, text)`` replaces the Levenshtein distance of a token and a
    group's words, joined by ``GAP``. Among equally cheap splits the one whose
    last groups start earliest wins. ``reach`` has no effect any more: groups of
    every length cost the same. Without tokens and insertions only an empty
    target has a split.
    """
    found: list = [None] * len(pairs)
    waiting = []
    for i, (source, targets) in enumerate(pairs):
        if not source and targets and not insertions:
            raise ValueError("no token and no insertion to take the words")
        if len(source) == 1 and not insertions and price is None:  # one token takes every word
            s, m = source[0], len(targets)
            free = (m < 2 and _transforms(s, "".join(targets), verbs)) or (m > 1 and s.split("-") == targets)
            found[i] = (0 if free else edit_distances(s, GAP.join(targets))[-1], [(0, 0, m)])
        else:
            waiting.append((i, _Span(source, targets, verbs)))
    for part in _batches(waiting, price is not None):
        for (i, _), result in zip(part, _Together([x for _, x in part], insertions, price).solve()):
            found[i] = result
    return found


def align_spans(
    pairs: list[tuple[list[str], list[str]]], verbs: frozenset = frozenset(), reach: int = 5, price=None
) -> list[tuple[int, list[int]]]:
    """``align_steps`` without insertions: cost and group borders
    (``len(source) + 1`` numbers) per pair."""
    return [(cost, [0, *(k for _, _, k in steps)]) for cost, steps in align_steps(pairs, verbs, reach, 0, price)]


def align_ops():
    """UDF: opcodes of two token arrays with every replace span cut into one
    group per source token; merge spans are kept whole (tag ``merge``). The third
    column holds the verb pairs ``"w1 w2"`` between the row's tokens."""

    @_once
    @F.pandas_udf(OPS_TYPE)
    def run(a: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        # pairs of other rows are in the lexicon too, so the batch may share them
        verbs = frozenset(tuple(x.split(" ")) for own in v if own is not None for x in own)
        rows = [None if x is None or y is None else (list(x), list(y)) for x, y in zip(a, b)]
        plans = [None if r is None else opcodes(*r) for r in rows]
        spans: dict[tuple, int] = {}
        for row, plan in zip(rows, plans):
            for tag, i1, i2, j1, j2 in plan or ():
                if tag == "replace" and i2 - i1 > 1:
                    spans.setdefault((tuple(row[0][i1:i2]), tuple(row[1][j1:j2])), len(spans))
        aligned = align_spans([(list(s), list(t)) for s, t in spans], verbs)

        def refine(src: list[str], tgt: list[str], plan: list[tuple]) -> list[dict]:
            out = []

            def add(tag: str, i1: int, i2: int, j1: int, j2: int) -> None:
                out.append({"tag": tag, "i1": i1, "i2": i2, "j1": j1, "j2": j2})

            for tag, i1, i2, j1, j2 in plan:
                if tag != "replace" or i2 - i1 == 1:
                    if tag != "equal":
                        add(tag, i1, i2, j1, j2)
                elif j2 - j1 == 1 and "-".join(src[i1:i2]) == tgt[j1]:
                    add("merge", i1, i2, j1, j2)
                else:
                    cut = aligned[spans[tuple(src[i1:i2]), tuple(tgt[j1:j2])]][1]
                    for k in range(i2 - i1):
                        add("replace", i1 + k, i1 + k + 1, j1 + cut[k], j1 + cut[k + 1])
            return out

        return pd.Series([None if r is None else refine(*r, p) for r, p in zip(rows, plans)])

    return run


def span_cost(verbs: frozenset = frozenset(), price=None):
    """UDF: cost and group borders of one source span against one target span."""

    @_once
    @F.pandas_udf(SPAN_TYPE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = align_spans([(list(x), list(y)) for x, y in zip(a, b)], verbs, price=price)
        return pd.DataFrame({"cost": [c for c, _ in found], "borders": [k for _, k in found]})

    return run


def span_steps(insertions: int = 1, verbs: frozenset = frozenset(), price=None):
    """UDF: cost and steps of one source span against one target span, with up to
    ``insertions`` groups between two tokens that belong to none (``token`` null;
    ``before`` is the number of the next token)."""

    @_once
    @F.pandas_udf(STEPS_TYPE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = align_steps([(list(x), list(y)) for x, y in zip(a, b)], verbs, insertions=insertions, price=price)
        rows = [
            [{"token": i if i >= 0 else None, "before": i if i >= 0 else -1 - i, "j1": j, "j2": k} for i, j, k in steps]
            for _, steps in found
        ]
        return pd.DataFrame({"cost": [c for c, _ in found], "steps": rows})

    return run
