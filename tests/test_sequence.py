"""Span alignment against a plain dynamic program."""

import random
import time
import tracemalloc

import pytest

from palimpsest.functions import sequence as S


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def plain(source, targets):
    def price(s, j, k):
        group = targets[j:k]
        if len(group) < 2 and S._transforms(s, "".join(group), frozenset()):
            return 0
        if len(group) > 1 and s.split("-") == group:
            return 0
        return lev(s, S.GAP.join(group))

    n, m = len(source), len(targets)
    best = [[10**9] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    came = {}
    for i in range(n):
        for j in range(m + 1):
            for k in range(j, m + 1):
                c = best[i][j] + price(source[i], j, k)
                if c < best[i + 1][k]:
                    best[i + 1][k] = c
                    came[i + 1, k] = j
    borders = [m]
    for i in range(n, 0, -1):
        borders.append(came[i, borders[-1]])
    return best[n][m], borders[::-1]


def test_distances():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 70)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 20)))
        assert S.edit_distances(a, b) == [lev(a, b[:k]) for k in range(len(b) + 1)]


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_alignment(reach):
    rng = random.Random(reach)

    def word():
        return "".join(rng.choice("abcS-s") for _ in range(rng.randint(1, 5)))

    pairs = [([word() for _ in range(rng.randint(1, 6))], [word() for _ in range(rng.randint(1, 25))]) for _ in range(120)]
    pairs += [(["x" * 70, "ab"], ["ab", "x" * 66, "c"]), (["well-known", "a"], ["well", "known", "a"])]
    for pair, (cost, borders) in zip(pairs, S.align_spans(pairs, reach=reach)):
        assert (cost, list(borders)) == plain(*pair)


def test_demo_cost():
    assert S.align_spans([(["u", "looks", "nice"], ["You", "look", "good"])])[0] == (6, [0, 1, 2, 3])


def plain_steps(source, targets, insertions, price=lev):
    """Every state (tokens, words, insertions since the last token), one by one."""

    def cost(s, group):
        if len(group) < 2 and S._transforms(s, "".join(group), frozenset()):
            return 0
        if len(group) > 1 and s.split("-") == group:
            return 0
        return price(s, S.GAP.join(group))

    n, m = len(source), len(targets)
    best, came = {(0, 0, 0): 0}, {}

    def offer(state, value, origin):
        if value < best.get(state, 10**9):
            best[state], came[state] = value, origin

    for i in range(n + 1):
        for j in range(m + 1):
            for q in range(insertions + 1):
                if (i, j, q) not in best:
                    continue
                have = best[i, j, q]
                for k in range(j, m + 1):
                    if i < n:
                        offer((i + 1, k, 0), have + cost(source[i], targets[j:k]), (i, j, q))
                    if q < insertions:
                        offer((i, k, q + 1), have + len(S.GAP.join(targets[j:k])), (i, j, q))
    ends = [best.get((n, m, q), 10**9) for q in range(insertions + 1)]
    state, steps = (n, m, ends.index(min(ends))), []
    while state in came:
        i, j, q = came[state]
        steps.append((i if state[0] > i else -1 - i, j, state[1]))
        state = (i, j, q)
    return min(ends), steps[::-1]


def some_pairs(rng, count, tokens=5, words=10):
    def word():
        return "".join(rng.choice("abS-s") for _ in range(rng.randint(1, 4)))

    return [([word() for _ in range(rng.randint(0, tokens))], [word() for _ in range(rng.randint(0, words))]) for _ in range(count)]


@pytest.mark.parametrize("insertions", [1, 2])
@pytest.mark.parametrize("parts", [False, True])
def test_insertions(insertions, parts, monkeypatch):
    if parts:  # every span in parts, a row of traceback at a time
        monkeypatch.setattr(S, "_LONG", 0)
        monkeypatch.setattr(S, "_PRICES", 7)
        monkeypatch.setattr(S, "_BACK", 1)
    pairs = some_pairs(random.Random(insertions), 150)
    for pair, found in zip(pairs, S.align_steps(pairs, insertions=insertions)):
        assert found == plain_steps(*pair, insertions)


def test_own_cost():
    def price(token, text):
        return abs(len(token) - len(text)) + 2 * (token[:1] != text[:1])

    pairs = some_pairs(random.Random(9), 100)
    for pair, found in zip(pairs, S.align_steps(pairs, insertions=1, price=price)):
        assert found == plain_steps(*pair, 1, price)
    pairs = [p for p in pairs if p[0]]
    for pair, (cost, borders) in zip(pairs, S.align_spans(pairs, price=price)):
        total, steps = plain_steps(*pair, 0, price)
        assert (cost, borders) == (total, [0, *(k for _, _, k in steps)])


def test_parts_change_nothing(monkeypatch):
    pairs = [p for p in some_pairs(random.Random(5), 40, tokens=30, words=60) if p[0]]
    whole = S.align_spans(pairs)
    monkeypatch.setattr(S, "_LONG", 0)
    monkeypatch.setattr(S, "_PRICES", 50)
    monkeypatch.setattr(S, "_BACK", 300)
    assert S.align_spans(pairs) == whole


def test_nothing_to_align():
    assert S.align_steps([([], [])]) == [(0, [])]
    assert S.align_steps([([], ["ab", "c"])], insertions=1) == [(6, [(-1, 0, 2)])]
    assert S.align_spans([(["ab", "c"], [])]) == [(3, [0, 0, 0])]
    with pytest.raises(ValueError):
        S.align_steps([([], ["ab"])])


def test_memory_of_a_long_span():
    """40 tokens against 20,000 words: one row of m x m would be 3.2 GB."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    source = [rng.choice(words) for _ in range(40)]
    targets = [w for s in source for w in [s, *(rng.choice(words) for _ in range(3))]] * 125
    tracemalloc.start()
    try:
        found = S.align_steps([(source, targets)], insertions=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    cost, steps = found[0]
    assert steps[0][1] == 0 and steps[-1][2] == len(targets)
    assert all(a[2] == b[1] for a, b in zip(steps, steps[1:]))
    assert sum(1 for i, _, _ in steps if i >= 0) == 40
    assert peak < 400 << 20


def test_long_groups_cost_no_more():
    """Few tokens against many unlike words: every best group is far longer than its
    token, which took time in the square of the words."""
    rng = random.Random(4)

    def word(letters, most):
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))

    pairs = [([word("abcdxyz", 12) for _ in range(60)], [word("abcdefgh", 9) for _ in range(900)]) for _ in range(8)]
    start = time.process_time()
    found = S.align_spans(pairs)
    assert time.process_time() - start < 5
    for (source, targets), (cost, borders) in zip(pairs, found):
        assert cost == sum(lev(s, S.GAP.join(targets[j:k])) for s, j, k in zip(source, borders, borders[1:]))


@pytest.mark.parametrize("cells", [1, 60, 5000])
def test_spans_together(cells, monkeypatch):
    """Spans of unlike sizes advanced together take nothing of their neighbours."""
    monkeypatch.setattr(S, "_CELLS", cells)
    pairs = some_pairs(random.Random(11), 200, tokens=7, words=9)
    pairs += [(["s", "日本" * 40, "s"], ["日本" * 38, "x"]), (["a"], []), (["b", "a"], [])]
    for insertions in (0, 1):
        some = [p for p in pairs if p[0] or insertions]
        for pair, found in zip(some, S.align_steps(some, insertions=insertions)):
            assert found == plain_steps(*pair, insertions)
