"""Periodic runs, personal data and fill-in-the-middle against plain programs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from compare import compare, connect

from palimpsest.llm import fill_middle, periodic, privacy
from palimpsest.llm.queries import ORACLES

TEXTS = [
    "",
    " \n ",
    "x " * 700,
    "a b " * 5 + "c",
    "a b " * 6,
    "one two three four five six " * 2,
    "one two three four five six " * 2 + "one",
    "p q r " * 9 + "p q z " + "p q r " * 9,
    "k " + "m n " * 40 + "m m " + "m n " * 40,
    "été x y " * 13,
    "aaaa" * 200,
]


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_equal_plain_program():
    rng = random.Random(5)
    for turn in range(400):
        n, kinds = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if turn % 3 == 0 and n:
            p = rng.randrange(1, 9)
            cut = rng.randrange(n)
            words[cut:] = (words[cut : cut + p] * 90)[: n - cut]
        codes = np.array(words, np.int64)
        assert periodic.runs_of(codes) == plain_runs(words)
        assert periodic.runs_of(codes, 5) == plain_runs(words, 5)


def test_runs_of_long_texts_stay_linear():
    one = np.zeros(60_000, np.int64)
    assert periodic.runs_of(one) == [(0, 60_000, 1)]
    pattern = np.tile(np.arange(7), 6_000)
    assert periodic.runs_of(np.r_[pattern, [99], pattern]) == [(0, 42_000, 7), (42_001, 42_000, 7)]
    # a phrase between different words thousands of times has pairs, but no run
    rng = np.random.default_rng(1)
    phrase = np.concatenate([[*range(8), 100 + i] for i in range(5_000)])
    assert periodic.runs_of(np.r_[phrase, rng.integers(10, 90, 50)]) == []


def test_find_runs_of_rows(spark, odd, none):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x", 1), (3, TEXTS[3], "x", 1), (3, TEXTS[3], "x", 1), (50, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, collapsed int")
    for table in (docs, odd):
        want = Counter()
        for r in table.collect():
            words = brute.words(r["text"])
            runs = plain_runs(words) if len(words) < 5000 else [(0, 30_000, 5_003)]  # the long texts count modulo 5003
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            want[r["doc_id"], tuple(runs), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
        got = Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"]), bytes(r["collapsed"]).decode()) for r in periodic.find_runs(table).collect())
        assert got == want
    assert periodic.find_runs(none).count() == 0


PIECES = ["a@b.c", "x.y@@z.d", "@", "q@no", "%a+b@c-d.e.f.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (377) 555-0271", "+1", "+12 34", "++123456789 0 ", "12345678901234567890", " ", "word", "é١", "9", "a@b.c%x@d.e"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            value = m[0] if kind == "ip" else re.sub("[A-Z]", lambda c: c[0].lower(), m[0]) if kind == "email" else digits
            out.append((kind, m.start(), m.end(), value))
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) + rng.choice(["", "", " ", "\n", "-", "."]) for _ in range(rng.randrange(12)))
        assert privacy.base_spans(text) == plain_spans(text)
    long = "a" * 300_000 + " " + "1" * 300_000 + " a@" + "b" * 300_000
    assert privacy.base_spans(long) == []


def plain_disclosed(rows):
    """Per row the disclosing terms' places, from a program that counts in dictionaries."""
    term = re.compile(privacy.TERM)
    lower = lambda s: re.sub("[A-Z]", lambda c: c[0].lower(), s)
    n_term, n_entity, n_both, texts, near = Counter(), Counter(), Counter(), defaultdict(set), []
    for _, text in rows:
        text = text or ""
        spans = plain_spans(text)
        n_term.update({lower(t) for t in term.findall(text)})
        n_entity.update({f"{k}:{v}" for k, _, _, v in spans})
        free = [m for m in term.finditer(text) if not any(s < m.end() and e > m.start() for _, s, e, _ in spans)]
        own = set()
        for kind, s, e, v in spans:
            before = [m for m in free if m.end() <= s][-privacy.WINDOW :]
            after = [m for m in free if m.start() >= e][: privacy.WINDOW]
            own |= {(f"{kind}:{v}", lower(m[0]), m.start(), m.end()) for m in before + after}
        near.append(own)
        for pair in {x[:2] for x in own}:
            n_both[pair] += 1
            texts[pair].add(text)
    n, out = math.log(len(rows)), []
    for own in near:
        places = set()
        for e, t, a, b in own:
            ic = n - math.log(n_entity[e])
            if ic > 0 and len(texts[e, t]) >= privacy.TEXTS and (n + math.log(n_both[e, t]) - math.log(n_entity[e]) - math.log(n_term[t])) / ic >= privacy.GENERALISE:
                places.add((a, b))
        out.append(sorted(places))
    return out


def people():
    """Three persons named near their address in several texts, much plain prose."""
    rng = random.Random(11)
    prose = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(200):
        words = [rng.choice(prose) for _ in range(40)]
        if i % 8 < 3:
            who = i % 8
            words[20:20] = ["The", f"Mayor{who}", f"of{who}", f"mail{who}@town.example.org", f"No{who * 111}", "again"]
        rows.append((i, " ".join(words)))
    rows += [(900 + k, f"copied secret{k % 2} b@c.d " + "tail " * 3) for k in range(20)]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (2005, None), (2006, ""), (2007, "+1 (377) 555-0271")]
    return rows


def test_disclosing_terms(spark, none, tmp_path):
    rows = people()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, tag string")
    got = Counter((r["doc_id"], r["chars"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"]), tuple((t["start"], t["end"]) for t in r["terms"])) for r in privacy.spans(docs).collect())
    want = Counter()
    for (d, t), places in zip(rows, plain_disclosed(rows)):
        want[d, len(t or ""), tuple(s[:3] for s in plain_spans(t or "")), tuple(places)] += 1
    assert got == want
    assert any(k[3] for k in want) and not any(k[3] for k in want if not k[2])
    assert privacy.spans(none).count() == 0
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in clean.filter("doc_id between 1 and 199").collect()}
    before = dict(rows)
    for i, text in by_id.items():
        assert "@" not in text and (i % 8 < 3 or text == before[i])
    assert "Mayor1" not in by_id[1] and "<email>" in by_id[1]
    assert clean.count() == len(rows) and clean.filter("text is null").count() == 1


def test_disclosing_terms_equal_sql(spark, tmp_path):
    from palimpsest.llm.queries import QUERIES

    unique = {}
    for d, t in people():
        if d is not None:
            unique.setdefault(d, t)
    spark.createDataFrame([*unique.items(), (5000, "Mayor1 %s b@c.d.e" % " ".join(PIECES))], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    assert compare(QUERIES["op12_private_data"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["op12_private_data"]) == []


def test_fill_middle_of_rows(spark, odd, none):
    rows = [(i, t, "x", i) for i, t in enumerate(["", "\n", "a", "a\n", "a\n\nb", "l1\nl2\nl3\n", "has <S> in\nit", "é\n\U0001f600\nz<\nS>", None, "p<\n<S\n>M>" * 40])]
    rows += [(None, "a\nb\nc\n", "x", 1), (2, "a", "x", 1)] + [(k, "".join(f"{j}\n" for j in range(k % 7)), "x", 1) for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, form int")
    for table in (docs, odd):
        given = Counter((r["doc_id"], r["text"] or "") for r in table.collect())
        arranged = fill_middle.transform(table)
        out = fill_middle.restore(arranged.select("*", arranged["output"].alias("kept")))
        assert Counter((r["doc_id"], r["restored"]) for r in out.collect()) == given
        want = {}
        for doc, text in given:
            h = hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
            units = re.findall(r"[^\n]*\n|[^\n]+", text)
            a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
            prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
            form = "plain" if not text or any(s in text for s in ("<P>", "<S>", "<M>")) else "spm" if h4 % 100 < 50 else "psm"
            put = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
            sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
            want[doc, text] = (len(units), form, *sizes, put, hashlib.sha256(put.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        names = ["n", "form", "prefix_chars", "middle_chars", "kept", "output_sha256", "restored_sha256"]
        for r in out.collect():
            assert tuple(r[n] for n in names) == want[r["doc_id"], r["restored"]]
    forms = {r["form"] for r in fill_middle.transform(docs).collect()}
    assert forms == {"plain", "psm", "spm"}
    assert {r["form"] for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert fill_middle.restore(fill_middle.transform(none)).count() == 0


def test_piece_table_cuts():
    table = fill_middle.PieceTable.over(b"abcdef")
    assert [t.text() for t in table.cut(2, 2)] == [b"ab", b"", b"cdef"]
    assert [t.text() for t in table.cut(0, 6)] == [b"", b"abcdef", b""]
    two = fill_middle.PieceTable([(b"abc", 1, 3), (b"xyz", 0, 2)])
    for i in range(5):
        for j in range(i, 5):
            assert [t.text() for t in two.cut(i, j)] == [b"bcxy"[:i], b"bcxy"[i:j], b"bcxy"[j:]]
    with pytest.raises(ValueError):
        fill_middle.PieceTable.restored(b"<P>no end", "psm")
