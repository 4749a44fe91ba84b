"""License scans by ordered signature rules, in DataFrame functions only.

Each license family gives several word patterns (an SPDX tag, a grant "under
the terms of", a name with a version, a bare name). A pattern is a regular
expression over whole words and starts with a keyword. Texts are cut into words
once; only at words that are some rule's keyword are that keyword's rules tried,
on the words that follow (patterns span at most ``SPAN`` words). Detections
overlap: one that lies inside another of better or equal priority is dropped.

Everything happens inside the row: one scan, no shuffle, no Python.

Defined results: null and empty texts have no words, labels or positions; very
long texts are read whole and cost in proportion to their length; repeated rows
get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.collections import bind, index_range

SPAN = 16

#: Phrases that always count, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, SPDX words, then the names; ``|`` between words that may
#: stand in one place, ``?`` after words that may be missing.
FAMILIES = """
gpl: gpl: gnu general public; gnu gpl; gpl
lgpl: lgpl: gnu lesser|library general public; gnu lgpl; lgpl
agpl: agpl: gnu affero general public; affero general public; agpl
fdl: gfdl: gnu free documentation; gfdl
apache: apache: apache software? foundation?; asl
mit: mit: mit; expat
x11: x11: x11; mit x11
bsd: bsd: bsd; 2|3|4 clause bsd; new|simplified|modified bsd
isc: isc: isc; internet systems consortium
mpl: mpl: mozilla public; mpl
epl: epl: eclipse public; epl
edl: edl: eclipse distribution
cddl: cddl: common development and distribution; cddl
cpl: cpl: common public; ibm public
cc-by: cc by: creative commons attribution; cc by
cc-by-sa: cc by sa: creative commons attribution share sharealike|alike; creative commons attribution sharealike; cc by sa
cc-by-nc: cc by nc: creative commons attribution non? noncommercial|commercial; cc by nc
cc-by-nd: cc by nd: creative commons attribution no? noderivatives|noderivs|derivatives; cc by nd
cc0: cc0: cc0; creative commons zero
unlicense: unlicense: unlicense
zlib: zlib: zlib; zlib libpng
artistic: artistic: artistic; perl artistic
boost: bsl: boost software
wtfpl: wtfpl: wtfpl; do what the fuck you want to public
eupl: eupl: european union public; eupl
psf: python: python software foundation; psf
php: php: php
ruby: ruby: ruby
ofl: ofl: sil open font; ofl
ms-pl: ms pl: microsoft public; ms pl
ms-rl: ms rl: microsoft reciprocal; ms rl
postgresql: postgresql: postgresql
openssl: openssl: openssl
ncsa: ncsa: university of illinois ncsa; ncsa
afl: afl: academic free; afl
osl: osl: open software; osl
qpl: qpl: q public; qpl
sleepycat: sleepycat: sleepycat
bittorrent: bittorrent: bittorrent open source
cecill: cecill: cecill
odbl: odbl: open database; odbl
pddl: pddl: public domain dedication and
w3c: w3c: w3c software
vim: vim: vim
lppl: lppl: latex project public; lppl
upl: upl: universal permissive; upl
mulan: mulanpsl: mulan permissive software
blueoak: blueoak: blue oak model
elastic: elastic: elastic
sspl: sspl: server side public; sspl
busl: busl: business source; busl
public-domain: public domain: public domain
proprietary: licenseref proprietary: all rights reserved; proprietary
"""

#: Order (0 first), certainty, word pattern around the family's name or tag.
TEMPLATES = [
    (0, 1.0, "spdx license identifier {spdx}"),
    (1, 0.9, "under the? terms? and? conditions? of? the? {name}"),
    (2, 0.8, "{name} license|licence? version|ver? v?\\d+ \\d*"),
    (3, 0.6, "{name} license|licence|licenses|licensed"),
]


def pattern(words: str) -> str:
    """A word pattern as a regular expression over ``" word "`` after ``" word "``."""
    out = []
    for word in words.split():
        if word == "\\d*":
            out.append("(?: [0-9]+ )?")
        elif word.endswith("?") and not word.startswith("v?"):
            out.append(f"(?: (?:{word[:-1]}) )?")
        else:
            out.append(f" (?:{word.replace(chr(92) + 'd', '[0-9]')}) ")
    return "^" + "".join(out)


def rules() -> list[tuple[str, str, str, int, float]]:
    """``(keyword, pattern, label, priority, certainty)`` in order."""
    found = []
    for line in FAMILIES.strip().splitlines():
        label, spdx, names = (x.strip() for x in line.split(":"))
        for priority, certainty, template in TEMPLATES:
            for name in names.split(";"):
                words = template.format(spdx=spdx, name=name.strip())
                first = words.split()[0]
                for keyword in first.rstrip("?").split("|"):
                    item = (keyword, pattern(words), label, priority, certainty)
                    if item not in found:
                        found.append(item)
    return sorted(found, key=lambda r: r[3])


def _rule_table() -> Column:
    """Keyword -> its rules, as a literal map."""
    by: dict[str, list] = {}
    for number, (keyword, regex, label, priority, certainty) in enumerate(rules()):
        by.setdefault(keyword, []).append((regex, label, priority, certainty, number))
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    entries = []
    for keyword, own in by.items():
        items = ", ".join(
            f"named_struct('regex', {quote(r)}, 'label', {quote(label)}, 'priority', {p}, 'certainty', {c}D, 'number', {n})" for r, label, p, c, n in own
        )
        entries.append(f"{quote(keyword)}, array({items})")
    return F.expr(f"map({', '.join(entries)})")


def keywords() -> list[str]:
    return sorted({r[0] for r in rules()} | {p.split()[0] for p in BASE})


def _inside(x: Column, y: Column) -> Column:
    """Whether detection ``y`` suppresses ``x``."""
    longer = y["end"] - y["start"] > x["end"] - x["start"]
    same = y["end"] - y["start"] == x["end"] - x["start"]
    better = (y["priority"] < x["priority"]) | ((y["priority"] == x["priority"]) & (longer | (same & (y["number"] < x["number"]))))
    return (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & better


def _detections(words: Column, hits: Column, table: Column) -> Column:
    """Detections left after suppression; ``hits``: places of keywords, ascending."""

    def at(i: Column) -> Column:
        after = F.concat(F.lit(" "), F.array_join(F.slice(words, i + 1, SPAN), "  "), F.lit(" "))

        def tried(snippet: Column) -> Column:
            found = F.transform(
                F.coalesce(F.element_at(table, F.get(words, i)), F.array().cast("array<struct<regex:string,label:string,priority:int,certainty:double,number:int>>")),
                lambda r: F.struct(
                    i.cast("int").alias("start"),
                    (i + F.length(F.regexp_replace(F.coalesce(F.regexp_substr(snippet, r["regex"]), F.lit("")), "[^ ]", "")) / 2).cast("int").alias("end"),
                    r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label"), r["certainty"].alias("certainty"),
                ),
            )
            there = F.filter(found, lambda x: x["end"] > x["start"])
            return bind(there, lambda d: F.filter(d, lambda x: ~F.exists(d, lambda y: _inside(x, y))))

        return bind(after, tried)

    # left per place: at most one detection of each priority, so those that can
    # hold a detection are among the SPAN * 4 before it
    near = SPAN * len(TEMPLATES)
    return bind(
        F.flatten(F.transform(hits, at)),
        lambda d: F.filter(
            d,
            lambda x, k: ~F.exists(
                F.slice(d, F.greatest(k - near, F.lit(0)) + 1, F.least(k, F.lit(near)) + len(TEMPLATES)), lambda y: _inside(x, y)
            ),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base places, labels, score and all detections."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, lower)
    words = F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    step = docs.select(F.col(id_col).alias("doc_id"), words.alias("_w"))
    known = keywords()
    step = step.select("doc_id", "_w", F.filter(index_range(F.size("_w")), lambda i: F.get(F.col("_w"), i).isin(known)).alias("_hits"))
    base = F.filter(
        F.transform(
            F.col("_hits"),
            lambda i: F.struct(
                i.cast("bigint").alias("at"),
                F.coalesce(
                    *[
                        F.when(
                            _all([F.coalesce(F.get(F.col("_w"), i + k) == word, F.lit(False)) for k, word in enumerate(phrase.split())]), F.lit(label)
                        )
                        for phrase, label in BASE.items()
                    ]
                ).alias("label"),
            ),
        ),
        lambda x: x["label"].isNotNull(),
    )
    found = F.when(F.size("_hits") > 0, _detections(F.col("_w"), F.col("_hits"), _rule_table())).otherwise(
        F.array().cast("array<struct<start:int,end:int,priority:int,number:int,label:string,certainty:double>>")
    )
    step = step.select("doc_id", F.size("_w").cast("bigint").alias("n_words"), base.alias("_base"), found.alias("detections"))
    certain = F.coalesce(F.array_max(F.col("detections.certainty")), F.lit(0.0))
    of_base = F.when(F.size("_base") > 0, F.lit(TEMPLATES[-1][1])).otherwise(0.0)
    return step.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.col("_base.at")).alias("first_word"),
        F.array_max(F.col("_base.at")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("_base.label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("_base.label"), F.col("detections.label")))), ",").alias("labels"),
        F.greatest(certain, of_base).alias("score"),
        "detections",
    )


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rules_sql() -> str:
    """The rules as SQL rows (keyword, regex, label, priority, certainty, number)."""
    quoted = lambda s: "'" + re.sub("'", "''", s) + "'"
    return ", ".join(f"({quoted(k)}, {quoted(r)}, {quoted(label)}, {p}, {c}::DOUBLE, {n})" for n, (k, r, label, p, c) in enumerate(rules()))
