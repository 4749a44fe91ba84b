"""Sections, sentences, diffs and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sequence, text as tx
from ..functions.collections import bind, index_range, present
from ..operators import context as cx, diff, pairing
from . import views as v
from .catalog import Tables, query


@query(
    "h_section_title",
    v.with_("revisions")
    + r"""SELECT rev_id, trim(regexp_extract(comment, '^/\*(.+)\*/(.*)', 1)) AS title,
    trim(regexp_extract(comment, '^/\*(.+)\*/(.*)', 2)) AS rest FROM revisions
    UNION ALL SELECT -1 - rev_id, '', comment FROM (SELECT rev_id, 'plain ' || comment AS comment FROM revisions)""",
)
def h_section_title(t: Tables) -> DataFrame:
    r = v.revisions(t).select("rev_id", "comment")
    plain = r.select((-1 - F.col("rev_id")).alias("rev_id"), F.concat(F.lit("plain "), "comment").alias("comment"))
    c = F.col("comment")
    return r.union(plain).select("rev_id", tx.section_title(c).alias("title"), tx.section_comment(c).alias("rest"))


@query(
    "h_section_text",
    r"""SELECT doc_id, trim(text, E' \t\n\r\f\x0b') AS body FROM documents
    WHERE NOT regexp_matches(text, '(?m)^(?:={1}[^=\n](?:[^\n]*[^=\n])?={1}|={2}[^=\n](?:[^\n]*[^=\n])?={2})[ \t]*$')""",
)
def h_section_text(t: Tables) -> DataFrame:
    """Each document as a section between others; deeper headings stay inside."""
    title = F.concat(F.lit("Sec (a|b)* "), F.col("doc_id").cast("string"))
    page = F.concat(
        F.lit("== Other ==\nx\n== "), title, F.lit(" ==\n"), F.col("text"), F.lit("\n== Next ==\ntail\n=== Deep ===\nend")
    )
    return t.documents.select("doc_id", tx.section_text(page, title).alias("body"))


@query(
    "h_sentences",
    v.with_("sents") + "SELECT doc_id, len(sents) AS n, md5(array_to_string(sents, '|')) AS digest FROM sents",
)
def h_sentences(t: Tables) -> DataFrame:
    sents = t.documents.select("doc_id", tx.split_sentences(F.col("text")).alias("s"))
    return sents.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


PAIR_TOKENS = f"SELECT pair_id, {v.tokens_sql('src')} AS a, {v.tokens_sql('tgt')} AS b FROM edit_pairs"


def _diffed(t: Tables) -> DataFrame:
    return (
        v.edit_pairs(t)
        .select("pair_id", tx.tokenize(F.col("src")).alias("a"), tx.tokenize(F.col("tgt")).alias("b"))
        .withColumn("ops", sequence.diff_ops("a", "b"))
    )


@query(
    "h_diff_ops",
    v.with_("edit_pairs", p=PAIR_TOKENS)
    + "SELECT pair_id, md5(array_to_string(b, ' ')) AS result, CAST(len(a) AS INTEGER) AS n_src, CAST(len(b) AS INTEGER) AS n_tgt FROM p",
)
def h_diff_ops(t: Tables) -> DataFrame:
    """The spans applied to the source give the target and cover both sides."""

    def size(o, side):
        return o[f"{side}2"] - o[f"{side}1"]

    def piece(o):
        kept = F.slice(F.col("a"), o["i1"] + 1, size(o, "i"))
        new = F.slice(F.col("b"), o["j1"] + 1, size(o, "j"))
        return F.when(o["tag"] == "equal", kept).when(o["tag"] == "delete", F.slice(kept, 1, 0)).otherwise(new)

    def total(side):
        return F.aggregate("ops", F.lit(0), lambda acc, o: acc + size(o, side))

    return _diffed(t).select(
        "pair_id",
        F.md5(F.array_join(F.flatten(F.transform("ops", piece)), " ")).alias("result"),
        total("i").alias("n_src"),
        total("j").alias("n_tgt"),
    )


@query(
    "h_changed_positions",
    v.with_("edit_pairs", p=PAIR_TOKENS)
    + "SELECT pair_id, true AS same_rest, a = b AS untouched FROM p",
)
def h_changed_positions(t: Tables) -> DataFrame:
    """What is not changed reads the same on both sides."""

    def rest(tokens: str, side: str):
        gone = sequence.changed(F.col("ops"), side)
        return bind(
            F.array_except(index_range(F.size(tokens)), gone),
            lambda keep: F.transform(keep, lambda i: F.get(F.col(tokens), i)),
        )

    touched = F.size(sequence.changed(F.col("ops"), "i")) + F.size(sequence.changed(F.col("ops"), "j"))
    return _diffed(t).select(
        "pair_id",
        (rest("a", "i") == rest("b", "j")).alias("same_rest"),
        (touched == 0).alias("untouched"),
    )


@query(
    "h_two_stage_diff",
    v.with_("kept")
    + """SELECT c.rev_id, true AS src_known, true AS tgt_known FROM kept c JOIN kept p ON c.parent_id = p.rev_id
    WHERE c.text <> p.text""",
)
def h_two_stage_diff(t: Tables) -> DataFrame:
    """Every changed sentence is found in the text it was cut from."""
    pairs = pairing.sections_of_pairs(pairing.pair_with_parent(pairing.gate_comments(v.revisions(t)), within=v.PAGE))
    changed = diff.two_stage_diff(pairs)

    def squeeze(c):
        return F.regexp_replace(c, r"\s+", "")

    def known(text: str, picked: str):
        parts = tx.split_sentences(F.col(picked))
        return bind(
            squeeze(F.col(text)), lambda whole: F.forall(parts, lambda s: F.contains(whole, squeeze(s)))
        )

    return changed.select(
        "rev_id", known("src_text", "src").alias("src_known"), known("tgt_text", "tgt").alias("tgt_known")
    )


def strips_sql(expr: str) -> str:
    for pattern, new in tx.MARKUP_STRIPS:
        quoted = pattern.replace("'", "''")
        to = new.replace("$1", "\\1")
        expr = f"regexp_replace({expr}, '{quoted}', '{to}', 'g')"
    return expr


WIKI = "'{{t|{{u}}}} [[A|b]] [[C]] <ref name=x>r</ref> [http://x.org y] {| t |} <!-- c --> ' || html"


@query("h_strip_markup", f"SELECT page_id, {strips_sql('w')} AS plain FROM (SELECT page_id, {WIKI} AS w FROM pages)")
def h_strip_markup(t: Tables) -> DataFrame:
    head = "{{t|{{u}}}} [[A|b]] [[C]] <ref name=x>r</ref> [http://x.org y] {| t |} <!-- c --> "
    return t.pages.select("page_id", tx.strip_markup(F.concat(F.lit(head), "html")).alias("plain"))


# changed tokens of these queries: long words, by a rule both engines share
DIFF_SQL = """flat AS (SELECT doc_id, sents, flatten(sents) AS tokens FROM sent_tokens),
  marked AS (SELECT *, list_filter(range(len(tokens)), lambda i: length(tokens[i + 1]) > 9) AS diff FROM flat)"""


def _marked(t: Tables) -> DataFrame:
    flat = v.sentence_tokens(t).withColumn("tokens", F.flatten("sents"))
    long_words = bind(
        F.col("tokens"),
        lambda w: F.filter(index_range(F.size(w)), lambda i: F.char_length(F.get(w, i)) > 9),
    )
    return flat.withColumn("diff", long_words)


def _list(c) -> F.Column:
    return F.array_join(F.transform(c, lambda i: i.cast("string")), ",")


@query(
    "h_sentence_of_token",
    v.with_("sent_tokens")
    + """SELECT doc_id, array_to_string(list_filter(range(len(sents)), lambda i: len(list_filter(sents[i + 1], lambda w: length(w) > 9)) > 0), ',') AS hit
    FROM sent_tokens""",
)
def h_sentence_of_token(t: Tables) -> DataFrame:
    hit = cx.sentence_of_token(F.col("sents"), F.col("tokens"), F.col("diff"))
    return _marked(t).select("doc_id", _list(hit).alias("hit"))


@query(
    "h_context_window",
    v.with_("sent_tokens")
    + f""", {DIFF_SQL}, d AS (SELECT doc_id, unnest(diff) AS i FROM marked),
    near AS (SELECT DISTINCT d.doc_id, d.i + o.o AS p FROM d, (VALUES (-2), (-1), (0), (1), (2)) AS o(o) JOIN marked m ON m.doc_id = d.doc_id
      WHERE d.i + o.o >= 0 AND d.i + o.o < len(m.tokens))
    SELECT n.doc_id, string_agg(m.tokens[n.p + 1], ' ' ORDER BY n.p) AS tokens, string_agg(CASE WHEN d.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY n.p) AS actions
    FROM near n JOIN marked m ON m.doc_id = n.doc_id LEFT JOIN d ON d.doc_id = n.doc_id AND d.i = n.p GROUP BY 1""",
)
def h_context_window(t: Tables) -> DataFrame:
    def joined(w: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(w, lambda x: x["token"]), " ").alias("tokens"),
            F.array_join(F.transform(w, lambda x: x["action"].cast("string")), "").alias("actions"),
        )

    window = bind(cx.context_window(F.col("tokens"), F.col("diff"), 2), joined)
    return _marked(t).select("doc_id", present(F.when(F.size("diff") > 0, window)))


@query(
    "h_extend_sentences",
    v.with_("sent_tokens")
    + """, s AS (SELECT doc_id, len(sents) AS n, len(sents) // 2 AS mid, list_transform(sents, lambda x: len(x)) AS z FROM sent_tokens WHERE len(sents) > 0),
    r1 AS (SELECT *, CASE WHEN z[mid + 1] <= 30 AND n > 1 THEN greatest(mid - 1, 0) ELSE mid END AS s1,
      CASE WHEN z[mid + 1] <= 30 AND n > 1 THEN least(mid + 1, n - 1) ELSE mid END AS e1 FROM s),
    g AS (SELECT *, (s1 < mid OR e1 > mid) AND list_sum(z[s1 + 1 : e1 + 1]) <= 30 AND e1 - s1 + 1 < n AS go FROM r1),
    r2 AS (SELECT doc_id, z, CASE WHEN go THEN greatest(s1 - 1, 0) ELSE s1 END AS s2, CASE WHEN go THEN least(e1 + 1, n - 1) ELSE e1 END AS e2 FROM g)
    SELECT doc_id, CAST(s2 AS INTEGER) AS "start", CAST(e2 AS INTEGER) AS "end", CAST(coalesce(list_sum(z[1 : s2]), 0) AS INTEGER) AS "offset" FROM r2""",
)
def h_extend_sentences(t: Tables) -> DataFrame:
    at = F.floor(F.size("sents") / 2).cast("int")
    grown = F.when(F.size("sents") > 0, cx.extend_sentences(F.col("sents"), at, at, 30, 2))
    return v.sentence_tokens(t).select("doc_id", present(grown))


@query(
    "h_map_context",
    v.with_("sent_tokens")
    + """, j AS (SELECT doc_id, sents, list_transform(sents, lambda x: array_to_string(x, ' ')) AS s FROM sent_tokens WHERE len(sents) > 0),
    k AS (SELECT doc_id, sents, s, s[len(s) // 3 + 1] AS a, s[len(s) * 2 // 3 + 1] AS b FROM j),
    f AS (SELECT doc_id, sents, list_position(list_transform(s, lambda x: contains(x, a)), true) - 1 AS st,
      list_position(list_transform(s, lambda x: contains(x, b)), true) - 1 AS en FROM k)
    SELECT doc_id, CAST(st AS INTEGER) AS "start", CAST(en AS INTEGER) AS "end",
    CAST(coalesce(list_sum(list_transform(sents[1 : st], lambda x: len(x))), 0) AS INTEGER) AS "offset" FROM f WHERE en >= st""",
)
def h_map_context(t: Tables) -> DataFrame:
    third = F.floor(F.size("sents") / 3).cast("int")
    two = F.floor(F.size("sents") * 2 / 3).cast("int")
    found = cx.map_context(F.col("sents"), F.get("sents", third), F.get("sents", two))
    return v.sentence_tokens(t).select("doc_id", present(F.when(F.size("sents") > 0, found)))


@query(
    "h_strip_context",
    v.with_("versions")
    + "SELECT doc_id, true AS same_front, true AS same_back, true AS sound FROM versions WHERE src IS NOT NULL",
)
def h_strip_context(t: Tables) -> DataFrame:
    """What is cut is equal on both sides; a cut only happens when it was needed."""
    docs = v.versions(t).select(
        "doc_id",
        *[
            F.transform(tx.split_sentences(F.col(c)), lambda s: tx.tokenize(s)).alias(n)
            for c, n in (("src", "a"), ("tgt", "b"))
        ],
    )
    x = F.col("x")
    cut = docs.withColumn("x", cx.strip_common_context(F.col("a"), F.col("b"), 200))

    def front(c):
        return F.slice(F.col(c), F.lit(1), x["front"])

    def back(c):
        return F.slice(F.col(c), F.size(c) - x["back"] + 1, x["back"])

    def n_tokens(c):
        return F.size(F.flatten(c))

    kept = [
        n_tokens(F.slice(F.col(c), x["front"] + 1, F.size(c) - x["front"] - x["back"])) for c in ("a", "b")
    ]
    fits = (kept[0] <= 200) & (kept[1] <= 200)
    needed = (n_tokens(F.col("a")) > 200) | (n_tokens(F.col("b")) > 200)
    return cut.select(
        "doc_id",
        (front("a") == front("b")).alias("same_front"),
        (back("a") == back("b")).alias("same_back"),
        ((fits == x["fits"]) & (needed | (x["front"] + x["back"] == 0)) & (n_tokens(front("a")) == x["offset"])).alias("sound"),
    )


@query(
    "h_edit_examples",
    v.with_("sents")
    + """SELECT doc_id, array_to_string(list_filter(sents, lambda s: contains(s, ' the ')), '|') AS pos,
    array_to_string(list_filter(sents, lambda s: NOT contains(s, ' the '))[1 : 10], '|') AS neg FROM sents""",
)
def h_edit_examples(t: Tables) -> DataFrame:
    def pick(s):
        changed = F.filter(index_range(F.size(s)), lambda i: F.contains(F.get(s, i), F.lit(" the ")))
        return bind(changed, lambda c: cx.edit_examples(s, c, F.col("doc_id"), 10))

    picked = t.documents.select("doc_id", bind(tx.split_sentences(F.col("text")), pick).alias("x"))
    return picked.select(
        "doc_id", F.array_join("x.pos", "|").alias("pos"), F.array_join("x.neg", "|").alias("neg")
    )


# the checking engine counts bytes: give every accented letter of the texts one byte
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßàäçèéêíñóöùúü"
ONE_BYTE = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(ACCENTED)])


@query(
    "h_levenshtein",
    v.with_("edit_pairs")
    + f"""SELECT pair_id, CAST(levenshtein(translate(src, '{ACCENTED}', {ONE_BYTE}), translate(tgt, '{ACCENTED}', {ONE_BYTE})) AS INTEGER) AS distance
    FROM edit_pairs""",
)
def h_levenshtein(t: Tables) -> DataFrame:
    return v.edit_pairs(t).select("pair_id", F.levenshtein("src", "tgt").alias("distance"))


@query(
    "h_tokenize",
    f"""SELECT doc_id, CAST(len({v.tokens_sql('text')}) AS INTEGER) AS n, md5(array_to_string({v.tokens_sql('text')}, ' ')) AS digest FROM documents""",
)
def h_tokenize(t: Tables) -> DataFrame:
    tokens = t.documents.select("doc_id", tx.tokenize(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_SIDES = {"src": "p", "tgt": "c"}
_SENTS = v.CTE["sents"].split("list_filter(", 1)[1].rsplit(" AS sents", 1)[0]
_RECORD_SQL = ", ".join(
    f"""{side}0 AS (SELECT rev_id, list_filter({_SENTS} AS sents FROM (SELECT c.rev_id, {alias}.text FROM kept c JOIN kept p ON c.parent_id = p.rev_id)),
    {side}1 AS (SELECT rev_id, sents, list_transform(sents, lambda s: {v.tokens_sql('s')}) AS st FROM {side}0),
    {side}2 AS (SELECT rev_id, sents, st, flatten(st) AS tokens FROM {side}1),
    {side}3 AS (SELECT *, list_filter(range(len(tokens)), lambda i: length(tokens[i + 1]) > 9) AS diff FROM {side}2),
    {side}d AS (SELECT rev_id, unnest(diff) AS i FROM {side}3),
    {side}n AS (SELECT DISTINCT d.rev_id, d.i + o.o AS p FROM {side}d d, (VALUES (-2), (-1), (0), (1), (2)) AS o(o) JOIN {side}3 m ON m.rev_id = d.rev_id WHERE d.i + o.o >= 0 AND d.i + o.o < len(m.tokens)),
    {side}w AS (SELECT n.rev_id, string_agg(m.tokens[n.p + 1], ' ' ORDER BY n.p) AS token, string_agg(CASE WHEN d.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY n.p) AS action
      FROM {side}n n JOIN {side}3 m ON m.rev_id = n.rev_id LEFT JOIN {side}d d ON d.rev_id = n.rev_id AND d.i = n.p GROUP BY 1)"""
    for side, alias in _SIDES.items()
)


@query(
    "h_context_records",
    v.with_(
        "kept",
        valid=f"""SELECT page_id, rev_id, rev_ord, comment FROM kept WHERE len({v.tokens_sql('comment')}) >= 3
      AND NOT contains(comment, '[[Project:AWB|AWB]]') AND NOT contains(comment, '[[Project:AutoWikiBrowser|AWB]]') AND NOT contains(comment, 'Undid revision')""",
    )
    + f""", {_RECORD_SQL},
    e AS (SELECT rev_id, sents, i, len(list_filter(st[i + 1], lambda x: length(x) > 9)) > 0 AS hit FROM (SELECT *, unnest(range(len(sents))) AS i FROM tgt3)),
    q AS (SELECT *, row_number() OVER (PARTITION BY rev_id, hit ORDER BY md5('7:' || rev_id || ':' || i)) AS place FROM e),
    x AS (SELECT rev_id, string_agg(sents[i + 1], '|' ORDER BY i) FILTER (WHERE hit) AS pos_edits, string_agg(sents[i + 1], '|' ORDER BY i) FILTER (WHERE NOT hit AND place <= 3) AS neg_edits FROM q GROUP BY 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rev_ord) AS no FROM valid),
    o AS (SELECT a.page_id, a.rev_id, b.no AS other, b.comment, row_number() OVER (PARTITION BY a.page_id, a.no ORDER BY abs(b.no - a.no), b.no) AS place
      FROM n a JOIN n b ON a.page_id = b.page_id AND a.no <> b.no),
    g AS (SELECT page_id, rev_id, string_agg(array_to_string({v.tokens_sql('comment')}, ' '), '|' ORDER BY other) AS neg_comments FROM o WHERE place <= 10 GROUP BY ALL)
    SELECT k.page_id, k.rev_id, k.parent_id, array_to_string({v.tokens_sql('k.comment')}, ' ') AS comment, coalesce(src.token, '') AS src_token, coalesce(src.action, '') AS src_action,
      coalesce(tgt.token, '') AS tgt_token, coalesce(tgt.action, '') AS tgt_action, coalesce(pos_edits, '') AS pos_edits, coalesce(neg_edits, '') AS neg_edits, coalesce(neg_comments, '') AS neg_comments
    FROM kept k JOIN tgt3 ON tgt3.rev_id = k.rev_id JOIN src3 ON src3.rev_id = k.rev_id LEFT JOIN srcw src ON src.rev_id = k.rev_id LEFT JOIN tgtw tgt ON tgt.rev_id = k.rev_id
    LEFT JOIN x ON x.rev_id = k.rev_id LEFT JOIN g ON g.page_id = k.page_id AND g.rev_id = k.rev_id WHERE len(tgt3.diff) > 0 OR len(src3.diff) > 0""",
)
def h_context_records(t: Tables) -> DataFrame:
    """Records of revision pairs; words of ten letters or more count as changed."""
    kept = pairing.gate_comments(v.revisions(t))
    pairs = pairing.pair_with_parent(kept, carry=("text",), within=v.PAGE).withColumnsRenamed({"text": "tgt", "parent_text": "src"})
    cut = pairs.withColumns({f"{side}_sents": tx.split_sentences(F.col(side)) for side in _SIDES})
    cut = cut.withColumns({f"{side}_tokens": F.transform(f"{side}_sents", lambda s: tx.tokenize(s)) for side in _SIDES})
    long_words = lambda w: F.filter(index_range(F.size(w)), lambda i: F.char_length(F.get(w, i)) > 9)
    marked = cut.withColumns({f"{side}_diff": bind(F.flatten(f"{side}_tokens"), long_words) for side in _SIDES})
    out = cx.context_records(marked, pairing.negative_comments(kept), window=2, k=3, seed=7)
    words, lines = (lambda c: F.array_join(c, " ")), (lambda c: F.array_join(c, "|"))
    return out.select(
        "page_id",
        "rev_id",
        "parent_id",
        words("comment").alias("comment"),
        *(words(f"{side}_token").alias(f"{side}_token") for side in _SIDES),
        *(F.array_join(F.transform(f"{side}_action", lambda x: x.cast("string")), "").alias(f"{side}_action") for side in _SIDES),
        lines("pos_edits").alias("pos_edits"),
        lines("neg_edits").alias("neg_edits"),
        lines(F.transform("neg_comments", lambda x: F.array_join(x, " "))).alias("neg_comments"),
    )
