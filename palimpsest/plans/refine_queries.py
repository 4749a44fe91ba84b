"""Projections, predicates, rewriting and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, text as tx
from ..functions.bleu import bleu
from ..functions.collections import bind
from ..operators import pairing, refine
from . import views as v
from .bleu_sql import bleu_sql, pair_texts
from .catalog import Tables, query

TITLE_FREE = r"regexp_extract(comment, '^/\*(.+)\*/(.*)', 2)"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replace_sql(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {sql_text(a)}, {sql_text(b)})"
    return expr


def any_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_text(w)})" for w in words) + ")"


def markup_sql(expr: str) -> str:
    return rf"regexp_replace({replace_sql(expr, rules.MARKUP_REWRITES)}, '\[\[User.*\]\]', '', 'g')"


BLACKLIST_SQL = (
    "(" + any_sql("lower(comment)", rules.COMMENT_BLACKLIST) + " OR " + any_sql("comment", rules.COMMENT_MARKERS) + ")"
)


@query(
    "b_topic_filter",
    v.with_("revisions")
    + f"SELECT rev_id FROM revisions WHERE {any_sql('comment', rules.TOPIC_WORDS)} AND {any_sql(TITLE_FREE, rules.TOPIC_WORDS)}",
)
def b_topic_filter(t: Tables) -> DataFrame:
    return pairing.gate_comments(v.revisions(t)).select("rev_id")


SIGNED = "CASE WHEN doc_id % 3 = 0 THEN '(edited with [[User:ProveIt_GT|ProveIt]] ' WHEN doc_id % 3 = 1 THEN 'fix // Edit via Wikiplus ' ELSE '' END || text"


@query(
    "b_clean_comment",
    f"SELECT doc_id, {replace_sql('c', [(s, '') for s in rules.TOOL_SIGNATURES])} AS comment FROM (SELECT doc_id, {SIGNED} AS c FROM documents)",
)
def b_clean_comment(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    sign = F.when(k == 0, "(edited with [[User:ProveIt_GT|ProveIt]] ").when(k == 1, "fix // Edit via Wikiplus ").otherwise("")
    return t.documents.select("doc_id", tx.clean_comment(F.concat(sign, F.col("text"))).alias("comment"))


@query(
    "b_comment_gate",
    v.with_("revisions")
    + f"""SELECT rev_id FROM revisions WHERE length(comment) >= 20
    AND len({v.tokens_sql('comment')}) >= 12 AND NOT {any_sql('comment', rules.BOT_MARKERS)}""",
)
def b_comment_gate(t: Tables) -> DataFrame:
    c = F.col("comment")
    return v.revisions(t).filter((F.char_length(c) >= 20) & tx.comment_ok(c, 12)).select("rev_id")


@query(
    "b_filter_revision",
    v.with_("revisions")
    + r"""SELECT rev_id FROM (SELECT rev_id, trim(comment) AS c, len(string_split(text, chr(10))) AS n FROM revisions)
    WHERE NOT (n = 0 OR n > 12 OR NOT starts_with(c, '/*') OR ends_with(c, '*/')
      OR regexp_matches(c, '(?i)^[^\n]*(revert|undo|undid)'))""",
)
def b_filter_revision(t: Tables) -> DataFrame:
    lines = F.size(F.split("text", "\n"))
    return v.revisions(t).filter(~tx.revision_rejected(F.col("comment"), lines, 12)).select("rev_id")


@query(
    "b_clean_wiki",
    f"""SELECT page_id, {replace_sql('html', [('[[', ''), (']]', ''), ("''", '')] + rules.ENTITIES)} AS clean FROM
    (SELECT page_id, '[[link]] ' || html || ' ''''markup''''' AS html FROM pages)""",
)
def b_clean_wiki(t: Tables) -> DataFrame:
    wiki = F.concat(F.lit("[[link]] "), F.col("html"), F.lit(" ''markup''"))
    return t.pages.select("page_id", tx.clean_wiki_text(wiki).alias("clean"))


@query("b_markup", v.with_("comments") + f"SELECT id, {markup_sql('c')} AS comment FROM (SELECT id, '[[User:x]] ' || comment AS c FROM comments)")
def b_markup(t: Tables) -> DataFrame:
    c = F.concat(F.lit("[[User:x]] "), F.col("comment"))
    return v.comments(t).select("id", tx.modify_markup(c).alias("comment"))


@query("b_blacklist", v.with_("comments") + f"SELECT id FROM comments WHERE NOT {BLACKLIST_SQL}")
def b_blacklist(t: Tables) -> DataFrame:
    return v.comments(t).filter(~tx.comment_blacklisted(F.col("comment"))).select("id")


@query(
    "b_rewrite_comment",
    v.with_("comments") + f"SELECT id, {markup_sql(replace_sql('comment', rules.COMMENT_REWRITES))} AS comment FROM comments",
)
def b_rewrite_comment(t: Tables) -> DataFrame:
    return v.comments(t).select("id", tx.rewrite_comment(F.col("comment")).alias("comment"))


@query(
    "b_url_filter",
    v.with_("comments", "edit_pairs")
    + f"""SELECT pair_id, {markup_sql('src')} AS src, {markup_sql('tgt')} AS tgt FROM
    (SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN 'http://x.org ' ELSE '' END || src AS src, tgt || ' &amp; <ref>' AS tgt FROM edit_pairs)
    WHERE NOT (contains(src, 'http:') OR contains(src, 'https:') OR contains(tgt, 'http:') OR contains(tgt, 'https:'))""",
)
def b_url_filter(t: Tables) -> DataFrame:
    link = F.when(F.col("pair_id") % 5 == 0, "http://x.org ").otherwise("")
    pairs = v.edit_pairs(t).select(
        "pair_id",
        F.lit("plain comment here").alias("comment"),
        F.concat(link, F.col("src")).alias("src"),
        F.concat(F.col("tgt"), F.lit(" &amp; <ref>")).alias("tgt"),
    )
    return refine.refine_pairs(pairs, check_comment=False, check_length=False, check_bleu=False).drop("comment")


@query(
    "b_length_filter",
    v.with_("edit_pairs")
    + r"""SELECT pair_id FROM edit_pairs WHERE length(src) BETWEEN 2 AND 400 AND length(tgt) BETWEEN 2 AND 400
    AND len(list_filter(regexp_split_to_array(src, '\s+'), lambda x: x <> '')) >= 3
    AND abs(length(src) - length(tgt)) <= 60 AND length(src) - length(tgt) >= -20""",
)
def b_length_filter(t: Tables) -> DataFrame:
    keep = refine.length_ok(F.col("src"), F.col("tgt"), F.col("src"), max_diff=60, min_short=-20)
    return v.edit_pairs(t).filter(keep).select("pair_id")


PAIR_BLEU = {**pair_texts(v.tokens_sql), **bleu_sql("toks", "pairs")}


@query(
    "b_bleu_filter",
    v.with_("edit_pairs", **PAIR_BLEU)
    + "SELECT k AS pair_id FROM bleu WHERE bleu > 0.05 AND bleu < 0.95",
)
def b_bleu_filter(t: Tables) -> DataFrame:
    return v.edit_pairs(t).filter(refine.bleu_ok(F.col("src"), F.col("tgt"), 0.05, 0.95)).select("pair_id")


DIGITLESS = "regexp_replace({}, '[0-9]+', '', 'g')"


@query(
    "b_overlap",
    v.with_(
        "comments",
        rows="""SELECT c.id, c.comment, d.text AS src, row_number() OVER (ORDER BY d.text, c.id) AS i
          FROM comments c JOIN documents d ON c.id = d.doc_id""",
        ct=f"SELECT i AS id, {v.tokens_sql(DIGITLESS.format('comment'))} AS t FROM rows",
        st=f"SELECT i AS id, {v.tokens_sql(DIGITLESS.format('src'))} AS t FROM rows",
        near="""SELECT a.i * 10 + o.d + 3 AS k, a.i AS own, a.i AS h, b.i AS r FROM rows a
          CROSS JOIN (VALUES (-3), (-2), (-1), (1), (2)) AS o(d) JOIN rows b ON b.i = a.i + o.d""",
        **bleu_sql("ct", "near", "cb"),
        **bleu_sql("st", "near", "sb"),
        hits="SELECT DISTINCT own FROM near JOIN cb USING (k) JOIN sb USING (k) WHERE cb.bleu > 0.9 AND sb.bleu > 0.8",
    )
    + "SELECT id, i IN (SELECT own FROM hits) AS overlap FROM rows",
)
def b_overlap(t: Tables) -> DataFrame:
    """Near copies among neighbours in text order."""
    rows = v.comments(t).join(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("src")), "id")
    return refine.overlap_flags(rows, ["src", "id"]).select("id", "overlap")


@query(
    "b_meaningless",
    v.with_("edit_pairs")
    + """SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN true ELSE false END AS meaningless FROM edit_pairs""",
)
def b_meaningless(t: Tables) -> DataFrame:
    """Every third source gets spare digits, every third a spare word."""
    k = F.col("pair_id") % 3
    spoiled = F.when(k == 0, F.concat("src", F.lit(" 12.5"))).when(k == 1, F.concat("src", F.lit(" zz"))).otherwise(F.col("src"))
    pairs = v.edit_pairs(t).select("pair_id", spoiled.alias("src"), F.col("src").alias("tgt"))
    return refine.with_meaningless_flag(pairs).select("pair_id", "meaningless")


@query(
    "b_month",
    v.with_("edit_pairs") + "SELECT pair_id, pair_id % 2 = 0 AS month_edit FROM edit_pairs",
)
def b_month(t: Tables) -> DataFrame:
    """A month name replaced in every second pair, another word in the rest."""
    word = F.when(F.col("pair_id") % 2 == 0, "January").otherwise("qqq")
    pairs = v.edit_pairs(t).select(
        "pair_id", F.concat("src", F.lit(" "), word).alias("src"), F.concat("src", F.lit(" xyzzy")).alias("tgt")
    )
    return refine.with_month_flag(pairs).select("pair_id", "month_edit")


@query(
    "b_talk",
    v.with_("comments") + "SELECT id FROM comments WHERE NOT (contains(lower(comment), 'talk') OR contains(lower(comment), 'discuss'))",
)
def b_talk(t: Tables) -> DataFrame:
    return v.comments(t).filter(~tx.is_talk(F.col("comment"))).select("id")


@query("b_select_cluster", v.with_("clusters") + "SELECT count(*) AS total, count(*) FILTER (cluster = 3) AS selected FROM clusters")
def b_select_cluster(t: Tables) -> DataFrame:
    all_rows = v.clusters(t)
    picked = refine.select_cluster(all_rows, 3).agg(F.count("*")).scalar()
    return all_rows.agg(F.count("*").alias("total")).select("total", picked.alias("selected"))


@query(
    "b_reject_report",
    v.with_("comments")
    + f"""SELECT CASE WHEN {BLACKLIST_SQL} THEN 'blacklist' WHEN contains(lower(comment), 'talk') OR contains(lower(comment), 'discuss') THEN 'talk'
    WHEN length(comment) > 3000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM comments GROUP BY 1""",
)
def b_reject_report(t: Tables) -> DataFrame:
    c = F.col("comment")
    return refine.reject_report(
        v.comments(t),
        {"blacklist": ~tx.comment_blacklisted(c), "talk": ~tx.is_talk(c), "long": F.char_length(c) <= 3000},
    )


@query("b_bernoulli")
def b_bernoulli(t: Tables) -> DataFrame:
    return v.revisions(t).filter(pairing.sampled(F.col("rev_id"), 0.5, seed=3)).select("rev_id")


@query(
    "b_bernoulli_all",
    v.with_("revisions") + "SELECT rev_id FROM revisions",
)
def b_bernoulli_all(t: Tables) -> DataFrame:
    return v.revisions(t).filter(pairing.sampled(F.col("rev_id"), 1.0)).select("rev_id")


@query(
    "b_unchanged_filter",
    v.with_("sents") + "SELECT doc_id FROM sents WHERE len(sents) - len(list_filter(sents, lambda s: contains(s, ' the '))) >= 10",
)
def b_unchanged_filter(t: Tables) -> DataFrame:
    """Sentences with a marker word stand for the changed ones."""

    def enough(s: Column) -> Column:
        changed = F.filter(s, lambda x: F.contains(x, F.lit(" the ")))
        return refine.unchanged_enough(F.size(s), F.size(changed), 10)

    return t.documents.filter(bind(tx.split_sentences(F.col("text")), enough)).select("doc_id")


@query("b_shuffle")
def b_shuffle(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(refine.hash_order(F.col("doc_id"), 5), "doc_id")


@query("b_sample_n", "SELECT count(*) AS n, true AS all_known FROM (SELECT doc_id FROM documents LIMIT 100)")
def b_sample_n(t: Tables) -> DataFrame:
    picked = refine.sample_rows(t.documents.select("doc_id"), "doc_id", 100, seed=5)
    known = picked.join(t.documents.select("doc_id", F.lit(1).alias("k")), "doc_id", "left")
    return known.agg(F.count("*").alias("n"), F.every(F.col("k").isNotNull()).alias("all_known"))


@query("b_count", "SELECT count(*) AS n FROM documents")
def b_count(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("n"))


@query(
    "b_diff_url",
    v.with_("revisions")
    + """SELECT rev_id, 'https://en.wikipedia.org/w/index.php?title=' || replace(page_title, ' ', '%20') || '&type=revision&diff='
    || CAST(rev_id AS VARCHAR) || '&oldid=' || CAST(parent_id AS VARCHAR) AS diff_url FROM revisions WHERE parent_id IS NOT NULL""",
)
def b_diff_url(t: Tables) -> DataFrame:
    return pairing.with_diff_url(v.revisions(t).filter("parent_id IS NOT NULL")).select("rev_id", "diff_url")


@query("b_cluster_input", v.with_("comments") + "SELECT id, comment AS text FROM comments")
def b_cluster_input(t: Tables) -> DataFrame:
    return refine.cluster_input(v.comments(t).withColumnRenamed("id", "revision_id"))


BRACKETED = """CASE doc_id % 3 WHEN 0 THEN 'a -LRB- b -RRB- ' WHEN 1 THEN 'a -LRB- ' ELSE '' END || text"""


@query(
    "b_brackets",
    f"""SELECT doc_id, CASE WHEN contains(line, '-LRB-') AND contains(line, '-RRB-')
      THEN regexp_replace(line, '-.*?LRB.*?-.*?-.*?RRB.*?-', '', 'g')
      WHEN contains(line, '-LRB-') OR contains(line, '-RRB-') THEN replace(replace(line, '-LRB-', '"'), '-RRB-', '"')
      ELSE line END AS line FROM (SELECT doc_id, {BRACKETED} AS line FROM documents)""",
)
def b_brackets(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    line = F.concat(F.when(k == 0, "a -LRB- b -RRB- ").when(k == 1, "a -LRB- ").otherwise(""), F.col("text"))
    return t.documents.select("doc_id", tx.strip_brackets(line).alias("line"))


@query(
    "b_sent_ok",
    """SELECT doc_id FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN 'SEPL|||SEPR' WHEN 1 THEN 'SEPL__SEPR' ELSE '' END AS s
    FROM documents) WHERE NOT (contains(s, 'SEPL|||SEPR') OR contains(s, 'SEPL__SEPR'))""",
)
def b_sent_ok(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    s = F.concat("text", F.when(k == 0, rules.LABEL_SEP).when(k == 1, rules.OP_SEP).otherwise(""))
    return t.documents.filter(tx.sentence_ok(s)).select("doc_id")


@query(
    "b_normalize",
    f"""SELECT doc_id, lower({replace_sql("array_to_string(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]), ' ')", rules.TOKEN_REWRITES)}) AS line
    FROM (SELECT doc_id, string_split('It''ve it''ve -- `a` ' || text, ' ') AS t FROM documents)""",
)
def b_normalize(t: Tables) -> DataFrame:
    line = F.concat(F.lit("It've it've -- `a` "), F.col("text"))
    return t.documents.select("doc_id", tx.normalize_line(line).alias("line"))


@query(
    "b_split",
    "SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys, true AS disjoint, true AS both_used FROM documents",
)
def b_split(t: Tables) -> DataFrame:
    """Each row in exactly one split, both splits in use."""
    parts = refine.split_train_valid(t.documents.select("doc_id"), F.col("doc_id"), seed=1)
    per_key = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("split").alias("split"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("keys"),
        F.every(F.col("n") == 1).alias("disjoint"),
        (F.count_if(F.col("split") == "valid").between(1, F.count("*") * 0.25)).alias("both_used"),
    )


@query(
    "b_has_generation",
    v.with_(
        "predictions",
        tagged="""SELECT user_id, list(CASE gold WHEN 'purchase' THEN '$REPLACE_x' WHEN 'error' THEN '$APPEND_y' ELSE '$KEEP' END) AS ops
          FROM predictions GROUP BY user_id, event_id // 4""",
    )
    + "SELECT user_id, count(*) AS n FROM tagged WHERE len(list_filter(ops, lambda o: starts_with(o, '$REPLACE') OR starts_with(o, '$APPEND'))) > 0 GROUP BY 1",
)
def b_has_generation(t: Tables) -> DataFrame:
    from ..operators.records import has_generation_op

    kind = F.col("gold")
    op = F.when(kind == "purchase", "$REPLACE_x").when(kind == "error", "$APPEND_y").otherwise("$KEEP")
    tagged = (
        v.predictions(t)
        .groupBy("user_id", F.floor(F.col("event_id") / 4).alias("part"))
        .agg(F.collect_list(F.array(op)).alias("ops"))
    )
    return tagged.filter(has_generation_op(F.col("ops"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "d_bleu",
    v.with_("edit_pairs", **PAIR_BLEU) + "SELECT k AS pair_id, round(bleu, 6) AS bleu FROM bleu",
)
def d_bleu(t: Tables) -> DataFrame:
    score = bleu(tx.tokenize(F.col("tgt")), tx.tokenize(F.col("src")))
    return v.edit_pairs(t).select("pair_id", F.round(score, 6).alias("bleu"))
