"""Edit-corpus inputs derived from the given tables, as DataFrames and as SQL.

``CTE`` holds the same derivations for the SQL checks; ``with_(...)`` puts the
named ones (and what they need) in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators.ordering import previous_in_group
from .catalog import Tables

ROOM = 1000  # turns per conversation in a revision id; from there on ids repeat on other pages
PAGE = ["page_id"]  # hence a revision's key is its page and its id

CTE = {
    "revisions": f"""SELECT conv_id AS page_id, 'Page ' || CAST(conv_id AS VARCHAR) AS page_title,
    conv_id * {ROOM} + turn AS rev_id,
    CASE WHEN turn = 0 THEN NULL ELSE conv_id * {ROOM} + turn - 1 END AS parent_id,
    turn AS rev_ord, role AS user_name,
    '/* Part (' || CAST(conv_id AS VARCHAR) || ') */ ' || CASE WHEN turn % 4 < 3 THEN 'POV fix ' ELSE 'Undid revision ' END
      || replace(text, chr(10), ' ') AS comment,
    'intro' || chr(10) || '== Part (' || CAST(conv_id AS VARCHAR) || ') ==' || chr(10) || text || chr(10) || '== End ==' || chr(10) || 'tail' AS text
  FROM conversations""",
    "kept": """SELECT page_id, page_title, rev_id, parent_id, rev_ord, user_name, 'Part (' || CAST(page_id AS VARCHAR) || ')' AS title,
    trim(regexp_extract(comment, '^/\\*(.+)\\*/(.*)', 2)) AS comment, text
  FROM revisions WHERE contains(regexp_extract(comment, '^/\\*(.+)\\*/(.*)', 2), 'POV')""",
    "once": """SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text""",
    "versions": """SELECT doc_id, lang, split_part(text, chr(10), 1) AS title, text AS tgt,
    lag(text) OVER (PARTITION BY split_part(text, chr(10), 1) ORDER BY doc_id) AS src
  FROM once""",
    "edit_pairs": """SELECT doc_id * 1000000 + i AS pair_id, doc_id, lang, s[i] AS src, t[i] AS tgt FROM (
    SELECT doc_id, lang, string_split(src, chr(10)) AS s, string_split(tgt, chr(10)) AS t,
      generate_subscripts(string_split(tgt, chr(10)), 1) AS i
    FROM versions WHERE src IS NOT NULL)
  WHERE s[i] <> '' AND t[i] <> ''""",
    "comments": """SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN '[[WP:NPOV]] ' WHEN 1 THEN 'see http://x.org/a.jpg '
      WHEN 2 THEN '&quot;a&quot; &lt;b&gt; <ref>c</ref> ' WHEN 3 THEN 'Talk: [[WP:AWB|AWB]] '
      WHEN 4 THEN 'revert NPoV ' ELSE '' END || replace(text, chr(10), ' ') AS comment
  FROM documents""",
    "clusters": "SELECT vec_id AS id, label AS cluster FROM embeddings",
    "manifest": "SELECT 'f' || CAST(doc_id AS VARCHAR) AS name, md5(text) AS md5 FROM documents",
    "listing": """SELECT 'f' || CAST(doc_id AS VARCHAR) AS name,
    md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS md5
  FROM documents WHERE doc_id % 7 <> 0""",
    "predictions": """SELECT event_id, user_id, event_type AS gold,
    CASE WHEN event_id % 5 = 0 THEN 'click' ELSE event_type END AS pred,
    event_id % 13 = 0 AS ignored, value AS loss
  FROM events""",
    "sents": r"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？]+|[^.!?。！？\n]+'),
      lambda s: trim(s, E' \t\n\r\f\x0b')), lambda s: s <> '') AS sents FROM documents""",
    "sent_tokens": r"""SELECT doc_id, list_transform(sents,
      lambda s: regexp_extract_all(s, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS sents FROM sents""",
}
NEEDS = {
    "kept": ["revisions"],
    "versions": ["once"],
    "edit_pairs": ["versions"],
    "sent_tokens": ["sents"],
}


def with_(*names: str, **extra: str) -> str:
    """``WITH`` clause of the named derivations, their needs first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTE[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


# ---- the same as DataFrames ----------------------------------------------------


def revisions(t: Tables) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    title = F.concat(F.lit("Part ("), F.col("conv_id").cast("string"), F.lit(")"))
    rev = F.col("conv_id") * ROOM + turn
    return t.conversations.select(
        F.col("conv_id").alias("page_id"),
        F.concat(F.lit("Page "), F.col("conv_id").cast("string")).alias("page_title"),
        rev.alias("rev_id"),
        F.when(turn != 0, rev - 1).alias("parent_id"),
        turn.alias("rev_ord"),
        role.alias("user_name"),
        F.concat(
            F.lit("/* "),
            title,
            F.lit(" */ "),
            F.when(turn % 4 < 3, "POV fix ").otherwise("Undid revision "),
            F.replace("text", F.lit("\n"), F.lit(" ")),
        ).alias("comment"),
        F.concat(
            F.lit("intro\n== "), title, F.lit(" ==\n"), F.col("text"), F.lit("\n== End ==\ntail")
        ).alias("text"),
    )


def versions(t: Tables) -> DataFrame:
    """``doc_id, lang, src, tgt``: documents that open with the same line are
    versions of one page; each is paired with the version before it.

    Only ids and the title's hash are ordered; the texts are fetched by id.
    """
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    # copies collapse to the first document, by digest so that no text moves
    heads = (
        t.documents.select("doc_id", F.sha2("text", 256).alias("_digest"), F.sha2(title, 256).alias("title"))
        .groupBy("_digest", "title")
        .agg(F.min("doc_id").alias("doc_id"))
        .select("doc_id", "title")
    )
    linked = previous_in_group(heads, ["title"], ["doc_id"], ["doc_id"]).filter(
        F.col("prev_doc_id").isNotNull()
    )
    return (
        linked.select("doc_id", F.col("prev_doc_id").alias("_p"))
        .join(t.documents.select("doc_id", "lang", F.col("text").alias("tgt")), "doc_id")
        .join(t.documents.select(F.col("doc_id").alias("_p"), F.col("text").alias("src")), "_p")
        .select("doc_id", "lang", "src", "tgt")
    )


def edit_pairs(t: Tables) -> DataFrame:
    """Line ``i`` of a document's previous version against line ``i`` of its own."""
    lines = F.arrays_zip(F.split("src", "\n").alias("s"), F.split("tgt", "\n").alias("t"))
    return (
        versions(t)
        .select("doc_id", "lang", F.posexplode(lines).alias("i", "z"))
        .filter((F.col("z.s") != "") & (F.col("z.t") != ""))
        .select(
            (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("pair_id"),
            "doc_id",
            "lang",
            F.col("z.s").alias("src"),
            F.col("z.t").alias("tgt"),
        )
    )


def comments(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 7
    noise = (
        F.when(k == 0, "[[WP:NPOV]] ")
        .when(k == 1, "see http://x.org/a.jpg ")
        .when(k == 2, "&quot;a&quot; &lt;b&gt; <ref>c</ref> ")
        .when(k == 3, "Talk: [[WP:AWB|AWB]] ")
        .when(k == 4, "revert NPoV ")
        .otherwise("")
    )
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.concat(noise, F.replace("text", F.lit("\n"), F.lit(" "))).alias("comment"),
    )


def clusters(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def manifest(t: Tables) -> DataFrame:
    return t.documents.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.md5("text").alias("md5")
    )


def listing(t: Tables) -> DataFrame:
    spoiled = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return t.documents.filter(F.col("doc_id") % 7 != 0).select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.md5(spoiled).alias("md5")
    )


def predictions(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("gold"),
        F.when(F.col("event_id") % 5 == 0, "click").otherwise(F.col("event_type")).alias("pred"),
        (F.col("event_id") % 13 == 0).alias("ignored"),
        F.col("value").alias("loss"),
    )


def sentence_tokens(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        F.transform(tx.split_sentences(F.col("text")), lambda s: tx.tokenize(s)).alias("sents"),
    )
