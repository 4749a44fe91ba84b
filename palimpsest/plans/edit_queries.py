"""Edit annotation and training / inference records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, sequence, tags, text as tx
from ..functions.collections import bind, present
from ..operators import annotate as an, lookups, records as rec
from . import views as v
from .catalog import Tables, query

WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents"


def up(expr: str) -> str:
    """Upper case with the full mapping of the sharp s, as Spark has it."""
    return f"upper(replace({expr}, 'ß', 'SS'))"


CAP = up("left({0}, 1)") + " || lower(substr({0}, 2))"
VARIANTS = f"""pairs AS (SELECT w AS s, unnest([w, lower(w), {up('w')}, {CAP.format('w')}, left(w, 1) || {CAP.format('substr(w, 2)')},
    {up('left(w, length(w) - 1)')} || right(w, 1), w || 's', left(w, length(w) - 1)]) AS t FROM (SELECT * FROM words WHERE length(w) > 0))"""
CASE_SQL = f"""CASE WHEN lower(s) <> lower(t) THEN NULL WHEN lower(s) = t THEN '$TRANSFORM_CASE_LOWER' WHEN {CAP.format('s')} = t THEN '$TRANSFORM_CASE_CAPITAL'
    WHEN {up('s')} = t THEN '$TRANSFORM_CASE_UPPER'
    WHEN left(s, 1) = left(t, 1) AND {CAP.format('substr(s, 2)')} = substr(t, 2) THEN '$TRANSFORM_CASE_CAPITAL_1'
    WHEN right(s, 1) = right(t, 1) AND {up('left(s, length(s) - 1)')} = left(t, length(t) - 1) THEN '$TRANSFORM_CASE_UPPER_-1' END"""
PLURAL_SQL = "CASE WHEN s = t || 's' THEN '$TRANSFORM_AGREEMENT_SINGULAR' WHEN t = s || 's' THEN '$TRANSFORM_AGREEMENT_PLURAL' END"


def _words(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.split("text", " ")).alias("w")).distinct()


def _variants(t: Tables) -> DataFrame:
    w = F.col("w")
    butlast = F.left(w, F.length(w) - 1)
    tail = F.substring(w, 2, 1 << 30)
    forms = F.array(
        w,
        F.lower(w),
        F.upper(w),
        tags.capitalize(w),
        F.concat(F.left(w, F.lit(1)), tags.capitalize(tail)),
        F.concat(F.upper(butlast), F.right(w, F.lit(1))),
        F.concat(w, F.lit("s")),
        butlast,
    )
    return _words(t).filter(F.char_length(w) > 0).select(w.alias("s"), F.explode(forms).alias("t"))


@query("k_case_tag", f"WITH words AS ({WORDS}), {VARIANTS} SELECT s, t, {CASE_SQL} AS tag FROM pairs")
def k_case_tag(t: Tables) -> DataFrame:
    return _variants(t).select("s", "t", tags.case_tag(F.col("s"), F.col("t")).alias("tag"))


@query(
    "k_simple_tags",
    f"""WITH words AS ({WORDS}), {VARIANTS} SELECT s, t, CASE WHEN s = t THEN '$KEEP' END AS same, {PLURAL_SQL} AS number,
    CASE WHEN len(string_split(s || '-' || t, '-')) > 1 AND string_split(s || '-' || t, '-') = [s, t] THEN '$TRANSFORM_SPLIT_HYPHEN' END AS split FROM pairs""",
)
def k_simple_tags(t: Tables) -> DataFrame:
    s, x = F.col("s"), F.col("t")
    return _variants(t).select(
        "s",
        "t",
        tags.equal_tag(s, x).alias("same"),
        tags.plural_tag(s, x).alias("number"),
        tags.split_tag(F.concat(s, F.lit("-"), x), F.array(s, x)).alias("split"),
    )


@query(
    "k_verb_tag",
    f"""WITH words AS ({WORDS}), {VARIANTS} SELECT s, t, CASE WHEN length(s) = 4 AND t = s || 's' THEN '$TRANSFORM_VERB-' || t END AS tag FROM pairs""",
)
def k_verb_tag(t: Tables) -> DataFrame:
    """Lexicon: four-letter words and their -s form."""
    lexicon = (
        _words(t)
        .filter(F.char_length("w") == 4)
        .select(
            F.col("w").alias("w1"),
            F.concat("w", F.lit("s")).alias("w2"),
            F.lit("VB").alias("t1"),
            F.lit("VBZ").alias("t2"),
            F.lit(1).alias("row_no"),
        )
    )
    pairs = _variants(t).select(F.col("s").alias("src"), F.col("t").alias("tgt"))
    return lookups.verb_lookup(pairs, lexicon).select(
        F.col("src").alias("s"), F.col("tgt").alias("t"), F.col("verb_tag").alias("tag")
    )


@query(
    "k_transform_tag",
    f"WITH words AS ({WORDS}), {VARIANTS} SELECT s, t, coalesce(CASE WHEN s = t THEN '$KEEP' END, {CASE_SQL}, {PLURAL_SQL}) AS tag FROM pairs",
)
def k_transform_tag(t: Tables) -> DataFrame:
    return _variants(t).select("s", "t", tags.word_tag(F.col("s"), F.col("t")).alias("tag"))


@query(
    "k_merge_tag",
    f"""WITH words AS ({WORDS}), {VARIANTS} SELECT s, t, CASE WHEN s <> t THEN '$MERGE_HYPHEN' ELSE NULL END AS tag FROM pairs""",
)
def k_merge_tag(t: Tables) -> DataFrame:
    """Unequal words are offered their hyphenation, equal ones a wrong one."""
    s, x = F.col("s"), F.col("t")
    target = F.when(s != x, F.concat(s, F.lit("-"), x)).otherwise(F.concat(s, F.lit("_"), x))
    return _variants(t).select("s", "t", tags.merge_tag(F.array(s, x), F.array(target)).alias("tag"))


def _replaced_spans(t: Tables) -> DataFrame:
    """``s, t``: the distinct replaced spans of all edit pairs."""
    diffed = (
        v.edit_pairs(t)
        .filter("src <> tgt")
        .select(tx.tokenize(F.col("src")).alias("a"), tx.tokenize(F.col("tgt")).alias("b"))
        .withColumn("ops", sequence.diff_ops("a", "b"))
    )
    return (
        diffed.select("a", "b", F.explode("ops").alias("o"))
        .filter("o.tag = 'replace'")
        .select(
            F.slice("a", F.col("o.i1") + 1, F.col("o.i2") - F.col("o.i1")).alias("s"),
            F.slice("b", F.col("o.j1") + 1, F.col("o.j2") - F.col("o.j1")).alias("t"),
        )
        .distinct()
        .repartition(t.tasks * 4)
    )


@query("k_align_insertions")
def k_align_insertions(t: Tables) -> DataFrame:
    """Every distinct replaced span aligned with up to one inserted group between
    two tokens: ``cost``, what the same span costs without (``plain_cost``), and
    the words that no token takes."""
    found = (
        _replaced_spans(t)
        .withColumn("p", sequence.span_cost()("s", "t"))
        .withColumn("r", sequence.span_steps(1)("s", "t"))
    )
    put_in = F.filter("r.steps", lambda x: x["token"].isNull() & (x["j2"] > x["j1"]))
    words = F.flatten(F.transform(put_in, lambda x: F.slice(F.col("t"), x["j1"] + 1, x["j2"] - x["j1"])))
    return found.select(
        F.array_join("s", " ").alias("src_span"),
        F.array_join("t", " ").alias("tgt_span"),
        F.col("r.cost").alias("cost"),
        F.col("p.cost").alias("plain_cost"),
        F.array_join(words, " ").alias("inserted"),
    )


@query("k_align_cost", "SELECT true AS bordered, true AS bounded, true AS zero_is_free")
def k_align_cost(t: Tables) -> DataFrame:
    """Over all distinct replaced spans: borders cut the whole target span, the
    cost is at most that of giving the last token everything, and at cost 0
    every group is a transform."""
    spans = _replaced_spans(t).withColumn("r", sequence.span_cost()("s", "t"))
    s, x = F.col("s"), F.col("t")
    borders = F.col("r.borders")
    n = F.size(s)
    joined = F.array_join(x, sequence.GAP)
    others = F.aggregate(F.slice(s, F.lit(1), n - 1), F.lit(0), lambda acc, w: acc + F.length(w))
    fixed = others + F.levenshtein(F.element_at(s, -1), joined)
    words = F.zip_with(s, F.slice(x, F.lit(1), n), lambda a, b: tags.word_tag(a, b).isNotNull())
    return spans.agg(
        F.every(
            (F.size(borders) == n + 1) & (F.get(borders, F.lit(0)) == 0) & (F.element_at(borders, -1) == F.size(x))
            & (F.array_sort(borders) == borders)
        ).alias("bordered"),
        F.every(F.col("r.cost") <= fixed).alias("bounded"),
        F.every((F.col("r.cost") > 0) | (n != F.size(x)) | F.forall(words, lambda w: F.coalesce(w, F.lit(False)))).alias(
            "zero_is_free"
        ),
    )


@query(
    "k_annotate",
    v.with_("edit_pairs")
    + f"SELECT pair_id, md5(array_to_string({v.tokens_sql('tgt')}, ' ')) AS result, CAST(len({v.tokens_sql('src')}) + 1 AS INTEGER) AS n_labels FROM edit_pairs",
)
def k_annotate(t: Tables) -> DataFrame:
    """Applying the annotation to the source gives the target."""
    done = an.annotate(v.edit_pairs(t), parallelism=t.tasks * 4)
    applied = tags.apply_edits(F.col("src_tokens"), F.col("labels"))
    return done.select(
        "pair_id", F.md5(F.array_join(applied, " ")).alias("result"), F.size("labels").alias("n_labels")
    )


@query(
    "k_annotate_verbs",
    f"""WITH words AS ({WORDS}), v AS (SELECT w FROM words WHERE regexp_full_match(w, '[a-z]{{4}}'))
    SELECT w, unnest(['ed', 't']) AS form, unnest(['$TRANSFORM_VERB-' || w || 'ed,$REPLACE_qq', '$REPLACE_' || w || 't,$REPLACE_qq']) AS ops FROM v""",
)
def k_annotate_verbs(t: Tables) -> DataFrame:
    """Verb tags from a lexicon of all four-letter words, where the first row of a key wins."""
    w = F.col("w")
    verbs = _words(t).filter(w.rlike(r"\A[a-z]{4}\z"))
    forms = F.explode(F.arrays_zip(F.array(F.lit("ed"), F.lit("t")).alias("form"), F.array(F.lit(1), F.lit(2)).alias("row_no")))
    spelt = verbs.select("w", forms.alias("f")).select("w", "f.form", "f.row_no", F.concat("w", "f.form").alias("w2"))
    lexicon = spelt.select(w.alias("w1"), "w2", F.lit("VB").alias("t1"), F.lit("VBD").alias("t2"), "row_no")
    pairs = spelt.select("w", "form", F.concat("w", F.lit(" zz")).alias("src"), F.concat("w2", F.lit(" qq")).alias("tgt"))
    return an.annotate(pairs, lexicon=lexicon).select("w", "form", F.array_join("edits.op", ",").alias("ops"))


# ---- tokens with ops chosen by word length -------------------------------------

SPLIT_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
TOK_SQL = f"""tok AS (SELECT doc_id, unnest({SPLIT_SQL}) AS w, generate_subscripts({SPLIT_SQL}, 1) - 1 AS pos FROM documents),
  n AS (SELECT doc_id, w, pos, length(w) % 9 AS k FROM tok)"""


def _tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.words(F.col("text")).alias("tokens"))


def _kind(w: Column) -> Column:
    return F.char_length(w) % 9


def _ops(w: Column) -> Column:
    """Op list of a word, by its length."""
    by_kind = [
        [rules.DELETE],
        ["$REPLACE_new_word"],
        [rules.KEEP],
        ["$APPEND_more"],
        [rules.DELETE],
        [rules.PLURAL, "$APPEND_x", "$APPEND_y"],
        [rules.DELETE, "$APPEND_tail"],
        ["$TRANSFORM_VERB-done"],
        [rules.MERGE_HYPHEN],
    ]
    return F.get(F.array(*[F.array(*[F.lit(n) for n in names]) for names in by_kind]), _kind(w))


OPS_SQL = """CASE k WHEN 0 THEN ['$DELETE'] WHEN 1 THEN ['$REPLACE_new_word'] WHEN 2 THEN ['$KEEP'] WHEN 3 THEN ['$APPEND_more'] WHEN 4 THEN ['$DELETE']
    WHEN 5 THEN ['$TRANSFORM_AGREEMENT_PLURAL', '$APPEND_x', '$APPEND_y'] WHEN 6 THEN ['$DELETE', '$APPEND_tail'] WHEN 7 THEN ['$TRANSFORM_VERB-done']
    ELSE ['$MERGE_HYPHEN'] END"""


@query(
    "k_edits_to_labels",
    f"""WITH {TOK_SQL}, p AS (SELECT doc_id, pos, {OPS_SQL} AS ops FROM n)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(ops, '|') AS ops FROM p UNION ALL SELECT DISTINCT doc_id, -1, '$KEEP' FROM n""",
)
def k_edits_to_labels(t: Tables) -> DataFrame:
    """Labels from the long edit table; KEEP fills the rest."""
    docs = _tokens(t)
    ops = docs.select("doc_id", F.posexplode("tokens").alias("pos", "w")).select(
        "doc_id", "pos", F.posexplode(_ops(F.col("w"))).alias("seq", "op")
    )
    lengths = docs.select("doc_id", F.size("tokens").alias("n_tokens")).filter("n_tokens > 0")
    out = an.labels_from_table(ops.filter(F.col("op") != rules.KEEP), lengths, "doc_id")
    return out.select("doc_id", "pos", F.array_join("ops", "|").alias("ops"))


@query(
    "k_apply_edits",
    f"""WITH {TOK_SQL}, f AS (SELECT doc_id, pos, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'new_word' WHEN 2 THEN w WHEN 3 THEN w || ' more' WHEN 4 THEN NULL
      WHEN 5 THEN w || 's x y' WHEN 6 THEN 'tail' WHEN 7 THEN 'done' ELSE w || ' $MERGE_HYPHEN' END AS frag FROM n)
    SELECT doc_id, 'first ' || coalesce(replace(string_agg(frag, ' ' ORDER BY pos), ' $MERGE_HYPHEN ', '-'), '') AS result FROM f GROUP BY 1""",
)
def k_apply_edits(t: Tables) -> DataFrame:
    labels = F.concat(F.array(F.array(F.lit("$APPEND_first"))), F.transform("tokens", _ops))
    result = F.array_join(tags.apply_edits(F.col("tokens"), labels), " ")
    rows = _tokens(t).filter(F.size("tokens") > 0).select("doc_id", result.alias("result"))
    return rows.withColumn("result", F.when(F.col("result") == "first", "first ").otherwise(F.col("result")))


LINE_SQL = f"""WITH {TOK_SQL}, l AS (SELECT doc_id, '$STARTSEPL|||SEPR$KEEP ' || string_agg(w || 'SEPL|||SEPR' || array_to_string({OPS_SQL}, 'SEPL__SEPR'), ' ' ORDER BY pos) AS line,
    '$START ' || string_agg(w, ' ' ORDER BY pos) AS tokens, '$KEEP ' || string_agg(array_to_string({OPS_SQL}, '+'), ' ' ORDER BY pos) AS ops,
    '$KEEP ' || string_agg(CASE k WHEN 1 THEN '$REPLACE' WHEN 3 THEN '$APPEND' ELSE ({OPS_SQL})[1] END, ' ' ORDER BY pos) AS one FROM n GROUP BY 1) """


def _lines(t: Tables) -> DataFrame:
    labels = F.concat(F.array(F.array(F.lit(rules.KEEP))), F.transform("tokens", _ops))
    return _tokens(t).filter(F.size("tokens") > 0).select(
        "doc_id", tags.to_tagged_line(F.col("tokens"), labels).alias("line")
    )


@query("k_tagged_line", LINE_SQL + "SELECT doc_id, md5(line) AS line, md5(tokens) AS tokens, md5(ops) AS ops FROM l")
def k_tagged_line(t: Tables) -> DataFrame:
    parsed = _lines(t).withColumn("p", tags.parse_tagged_line(F.col("line")))
    return parsed.select(
        "doc_id",
        F.md5("line").alias("line"),
        F.md5(F.array_join("p.tokens", " ")).alias("tokens"),
        F.md5(F.array_join(F.transform("p.ops", lambda o: F.array_join(o, "+")), " ")).alias("ops"),
    )


@query(
    "k_reverse_transform",
    f"""WITH words AS ({WORDS}), p AS (SELECT w, unnest(['$TRANSFORM_CASE_LOWER', '$TRANSFORM_CASE_UPPER', '$TRANSFORM_CASE_CAPITAL', '$TRANSFORM_CASE_CAPITAL_1',
      '$TRANSFORM_CASE_UPPER_-1', '$TRANSFORM_VERB-done', '$TRANSFORM_SPLIT_HYPHEN', '$TRANSFORM_AGREEMENT_PLURAL', '$TRANSFORM_AGREEMENT_SINGULAR', '$KEEP']) AS tag FROM words WHERE length(w) > 0)
    SELECT w, tag, CASE tag WHEN '$TRANSFORM_CASE_LOWER' THEN lower(w) WHEN '$TRANSFORM_CASE_UPPER' THEN {up('w')} WHEN '$TRANSFORM_CASE_CAPITAL' THEN {CAP.format('w')}
      WHEN '$TRANSFORM_CASE_CAPITAL_1' THEN left(w, 1) || {CAP.format('substr(w, 2)')} WHEN '$TRANSFORM_CASE_UPPER_-1' THEN {up('left(w, length(w) - 1)')} || right(w, 1)
      WHEN '$TRANSFORM_VERB-done' THEN 'done' WHEN '$TRANSFORM_SPLIT_HYPHEN' THEN replace(w || '-end', '-', '|') WHEN '$TRANSFORM_AGREEMENT_PLURAL' THEN w || 's'
      WHEN '$TRANSFORM_AGREEMENT_SINGULAR' THEN left(w, length(w) - 1) ELSE w END AS result FROM p""",
)
def k_reverse_transform(t: Tables) -> DataFrame:
    all_tags = [
        rules.CASE_LOWER, rules.CASE_UPPER, rules.CASE_CAPITAL, rules.CASE_CAPITAL_1, rules.CASE_UPPER_1,
        "$TRANSFORM_VERB-done", rules.SPLIT_HYPHEN, rules.PLURAL, rules.SINGULAR, rules.KEEP,
    ]
    pairs = _words(t).filter(F.char_length("w") > 0).select(
        "w", F.explode(F.array(*[F.lit(x) for x in all_tags])).alias("tag")
    )
    token = F.when(F.col("tag") == rules.SPLIT_HYPHEN, F.concat("w", F.lit("-end"))).otherwise(F.col("w"))
    return pairs.select("w", "tag", F.array_join(tags.apply_tag(token, F.col("tag")), "|").alias("result"))


@query(
    "k_realise_merges",
    f"""WITH {TOK_SQL}, m AS (SELECT doc_id, string_agg(w || CASE k WHEN 3 THEN ' $MERGE_HYPHEN' WHEN 4 THEN ' $MERGE_SPACE' ELSE '' END, ' ' ORDER BY pos) AS line FROM n GROUP BY 1)
    SELECT doc_id, md5(replace(replace(line, ' $MERGE_HYPHEN ', '-'), ' $MERGE_SPACE ', '')) AS digest FROM m""",
)
def k_realise_merges(t: Tables) -> DataFrame:
    def marked(w):
        k = _kind(w)
        return F.when(k == 3, F.array(w, F.lit(rules.MERGE_HYPHEN))).when(k == 4, F.array(w, F.lit(rules.MERGE_SPACE))).otherwise(F.array(w))

    tokens = F.flatten(F.transform("tokens", marked))
    return _tokens(t).filter(F.size("tokens") > 0).select(
        "doc_id", F.md5(F.array_join(tags.realise_merges(tokens), " ")).alias("digest")
    )


# ---- records -------------------------------------------------------------------


@query("i_tagging_records", LINE_SQL + "SELECT doc_id, md5(tokens) AS tokens, md5(one) AS action_tags FROM l")
def i_tagging_records(t: Tables) -> DataFrame:
    r = _lines(t).select("doc_id", rec.tagging_record(F.col("line")).alias("r"))
    return r.select(
        "doc_id",
        F.md5(F.array_join("r.tokens", " ")).alias("tokens"),
        F.md5(F.array_join("r.action_tags", " ")).alias("action_tags"),
    )


def _items(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["token"], F.lit("/"), x["mask"].cast("string"))), " ")


# merged runs: marked tokens plus the one after them share a group
GROUPS_SQL = """g0 AS (SELECT *, lag(k) OVER w AS pk, lead(k) OVER w AS nk, lag(k, 2) OVER w AS ppk, CASE WHEN lag(k) OVER w = 8 THEN 0 ELSE 1 END AS starts,
    lead(pos) OVER w IS NULL AS is_last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  g1 AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM g0),
  g2 AS (SELECT *, string_agg(w, '-') OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g1)"""


@query(
    "i_generation_records",
    f"""WITH {TOK_SQL}, {GROUPS_SQL}, f AS (SELECT doc_id, pos, CASE
      WHEN k = 8 AND NOT is_last THEN NULL
      WHEN k = 8 OR pk = 8 THEN run || '/0' || CASE k WHEN 3 THEN ' more/1' WHEN 5 THEN ' x/1 y/1' WHEN 6 THEN ' tail/1' ELSE '' END
      WHEN k IN (0, 4) THEN CASE WHEN pk IN (0, 4) AND coalesce(ppk, 0) <> 8 THEN '' ELSE '[DELETE]/0 ' END || w || '/0' || CASE WHEN nk IN (0, 4, 6) THEN '' ELSE ' [/DELETE]/0' END
      WHEN k = 6 THEN CASE WHEN pk IN (0, 4) AND coalesce(ppk, 0) <> 8 THEN '' ELSE '[DELETE]/0 ' END || w || '/0 [/DELETE]/0 tail/1'
      WHEN k = 1 THEN '[DELETE]/0 ' || w || '/0 [/DELETE]/0 new_word/1'
      WHEN k = 3 THEN w || '/0 more/1' WHEN k = 5 THEN w || 's/0 x/1 y/1'
      WHEN k = 7 THEN '[TRANSFORM_VERB]/0 ' || w || '/0 [/TRANSFORM_VERB]/0 done/1' ELSE w || '/0' END AS frag FROM g2)
    SELECT doc_id, md5(string_agg(frag, ' ' ORDER BY pos)) AS record FROM f GROUP BY 1
    HAVING doc_id IN (SELECT doc_id FROM n WHERE k IN (1, 3, 5, 6))""",
)
def i_generation_records(t: Tables) -> DataFrame:
    def record(x: Column) -> Column:
        made = rec.generation_record(x["t"], x["o"])
        return F.when(rec.has_generation_op(x["o"]), F.struct(F.md5(_items(made)).alias("record")))

    def of_tokens(tokens: Column) -> Column:
        return bind(F.struct(tokens.alias("t"), F.transform(tokens, _ops).alias("o")), record)

    return t.documents.select("doc_id", present(bind(tx.words(F.col("text")), of_tokens)))


@query(
    "i_inference_records",
    f"""WITH {TOK_SQL}, {GROUPS_SQL}, f AS (SELECT doc_id, pos, CASE WHEN k = 8 AND NOT is_last THEN NULL WHEN k = 8 OR pk = 8 THEN run || '/0'
      WHEN k IN (0, 4, 6) THEN '[DELETE]/0 ' || w || '/0 [/DELETE]/0' WHEN k = 1 THEN '[DELETE]/0 ' || w || '/0 [/DELETE]/0 [MASK]/1 [MASK]/1'
      WHEN k = 3 THEN w || '/0 [MASK]/1 [MASK]/1' WHEN k = 5 THEN w || 's/0'
      WHEN k = 7 THEN '[TRANSFORM_VERB]/0 ' || w || '/0 [/TRANSFORM_VERB]/0 [MASK]/1 [MASK]/1' ELSE w || '/0' END AS frag FROM g2)
    SELECT doc_id, md5(string_agg(frag, ' ' ORDER BY pos)) AS record FROM f GROUP BY 1""",
)
def i_inference_records(t: Tables) -> DataFrame:
    predicted = F.transform("tokens", lambda w: F.concat(F.lit("B-"), F.get(_ops(w), F.lit(0))))
    rows = _tokens(t).filter(F.size("tokens") > 0)
    made = rows.select("doc_id", rec.inference_record(F.col("tokens"), predicted, slots=2).alias("r"))
    return made.select("doc_id", F.md5(_items("r")).alias("record"))


@query(
    "i_keep_all",
    f"SELECT doc_id, md5('$START ' || array_to_string({v.tokens_sql('text')}, ' ')) AS tokens, CAST(len({v.tokens_sql('text')}) + 1 AS INTEGER) AS n_keep FROM documents",
)
def i_keep_all(t: Tables) -> DataFrame:
    tokens = F.concat(F.array(F.lit(rules.START)), tx.tokenize(F.col("text")))
    r = t.documents.select("doc_id", rec.keep_all_record(tokens).alias("r"))
    return r.select(
        "doc_id",
        F.md5(F.array_join("r.tokens", " ")).alias("tokens"),
        F.size(F.filter("r.action_tags", lambda x: x == rules.KEEP)).alias("n_keep"),
    )


# sub-word pieces: a word of n characters has ceil(n / 3) pieces, special pieces at both ends
PIECE_SQL = """pieces AS (SELECT doc_id, pos, w, unnest(range(CAST(ceil(length(w) / 3.0) AS BIGINT))) AS j FROM tok)"""


def _pieces(t: Tables) -> DataFrame:
    counts = F.transform(
        "tokens", lambda w, i: F.array_repeat(i, F.ceil(F.char_length(w) / 3).cast("int"))
    )
    edge = F.array(F.lit(None).cast("int"))
    ids = _tokens(t).withColumn("word_ids", F.concat(edge, F.flatten(counts), edge))
    return ids.withColumn("piece_ids", F.transform("word_ids", lambda _, i: i + 1000))


@query(
    "i_align_labels",
    f"""WITH {TOK_SQL}, {PIECE_SQL} SELECT doc_id, md5('-100 ' || string_agg(CASE WHEN j = 0 THEN CAST(length(w) % 5 AS VARCHAR) ELSE '-100' END, ' ' ORDER BY pos, j) || ' -100') AS labels,
    md5('-100 ' || string_agg(CAST(length(w) % 5 + CASE WHEN j = 0 THEN 0 ELSE 50 END AS VARCHAR), ' ' ORDER BY pos, j) || ' -100') AS all_labels FROM pieces GROUP BY 1""",
)
def i_align_labels(t: Tables) -> DataFrame:
    label_ids = F.transform("tokens", lambda w: F.char_length(w) % 5)
    b_to_i = F.array(*[F.lit(50 + i) for i in range(5)])
    first = rec.align_labels(F.col("word_ids"), label_ids)
    every = rec.align_labels(F.col("word_ids"), label_ids, b_to_i)

    def text(c):
        return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))

    rows = _pieces(t).filter(F.size("tokens") > 0)
    return rows.select("doc_id", text(first).alias("labels"), text(every).alias("all_labels"))


@query(
    "i_align_slots",
    f"""WITH {TOK_SQL}, {PIECE_SQL}, q AS (SELECT doc_id, CAST(length(w) > 6 AS INTEGER) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS p FROM pieces),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, m ORDER BY p) AS isl FROM q),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, m, isl ORDER BY p) AS rn, count(*) OVER (PARTITION BY doc_id, m, isl) AS n FROM r),
    c AS (SELECT doc_id, p, 0 AS x, CASE WHEN m = 1 THEN '103' ELSE CAST(1000 + p AS VARCHAR) END AS i, CASE WHEN m = 1 THEN CAST(1000 + p AS VARCHAR) ELSE '-100' END AS l FROM s WHERE m = 0 OR rn <= 4
      UNION ALL SELECT doc_id, p, unnest(range(1, 5 - n)), '103', '0' FROM s WHERE m = 1 AND rn = n AND n < 4)
    SELECT doc_id, md5('1000 ' || string_agg(i, ' ' ORDER BY p, x) || ' ' || CAST(1001 + (SELECT max(p) FROM q WHERE q.doc_id = c.doc_id) AS VARCHAR)) AS input_ids,
      md5('-100 ' || string_agg(l, ' ' ORDER BY p, x) || ' -100') AS labels FROM c GROUP BY 1""",
)
def i_align_slots(t: Tables) -> DataFrame:
    mask = F.transform("tokens", lambda w: (F.char_length(w) > 6).cast("int"))
    cells = rec.align_slots(F.col("piece_ids"), F.col("word_ids"), mask, mask_id=103, pad_id=0, slot=4)
    rows = _pieces(t).filter(F.size("tokens") > 0).select("doc_id", cells.alias("c"))

    def text(field):
        return F.md5(F.array_join(F.transform("c", lambda x: x[field].cast("string")), " "))

    return rows.select("doc_id", text("input_id").alias("input_ids"), text("label").alias("labels"))


@query(
    "i_pad",
    f"""WITH a AS (SELECT doc_id, doc_id // 16 AS batch_no, list_transform({SPLIT_SQL}, lambda w: length(w)) AS ids FROM documents),
    b AS (SELECT doc_id, ids, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_no) / 8.0) * 8 AS INTEGER) AS n FROM a)
    SELECT doc_id, n, md5(array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda x: -1)), ' ')) AS ids,
      md5(array_to_string(list_concat(ids, list_transform(range(20 - len(ids)), lambda x: -1))[1 : 20], ' ')) AS cut FROM b""",
)
def i_pad(t: Tables) -> DataFrame:
    rows = _tokens(t).select(
        "doc_id",
        F.floor(F.col("doc_id") / 16).alias("batch_no"),
        F.transform("tokens", lambda w: F.char_length(w)).alias("ids"),
    )
    cut = rows.withColumn("cut", rec.pad_to(F.col("ids"), F.lit(20), F.lit(-1)))
    padded = rec.pad_batches(cut, "ids", "batch_no", -1, multiple=8)

    def text(c):
        return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))

    return padded.select("doc_id", F.size("ids").alias("n"), text("ids").alias("ids"), text("cut").alias("cut"))


@query(
    "i_slot_masking",
    f"""WITH {TOK_SQL} SELECT doc_id, md5(string_agg(CASE WHEN length(w) % 3 = 2 THEN '103' ELSE CAST(length(w) AS VARCHAR) END, ' ' ORDER BY pos)) AS input_ids,
    md5(string_agg(CASE WHEN length(w) % 3 = 2 THEN CAST(length(w) AS VARCHAR) ELSE '-100' END, ' ' ORDER BY pos)) AS labels,
    sum(CASE WHEN length(w) % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS attended FROM tok GROUP BY 1""",
)
def i_slot_masking(t: Tables) -> DataFrame:
    ids = F.transform("tokens", lambda w: F.char_length(w))
    flags = F.transform("tokens", lambda w: F.char_length(w) % 3 - 1)
    rows = _tokens(t).filter(F.size("tokens") > 0)
    cells = rows.select("doc_id", rec.slot_masking(ids, flags, 103, 0).alias("c"))

    def text(field):
        return F.md5(F.array_join(F.transform("c", lambda x: x[field].cast("string")), " "))

    attended = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + x["attention"])
    return cells.select("doc_id", text("input_id").alias("input_ids"), text("label").alias("labels"), attended.alias("attended"))


@query(
    "i_random_masking",
    f"SELECT CAST(sum(len({SPLIT_SQL})) AS BIGINT) AS tokens, true AS share_ok, true AS mask_ok, true AS special_kept FROM documents",
)
def i_random_masking(t: Tables) -> DataFrame:
    """Shares of picked and masked tokens; special ids are never picked."""
    ids = F.transform("tokens", lambda w: F.char_length(w))
    special = F.array(F.lit(1), F.lit(2))
    cells = _tokens(t).select(
        F.explode(F.arrays_zip(ids.alias("id"), rec.random_masking(ids, F.col("doc_id"), special, 103, 30000).alias("c"))).alias("z")
    )
    picked = F.col("z.c.label") != rules.IGNORE
    usable = ~F.col("z.id").isin(1, 2)
    return cells.agg(
        F.count("*").alias("tokens"),
        (F.count_if(picked) / F.count_if(usable)).between(0.13, 0.17).alias("share_ok"),
        (F.count_if(picked & (F.col("z.c.input_id") == 103)) / F.count_if(picked)).between(0.75, 0.85).alias("mask_ok"),
        F.every(usable | (F.col("z.c.input_id") == F.col("z.id"))).alias("special_kept"),
    )


@query(
    "i_confidence_fallback",
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE * 20 - list_max(embedding)::DOUBLE * 20)) AS e FROM embeddings),
    p AS (SELECT vec_id, list_position(e, list_max(e)) - 1 AS k, list_max(e) / list_sum(e) AS p FROM x)
    SELECT vec_id, CAST(CASE WHEN k <> 0 AND p < 0.5 THEN 0 ELSE k END AS INTEGER) AS label FROM p""",
)
def i_confidence_fallback(t: Tables) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double") * 20)
    return t.embeddings.select("vec_id", rec.confidence_fallback(logits, 0, 0.5).alias("label"))


@query(
    "i_fill_slots",
    f"""WITH {TOK_SQL}, m AS (SELECT doc_id, pos, w, length(w) % 4 AS q, sum(CASE WHEN length(w) % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM tok)
    SELECT doc_id, md5('begin ' || coalesce(string_agg(CASE WHEN q = 1 THEN 'p' || CAST(c AS VARCHAR) ELSE w END, ' ' ORDER BY pos) FILTER (q <> 0), '')) AS line FROM m GROUP BY 1""",
)
def i_fill_slots(t: Tables) -> DataFrame:
    def item(w):
        q = F.char_length(w) % 4
        return (
            F.when(q == 0, F.array(F.lit(rules.DELETE_OPEN), w, F.lit(rules.MASK), F.lit(rules.DELETE_CLOSE)))
            .when(q == 1, F.array(F.lit(rules.MASK)))
            .otherwise(F.array(w))
        )

    rows = _tokens(t).filter(F.size("tokens") > 0)
    n_masks = F.size(F.filter("tokens", lambda w: F.char_length(w) % 4 == 1))
    predictions = F.when(
        n_masks > 0, F.transform(F.sequence(F.lit(1), n_masks), lambda i: F.concat(F.lit("p"), i.cast("string")))
    ).otherwise(F.array().cast("array<string>"))
    filled = rec.fill_slots(F.flatten(F.transform("tokens", item)), predictions)
    return rows.select("doc_id", F.md5(F.concat(F.lit("begin "), F.array_join(filled, " "))).alias("line"))


@query(
    "i_strip_ignored",
    """WITH x AS (SELECT event_id // 32 AS part, event_id, ascii(event_type) % 5 AS g, CASE WHEN event_id % 5 = 0 THEN 0 ELSE ascii(event_type) % 5 END AS p FROM events WHERE event_id % 13 <> 0)
    SELECT part, string_agg('B-L' || CAST(p AS VARCHAR), ' ' ORDER BY event_id) AS pred, string_agg('B-L' || CAST(g AS VARCHAR), ' ' ORDER BY event_id) AS gold FROM x GROUP BY 1""",
)
def i_strip_ignored(t: Tables) -> DataFrame:
    """Rows of 32 positions; every 13th position is to be ignored."""
    kind = F.ascii("event_type") % 5
    cells = t.events.select(
        F.floor(F.col("event_id") / 32).alias("part"),
        F.struct(
            "event_id",
            F.when(F.col("event_id") % 13 == 0, rules.IGNORE).otherwise(kind).alias("g"),
            F.when(F.col("event_id") % 5 == 0, 0).otherwise(kind).alias("p"),
        ).alias("x"),
    )
    rows = cells.groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    names = F.array(*[F.lit(f"L{i}") for i in range(5)])
    stripped = rec.strip_ignored(
        F.transform("xs", lambda x: x["p"]), F.transform("xs", lambda x: x["g"]), names
    )
    out = rows.select("part", stripped.alias("s"))
    return out.select("part", F.array_join("s.pred", " ").alias("pred"), F.array_join("s.gold", " ").alias("gold"))


@query("i_log_samples")
def i_log_samples(t: Tables) -> DataFrame:
    from ..operators.refine import sample_rows

    return sample_rows(t.documents.select("doc_id", "lang", "text"), "doc_id", 10, seed=1)
