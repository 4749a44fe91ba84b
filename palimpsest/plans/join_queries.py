"""Joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules, text as tx
from ..functions.collections import argmax
from ..operators import batches, cluster, context, features, lookups, metrics, ordering, pairing, records
from ..operators.ordering import with_index
from ..session import scratch_path
from ..sources import readers, writers
from . import views as v
from .bleu_sql import bleu_sql, pair_texts
from .catalog import Tables, query


@query(
    "c_revision_pairs",
    v.with_("kept")
    + """SELECT c.page_id, c.rev_id, c.parent_id, md5(p.text) AS parent_digest FROM kept c JOIN kept p ON c.parent_id = p.rev_id
    WHERE length(c.text) > 0 AND length(p.text) > 0""",
)
def c_revision_pairs(t: Tables) -> DataFrame:
    pairs = pairing.pair_with_parent(pairing.gate_comments(v.revisions(t)), within=v.PAGE)
    return pairs.filter((F.char_length("text") > 0) & (F.char_length("parent_text") > 0)).select(
        "page_id", "rev_id", "parent_id", F.md5("parent_text").alias("parent_digest")
    )


@query(
    "c_add_cluster",
    v.with_("clusters") + "SELECT id, cluster, 'c' || CAST(id AS VARCHAR) AS comment FROM clusters",
)
def c_add_cluster(t: Tables) -> DataFrame:
    """Two versions of the assignment; the later one wins."""
    c = v.clusters(t)
    old = c.select("id", (F.col("cluster") + 100).alias("cluster"), F.lit(1).alias("version"))
    new = c.select("id", "cluster", F.lit(2).alias("version"))
    pairs = c.select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("comment"))
    return lookups.add_cluster_by_id(pairs, old.unionByName(new), "version").select("id", "cluster", "comment")


@query(
    "c_zip_cluster",
    """SELECT d.doc_id, e.label AS cluster FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) d
    JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) e USING (i)""",
)
def c_zip_cluster(t: Tables) -> DataFrame:
    left = with_index(t.documents.select("doc_id"), ["doc_id"], "line_no")
    right = with_index(t.embeddings.select("vec_id", "label"), ["vec_id"], "line_no")
    return lookups.zip_by_position(left, right).select("doc_id", F.col("label").alias("cluster"))


@query(
    "c_comment_lookup",
    v.with_("kept")
    + f"""SELECT a.rev_id, len({v.tokens_sql('a.comment')}) AS n_tokens, array_to_string({v.tokens_sql('b.comment')}, ' ') AS parent_comment
    FROM kept a LEFT JOIN kept b ON a.parent_id = b.rev_id""",
)
def c_comment_lookup(t: Tables) -> DataFrame:
    kept = pairing.gate_comments(v.revisions(t)).select(
        "page_id", "rev_id", "parent_id", tx.tokenize(F.col("comment")).alias("tokens")
    )
    dim = kept.select("page_id", F.col("rev_id").alias("parent_id"), F.array_join("tokens", " ").alias("parent_comment"))
    return kept.join(dim, [*v.PAGE, "parent_id"], "left").select(
        "rev_id", F.size("tokens").cast("bigint").alias("n_tokens"), "parent_comment"
    )


def _word_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.split(writers.one_line(F.col("text")), " ").alias("tokens"))


WORDS_SQL = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, string_split(replace(text, chr(10), ' '), ' ') AS tokens FROM documents"


@query(
    "c_zip_predictions",
    f"""SELECT i AS line_no, len(tokens) AS n, len(list_filter(tokens, lambda x: length(x) > 4)) AS n_delete
    FROM ({WORDS_SQL.replace("replace(text, chr(10), ' ')", "regexp_replace(text, '[\\r\\n]+', ' ', 'g')")})""",
)
def c_zip_predictions(t: Tables) -> DataFrame:
    """Records zipped with the lines of a prediction file."""
    lines = with_index(_word_lines(t), ["doc_id"], "line_no")
    tag = F.transform("tokens", lambda w: F.when(F.char_length(w) > 4, "B-$DELETE").otherwise("B-$KEEP"))
    path = scratch_path(t.spark, "predictions")
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
    writers.write_lines(ordered.select(F.array_join(tag, " ").alias("line")), "line", path)
    zipped = lookups.zip_checked(lines, readers.read_tag_lines(t.spark, path), "tokens", "tags")
    return zipped.select(
        "line_no",
        F.size("tokens").cast("bigint").alias("n"),
        F.size(F.filter("tags", lambda x: x == "B-$DELETE")).cast("bigint").alias("n_delete"),
    )


@query("c_results_by_index", "SELECT doc_id AS id, upper(lang) || ' ' || source AS output FROM documents")
def c_results_by_index(t: Tables) -> DataFrame:
    inputs = with_index(t.documents.select(F.col("doc_id").alias("id")), ["id"], "line_no")
    path = scratch_path(t.spark, "results")
    ordered = t.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writers.write_lines(
        ordered.select(F.concat(F.upper("lang"), F.lit(" "), F.col("source")).alias("line")), "line", path
    )
    out = readers.read_lines(t.spark, path).select("line_no", F.col("value").alias("output"))
    return lookups.zip_by_position(inputs, out).select("id", "output")


def _centroids(t: Tables) -> DataFrame:
    """The mean vector of every label, as one array of arrays in label order."""
    means = (
        t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    vectors = means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")
    )
    return vectors.agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "c"))), lambda s: s["c"]))


NEAREST_SQL = """SELECT e.vec_id AS id, arg_min(c.label, list_sum(list_transform(list_zip(e.embedding, c.c),
    lambda z: pow(z[1]::DOUBLE - z[2], 2)))) AS cluster FROM embeddings e CROSS JOIN
    (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM
      (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) c GROUP BY 1"""


def _nearest(t: Tables) -> DataFrame:
    near = cluster.nearest_centroid(F.col("embedding"), F.col("_c"))
    vectors = t.embeddings.withColumn("_c", _centroids(t).scalar())
    return vectors.select(F.col("vec_id").alias("id"), near.alias("cluster"))


@query("j_assign_centroids", NEAREST_SQL)
def j_assign_centroids(t: Tables) -> DataFrame:
    return _nearest(t)


@query(
    "c_attach_cluster",
    f"WITH a AS ({NEAREST_SQL}) SELECT d.doc_id AS id, md5(d.text) AS digest, a.cluster FROM documents d JOIN a ON d.doc_id = a.id",
)
def c_attach_cluster(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return texts.join(_nearest(t), "id")


LEXICON = """SELECT DISTINCT w AS w1, w || 'ed' AS w2, 'VB' AS t1, 'VBD' AS t2 FROM
  (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) = 4"""


def _words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("src"))


def _lexicon(t: Tables) -> DataFrame:
    """Four-letter words as verbs with a second, later spelling per key."""
    verbs = _words(t).filter(F.char_length("src") == 4).select(F.col("src").alias("w1")).distinct()
    first = verbs.select("w1", F.concat("w1", F.lit("ed")).alias("w2"), F.lit(1).alias("row_no"))
    later = verbs.select("w1", F.concat("w1", F.lit("t")).alias("w2"), F.lit(2).alias("row_no"))
    return first.unionByName(later).select("w1", "w2", F.lit("VB").alias("t1"), F.lit("VBD").alias("t2"), "row_no")


@query(
    "c_verb_lookup",
    f"""WITH lex AS ({LEXICON}), w AS (SELECT unnest(string_split(text, ' ')) AS src FROM documents)
    SELECT CASE WHEN l.w1 IS NULL THEN NULL ELSE '$TRANSFORM_VERB-' || w.src || 'ed' END AS verb_tag,
      coalesce(l.w2, w.src) AS word, count(*) AS n FROM w LEFT JOIN lex l ON w.src = l.w1 GROUP BY 1, 2""",
)
def c_verb_lookup(t: Tables) -> DataFrame:
    lexicon = _lexicon(t)
    words = _words(t).select("src", F.concat("src", F.lit("ed")).alias("tgt"))
    encoded = lookups.verb_lookup(words, lexicon)
    asked = encoded.select("verb_tag", F.col("src").alias("token"), F.lit("VB").alias("t1"), F.lit("VBD").alias("t2"))
    return lookups.verb_decode(asked, lexicon).groupBy("verb_tag", "word").agg(F.count("*").alias("n"))


EPS = 0.72
EDGES_SQL = f"""SELECT a.vec_id AS a, b.vec_id AS b,
    1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
      / sqrt(a.nn) / sqrt(b.nn) AS distance
  FROM u a JOIN u b ON a.vec_id < b.vec_id"""
UNIT_SQL = """SELECT min(vec_id) AS vec_id, embedding, count(*) AS weight,
    list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS nn FROM embeddings GROUP BY embedding"""


@query(
    "c_eps_pairs",
    f"WITH u AS ({UNIT_SQL}), e AS ({EDGES_SQL}) SELECT a, b, round(distance, 6) AS distance FROM e WHERE distance <= {EPS}",
)
def c_eps_pairs(t: Tables) -> DataFrame:
    pairs = cluster.eps_pairs(t.embeddings, "vec_id", "embedding", EPS)
    return pairs.select("a", "b", F.round("distance", 6).alias("distance"))


@query(
    "j_dbscan",
    f"""WITH RECURSIVE u AS ({UNIT_SQL}), e0 AS ({EDGES_SQL}), e AS (SELECT a, b FROM e0 WHERE distance <= {EPS}),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    core AS (SELECT u.vec_id AS id FROM u LEFT JOIN (SELECT x.a, sum(w.weight) AS n FROM both_ways x JOIN u w ON w.vec_id = x.b GROUP BY 1) s
      ON s.a = u.vec_id WHERE u.weight + coalesce(s.n, 0) >= 5),
    ce AS (SELECT a, b FROM both_ways WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS label FROM core UNION SELECT ce.b, reach.label FROM reach JOIN ce ON ce.a = reach.id),
    cl AS (SELECT id, min(label) AS label FROM reach GROUP BY 1),
    bd AS (SELECT x.a AS id, min(cl.label) AS label FROM both_ways x JOIN cl ON cl.id = x.b WHERE x.a NOT IN (SELECT id FROM core) GROUP BY 1),
    lab AS (SELECT * FROM cl UNION ALL SELECT * FROM bd)
    SELECT v.vec_id, coalesce(lab.label, -1) AS cluster FROM embeddings v JOIN u ON u.embedding = v.embedding LEFT JOIN lab ON lab.id = u.vec_id""",
)
def j_dbscan(t: Tables) -> DataFrame:
    return cluster.dbscan(t.embeddings, "vec_id", "embedding", EPS, 5)


# ---- aggregations --------------------------------------------------------------


@query(
    "d_label_vocab",
    """SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS label FROM documents)""",
)
def d_label_vocab(t: Tables) -> DataFrame:
    return metrics.label_vocab(_words(t).withColumnRenamed("src", "label"))


@query(
    "d_label_maps",
    """WITH l AS (SELECT DISTINCT 'B-' || event_type AS label FROM events UNION SELECT DISTINCT 'I-' || event_type FROM events WHERE event_type <> 'view'),
    ids AS (SELECT label, 100 + row_number() OVER (ORDER BY label DESC) AS id FROM l)
    SELECT a.label, a.id, coalesce(b.id, a.id) AS i_id FROM ids a LEFT JOIN ids b ON starts_with(a.label, 'B-') AND b.label = replace(a.label, 'B-', 'I-')""",
)
def d_label_maps(t: Tables) -> DataFrame:
    """A given vocabulary with the same labels dictates the ids."""
    kinds = t.events.select("event_type").distinct()
    labels = kinds.select(F.concat(F.lit("B-"), "event_type").alias("label")).union(
        kinds.filter("event_type <> 'view'").select(F.concat(F.lit("I-"), "event_type"))
    )
    vocab = metrics.label_vocab(labels)
    given = vocab.agg(F.count("*")).scalar()
    return metrics.label_maps(vocab, vocab.select("label", (100 + given - F.col("id")).alias("id")))


@query(
    "d_corpus_counts",
    v.with_("edit_pairs")
    + "SELECT count(*) AS total, count(*) FILTER (src <> tgt) AS changed, count(*) FILTER (src = tgt) AS unchanged FROM edit_pairs",
)
def d_corpus_counts(t: Tables) -> DataFrame:
    return metrics.corpus_counts(v.edit_pairs(t))


PER_LABEL = """WITH p AS (SELECT gold, pred FROM (SELECT event_type AS gold, CASE WHEN event_id % 5 = 0 THEN 'click' ELSE event_type END AS pred,
    event_id % 13 = 0 AS ignored FROM events) WHERE NOT ignored),
  x AS (SELECT gold AS label, CAST(gold = pred AS INT) AS tp, 0 AS np, 1 AS ng FROM p UNION ALL SELECT pred, 0, 1, 0 FROM p),
  s AS (SELECT label, sum(tp) AS tp, sum(np) AS np, sum(ng) AS ng FROM x GROUP BY 1 UNION ALL SELECT 'overall', sum(tp), sum(np), sum(ng) FROM x),
  r AS (SELECT label, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS precision, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS recall, ng FROM s),
  m AS (SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
    CAST(ng AS BIGINT) AS support FROM r)
"""


@query(
    "d_entity_metrics",
    PER_LABEL + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m",
)
def d_entity_metrics(t: Tables) -> DataFrame:
    m = metrics.entity_metrics(v.predictions(t).filter("NOT ignored"))
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "d_metrics_json",
    PER_LABEL
    + """SELECT 'eval_' || label || '_f1' AS key, round(f1, 6) AS value FROM m
    UNION ALL SELECT 'eval_' || label || '_support', support FROM m""",
)
def d_metrics_json(t: Tables) -> DataFrame:
    """The flat JSON object, read back into entries."""
    doc = metrics.metrics_json(metrics.entity_metrics(v.predictions(t).filter("NOT ignored")))
    entries = doc.select(F.explode(F.from_json("metrics", "map<string, double>")).alias("key", "value"))
    return entries.filter(F.col("key").rlike("_(f1|support)$")).select("key", F.round("value", 6).alias("value"))


@query(
    "d_slot_accuracy",
    v.with_("predictions") + "SELECT round(avg(CAST(pred = gold AS DOUBLE)), 6) AS accuracy FROM predictions WHERE NOT ignored",
)
def d_slot_accuracy(t: Tables) -> DataFrame:
    acc = metrics.slot_accuracy(v.predictions(t).filter("NOT ignored"))
    return acc.select(F.round("accuracy", 6).alias("accuracy"))


@query("d_perplexity", v.with_("predictions") + "SELECT round(exp(avg(loss / 10)), 6) AS perplexity FROM predictions")
def d_perplexity(t: Tables) -> DataFrame:
    losses = v.predictions(t).select((F.col("loss") / 10).alias("loss"))
    return metrics.perplexity(losses).select(F.round("perplexity", 6).alias("perplexity"))


@query(
    "d_token_counts",
    r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS token_count FROM documents",
)
def d_token_counts(t: Tables) -> DataFrame:
    return metrics.token_counts(t.documents, "doc_id", "text")


@query(
    "d_corpus_bleu",
    v.with_("edit_pairs", **pair_texts(v.tokens_sql), **bleu_sql("toks", "pairs"),
            sums="SELECT n, sum(hit) AS hit, sum(total) AS total, sum(rl) AS rl, sum(hl) AS hl FROM bleu_n GROUP BY n")
    + """SELECT CAST(max(hit) FILTER (n = 1) AS BIGINT) AS m1, CAST(max(hit) FILTER (n = 4) AS BIGINT) AS m4,
    round(CASE WHEN max(hl) > max(rl) THEN 1.0 ELSE exp(1.0 - max(rl)::DOUBLE / max(hl)) END * exp(sum(ln(hit::DOUBLE / total)) / 4), 6) AS bleu FROM sums""",
)
def d_corpus_bleu(t: Tables) -> DataFrame:
    pairs = v.edit_pairs(t).select(
        tx.tokenize(F.col("tgt")).alias("ref"), tx.tokenize(F.col("src")).alias("hyp")
    )
    return metrics.corpus_bleu(pairs).select("m1", "m4", F.round("bleu", 6).alias("bleu"))


@query(
    "d_steps",
    """WITH b AS (SELECT sum(CAST(ceil(n / 16.0) AS BIGINT)) AS batches FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
    SELECT CAST(batches AS BIGINT) AS batches, CAST(ceil(batches / 4.0) AS BIGINT) AS updates, CAST(ceil(batches / 4.0) * 10 AS BIGINT) AS total_steps FROM b""",
)
def d_steps(t: Tables) -> DataFrame:
    sizes = t.documents.groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("rows"))
    return batches.steps_per_epoch(sizes, 16, accumulate=4, epochs=10)


# ---- windows -------------------------------------------------------------------


@query(
    "e_prev_revision",
    v.with_("kept") + "SELECT rev_id, lag(rev_id) OVER (PARTITION BY page_id ORDER BY rev_ord) AS prev_rev_id FROM kept",
)
def e_prev_revision(t: Tables) -> DataFrame:
    kept = pairing.gate_comments(v.revisions(t)).select("page_id", "rev_ord", "rev_id")
    return pairing.previous_kept(kept).select("rev_id", "prev_rev_id")


@query(
    "e_neighbours",
    """SELECT doc_id, CAST(sum(n_chars) OVER w AS BIGINT) - n_chars AS around FROM documents
    WINDOW w AS (ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""",
)
def e_neighbours(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    indexed = with_index(t.documents.select("doc_id", "n_chars"), ["doc_id"], "_idx")
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(-3, 2)
    return (
        ordering.halo_blocks(indexed, "_idx", 3, 2)
        .withColumn("around", F.sum("n_chars").over(w) - F.col("n_chars"))
        .filter("_own")
        .select("doc_id", "around")
    )


COMMENT_SQL = v.with_(
    "kept",
    valid=f"""SELECT page_id, rev_id, rev_ord, comment FROM kept WHERE len({v.tokens_sql('comment')}) >= 3
      AND NOT contains(comment, '[[Project:AWB|AWB]]') AND NOT contains(comment, '[[Project:AutoWikiBrowser|AWB]]') AND NOT contains(comment, 'Undid revision')""",
)


@query(
    "e_page_comments",
    COMMENT_SQL
    + """SELECT page_id, rev_id, row_number() OVER (PARTITION BY page_id ORDER BY rev_ord) AS n_comments,
    array_to_string(list(comment) OVER (PARTITION BY page_id ORDER BY rev_ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '|') AS recent FROM valid""",
)
def e_page_comments(t: Tables) -> DataFrame:
    """Number and last three; ``e_comment_rows`` keeps the whole list."""
    out = pairing.page_comments(pairing.gate_comments(v.revisions(t)), last=3)
    return out.withColumn("recent", F.array_join("recent", "|"))


@query(
    "h_negative_comments",
    COMMENT_SQL
    + """SELECT page_id, rev_id, coalesce(array_to_string(list(comment) OVER (PARTITION BY page_id ORDER BY rev_ord
    ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS negatives FROM valid""",
)
def h_negative_comments(t: Tables) -> DataFrame:
    """The two comments before; ``h_page_negatives`` takes all sides of the page."""
    out = pairing.earlier_comments(pairing.gate_comments(v.revisions(t)), k=2)
    return out.withColumn("negatives", F.array_join("negatives", "|"))


@query(
    "e_comment_rows",
    COMMENT_SQL
    + "SELECT page_id, rev_id, row_number() OVER (PARTITION BY page_id ORDER BY rev_ord) AS comment_no, comment FROM valid",
)
def e_comment_rows(t: Tables) -> DataFrame:
    return pairing.comment_rows(pairing.gate_comments(v.revisions(t)))


@query(
    "h_page_negatives",
    COMMENT_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rev_ord) AS no FROM valid),
    o AS (SELECT a.page_id, a.no, b.no AS other, b.comment,
      row_number() OVER (PARTITION BY a.page_id, a.no ORDER BY abs(b.no - a.no), b.no) AS place FROM n a JOIN n b ON a.page_id = b.page_id AND a.no <> b.no)
    SELECT n.page_id, n.rev_id, coalesce(string_agg(o.comment, '|' ORDER BY o.other), '') AS negatives
    FROM n LEFT JOIN o ON o.page_id = n.page_id AND o.no = n.no AND o.place <= 10 GROUP BY n.page_id, n.no, n.rev_id""",
)
def h_page_negatives(t: Tables) -> DataFrame:
    out = pairing.negative_comments(pairing.gate_comments(v.revisions(t)))
    return out.withColumn("negatives", F.array_join("negatives", "|"))


@query(
    "e_line_index",
    """SELECT md5(line) AS digest, line_no FROM (SELECT regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS line,
    row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents)""",
)
def e_line_index(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines")
    ordered = t.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writers.write_lines(ordered.select(writers.one_line(F.col("text")).alias("line")), "line", path)
    return readers.read_lines(t.spark, path).select(F.md5("value").alias("digest"), "line_no")


TERMS_SQL = r"""SELECT doc_id, CASE WHEN regexp_matches(term, '^[0-9]') THEN '#NUMBER' ELSE term END AS term FROM
  (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)"""
TFIDF_SQL = f"""terms AS ({TERMS_SQL}), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
  raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
  weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query("j_tfidf", f"WITH {TFIDF_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def j_tfidf(t: Tables) -> DataFrame:
    return features.tfidf(t.documents, "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "j_number_tokens",
    f"WITH terms AS ({TERMS_SQL}) SELECT term, count(*) AS n FROM terms GROUP BY 1",
)
def j_number_tokens(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(features.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "e_top_terms",
    f"""WITH {TFIDF_SQL}, sizes AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1),
    c AS (SELECT e.label AS cluster, w.term, round(sum(w.weight) / any_value(s.n), 9) AS score FROM weights w JOIN embeddings e ON e.vec_id = w.doc_id
      JOIN sizes s ON s.cluster = e.label GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) - 1 AS k FROM c)
    SELECT cluster, {', '.join(f"max(term) FILTER (k = {i}) AS term_{i}" for i in range(10))} FROM r GROUP BY cluster""",
)
def e_top_terms(t: Tables) -> DataFrame:
    clusters = v.clusters(t).withColumnRenamed("id", "doc_id")
    return features.top_terms(features.tfidf(t.documents, "doc_id", "text", clusters), clusters, "doc_id")


def _task_batches(t: Tables) -> DataFrame:
    """Head 0 trains on documents, head 1 on conversations; languages / roles are tasks."""
    docs = t.documents.select(
        F.lit(0).alias("head"), (F.ascii("lang") % 2).alias("task"), F.col("doc_id").alias("id")
    )
    turns = t.conversations.select(
        F.lit(1).alias("head"),
        (F.ascii("role") % 2).alias("task"),
        (F.col("conv_id") * v.ROOM + F.col("turn")).alias("id"),
    )
    return batches.numbered_batches(docs.unionByName(turns), ["head", "task"], "id", 16)


@query(
    "e_round_robin",
    f"""WITH x AS (SELECT 0 AS head, ascii(lang) % 2 AS task, doc_id AS id FROM documents UNION ALL
      SELECT 1, ascii(role) % 2, conv_id * {v.ROOM} + turn FROM conversations),
    b AS (SELECT head, task, id, (row_number() OVER (PARTITION BY head, task ORDER BY id) - 1) // 16 AS batch_no FROM x),
    g AS (SELECT head, task, max(batch_no) + 1 AS n FROM b GROUP BY 1, 2),
    h AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY task) - 1 AS k, count(*) OVER (PARTITION BY head) AS m FROM g),
    st AS (SELECT step, step % 2 AS head, step // 2 AS turn FROM (SELECT unnest(range(n)) AS step FROM (SELECT CAST(sum(n) AS BIGINT) AS n FROM g)))
    SELECT st.step, CAST(b.head AS INTEGER) AS head, CAST(b.task AS INTEGER) AS task, b.batch_no, count(*) AS rows, min(b.id) AS first_id
    FROM st JOIN h ON h.head = st.head AND h.k = st.turn % h.m JOIN b ON b.head = h.head AND b.task = h.task AND b.batch_no = (st.turn // h.m) % h.n GROUP BY 1, 2, 3, 4""",
)
def e_round_robin(t: Tables) -> DataFrame:
    numbered = _task_batches(t)
    per_batch = numbered.groupBy("head", "task", "batch_no").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id")
    )
    groups = per_batch.groupBy("head", "task").agg((F.max("batch_no") + 1).alias("n_batches"))
    plan = batches.round_robin(groups, heads=2)
    return plan.join(per_batch, ["head", "task", "batch_no"])


@query(
    "e_stride_shards",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n AS (SELECT count(*) AS n FROM documents)
    SELECT CAST(i % 7 AS INTEGER) AS shard, i // 7 AS slot, doc_id FROM r
    UNION ALL SELECT CAST(g % 7 AS INTEGER), g // 7, -1 FROM (SELECT unnest(range(n, CAST(ceil(n / 7.0) * 7 AS BIGINT))) AS g FROM n)""",
)
def e_stride_shards(t: Tables) -> DataFrame:
    return batches.stride_shards(t.documents.select("doc_id"), ["doc_id"], 7, {"doc_id": -1})


@query(
    "e_delete_runs",
    f"""WITH w AS ({WORDS_SQL}), p AS (SELECT doc_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM w),
    d AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM p WHERE length(tok) > 4)
    SELECT doc_id, CAST(min(pos) AS INTEGER) AS lo, CAST(max(pos) AS INTEGER) AS hi FROM d GROUP BY doc_id, g""",
)
def e_delete_runs(t: Tables) -> DataFrame:
    """Runs of long words, marked as deleted."""
    firsts = F.transform("tokens", lambda w: F.when(F.char_length(w) > 4, rules.DELETE).otherwise(rules.KEEP))
    words = t.documents.select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("tokens"))
    runs = words.select("doc_id", F.explode(records.delete_runs(firsts)).alias("r"))
    return runs.select("doc_id", "r.lo", "r.hi")


@query(
    "f_argmax",
    "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings",
)
def f_argmax(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", argmax(F.col("embedding")).cast("int").alias("best"))


@query(
    "g_unchanged_sents",
    v.with_("sents")
    + """SELECT doc_id, array_to_string(list_filter(range(len(sents)), lambda i: NOT contains(sents[i + 1], ' the ')), ',') AS kept FROM sents""",
)
def g_unchanged_sents(t: Tables) -> DataFrame:
    from ..functions.collections import bind, index_range

    def kept(s):
        changed = F.filter(index_range(F.size(s)), lambda i: F.contains(F.get(s, i), F.lit(" the ")))
        return F.array_join(F.transform(context.unchanged(F.size(s), changed), lambda i: i.cast("string")), ",")

    return t.documents.select("doc_id", bind(tx.split_sentences(F.col("text")), kept).alias("kept"))


@query("d_edit_histogram",
    """WITH o AS (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents)
    SELECT CASE WHEN length(w) > 8 THEN '$REPLACE' WHEN length(w) > 6 THEN '$APPEND' WHEN length(w) > 4 THEN '$DELETE' ELSE '$KEEP' END AS op, count(*) AS n
    FROM o GROUP BY 1""")
def d_edit_histogram(t: Tables) -> DataFrame:
    """Kinds of given tags (word length decides the tag)."""
    from ..operators.annotate import edit_histogram

    def tag(w):
        n = F.char_length(w)
        op = (
            F.when(n > 8, F.concat(F.lit(rules.REPLACE), w)).when(n > 6, F.concat(F.lit(rules.APPEND), w))
            .when(n > 4, rules.DELETE).otherwise(rules.KEEP)
        )
        return F.array(op)

    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return edit_histogram(t.documents.select(F.transform(words, tag).alias("labels")))



