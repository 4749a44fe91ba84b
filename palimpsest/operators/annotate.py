"""Token-level edit annotation: align source and target into edit tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, sequence, tags, text as tx
from ..functions.collections import bind, bound
from . import lookups

EDIT_TYPE = "array<struct<pos:int,op:string>>"
_BLOCK_BITS = 12  # positions of a key that are labelled together: 4096
_NULL = "\0"  # a list leaves out nulls


def with_verbs(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``_verbs``: the lexicon pairs (``"w1 w2"``) between a row's own source
    and target tokens. Where rows are numbered, later ones of a decode key do not
    count (see ``lookups.encode_lexicon``).

    Both sides are exploded word by word and meet in joins, so neither the
    lexicon nor the product of a row's sides is held anywhere.
    """
    first = lookups.encode_lexicon(lexicon) if "row_no" in lexicon.columns else lexicon
    known = first.select("w1", "w2").distinct()
    keyed = tokens.withColumn("_k", F.sha2(F.to_json(F.struct("src", "tgt")), 256))
    changed = keyed.filter(F.col("src_tokens") != F.col("tgt_tokens"))
    sources = changed.select("_k", F.explode(F.array_distinct("src_tokens")).alias("w1"))
    targets = changed.select("_k", F.explode(F.array_distinct("tgt_tokens")).alias("w2"))
    hits = sources.join(known, "w1").join(targets, ["_k", "w2"], "left_semi")
    own = hits.groupBy("_k").agg(F.collect_set(F.concat("w1", F.lit(" "), "w2")).alias("_verbs"))
    return keyed.join(own, "_k", "left").withColumn("_verbs", F.coalesce("_verbs", F.array().cast("array<string>"))).drop("_k")


def _edit(pos: Column, op: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), op.alias("op"))


def _append(pos: Column, words: Column) -> Column:
    return F.transform(words, lambda w: _edit(pos, F.concat(F.lit(rules.APPEND), w)))


def _group_edits(pos: Column, s: Column, group: Column, verb: Column | None) -> Column:
    """Edits that turn one source token into a group of target words."""
    parts = F.size(F.split(s, "-"))
    n = F.size(group)
    by_split = (parts > 1) & (n >= parts) & (F.slice(group, F.lit(1), parts) == F.split(s, "-"))

    def known(w: Column) -> Column | None:
        if verb is None:
            return None
        return F.array_contains(verb, F.concat(s, F.lit(" "), w))

    def choice(scored: Column) -> Column:
        best = F.array_position(
            F.transform(scored, lambda x: x["cost"]), F.array_min(F.transform(scored, lambda x: x["cost"]))
        ).cast("int")
        return bind(
            best,
            lambda k: F.concat(
                _append(pos - 1, F.slice(group, F.lit(1), k - 1)),
                F.array(
                    _edit(
                        pos,
                        F.coalesce(
                            F.get(scored, k - 1)["tag"],
                            F.concat(F.lit(rules.REPLACE), F.get(group, k - 1)),
                        ),
                    )
                ),
                _append(pos, F.slice(group, k + 1, F.greatest(n - k, F.lit(0)))),
            ),
        )

    def score(w: Column) -> Column:
        return bind(
            tags.word_tag(s, w, known(w)),
            lambda tag: F.struct(
                tag.alias("tag"), F.when(tag.isNotNull(), F.lit(0)).otherwise(F.levenshtein(s, w)).alias("cost")
            ),
        )

    scored = F.transform(group, score)
    return (
        F.when(n == 0, F.array(_edit(pos, F.lit(rules.DELETE))))
        .when(
            by_split,
            F.concat(
                F.array(_edit(pos, F.lit(rules.SPLIT_HYPHEN))),
                _append(pos, F.slice(group, parts + 1, F.greatest(n - parts, F.lit(0)))),
            ),
        )
        .otherwise(bind(scored, choice))
    )


@bound(3)
def ops_to_edits(ops: Column, src: Column, tgt: Column, verb: Column | None = None) -> Column:
    """Refined opcodes (one group per replaced token) to ordered ``(pos, op)`` edits."""

    def one(o: Column) -> Column:
        group = F.slice(tgt, o["j1"] + 1, o["j2"] - o["j1"])
        removed = F.transform(
            F.sequence(o["i1"], F.greatest(o["i2"] - 1, o["i1"])), lambda i: _edit(i, F.lit(rules.DELETE))
        )
        merged = F.transform(
            F.sequence(o["i1"], F.greatest(o["i2"] - 2, o["i1"])),
            lambda i: _edit(i, F.lit(rules.MERGE_HYPHEN)),
        )
        return (
            F.when(o["tag"] == "delete", removed)
            .when(o["tag"] == "insert", _append(o["i1"] - 1, group))
            .when(o["tag"] == "merge", merged)
            .otherwise(
                bind(
                    F.struct(group.alias("g"), F.get(src, o["i1"]).alias("s")),
                    lambda x: _group_edits(o["i1"], x["s"], x["g"], verb),
                )
            )
        )

    return F.flatten(F.transform(ops, one))


def annotate(
    pairs: DataFrame, mode: str = "word", lexicon: DataFrame | None = None, parallelism: int | None = None
) -> DataFrame:
    """Adds ``src_tokens, tgt_tokens, edits, labels`` to ``src, tgt`` pairs.

    Pairs that hold a format delimiter are left out (see ``delimiter_rejects``).
    Equal pairs never reach Python: their opcodes are the empty list. The
    alignment costs far more than moving a pair, so pairs are dealt evenly
    over ``parallelism`` tasks when that is given. A verb ``lexicon`` has
    ``w1, w2, t1, t2, row_no``; without ``row_no`` all its pairs count.
    """
    ok = pairs.filter(tx.sentence_ok(F.col("src")) & tx.sentence_ok(F.col("tgt")))
    tokens = ok.withColumns(
        {
            "src_tokens": tx.tokenize(F.col("src"), mode),
            "tgt_tokens": tx.tokenize(F.col("tgt"), mode),
        }
    )
    verb = None
    if lexicon is not None:
        tokens, verb = with_verbs(tokens, lexicon), F.col("_verbs")
    if parallelism:
        tokens = tokens.repartition(parallelism)
    # a null side returns at once, so equal pairs cost no alignment
    none = F.array().cast("array<string>")
    differs = F.when(F.col("src_tokens") != F.col("tgt_tokens"), F.col("src_tokens"))
    refined = tokens.withColumn("_ops", sequence.align_ops()(differs, F.col("tgt_tokens"), none if verb is None else verb))
    edits = F.coalesce(
        ops_to_edits(F.col("_ops"), F.col("src_tokens"), F.col("tgt_tokens"), verb),
        F.array().cast(EDIT_TYPE),
    )
    return (
        refined.withColumn("edits", edits)
        .drop("_ops", "_verbs")
        .withColumn("labels", tags.edits_to_labels(F.col("edits"), F.size("src_tokens")))
    )


def delimiter_rejects(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~(tx.sentence_ok(F.col("src")) & tx.sentence_ok(F.col("tgt"))))


def edit_table(annotated: DataFrame, key: str = "pair_id") -> DataFrame:
    """Long form: ``(key, pos, seq, op)``."""
    return annotated.select(key, F.posexplode("edits").alias("seq", "_e")).select(
        key, F.col("_e.pos").alias("pos"), "seq", F.col("_e.op").alias("op")
    )


def labels_from_table(edits: DataFrame, lengths: DataFrame, key: str = "pair_id") -> DataFrame:
    """Dense labels from a long edit table: one row per position from -1.

    Edits travel as two lists per key and block of positions, and meet one row
    per block; the positions are made behind the join.
    """
    at = F.col("pos") + 1
    placed = F.shiftleft(at.cast("bigint"), 32) + F.col("seq")
    listed = edits.groupBy(key, F.shiftright(at, _BLOCK_BITS).alias("_block")).agg(
        F.collect_list(placed).alias("at"), F.collect_list(F.coalesce("op", F.lit(_NULL))).alias("op")
    )
    ordered = F.sort_array(F.arrays_zip("at", "op"))
    n = F.col("n_tokens")
    numbers = F.sequence(F.lit(0), F.shiftright(n, _BLOCK_BITS))
    blocks = lengths.filter(n >= 0).select(key, "n_tokens", F.explode(numbers).alias("_block"))
    first = F.shiftleft("_block", _BLOCK_BITS)  # the position before the block's own, plus one
    inside = F.filter(ordered, lambda e: F.shiftright(e["at"], 32) <= n)
    own = F.transform(inside, lambda e: _edit(F.shiftright(e["at"], 32) - 1 - first, F.nullif(e["op"], F.lit(_NULL))))
    labels = tags.edits_to_labels(
        F.coalesce(own, F.array().cast(EDIT_TYPE)), F.least(n - first, F.lit((1 << _BLOCK_BITS) - 1))
    )
    return (
        blocks.join(listed, [key, "_block"], "left")
        .select(key, "_block", F.posexplode(labels).alias("_i", "ops"))
        .select(key, (first + F.col("_i") - 1).alias("pos"), "ops")
    )


def edit_kind(op: Column) -> Column:
    """Tag without its word."""
    return F.regexp_replace(op, r"^(\$APPEND|\$REPLACE|\$TRANSFORM_VERB)[_-](?s:.*)$", "$1")


def edit_histogram(annotated: DataFrame) -> DataFrame:
    """Occurrences of each kind of edit, over all label positions."""
    return (
        annotated.select(F.explode(F.flatten("labels")).alias("op"))
        .groupBy(edit_kind(F.col("op")).alias("op"))
        .agg(F.count("*").alias("n"))
    )
