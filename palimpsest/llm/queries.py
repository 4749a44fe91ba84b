"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, exact_dedup, fill_middle, licenses, mixing, near_dedup, packing, periodic, privacy, quality, sharding, substring_dedup, suffix_dedup
from .common import WORD, documents, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query(
    rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
    r AS (SELECT *, cap / weight AS room FROM w),
    l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
    o AS (SELECT arg_min(lev, (room, lev)) AS lev FROM l WHERE lev <= room),
    t AS (SELECT source, source_size, least(cap, coalesce(o.lev * weight, cap)) AS target FROM l LEFT JOIN o ON true),
    q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
    h AS (SELECT d.doc_id, d.size, q.*, seed, CASE WHEN ('0x' || substr(md5(seed || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT
      < (rate - floor(rate)) * 281474976710656.0::DOUBLE THEN 1 ELSE 0 END AS extra
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source CROSS JOIN (SELECT range AS seed FROM range(16)) z),
    b AS (SELECT source, seed, abs(sum(size * extra)::DOUBLE - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS miss FROM h GROUP BY source, seed),
    p AS (SELECT source, arg_min(seed, (miss, seed)) AS seed FROM b GROUP BY source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + extra))::BIGINT AS taken FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source AND h.seed = p.seed"""
)
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes, and its source's target."""
    sized, sources = mixing.rates(documents(spark, folder))
    counted = mixing.with_source(mixing.copies(sized, sources), sources.select("source", "source_size", "target"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).cast("bigint").alias("taken"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE w IS NOT NULL),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    k AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT a, min(b) AS low FROM reach GROUP BY a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""
)
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.groups(documents(spark, folder))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.text) AS text_sha256 FROM d JOIN g ON d.text = g.text"""
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Owner and size of each document's group of equal texts."""
    return exact_dedup.report(documents(spark, folder))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece in sequences of 2048 tokens."""
    return packing.pack(documents(spark, folder), tokenizer_path())


def _quality_sql() -> str:
    """The rules of ``quality`` in SQL, from the same fixed values."""
    space = quality.PROSE["space"]
    among = {n: f"{n}::DOUBLE / (n_chars - space) * {1 - space!r}::DOUBLE" for n in (*quality.CLASSES, "rest")} | {"space": f"{space!r}::DOUBLE"}
    shares = [f"(CASE WHEN wide THEN {among[n]} ELSE {n}::DOUBLE / n_chars END)" for n in (*quality.CLASSES, "rest")]

    def distance(p: list[str], q: list[float]) -> str:
        part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * ln({x} * 2 / ({x} + {y})) ELSE 0 END"
        terms = " + ".join(f"{part(x, f'{y}::DOUBLE')} + {part(f'{y}::DOUBLE', x)}" for x, y in zip(p, q))
        return f"sqrt(greatest({terms}, 0) / (2 * ln(2)))"

    def literal(chars: str) -> str:
        return " || ".join(f"chr({ord(c)})" for c in chars)

    counted = ", ".join(f"length(t) - length(translate(t, {literal(chars)}, '')) AS {name}" for name, chars in quality.CLASSES.items())
    listed = ", ".join(f"len(list_filter(w, lambda x: x IN ('{w}', '{w.capitalize()}', '{w.upper()}'))) AS w_{w}" for w in quality.LISTED)
    nearest = ", ".join(
        distance(
            [*(f"(w_{w}::DOUBLE / n_words)" for w in lang), "((n_words - " + " - ".join(f"w_{w}" for w in lang) + ")::DOUBLE / n_words)"],
            [*lang.values(), 1 - sum(lang.values())],
        )
        for lang in quality.COMMON.values()
    )
    absent = []
    for lang in quality.COMMON.values():
        hits, forms = " + ".join(f"w_{w}" for w in lang), " + ".join(f"(w_{w} > 0)::INT" for w in lang)
        absent.append(f"({quality.LISTED_SHARE} * ({hits}) < n_words OR ({forms} < {quality.LISTED_FORMS} AND {quality.LONE_SHARE} * ({hits}) < n_words))")
    unlisted = f"({quality.SYMBOL_SHARE} * symbol < n_words AND {' AND '.join(absent)})"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
    m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM m) GROUP BY 1),
    l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
    c AS (SELECT d.doc_id, len(w) AS n_words, length(t) AS n_chars, octet_length(encode(t)) >= {quality.WIDE} * length(t) AS wide, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {counted}, {listed}
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id),
    f AS (SELECT *, n_chars - upper - digit - space - stop - symbol AS rest FROM c),
    j AS (SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words) AS base_failed,
      CASE WHEN n_chars >= {quality.JUDGED_CHARS} THEN {distance(shares, list(quality.PROSE.values()))} ELSE 0 END AS char_distance,
      CASE WHEN n_words >= {quality.JUDGED_WORDS} THEN least({nearest}) ELSE 0 END AS word_distance FROM f)
    SELECT doc_id, n_words::BIGINT AS n_words, (n_chars - space)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
      n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed AND char_distance <= {quality.MAX_CHAR_DISTANCE} AND (word_distance <= {quality.MAX_WORD_DISTANCE} OR {unlisted}) AS kept FROM j"""


@query(_quality_sql())
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdicts of the quality rules for every document."""
    return quality.report(documents(spark, folder)).drop("char_distance", "word_distance")


@query()
def op3_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.interleave(documents(spark, folder)).drop("source")


def _license_sql() -> str:
    base = " ".join(
        f"WHEN {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(phrase.split()))} THEN '{label}'"
        for phrase, label in licenses.BASE.items()
    )
    known = ", ".join(f"'{k}'" for k in licenses.keywords())
    return rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    rules(keyword, regex, label, priority, certainty, number) AS (VALUES {licenses.rules_sql()}),
    h AS (SELECT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN ({known})),
    b AS (SELECT * FROM (SELECT doc_id, i - 1 AS pos, CASE {base} END AS label FROM h) WHERE label IS NOT NULL),
    f AS (SELECT doc_id, i - 1 AS s, i - 1 + length(regexp_replace(regexp_extract(' ' || array_to_string(w[i:i + {licenses.SPAN - 1}], '  ') || ' ', regex), '[^ ]', '', 'g')) // 2 AS e, label, priority, certainty, number
      FROM h JOIN rules ON keyword = w[i]),
    x AS (SELECT * FROM f WHERE e > s),
    k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND y.e >= x.e
      AND (y.priority < x.priority OR (y.priority = x.priority AND (y.e - y.s > x.e - x.s OR (y.e - y.s = x.e - x.s AND y.number < x.number)))))),
    bb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY 1),
    ll AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(certainty) AS score FROM (SELECT doc_id, label, certainty FROM k UNION ALL SELECT doc_id, label, 0.6 FROM b) GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN bb ON bb.doc_id = d.doc_id LEFT JOIN ll ON ll.doc_id = d.doc_id"""


@query(_license_sql())
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan(documents(spark, folder)).drop("detections")


_TRICKY = "\\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace(replace({0}, '\', '\\'), '#', '\h'), '<', '\l'), ': ', '\c')"


@query(
    f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 14)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""
)
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests read back from the formatted conversations."""
    given = spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], "conv_id bigint, turn int, role string, text string")
    rows = given.unionByName(tricky)
    record = F.to_json(F.struct("conv_id", "role", "text", "turn"), {"ignoreNullFields": "false"})
    known, _ = chat.canonical(rows.select("conv_id", "turn", record.alias("record")))
    turns = known.select("conv_id", "turn", F.explode("turns").alias("t")).select("conv_id", "turn", "t.role", "t.text")
    back = chat.read_back(chat.formatted(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query(
    rf"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id),
    c AS (SELECT DISTINCT doc_id, i + k AS i FROM m CROSS JOIN (SELECT range AS k FROM range(13)) r),
    s AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
      sha256(array_to_string(list_filter(w, lambda x, j: gone IS NULL OR NOT list_contains(gone, j)), ' ')) AS kept_sha256
    FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""
)
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What substring dedup leaves of every document."""
    left = substring_dedup.remove_repeats(documents(spark, folder))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What suffix dedup leaves of every document."""
    left = suffix_dedup.remove_repeats(documents(spark, folder))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: crc32 of the decimal id in SQL: the table by its rule, then one step a digit.
_CRC = """t AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
    c AS (SELECT doc_id, text, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM documents, t)"""


@query(
    rf"""WITH {_CRC},
    o AS (SELECT doc_id, h, coalesce({_WORDS}, []) AS w FROM c),
    v AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
    p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM v),
    d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) END AS w FROM p),
    g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d)),
    e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
    f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
    s AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 6 + q AS len FROM f GROUP BY doc_id, q, island HAVING max(i) - min(i) + 6 >= q AND max(i) - min(i) + 6 + q >= 12),
    r AS (SELECT doc_id, s, len, min(q) AS q FROM s GROUP BY doc_id, s, len),
    m AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'s': s, 'len': len, 'q': q}}, (len, -s, -q)) AS best,
      string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
    x AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + len)) AS i FROM r) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
      (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
      sha256(array_to_string(list_filter(w, lambda y, k: gone IS NULL OR NOT list_contains(gone, k - 1)), ' ')) AS collapsed_sha256
    FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"""
)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, a tenth of which are made periodic first."""
    given = documents(spark, folder).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & (word_count(F.col("text")) > 0)
    words = given.select("doc_id", "text", "h", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    turns = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")
    runs = periodic.find_runs(words.select("doc_id", F.when(F.col("w").isNotNull(), changed).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    digests = runs.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = (F.col(f"best.{name}") for name in ("length", "start", "period"))
    return digests.select(
        "doc_id",
        "n_runs",
        (-start).alias("start"),
        length.alias("length"),
        (-period).alias("period"),
        F.floor(1000 * length / -period).cast("bigint").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def _private_sql() -> str:
    """Spans and disclosures in SQL. Places of matches: marks are put around them,
    the text is split at the marks, and the lengths of the pieces are summed up."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def places(source: str, pattern: str) -> str:
        return rf"""(SELECT doc_id, string_split(piece, chr(2))[1] AS m, first + length(string_split(piece, chr(2))[1]) AS last, first FROM (
          SELECT doc_id, k, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (k - 2))::BIGINT AS first FROM (
          SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (
          SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM {source}))) WHERE k > 1)"""

    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda x, k: CASE WHEN k % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN x::INT * 2 - 9 ELSE x::INT * 2 END)) % 10 = 0"
    keep = {
        "email": ("lower(m)", "true"),
        "ip": ("m", "list_bool_and(list_transform(string_split(m, '.'), lambda x: x::HUGEINT <= 255))"),
        "card": (digits, f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        "phone": (digits, f"length({digits}) BETWEEN 9 AND 15"),
    }
    base = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, first, last, '{kind}:' || {keep[kind][0]} AS entity FROM {places('d', patterns[kind])} WHERE {keep[kind][1]}"
        for k, kind in enumerate(privacy.KINDS)
    )
    lowered = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in privacy.KINDS)
    shown = ", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in privacy.KINDS)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    b AS MATERIALIZED ({base}),
    bd AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM b)),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS i FROM {places('bd', privacy.TERM)} x
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.first < x.last AND b.last > x.first)),
    k AS (SELECT b.doc_id, entity, b.first, count(w.i) AS k FROM b LEFT JOIN w ON w.doc_id = b.doc_id AND w.first < b.first GROUP BY ALL),
    near AS MATERIALIZED (SELECT DISTINCT w.doc_id, entity, {lowered.replace('(t,', '(m,')} AS term, w.first, w.last FROM k JOIN w ON w.doc_id = k.doc_id AND i >= k - {privacy.WINDOW} AND i < k + {privacy.WINDOW}),
    pairs AS (SELECT entity, term, count(DISTINCT near.doc_id) AS n_both FROM near JOIN d ON d.doc_id = near.doc_id GROUP BY entity, term HAVING count(DISTINCT t) >= {privacy.TEXTS}),
    ent AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM b GROUP BY entity),
    tc AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(regexp_extract_all({lowered}, '{privacy.TERM}'))) AS term FROM d) GROUP BY term),
    n AS (SELECT ln(count(*)) AS n FROM d),
    dis AS (SELECT entity, term FROM pairs JOIN ent USING (entity) JOIN tc USING (term), n WHERE n > ln(n_entity) AND (n + ln(n_both) - ln(n_entity) - ln(n_term)) / (n - ln(n_entity)) >= {privacy.GENERALISE}),
    terms AS (SELECT doc_id, string_agg('term:' || first || ':' || last, ',' ORDER BY first) AS listed FROM (SELECT DISTINCT doc_id, first, last FROM near SEMI JOIN dis USING (entity, term)) GROUP BY doc_id),
    per AS (SELECT doc_id, {counts}, string_agg(kind || ':' || first || ':' || last, ',' ORDER BY rank, first) AS listed FROM b GROUP BY doc_id)
    SELECT d.doc_id, {shown}, sha256(coalesce(per.listed, '')) AS base_sha256, concat_ws(',', per.listed, terms.listed) AS spans
    FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN terms ON terms.doc_id = d.doc_id"""


@query(_private_sql())
def op12_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: identifiers, and the terms that disclose them."""
    found = privacy.spans(documents(spark, folder))
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(privacy.KINDS) for x in (kind, k)))
    ordered = F.array_sort(F.transform("base", lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    base = F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = (F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("bigint").alias(f"n_{kind}") for kind in privacy.KINDS)  # noqa: B023
    listed = found.select("doc_id", *counts, base.alias("base"), terms.alias("terms"))
    return listed.select(
        "doc_id",
        *(f"n_{kind}" for kind in privacy.KINDS),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", "terms"), ",").alias("spans"),
    )


@query(
    r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS d FROM documents),
    l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
      ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM h),
    c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
    p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM p"""
)
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and restored."""
    return fill_middle.restore(fill_middle.transform(documents(spark, folder)), digest_only=True)
