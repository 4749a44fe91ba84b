"""Chat formatting: schema fingerprints select mappings to canonical turns.

A record is JSON of any known layout (a turn per row, prompt and answer,
instruction with input, message lists, shares). The set of its nested field
paths, sorted and hashed, is its fingerprint; a table from fingerprint to a
declarative mapping (paths of role and text, or the role each field plays)
converts it. New layouts are new rows of ``LAYOUTS``, not code.

The template marks turns as ``### role: text</turn>`` and a line feed. Inside roles and
texts ``\\``, ``#``, ``<`` and ``: `` are escaped, so no marker can occur in them and
``unescape(escape(x)) = x`` for every string. The loss mask is the list of
(start, length) spans of the assistant's escaped texts, in code points.

DataFrame functions only; one shuffle by conversation, after which a
conversation is one row (it is one output string).

Defined results: null texts and roles are empty; turns are ordered by number,
then role and text (ties and repeated rows all stay); a null turn comes first;
rows with a null conversation id form one conversation; records of an unknown
layout go to ``unknown``; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.collections import bind, index_range

MARK, END = "### ", "</turn>\n"
ANSWERS = "assistant"
#: What a marker starts with or a role ends at, and the letter that stands for it after a backslash.
CODES = {"#": "h", "<": "l", ": ": "c"}

#: layout -> field paths and how they become turns: (role path or fixed role, text path) per
#: turn; a list layout names the array and its role and text fields.
LAYOUTS = {
    "turn_row": (["conv_id", "role", "text", "turn"], [("$.role", "$.text")]),
    "prompt_completion": (["completion", "prompt"], [("=user", "$.prompt"), ("=assistant", "$.completion")]),
    "prompt_response": (["prompt", "response"], [("=user", "$.prompt"), ("=assistant", "$.response")]),
    "question_answer": (["answer", "question"], [("=user", "$.question"), ("=assistant", "$.answer")]),
    "instruction": (["instruction", "output"], [("=user", "$.instruction"), ("=assistant", "$.output")]),
    "instruction_input": (["input", "instruction", "output"], [("=user", "$.instruction+$.input"), ("=assistant", "$.output")]),
    "messages": (["messages[]", "messages[].content", "messages[].role"], ("$.messages", "role", "content")),
    "shares": (["conversations[]", "conversations[].from", "conversations[].value"], ("$.conversations", "from", "value")),
}
#: Role names of known layouts and their canonical form.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Column) -> Column:
    """Hash of a set of nested field paths."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)


def field_paths(record: Column) -> Column:
    """Nested field paths of a JSON object: its keys, and below a key that holds
    an array ``key[]`` and the keys of the array's first object."""

    def of(key: Column) -> Column:
        inner = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("'][0]")))
        nested = F.transform(F.coalesce(F.json_object_keys(inner), F.array().cast("array<string>")), lambda k: F.concat(key, F.lit("[]."), k))
        return F.when(inner.isNotNull(), F.concat(F.array(F.concat(key, F.lit("[]"))), nested)).otherwise(F.array(key))

    return F.flatten(F.transform(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), of))


def mappings(spark: SparkSession) -> DataFrame:
    """``fingerprint, layout``: one row per known layout."""
    rows = [(name, paths) for name, (paths, _) in LAYOUTS.items()]
    return spark.createDataFrame(rows, "layout string, paths array<string>").select("layout", fingerprint(F.col("paths")).alias("fingerprint"))


def _turns(record: Column, layout: Column) -> Column:
    kind = "array<struct<role:string,text:string>>"
    out = F.lit(None).cast(kind)
    text = lambda path: F.coalesce(F.get_json_object(record, path), F.lit(""))
    for name, (_, how) in LAYOUTS.items():
        if isinstance(how, tuple):
            path, role, content = how
            items = F.from_json(F.get_json_object(record, path), f"array<struct<`{role}`:string,`{content}`:string>>")
            turns = F.transform(items, lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(x[content], F.lit("")).alias("text")))
        else:
            parts = []
            for role, path in how:
                pieces = [text(p) for p in path.split("+")]
                joined = pieces[0] if len(pieces) == 1 else F.concat_ws("\n", *[F.when(p != "", p) for p in pieces])
                parts.append(F.struct((F.lit(role[1:]) if role[0] == "=" else text(role)).alias("role"), joined.alias("text")))
            turns = F.array(*parts)
        out = F.when(layout == name, turns.cast(kind)).otherwise(out)
    return out


def canonical(records: DataFrame, record_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """Adds ``turns`` (canonical roles and texts) to JSON records; second table:
    the records of no known layout. The mapping table has a row per layout."""
    printed = records.withColumn("fingerprint", fingerprint(field_paths(F.col(record_col))))
    known = printed.join(F.broadcast(mappings(records.sparkSession)), "fingerprint", "left")
    turns = _turns(F.col(record_col), F.col("layout"))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    listed = F.col("layout").isin([n for n, (_, how) in LAYOUTS.items() if isinstance(how, tuple)])
    renamed = F.transform(turns, lambda t: F.struct(F.coalesce(F.when(listed, F.element_at(names, t["role"])), t["role"]).alias("role"), t["text"].alias("text")))
    return known.filter("layout is not null").withColumn("turns", renamed), known.filter("layout is null").drop("layout")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in CODES.items():
        out = F.replace(out, F.lit(plain), F.lit(f"\\{code}"))
    return out


def unescape(text: Column) -> Column:
    """Split at escaped backslashes (read left to right), undo the rest, join."""
    parts = F.split(text, r"\\\\", -1)

    def plain(part: Column) -> Column:
        for char, code in CODES.items():
            part = F.replace(part, F.lit(f"\\{code}"), F.lit(char))
        return part

    return F.array_join(F.transform(parts, plain), "\\")


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from rows ``conv_id, turn, role, text``."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_t"))
    head = lambda t: F.concat(F.lit(MARK), escape(t["role"]), F.lit(": "))
    pieces = F.transform(
        "_t",
        lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == ANSWERS).alias("loss")),
    )
    held = held.select("conv_id", pieces.alias("_p"))
    string = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    ends = running(F.transform("_p", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END)))

    def spans(e: Column) -> Column:
        every = F.transform(
            "_p",
            lambda p, k: F.struct(
                (F.get(e, k) - len(END) - F.char_length(p["body"])).alias("start"), F.char_length(p["body"]).cast("bigint").alias("length"), p["loss"].alias("loss")
            ),
        )
        return F.transform(F.filter(every, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    return held.select("conv_id", string.alias("formatted"), bind(ends, spans).alias("loss_spans"))


_STEP = 256


def running(sizes: Column) -> Column:
    """Inclusive running sums. Sums of blocks come first, so no array is copied
    once per element."""

    def blocks(a: Column) -> Column:
        chunk = lambda b: F.slice(a, b * _STEP + 1, _STEP)
        numbers = index_range(F.ceil(F.size(a) / _STEP).cast("int"))
        total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + y)
        sums = F.transform(numbers, lambda b: total(chunk(b)))

        def joined(s: Column) -> Column:
            def one(b: Column) -> Column:
                own = lambda c: F.transform(c, lambda _, k: total(F.slice(c, F.lit(1), k + 1)) + total(F.slice(s, F.lit(1), b)))
                return bind(chunk(b), own)

            return F.flatten(F.transform(numbers, one))

        return bind(sums, joined)

    return bind(sizes, blocks)


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``loss_text`` (unescaped) read from the output alone."""
    parts = F.filter(F.split("formatted", END, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, ": ", 1)
        return F.struct(
            unescape(F.substring(role, F.lit(len(MARK) + 1), F.char_length(role))).alias("role"),
            unescape(F.substring(p, F.char_length(role) + 3, F.char_length(p))).alias("text"),
        )

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(masked, ""))
