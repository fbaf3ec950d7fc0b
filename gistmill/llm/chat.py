"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record may be a row of role and text, a list of messages, a prompt with its
completion, an instruction with its input and output, and so on.  The nested field
paths that a record has, in all elements of its lists and to a given depth of names, each with the kind of value that it holds
(text, list or object), are hashed to a fingerprint, which selects the mapping of a declared layout; the mapping turns the record into
canonical turns.  Fields that tell nothing of the turns are no part of a fingerprint: those named in ``METADATA``, and numbers, truth values
and nulls that no layout reads.  Any other field makes a fingerprint that no layout has, so a record is never mapped with a text left out
or with a list in the place of a text.  The turns of a conversation are put in order and marked by a template:

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

Inside texts and roles, each run ``<``, backslashes, ``|`` gets one more backslash, so
that no control string of the template can occur there, and texts without such a run
stay as they are.  In roles, line feeds are escaped, too.  ``parse`` reads turns back.

A conversation's rows are first joined by blocks of ``BLOCK`` turn numbers and then by
conversation, so only finished blocks of text meet in one row.

Defined results: null text and null role count as empty; turns with equal numbers are
ordered by role, then text; a null turn number comes first; records with an unknown
layout, or that are no objects, have no turns and ``layout`` null, and stay in ``canonical_turns`` and ``format_records``; very long texts and
conversations are marked whole;
a field or list element that a layout names and a record lacks counts as empty; rows that repeat a turn are turns of their
own; conversations may have any number of turns; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 64

#: Layouts: field paths that a record has (``[]`` marks a list), and where role and text of its turns lie.
#: Turns are listed as (role, path), where a role that starts with ``$`` is itself a path, or as (list, role, text) for the elements of a list.
LAYOUTS: dict[str, dict] = {
    "turn_row": {"paths": ["role", "text"], "turns": [("$role", "text")]},
    "content_row": {"paths": ["content", "role"], "turns": [("$role", "content")]},
    "messages": {"paths": ["messages[].content", "messages[].role"], "turns": [("messages", "role", "content")]},
    "speakers": {"paths": ["conversations[].from", "conversations[].value"], "turns": [("conversations", "from", "value")]},
    "instruction": {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"paths": ["input", "instruction", "output"], "turns": [("user", "instruction+input"), ("assistant", "output")]},
    "prompt_completion": {"paths": ["completion", "prompt"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "question_answer": {"paths": ["answer", "question"], "turns": [("user", "question"), ("assistant", "answer")]},
    "prompt_completion_messages": {
        "paths": ["completion[].content", "completion[].role", "prompt[].content", "prompt[].role"], "turns": [("prompt", "role", "content"), ("completion", "role", "content")],
    },
    "prompt_messages": {"paths": ["completion", "prompt[].content", "prompt[].role"], "turns": [("prompt", "role", "content"), ("assistant", "completion")]},
    "prompt_response_messages": {"paths": ["prompt[].content", "prompt[].role", "response"], "turns": [("prompt", "role", "content"), ("assistant", "response")]},
}
#: Names of fields, at any depth, that hold nothing of a conversation.
METADATA = ["conv_id", "conversation_id", "created_at", "dataset", "id", "lang", "language", "metadata", "model", "name", "source", "timestamp", "url", "weight"]
#: Names for the same role.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Names in a row that a fingerprint follows.
DEPTH = 3


def _at(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def _kind(value: Column) -> Column:
    """A mark for what a variant holds: text, list, object, other values, or null."""
    said = F.schema_of_variant(value)
    return F.coalesce(F.when(said == "STRING", ":t").when(F.startswith(said, F.lit("ARRAY")), ":l").when(F.startswith(said, F.lit("OBJECT")), ":o").when(said != "VOID", ":v"), F.lit(":z"))


def _names(value: Column, path: Column, depth: int) -> Column:
    """Paths of the fields of an object, and of what they hold, with their kinds."""
    held = lambda e: F.concat(path, e["key"])
    own = lambda e: F.array(F.concat(held(e), _kind(e["value"])))
    each = lambda e: F.concat(own(e), _under(e["value"], held(e), depth - 1)) if depth > 1 else own(e)
    return F.flatten(F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), each))


def _under(value: Column, path: Column, depth: int) -> Column:
    """Paths below a value: of its fields if it is an object, of its elements' fields if it is a list; elements that are no objects count themselves."""
    none = F.array().cast("array<string>")
    item = lambda x: F.coalesce(_names(x, F.concat(path, F.lit("[].")), depth), F.array(F.concat(path, F.lit("[]"), _kind(x))))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), item)
    return F.concat(F.coalesce(_names(value, F.concat(path, F.lit(".")), depth), none), F.coalesce(F.flatten(items), none))


def field_paths(record: Column, depth: int = DEPTH) -> Column:
    """The nested field paths of a variant that a fingerprint follows, each with the kind of its value, sorted."""
    all_paths = F.array_distinct(F.coalesce(_names(record, F.lit(""), depth), F.array().cast("array<string>")))
    read = F.array(*map(F.lit, sorted({p for x in LAYOUTS.values() for p in _declared(x)})))
    name = lambda p: F.substr(p, F.lit(1), F.length(p) - 2)
    silent = lambda p: p.rlike(":[vz]$")
    # values and nulls count as texts where a layout reads a text
    as_text = F.transform(all_paths, lambda p: F.when(silent(p) & F.array_contains(read, F.concat(name(p), F.lit(":t"))), F.concat(name(p), F.lit(":t"))).otherwise(p))
    aside = rf"(^|\.)({'|'.join(METADATA)})(\[\])?[.:]"
    return F.array_sort(F.array_distinct(F.filter(as_text, lambda p: ~silent(p) & ~p.rlike(aside))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "|"))


def layout_of(paths: Column) -> Column:
    """The name of the layout that a record with these field paths has; null for none."""
    marks = [(F.lit(name), F.xxhash64(F.lit("|".join(_declared(x))))) for name, x in LAYOUTS.items()]
    return F.element_at(F.create_map(*[x for name, mark in marks for x in (mark, name)]), fingerprint(paths))


def _declared(layout: dict) -> list[str]:
    """A layout's paths and those of the lists they lie in, with their kinds."""
    return sorted({*(f"{p}:t" for p in layout["paths"]), *(f"{p.split('[]')[0]}:l" for p in layout["paths"] if "[]" in p)})


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, role), role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, layout: dict) -> Column:
    def text_of(path: str) -> Column:
        first, *more = path.split("+")
        rest = [F.when(F.coalesce(_at(record, p, "string"), F.lit("")) != "", F.concat(F.lit("\n"), _at(record, p, "string"))) for p in more]
        return F.concat(F.coalesce(_at(record, first, "string"), F.lit("")), *[F.coalesce(x, F.lit("")) for x in rest])

    def part(role: str, *path: str) -> Column:
        if len(path) == 1:
            return F.array(_turn(_role(_at(record, role[1:], "string")) if role[0] == "$" else F.lit(role), text_of(path[0])))
        items = F.coalesce(F.try_variant_get(record, f"$.{role}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(items, lambda x: _turn(_role(_at(x, path[0], "string")), _at(x, path[1], "string")))

    return F.concat(*[part(*x) for x in layout["turns"]])


def canonical_turns(records: DataFrame, record: Column | str, *keep: Column | str, depth: int = DEPTH) -> DataFrame:
    """The ``keep`` columns, ``fingerprint``, ``layout`` and ``turns`` (array of role, text) of each record.

    ``record`` is a variant, or a string of JSON; ``depth`` tells how many names deep a fingerprint looks.
    """
    record = F.col(record) if isinstance(record, str) else record
    kind = records.select(record.alias("x")).dtypes[0][1]
    rows = records.select(*keep, (F.try_parse_json(record) if kind == "string" else record).alias("__record"))
    # generators, so that the optimizer leaves paths and layouts to be computed once for each record
    rows = rows.select("*", F.explode(F.array(field_paths(F.col("__record"), depth))).alias("__paths"))
    rows = rows.select("*", F.explode(F.array(layout_of(F.col("__paths")))).alias("__layout"))
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for name, x in LAYOUTS.items():
        turns = F.when(F.col("__layout") == name, _turns(F.col("__record"), x)).otherwise(turns)
    kept = [x if isinstance(x, str) else F.col(rows.columns[i]) for i, x in enumerate(keep)]
    return rows.select(*kept, fingerprint(F.col("__paths")).alias("fingerprint"), F.col("__layout").alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("&"), F.lit("&a")), F.lit("\n"), F.lit("&n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("&n"), F.lit("\n")), F.lit("&a"), F.lit("&")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of rows of turns: conv_id, n_turns, formatted, loss_spans; see ``format_records``."""
    row = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.to_variant_object(F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("text"))).alias("record"),
    )
    return format_records(row, "record", "conv_id", "turn").drop("n_unknown")


def format_records(records: DataFrame, record: Column | str = "record", conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (array of start, length, nth turn), n_unknown.

    A conversation may lie in several records, in the order of ``turn_col``, each with one turn or more.
    The loss mask covers the texts of assistant turns, and no marks; starts and lengths are code points.
    ``n_unknown`` counts records without turns; a conversation of such records alone is the empty string.
    """
    flat = canonical_turns(records, record, F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"))
    flat = flat.select("conv_id", "turn", F.posexplode_outer("turns").alias("nth", "x"))
    head = F.concat(F.lit(START), escape_role(F.col("x.role")), F.lit("\n"))
    body = escape(F.col("x.text"))
    piece = F.struct(
        F.col("turn"),
        F.col("nth"),
        F.col("x.role").alias("role"),
        F.col("x.text").alias("raw"),
        F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.length(head).alias("head"),
        F.length(body).alias("body"),
    )
    known = F.when(F.col("x").isNotNull(), piece)  # lists leave nulls out
    blocks = flat.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(known), _in_turn).alias("p"), F.count_if(F.col("x").isNull()).alias("unknown")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("nth"), F.array().cast("array<struct<start:bigint,length:bigint,nth:bigint>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        span = F.struct((done["at"] + x["head"]).alias("start"), x["body"].cast("long").alias("length"), done["nth"].alias("nth"))
        return F.struct(
            (done["at"] + F.length(x["piece"])).alias("at"),
            (done["nth"] + 1).alias("nth"),
            F.when(x["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    blocks = blocks.select(
        "conv_id",
        "block",
        F.size("p").alias("n"),
        "unknown",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.aggregate("p", start, step, lambda x: x["spans"]).alias("spans"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"at": F.sum(F.length("formatted")), "nth": F.sum("n")}
    blocks = blocks.withColumns({name: F.coalesce(x.over(before), F.lit(0)) for name, x in sums.items()})
    whole = blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("unknown").alias("n_unknown"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "at",
                    "nth",
                    "formatted",
                    F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length"), (s["nth"] + F.col("nth")).alias("nth"))).alias("spans"),
                )
            )
        ).alias("b"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("b", lambda x: x["spans"])).alias("loss_spans"),
        "n_unknown",
    )


def _in_turn(a: Column, b: Column) -> Column:
    """Order by turn (nulls first), place in the record, role, text."""
    out = F.lit(0)
    for name in ("raw", "role", "nth"):
        out = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(out)
    same = a["turn"].eqNullSafe(b["turn"])
    return F.when(same, out).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).otherwise(1)


def _pieces(formatted: Column) -> Column:
    return F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")


def parse(formatted: Column) -> Column:
    """Turns (array of role, text) read back from a formatted conversation."""

    def turn(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescape_role(F.substr(line, F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(line) + 2)).alias("text"),
        )

    return F.transform(_pieces(formatted), turn)


def masked(chats: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``loss``: all text under the loss mask of ``formatted`` and ``loss_spans``, unescaped, with nothing between.

    A span is read from the end of its own turn, so a conversation of any length is gone through once.
    """
    rows = chats.select("*", F.explode(F.array(_pieces(F.col("formatted")))).alias("__pieces"))  # a generator, so that it is split once

    def under(s: Column) -> Column:
        piece = F.get("__pieces", s["nth"].cast("int"))
        return unescape(F.substr(piece, (F.length(piece) - s["length"] + 1).cast("int"), s["length"].cast("int")))

    return rows.select(*keep, F.array_join(F.transform("loss_spans", under), "").alias("loss"))
