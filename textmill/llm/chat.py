r"""Chat formatting: layouts found by fingerprints of field paths and chosen for each record, one template, reversible escapes and a loss mask.

Everything is an expression or a grouping; no Python runs on rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, NumericType, StringType, StructType

TURN_START, ROLE_END, TURN_END = "<|turn|>", "\n", "<|end|>\n"
#: Strings that chat templates use for control; none of them stays readable inside a text or role.
CONTROL_STRINGS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record lie: an array with a role and a text field, fields that are a turn each, or the record is one turn.

    `paths` are the field paths the layout needs; `fields` maps a role to the fields whose texts, joined by an empty line,
    are its turn. A turn whose fields are all null or empty is no turn in this form. `turn` is the
    column that numbers the turns if a record is one.
    """

    paths: tuple[str, ...]
    array: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turn: str = ""


def _pairs(prompt: str, answer: str, *more: str) -> Layout:
    return Layout((prompt, *more, answer), fields=(("user", (prompt, *more)), ("assistant", (answer,))))


LAYOUTS = (
    Layout(("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout(("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout(("turns[].role", "turns[].text"), "turns", "role", "text"),
    Layout(("dialog[].speaker", "dialog[].utterance"), "dialog", "speaker", "utterance"),
    Layout(("turn", "role", "text"), role="role", text="text", turn="turn"),
    Layout(("system", "prompt", "response"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    _pairs("instruction", "output", "input"),
    _pairs("instruction", "output"),
    _pairs("instruction", "response", "context"),
    _pairs("prompt", "completion"),
    _pairs("prompt", "response"),
    _pairs("question", "answer"),
)


def field_paths(schema: StructType) -> list[str]:
    """Paths of all leaves; `[]` marks the elements of an array."""

    def walk(kind, path: str) -> list[str]:
        if isinstance(kind, ArrayType):
            return walk(kind.elementType, path + "[]")
        if isinstance(kind, StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
        return [path]

    return sorted(walk(schema, ""))


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def find_layouts(schema: StructType) -> list[Layout]:
    """All layouts whose fingerprint is that of the same paths in the schema, those with the most paths first; other fields don't matter."""
    paths = set(field_paths(schema))
    found = (BY_FINGERPRINT.get(fingerprint([p for p in layout.paths if p in paths])) for layout in LAYOUTS)
    layouts = sorted((layout for layout, met in zip(LAYOUTS, found) if met is layout), key=lambda x: -len(x.paths))
    if not layouts:
        raise ValueError(f"no layout for the fields {sorted(paths)}")
    return layouts


def find_layout(schema: StructType) -> Layout:
    """The layout with the most paths of those the schema has."""
    return find_layouts(schema)[0]


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _present(layout: Layout, path: str) -> Column:
    """Whether a record holds something other than empty text at a path of the layout."""
    if layout.array:
        return F.coalesce(F.exists(F.col(layout.array), lambda t: _text(t[path.split("[].")[1]]) != ""), F.lit(False))
    return _text(F.col(path)) != ""


def _holds_text(column: Column, kind: DataType) -> Column:
    """Whether there is text anywhere in a value."""
    if isinstance(kind, StringType):
        return F.coalesce(column != "", F.lit(False))
    if isinstance(kind, MapType):
        return _holds_text(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(column, lambda x: _holds_text(x, kind.elementType)), F.lit(False))
    if isinstance(kind, StructType):
        return reduce(Column.__or__, (_holds_text(column[f.name], f.dataType) for f in kind.fields), F.lit(False))
    return F.lit(False)


def _choice(layouts: list[Layout]) -> Column:
    """The place of the record's own layout in `layouts`, null if it has none.

    Complete layouts, which hold something at all their paths, go before others, then those that hold something at more paths, then the
    earlier ones. An array with elements counts even if these are empty.
    """
    scores = []
    for place, layout in enumerate(layouts):
        held = reduce(Column.__add__, (_present(layout, p).cast("int") for p in layout.paths))
        some = F.coalesce(F.size(layout.array) > 0, F.lit(False)) if layout.array else held > 0
        scores.append(F.when(some, F.struct((held == len(layout.paths)).alias("complete"), held.alias("held"), F.lit(-place).alias("place"))))
    return -F.array_max(F.array(*scores))["place"]


def _turns(layout: Layout, number: DataType) -> Column:
    """The turns of a record of the layout: an array of turn, role and text."""
    if layout.turn:
        return F.array(F.struct(F.col(layout.turn).alias("turn"), _text(F.col(layout.role)).alias("role"), _text(F.col(layout.text)).alias("text")))
    if layout.array:
        turns = F.transform(F.col(layout.array), lambda t: F.struct(_text(t[layout.role]).alias("role"), _text(t[layout.text]).alias("text")))
    else:
        made = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(_text(F.col(c)) for c in columns)), lambda x: x != ""),
                                                                 "\n\n").alias("text")) for role, columns in layout.fields]
        turns = F.filter(F.array(*made), lambda t: t["text"] != "")
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.transform(turns, lambda t, i: F.struct(i.cast(number).alias("turn"), F.coalesce(names[t["role"]], t["role"]).alias("role"),
                                                    t["text"].alias("text")))


def canonical_turns(records: DataFrame, id_col: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """id_col, turn (from 0), role and text of each turn, whatever the layout. Null roles and texts are empty.

    Records may have different layouts: each is read by the one, of those that the schema has, of which it holds the most, as
    `_choice` says. Other fields of it don't matter. A record without any layout that holds text in a column other than the id and
    the `ignored` ones fails the job, so no conversation is lost unseen; without text it gives no turn. Where rows by turn are one of the
    layouts, a row of nulls is a turn, too, as it may be one of theirs.

    Role names of nested layouts become system, user and assistant; unknown ones stay. Rows by turn keep
    their turn numbers and their roles. The id of a nested record should not repeat: the turns of equal ids become one
    conversation, ordered as `format_turns` does.
    """
    layouts = find_layouts(records.schema)
    number = next((records.schema[x.turn].dataType for x in layouts if x.turn), IntegerType())
    if len(layouts) > 1 and not isinstance(number, NumericType):
        raise ValueError(f"turns are numbered by {number.simpleString()}, which can't number those of the other layouts")
    if len(layouts) == 1 and layouts[0].turn:
        turns = _turns(layouts[0], number)
    else:
        texts = [_holds_text(F.col(f"`{f.name}`"), f.dataType) for f in records.schema.fields if f.name not in (id_col, *ignored)]
        lost = F.raise_error(F.concat(F.lit("no layout for the record "), _text(F.col(id_col))))
        made = [_turns(layout, number) for layout in layouts]
        without = F.col("_layout").isNull()
        turns = F.when(without & reduce(Column.__or__, texts, F.lit(False)), lost)
        for place, (layout, array) in enumerate(zip(layouts, made)):
            nulls = without & reduce(Column.__and__, (F.col(x.array).isNull() for x in layouts if x.array), F.lit(True))
            turns = turns.when((F.col("_layout") == place) | nulls if layout.turn else F.col("_layout") == place, array)
        records = records.withColumn("_layout", _choice(layouts))
    return records.select(F.col(id_col), F.explode(turns).alias("t")).select(id_col, "t.turn", "t.role", "t.text")


def escape(text: Column) -> Column:
    r"""`\` becomes `\\`; a control string's first character becomes `\l` or `\b`, so it can't be read as one."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL_STRINGS:
        out = F.replace(out, F.lit(control), F.lit(("\\l" if control[0] == "<" else "\\b") + control[1:]))
    return out


def unescape(text: Column) -> Column:
    r"""The inverse of `escape` and `escape_role`: parts between `\\` hold the other escapes only."""
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(
        p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n")))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(parts, "\\")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """id_col, formatted, n_turns and loss_spans, an array of (start, length) in code points, for each conversation.

    A conversation is its turns ordered by turn, role and text; repeated rows are turns of their own, a null turn number comes first.
    Each is written as `<|turn|>`, role, line end, text, `<|end|>`, line end, with control strings escaped. The loss
    mask covers the texts of `loss_role` and nothing else; an empty one has a span of length 0. Null roles and texts are
    empty; a null id is a conversation of its own; an empty table gives no rows; other columns are not read. A conversation
    becomes one value, so it passes one task, as its output does.
    """
    role, text = _text(F.col(role_col)), _text(F.col(text_col))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                        F.concat(F.lit(TURN_START), escape_role(role), F.lit(ROLE_END)).alias("head"), escape(text).alias("body"))
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    sizes = F.char_length("head") + F.char_length("body") + len(TURN_END)
    end = F.sum(sizes).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(order)
    placed = rows.withColumns({"place": place, "end": end})
    piece = F.concat("head", "body", F.lit(TURN_END))
    span = F.when(F.col("role") == loss_role, F.struct(
        (F.col("end") - len(TURN_END) - F.char_length("body")).alias("start"), F.char_length("body").cast("long").alias("length")))
    made = placed.select("id", F.struct("place", piece.alias("piece"), span.alias("span")).alias("t")).groupBy("id").agg(
        F.array_sort(F.collect_list("t")).alias("ts"))
    return made.select(
        F.col("id").alias(id_col), F.array_join(F.col("ts.piece"), "").alias("formatted"), F.size("ts").cast("long").alias("n_turns"),
        F.filter(F.col("ts.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def format_records(records: DataFrame, id_col: str, ignored: tuple[str, ...] = (), **names) -> DataFrame:
    """Conversations of any known layouts, also of several in one table, formatted."""
    return format_turns(canonical_turns(records, id_col, ignored), id_col, **names)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) back from a formatted conversation; escaped text holds no mark, so splitting is exact."""
    pieces = F.split(formatted, TURN_START.replace("|", "\\|"), -1)
    return F.transform(F.slice(pieces, 2, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(p, ROLE_END, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, ROLE_END) + 1, F.char_length(p) - F.instr(p, ROLE_END) - len(TURN_END))).alias("text")))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
