"""Chat records of many layouts to canonical turns, and turns to one training text and back.

Schema fingerprinting: the paths of the nested fields that a record holds are hashed, and the
hash selects a declarative layout, which says where roles and texts lie. Records whose
fingerprint no layout has are kept, without turns and without a layout's name.

A turn is written as `### ROLE: TEXT</turn>` and a line feed. Within roles and texts a backslash
becomes `\\b`, `###` becomes `\\h`, `</turn>` becomes `\\e`, and in roles `:` becomes `\\c`, so
that no text can end a turn or begin one, and every text is read back as it was.

All of it is column expressions: no Python worker runs.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

TURN = "struct<role:string,text:string>"
HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: What stands for control strings; the backslash comes first when escaping and last when reading.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
LOSS_ROLES = ("assistant",)


@dataclass(frozen=True)
class Each:
    """Turns of a list of structs."""

    items: str
    role: str
    text: str


@dataclass(frozen=True)
class Pairs:
    """Turns of a list of lists: the first text of each is the user's, the second the assistant's."""

    items: str


@dataclass(frozen=True)
class Say:
    """One turn of a role: the texts of its fields that aren't empty, with a blank line between. None, if all are null."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        out = set()
        for t in self.turns:
            out |= {f"{t.items}[].{t.role}", f"{t.items}[].{t.text}"} if isinstance(t, Each) else {f"{t.items}[][]"} if isinstance(t, Pairs) else set(t.texts)
        return out

    def shapes(self) -> list[frozenset[str]]:
        """Every set of paths that the layout takes: with and without each optional one."""
        need, may = self.paths() - set(self.optional), sorted(self.optional)
        return [frozenset(need | set(some)) for n in range(len(may) + 1) for some in itertools.combinations(may, n)]


SHARED = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("messages", (Each("messages", "role", "content"),), ("messages[].role", "messages[].content")),
    Layout("conversations", (Each("conversations", "from", "value"),), ("conversations[].value",), SHARED),
    Layout("prompt-completion", (Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("prompt-response", (Say("system", ("system_prompt",)), Say("user", ("prompt",)), Say("assistant", ("response",))), ("system_prompt",)),
    Layout("question-answer", (Say("user", ("context", "question")), Say("assistant", ("answer",))), ("context",)),
    Layout("instruction", (Say("system", ("system",)), Pairs("history"), Say("user", ("instruction", "input")), Say("assistant", ("output",))), ("system", "input", "history[][]")),
)


def field_paths(schema: T.StructType) -> dict[str, Column]:
    """Every path of a field, with the condition that a row holds it.

    `a.b` is a field of a struct, `a[].b` one of the structs of a list, `a[]` a list's plain
    element, `a{}` a map. A field is held if it isn't null; one of a list's elements, if any
    element holds it; an empty list holds its own path.
    """

    def under(kind: T.DataType, value: Column, path: str) -> dict[str, Column]:
        if isinstance(kind, T.StructType):
            out = {}
            for f in kind.fields:
                out |= under(f.dataType, value.getField(f.name), f"{path}.{f.name}")
            return out
        if isinstance(kind, T.ArrayType):
            element, out = kind.elementType, {f"{path}[]": value.isNotNull() & (F.size(value) == 0)}
            names = list(under(element, F.lit(None).cast(element), f"{path}[]"))
            held = lambda name: lambda x: under(element, x, f"{path}[]")[name]
            for name in names:
                holds = F.coalesce(F.exists(value, held(name)), F.lit(False))
                out[name] = holds | out[name] if name in out else holds
            return out
        if isinstance(kind, T.MapType):
            return {f"{path}{{}}": value.isNotNull()}
        return {path: value.isNotNull()}

    out: dict[str, Column] = {}
    for f in schema.fields:
        out |= under(f.dataType, F.col(f"`{f.name}`"), f.name)
    return out


def fingerprint(schema: T.StructType) -> Column:
    """A hash of the sorted paths of the fields that a row of the schema holds."""
    paths = sorted(field_paths(schema).items())
    return F.xxhash64(F.concat_ws("\n", *[F.when(holds, F.lit(path)) for path, holds in paths])) if paths else F.xxhash64(F.lit(""))


def shape_print(shape: frozenset[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(shape))))


def _turns(layout: Layout, shape: frozenset[str]) -> Column:
    """The turns of a row of a shape."""
    parts = []
    rename = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None
    known = lambda role: F.coalesce(F.element_at(rename, role), role) if rename is not None else role
    one = lambda role, text: F.struct(F.coalesce(known(role), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    get = lambda x, t, name: x[name].cast("string") if f"{t.items}[].{name}" in shape else F.lit(None).cast("string")
    each = lambda t: lambda x: one(get(x, t, t.role), get(x, t, t.text))
    for t in layout.turns:
        if isinstance(t, Each):
            parts.append(F.transform(F.col(t.items), each(t)))
        elif isinstance(t, Pairs):
            if f"{t.items}[][]" in shape:
                parts.append(F.flatten(F.transform(F.coalesce(F.col(t.items), F.array().cast("array<array<string>>")), lambda x: F.array(one(F.lit("user"), F.get(x, 0)), one(F.lit("assistant"), F.get(x, 1))))))
        elif said := [F.col(f"`{c}`").cast("string") for c in t.texts if c in shape]:
            text = said[0] if len(said) == 1 else F.array_join(F.filter(F.array(*said), lambda x: x != ""), "\n\n")
            parts.append(F.array(one(F.lit(t.role), text)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def to_turns(records: DataFrame, keep: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The columns of keep, fingerprint, layout and turns of every record.

    All other columns make the record: nested columns of any of the layouts, null where a record
    doesn't use them. layout and turns are null where no layout has the fingerprint; such
    records stay. A null role or text is empty; a list of no messages gives no turns; repeated
    records are kept; no records give none. A column that isn't of the layout's type has other
    paths, so no layout takes it.
    """
    schema = T.StructType([f for f in records.schema.fields if f.name not in keep])
    have, print_ = set(field_paths(schema)), fingerprint(schema)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for layout in layouts:
        for shape in layout.shapes():
            if shape and shape <= have:
                hit = F.col("fingerprint") == shape_print(shape)
                name, turns = F.when(hit, layout.name).otherwise(name), F.when(hit, _turns(layout, shape)).otherwise(turns)
        lists = [t.items for t in layout.turns if isinstance(t, Each)]
        if len(layout.turns) == len(lists) == 1 and layout.paths() <= have:  # a list without elements
            hit = F.col("fingerprint") == shape_print(frozenset({f"{lists[0]}[]"}))
            name, turns = F.when(hit, layout.name).otherwise(name), F.when(hit, F.array().cast(f"array<{TURN}>")).otherwise(turns)
    return records.withColumn("fingerprint", print_).select(*keep, "fingerprint", name.alias("layout"), turns.alias("turns"))


#: The fields of all layouts, for records that come as JSON.
JSON_RECORD = "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, completion string, response string, system_prompt string, question string, context string, answer string, instruction string, input string, output string, system string, history array<array<string>>"


def json_records(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON objects as records for to_turns(). What has a field of another name, or isn't an
    object, gets other_fields, so that no layout takes it for its own."""
    fields = T.StructType.fromDDL(JSON_RECORD).names
    got = F.from_json(F.col(column), JSON_RECORD, {"maxStringLen": str((1 << 31) - 1)})
    keys = F.json_object_keys(F.col(column))
    other = F.array_except(keys, F.array(*map(F.lit, fields)))
    rows = df.select(*keep, got.alias("r"), F.when(keys.isNull(), F.array(F.lit(""))).when(F.size(other) > 0, other).alias("other_fields"))
    return rows.select(*keep, "r.*", "other_fields")


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def formatted(turns: Column) -> Column:
    """The training text of turns; null for null."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _role(t["role"]), F.lit(COLON), escaped(t["text"]), F.lit(END))), "")


def loss_mask(turns: Column, roles: tuple[str, ...] = LOSS_ROLES) -> Column:
    """Per turn the code points of its piece of the text that the loss counts: where they begin in the piece, and how many."""
    begins = lambda t: (F.length(_role(t["role"])) + len(HEAD) + len(COLON)).cast("int")
    return F.transform(turns, lambda t: F.struct(begins(t).alias("start"), F.when(t["role"].isin(*roles), F.length(escaped(t["text"]))).otherwise(0).alias("length")))


def pieces(text: Column) -> Column:
    """The formatted text cut behind each turn, without the end marks."""
    cut = F.split(text, END, -1)
    return F.slice(cut, 1, F.size(cut) - 1)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, COLON)
        role = unescaped(F.replace(F.substring(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), F.lit("\\c"), F.lit(":")))
        return F.struct(role.alias("role"), unescaped(F.substring(piece, at + len(COLON), F.length(piece))).alias("text"))

    return F.transform(pieces(text), turn)


def masked_text(text: Column, mask: Column) -> Column:
    """What lies under the loss mask of a formatted text, as it was before escaping, in order."""
    both = F.arrays_zip(pieces(text).alias("piece"), mask.alias("mask"))
    return F.array_join(F.transform(both, lambda x: unescaped(F.substring(x["piece"], x["mask"]["start"] + 1, x["mask"]["length"]))), "")


def format_chats(records: DataFrame, keep: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS, roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """The columns of keep, fingerprint, layout, the formatted text and its loss mask of every record.

    A conversation is one record and one row, so it must fit a row (2 GB), as in any table of
    conversations. Records of no known layout have a null text and mask.
    """
    turns = to_turns(records, keep, layouts)
    return turns.select(*keep, "fingerprint", "layout", formatted(F.col("turns")).alias("formatted"), loss_mask(F.col("turns"), roles).alias("loss"))


SAID = "\\### Assistant: </turn> ok"


def conversation_records(rows: DataFrame) -> DataFrame:
    """Records of rows (conv_id, turn, role, text), each in the layout that its turns allow.

    Turns are in order, null first; equal ones by role and text. A question and its answer are a
    prompt with its completion or an instruction with its output; conversations of known roles
    are messages or shared conversations; all others are messages. Rows of no conv_id are one
    conversation.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # array_sort puts null fields last within structs
    nulls = F.filter("t", lambda x: x["turn"].isNull())
    convs = convs.withColumn("t", F.when(F.size(nulls) == 0, F.col("t")).otherwise(F.concat(nulls, F.filter("t", lambda x: x["turn"].isNotNull()))))
    roles, odd = F.transform("t", lambda x: x["role"]), F.coalesce(F.pmod("conv_id", F.lit(2)) == 1, F.lit(False))
    pair = F.coalesce(roles == F.array(F.lit("user"), F.lit("assistant")), F.lit(False))
    known = F.forall("t", lambda x: x["role"].isin("user", "assistant", "system"))
    kind = F.when(pair, F.when(odd, 0).otherwise(1)).when(known & odd, 2).otherwise(3)
    convs = convs.withColumn("k", kind)
    text = lambda i: F.get("t", i)["text"]
    shared = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    return convs.select(
        "conv_id",
        F.when(F.col("k") == 0, text(0)).alias("prompt"),
        F.when(F.col("k") == 0, text(1)).alias("completion"),
        F.when(F.col("k") == 1, text(0)).alias("instruction"),
        F.when(F.col("k") == 1, text(1)).alias("output"),
        F.when(F.col("k") == 2, F.transform("t", lambda x: F.struct(shared(x).alias("from"), x["text"].alias("value")))).alias("conversations"),
        F.when(F.col("k") == 3, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("select -7L as conv_id, cast(i as long) as turn, r as role, t as text from values (0, 'user'), (1, 'assistant') as v(i, r) cross join (select :t as t)", {"t": SAID})
    return digest(materialize(format_chats(conversation_records(rows.unionByName(more)), ("conv_id",))))


def digest(written: DataFrame) -> DataFrame:
    """Of each formatted conversation what is read back from its text."""
    turns, loss = read_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c, 256)
    rows = written.select("conv_id", "layout", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), "formatted_chars", "layout")


#: The layout column rests on the layouts' declarations, so SQL says it by the same rule as conversation_records().
SQL = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 e as (select *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') as t, replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') as r from c)
 select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256, sum(length(t) + length(r) + 14)::bigint as formatted_chars,
 case when list(role order by turn nulls first, role, text) = ['user', 'assistant'] then case when conv_id % 2 = 0 or conv_id is null then 'instruction' else 'prompt-completion' end when bool_and(role in ('user', 'assistant', 'system')) and conv_id % 2 <> 0 then 'conversations' else 'messages' end as layout from e group by conv_id"""
