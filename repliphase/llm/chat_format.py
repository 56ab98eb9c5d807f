r"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a VARIANT in one of several layouts. The nested field paths that hold something, of
those that any mapping knows, are hashed; the fingerprint selects a declarative mapping, which
turns the record into canonical turns (role, text). A field that is null or an empty list holds
nothing, as in tables merged from several sources; only where no mapping fits what is held, those
fields count too. Where several mappings fit, the first in their order is taken; other fields of a
record are ignored, but a system text stays in front of a list of turns. Members of a list are
read one by one, each by the first known role and text field that hold something. Rows of one
conversation are put together by their order and written in one template:

    <turn:ROLE>\nTEXT</turn>\n

Inside texts every ``<turn`` and ``</turn``, with any backslashes before ``turn``, gets one more
backslash, which reading back removes; in roles the characters ``% < >`` and line ends are
percent-encoded. The loss mask holds the spans, in code points, of the assistant texts.

Defined cases: null or absent text is empty, a null role is empty; a text that is a list of parts
is its parts' texts with an empty line between, and a field that holds a list of turns instead of a
text gives those turns; a list of turns may be a single turn, or a string of JSON, and any other
string is one turn without a role; rows with the same place in a
conversation are ordered by role and text, repeated ones stay; a record of no layout, and a member
of a list without any known field, give no turn and are counted in n_unknown, while the rest of the
conversation stays; an empty list gives no turns; a null id is an id; empty tables give no rows. A
conversation is one value of one row, so one task holds it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, HEAD_END, CLOSE = "<turn:", ">\n", "</turn>\n"
_ROLE_CODES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns; records that have all its required paths are of that layout.

    ``fields`` are (role, path, optional) of records with a field per turn; optional fields may be
    absent, and paths of one role in sequence are joined by an empty line. ``items`` is the path
    of a list of turns, which optional ``fields`` may come before. ``row`` is the (role path, text path) of records that are one turn.
    ``roles`` renames roles.
    """

    name: str
    fields: tuple[tuple[str, str, bool], ...] = ()
    items: str | None = None
    row: tuple[str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def required(self) -> frozenset[str]:
        return frozenset(self.row or ([self.items] if self.items else [path for _, path, optional in self.fields if not optional]))

    def paths(self) -> set[str]:
        return {*self.required(), *(path for _, path, _ in self.fields)}


#: In order of precedence.
MAPPINGS = (
    Mapping("messages", fields=(("system", "$.system", True),), items="$.messages"),
    Mapping("conversations", fields=(("system", "$.system", True),), items="$.conversations", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", fields=(("system", "$.system", True), ("user", "$.instruction", False), ("user", "$.input", True), ("assistant", "$.output", False))),
    Mapping("prompt and completion", fields=(("system", "$.system", True), ("user", "$.prompt", False), ("assistant", "$.completion", False), ("assistant", "$.response", True))),
    Mapping("prompt and response", fields=(("system", "$.system", True), ("user", "$.prompt", False), ("assistant", "$.response", False))),
    Mapping("turn rows", row=("$.role", "$.text")),
)

#: The fields of a list's members, in order of precedence.
MEMBER_ROLES, MEMBER_TEXTS = ("$.role", "$.from"), ("$.content", "$.value", "$.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(/?)(\\*)turn", r"<$1\\$2turn")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(/?)\\(\\*)turn", r"<$1$2turn")


def _encode_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _decode_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _known(mappings: tuple[Mapping, ...]) -> list[str]:
    return sorted({path for m in mappings for path in m.paths()})


def _there(record: Column, path: str) -> Column:
    """Whether a VARIANT has this path, whatever it holds."""
    return F.try_variant_get(record, path, "variant").isNotNull()


def _held(record: Column, path: str) -> Column:
    """Whether this path of a VARIANT holds something: neither null nor an empty list."""
    value = F.try_variant_get(record, path, "variant")
    return value.isNotNull() & ~F.is_variant_null(value) & (F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(-1)) != 0)


def _held_for(mappings: tuple[Mapping, ...]):
    """``_held``, but a record that is one turn holds its role and its text if it holds either."""
    pairs = {path: m.row for m in mappings if m.row for path in m.row}

    def has(record: Column, path: str) -> Column:
        return _there(record, path) & (_held(record, pairs[path][0]) | _held(record, pairs[path][1])) if path in pairs else _held(record, path)

    return has


def fingerprint(record: Column, paths: list[str], has=_held) -> Column:
    """The hash of those of the paths of a VARIANT for which ``has`` holds."""
    return F.xxhash64(F.concat_ws("|", *[F.when(has(record, path), F.lit(path)) for path in paths]))


def _layouts(spark: SparkSession, mappings: tuple[Mapping, ...]) -> DataFrame:
    """Rows (print, layout): the fingerprint of each set of known paths and the first mapping that it has all required paths of."""
    paths, needs = _known(mappings), [m.required() for m in mappings]
    if len(set(needs)) < len(needs):
        raise ValueError("two mappings require the same paths")
    if len(paths) > 14:
        raise ValueError("the mappings know more than 14 paths")
    has = [(F.shiftright("id", k) % 2) == 1 for k in range(len(paths))]
    layout = F.lit(None).cast("int")
    for k in reversed(range(len(mappings))):
        fits = reduce(and_, [has[paths.index(p)] for p in needs[k]])
        layout = F.when(fits, F.lit(k)).otherwise(layout)
    prints = F.xxhash64(F.concat_ws("|", *[F.when(h, F.lit(p)) for h, p in zip(has, paths)]))
    return spark.range(1 << len(paths)).select(prints.alias("_print"), layout.alias("layout"))


def _said(value: Column) -> Column:
    """The text of a VARIANT: its own, or that of its parts with an empty line between."""
    own = F.try_variant_get(value, "$", "string")
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.try_variant_get(p, "$.text", "string")))
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.array_join(parts, "\n\n")), own)


def _members(value: Column) -> Column:
    """The members of a VARIANT that is a list, a single member or a string of either."""
    text = F.try_variant_get(value, "$", "string")

    def listed(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), F.array(v))

    other = F.when(text.isNotNull(), F.array(F.to_variant_object(F.struct(text.alias("text")))))
    return F.coalesce(listed(value), listed(F.try_parse_json(text)), other, F.array().cast("array<variant>"))


def _turn(role: Column, text: Column, mapping: Mapping) -> Column:
    for old, new in mapping.roles.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _first_of(member: Column, paths: tuple[str, ...], read) -> Column:
    """What the first of the paths that holds something gives; NULL if none does."""
    return F.coalesce(*[F.when(_held(member, path), read(path)) for path in paths])


def _member_turn(member: Column, mapping: Mapping) -> Column:
    """The turn of a list's member; its role is null where it has no known field."""
    role = _first_of(member, MEMBER_ROLES, lambda path: F.try_variant_get(member, path, "string"))
    text = _first_of(member, MEMBER_TEXTS, lambda path: _said(F.try_variant_get(member, path, "variant")))
    known = reduce(or_, [_there(member, path) for path in (*MEMBER_ROLES, *MEMBER_TEXTS)])
    return F.when(known, _turn(role, text, mapping)).otherwise(F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text")))


def _is_turns(value: Column) -> Column:
    """Whether a VARIANT is a list some of whose members have a role."""
    members = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.exists(members, lambda m: reduce(or_, [_there(m, path) for path in MEMBER_ROLES])), F.lit(False))


def _field_turns(record: Column, role: str, paths: list[tuple[str, bool]], mapping: Mapping) -> Column:
    """The turns of fields of one role: those of lists of turns, then one of all texts; an empty optional text adds nothing."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    lists, texts = [], []
    for path, optional in paths:
        value = F.try_variant_get(record, path, "variant")
        listed, text = _is_turns(value), F.coalesce(_said(value), F.lit(""))
        lists.append(F.when(listed, F.transform(_members(value), lambda m: _member_turn(m, mapping))).otherwise(none))
        texts.append(F.when(~listed & (text != "") if optional else ~listed, text))
    said = F.when(F.coalesce(*texts).isNotNull(), F.array(_turn(F.lit(role), F.concat_ws("\n\n", *texts), mapping))).otherwise(none)
    return F.concat(*lists, said)


def _turns(record: Column, mapping: Mapping) -> Column:
    """The turns of a record in this layout: an array of (role, text)."""
    if mapping.row:
        text = _said(F.try_variant_get(record, mapping.row[1], "variant"))
        return F.array(_turn(F.try_variant_get(record, mapping.row[0], "string"), text, mapping))
    by_role = [(role, [(path, optional) for _, path, optional in group]) for role, group in groupby(mapping.fields, key=lambda f: f[0])]
    parts = [_field_turns(record, role, paths, mapping) for role, paths in by_role]
    if mapping.items:
        parts.append(F.transform(_members(F.try_variant_get(record, mapping.items, "variant")), lambda m: _member_turn(m, mapping)))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, id_col: str, order_col: str | None, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows (id, place, member, role, text): one per turn. What is of no known layout is a row with a null role,
    an empty list one with a null member.

    ``record_col`` is a VARIANT, or a string of JSON; JSON that cannot be read is of no layout.
    """
    record = F.col(record_col)
    if dict(records.dtypes)[record_col] == "string":
        record = F.try_parse_json(record)
    rows = records.select(F.col(id_col).alias("id"), (F.col(order_col) if order_col else F.lit(0)).alias("place"), record.alias("record"))
    # A row for each set of known paths: their number depends on the mappings alone.
    layouts, known = _layouts(records.sparkSession, mappings), _known(mappings)
    rows = rows.withColumn("_print", fingerprint(F.col("record"), known, _held_for(mappings))).join(F.broadcast(layouts), "_print", "left").drop("_print")
    rows = rows.withColumn("_print", F.when(F.col("layout").isNull(), fingerprint(F.col("record"), known, _there)))
    rows = rows.join(F.broadcast(layouts.withColumnRenamed("layout", "_empty")), "_print", "left").withColumn("layout", F.coalesce("layout", "_empty"))
    turns = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text")))
    for k, mapping in enumerate(mappings):
        turns = F.when(F.col("layout") == k, _turns(F.col("record"), mapping)).otherwise(turns)
    return rows.select("id", "place", F.posexplode_outer(turns).alias("member", "t")).select("id", "place", "member", "t.role", F.coalesce("t.text", F.lit("")).alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Canonical turns to rows (id, formatted, loss_spans, n_unknown), one per conversation."""
    turns = turns.withColumn("piece", F.when(F.col("role").isNotNull(), F.concat(F.lit(OPEN), _encode_role(F.col("role")), F.lit(HEAD_END), escape(F.col("text")), F.lit(CLOSE))).otherwise(""))
    order = ["place", "member", "role", "text"]
    before = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("piece").cast("long")
    turns = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    inner = F.col("at") + len(OPEN) + F.char_length(_encode_role(F.col("role"))) + len(HEAD_END)
    span = F.struct(inner.alias("start"), (F.col("at") + size - len(CLOSE)).alias("stop"))
    made = turns.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("role").isNull().alias("none"), "piece"))).alias("p"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"),
        F.count_if(F.col("role").isNull() & F.col("member").isNotNull()).alias("n_unknown"),
    )
    return made.select("id", F.array_join("p.piece", "").alias("formatted"), "loss_spans", "n_unknown")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode_role(F.substring(F.substring_index(p, HEAD_END, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(p, F.locate(HEAD_END, p) + len(HEAD_END), F.lit(2**31 - 1))).alias("text"),
        ),
    )


def masked(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.stop - s.start).cast("int")))), "")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + 2 * (length(role) - length(regexp_replace(role, '[%<>\r\n]', '', 'g')))
    + length(regexp_replace(text, '<(/?)(\\*)turn', '<\1\\\2turn', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
