"""Chat formatting with a declarative template: a finite-state machine over roles and segments with loss flags.

A Template names the control strings that open and close each role's turn, the roles whose text is trained on, and the
transitions that are allowed between roles. format_turns() folds a conversation into text segments, each with a loss
flag, and walks the machine over its roles: valid says whether every turn was allowed and the end is an accepting one,
bad_turn is the place of the first turn that was not. Conversations that break the order are formatted all the same.

Control strings inside a text or role are escaped reversibly: every & becomes &amp; and a control string's first
character becomes its entity. A control string has its first character at no later place, so none can arise across the
border of a text, and what remains unescaped are the template's own marks. parse_formatted() reads turns back from the
formatted string alone. Everything is built from DataFrame functions.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null text or role is empty; a null conv_id is a
conversation of its own; repeated rows stay as turns; a role that the template doesn't name gets the generic marks and
leads to the error state; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTITIES = {"<": "&lt;", "[": "&lb;"}


@dataclass(frozen=True)
class Template:
    """Control strings start with < or [ and hold neither of them elsewhere."""

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    #: Open, between role and text, close: for roles without marks of their own.
    generic: tuple[str, str, str] = ("[TURN]", "[SEP]", "[/TURN]")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """All control strings, longest first."""
        found = {self.begin, *self.generic, *(m for pair in self.marks.values() for m in pair)}
        for c in found:
            if c[0] not in _ENTITIES or any(x in c[1:] for x in _ENTITIES):
                raise ValueError(f"not a control string: {c!r}")
        return sorted(found, key=lambda c: (-len(c), c))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in template.controls():
        text = F.replace(text, F.lit(c), F.lit(_ENTITIES[c[0]] + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for char, entity in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _turn_segments(turn: Column, template: Template) -> Column:
    body = escape(turn["text"], template)
    out = F.array(
        _segment(F.concat(F.lit(template.generic[0]), escape(turn["role"], template), F.lit(template.generic[1])), False),
        _segment(body, False),
        _segment(F.lit(template.generic[2]), False),
    )
    for role, (open_, close) in template.marks.items():
        own = F.array(_segment(F.lit(open_), False), _segment(body, role in template.trained), _segment(F.lit(close), False))
        out = F.when(turn["role"] == role, own).otherwise(out)
    return out


def _next_state(state: Column, role: Column, template: Template) -> Column:
    allowed = F.array(*[F.lit(f"{s}>{r}") for s, roles in template.transitions.items() for r in roles])
    return F.when(F.array_contains(allowed, F.concat(state, F.lit(">"), role)), role).otherwise(F.lit("error"))


def format_turns(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), formatted, valid and bad_turn of every conversation."""
    turns = rows.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, t: F.struct(
            _next_state(acc["state"], t["role"], template).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(_next_state(acc["state"], t["role"], template) == "error", acc["at"])).alias("bad"),
        ),
    )
    segments = F.concat(F.array(_segment(F.lit(template.begin), False)), F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), walk.alias("w")).select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("w.bad").isNull() & F.col("w.state").isin(*template.accepting)).alias("valid"),
        F.col("w.bad").alias("bad_turn"),
    )


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def parse_formatted(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped."""
    pairs = [*template.marks.values(), (template.generic[0], template.generic[2])]
    opens, closes = ("|".join(_quoted(p[k]) for p in pairs) for k in (0, 1))
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))
    role_mark = template.generic[1]

    def turn(raw: Column) -> Column:
        role = F.substring_index(F.substr(raw, F.lit(len(template.generic[0]) + 1)), role_mark, 1)
        text = F.substr(raw, F.lit(len(template.generic[0] + role_mark) + 1) + F.length(role), F.length(raw) - F.length(role) - len("".join(template.generic)))
        out = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        for name, (open_, close) in template.marks.items():
            body = F.substr(raw, F.lit(len(open_) + 1), F.length(raw) - len(open_ + close))
            out = F.when(F.startswith(raw, F.lit(open_)), F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(found, turn)


def with_control_probe(rows: DataFrame, conv_id: int = -7, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """The conversations and one more whose texts hold control strings."""
    spark: SparkSession = rows.sparkSession
    probe = spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of the turns read back from the formatted string and of the text under the loss mask."""
    turns = parse_formatted(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumns({"back": turns, "loss": loss}).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


# What a formatted conversation's length is under DEFAULT: <s>, then per turn the marks and the escaped text.
_SQL_ESCAPED = "replace({x}, '&', '&amp;')"
for _c in DEFAULT.controls():
    _SQL_ESCAPED = f"replace({_SQL_ESCAPED}, '{_c}', '{_ENTITIES[_c[0]]}{_c[1:]}')"

ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
parts AS (
  SELECT *, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 18 + length({_SQL_ESCAPED.format(x="role")}) END
            + length({_SQL_ESCAPED.format(x="text")}) AS chars,
         CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END
         AND (n < total OR role = 'assistant') AS ok
  FROM numbered)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid
FROM parts GROUP BY conv_id
"""
