"""Chat formatting with DataFrame functions only: a declared template, a finite-state machine over roles, and segments
with loss flags.

A template is data: marks around each turn, the roles that are learned from, and the moves of a machine over roles.
A control string inside a text gets the escape character after its first character, and the escape character itself is
doubled, so no control string is left in an escaped text and unescape() gives the text back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + middle + text + close for each turn. learned: roles whose text is under the loss mask. moves:
    (state, role) -> state; a role without a move leads to the state "invalid", which nothing leaves. Role names may
    not hold the escape character's control strings unescaped either: they are escaped like texts."""

    open: str = "### "
    middle: str = ":\n"
    close: str = "</turn>\n"
    controls: tuple[str, ...] = ("### ", "</turn>", ":\n")
    text_controls: tuple[str, ...] = ("### ", "</turn>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    final: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
            ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant",
        }
    )


def escaped(text: Column, controls: tuple[str, ...], escape: str = "\\") -> Column:
    text = F.replace(text, F.lit(escape), F.lit(escape * 2))
    for c in controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + escape + c[1:]))
    return text


def unescaped(text: Column, escape: str = "\\") -> Column:
    e = "\\" + escape
    return F.regexp_replace(text, F.lit(f"(?s){e}(.)"), F.lit("$1"))


def format_conversations(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss), valid, invalid_at.

    Turns go by turn number (nulls first), then role and text, so ties and repeated rows have one order and all stay.
    Null texts and roles are empty; null conversation ids are one conversation. valid: the machine accepts the roles;
    invalid_at: the place, from 0, of the first turn that it has no move for, or the number of turns where the last
    state is none to end in; null if valid. Invalid conversations are formatted too. Other columns are ignored.
    """
    t = template
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"),
            F.concat(F.lit(t.open), escaped(role, t.controls, t.escape), F.lit(t.middle)).alias("head"),
            escaped(text, t.text_controls, t.escape).alias("body"), role.isin(*t.learned).alias("loss"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    segments = F.flatten(F.transform("ts", lambda x: F.array(F.struct(x.head.alias("text"), F.lit(False).alias("loss")), F.struct(x.body.alias("text"), x.loss.alias("loss")), F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"))
    walked = F.aggregate(
        "ts", begin,
        lambda a, x: F.when(a.state == "invalid", a).otherwise(
            F.struct(F.coalesce(F.try_element_at(moves, F.concat(a.state, F.lit("\n"), x.role)), F.lit("invalid")).alias("state"), (a.n + F.when(F.try_element_at(moves, F.concat(a.state, F.lit("\n"), x.role)).isNull(), 0).otherwise(1)).alias("n"))
        ),
    )
    done = convs.select("conv_id", segments.alias("segments"), walked.alias("w"))
    valid = F.col("w.state").isin(*t.final)
    return done.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", valid.alias("valid"), F.when(~valid, F.col("w.n")).alias("invalid_at"))


def read_back(formatted: DataFrame, template: Template = Template(), *also: str) -> DataFrame:
    """conv_id and turns (role, text, loss) as the formatted string alone tells them, and the columns named in also."""
    t = template
    pieces = F.split(F.col("formatted"), "\\Q" + t.close + "\\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(t.open) + 1))
        cut_at = F.instr(rest, t.middle)
        role = unescaped(F.substr(rest, F.lit(1), cut_at - 1), t.escape)
        return F.struct(role.alias("role"), unescaped(F.substr(rest, cut_at + len(t.middle)), t.escape).alias("text"), role.isin(*t.learned).alias("loss"))

    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"), *also)


def turn_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of the output: turns as read_back() finds them in the formatted string, the learned text as the flags of
    the segments mark it, and the machine's verdict on the roles."""
    back = read_back(format_conversations(turns, template), template, "segments", "valid", "invalid_at")
    every = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescaped(s.text, template.escape)), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars", "valid", "invalid_at",
    )


#: The conversation that the query adds: each text holds an escape character and two control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"

_MOVES = " ".join(f"when '{state}>{role}' then '{to}'" for (state, role), to in Template().moves.items())
ORACLE = f"""
with recursive t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, v.turn, v.role, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(turn, role)),
e as (
  select *, length(replace(replace(replace(text, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>')) as body,
    length(replace(replace(replace(replace(role, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>'), ':' || chr(10), ':\\' || chr(10))) as head
  from t),
o as (select conv_id, role, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from t),
w as (select distinct conv_id, 0 as k, 'start' as state from t union all
  select w.conv_id, w.k + 1, case w.state || '>' || o.role {_MOVES} else 'invalid' end
  from w join o on o.conv_id is not distinct from w.conv_id and o.k = w.k + 1 where w.state <> 'invalid'),
v as (select conv_id, arg_max(state, k) as last, max(k) as k from w group by conv_id),
g as (select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(4 + head + 2 + body + 8) as bigint) as formatted_chars
  from e group by conv_id)
select g.*, last = 'assistant' as valid, cast(case when last = 'assistant' then null when last = 'invalid' then k - 1 else k end as integer) as invalid_at
from g join v on g.conv_id is not distinct from v.conv_id
"""
