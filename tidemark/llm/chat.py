"""Chat formatting: a finite-state machine checks the turns, a declared template turns them into segments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """``marks``: what opens and closes a turn of a role; ``other`` does so for any other role, which is then named.

    ``moves`` maps (state, role) to the next state, from ``start``; a conversation is valid that ends in ``final``.
    Texts of roles in ``loss`` are trained on.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )

    @property
    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)


def escape(text: Column, template: ChatTemplate) -> Column:
    """The text with no control string in it: each gets the escape character behind its first character."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.controls:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _literal(mark: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in mark)


def _segments(turn: Column, template: ChatTemplate) -> Column:
    """The segments of one turn; markup never carries loss."""

    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    text = escape(turn["text"], template)
    named, shut, end = template.other
    out = F.array(
        segment(F.concat(F.lit(named), escape(turn["role"], template), F.lit(shut)), False),
        segment(text, False),
        segment(F.lit(end), False),
    )
    for role, (opens, closes) in template.marks.items():
        out = F.when(
            turn["role"] == role,
            F.array(segment(F.lit(opens), False), segment(text, role in template.loss), segment(F.lit(closes), False)),
        ).otherwise(out)
    return out


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, ``segments`` (text, loss), ``formatted``, ``valid``, ``bad_turn`` (from 0, null if valid).

    Turns go by number, then role, then text; null numbers come first, null roles and texts are empty. Repeated rows
    are repeated turns, which the machine rejects. Rows without a conversation id are conversations of one turn each.
    Every conversation is formatted, valid or not; a conversation is one row of output, so the longest must fit a task.
    """
    rows = turns.select(
        turns[id_col].alias("id"),
        F.struct(
            turns[turn_col].alias("turn"),
            F.coalesce(turns[role_col], F.lit("")).alias("role"),
            F.coalesce(turns[text_col], F.lit("")).alias("text"),
        ).alias("t"),
    )
    known = rows.filter("id is not null").groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = known.unionByName(rows.filter("id is null").select("id", F.array("t").alias("turns")))

    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda a, t: F.struct(
            F.coalesce(F.try_element_at(moves, F.concat_ws("\n", a["state"], t["role"])), F.lit("rejected")).alias("state"),
            (a["n"] + 1).alias("n"),
            F.coalesce(
                a["bad"], F.when(F.try_element_at(moves, F.concat_ws("\n", a["state"], t["role"])).isNull(), a["n"])
            ).alias("bad"),
        ),
    )
    out = chats.withColumn("end", machine).withColumn(
        "segments", F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    )
    valid = F.col("end.bad").isNull() & F.col("end.state").isin(*template.final)
    return out.select(
        F.col("id").alias(id_col),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        valid.alias("valid"),
        F.when(~valid, F.coalesce(F.col("end.bad"), F.col("end.n"))).alias("bad_turn"),
    )


def parse_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    named, shut, end = template.other
    shapes = {role: rf"{_literal(a)}(.*?){_literal(b)}" for role, (a, b) in template.marks.items()}
    rest = rf"{_literal(named)}(.*?){_literal(shut)}(.*?){_literal(end)}"
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join([*shapes.values(), rest])), F.lit(0))

    def turn(x: Column) -> Column:
        def inside(a: str, b: str) -> Column:
            return unescape(x.substr(F.lit(len(a) + 1), F.length(x) - len(a) - len(b)))

        at = F.instr(x, shut)
        out = F.struct(
            unescape(x.substr(F.lit(len(named) + 1), at - len(named) - 1)).alias("role"),
            unescape(x.substr(at + len(shut), F.length(x) - at - len(shut) - len(end) + 1)).alias("text"),
        )
        for role, (a, b) in template.marks.items():
            out = F.when(
                x.startswith(F.lit(a)), F.struct(F.lit(role).alias("role"), inside(a, b).alias("text"))
            ).otherwise(out)
        return out

    return F.transform(found, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    kept = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return F.array_join(kept, "")
