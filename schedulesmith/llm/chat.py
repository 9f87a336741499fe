"""Chat formatting: a role state machine and a declarative template, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles whose text is trained on, and the allowed turn order.

    Every mark starts with ``<|``. ``moves`` maps a state (the role before, or ``start``) to
    the roles that may follow; ``ends`` are the roles a conversation may end with.
    """

    turn: str = "<|im_start|>"
    body: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    r"""No ``<|`` is left: one backslash more goes between ``<`` and ``|``, also where some stand already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, valid, first_bad_turn, segments, formatted).

    ``segments`` are (text, loss) in order, ``formatted`` is their concatenation. Turns are put
    in the order of (turn, role, text), nulls first, so ties have one order. Null texts and
    roles count as empty, rows with a null conv_id form one conversation of their own. The
    state machine only judges: a conversation that breaks the order has ``valid`` false and the
    position (from 0) of the first bad turn, the number of turns if only the end is bad, and is
    formatted all the same. Repeated rows are repeated turns. Other columns are left aside.

    A conversation becomes one row, so one must fit in a row (2 GB); rows of a conversation are
    gathered where they are formatted, the only shuffle.
    """
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    allowed = F.create_map(*[F.lit(x) for state, roles in template.moves.items() for role in roles for x in (f"{state}\n{role}", True)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("done"), F.lit(True).alias("ok"))

    def move(at: Column, turn: Column) -> Column:
        ok = at["ok"] & F.coalesce(F.try_element_at(allowed, F.concat_ws("\n", at["state"], turn["role"])), F.lit(False))
        return F.struct(turn["role"].alias("state"), (at["done"] + ok.cast("int")).alias("done"), ok.alias("ok"))

    judged = ordered.withColumn("walk", F.aggregate("turns", start, move))
    valid = F.col("walk.ok") & F.col("walk.state").isin(*template.ends)

    def segments(turn: Column) -> Column:
        head = F.concat(F.lit(template.turn), escape(turn["role"]), F.lit(template.body))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), turn["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))

    return judged.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"),
        F.when(~valid, F.col("walk.done")).alias("first_bad_turn"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Array of (role, text) parsed from formatted text alone."""
    literal = lambda mark: "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in mark)
    pieces = F.split(formatted, literal(template.turn))
    pieces = F.slice(pieces, 2, F.size(pieces))

    def parse(piece: Column) -> Column:
        halves = F.split(piece, literal(template.body), 2)
        return F.struct(unescape(halves[0]).alias("role"),
                        unescape(F.regexp_replace(halves[1], f"{literal(template.end)}$", "")).alias("text"))

    return F.transform(pieces, parse)


def chat_digest(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of what is read back from the formatted text and from the segments under the loss mask."""
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumns({"back": read_turns(F.col("formatted"), template), "trained": trained}).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
