"""Chat formatting from a declarative template, in DataFrame functions only.

A template gives each role its opening string, closing string and loss flag, and a finite-state
machine over roles: ``moves[state][role]`` is the next state, anything else leads to ``error``. A
conversation's turns, in order, become segments (text, loss) and one formatted string.

Control strings all begin with ``<`` or ``[``. Inside texts and role names each of ``<``, ``[`` and
the backslash is followed by a backslash, so no control string can occur there; reading back takes
that backslash away again.

Edge cases: rows are ordered by turn (null first), then role, then text; repeated rows are turns of
their own. A null text or role is empty. A null conv_id is a conversation of its own. Turns in an
order that the machine refuses are formatted all the same, with ``valid`` false and ``first_error``
the place (from 0) of the first refused turn. Other columns are never read. A conversation is one
result row, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.minhash import let

#: Declarative template. ``other`` is used for roles without an entry of their own.
TEMPLATE = {
    "roles": {
        "system": {"open": "[SYS]<role>system<text>", "close": "[/SYS]\n", "loss": False},
        "user": {"open": "<s>[INST]<role>user<text>", "close": "[/INST]\n", "loss": False},
        "assistant": {"open": "<role>assistant<text>", "close": "</s>\n", "loss": True},
    },
    "other": {"open": "[TURN]<role>{role}<text>", "close": "[/TURN]\n", "loss": False},
    "start": "start",
    "moves": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    "final": ["assistant"],
}
ERROR = "error"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[\\\\])", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "([<\\[\\\\])\\\\", "$1")


def _by_role(template: dict, role: Column, part: str) -> Column:
    value = template["other"][part]
    out = F.replace(F.lit(value), F.lit("{role}"), escape(role)) if isinstance(value, str) else F.lit(value)
    for name, spec in template["roles"].items():
        out = F.when(role == name, F.lit(spec[part])).otherwise(out)
    return out


def machine(template: dict, roles: Column) -> Column:
    """struct<state, at, refused>: the state after the last turn, the number of turns, and the first refused one's (from 1; 0: none). One pass."""

    def move(state: Column, role: Column) -> Column:
        out = F.lit(ERROR)
        for source, targets in template["moves"].items():
            for by, target in targets.items():
                out = F.when((state == source) & (role == by), F.lit(target)).otherwise(out)
        return out

    def step(s: Column, role: Column) -> Column:
        state, at = move(s["state"], role), s["at"] + 1
        refused = F.when(s["refused"] > 0, s["refused"]).when(state == ERROR, at).otherwise(F.lit(0))
        return F.struct(state.alias("state"), at.alias("at"), refused.alias("refused"))

    zero = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("refused"))
    return F.aggregate(roles, zero, step)


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid, first_error of every conversation."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    talks = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(_by_role(template, t["role"], "open"), F.lit(False)),
            seg(escape(t["text"]), _by_role(template, t["role"], "loss")),
            seg(_by_role(template, t["role"], "close"), F.lit(False)),
        )

    walked = machine(template, F.transform("turns", lambda t: t["role"]))
    return (
        talks.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), walked.alias("walked"))
        .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
        .select(
            "conv_id",
            "formatted",
            "segments",
            F.col("walked.state").isin(template["final"]).alias("valid"),  # no state leaves the error
            F.when(F.col("walked.refused") > 0, F.col("walked.refused") - 1).alias("first_error"),
        )
    )


def _closers(template: dict) -> str:
    """Regular expression of all closing strings (each ends a turn)."""
    found = {spec["close"] for spec in [*template["roles"].values(), template["other"]]}
    return "|".join("\\Q" + c + "\\E" for c in sorted(found))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted string."""
    turns = F.filter(F.split(formatted, _closers(template)), lambda x: x != "")

    def one(x: Column) -> Column:
        return let(F.split(F.element_at(F.split(x, "<role>", 2), 2), "<text>", 2), lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))

    return F.transform(turns, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def digest(talks: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: read back from the formatted output."""
    back = talks.select("conv_id", "valid", "formatted", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
