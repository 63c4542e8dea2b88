"""Chat formatting by a finite-state machine over roles; DataFrame functions only.

A declarative template gives each role its opening and closing control string and whether
its text bears loss. The machine reads a conversation's turns in order, checks that each
role may follow the one before, and emits segments (text, loss). Texts are escaped so that
no control string can occur in them; reading a formatted conversation back finds the turns
by their control strings and undoes the escape, which gives the texts exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: role: (opening, closing, loss). Roles that are not listed take OTHER around their name.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
OTHER = ("<|", "|>", "<|/|>")
#: Every control string holds < or [; & begins an escape.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
#: Roles that may follow each state; a conversation ends well after an assistant.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
TURN = r"(<<SYS>>|\[INST\]|<s>|<\|[^<\[|]*\|>)([^<\[]*)(?:<</SYS>>|\[/INST\]|</s>|<\|/\|>)"


def escaped(text):
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text):
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _by_role(role, part: int, other):
    out = other
    for name, spec in TEMPLATE.items():
        out = F.when(role == name, F.lit(spec[part])).otherwise(out)
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, role, text) in order of turn, then role and text; nulls are empty.

    A conversation is one value, as its formatted text is, so its turns meet in one task.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, segments array of (text, loss), formatted, valid, first_error of each conversation.

    first_error is the place, from 0, of the first turn whose role may not follow, the
    number of turns if the conversation ends before an assistant's, null if it is valid.
    Conversations that are not valid are formatted all the same. Null roles and texts are
    empty; unknown roles are marked by name and never valid. Turns that repeat are kept.
    """
    follow = F.create_map(*(F.lit(x) for k, v in FOLLOWS.items() for x in (k, ",".join(v))))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(s, t):
        allowed = F.array_contains(F.split(F.coalesce(follow[s["state"]], F.lit("")), ","), t["role"]) & (t["role"] != "")
        return F.struct(t["role"].alias("state"), (s["at"] + 1).alias("at"), F.when((s["bad"] < 0) & ~allowed, s["at"]).otherwise(s["bad"]).alias("bad"))

    opening = lambda t: _by_role(t["role"], 0, F.concat(F.lit(OTHER[0]), escaped(t["role"]), F.lit(OTHER[1])))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(opening(t), F.lit(False)),
                segment(escaped(t["text"]), _by_role(t["role"], 2, F.lit(False))),
                segment(_by_role(t["role"], 1, F.lit(OTHER[2])), F.lit(False)),
            ),
        )
    )
    end = F.aggregate("turns", start, step)
    out = conversations(rows).select("conv_id", segments.alias("segments"), end.alias("end"))
    bad = F.when(F.col("end.bad") >= 0, F.col("end.bad")).when(F.col("end.state") != "assistant", F.col("end.at"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "segments", text.alias("formatted"), bad.isNull().alias("valid"), bad.alias("first_error"))


def read_back(text):
    """The turns of a formatted conversation, an array of (role, text)."""
    roles, bodies = F.regexp_extract_all(text, F.lit(TURN), 1), F.regexp_extract_all(text, F.lit(TURN), 2)
    n, m = len(OTHER[0]), len(OTHER[0]) + len(OTHER[1])

    def role(opening):
        out = unescaped(F.substring(opening, F.lit(n + 1), F.length(opening) - m))
        for name, spec in TEMPLATE.items():
            out = F.when(opening == spec[0], F.lit(name)).otherwise(out)
        return out

    return F.zip_with(roles, bodies, lambda r, b: F.struct(role(r).alias("role"), unescaped(b).alias("text")))


def chat_format(rows: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says when read back, with valid and first_error.

    Loss text is what the segments hold that are flagged with a loss, unescaped. Rows without a conv_id are one
    conversation, of null. An empty table gives an empty one; columns besides conv_id, turn, role and text are not read.
    A conversation of any length is one value of one task, as its formatted text and its digests are.
    """
    done = formatted(rows).withColumn("turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("first_error").cast("long").alias("first_error"),
    )
