r"""Chat formatting with a grammar round trip (operator 3), in DataFrame functions only.

A turn is written as ``### role:level``, a new line, the text, ``</turn>`` and a
new line. The parser cuts a conversation at ``</turn>`` and refuses a turn that
holds another ``### ``. Each text is written as it is (level 0) and parsed again;
if what comes back differs, its control strings are escaped (level 1: ``\e`` for
``</turn>``, ``\h`` for ``### ``); if the text also holds such escapes itself, so
that it still comes back differently, backslashes are escaped first (level 2:
``\b``). Level 2 always comes back: after it every backslash starts an escape.
Roles are always written at level 2, with ``\n`` for a new line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
_PIECE = "</turn>\\n"
LEVELS = (0, 1, 2)


def _swap(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_CONTROL = [(END, "\\e"), (HEAD, "\\h")]


def escape(text: Column, level: int) -> Column:
    return _swap(text, [[], _CONTROL, [("\\", "\\b"), *_CONTROL]][level])


def unescape(text: Column, level: int) -> Column:
    back = [(b, a) for a, b in _CONTROL]
    return _swap(text, [[], back, [*back, ("\\b", "\\")]][level])


def render(role: Column, text: Column, level: int) -> Column:
    name = F.replace(escape(role, 2), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(HEAD), name, F.lit(f":{level}\n"), escape(text, level), F.lit(f"{END}\n"))


def parse_piece(piece: Column) -> Column:
    """role, level, start of the text and text of one turn without its end; text null where the grammar doesn't allow it."""
    head = F.substring_index(piece, "\n", 1)
    name = F.substring(head, F.lit(len(HEAD) + 1), F.length(head) - len(HEAD) - 2)
    level = F.right(head, F.lit(1))
    start = F.length(head) + 1
    body = F.substring(piece, start + 1, F.length(piece))
    text = F.when(level == "0", body).when(level == "1", unescape(body, 1)).otherwise(unescape(body, 2))
    legal = piece.startswith(HEAD) & (F.instr(body, HEAD) == 0)
    return F.struct(unescape(F.replace(name, F.lit("\\n"), F.lit("\n")), 2).alias("role"), level.cast("int").alias("level"), start.alias("start"), F.when(legal, text).alias("text"))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their ends."""
    cut = F.split(formatted, END)
    return F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda p, i: F.when(i == 0, p).otherwise(F.substring(p, F.lit(2), F.length(p))))


def _comes_back(role: Column, text: Column, level: int) -> Column:
    found = pieces(render(role, text, level))
    one = parse_piece(found[0])
    return (F.size(found) == 1) & one["text"].eqNullSafe(text) & (one["role"] == role)


def format_conversations(rows: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted, turns (source role and text, in order), loss_mask, n_turns, round_trip.

    rows: conv_id, turn, role, text and any others, which are left out. Null role
    and text are empty; rows are ordered by turn (null first), then role, then
    text; repeated rows are repeated turns; a null conv_id is a conversation.
    loss_mask lists the texts of ``learned_role``: segment (counted from 0), start
    within it, start within formatted, length, in characters. round_trip says that
    the parsed turns equal the source; a conversation for which they don't is an error.

    A conversation is one value here (its digests are over its whole text), so its
    turns and their formatted text must fit in a row: 2 GB by Spark's limit, and about
    a tenth of a task's memory.
    """
    flat = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    out = F.when(_comes_back(role, text, 0), render(role, text, 0)).when(_comes_back(role, text, 1), render(role, text, 1)).otherwise(render(role, text, 2))
    written = flat.withColumn("out", out)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = written.select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        F.coalesce(F.sum(F.length("out")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"),
        "role",
        "text",
        "out",
    )
    one = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "role", "text", "out"))).alias("t"))
    body = lambda x: F.length(F.substring_index(x["out"], "\n", 1)) + 1
    mask = F.transform(
        F.filter("t", lambda x: x["role"] == learned_role),
        lambda x: F.struct((x["pos"] - 1).alias("segment"), body(x).alias("start"), (x["at"] + body(x)).alias("at"), (F.length(x["out"]) - body(x) - len(END) - 1).alias("length")),
    )
    made = one.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        mask.alias("loss_mask"),
    )
    same = parsed_turns(F.col("formatted")) == F.col("turns")
    return made.withColumn("round_trip", F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("chat: a conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean")))


def parsed_turns(formatted: Column) -> Column:
    return F.transform(pieces(formatted), lambda p: F.struct(parse_piece(p)["role"].alias("role"), parse_piece(p)["text"].alias("text")))


def read_back(made: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all read from ``formatted`` and ``loss_mask``."""
    cut = made.select("conv_id", "formatted", "loss_mask", "round_trip", pieces(F.col("formatted")).alias("pieces"), parsed_turns(F.col("formatted")).alias("seen"))
    under = F.transform(
        F.arrays_zip(F.transform("loss_mask", lambda m: m["segment"]).alias("segment"), F.col("loss_mask").alias("m")),
        lambda z: _unmask(F.get(F.col("pieces"), z["segment"].cast("int")), z["m"]),
    )
    wide = cut.select("*", F.array_join(under, "").alias("learned"))
    return wide.select(
        "conv_id",
        F.size("seen").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("seen", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def _unmask(piece: Column, mask: Column) -> Column:
    level = F.right(F.substring_index(piece, "\n", 1), F.lit(1))
    raw = F.substring(piece, mask["start"] + 1, mask["length"])
    return F.when(level == "0", raw).when(level == "1", unescape(raw, 1)).otherwise(unescape(raw, 2))
