r"""Chat formatting by relational means only: collected turn structs, array functions.

Template: a block of adjacent turns of one role opens with ``### role: ``; each turn of
the block is its text and ``</turn>``. Inside texts and roles a backslash becomes
``\s``, ``###`` becomes ``\h`` and ``</turn>`` becomes ``\t`` (in roles also ``:``
becomes ``\c``), so no control string survives in them and ``parse`` gives back every
turn. ``loss_spans`` marks the texts of the assistant, in code points and in bytes. Work is
linear in the turns of a conversation, but for their sort.

Defined results: null texts and roles are empty; turns are ordered by turn (null first),
then role, then text; repeated rows are turns of their own; rows without a conversation
id form one conversation; other columns take no part, whatever their names; an empty table
gives an empty result. A conversation is one output row, so its text, however long its turns,
has to fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, MID, END = "### ", ": ", "</turn>"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("###"), F.lit("\\h")), F.lit(END), F.lit("\\t"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\t"), F.lit(END)), F.lit("\\h"), F.lit("###"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: its id, formatted string, loss_spans array of (start, length, first_byte, bytes)."""
    turns = rows.select(
        F.col(conv).alias(conv),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    said = turns.groupBy(conv).agg(F.array_sort(F.collect_list("said")).alias("said"))
    # A turn opens a block unless the turn before it has its role.
    pieces = F.transform(
        "said",
        lambda x, i: F.struct(
            F.when((i > 0) & (F.get("said", i - 1)["role"] == x["role"]), F.lit("")).otherwise(F.concat(F.lit(HEAD), escape(x["role"], role=True), F.lit(MID))).alias("head"),
            escape(x["text"]).alias("text"),
            (x["role"] == trained).alias("trained"),
        ),
    )
    # Offsets are running sums over the pieces' rows: a fold that gathers spans would copy
    # them at each turn. The rows keep their partitioning, so they are not shuffled again.
    rows_of = said.select(conv, F.posexplode(pieces).alias("place", "piece")).select(conv, "place", "piece.*")
    line = Window.partitionBy(conv).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

    def before(size) -> Column:
        whole = F.sum(size("head") + size("text") + len(END)).over(line)
        return F.coalesce(whole, F.lit(0)) + size("head")

    placed = rows_of.select(
        conv,
        F.struct(
            "place",
            F.concat("head", "text", F.lit(END)).alias("piece"),
            "trained",
            F.struct(
                before(F.length).cast("int").alias("start"),
                F.length("text").alias("length"),
                before(F.octet_length).cast("int").alias("first_byte"),
                F.octet_length("text").alias("bytes"),
            ).alias("span"),
        ).alias("turn"),
    )
    whole = placed.groupBy(conv).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(conv, F.array_join("turns.piece", "").alias("formatted"), F.filter("turns", lambda t: t["trained"])["span"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted string."""
    blocks = F.filter(F.split(formatted, F.lit(HEAD)), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, MID, 1)
        body = F.substr(block, F.length(role) + len(MID) + 1)
        texts = F.split(body, F.lit(END))
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped, in order.

    Cut by bytes: a cut by code points walks from the start of the string each time.
    """
    cut = F.transform(F.array(formatted.cast("binary")), lambda b: F.transform(spans, lambda s: unescape(F.substr(b, s["first_byte"] + 1, s["bytes"]).cast("string"))))
    return F.get(cut, F.lit(0))
