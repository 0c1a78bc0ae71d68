r"""Chat formatting of conversations, with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role,
text). Adjacent turns of one role share a block; inside it each further turn
begins after ``<turn/>``:

    <turn>role
    text<turn/>text</turn><turn>role
    text</turn>

Control strings begin with ``<turn`` or ``</turn``. Inside roles and texts
backslashes are doubled, and a backslash follows the first ``<`` of a control
string, so they never occur there; a line end inside a role is written ``<\nl``.
The escape is undone exactly by :func:`read_back`.

The formatted text is UTF-8 binary. ``loss`` lists the byte spans (start,
length) of all assistant texts, in order.

Defined results: null texts and roles are empty; a null conv_id is one
conversation; repeated (conv_id, turn) rows are all kept, ordered by role and
text; a null turn comes first; an empty table gives no rows; further columns are
ignored. A conversation is one value of the result, so it must fit in a row;
nothing else of it is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.scans import totals_before

BEGIN, NEXT, END = "<turn>", "<turn/>", "</turn>"
LOSS_ROLE = "assistant"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "\\", "\\\\"), "<turn", "<\\turn"), "</turn", "<\\/turn")


def unescape(c: Column) -> Column:
    return _replace(_replace(_replace(c, "<\\turn", "<turn"), "<\\/turn", "</turn"), "\\\\", "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (binary), loss (byte spans) of each conversation."""
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_ = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # merge adjacent turns of one role: a turn begins a block unless the turn before has its role
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform("turns", lambda t: t["role"]), F.lit(1), F.size("turns") - 1))
    marked = sorted_.select("conv_id", F.zip_with("turns", before, lambda t, p: F.struct(t["role"].alias("role"), t["text"].alias("text"), (p.isNull() | (p != t["role"])).alias("opens"), p.isNull().alias("leads"))).alias("turns"))
    role = lambda t: _replace(escape(t["role"]), "\n", "<\\nl")
    lead = lambda t: F.when(t["opens"], F.concat(F.when(t["leads"], F.lit("")).otherwise(F.lit(END)), F.lit(BEGIN), role(t), F.lit("\n"))).otherwise(F.lit(NEXT))
    pieces = marked.select("conv_id", F.transform("turns", lambda t: F.struct(lead(t).alias("lead"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))).alias("pieces"))
    measured = pieces.select("conv_id", "pieces", totals_before(F.transform("pieces", lambda p: (F.octet_length(p["lead"]) + F.octet_length(p["text"])).cast("long"))).alias("starts"))
    placed = F.zip_with("pieces", "starts", lambda p, at: F.when(p["loss"], F.struct((at + F.octet_length(p["lead"])).cast("long").alias("start"), F.octet_length(p["text"]).cast("long").alias("length"))))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END))
    return measured.select("conv_id", text.cast("binary").alias("formatted"), F.array_compact(placed).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text (all text under the loss mask), formatted_chars."""
    inner = formatted.select("conv_id", "formatted", "loss", F.decode("formatted", "UTF-8").alias("whole"))
    # every block ends with END, so the last part is empty
    closed = F.split("whole", END)
    blocks = F.slice(closed, F.lit(1), F.size(closed) - 1)
    body = lambda b: F.expr(f"substring({b}, instr({b}, '\n') + 1)")
    parts = inner.select("conv_id", "formatted", "loss", F.length("whole").cast("long").alias("formatted_chars"), F.transform(blocks, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("head"), b.alias("block"))).alias("blocks"))
    turns = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                F.split(F.substring(b["block"], F.length(b["head"]) + 2, F.length(b["block"])), NEXT),
                lambda x: F.struct(unescape(_replace(F.substring(b["head"], F.lit(len(BEGIN) + 1), F.length(b["head"])), "<\\nl", "\n")).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.decode(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))), "")
    return parts.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted_chars")


def digest(read: DataFrame) -> DataFrame:
    """Counts and hex digests of what :func:`read_back` found."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    length(replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')) AS text_chars,
    length(replace(replace(replace(replace(role, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn'), chr(10), '<\nl')) AS role_chars,
    coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), true) AS opens
  FROM t
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens THEN 14 + role_chars ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
