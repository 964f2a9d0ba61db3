"""Relational chat formatting in Spark expressions only.

A conversation's rows are collected as structs and sorted; adjacent turns of
one role become one block; blocks are written with fixed markers. Output is a
list of segments (text, loss) whose concatenation is the training string; the
segments under the loss mask are exactly the assistant's texts.

    <s>[INST]role[ROLE]\\ntext\\n[SEP]\\ntext\\n[/INST]...</s>

``[SEP]`` stands between the texts of merged turns, so that reading back gives
every turn as it was. A marker inside a role or text gets a backslash after its
first character, and a backslash is doubled; :func:`unescape` undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[SEP]")
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in MARKERS:
        out = F.replace(out, F.lit(m), F.lit(m[0] + "\\" + m[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for m in MARKERS:
        out = F.replace(out, F.lit(m[0] + "\\" + m[1:]), F.lit(m))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv, segments array<struct<text, loss>>), one row per conversation.

    Turns are sorted by turn, then role, then text, nulls first, so ties and
    repeated rows have one order and all stay. Null roles and texts count as
    empty; a null conversation id is a conversation; an empty table gives no
    rows; other columns are not read. A conversation's string is one row, so
    its turns meet in one task: all steps are linear in its length.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # Starts of blocks of one role, counted from 1, and one past the end.
    changes = F.expr("concat(filter(sequence(1, size(t)), i -> i = 1 or t[i - 1].role != t[i - 2].role),"
                     " array(size(t) + 1))")
    rows = rows.withColumn("at", changes)
    rows = rows.withColumn("blocks", F.expr(
        "transform(sequence(1, size(at) - 1), b -> named_struct('role', t[at[b - 1] - 1].role,"
        " 'texts', transform(slice(t, at[b - 1], at[b] - at[b - 1]), x -> x.text)))"))

    def segment(text: Column, loss: Column | bool = False) -> Column:
        return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def block(b: Column) -> Column:
        head = segment(F.concat(F.lit("[INST]"), escape(b["role"]), F.lit("[ROLE]\n")))
        texts = F.transform(b["texts"], lambda x, i: F.array(
            segment(F.when(i > 0, F.lit("\n[SEP]\n")).otherwise(F.lit(""))),
            segment(escape(x), b["role"] == ASSISTANT)))
        return F.concat(F.array(head), F.flatten(texts), F.array(segment(F.lit("\n[/INST]"))))

    segments = F.concat(F.array(segment(F.lit("<s>"))), F.flatten(F.transform("blocks", block)),
                        F.array(segment(F.lit("</s>"))))
    return rows.select(F.col("conv").alias(conv_col), F.filter(segments, lambda s: s["text"] != "").alias("segments"))


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.col(segments)["text"], "")


def read_back(text: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted string."""
    inner = F.substring(text, 4, F.length(text) - 7)  # without <s> and </s>
    blocks = F.filter(F.split(inner, "\n\\[/INST\\]", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(F.substr(b, F.lit(7)), "\\[ROLE\\]\n", 2)
        texts = F.split(parts[1], "\n\\[SEP\\]\n", -1)
        return F.transform(texts, lambda x: F.struct(unescape(parts[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digest columns read back from the formatted strings and their loss masks."""
    nl = F.lit("\n")
    out = chats.withColumn("s", formatted()).withColumn("turns", read_back(F.col("s")))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = out.withColumn("loss", masked)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return out.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("s").cast("long").alias("formatted_chars"))


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for m in MARKERS:
        out = f"replace({out}, '{m}', '{m[0]}\\{m[1:]}')"
    return out


PLANTED = "</s>[INST] ok [/INST]"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       (7 + sum(length({_sql_escape('text')}) + CASE WHEN prior = role THEN 7
                ELSE length({_sql_escape('role')}) + 6 + 7 + 8 END))::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""
