"""Chat formatting with Spark expressions alone.

Template: each run of turns of one role is ``<s>[role] text</s>``; texts of merged turns have ``[+]`` between them. In
texts and roles ``&``, ``<``, ``[`` and ``]`` become entities, so no control string can occur inside them and every text
comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
OPEN, ROLE_END, JOIN, CLOSE = "<s>[", "] ", "[+]", "</s>"
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss) whose texts make up ``formatted``.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one result and each counts.
    Null roles and texts are empty. Rows of null conversations make one conversation. Adjacent turns of one role are
    merged into one block. Other columns aren't read; an empty table gives no rows.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn("starts", F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR element_at(turns, i).role <> element_at(turns, greatest(i - 1, 1)).role)"))
    chats = chats.withColumn("blocks", F.expr("transform(starts, (s, k) -> slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s))"))

    def segment(text: Column, loss: Column | bool) -> Column:
        return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def block(turns: Column) -> Column:
        role = turns[0]["role"]
        texts = F.flatten(
            F.transform(
                turns,
                lambda t, i: F.when(i > 0, F.array(segment(F.lit(JOIN), False), segment(escape(t["text"]), role == trained))).otherwise(F.array(segment(escape(t["text"]), role == trained))),
            )
        )
        return F.concat(F.array(segment(F.concat(F.lit(OPEN), escape(role), F.lit(ROLE_END)), False)), texts, F.array(segment(F.lit(CLOSE), False)))

    chats = chats.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ROLE_END, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + len(ROLE_END) + 1)
        return F.transform(F.split(body, r"\[\+\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = format_chats(table.unionByName(spark.createDataFrame(PLANTED, table.schema)))
    chats = chats.withColumn("read", read_turns(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _length(column: str) -> str:
    """Characters of an escaped text, in SQL."""
    return f"length({column})" + "".join(f" + {len(e) - 1} * (length({column}) - length(replace({column}, '{r}', '')))" for r, e in ENTITIES)


OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES {', '.join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PLANTED)}
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS same FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_length('text')} + CASE WHEN same THEN {len(JOIN)} ELSE {len(OPEN + ROLE_END + CLOSE)} + {_length('role')} END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
