"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

A logged conversation may be an earlier snapshot of a longer one.  The turns of each
conversation are put in order and hashed cumulatively, turn by turn; a conversation whose
whole hash is a proper-prefix hash of another is dropped, and of equal conversations the
smallest id stays.  What remains is rendered.

Hashes are pairs of 64-bit hashes, chained.  Prefix hashes are made distinct before the
shuffle's merge, so a first turn that a third of all conversations share is one row.

Defined cases: turns are ordered by turn (nulls first), then role and text; exact repeats
of a turn count once; a null role reads "unknown", a null text is empty; rows without a
conversation id belong to no conversation and are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The marks around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _chained(turns: Column) -> Column:
    """The hash after each turn, as an array of structs (a, b)."""
    start = F.array(F.struct(F.lit(11).cast("long").alias("a"), F.lit(29).cast("long").alias("b")))

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(F.xxhash64(last["a"], t["role"], t["text"]).alias("a"), F.xxhash64(t["text"], last["b"], t["role"], F.lit(7)).alias("b"))))

    return F.aggregate(turns, start, step, lambda acc: F.slice(acc, 2, F.size(acc) - 1))


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of turn, role, text in order) and hashes (after each turn)."""
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list("t")), _in_order).alias("turns"))
    return grouped.withColumn("hashes", _chained(F.col("turns")))


def _in_order(a: Column, b: Column) -> Column:
    turn = F.when(a["turn"].eqNullSafe(b["turn"]), F.lit(0)).when(a["turn"].isNull(), F.lit(-1)).when(b["turn"].isNull(), F.lit(1)).when(a["turn"] < b["turn"], F.lit(-1)).otherwise(F.lit(1))
    rest = F.when(a["role"] < b["role"], F.lit(-1)).when(a["role"] > b["role"], F.lit(1)).when(a["text"] < b["text"], F.lit(-1)).when(a["text"] > b["text"], F.lit(1)).otherwise(F.lit(0))
    return F.when(turn != 0, turn).otherwise(rest)


def rendered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The maximal conversations: conv_id, n_turns, n_copies (equal conversations, itself included), chat."""
    all_ = conversations(rows, conv_col, turn_col, role_col, text_col)
    narrow = all_.select("conv_id", F.size("turns").alias("n"), F.element_at("hashes", -1).alias("whole"), "hashes")
    first = narrow.groupBy("n", "whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = narrow.select(F.posexplode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("k", "whole")).select((F.col("k") + 1).alias("n"), "whole").distinct()
    maximal = first.join(prefixes, ["n", "whole"], "left_anti").select("conv_id", "n_copies")
    turn = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    return all_.join(maximal, "conv_id").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(turn, "").alias("chat"))


CHAT_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (SELECT conv_id, k, string_agg('{BEGIN}' || role || chr(10) || text || '{END}' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k) AS chat FROM o),
w AS (SELECT conv_id, max(k) AS n_turns, max_by(chat, k) AS chat FROM c GROUP BY conv_id),
f AS (SELECT n_turns, chat, min(conv_id) AS conv_id, count(*) AS n_copies FROM w GROUP BY n_turns, chat),
p AS (SELECT DISTINCT c.k AS n_turns, c.chat FROM c JOIN w ON c.conv_id = w.conv_id AND c.k < w.n_turns)
SELECT conv_id, n_turns, n_copies, chat FROM f ANTI JOIN p USING (n_turns, chat)
"""
