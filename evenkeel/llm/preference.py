"""Preference formatting in built-in expressions: the common turns of a chosen and a rejected conversation once, then both completions.

The prompt holds the longest common prefix of turns (same role and text, null like null); each completion holds the rest of its
conversation. Only text of the assistant in a completion is to be learned; its spans, in code points, are the loss mask.

Turns are ordered by (turn, role, text), nulls first; repeated rows stay repeated turns. A null role is shown as ``unknown``, a null
text as empty. A pair becomes one row, so its two conversations must fit in a row; turns of other pairs never meet in a task's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import register, table
from .fingerprint import let

LEARNED = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.coalesce(t["text"], F.lit(""))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("<|end|>\n"))), "")


def spans(turns: Column) -> Column:
    """``start-end`` of every learned text in the rendered turns, comma-joined."""
    size = lambda t: F.length(_head(t)) + F.length(_body(t)) + len("<|end|>\n")

    def step(state: Column, t: Column) -> Column:
        at = state["at"] + F.length(_head(t))
        span = F.concat_ws("-", at.cast("string"), (at + F.length(_body(t))).cast("string"))
        own = F.when(t["role"] == LEARNED, F.concat(state["own"], F.array(span))).otherwise(state["own"])
        return F.struct((state["at"] + size(t)).alias("at"), own.alias("own"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("own"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["own"]), ",")


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans) for ``turns`` (conv_id, turn, role, text).

    ``pairs`` (pair_id, conv_id, chosen boolean) names each pair's conversations; a pair with one side only has no preference and no row.
    """
    rows = turns.select("conv_id", "turn", "role", "text").join(pairs, "conv_id")
    return _rendered(_sides(rows.select("pair_id", "chosen", "turn", "role", "text")))


def _sides(rows: DataFrame) -> DataFrame:
    """(pair_id, a, b): the turns of the chosen and of the rejected conversation of every pair that has both, in order."""
    turn = F.struct("turn", "role", "text")
    side = lambda own: F.sort_array(F.collect_list(F.when(own, turn)))
    both = rows.groupBy("pair_id").agg(side(F.col("chosen")).alias("a"), side(~F.col("chosen")).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return both.select("pair_id", plain("a").alias("a"), plain("b").alias("b"))


def _rendered(both: DataFrame) -> DataFrame:
    """Pairs (pair_id, a, b) of the chosen and the rejected turns (role, text), neither empty, as prompt and completions."""
    n = F.least(F.size("a"), F.size("b"))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i)))
    both = both.withColumn("n_common", F.coalesce(F.get(differ, F.lit(0)), n))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    return both.select(
        "pair_id", "n_common", render(F.slice("a", F.lit(1), F.col("n_common"))).alias("prompt"),
        render(rest("a")).alias("chosen"), spans(rest("a")).alias("chosen_spans"),
        render(rest("b")).alias("rejected"), spans(rest("b")).alias("rejected_spans"),
    )


_SIDE = """
s{k} AS (SELECT pair_id, string_agg(piece, '' ORDER BY n) AS txt,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN (begin_at + head) || '-' || (begin_at + head + body) END, ',' ORDER BY n), '') AS spans
  FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
        FROM (SELECT t.* FROM t JOIN c USING (pair_id) WHERE side = {k} AND n > n_common)) GROUP BY pair_id)"""
_SQL = f"""
WITH own AS (SELECT conv_id AS pair_id, conv_id + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END AS mate, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, count(*) OVER (PARTITION BY conv_id) AS size,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece,
    length(coalesce(role, 'unknown')) + 5 AS head, length(coalesce(text, '')) AS body FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT * FROM own WHERE mate IN (SELECT pair_id FROM own)),
t AS (SELECT pair_id, 0 AS side, role, text, n, piece, head, body FROM u
    UNION ALL SELECT pair_id, 1, role, text, n, piece, head, body FROM u WHERE n < size
    UNION ALL SELECT u.pair_id, 1, m.role, m.text, u.n, m.piece, m.head, m.body FROM u JOIN u m ON m.pair_id = u.mate AND u.n = u.size AND m.n = m.size),
sizes AS (SELECT pair_id, max(CASE WHEN side = 0 THEN n END) AS na, max(CASE WHEN side = 1 THEN n END) AS nb FROM t GROUP BY pair_id),
same AS (SELECT a.pair_id, a.n FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.n = b.n AND a.side = 0 AND b.side = 1
    WHERE a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
run AS (SELECT pair_id, n, row_number() OVER (PARTITION BY pair_id ORDER BY n) AS r FROM same),
c AS (SELECT pair_id, coalesce(max(CASE WHEN run.n = r THEN r END), 0) AS n_common FROM sizes LEFT JOIN run USING (pair_id)
    WHERE na > 0 AND nb > 0 GROUP BY pair_id),
p AS (SELECT pair_id, string_agg(piece, '' ORDER BY n) AS txt FROM t JOIN c USING (pair_id) WHERE side = 0 AND n <= n_common GROUP BY pair_id),
{_SIDE.format(k=0).strip()}, {_SIDE.format(k=1).strip()}
SELECT c.pair_id, CAST(n_common AS INTEGER) AS n_common, coalesce(p.txt, '') AS prompt, coalesce(s0.txt, '') AS chosen, coalesce(s0.spans, '') AS chosen_spans,
    coalesce(s1.txt, '') AS rejected, coalesce(s1.spans, '') AS rejected_spans
FROM c LEFT JOIN p USING (pair_id) LEFT JOIN s0 USING (pair_id) LEFT JOIN s1 USING (pair_id)"""


@register("op3_preference_format", _SQL)
def op3(spark, sf_dir) -> DataFrame:
    """Every conversation is chosen; rejected is the same one with the last turn of its neighbour (2k and 2k + 1) in place of its own.

    ``pair_id`` is the chosen conversation; one without a neighbour has no pair. Rows of a null conv_id belong to no pair.
    """
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    both = _sides(turns.select(
        F.expr("floor(conv_id / 2)").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"
    ))
    swapped = lambda x, y: F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(y, F.size(y), F.lit(1)))
    pair = lambda at, x, y: F.struct((F.col("pair_id") * 2 + at).alias("pair_id"), F.col(x).alias("a"), swapped(F.col(x), F.col(y)).alias("b"))
    return _rendered(both.select(F.inline(F.array(pair(0, "a", "b"), pair(1, "b", "a")))))
