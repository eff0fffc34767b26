"""Preference formatting of chosen and rejected conversations, in DataFrame operations.

The longest common prefix of the two conversations' turns (role and text equal) is rendered once as the prompt; what follows
in either is its completion. A completion comes with the character spans that are trained on: the texts of assistant
turns with their end marks; all else is masked. What looks like a mark in a role or text is escaped (``\\`` and the bar of ``<|``
in texts, ``\\`` and every bar in roles), so marks always come from the rendering.

Cases: turns are ordered by turn number, null numbers first; turns with one number, and repeated rows, by role and text; null
roles and texts are empty; pairs whose conversations are equal have empty completions and `differs` false; completions
without a reply have no spans; a pair missing from one table has no row; null conversation ids are left out; an empty table
gives an empty table; other columns are ignored. A conversation becomes one row, however long, as its rendering is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import only

#: The rendering of a turn.
HEAD, NECK, TAIL = "<|", "|>\n", "<|end|>\n"
#: Conversations among whose replies rejected ones are drawn: a stretch of ids.
STRETCH = 1000


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each conversation's turns in order."""
    src = only(conversations, key, "turn", "role", "text").where(F.col(key).isNotNull())
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return src.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escaped(turns: Column) -> Column:
    text = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    role = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.transform(turns, lambda t: F.struct(role(t["role"]).alias("mark"), text(t["text"]).alias("text"), t["role"].alias("role")))


def rendered(turns: Column) -> Column:
    """The text of escaped turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["mark"], F.lit(NECK), t["text"], F.lit(TAIL))), "")


def trained(turns: Column) -> Column:
    """Spans (start, stop) of a rendering of escaped turns that are trained on, by one pass over them."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(st: Column, t: Column) -> Column:
        start = st["at"] + len(HEAD) + F.length(t["mark"]) + len(NECK)
        stop = start + F.length(t["text"]) + len(TAIL)
        span = F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"))
        return F.struct(stop.cast("bigint").alias("at"), F.when(t["role"] == "assistant", F.concat(st["spans"], F.array(span))).otherwise(st["spans"]).alias("spans"))

    return F.aggregate(turns, first, step, lambda st: st["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a pair of conversations (pair_id, turns) with one id."""
    both = chosen.select("pair_id", F.col("turns").alias("c")).join(rejected.select("pair_id", F.col("turns").alias("r")), "pair_id")
    least = F.least(F.size("c"), F.size("r"))
    # places where the conversations differ; the first one ends the prefix
    differ = F.filter(F.transform(F.arrays_zip("c", "r"), lambda z, i: F.when(z["c"].eqNullSafe(z["r"]) & (i < least), -1).otherwise(i)), lambda i: i >= 0)
    both = both.withColumn("k", F.coalesce(F.try_element_at(differ, F.lit(1)), least))
    rest = lambda c: escaped(F.slice(c, F.col("k") + 1, F.greatest(F.size(c), F.lit(1))))
    out = both.select("pair_id", F.col("k").cast("bigint").alias("n_prompt_turns"), escaped(F.slice("c", F.lit(1), F.col("k"))).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return out.select(
        "pair_id", "n_prompt_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), trained(F.col("c")).alias("chosen_spans"),
        rendered(F.col("r")).alias("rejected"), trained(F.col("r")).alias("rejected_spans"), ((F.size("c") > 0) | (F.size("r") > 0)).alias("differs"),
    )


def contrasted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation whole as the chosen one, and as the rejected one its first turns followed by the later turns of the next
    conversation in its stretch of ids (of the first one for the last). They part after 1 to n - 1 of its n turns, by its id, or
    later where the turns happen to be equal."""
    turns = turns_of(conversations)
    by = Window.partitionBy(F.floor(F.col("conv_id") / STRETCH)).orderBy("conv_id")
    own = F.lit(1) + F.pmod("conv_id", F.greatest(F.lit(1), F.size("turns") - 1)).cast("int")
    pairs = turns.select(F.col("conv_id").alias("pair_id"), "turns", own.alias("own"), F.coalesce(F.lead("turns").over(by), F.first("turns").over(by)).alias("other"))
    later = F.when(F.size("other") > F.col("own"), F.slice("other", F.col("own") + 1, F.size("other"))).otherwise(F.slice("other", 1, 0))
    return turns.select(F.col("conv_id").alias("pair_id"), "turns"), pairs.select("pair_id", F.concat(F.slice("turns", F.lit(1), F.col("own")), later).alias("turns"))


def flat(pairs: DataFrame) -> DataFrame:
    """Spans as text, start:stop joined by commas."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return pairs.withColumn("chosen_spans", text("chosen_spans")).withColumn("rejected_spans", text("rejected_spans"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(preference_pairs(*contrasted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, 1 + conv_id % greatest(1, count(*) - 1) AS own FROM t GROUP BY conv_id),
pairs AS (SELECT conv_id, own, coalesce(lead(conv_id) OVER w, first(conv_id) OVER w) AS other FROM sizes WINDOW w AS (PARTITION BY floor(conv_id / 1000) ORDER BY conv_id)),
r AS (SELECT t.* FROM t JOIN pairs p ON t.conv_id = p.conv_id AND t.i <= p.own UNION ALL SELECT p.conv_id, t.role, t.text, t.i FROM t JOIN pairs p ON t.conv_id = p.other AND t.i > p.own),
same AS (SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, coalesce(min(coalesce(t.i, r.i)) FILTER (WHERE t.i IS NULL OR r.i IS NULL OR t.role <> r.role OR t.text <> r.text), max(t.i) + 1) - 1 AS p FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.i = r.i GROUP BY 1),
lines AS (SELECT 'c' AS side, conv_id, i, role, replace(replace(text, '\', '\\'), '<|', '<\|') AS text FROM t UNION ALL SELECT 'r', conv_id, i, role, replace(replace(text, '\', '\\'), '<|', '<\|') FROM r),
mark AS (SELECT l.*, s.p, '<|' || replace(replace(role, '\', '\\'), '|', '\|') || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM lines l JOIN same s USING (conv_id)),
place AS (SELECT *, sum(CASE WHEN i > p THEN length(line) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY i) AS stop FROM mark),
body AS (SELECT side, conv_id, any_value(p) AS p, string_agg(line, '' ORDER BY i) FILTER (WHERE i <= p) AS prompt, string_agg(line, '' ORDER BY i) FILTER (WHERE i > p) AS rest,
  string_agg(CAST(stop - length(text) - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY i) FILTER (WHERE i > p AND role = 'assistant') AS spans FROM place GROUP BY side, conv_id)
SELECT c.conv_id AS pair_id, CAST(c.p AS BIGINT) AS n_prompt_turns, coalesce(c.prompt, '') AS prompt, coalesce(c.rest, '') AS chosen, coalesce(c.spans, '') AS chosen_spans,
  coalesce(r.rest, '') AS rejected, coalesce(r.spans, '') AS rejected_spans, c.rest IS NOT NULL OR r.rest IS NOT NULL AS differs
FROM body c JOIN body r ON c.conv_id = r.conv_id AND c.side = 'c' AND r.side = 'r'
"""
