"""Chat formatting with a grammar round trip. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import read_table, spread

END, HEAD = "</turn>", "### "
TURN = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def _controls(c: Column) -> Column:
    return _replace(_replace(c, END, r"<\/turn>"), HEAD, r"#\## ")


def _escaped(c: Column) -> Column:
    return _controls(_replace(c, "\\", "\\\\"))


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\/#:])", "$1")


def _turns(formatted: Column) -> Column:
    """The deterministic parser: an array of (role, text) read from a string alone: cut at each end mark, split at the first
    colon outside an escape, unescape."""
    parts = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(_unescaped(F.regexp_extract(p, TURN, 1)).alias("role"), _unescaped(F.regexp_extract(p, TURN, 2)).alias("text")))


def _line(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(": "), text, F.lit(END + "\n"))


def body(role: Column, text: Column) -> Column:
    """A text as it stands in its turn: at the least level of escaping (none, control strings, backslashes too) at which the
    turn, rendered, is parsed back into the same role and text, and holds no control string."""
    written = _replace(_escaped(role), ":", r"\:")

    def same(c: Column) -> Column:
        back = _turns(_line(written, c))
        return ~F.contains(c, F.lit(END)) & ~F.contains(c, F.lit(HEAD)) & (F.size(back) == 1) & (F.get(back, 0)["role"] == role) & (F.get(back, 0)["text"] == text)

    return F.when(same(text), text).when(same(_controls(text)), _controls(text)).otherwise(_escaped(text))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, source (array of turn, role, text), formatted, a string for each conversation, and spans, an array of the places
    (start, end, in code points) where each turn's text stands in it, with its role.

    A turn reads ``### role: text</turn>`` and a line feed; ``</turn>`` and ``### `` never stand in a text or
    role unescaped. Turns are in the order of turn, role, text (null turns first); null texts and roles
    are empty; equal rows are turns of their own; all rows of null conv_id are one conversation; extra columns are ignored; an empty
    table gives none. A conversation is one string, so it must fit a task: 2 GB with its source at most.
    """
    t = spread(turns, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("body", body(F.col("role"), F.col("text"))).withColumn("line", _line(_replace(_escaped(F.col("role")), ":", r"\:"), F.col("body")))
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("end", F.sum(F.length("line")).over(upto) - (len(END) + 1))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end", "line", F.length("body").alias("n")))).alias("all"))
    spans = F.transform("all", lambda x: F.struct((x["end"] - x["n"]).cast("int").alias("start"), x["end"].cast("int").alias("end"), x["role"].alias("role")))
    return t.select("conv_id", F.transform("all", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"))).alias("source"), F.array_join(F.transform("all", lambda x: x["line"]), "").alias("formatted"), spans.alias("spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text) read from formatted alone."""
    return formatted.withColumn("turns", _turns(F.col("formatted")))


def format_conversations(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask (where loss is taken: the spans of ``role``'s texts in formatted), turns (read back) and
    roundtrip_ok (they equal the source)."""
    out = parse(render(turns))
    same = F.to_json(F.transform("source", lambda x: F.struct(x["role"], x["text"]))) == F.to_json(F.transform("turns", lambda x: F.struct(x["role"], x["text"])))
    mask = F.transform(F.filter("spans", lambda x: x["role"] == role), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return out.select("conv_id", "formatted", mask.alias("mask"), "turns", F.coalesce(same, F.lit(False)).alias("roundtrip_ok"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under a mask, unescaped, in order."""
    return F.transform(mask, lambda m: _unescaped(F.substring(formatted, m["start"] + 1, m["end"] - m["start"])))


def op6_chat(spark, sf_dir):
    """Digests of every conversation, read back from its formatted string."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    got = format_conversations(spread(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"]).unionByName(extra))
    return got.withColumn("loss", F.array_join(under_mask(F.col("formatted"), F.col("mask")), "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "roundtrip_ok",
    )


OP6_SQL = r"""
WITH b AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '</turn>', '<\/turn>'), '### ', '#\## ') AS t1,
  replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS t2,
  replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') AS r2 FROM b),
f AS (SELECT *, CASE WHEN regexp_replace(text, '\\([\\/#:])', '\1', 'g') = text AND NOT contains(text, '</turn>') AND NOT contains(text, '### ') THEN text
  WHEN regexp_replace(t1, '\\([\\/#:])', '\1', 'g') = text THEN t1 ELSE t2 END AS body FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(r2) + length(body) + 14) AS BIGINT) AS formatted_chars,
  true AS roundtrip_ok
FROM f GROUP BY conv_id
"""
