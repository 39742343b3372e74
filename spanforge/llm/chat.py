"""Operator 8, chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are its context (the prefix), its own turn is the target, and only the
reply in it is trainable.  ``read_examples`` expands the formatted conversations to these: an example is a row with its whole
context, its target and where the loss begins and ends in the two (code points).  All examples of a conversation have as many
characters as its prefixes together, so they are made a row at a time and not shuffled.  ``expand`` names them by offsets alone.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles a backslash is doubled and every control string of
``CONTROL`` gets a backslash after its first character, so no text can end or begin a turn, and ``unescape`` restores it.

Null texts and roles count as empty; rows with a null ``conv_id`` form one conversation; null turns come first; rows of equal
turn are ordered by role, then text, and repeated rows stay; an empty table gives an empty result; other columns are dropped.
A conversation's digests need its text in one row, as does any consumer that trains on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as X

# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in s)


_HEADS = "(?:" + "|".join(f"{_quoted(s[0])}(?={_quoted(s[1:])})" for s in CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_HEADS})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\N"))


def unescape_role(role: Column) -> Column:
    parts = F.regexp_extract_all(role, F.lit(r"\\(?s:.)|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "\\N", "\n").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)), "")


def segments(df: DataFrame) -> DataFrame:
    """One row per turn: its formatted segment, where that begins in the conversation, and the part that may be trained on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    rows = rows.withColumns({"head_chars": F.length(head).cast("long"), "body_chars": F.length(body).cast("long"), "segment": F.concat(head, body, F.lit(END)), "target": F.col("role") == TARGET})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "turn", F.row_number().over(order).alias("place"), "segment", F.coalesce(before, F.lit(0)).alias("segment_start"), "head_chars", "body_chars", "target")


def with_examples(turns: DataFrame) -> DataFrame:
    """``turns`` with ``example`` (context_chars, loss_start, loss_end) on those that may be trained on, else null."""
    start = F.col("segment_start") + F.col("head_chars")
    made = F.struct(F.col("segment_start").alias("context_chars"), start.alias("loss_start"), (start + F.col("body_chars")).alias("loss_end"))
    return turns.withColumn("example", F.when(F.col("target"), made))


def expand(turns: DataFrame) -> DataFrame:
    """The examples: one row per assistant turn of ``segments``."""
    return with_examples(turns).where("example IS NOT NULL").select("conv_id", "turn", "place", "segment", "example.*")


def read_examples(turns: DataFrame) -> DataFrame:
    """A row per turn, read from the formatted conversations: its place, what it says (``piece``), how many characters stand before
    it (``before``), and, if it is the assistant's, its example (else null): ``context`` and ``target`` are texts of their own."""
    listed = with_examples(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment", "example", "turn"))).alias("listed"))
    each = lambda name: F.transform("listed", lambda s: s[name])
    joined = listed.select("conv_id", F.array_join(each("segment"), "").alias("formatted"), each("example").alias("examples"), each("turn").alias("turns"))
    pieces = F.split("formatted", _quoted(END[:-1]) + "\n", -1)
    split = joined.select("*", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))
    chars = lambda p: F.length(p).cast("long") + len(END)
    before = X.scan(F.col("pieces"), F.lit(0).cast("long"), lambda at, p: at + chars(p), lambda at, p: F.array(at), "long")
    rows = split.select("conv_id", "formatted", F.posexplode(F.arrays_zip("pieces", "examples", "turns", before.alias("before"))).alias("place", "t"))
    example = F.col("t.examples")
    upto = lambda start, end: F.substr("formatted", (start + 1).cast("int"), (end - start).cast("int"))
    prefix, target = upto(F.lit(0), example["context_chars"]), upto(example["context_chars"], example["loss_end"] + len(END))
    return rows.select("conv_id", "place", F.col("t.turns").alias("turn"), F.col("t.pieces").alias("piece"), F.col("t.before").alias("before"), example.alias("example"), prefix.alias("context"), target.alias("target"))


def with_context(turns: DataFrame) -> DataFrame:
    """Examples with their whole text (context and target): as many characters as all prefixes have."""
    return read_examples(turns).where("example IS NOT NULL").select("conv_id", "turn", F.concat("context", "target").alias("text"), "example.loss_start", "example.loss_end")


def _joined(field: str) -> Column:
    return F.array_join(F.transform("rows", lambda r: r[field]), "").alias(field)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and its examples say: digests of the turns and of the replies to learn.  The
    replies are read from the examples' own texts; one whose context isn't all turns before its target, whose target isn't the
    whole turn, whose loss isn't the whole reply, or assistant turns without one, are an error."""
    piece, before, example, context, target = (F.col(c) for c in ("piece", "before", "example", "context", "target"))
    head, intro = len(START) + 1, F.lit(f"{START}{TARGET}\n")
    cut = F.instr(piece, "\n")
    turn = F.concat(unescape_role(F.substr(piece, F.lit(head), cut - head)), F.lit("\n"), unescape(F.substr(piece, cut + 1)), F.lit("\n"))
    # The length is looked at once, as a context may be long.
    whole = (F.length(context) == before) & (F.endswith(context, F.lit(END)) | (before == 0)) & (target == F.concat(piece, F.lit(END)))
    fits = whole & (example["loss_start"] == before + F.length(intro)) & (example["loss_end"] == before + F.length(piece))
    good = F.when(F.startswith(piece, intro), F.coalesce(fits, F.lit(False))).otherwise(example.isNull())
    reply = unescape(F.substr(target, (example["loss_start"] - before + 1).cast("int"), (example["loss_end"] - example["loss_start"]).cast("int")))
    loss = F.when(~good, F.raise_error(F.lit("an example does not fit its conversation"))).when(example.isNull(), "").otherwise(reply)
    rows = read_examples(turns).select("conv_id", "place", turn.alias("turn"), loss.alias("loss"), (before + F.length(piece) + len(END)).alias("upto"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "loss"))).alias("rows"), F.count("*").alias("n_turns"), F.max("upto").alias("formatted_chars"))
    joined = found.select("conv_id", "n_turns", "formatted_chars", _joined("turn"), _joined("loss"))
    return joined.select("conv_id", "n_turns", F.sha2("turn", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(segments(rows.unionByName(planted)))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 24)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
