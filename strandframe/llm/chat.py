"""Chat formatting with prefix-target expansion, in built-in DataFrame functions only.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Every assistant turn is exploded into an example
of its own, a row of the ``examples`` table: all preceding turns are its context, and only its reply is
trainable. All contexts of one conversation are prefixes of the same formatted stream, so the stream is
written once, in chunks of ``CHUNK`` turn numbers, and an example names its context by length and its reply
by a span. A conversation of any length thus costs space in proportion to its length, and no task holds
more than a chunk while formatting (turns of equal or null number share a chunk, as their order is that of
their texts). ``materialise`` gives the examples' full texts, whose size is by nature quadratic.

Escapes: ``\\`` becomes ``\\b``, the first character of any control string is followed by ``\\p``, and a
newline in a role becomes ``\\n``. No control string is left in an escaped text, and ``unescape`` gives
back the text exactly.

Defined results: null text or role is empty; turns are ordered by turn (null first), then role and
text, so ties are settled; repeated rows are repeated turns; a null conv_id is a conversation; an
empty table gives no chunks; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import discard, fresh_path, stash, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in common use give a meaning to.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CHUNK = 256

_HEADS = "|".join(r"\Q%s\E(?=\Q%s\E)" % (c[0], c[1:]) for c in CONTROL)
_TURN = r"(?s)\Q%s\E([^\n]*)\n(.*?)\Q%s\E\n" % (START, END)


def escape(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), f"({_HEADS})", r"$1\\p")
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("\\p"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def format_chunks(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk, its formatted text, and its examples' target spans (0-based, within the chunk)."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = turns.groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    made = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escape(t.role, True), F.lit("\n")).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("loss")))
    c = chunks.select("conv_id", "chunk", made.alias("made"))
    tail = F.lit(f"{END}\n")
    text = F.array_join(F.transform("made", lambda m: F.concat(m.head, m.body, tail)), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))
    step = lambda a, m: F.struct(
        (a.at + F.length(m.head) + F.length(m.body) + len(END) + 1).alias("at"),
        F.when(m.loss, F.concat(a.spans, F.array(F.struct((a.at + F.length(m.head)).alias("start"), F.length(m.body).alias("chars"))))).otherwise(a.spans).alias("spans"),
    )
    return c.select("conv_id", "chunk", F.size("made").alias("n_turns"), text.alias("formatted"), F.aggregate("made", start, step, lambda a: a.spans).alias("targets")).withColumn("chars", F.length("formatted").cast("long"))


def examples(chunks: DataFrame) -> DataFrame:
    """One row per assistant turn: all that stands before it is context, and only its reply is trainable.

    ``context_chars`` counts from the begin of the conversation's stream; ``start`` is the reply's place in
    its chunk, and ``target_chars`` its length.
    """
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.select("conv_id", "chunk", "chars", "targets")
    placed = sizes.withColumns({"base": F.coalesce(F.sum("chars").over(before), F.lit(0)), "earlier": F.coalesce(F.sum(F.size("targets")).over(before), F.lit(0))})
    each = placed.select("conv_id", "chunk", "base", "earlier", F.posexplode("targets").alias("i", "t"))
    return each.select("conv_id", (F.col("earlier") + F.col("i")).alias("example"), "chunk", (F.col("base") + F.col("t.start")).alias("context_chars"), F.col("t.start").cast("long").alias("start"), F.col("t.chars").cast("long").alias("target_chars"))


def materialise(chunks: DataFrame, examples: DataFrame) -> DataFrame:
    """Context and target texts of every example (quadratic in a conversation's length by nature)."""
    stream = chunks.select(F.col("conv_id").alias("conv"), F.col("chunk").alias("c"), "formatted")
    parts = examples.join(stream, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("c") <= F.col("chunk")))
    whole = parts.groupBy("conv_id", "example", "context_chars", "target_chars").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "formatted"))), lambda x: x.formatted), "").alias("s"))
    return whole.select("conv_id", "example", F.expr("substring(s, 1, int(context_chars))").alias("context"), F.expr("substring(s, int(context_chars) + 1, int(target_chars))").alias("target"))


def write_examples(conversations: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Two tables in a folder: ``streams`` (the formatted chunks) and ``examples`` (a row per assistant turn)."""
    spark = conversations.sparkSession
    made, at = stash(format_chunks(conversations, chunk), "chat")
    made.select("conv_id", "chunk", "n_turns", "chars", "formatted").write.parquet(f"{path}/streams")
    examples(made).write.parquet(f"{path}/examples")
    discard(spark, at)


def read_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/streams"), spark.read.parquet(f"{path}/examples")


def read_back(streams: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, from what was written alone: its turns from the stream, and the text under the loss mask of its examples, unescaped.

    Examples meet their chunk as one row of spans, so a chunk's text is not copied for each of them.
    """
    spans = examples.groupBy(F.col("conv_id").alias("conv"), F.col("chunk").alias("c")).agg(F.sort_array(F.collect_list(F.struct("example", "start", "target_chars"))).alias("spans"))
    both = streams.join(spans, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("chunk") == F.col("c")), "left")
    roles, texts = (F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(g)) for g in (1, 2))
    c = both.select("conv_id", "chunk", "chars", "formatted", "spans", F.arrays_zip(roles.alias("role"), texts.alias("text")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(unescape(t.role, True), F.lit("\n"), unescape(t.text), F.lit("\n"))), "")
    stream = F.col("formatted")
    loss = F.array_join(F.transform(F.coalesce("spans", F.array()), lambda t: unescape(F.substring(stream, (t.start + 1).cast("int"), t.target_chars.cast("int")))), "")
    parts = c.select("conv_id", "chars", F.size("turns").cast("long").alias("n"), F.struct("chunk", said.alias("said"), loss.alias("loss")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("ps"))
    joined = lambda name: F.array_join(F.transform("ps", lambda p: p[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "'</s>[INST] ok [/INST]'"
    extra = spark.range(2).selectExpr("-7L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"{probe} text")
    path = fresh_path(spark, "chat-examples")
    write_examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra), path)
    return read_back(*read_examples(spark, path))


_ESCAPED = r"regexp_replace(replace(coalesce(text, ''), '\', '\b'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\p\2\4', 'g')"
OP6_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED} AS body FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum(length(body) + length(replace(role, chr(10), '\n')) + 12 + 1 + 10 + 1) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
