"""Chat formatting of typed content parts, DataFrame functions only.

A message's content is an array of parts (kind, text, ref, tokens). A visitor flattens them in order:
text parts are escaped, image, audio and document parts become numbered placeholders, whose attachment
reference and expanded token count are recorded. A turn is written as

    <turn>ROLE\\nCONTENT</turn>\\n

Escapes: in contents a backslash is doubled and a backslash follows any < that begins <turn, </turn or
<part; in roles backslash, line feed and < have a backslash before them. Therefore no control string
can stand in a content, and unescape() (drop each backslash, keep what follows it) restores any text.
The loss mask is a list of byte spans of the formatted text: the contents of the roles to learn from.

Defined results: null text and role count as empty; rows with a null conv_id are one conversation; turns
with equal numbers are ordered by role and then text, nulls first; repeated rows stay; an empty table
gives an empty result; other columns, whatever their names, are ignored. A conversation is one output
string and so is put together in one task; parts of it are never gathered further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that a placeholder stands for where its part doesn't say: fixed choices of ours.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<kind string, text string, ref string, tokens long>>"
PART_KINDS = tuple(DEFAULT_TOKENS)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(?=/?turn|part)", r"<\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\\n<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """Content that is one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))).cast(PARTS)


def _visit(part: Column, i: Column) -> Column:
    """What a part is flattened to."""
    holder = F.concat(F.lit("<part "), part["kind"], F.lit(" "), i.cast("string"), F.lit(">"))
    return F.when(part["kind"].isin(*PART_KINDS), holder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column) -> Column:
    usual = F.coalesce(*[F.when(part["kind"] == k, F.lit(n)) for k, n in DEFAULT_TOKENS.items()], F.lit(0))
    return F.when(part["kind"].isin(*PART_KINDS), F.coalesce(part["tokens"], usual.cast("long"))).otherwise(F.lit(0).cast("long"))


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns: conv_id, turn, role, parts (as PARTS). A row per conversation: conv_id, n_turns, formatted,
    loss_spans (start and length in bytes), attachments (turn place, part place, kind, ref, tokens), expanded_tokens."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    t = t.withColumn("body", F.array_join(F.transform("parts", _visit), "")).withColumn("head", head)
    t = t.withColumn("own", F.octet_length("head").cast("long")).withColumn("long", F.octet_length("body").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    t = t.withColumn("k", F.row_number().over(order))
    t = t.withColumn("start", F.sum(F.col("own") + F.col("long") + len(CLOSE)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("long") - len(CLOSE))
    held = F.filter(F.transform("parts", lambda p, i: F.when(p["kind"].isin(*PART_KINDS), F.struct(F.col("k").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))), lambda x: x.isNotNull())
    t = t.withColumn("held", held).withColumn("text", F.concat("head", "body", F.lit(CLOSE)))
    span = F.when(F.col("role").isin(*loss_roles), F.struct("start", "long"))
    got = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("k", "text", span.alias("span"), "held"))).alias("all"))
    return got.select(
        "conv_id", "n_turns", F.array_join("all.text", "").alias("formatted"), F.filter("all.span", lambda x: x.isNotNull()).alias("loss_spans"), F.flatten("all.held").alias("attachments"),
        F.aggregate(F.flatten("all.held"), F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted texts: adds turns (role and text, unescaped) and loss_texts (unescaped)."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    whole = r"(?s)\A<turn>((?:[^\\\n<]++|\\.)*+)\n(.*)\z"
    turns = F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, whole, 1)).alias("role"), unescape(F.regexp_extract(x, whole, 2)).alias("text")))
    data = F.col("formatted").cast("binary")
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(data, (s["start"] + 1).cast("int"), s["long"].cast("int")).cast("string")))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", masked)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    back = read_back(format_chat(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", "n_turns", F.sha2(said_all, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


ORACLE_SQL = r"""
with t as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), u as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from t
), v as (
  select *, regexp_replace(replace(text, '\', '\\'), '<(/?turn|part)', '<\\\1', 'g') as body,
    regexp_replace(role, '([\\\n<])', '\\\1', 'g') as head
  from u
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(head) + length(body) + 15) as bigint) as formatted_chars
from v group by conv_id
"""
