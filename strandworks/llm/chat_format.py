"""Chat formatting by a grammar round trip, with DataFrame functions only.

Template (one turn)::

    ### <role>: <text>\\n</turn>\\n

The role is URL-encoded. Control strings are ``### `` and ``</turn>``; one that has no backslash before
it is markup. The parser cuts a rendering at each unescaped ``\\n</turn>\\n``, reads the header and takes
one backslash from each escaped control string of the body. A turn is first rendered as it stands;
where the parser doesn't give back exactly that turn, each of its control strings, with the backslashes
before it, gets one backslash more, and the result is parsed again. One more backslash always parses
back to the source, since the parser takes away exactly one; a rendering that still differs is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

END = "\n</turn>\n"
#: An unescaped end mark can follow only the newline of the template: escaped bodies hold none.
CONTROL = r"(\\*)(### |</turn>)"
HEADER = r"^### ([^:\s]*): "


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), F.url_encode(role), F.lit(": "), body, F.lit(END))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"\\(\\*)(### |</turn>)", "$1$2")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendering; null where it doesn't follow the grammar."""
    parts = F.split(formatted, END)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = (F.element_at(parts, -1) != "") | F.exists(turns, lambda s: ~s.rlike(HEADER) | F.regexp_replace(s, HEADER, "").rlike(r"(?<!\\)(### |</turn>)"))
    got = F.transform(turns, lambda s: F.struct(F.url_decode(F.regexp_extract(s, HEADER, 1)).alias("role"), unescape(F.regexp_replace(s, HEADER, "")).alias("text")))
    return F.when(~bad, got)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) in any row order -> conv_id, n_turns, formatted, loss_spans.

    loss_spans are (start, end) code points of assistant texts, as rendered, in ``formatted``. Null
    text and null role are empty; turns stand by turn (null first), equal turns by role, then text, and
    repeated rows all stay; rows of a null conv_id are one conversation. No rows give no rows; other
    columns are ignored. A conversation becomes one value, so it has to fit in one row; its rows are
    rendered and checked before they are gathered.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = lambda out: F.coalesce(parse(out) == F.array(F.struct(F.col("role"), F.col("text"))), F.lit(False))
    plain = render(F.col("role"), F.col("text"))
    rows = rows.withColumn("piece", F.when(same(plain), plain).otherwise(render(F.col("role"), escape(F.col("text")))))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    head = F.length(F.url_encode("role")) + 6
    span = F.struct((F.col("end") - F.length("piece") + head).alias("start"), (F.col("end") - len(END)).alias("end"))
    chats = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece", "role", "text", F.when(F.col("role") == "assistant", span).alias("span")))).alias("t")
    )
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    chats = chats.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"), source.alias("source"))
    whole = F.when(F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a rendering does not parse back to its source")).cast("string"))
    return chats.select("conv_id", "n_turns", whole.alias("formatted"), "loss_spans")


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
