"""Chat formatting with typed content parts.

A visitor goes over the parts of a turn and flattens them: text is escaped,
image, audio and document parts become numbered placeholders, their references
and expanded token counts are recorded. Turns stand between control strings;
control strings inside texts are escaped and can be restored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
# Strings that chat templates give a meaning. The first character is what the escape follows.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\"
#: Tokens that one unit of an attachment expands to: image tiles, seconds of audio, pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
BLOCK = 512             # code points of a formatted text that are cut out together
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """Double each backslash, then break control strings by a single one."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """A turn of one text part; null reads as empty."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def _visit(part: Column, number: Column, tokens_per_unit: Mapping[str, int]) -> Column:
    """(piece, attachment or null, tokens) of one part; unknown kinds read as text."""
    kind, content = part["kind"], F.coalesce(part["text"], F.lit(""))
    units = F.coalesce(part["units"], F.lit(1))
    piece, tokens, known = escape(content), F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(False)
    for name, each in tokens_per_unit.items():
        here = F.coalesce(kind == name, F.lit(False))
        piece = F.when(here, F.concat(F.lit(f"<|{name}:"), number.cast("string"), F.lit("|>"))).otherwise(piece)
        tokens = F.when(here, units * each).otherwise(tokens)
        known = known | here
    return F.struct(piece.alias("piece"), tokens.cast("bigint").alias("tokens"), F.when(known, F.struct(
        kind.alias("kind"), part["ref"].alias("ref"), number.cast("int").alias("part"),
        (units * F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in tokens_per_unit.items()])).alias("tokens"),
    )).alias("attachment"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts_col: str = "parts", loss_roles: Sequence[str] = ("assistant",),
    tokens_per_unit: Mapping[str, int] = TOKENS_PER_UNIT,
) -> DataFrame:
    """One row per conversation: ``formatted``, ``segments``, ``loss_spans``, ``attachments``, ``tokens``, ``n_turns``.

    ``parts_col`` is an array of ``PART``. ``segments`` (text, loss) join to
    ``formatted``, and those with ``loss`` are the loss mask; ``loss_spans``
    gives the same as code-point ranges, end exclusive. ``attachments`` are in
    order, with the turn's position and the number in the placeholder, which
    counts the parts of the turn from 0.

    Turns go by ``turn_col`` (null first), ties by role and content, so equal
    rows may be repeated. Null roles, texts and part arrays read as empty, a
    null conversation id is a conversation. An empty table gives no rows;
    other columns are left out. The answer is one string per conversation, so
    a conversation has to fit in a row, and only that.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    rows = turns.select(
        F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
        F.transform(parts, lambda p, i: _visit(p, i, tokens_per_unit)).alias("_seen"))
    rows = rows.select(
        "_c", "_t", "_role", F.array_join(F.transform("_seen", lambda s: s["piece"]), "").alias("_body"),
        F.filter(F.transform("_seen", lambda s: s["attachment"]), lambda a: a.isNotNull()).alias("_files"),
        F.aggregate("_seen", F.lit(0).cast("bigint"), lambda n, s: n + s["tokens"]).alias("_tokens"),
        F.concat(F.lit(START), escape(F.col("_role")), F.lit(MIDDLE)).alias("_head"),
        F.col("_role").isin(list(loss_roles)).alias("_loss"))
    order = Window.partitionBy("_c").orderBy("_t", "_role", "_body")
    length = F.length("_head") + F.length("_body") + len(END)
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn(
        "_to", F.sum(length.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.col("_to") - len(END)
    piece = F.struct(
        "_n", F.array(
            F.struct(F.col("_head").alias("text"), F.lit(False).alias("loss")),
            F.struct(F.col("_body").alias("text"), F.col("_loss").alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))).alias("segments"),
        F.when(F.col("_loss"), F.struct((stop - F.length("_body")).alias("start"), stop.alias("end"))).alias("span"),
        F.transform("_files", lambda f: f.withField("turn", F.col("_n"))).alias("files"))
    chats = rows.groupBy("_c").agg(
        F.sort_array(F.collect_list(piece)).alias("_pieces"), F.sum("_tokens").alias("tokens"),
        F.count("*").alias("n_turns"))
    chats = chats.withColumn("segments", F.flatten(F.transform("_pieces", lambda p: p["segments"])))
    return chats.select(
        F.col("_c").alias(conv_col), "n_turns", "tokens",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        F.filter(F.transform("_pieces", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("_pieces", lambda p: p["files"])).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, read back from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t, i: i > 0)

    def one(t: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(t, MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(t, END, 1), MIDDLE, -1)).alias("text"))

    return F.transform(turns, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text of a formatted conversation under the loss mask, restored, nothing between.

    Spans are cut from blocks, as finding a place in a long string takes time
    in proportion to the place.
    """
    def cut(blocks: Column, s: Column) -> Column:
        first = F.floor(s["start"] / BLOCK).cast("int")
        some = F.slice(blocks, first + 1, F.ceil(s["end"] / BLOCK).cast("int") - first)
        return F.substring(F.array_join(some, ""), (s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int"))

    # As the variable of a function the blocks are computed once, not per span.
    blocks = F.array(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    return F.get(F.transform(blocks, lambda b: F.array_join(F.transform(spans, lambda s: unescape(cut(b, s))), "")), F.lit(0))
