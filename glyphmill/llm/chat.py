"""Chat formatting with typed content parts.

A message's content is an array of typed parts. A visitor has one method per type of part and gives, as columns, the
placeholder that stands for the part in the prompt, the reference to record, and the number of tokens that it takes
once a model has expanded it. The parts of a conversation are flattened in order of turns; attachments are numbered
by type over the whole conversation, so placeholders and recorded attachments correspond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PATCH, IMAGE_EXTRA, AUDIO_PER_SECOND, PAGE = 28, 2, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TYPES = ("image", "audio", "document")


class PartVisitor:
    """Columns for one part; ``number`` counts the parts of its type in the conversation from 1 on."""

    def text_tokens(self, text: Column) -> Column:
        """Words and single punctuation marks."""
        return F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+|[^ \\t\\n\\r\\f\\p{L}\\p{N}]"))

    def text(self, part: Column, number: Column) -> tuple[Column, Column]:
        shown = F.coalesce(part["text"], F.lit(""))
        return escaped(shown), self.text_tokens(shown)

    def image(self, part: Column, number: Column) -> tuple[Column, Column]:
        """One token per patch of 28 pixels a side, and two that frame the image; an unknown size counts as one
        patch a side."""
        side = lambda x: F.ceil(F.greatest(F.coalesce(part[x], F.lit(1)), F.lit(1)) / PATCH)
        return F.concat(F.lit("<|image_"), number.cast("string"), F.lit("|>")), side("width") * side("height") + IMAGE_EXTRA

    def audio(self, part: Column, number: Column) -> tuple[Column, Column]:
        return F.concat(F.lit("<|audio_"), number.cast("string"), F.lit("|>")), F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_PER_SECOND)

    def document(self, part: Column, number: Column) -> tuple[Column, Column]:
        return F.concat(F.lit("<|document_"), number.cast("string"), F.lit("|>")), F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * PAGE

    def other(self, part: Column, number: Column) -> tuple[Column, Column]:
        """A part of a type that isn't known is kept as a mark without tokens."""
        return F.lit("<|unsupported|>"), F.lit(0)

    def visit(self, part: Column, number: Column) -> Column:
        """Dispatch on the type: the struct (shown, tokens)."""
        kinds = {"text": self.text(part, number), "image": self.image(part, number), "audio": self.audio(part, number), "document": self.document(part, number)}
        shown, tokens = self.other(part, number)
        for kind, (a, b) in kinds.items():
            is_kind = part["type"] == kind
            shown, tokens = F.when(is_kind, a).otherwise(shown), F.when(is_kind, b).otherwise(tokens)
        return F.struct(shown.alias("shown"), tokens.cast("bigint").alias("tokens"))


def escaped(text: Column) -> Column:
    """The text with a backslash put into every ``<|``, and one more where backslashes stand there already, so that no
    text can hold a placeholder or end a message. ``unescaped`` takes them out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``prompt``, ``n_tokens`` (text and expanded attachments), ``n_messages``,
    and ``attachments``, an array of (type, number, ref, turn, tokens) in the order of the prompt.

    ``parts_col`` is an array of ``PART``. Messages come in order of turn, then role, then parts; each is written as
    ``<|role|>`` and a line break, its parts one a line, and ``<|end|>``. Marks in texts are ``escaped``, and of a role
    letters, digits, blanks and ``_.-`` stay while others become ``_``, so every placeholder in the prompt is that of an
    attachment; tokens are those of the text as it was. A null role is ``user``. Null parts, null texts and empty
    messages give no text and no tokens. Repeated rows are repeated messages. Rows without conversation are left out. A
    long conversation or text takes time in proportion. An empty table gives no rows. Other columns are ignored.

    One shuffle by conversation serves the numbering of messages, that of parts and the assembly.
    """
    visitor = visitor or PartVisitor()
    role = F.regexp_replace(F.coalesce(messages[role_col], F.lit("user")), r"[^\p{L}\p{N}_ .-]", "_")
    own = messages.select(
        messages[conv_col].alias("conv_id"), messages[turn_col].alias("turn"), role.alias("role"),
        F.filter(F.coalesce(messages[parts_col], F.from_json(F.lit("[]"), f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"),
    ).where("conv_id IS NOT NULL")
    ordered = own.withColumn("m", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts")))
    flat = ordered.select("conv_id", "m", "turn", "role", F.posexplode_outer("parts").alias("p", "part"))
    number = F.row_number().over(Window.partitionBy("conv_id", "part.type").orderBy("m", "p"))
    seen = flat.withColumn("number", number).withColumn("seen", visitor.visit(F.col("part"), F.col("number")))
    attachment = F.struct(
        "p", F.col("part.type").alias("type"), F.col("number").cast("bigint").alias("number"), F.col("part.ref").alias("ref"), F.col("turn").cast("bigint").alias("turn"), F.col("seen.tokens").alias("tokens")
    )
    is_part = F.col("part").isNotNull()
    by_message = seen.groupBy("conv_id", "m").agg(
        F.first("role").alias("role"),
        F.array_sort(F.collect_list(F.when(is_part, F.struct("p", F.col("seen.shown").alias("shown"))))).alias("lines"),
        F.sum(F.when(is_part, F.col("seen.tokens")).otherwise(0)).alias("tokens"),
        F.array_sort(F.collect_list(F.when(F.col("part.type").isin(*TYPES), attachment))).alias("attachments"),
    )
    body = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.array_join(F.col("lines.shown"), "\n"), F.lit("\n<|end|>"))
    talk = by_message.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("m", body.alias("body"), "attachments"))).alias("messages"), F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_messages")
    )
    return talk.select(
        "conv_id",
        F.array_join(F.col("messages.body"), "\n").alias("prompt"),
        "n_tokens",
        "n_messages",
        F.transform(F.flatten("messages.attachments"), lambda a: F.struct(a["type"].alias("type"), a["number"].alias("number"), a["ref"].alias("ref"), a["turn"].alias("turn"), a["tokens"].alias("tokens"))).alias("attachments"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations. Their table has text alone, so user turns get attachments from the keys: in every
    conversation the first turn refers to the page of that number as a document, and by turn and conversation an
    image or a sound recording. Attachments are written as (type, number, ref, turn, tokens) strings."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), "url", F.ceil(F.length("html") / 3000).cast("int").alias("pages"))
    part = lambda **x: F.struct(*[x.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split(":") for f in PART[7:-1].split(","))])
    user = F.col("role") == "user"
    parts = F.array(
        part(type=F.lit("text"), text=F.col("text")),
        F.when(user & (F.col("turn") < 2) & F.col("url").isNotNull(), part(type=F.lit("document"), ref=F.col("url"), pages=F.col("pages"))),
        F.when(user & ((F.col("conv_id") + F.col("turn")) % 3 == 0), part(type=F.lit("image"), ref=F.concat(F.lit("image/"), F.col("conv_id"), F.lit("/"), F.col("turn")), width=200 + F.col("conv_id") % 7 * 100, height=F.lit(336))),
        F.when(user & (F.col("conv_id") % 5 == 2), part(type=F.lit("audio"), ref=F.concat(F.lit("audio/"), F.col("conv_id"), F.lit("/"), F.col("turn")), seconds=F.col("turn") + 1.5)),
    )
    done = format_chat(talk.join(pages, "conv_id", "left").withColumn("parts", parts))
    shown = F.transform("attachments", lambda a: F.concat_ws("|", a["type"], a["number"].cast("string"), a["ref"], a["turn"].cast("string"), a["tokens"].cast("string")))
    return done.withColumn("attachments", F.array_join(shown, ";"))


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {
    "op3_chat_format": r"""
WITH m AS (
  SELECT c.conv_id, c.turn, regexp_replace(coalesce(c.role, 'user'), '[^\p{L}\p{N}_ .-]', '_', 'g') AS role, coalesce(c.text, '') AS text, p.url, CAST(ceil(length(p.html) / 3000) AS INTEGER) AS pages
  FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id WHERE c.conv_id IS NOT NULL
), parts AS (
  SELECT conv_id, turn, role, 0 AS k, 'text' AS type, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown, NULL AS ref, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}]')) AS tokens FROM m
  UNION ALL SELECT conv_id, turn, role, 1, 'document', NULL, url, pages * 256 FROM m WHERE role = 'user' AND turn < 2 AND url IS NOT NULL
  UNION ALL SELECT conv_id, turn, role, 2, 'image', NULL, 'image/' || conv_id || '/' || turn, CAST(ceil((200 + conv_id % 7 * 100) / 28) * 12 + 2 AS BIGINT)
    FROM m WHERE role = 'user' AND (conv_id + turn) % 3 = 0
  UNION ALL SELECT conv_id, turn, role, 3, 'audio', NULL, 'audio/' || conv_id || '/' || turn, CAST(ceil((turn + 1.5) * 25) AS BIGINT) FROM m WHERE role = 'user' AND conv_id % 5 = 2
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, type ORDER BY turn, role, k) AS number FROM parts
), messages AS (
  SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || string_agg(coalesce(shown, '<|' || type || '_' || number || '|>'), chr(10) ORDER BY k) || chr(10) || '<|end|>' AS body,
    sum(tokens) AS tokens
  FROM numbered GROUP BY conv_id, turn, role
), attached AS (
  SELECT conv_id, string_agg(type || '|' || number || '|' || ref || '|' || turn || '|' || tokens, ';' ORDER BY turn, role, k) AS attachments FROM numbered WHERE type <> 'text' GROUP BY conv_id
)
SELECT conv_id, string_agg(body, chr(10) ORDER BY turn, role) AS prompt, CAST(sum(tokens) AS BIGINT) AS n_tokens, count(*) AS n_messages, coalesce(any_value(attachments), '') AS attachments
FROM messages LEFT JOIN attached USING (conv_id) GROUP BY conv_id
"""
}
