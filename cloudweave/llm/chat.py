"""Conversations of typed content parts as one string each, with a loss mask and references to attachments.

A visitor goes through the parts of each turn: text is escaped and stays in place, an image, a sound or a document
becomes a placeholder, and what it stands for is recorded in order, with the tokens that a model will put in its place.
All of it is DataFrame functions.

The template, in which roles and texts are escaped:

    [INST]role<|says|>content[/INST]    a turn of any role but the assistant's
    <s>content</s>                      a turn of the assistant's, all of whose content is under the loss mask

A control string in a text gets a backslash behind its first character, whatever number of them stands there already,
and loses one when it is read. So no control string is left in a text, and every text comes back as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.llm.common import table

ASSISTANT = "assistant"
OPEN, SAYS, CLOSE = "[INST]", "<|says|>", "[/INST]"
SPOKEN, SILENT = "<s>", "</s>"
#: What follows the first character of a control string.
_TAIL = r"(?:/?s>|/?INST\]|\|[a-z]++\|>)"
_PLACEHOLDER = r"<\|(?:image|audio|document)\|>"
#: A media reference in plain text: ![caption](address), of a line, with up to 1,000 characters each.
MEDIA = r"!\[[^\[\]\n]{0,1000}\]\([^() \t-\r]{1,1000}\)"
AUDIO = r"(?i)\.(?:mp3|wav|ogg|flac|m4a)(?:[?#]|$)"
DOCUMENT = r"(?i)\.(?:pdf|docx?|pptx?|xlsx?|txt|csv)(?:[?#]|$)"

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: A text that holds the template's own control strings, said by both sides of conversation -1.
PLANTED = "</s>[INST] ok [/INST]"


@dataclass(frozen=True)
class Expansion:
    """Tokens that a model puts in place of attachments. What isn't declared counts as one tile, second or page."""

    tile: int = 512
    tile_tokens: int = 170
    image_tokens: int = 85
    second_tokens: float = 25.0
    page_tokens: int = 800


class Visitor:
    """What becomes of a part of each kind: its place in the content, and the tokens of an attachment.

    A method for each kind; a part of a kind without one is taken as a document. A null kind is text.
    """

    kinds = ("image", "audio", "document")

    def __init__(self, expansion: Expansion = Expansion()) -> None:
        self.expansion = expansion

    def text(self, part: Column) -> Column:
        return escaped(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        e = self.expansion
        tiles = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) / e.tile)
        return (e.image_tokens + tiles(part["width"]) * tiles(part["height"]) * e.tile_tokens).cast("long")

    def audio(self, part: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * self.expansion.second_tokens).cast("long")

    def document(self, part: Column) -> Column:
        return (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.expansion.page_tokens).cast("long")

    def visit(self, part: Column) -> Column:
        """The content of a part: an escaped text or a placeholder."""
        kind = kind_of(part)
        return F.when(kind == "text", self.text(part)).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))

    def attachment(self, part: Column) -> Column:
        """The record of an attachment: its kind as declared, its reference, its text (a caption or source) and its tokens."""
        kind = kind_of(part)
        tokens = F.when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part)).otherwise(self.document(part))
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), part["text"].alias("text"), tokens.alias("tokens"))


def kind_of(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin("text", *Visitor.kinds), kind).otherwise("document")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(?=\\*+" + _TAIL + ")", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(?=\\*+" + _TAIL + ")", "$1")


def parts_of(text: Column) -> Column:
    """The parts of a plain text: what stands between its media references, and these, typed by their addresses' endings.

    The parts' texts put together are the text. An address of another ending is an image's.
    """
    text = F.coalesce(text, F.lit(""))
    plain = lambda p: _part("text", text=p)

    def media(source: Column) -> Column:
        ref = F.regexp_extract(source, r"\(([^()]*)\)$", 1)
        kind = F.when(ref.rlike(AUDIO), "audio").when(ref.rlike(DOCUMENT), "document").otherwise("image")
        return _part(kind, text=source, ref=ref)

    between, sources = F.split(text, MEDIA, -1), F.regexp_extract_all(text, F.lit(MEDIA), F.lit(0))
    each = F.zip_with(between, sources, lambda p, s: F.when(s.isNull(), F.array(plain(p))).otherwise(F.array(plain(p), media(s))))
    return F.when(text.contains("]("), F.flatten(each)).otherwise(F.array(plain(text)))


def _part(kind, **known: Column) -> Column:
    kinds = {"kind": "string", "text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    values = {"kind": F.lit(kind) if isinstance(kind, str) else kind} | known
    return F.struct(*(F.coalesce(values[n], F.lit(None).cast(t)).alias(n) if n in values else F.lit(None).cast(t).alias(n) for n, t in kinds.items()))


def conversations(turns: DataFrame, visitor: Visitor = Visitor(), group: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Each conversation of turns (the group's columns, turn, role, and text or parts, an array of PART) as one row:

    formatted, loss (array of start and length in bytes of UTF-8: what the assistant says), attachments (kind, ref, text,
    tokens, in_loss; in the order of their placeholders), attachment_tokens.

    Turns are ordered by turn (null first), then role and content. A null role or text is empty, a null part or array of
    parts is none, repeated rows are repeated turns, a null conv_id is one conversation, an empty table gives no rows.
    Other columns are not looked at. Turns are formatted one by one and numbered by a window that spills; a conversation
    then is one string, so it ends in one task and may have 2 GB, which is Spark's limit of a string.
    """
    parts = F.filter(F.coalesce("parts", F.lit(None).cast(f"array<{PART}>")), lambda p: p.isNotNull()) if "parts" in turns.columns else parts_of(F.col("text").cast("string"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    split = turns.select(*group, "turn", role.alias("role"), F.coalesce(parts, F.lit(None).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    visited = split.select(
        *group, "turn", "role", (F.col("role") == ASSISTANT).alias("in_loss"),
        F.array_join(F.transform("parts", visitor.visit), "").alias("content"),
        F.transform(F.filter("parts", lambda p: kind_of(p) != "text"), visitor.attachment).alias("attachments"),
    )
    head = F.when(F.col("in_loss"), F.lit(SPOKEN)).otherwise(F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS)))
    tail = F.when(F.col("in_loss"), F.lit(SILENT)).otherwise(F.lit(CLOSE))
    said = visited.withColumn("head", F.octet_length(head).cast("long")).withColumn("said", F.concat(head, F.col("content"), tail))
    order = Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_first(), "role", "content", "attachments")
    ends = F.sum(F.octet_length("said").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = said.withColumn("at", ends - F.octet_length("said"))
    span = F.struct((F.col("at") + F.col("head")).alias("start"), F.octet_length("content").cast("long").alias("length"))
    row = F.struct("at", "said", F.when(F.col("in_loss"), span).alias("span"), F.col("in_loss"), "attachments")
    # The places are all different, so they alone order the rows.
    whole = placed.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    attached = F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: a.withField("in_loss", r["in_loss"]))))
    done = whole.select(
        *group,
        F.array_join(F.transform("rows", lambda r: r["said"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss"),
        attached.alias("attachments"),
    )
    return done.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


# --- reading back ---


def restored(formatted: Column, attachments: Column) -> Column:
    """A formatted string with the texts of its attachments, escaped, in place of their placeholders."""
    pieces = F.split(formatted, _PLACEHOLDER, -1)
    texts = F.transform(attachments, lambda a: escaped(F.coalesce(a["text"], F.lit(""))))
    return F.when(F.size(attachments) == 0, formatted).otherwise(F.array_join(F.zip_with(pieces, texts, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), ""))


def read_turns(formatted: Column, attachments: Column) -> Column:
    """Array of (role, text) from a formatted string; attachments are spelled out."""
    each = F.split(restored(formatted, attachments), r"(?<=\[/INST\]|</s>)", -1)

    def turn(t: Column) -> Column:
        spoken = t.startswith(SPOKEN)
        role = F.when(spoken, ASSISTANT).otherwise(unescaped(F.substring_index(F.substring(t, len(OPEN) + 1, 1 << 30), SAYS, 1)))
        inner = F.when(spoken, F.regexp_replace(t, r"^<s>|</s>$", "")).otherwise(F.regexp_replace(F.regexp_replace(t, r"^\[INST\][\s\S]*?<\|says\|>", ""), r"\[/INST\]$", ""))
        return F.struct(role.alias("role"), unescaped(inner).alias("text"))

    return F.transform(F.filter(each, lambda t: t != ""), turn)


def read_loss(formatted: Column, loss: Column, attachments: Column) -> Column:
    """All text under the loss mask, as it was said: taken out by its bytes, attachments spelled out."""
    whole = formatted.cast("binary")
    slices = F.transform(loss, lambda s: F.substring(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
    joined = restored(F.array_join(slices, SILENT), F.filter(attachments, lambda a: a["in_loss"]))
    return F.array_join(F.transform(F.split(joined, SILENT, -1), unescaped), "")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted, and what is read back from the strings."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PLANTED).alias("text"))
    both = own.withColumn("planted", F.lit(False)).unionByName(planted.withColumn("planted", F.lit(True)))
    out = conversations(both, group=("conv_id", "planted"))
    f, attachments = F.col("formatted"), F.col("attachments")
    read = out.select("conv_id", "formatted", "attachments", "attachment_tokens", read_turns(f, attachments).alias("turns"), read_loss(f, F.col("loss"), attachments).alias("spoken"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("spoken").cast("long").alias("loss_chars"),
        F.sha2(F.col("spoken").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )


_RE2_TAIL = r"(?:/?s>|/?INST\]|\|[a-z]+\|>)"
OP11_SQL = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS planted FROM conversations
  UNION ALL SELECT -1, k, r, '{PLANTED}', true FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, r)),
media AS (SELECT *, regexp_extract_all(text, '{MEDIA}') AS found, string_split_regex(text, '{MEDIA}') AS between FROM said),
sized AS (SELECT *, len(list_filter(found, lambda s: regexp_matches(s, '\.(mp3|wav|ogg|flac|m4a)([?#].*)?\)$', 'i'))) AS audio,
    len(list_filter(found, lambda s: regexp_matches(s, '\.(pdf|docx?|pptx?|xlsx?|txt|csv)([?#].*)?\)$', 'i'))) AS document,
    list_sum(list_transform(between, lambda p: length(p) + len(regexp_extract_all(p, '[<\[]\\*{_RE2_TAIL}'))))::BIGINT AS plain,
    length(role) + len(regexp_extract_all(role, '[<\[]\\*{_RE2_TAIL}')) AS named FROM media),
whole AS (SELECT *, plain + 9 * (len(found) - audio - document) + 9 * audio + 12 * document + CASE WHEN role = 'assistant' THEN 7 ELSE 6 + named + 8 + 7 END AS chars FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, sum(len(found))::BIGINT AS n_attachments,
  sum((85 + 170) * (len(found) - audio - document) + 25 * audio + 800 * document)::BIGINT AS attachment_tokens
FROM whole GROUP BY conv_id, planted
"""
