"""Readers of exported conversations: Markdown in two dialects, JSON with alternative field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import one_spaced, words

#: Turn headers of the two Markdown dialects, user first, and lines that are no text.
DIALECTS = {"Claude MD": ("### 👤 Du", "### 🤖 Assistant"), "Gemini MD": ("## 👤 You", "## 🤖 Gemini")}
META = r"^(---|\*[^*].*\*|#[^#].*Export.*|>.*---)\s*$"
#: The names a field may have, in the order in which they are tried.
TITLES, MESSAGES, SENDERS, TEXTS, TIMES = ("name", "title", "chat_title"), ("chat_messages", "messages", "conversation"), ("sender", "role"), ("text", "content"), ("created_at", "timestamp")


def first_truthy(*values: Column) -> Column:
    """The first of some strings that is neither null nor empty."""
    return F.coalesce(*(F.when(v != "", v) for v in values))


def markdown_turns(files: DataFrame) -> DataFrame:
    """path, format, side, n, text: the turns of each Markdown export (path, text), their text in single spaces; files in no known dialect give nothing.

    A turn goes on to the next header; headers of either dialect and lines that are no text are left out, and so are turns without text.
    """
    known = F.lit(None).cast("string")
    for name, marks in reversed(DIALECTS.items()):
        known = F.when(F.col("text").contains(marks[0]) | F.col("text").contains(marks[1]), name).otherwise(known)
    rows = files.select("path", "text", known.alias("format")).where("format is not null")
    return _turns(rows, "Claude MD").unionByName(_turns(rows, "Gemini MD")).where("text != ''")


def _turns(rows: DataFrame, dialect: str) -> DataFrame:
    """Turns of the files in one dialect; other headers are dropped line by line before the text is cut at the dialect's own."""
    user, assistant = DIALECTS[dialect]
    end = r"(?![\p{L}\p{N}_])"
    others = "|".join(m for name, marks in DIALECTS.items() if name != dialect for m in marks)
    header = rf"(?m)^(?:{user}|{assistant}){end}[^\n]*$"
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~(x.rlike(rf"^({others}){end}") | x.rlike(META) | x.startswith("> ---")))
    found = rows.where(F.col("format") == dialect).select("path", "format", F.array_join(lines, "\n").alias("j"))
    bodies = F.slice(F.split("j", header, -1), 2, 1_000_000_000)
    turns = F.arrays_zip(F.regexp_extract_all("j", F.lit(f"({header})"), F.lit(1)).alias("head"), bodies.alias("body"))
    found = found.select("path", "format", F.posexplode(turns).alias("n", "t"))
    return found.select("path", "format", F.when(F.col("t.head").startswith(user), "user").otherwise("ai").alias("side"), "n", one_spaced(F.col("t.body")).alias("text"))


def json_turns(files: DataFrame) -> DataFrame:
    """path, chat, title, n, side, text: the turns of JSON exports (path, text); a file holds one chat or a list of chats.

    Only messages of a human or an assistant count. Their text is that of the content blocks of type text, trimmed and joined by spaces, else the field
    `text`; messages without any are left out, and so are files that are no JSON and chats whose messages are no list.
    """
    v = F.try_parse_json("text")
    chats = files.select("path", v.alias("v")).where("v is not null")
    chats = chats.select("path", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v")).alias("all"))
    chats = chats.select("path", F.posexplode("all").alias("chat", "c"))
    get = lambda c, name, kind: F.expr(f"try_variant_get({c}, '$.{name}', '{kind}')")
    listed = F.coalesce(*(F.when(F.size(get("c", m, "array<variant>")) > 0, get("c", m, "array<variant>")) for m in MESSAGES))
    rows = chats.select("path", "chat", F.coalesce(first_truthy(*(get("c", t, "string") for t in TITLES)), F.lit("")).alias("title"), F.posexplode(listed).alias("n", "m"))
    blocks = get("m", "content", "array<variant>")
    rows = rows.select("path", "chat", "title", "n", first_truthy(*(get("m", s, "string") for s in SENDERS)).alias("sender"), blocks.alias("blocks"), get("m", "text", "string").alias("plain"))
    texts = F.expr("filter(transform(filter(blocks, b -> try_variant_get(b, '$.type', 'string') = 'text'), b -> trim(coalesce(try_variant_get(b, '$.text', 'string'), ''))), t -> t != '')")
    text = first_truthy(F.array_join(texts, " "), F.trim("plain"))
    side = F.when(F.col("sender").isin("human", "user"), "user").when(F.col("sender") == "assistant", "ai")
    return rows.select("path", "chat", "title", "n", side.alias("side"), text.alias("text")).where("side is not null and text is not null")


def turn_stats(turns: DataFrame, *keys: str) -> DataFrame:
    """Per key: turns, words and characters of either side."""
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0)).cast("long")
    counts = {"turns": F.lit(1), "words": words(F.col("text")), "chars": F.length("text")}
    return turns.groupBy(*keys).agg(*(of(side, x).alias(f"{side}_{name}") for side in ("user", "ai") for name, x in counts.items()))
