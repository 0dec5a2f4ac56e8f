"""Records of conversations and the views that trainers want: arrays transformed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill import lexicons as L
from grainmill.functions.lang import let
from grainmill.functions.text import blank, strip

TURN = "array<struct<`from`:string,value:string>>"


def turn(role: str | Column, value: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("from"), value.alias("value"))


def conversation_record(image: Column, prompt: Column, answer: Column) -> Column:
    """Two turns, the prompt after an image tag; ``image`` decides whether there is one."""
    tagged = F.when(image.isNotNull(), F.concat(F.lit(L.IMAGE_TAG + "\n"), prompt)).otherwise(prompt)
    return F.array(turn("human", tagged), turn("gpt", answer))


def report_mode(df: DataFrame, prompt: str, mode: str = "report", suffix: str = "_report", conversations: str = "conversations", id_col: str = "id") -> DataFrame:
    """Replace the first turn's text by the media prefix and ``prompt``, mark the mode, extend the id.

    Records of fewer than two turns get the ``error`` column and no conversation.
    """
    c = F.col(conversations)
    prefix = lambda v: F.when(v.contains(L.IMAGE_TAG), L.IMAGE_TAG + "\n").when(v.contains(L.VIDEO_TAG), L.VIDEO_TAG + "\n").otherwise("")
    new = F.transform(c, lambda x, i: F.when(i == 0, x.withField("value", F.concat(prefix(x["value"]), F.lit(prompt)))).otherwise(x))
    short = F.coalesce(F.size(c), F.lit(0)) < 2
    ident = F.when(F.col(id_col).isNotNull(), F.concat(F.col(id_col).cast("string"), F.lit(suffix)))
    return df.withColumns({conversations: F.when(~short, new), "grpo_mode": F.lit(mode), id_col: ident, "error": F.when(short, F.lit("fewer than two turns"))})


def replace_media(text: Column, video: bool = False) -> Column:
    tag, tokens = (L.VIDEO_TAG, L.VIDEO_TOKENS) if video else (L.IMAGE_TAG, L.IMAGE_TOKENS)
    return F.regexp_replace(text, rf"\n?{tag}\n?", tokens)


def to_messages(conversations: Column, video: bool = False) -> Column:
    """Array of ``role`` and ``content``; roles without a mapping pass."""
    roles = F.create_map(*[F.lit(x) for kv in L.ROLES.items() for x in kv])
    return F.transform(conversations, lambda x: F.struct(F.coalesce(roles[x["from"]], x["from"]).alias("role"), replace_media(x["value"], video).alias("content")))


def strip_media(text: Column) -> Column:
    """Without media tokens and the space around them."""
    out = text
    for tokens in (L.IMAGE_TOKENS, L.VIDEO_TOKENS):
        out = F.regexp_replace(out, rf"(?U)\s*\Q{tokens}\E\s*", "")
    return strip(out)


def first_answer(conversations: Column, role: str = "gpt") -> Column:
    """First turn of the role that is not blank, stripped; null if there is none."""
    return strip(F.try_element_at(F.filter(conversations, lambda x: (x["from"] == role) & ~blank(x["value"])), F.lit(1))["value"])


def grpo_sample(conversations: Column, system: str = L.SYSTEM_MESSAGE) -> Column:
    """Struct of ``prompt`` (system and first turn as messages) and ``assistant`` (second turn)."""
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return let(
        to_messages(conversations),
        lambda m: F.struct(F.array(message("system", F.lit(system)), message("user", strip_media(F.get(m, F.lit(0))["content"]))).alias("prompt"), F.get(m, F.lit(1))["content"].alias("assistant")),
    )


def preference_sample(prompt: Column, chosen: Column, rejected: Column, end: str = "<|im_end|>\n") -> Column:
    close = lambda x: F.concat(x, F.lit(end))
    return F.struct(
        F.concat(F.lit("<|im_start|>user\n"), replace_media(prompt), F.lit("<|im_end|>\n<|im_start|>assistant\n")).alias("prompt"), close(chosen).alias("chosen"), close(rejected).alias("rejected")
    )


def classification_sample(media: Column, prompt: Column, label: Column, classes: dict[str, int], default: str, system: str | None = None) -> Column:
    """Struct of ``messages`` and the class number; existing files always count among the media."""
    ids = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    parts = F.concat(
        F.transform(F.coalesce(media, F.array().cast("array<string>")), lambda m: F.struct(F.lit("media").alias("type"), m.alias("value"))),
        F.array(F.struct(F.lit("text").alias("type"), F.coalesce(prompt, F.lit(default)).alias("value"))),
    )
    user = F.struct(F.lit("user").alias("role"), parts.alias("content"))
    head = [F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit(system).alias("value"))).alias("content"))] if system else []
    return F.struct(F.array(*head, user).alias("messages"), ids[label].alias("label"))


def media_limits(path: Column, min_pixels: int | None = None, max_pixels: int | None = None, width: int | None = None, height: int | None = None, fps: float | None = None, frames: int | None = None) -> Column:
    """Struct of a medium and its limits: both sizes or none; a number of frames beats a rate."""
    both = width is not None and height is not None
    put = lambda v, kind: F.lit(v).cast(kind)
    return F.struct(
        path.alias("path"),
        put(min_pixels, "long").alias("min_pixels"),
        put(max_pixels, "long").alias("max_pixels"),
        put(width if both else None, "int").alias("resized_width"),
        put(height if both else None, "int").alias("resized_height"),
        put(None if frames is not None else fps, "double").alias("fps"),
        put(frames, "int").alias("nframes"),
    )


def message_text(message: Column) -> Column:
    """Text of a struct with ``content``, an array of ``type`` and ``text``: its text parts, stripped, by line."""
    parts = F.filter(message["content"], lambda p: (p["type"] == "text") & ~blank(p["text"]))
    return F.coalesce(F.array_join(F.transform(parts, lambda p: strip(p["text"])), "\n"), F.lit(""))


def turn_pairs(turns: Column) -> Column:
    """Consecutive pairs ``a``, ``b``; an odd number of turns is an error."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(turns) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(turns, i).alias("a"), F.get(turns, i + 1).alias("b")))
    return F.when(F.size(turns) % 2 != 0, F.raise_error(F.lit("odd number of turns")).cast("array<void>")).when(F.size(turns) == 0, F.slice(pairs, 1, 0)).otherwise(pairs)


def media_slices(counts: Column, media: Column) -> Column:
    """The media of each turn, by the number of tags in it."""
    before = lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x)
    return F.transform(counts, lambda n, i: F.slice(media, before(i) + 1, n))


def input_ids(prompt: Column, response: Column) -> Column:
    return F.concat(prompt, response)


def masked_labels(prompt: Column, response: Column) -> Column:
    """Prompt places are ignored by the loss."""
    return F.concat(F.array_repeat(F.lit(L.IGNORE_INDEX), F.size(prompt)), response)


def attention_mask(ids: Column, pad: int) -> Column:
    """1 where the token is not the pad; a genuine pad token is masked too."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def truncate(ids: Column, most: int, end: int | None) -> Column:
    """Longer than ``most``: the first ``most`` - 1; then the end token, if there is one."""
    cut = F.when(F.size(ids) > most, F.slice(ids, 1, most - 1)).otherwise(ids)
    return cut if end is None else F.concat(cut, F.array(F.lit(end)))


def pad(ids: Column, width: Column, value: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), (width - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def collate(df: DataFrame, batch: str, prompt: str, response: str, pad_id: int = 0, left: bool = False) -> DataFrame:
    """Add ``input_ids``, ``labels`` and ``attention_mask`` padded to the longest of the batch."""
    ids, labels = input_ids(F.col(prompt), F.col(response)), masked_labels(F.col(prompt), F.col(response))
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    out = df.withColumns({"input_ids": ids, "labels": labels}).withColumn("_width", width)
    out = out.withColumns({"input_ids": pad(F.col("input_ids"), F.col("_width"), pad_id, left), "labels": pad(F.col("labels"), F.col("_width"), L.IGNORE_INDEX, left)})
    return out.withColumn("attention_mask", attention_mask(F.col("input_ids"), pad_id)).drop("_width")


def stack_sides(df: DataFrame, batch: str, prompt: str, chosen: str, rejected: str, keys: list[str], pad_id: int = 0) -> DataFrame:
    """Chosen rows, then rejected ones, as ``side``, ``prompt``, ``ids`` and ``attention_mask``; both sides padded to the longest of their batch."""
    widest = F.max(F.greatest(F.size(chosen), F.size(rejected))).over(Window.partitionBy(batch))
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("ids")) for c in (chosen, rejected)])
    rows = df.select(*keys, F.col(batch).alias(batch), F.col(prompt).alias("prompt"), widest.alias("_width"), F.posexplode(sides).alias("_at", "_side"))
    ids = F.col("_side.ids")
    mask = pad(F.transform(ids, lambda _: F.lit(1)), F.col("_width"), 0)
    return rows.select(*keys, batch, F.col("_side.side").alias("side"), "prompt", pad(ids, F.col("_width"), pad_id).alias("ids"), mask.alias("attention_mask"))


def ask(history: Column, question: Column, report: Column, answer: Column, without_report: str = "请先生成一份手相报告，再继续追问。") -> Column:
    """The history, an array of ``question`` and ``answer``, after one more question; a blank one changes nothing."""
    told = F.when(F.coalesce(report, F.lit("")) == "", F.lit(without_report)).otherwise(answer)
    before = F.coalesce(history, F.array().cast("array<struct<question:string,answer:string>>"))
    return F.when(blank(question), before).otherwise(F.concat(before, F.array(F.struct(question.alias("question"), told.alias("answer")))))
