"""JSON payloads: options, chat messages and server-sent event lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_SCHEMA = (
    "array<struct<role:string,content:array<struct<type:string,text:string,image_url:struct<url:string>>>>>"
)
DATA_PREFIX = "data: "
DONE = "[DONE]"


def json_option(json: Column, path: str, cast: str, default) -> Column:
    """A typed value of a JSON text with a default; bad JSON gives the default."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{path}", cast)
    return F.coalesce(value, F.lit(default).cast(cast))


def message_parts(messages: Column) -> Column:
    """Chat messages as parsed structs; plain string contents become one text part."""
    plain = F.from_json(messages, "array<struct<role:string,content:string>>")
    rich = F.from_json(messages, MESSAGE_SCHEMA)

    def parts(text: Column, structured: Column) -> Column:
        as_text = F.array(
            F.struct(
                F.lit("text").alias("type"),
                text["content"].alias("text"),
                F.lit(None).cast("struct<url:string>").alias("image_url"),
            )
        )
        return F.coalesce(structured["content"], as_text)

    return F.flatten(F.zip_with(plain, rich, parts))


def message_prompt(messages: Column) -> Column:
    """All text parts joined by a space."""
    texts = F.filter(message_parts(messages), lambda p: p["type"] == "text")
    return F.array_join(F.transform(texts, lambda p: p["text"]), " ")


def message_image(messages: Column) -> Column:
    """Payload of the last inline image; external addresses are ignored."""
    images = F.filter(
        message_parts(messages),
        lambda p: (p["type"] == "image_url") & p["image_url"]["url"].startswith("data:image"),
    )
    url = F.try_element_at(images, F.lit(-1))["image_url"]["url"]
    return F.regexp_extract(url, r"(?s)^[^,]*,(.*)$", 1)


def sse_payload(line: Column) -> Column:
    """What follows the data prefix; null for other lines."""
    return F.when(line.startswith(DATA_PREFIX), F.substring(line, len(DATA_PREFIX) + 1, 2147483647))


def sse_chunks(lines: Column) -> Column:
    """Payloads of an ordered array of lines up to the end mark; bad JSON is skipped."""
    payloads = F.filter(F.transform(lines, sse_payload), lambda p: p.isNotNull())
    end = F.array_position(payloads, F.lit(DONE)).cast("int")
    upto = F.when(end > 0, F.slice(payloads, 1, F.greatest(end - 1, F.lit(0)))).otherwise(payloads)
    return F.filter(upto, lambda p: F.try_parse_json(p).isNotNull())


def chunk_text(chunk: Column) -> Column:
    """The text delta of a chunk; null when empty or absent."""
    text = F.get_json_object(chunk, "$.choices[0].delta.content")
    return F.when(text != "", text)


def drop_nulls(params: Column) -> Column:
    """F16: a parameter map without its null entries; null when nothing is left."""
    kept = F.map_filter(params, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)
