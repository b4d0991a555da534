"""Parsers and sanitisers of what services send: stream lines, errors, addresses, result pages, tool payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, decoded_entities, stripped_html

#: Fields of hidden reasoning, marks of errors, and of a page that asks for a human.
REASONING_FIELDS = ("reasoning_content", "reasoning", "reasoning_text", "reasoning_details")
PREVIEW_CHARS = 120
WINDOW_ERROR = r"(?i)context[_ ]length[^.]{0,40}exceeded|maximum context length|prompt is too long|context window.{0,40}(?:exceed|too (?:long|large|many))|too many tokens|reduce the length"
WINDOW_NUMBERS = (r"(?i)maximum context length is (\d+)", r"(?i)(?:tokens?\s*)?\d+\s*tokens?\s*>\s*(\d+)(?:\s*tokens?)?\s*maximum", r"(?i)(\d+)\s*(?:tokens?)?\s*maximum")
ERRORS = (
    ("AUTHENTICATION_ERROR", r"\b(401|403)\b|unauthorized|authentication|api key"),
    ("RATE_LIMITED", r"\b429\b|rate limit|quota"),
    ("TIMEOUT", r"timeout|timed out|aborted"),
    ("NETWORK_ERROR", r"fetch|network|econnrefused|enotfound|socket"),
)
CHALLENGE = r"(?i)g-recaptcha|are you a human|id=\"challenge-form\"|name=\"challenge\""
RESULT = r"(?i)class=\"[^\"]*\bresult__a\b[^\"]*\""
#: A result's link and its snippet.
RESULT_LINK = r"(?is)<a\b(?=[^>]*\bclass=\"[^\"]*\bresult__a\b[^\"]*\")([^>]*)>(.*?)</a>"
RESULT_SNIPPET = r"(?is)<a\b(?=[^>]*\bclass=\"[^\"]*\bresult__snippet\b[^\"]*\")[^>]*>(.*?)</a>"


def model_error(stop_reason: Column, code: Column, message: Column) -> Column:
    """The kind of a failed answer, null where it didn't fail; marks are looked for in the order of ERRORS."""
    text = F.lower(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(message, F.lit(""))))
    kind = F.lit("INVALID_RESPONSE")
    for name, marks in reversed(ERRORS):
        kind = F.when(text.rlike(marks), name).otherwise(kind)
    return F.when(stop_reason == "error", kind)


def reported_window(message: Column) -> Column:
    """What an error of a too long prompt says the window is, 0 where it doesn't say; null for other errors."""
    numbers = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")).try_cast("long") for p in WINDOW_NUMBERS]
    return F.when(message.rlike(WINDOW_ERROR), F.coalesce(*[F.when(n > 0, n) for n in numbers], F.lit(0)))


class _Spelled(float):
    """A number as it was written."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made


def _spelled(value) -> str:
    """JSON without blanks, members in their order, numbers as they were written."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_spelled(k)}:{_spelled(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_spelled, value)) + "]"
    return value.text if isinstance(value, _Spelled) else json.dumps(value, ensure_ascii=False)


def _reasoning_stripped(payload: str | None) -> str | None:
    if payload is None or not any(field in payload for field in REASONING_FIELDS):
        return None
    try:
        chunk = json.loads(payload, parse_float=_Spelled, parse_int=_Spelled)
    except (ValueError, RecursionError):
        return None
    choices = chunk.get("choices") if isinstance(chunk, dict) else None
    deltas = [c["delta"] for c in choices if isinstance(c, dict) and isinstance(c.get("delta"), dict)] if isinstance(choices, list) else []
    hidden = [(delta, field) for delta in deltas for field in REASONING_FIELDS if field in delta]
    for delta, field in hidden:
        del delta[field]
    return _spelled(chunk) if hidden else None


def without_reasoning(payload: Column) -> Column:
    """A stream chunk's JSON without the fields of hidden reasoning in its choices' deltas, all else as it was; null where
    there is nothing to take away. Spark's own JSON functions keep neither the order of unknown members nor their types."""

    @F.pandas_udf("string")
    def stripped(payloads: pd.Series) -> pd.Series:
        return payloads.map(_reasoning_stripped, na_action=None)

    return stripped(payload)


def stream_line(line: Column) -> Column:
    """A line of a server-sent stream, rewritten if it is data with hidden reasoning."""
    bare = F.trim(line)
    payload = F.trim(F.substr(bare, F.lit(6)))
    new = without_reasoning(payload)
    return F.when(bare.startswith("data:") & (payload != "") & (payload != "[DONE]") & new.isNotNull(), F.concat(F.lit("data: "), new)).otherwise(line)


def _bare_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")


def chat_endpoint(protocol: Column, url: Column) -> Column:
    """Where a chat request goes, whether the address names a host, a version or the whole endpoint."""
    bare = _bare_url(url)
    openai = F.regexp_replace(F.regexp_replace(bare, r"/chat/completions$", ""), r"/+$", "")
    openai = F.when(openai.rlike(r"/v\d+[a-z0-9]*$"), openai).otherwise(F.concat(openai, F.lit("/v1")))
    other = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"/v1/messages$", ""), r"/messages$", ""), r"/v1$", "")
    return F.when(protocol == "openai", F.concat(openai, F.lit("/chat/completions"))).otherwise(F.concat(other, F.lit("/v1/messages")))


def embeddings_endpoint(url: Column) -> Column:
    bare = F.regexp_replace(_bare_url(url), r"/embeddings$", "")
    return F.concat(F.when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1"))), F.lit("/embeddings"))


def is_challenge(html: Column) -> Column:
    """Whether a page of results is none, but asks whether one is human."""
    return ~html.rlike(RESULT) & html.rlike(CHALLENGE)


def result_links(html: Column) -> Column:
    """array<struct<title, url, snippet>> of a page of results: each result's link, and the snippet before the next one."""
    attributes, titles = F.regexp_extract_all(html, F.lit(RESULT_LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(RESULT_LINK), F.lit(2))
    behind = F.slice(F.split(html, RESULT_LINK, -1), 2, F.size(titles))
    plain = lambda x: decoded_entities(stripped_html(x))
    made = F.transform(
        F.arrays_zip(attributes.alias("a"), titles.alias("t"), behind.alias("b")),
        lambda r: F.struct(plain(r["t"]).alias("title"), unwrapped(decoded_entities(F.regexp_extract(r["a"], r"(?i)\bhref=\"([^\"]*)\"", 1))).alias("url"), plain(F.regexp_extract(r["b"], RESULT_SNIPPET, 1)).alias("snippet")),
    )
    return F.filter(made, lambda r: (r["title"] != "") & (r["url"] != ""))


def unwrapped(url: Column) -> Column:
    """The target that a redirecting address, a whole one, carries as `uddg`; other addresses stay as they are."""
    target = F.regexp_extract(url, r"^[^#]*?[?&]uddg=([^&#]*)", 1)
    return F.when((target != "") & url.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"), F.coalesce(F.try_url_decode(target), url)).otherwise(url)


def args_preview(args: Column) -> Column:
    return F.substring(collapsed(args), 1, PREVIEW_CHARS)


def payload_chars(text: Column, images: Column) -> Column:
    """Characters of a tool's text, and bytes of its images in base 64."""
    return F.length(text) + F.aggregate(images, F.lit(0), lambda a, x: a + F.floor(F.length(x) * 3 / 4).cast("int"))


def payload_key(text: Column, images: Column) -> Column:
    """Tells payloads apart: equal text and images, byte for byte, have equal keys."""
    return F.sha2(F.concat_ws("\u0000", F.sha2(text, 256), images), 256)


def entry_key(level: Column, label: Column) -> Column:
    return F.concat(level.cast("string"), F.lit("|"), F.lower(label))


def image_name(digest: Column, mime: Column) -> Column:
    """The file name under which a page image is kept: by content, so that equal images are one file."""
    return F.concat(digest, F.lit("."), F.when(mime == "image/jpeg", "jpg").otherwise(F.regexp_extract(mime, "/([a-z0-9]+)", 1)))
