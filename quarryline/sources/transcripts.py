"""Transcripts of several assistants as one table of messages, and text out of nested content."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import ASSIGNMENTS, MARK, SECRETS

#: Block types that hold calls and results of tools (fixed values).
TOOL_BLOCKS = ("tool_use", "tool_result", "function_call")


def _visit(value, tools: bool, out: list[str]) -> None:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v.strip())
        elif isinstance(v, list):
            stack += v[::-1]
        elif isinstance(v, dict) and (tools or v.get("type") not in TOOL_BLOCKS):
            if isinstance(v.get("text"), str):
                out.append(v["text"].strip())
            elif tools and isinstance(v.get("content"), str):
                out.append(v["content"].strip())
            stack += [x for k, x in v.items() if k not in ("type", "text", "content")][::-1]


def content_text(content: str | None, tools: bool = False) -> str | None:
    """The text in a JSON value of any depth, a part a line; a plain string is its own text; null for nothing.

    Blocks of tools are left out unless asked for. The walk keeps its own stack, so depth has no bound of its own.
    """
    if content is None:
        return None
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        value = content
    out: list[str] = []
    _visit(value, tools, out)
    return "\n".join(x for x in out if x) or None


def result_text(content: str | None) -> str | None:
    """The text of a tool's result: a string as it is, of an array of blocks their texts, [image] for an image."""
    if content is None:
        return None
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return content
    if isinstance(value, str) or value is None:
        return value or ""
    if not isinstance(value, list):
        return content_text(content, True) or ""
    parts = []
    for v in value:
        if isinstance(v, dict):
            v = "[image]" if v.get("type") == "image" else v["text"] if isinstance(v.get("text"), str) else v.get("content")
        if isinstance(v, str) and v.strip():
            parts.append(v.strip())
    return "\n".join(parts)


def text_of(c: Column, tools: bool = False) -> Column:
    """`content_text` of a column, in Arrow batches."""
    return F.pandas_udf(lambda s: pd.Series([content_text(x, tools) for x in s], dtype=object), "string")(c)


def result_text_of(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([result_text(x) for x in s], dtype=object), "string")(c)


def sensitive(key: str) -> bool:
    """Whether a key of a JSON object names a secret, whatever its case and separators."""
    k = "".join(c for c in key if c.isascii() and c.isalnum()).lower()
    return "apikey" in k or "password" in k or k.endswith(("token", "secret")) or k in ("authorization", "cookie", "setcookie", "privatekey", "clientsecret")


_SECRETS = [re.compile(p) for p in SECRETS], [re.compile(p) for p in ASSIGNMENTS]


def redact_value(value):
    """A JSON value with secrets in its strings and all values of sensitive keys replaced by a mark."""
    if isinstance(value, str):
        for p in _SECRETS[0]:
            value = p.sub(MARK, value)
        for p in _SECRETS[1]:
            value = p.sub(lambda m: m.group(1) + MARK, value)
        return value
    if isinstance(value, list):
        return [redact_value(v) for v in value]
    if isinstance(value, dict):
        return {k: MARK if sensitive(k) else redact_value(v) for k, v in value.items()}
    return value


def redact_json(text: str | None) -> str | None:
    """JSON text redacted at any depth; other text as a string is."""
    if text is None:
        return None
    try:
        value = json.loads(text)
        return json.dumps(redact_value(value), ensure_ascii=False)
    except (ValueError, RecursionError):
        return redact_value(text)


def redact_json_of(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([redact_json(x) for x in s], dtype=object), "string")(c)


#: Of each form: which lines are messages, where role, content, id and time stand, the session's id, and header lines with it.
FORMS = {
    "claude": {"is": "type IN ('user', 'assistant')", "role": ["$.message.role", "$.type"], "content": ["$.message.content"], "id": ["$.uuid"], "at": ["$.timestamp"], "session": ["$.sessionId"], "header": []},
    "codex": {
        "is": "type = 'message' OR (type = 'response_item' AND payload_type = 'message')", "role": ["$.role", "$.payload.role"], "content": ["$.content", "$.payload.content"], "id": ["$.id"], "at": ["$.timestamp"], "session": [],
        "header": [("session_meta", "$.payload.id"), (None, "$.id")],
    },
    "pi": {"is": "type = 'message'", "role": ["$.message.role"], "content": ["$.message.content"], "id": ["$.id"], "at": ["$.timestamp"], "session": [], "header": [("session", "$.id")]},
    "opencode": {"is": "true", "role": ["$.role"], "content": ["$.parts", "$.content", "$.summary"], "id": ["$.id"], "at": ["$.time.created"], "session": ["$.sessionID"], "header": []},
    "cursor": {"is": "true", "role": ["$.role"], "content": ["$.message.content", "$.content"], "id": ["$.id"], "at": ["$.timestamp"], "session": [], "header": []},
}


def messages(lines: DataFrame, form: str, tools: bool = False) -> DataFrame:
    """form, session_id, message_id, role, text, sent_at, path, line_no of the messages with text of user and assistant.

    lines: path, line_no, value (one JSON object; what isn't one is left out). A session's id stands in the line, in a
    header line of its file (of the header forms the first that the first line has), or is the file's name.
    """
    spec, field = FORMS[form], lambda ps: F.coalesce(*(F.get_json_object("value", p) for p in ps)) if ps else F.lit(None).cast("string")
    own = lines.where(F.try_parse_json("value").isNotNull()).select(
        "path", "line_no", "value", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.payload.type").alias("payload_type")
    )
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[A-Za-z]+)?$", 1)
    at = field(spec["at"])
    found = own.where(spec["is"]).select(
        "path", "line_no", F.lower(field(spec["role"])).alias("role"), text_of(field(spec["content"]), tools).alias("text"), field(spec["id"]).alias("message_id"), field(spec["session"]).alias("own"),
        F.coalesce(F.when(at.rlike(r"^\d{12,}$"), F.timestamp_millis(at.try_cast("long"))), F.try_to_timestamp(at)).alias("sent_at"),
    )
    if spec["header"]:
        ids = [F.when(F.lit(True) if kind is None else F.col("type") == kind, F.get_json_object("value", p)) for kind, p in spec["header"]]
        heads = own.groupBy("path").agg(F.min_by(F.coalesce(*ids), "line_no").alias("head"))
        found = found.join(heads, "path", "left")
    else:
        found = found.withColumn("head", F.lit(None).cast("string"))
    named = found.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    return named.select(F.lit(form).alias("form"), F.coalesce(F.nullif("own", F.lit("")), F.nullif("head", F.lit("")), stem).alias("session_id"), "message_id", "role", "text", "sent_at", "path", "line_no")


def all_messages(sources: dict[str, DataFrame]) -> DataFrame:
    out = None
    for form, lines in sources.items():
        own = messages(lines, form)
        out = own if out is None else out.unionByName(own)
    return out
