"""Functions on tool calls, sessions, plans and model labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import search_normalise, strip_controls


def pick(c: Column, table: dict, otherwise=None) -> Column:
    """The table's value for a column's, else `otherwise` (a value or a column)."""
    rest = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[c], rest)


#: Older names of tools (fixed values).
TOOL_ALIASES = {"file_read": "read", "file_write": "write", "file_edit": "edit", "file_grep": "grep", "todowrite": "todo"}


def canonical_tool(c: Column) -> Column:
    return pick(c, TOOL_ALIASES, c)


def expanded_tools(name: Column, arguments: Column) -> Column:
    """A call's tool and, of a batch, the tools of its inner calls, all by canonical name."""
    inner = F.from_json(F.get_json_object(arguments, "$.tool_calls"), "array<struct<tool string>>")
    names = F.transform(F.filter(F.coalesce(inner, F.array()), lambda x: x["tool"].isNotNull()), lambda x: canonical_tool(x["tool"]))
    return F.when(canonical_tool(name) == "batch", F.concat(F.array(canonical_tool(name)), names)).otherwise(F.array(canonical_tool(name)))


#: Commands that run tests (fixed values).
TEST_RUNS = ["cargo test", "npm test", "pnpm test", "pytest", "jest", "vitest", "go test", "rspec", "bun test", " test"]


def test_run(name: Column, arguments: Column) -> Column:
    """Whether a tool call looks like a test run by its name, command, description or task."""
    texts = [name, *(F.get_json_object(arguments, f"$.{k}") for k in ("command", "description", "task"))]
    found = [F.coalesce(F.lower(t).contains(m), F.lit(False)) for t in texts for m in TEST_RUNS]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def mcp_server(name: Column, arguments: Column) -> Column:
    """The server of a tool of the context protocol; null for other tools and blank servers."""
    given = strip_controls(F.get_json_object(arguments, "$.server"))
    return F.when(name.startswith("mcp__"), F.split(F.substr(name, F.lit(6)), "__")[0]).when((name == "mcp") & (given != ""), given)


def workflow_flags(prompt: Column, **used: Column) -> dict[str, Column]:
    """The given flags, and chat_only: a prompt and none of them."""
    plain = {k: F.coalesce(v, F.lit(False)) for k, v in used.items()}
    none = F.coalesce(prompt, F.lit(False))
    for v in plain.values():
        none = none & ~v
    return plain | {"chat_only": none}


#: File endings of languages (fixed values).
LANGUAGES = {"rs": "rust", "js": "js_ts", "jsx": "js_ts", "ts": "js_ts", "tsx": "js_ts", "py": "python", "go": "go", "md": "markdown", "mdx": "markdown"}


def languages(paths: Column) -> Column:
    """Distinct languages of an array of paths, by their endings."""
    endings = F.transform(paths, lambda p: pick(F.regexp_extract(p, r"\.([A-Za-z]+)$", 1), LANGUAGES))
    return F.array_sort(F.array_distinct(F.filter(endings, lambda x: x.isNotNull())))


def mixed_languages(paths: Column) -> Column:
    return F.size(languages(paths)) > 1


def clean_feedback(c: Column, most: int = 2000) -> Column:
    """Without control characters but line breaks and tabs, trimmed, at most `most` characters."""
    kept = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    return F.substring(F.regexp_replace(kept, r"^\s+|\s+$", ""), 1, most)


def time_bucket(ms: Column, cap: int = 300_000, step: int = 100) -> Column:
    """A duration capped and rounded down to a step."""
    capped = F.least(ms, F.lit(cap))
    return F.when(ms.isNotNull(), capped - capped % step)


def local_parts(at: Column, zone: str) -> tuple[Column, Column, Column]:
    """Hour, weekday (Monday 0) and date of a UTC time in a zone."""
    local = F.from_utc_timestamp(at.cast("timestamp"), zone)
    return F.hour(local), F.weekday(local), F.to_date(local)


#: Ranks of priorities; unknown ones are in the middle (fixed values).
PRIORITIES = {"high": 0, "urgent": 0, "p0": 0, "medium": 1, "normal": 1, "p1": 1, "low": 2, "p2": 2}


def priority_rank(c: Column) -> Column:
    return pick(c, PRIORITIES, 1)


#: Weights and least confidence of ways to learn something (fixed values).
AUTHORITY = {"user_stated": 5, "structured_mapping": 4, "rule_extraction": 3, "llm_extraction": 2, "rule_inference": 1}
ADMISSION = {"user_stated": 0.0, "structured_mapping": 0.0, "rule_extraction": 0.7, "llm_extraction": 0.7, "rule_inference": 0.8}


def authority(method: Column) -> Column:
    return pick(method, AUTHORITY)


def admissible(method: Column, confidence: Column) -> Column:
    return confidence >= pick(method, ADMISSION)


def boosted(confidence: Column, amount: float) -> Column:
    return F.when(confidence.isNotNull(), F.least(F.lit(1.0), confidence + amount))


def lowered(confidence: Column, amount: float) -> Column:
    return F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), confidence - amount))


def tagged_text(text: Column, tags: Column) -> Column:
    """Normalised text followed by its normalised tags, blank ones left out."""
    parts = F.concat(F.array(search_normalise(text)), F.transform(F.coalesce(tags, F.array()), search_normalise))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


#: Words that say nothing of a skill (fixed values).
SKILL_STOP_WORDS = "about after before could from have just make ready should start that their there they this what when where which while will with work would your".split()


def skill_terms(query: str) -> list[str]:
    """Distinct words of a query from four characters on, stop words left out."""
    for c in "-_/\\.:":
        query = query.replace(c, " ")
    return sorted({w for w in query.lower().split() if len(w.encode()) >= 4 and w not in SKILL_STOP_WORDS})


def skill_bonus(text: Column, query: str) -> Column:
    """What a skill gains by the terms of the query its normalised text holds: 0, 0, .08, .14, .20 from four on."""
    own = search_normalise(text)
    hits = sum((F.when(own.contains(t), 1).otherwise(0) for t in skill_terms(query)), F.lit(0))
    return F.when(hits < 2, 0.0).when(hits == 2, 0.08).when(hits == 3, 0.14).otherwise(0.2)


def cut_bytes(c: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes of UTF-8 that splits no character."""
    raw = F.encode(c, "utf-8")
    inside = lambda at: (F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int").bitwiseAND(0xC0)) == 0x80
    keep = F.when(~inside(most + 1), most)
    for back in (1, 2):
        if most - back >= 0:
            keep = keep.when(~inside(most + 1 - back), most - back)
    size = keep.otherwise(max(0, most - 3))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), size), "utf-8"))


#: Characters a token stands for, what an image and a prompt's frame cost in tokens, and the usual budget (fixed values).
CHARS_PER_TOKEN, IMAGE_TOKENS, FRAME_TOKENS, BUDGET = 4, 1_600, 18_000, 200_000


def block_size(kind: Column, text: Column, arguments: Column) -> Column:
    """Bytes a content block counts: its text; a call's arguments and 50; a result's text and 20; an image's flat cost."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return F.when(kind == "image", IMAGE_TOKENS * CHARS_PER_TOKEN).when(kind == "tool_use", size(arguments) + 50).when(kind == "tool_result", size(text) + 20).otherwise(size(text))


def estimated_tokens(chars: Column, budget: int = BUDGET) -> Column:
    """Tokens of so many characters, with the frame's where the budget is at least half the usual one."""
    return F.floor(chars / CHARS_PER_TOKEN).cast("long") + (FRAME_TOKENS if budget >= BUDGET // 2 else 0)


def context_tokens(provider: Column, tokens_in: Column, cache_read: Column, cache_new: Column) -> Column:
    """Size of a context from its usage counts.

    Cached tokens are added where the provider counts them apart: by its name, or as there are new cached tokens, or more
    read ones than tokens at all; else the input holds them already.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    name, n, read, new = F.coalesce(F.lower(provider), F.lit("")), zero(tokens_in), zero(cache_read), zero(cache_new)
    apart = name.contains("anthropic") | name.contains("claude") | (new > 0) | (read > n)
    return F.when(n == 0, 0).when(apart, n + read + new).otherwise(n).cast("long")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a hash of the text's UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "utf-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16_777_619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(pairs, F.lit(2_166_136_261).cast("long"), step)


def model_candidates(label: Column) -> Column:
    """Names a catalogue may list a model label under: without markers, provider, route, effort, date and thinking suffixes,
    and with dots and dashes of version numbers exchanged."""
    bare = F.regexp_replace(F.trim(label), r"(?i)\[1m\]$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\[web\]$", ""), r"@[^@]+$", "")
    bare = F.regexp_replace(bare, r"(?i)-(xhigh|x-high|max-effort)$", "")
    names = F.array(bare, F.regexp_extract(bare, r"([^/]*)$", 1), F.regexp_replace(bare, r"^[^/]*/", ""))
    every = lambda a, f: F.concat(a, F.transform(a, f))
    names = every(names, lambda x: F.regexp_replace(x, r"(?i)-(xhigh|high|medium|low|none|minimal)$", ""))
    names = every(names, lambda x: F.regexp_replace(x, r"-\d{8}$", ""))
    claude = lambda x, y: F.when(x.startswith("claude-"), y).otherwise(x)
    dated = names
    names = F.concat(names, F.transform(dated, lambda x: claude(x, F.regexp_replace(x, r"(\d)\.(\d)", "$1-$2"))), F.transform(dated, lambda x: claude(x, F.regexp_replace(x, r"(\d)-(\d)(?!\d)", "$1.$2"))))
    names = F.concat(names, F.transform(dated, lambda x: F.regexp_replace(x, r"(?i)-(thinking|highspeed|high|medium|low)$", "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


#: Words that make a plan's item specific (fixed values).
SPECIFIC = "map trace audit inspect verify enumerate identify classify test run search document review inventory analyse analyze implement fix write report check validate".split()


def plan_quality(contents: Column, statuses: Column, calls: Column, debug: Column) -> Column:
    """Score from 0 to 10 of a plan: specific items of some length, several calls, and how much is completed.

    contents, statuses: arrays of the items; calls: how often the plan was written; a debug session loses 2.
    """
    filled = F.filter(F.transform(F.coalesce(contents, F.array()), F.trim), lambda x: x != "")
    n, meant = F.size(F.coalesce(contents, F.array())), F.size(filled)
    share = lambda a, k: F.size(a) / F.nullif(k, F.lit(0))
    length = F.aggregate(filled, F.lit(0), lambda s, x: s + F.char_length(x)) / F.nullif(meant, F.lit(0))
    specific = share(F.filter(filled, lambda x: x.rlike(r"(?i)\b(" + "|".join(SPECIFIC) + r")\b")), meant)
    state = F.transform(F.coalesce(statuses, F.array()), F.lower)
    done = F.size(F.filter(state, lambda x: x == "completed"))
    open_ = F.size(F.filter(state, lambda x: x.isin("pending", "in_progress")))
    calls = F.coalesce(calls, F.lit(0))
    strong = F.when((done == n) & (calls >= 3), 10).when(done >= F.greatest(F.lit(2.0), n * 0.6), 9).otherwise(8)
    fair = F.when((done >= n * 0.5) & (calls >= 2), 7).when(open_ > 0, 5).otherwise(6)
    weak = F.when((calls <= 1) | (open_ > 0), 2).otherwise(4)
    base = F.when((meant == 0) | F.forall(filled, lambda x: F.char_length(x) <= 12), 0)
    base = base.when((n >= 3) & (length >= 35) & (specific >= 0.5), strong).when((n >= 2) & (length >= 20), fair).otherwise(weak)
    return F.least(F.lit(10), F.greatest(F.lit(0), base - F.when(F.coalesce(debug, F.lit(False)), 2).otherwise(0)))


#: Kinds of people by their busiest hour: last hour of each (fixed values).
CHRONOTYPES = [(4, "Nocturnal Hacker"), (8, "Early Bird"), (11, "Morning Person"), (16, "Afternoon Operator"), (20, "Evening Builder"), (23, "Night Owl")]


def chronotype(hour: Column) -> Column:
    out = F.when(hour.isNull(), None)
    for last, name in CHRONOTYPES:
        out = out.when(hour <= last, name)
    return out


#: Classes of an item's status (fixed values).
STATUS = {
    "completed": ["completed", "done"],
    "terminal": ["completed", "done", "failed", "stopped", "crashed"],
    "active": ["running", "running_stale"],
    "failed": ["failed", "stopped", "crashed"],
    "runnable": ["queued", "ready", "pending", "todo"],
}


def status_classes(c: Column) -> dict[str, Column]:
    return {name: F.coalesce(c.isin(*values), F.lit(False)) for name, values in STATUS.items()}
