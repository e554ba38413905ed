"""Scalar functions as column expressions: token totals, model and provider names, times, labels, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasoning tiers that may end a model name, provider aliases, tool labels.
TIERS = ("minimal", "low", "medium", "high", "xhigh", "none", "auto")
ALIASES = {
    "x_ai": "xai", "xai": "xai", "z_ai": "zai", "zai": "zai", "moonshot": "moonshotai", "moonshotai": "moonshotai", "meta": "meta_llama", "meta_llama": "meta_llama",
    "azure": "azure_ai", "azure_ai": "azure_ai", "anthropic": "anthropic", "vertex": "anthropic", "vertex_ai": "anthropic", "together": "together_ai", "together_ai": "together_ai",
    "fireworks": "fireworks_ai", "fireworks_ai": "fireworks_ai", "google": "google", "gemini": "google", "openai": "openai", "openai_codex": "openai", "mistral": "mistralai",
    "mistralai": "mistralai", "ai21": "ai21",
}
FAMILIES = (
    ("claude|anthropic|\\b(opus|sonnet|haiku)\\b", "anthropic"),
    ("gpt|openai|\\b(o1|o3|o4)\\b", "openai"),
    ("gemini|google", "google"),
    ("grok", "xai"),
    ("deepseek", "deepseek"),
    ("mimo|xiaomi", "xiaomi"),
    ("mistral|mixtral", "mistral"),
    ("llama|\\bmeta\\b", "meta"),
    ("qwen", "qwen"),
    ("glm", "zai"),
)

COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_output_tokens"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_total(counter_log: Column, prefix: str = "") -> Column:
    """Sum of the counters; where `counter_log` holds, reasoning is already inside output."""
    i, o, w, r, think = (F.col(prefix + c) for c in COUNTERS)
    return i + o + r + w + F.when(counter_log, F.lit(0)).otherwise(think)


def positive_number(x: Column | str) -> Column:
    x = _c(x).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0), F.lit(0.0)).otherwise(x)


def positive_int(x: Column | str) -> Column:
    return F.floor(positive_number(x)).cast("long")


def normalise_model(x: Column | str, tiers: tuple[str, ...] = TIERS) -> Column:
    """Lower case; without a known tier in parentheses and a date suffix; versions with hyphens for the family that writes both."""
    name = F.lower(F.trim(_c(x)))
    name = F.when(name.isNull() | (name == ""), "unknown").otherwise(name)
    name = F.regexp_replace(name, rf"(?<=\S)\((?:{'|'.join(tiers)})\)$", "")
    name = F.when(F.char_length(name) > 9, F.regexp_replace(name, r"-\d{8}$", "")).otherwise(name)
    return F.when(name.contains("claude"), F.regexp_replace(name, r"(?<=\d)\.(?=\d)", "-")).otherwise(name)


def canonical_provider(x: Column | str) -> Column:
    known = F.create_map(*(F.lit(v) for kv in ALIASES.items() for v in kv))
    parts = F.transform(F.split(F.regexp_replace(F.trim(_c(x)), "-", "_"), "[/.]"), lambda p: F.lower(F.trim(p)))
    named = F.transform(parts, lambda p: F.when((p == "") | (p == "unknown"), F.lit(None).cast("string")).otherwise(F.coalesce(known[p], F.when(~p.rlike(r"\d"), p))))
    return F.get(F.filter(named, lambda p: p.isNotNull()), F.lit(0))


def infer_provider(model: Column | str) -> Column:
    low = F.lower(F.coalesce(_c(model), F.lit("")))
    out = F.when(low.rlike(FAMILIES[0][0]), FAMILIES[0][1])
    for pattern, name in FAMILIES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out


def source_label(client: Column | str, labels: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(v) for kv in labels.items() for v in kv))
    client = F.nullif(_c(client), F.lit(""))
    return F.coalesce(known[client], client, F.lit("unknown"))


def local_date(epoch: Column | str, zone: str) -> Column:
    """Date in the display zone of an epoch number: above 1e12 milliseconds, else seconds; null stays null."""
    e = _c(epoch).cast("double")
    ts = F.timestamp_millis(F.when(F.abs(e) > 1e12, e).otherwise(e * 1000).cast("long"))
    return F.to_date(F.from_utc_timestamp(ts, zone))


def event_instant(value: Column | str) -> Column:
    """Instant of a text: epoch digits (below 1e10 seconds, else milliseconds) or ISO text, which is UTC without a zone."""
    v = F.trim(_c(value).cast("string"))
    n = v.try_cast("double")
    epoch = F.timestamp_millis(F.when(n < 1e10, n * 1000).otherwise(n).cast("long"))
    return F.when(n.isNotNull(), epoch).otherwise(F.try_to_timestamp(v))


def local_hour(ts: Column | str, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(_c(ts), zone))


def display_today(now: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(now, valid_zone(zone)))


def valid_zone(zone: str | None) -> str:
    """The zone if it is a known name, else UTC."""
    from zoneinfo import available_timezones

    return zone if zone in available_timezones() else "UTC"


def workspace_label(folder: Column | str) -> Column:
    """The decoded name where it is an absolute path, else the name as it is."""
    folder = _c(folder)
    decoded = F.try_url_decode(folder)
    return F.when(decoded.rlike(r"^(/|[A-Za-z]:[\\/])"), decoded).otherwise(folder)


def last_segment(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def row_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), 256)


def row_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


def compact_number(x: Column | str) -> Column:
    """K, M and B with one decimal, none where it is zero. Rounded by the number's exact binary value, ties away from zero."""
    x = _c(x).cast("double")
    a = F.abs(x)

    def cut(by: float, sign: str) -> Column:
        q = a / by
        q = F.when((q * 4) % 2 == 1, q + 0.01).otherwise(q)  # .25 and .75 are the only exact ties; format_number sends them to even
        return F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(F.call_function("format_number", q, F.lit("0.0")), r"\.0$", ""), F.lit(sign))

    return F.when(x.isNull(), "—").when(a >= 1e9, cut(1e9, "B")).when(a >= 1e6, cut(1e6, "M")).when(a >= 1e3, cut(1e3, "K")).otherwise(F.format_string("%.0f", x))


def mask_email(x: Column | str) -> Column:
    x = _c(x)
    at = F.instr(x, "@")
    return F.when(at > 1, F.concat(F.substring(x, F.lit(1), F.least(F.lit(4), at - 1)), F.lit("***@"), F.substring(x, at + 1, F.char_length(x))))


def project_label(path: Column | str, session: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(path), F.lit("")), _c(session))


def display_time(ts: Column | str, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(_c(ts), zone), "yyyy-MM-dd HH:mm")


def split_cached(input_tokens: Column, cached: Column) -> tuple[Column, Column]:
    """Cached tokens counted inside the input: the input without them, and the cached ones, at most the input."""
    read = F.least(cached, input_tokens)
    return input_tokens - read, read


def split_cached_checked(i: Column, cached: Column, o: Column, r: Column, tool: Column, total: Column) -> tuple[Column, Column]:
    """As split_cached, but where a total is given only if it says that the input holds the cached tokens. Those stay unclamped."""
    i, cached, o, r, tool = (F.greatest(x, F.lit(0)) for x in (i, cached, o, r, tool))
    inside = i + o + r + tool
    holds = total.isNull() | (cached > 0) & (F.greatest(total, F.lit(0)) == inside)
    return F.when(holds, i - F.least(cached, i)).otherwise(i), cached


def percent(part: Column, whole: Column) -> Column:
    """Part of whole in per cent; 0 where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole * 100).otherwise(F.lit(0.0))


def delta_pct(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before).cast("double") / before * 100)


def delta_class(delta: Column) -> Column:
    return F.when(delta.isNull(), "none").when(delta > 0.05, "up").when(delta < -0.05, "down").otherwise("flat")
