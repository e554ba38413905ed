"""Prices: resolved once for each distinct model, then joined to the facts; graduated and flat cost in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S

RATE, MONEY = "decimal(18,12)", "decimal(31,12)"
TIER_SIZES = {"128k": 128_000, "200k": 200_000, "256k": 256_000, "272k": 272_000}
#: Which counters have which tiers.
TIERS = {"input": ("128k", "200k", "256k", "272k"), "output": ("128k", "200k", "256k", "272k"), "cache_read": ("200k", "272k"), "cache_write": ("200k",)}
RATES = [*TIERS, *(f"{k}_above_{t}" for k, ts in TIERS.items() for t in ts)]
EXCLUDED = "^github_copilot/"
RESELLERS = (("openrouter/", -5000), ("vertex_ai/", -2000), ("bedrock/", -2000))
FUZZY_LEAST = 5


def _dotted(x: Column) -> Column:
    """Single digits around a hyphen are a version: 4-5 becomes 4.5."""
    return F.regexp_replace(x, r"(?<=(?<!\d)\d)-(?=\d(?!\d))", ".")


def _shorter(x: Column, most: int = 4) -> Column:
    """The name without its last segment, last two, ... ; two characters at least."""
    parts = F.split(x, "-")
    cut = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "-"))
    return F.filter(F.when(F.size(parts) > 1, cut).otherwise(F.array().cast("array<string>")), lambda s: F.char_length(s) >= 2)


def _tails(x: Column, most: int = 2) -> Column:
    """The name without its first segment, and the first two, each followed by its shorter forms."""
    parts = F.split(x, "-")
    made = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "-"))
    made = F.filter(F.when(F.size(parts) > 1, made).otherwise(F.array().cast("array<string>")), lambda s: F.char_length(s) >= 2)
    return F.flatten(F.transform(made, lambda s: F.concat(F.array(s), _shorter(s))))


def _bare(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


#: How lists write a provider before a model's name, where not as we do; the second list writes one more in its own way.
PREFIXES = {"meta_llama": "meta-llama", "xai": "x-ai"}
PREFIXES_2 = PREFIXES | {"zai": "z-ai"}


def model_ids(models: DataFrame) -> DataFrame:
    """model, provider -> model, provider, hint (the provider, else the one that the name tells), rank, id: names of the model without a provider, best first."""
    models = models.select("model", "provider").distinct().withColumn("low", F.lower(F.trim("model"))).where("low <> ''")
    models = models.withColumn("base", _bare(F.col("low"))).withColumn("hint", F.coalesce(S.canonical_provider("provider"), S.infer_provider("low")))
    m, b = F.col("low"), F.col("base")
    ids = F.array_distinct(F.concat(F.array(m, b, _dotted(m), _dotted(b)), _shorter(m), _shorter(b), _tails(m), _tails(b)))
    return models.select("model", "provider", "hint", F.posexplode(F.filter(ids, lambda c: c != "")).alias("rank", "id"))


def model_candidates(models: DataFrame) -> DataFrame:
    """model, provider -> dataset, model, provider, rank, candidate: names under which each of the two lists may have a price, best first."""
    ids = model_ids(models).groupBy("model", "provider", "hint").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))

    def forms(prefixes: dict[str, str]) -> Column:
        known = F.create_map(*(F.lit(v) for kv in prefixes.items() for v in kv))
        prefix = F.coalesce(known[F.col("hint")], F.col("hint"))
        each = F.transform("ids", lambda c: F.concat(F.when(prefix.isNotNull(), F.array(F.concat_ws("/", prefix, _bare(c)))).otherwise(F.array().cast("array<string>")), F.array(c, _bare(c))))
        return F.filter(F.array_distinct(F.flatten(each)), lambda c: c != "")

    both = F.array(F.struct(F.lit("d1").alias("dataset"), forms(PREFIXES).alias("names")), F.struct(F.lit("d2").alias("dataset"), forms(PREFIXES_2).alias("names")))
    lists = ids.select("model", "provider", F.explode(both).alias("x"))
    return lists.select("x.dataset", "model", "provider", F.posexplode("x.names").alias("rank", "candidate"))


def read_price_dim(prices: DataFrame) -> DataFrame:
    """Prices with all rate columns as exact decimals; entries without an input and an output price are no prices."""
    rate = {c: F.col(c).cast(RATE) if c in prices.columns else F.lit(None).cast(RATE) for c in RATES}
    rate |= {c: F.coalesce(rate[c], F.lit(0).cast(RATE)) for c in TIERS}
    out = prices.where(F.col("input").isNotNull() | F.col("output").isNotNull())
    return out.select("dataset", "model_key", *(x.alias(c) for c, x in rate.items()))


def _priced(dim: DataFrame) -> DataFrame:
    return dim.where(~F.lower("model_key").rlike(EXCLUDED)).select("dataset", F.lower("model_key").alias("low"), F.struct("model_key", *RATES).alias("rates"))


def exact_match(candidates: DataFrame, dim: DataFrame) -> DataFrame:
    """dataset, model, provider, rates: of each list the first candidate's price, by the same key, with openai/ before it, or, in the second list, by the same last part."""
    low = F.col("low")
    kinds = F.array(F.struct(low.alias("candidate"), F.lit(0).alias("kind")), F.struct(F.when(low.startswith("openai/"), F.substring(low, 8, 200)).alias("candidate"), F.lit(1).alias("kind")), F.struct(F.when(F.col("dataset") == "d2", _bare(low)).alias("candidate"), F.lit(2).alias("kind")))
    listed = _priced(dim).select("dataset", "rates", F.explode(kinds).alias("x")).select("dataset", "rates", "x.*").where("candidate IS NOT NULL")
    found = candidates.join(listed, ["dataset", "candidate"])
    return found.groupBy("dataset", "model", "provider").agg(F.min_by("rates", F.struct("rank", "kind", "rates.model_key")).alias("rates"))


def _prefixes(x: Column) -> Column:
    """The name and what is left of it without its last part, last two, ... at hyphens."""
    parts = F.split(x, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "-"))


def fuzzy_match(candidates: DataFrame, dim: DataFrame) -> DataFrame:
    """model, provider, rates by related names: equal, or one the other's beginning up to a hyphen, both of FUZZY_LEAST characters at least.

    The first list comes before the second, then the better candidate, then the key with the higher score. Related names
    meet by the beginnings of one of them, so there are two plain joins and no comparison of every pair.
    """
    keys = _priced(dim).withColumn("known", _dotted(_bare(F.col("low")))).where(F.char_length("known") >= FUZZY_LEAST)
    asked = candidates.withColumn("wanted", _dotted(F.col("candidate"))).where(F.char_length("candidate") >= FUZZY_LEAST)
    longer = asked.join(keys.withColumn("wanted", F.explode(_prefixes(F.col("known")))), ["dataset", "wanted"])
    shorter = asked.withColumn("known", F.explode(_prefixes(F.col("wanted")))).where("known <> wanted").join(keys, ["dataset", "known"])
    found = longer.unionByName(shorter)
    own = F.regexp_extract("candidate", "^[^-.]*", 0)
    score = F.char_length("low") + F.when((own != "") & F.col("low").startswith(F.concat(own, F.lit("/"))), 10_000).otherwise(0) + F.when(F.col("low").contains("/"), 100).otherwise(0)
    for prefix, points in RESELLERS:
        score = score + F.when(F.col("low").startswith(prefix), points).otherwise(0)
    best = found.groupBy("model", "provider", "dataset", "rank").agg(F.max_by("rates", F.struct(score, "low")).alias("rates"))
    return best.groupBy("model", "provider").agg(F.min_by("rates", F.struct("dataset", "rank")).alias("rates"))


def _given(ids: DataFrame, table: DataFrame, bare: bool) -> DataFrame:
    """model, provider, rates of an override table: by the model's best name that it has."""
    keys = read_price_dim(table).select(F.lower("model_key").alias("name"), F.struct("model_key", *RATES).alias("rates"))
    found = ids.withColumn("name", _bare(F.col("id")) if bare else F.col("id")).join(keys, "name")
    return found.groupBy("model", "provider").agg(F.min_by("rates", F.struct("rank", "rates.model_key")).alias("rates"))


def resolve_prices(models: DataFrame, dim: DataFrame, first: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
    """model, provider -> rates for distinct models.

    Order: `first` overrides by any of the model's names; exact hits in d1, or in d2 where d1 has no cache price and d2 does,
    or where only d2 lists the model; `late` overrides; related names; else no rates.
    """
    models = models.select("model", "provider").distinct()
    ids, names = model_ids(models), model_candidates(models)
    hits = exact_match(names, dim)
    cache = lambda r: (F.col(f"{r}.cache_read") > 0) | (F.col(f"{r}.cache_write") > 0)
    both = hits.groupBy("model", "provider").agg(*(F.max(F.when(F.col("dataset") == d, F.col("rates"))).alias(n) for d, n in (("d1", "one"), ("d2", "two"))))
    exact = both.select("model", "provider", F.when(F.col("one").isNull() | (~cache("one") & F.col("two").isNotNull() & cache("two")), F.col("two")).otherwise(F.col("one")).alias("rates"))
    steps = [exact, fuzzy_match(names, dim)]
    if late is not None:
        steps.insert(1, _given(ids, late, bare=False))
    if first is not None:
        steps.insert(0, _given(ids, first, bare=True))
    found = None
    for i, step in enumerate(steps):
        step = step.withColumn("turn", F.lit(i))
        found = step if found is None else found.unionByName(step)
    best = found.groupBy("model", "provider").agg(F.min_by("rates", "turn").alias("rates")).withColumnsRenamed({"model": "_m", "provider": "_p"})
    return models.join(best, (F.col("model") == F.col("_m")) & F.col("provider").eqNullSafe(F.col("_p")), "left").select("model", "provider", "rates")


MOST_PRICES = 100_000


def price_table(resolved: DataFrame, most: int = MOST_PRICES) -> DataFrame:
    """Resolved prices worked out once: as a constant table where there are `most` rows or fewer, else as they are."""
    spark = resolved.sparkSession
    text = resolved.limit(most + 1).agg(F.count("*").alias("n"), F.to_json(F.collect_list(F.struct("model", "provider", "rates"))).alias("rows")).first()
    if text.n > most:
        return resolved
    kind = f"array<{resolved.select(F.struct('model', 'provider', 'rates').alias('x')).schema['x'].dataType.simpleString()}>"
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text.rows), kind))))


def _exact(n: Column, price: Column) -> Column:
    """Any count of tokens times a rate: 19 digits hold every long."""
    return (n.cast("decimal(19,0)") * price).cast(MONEY)


def _part(tokens: Column, rates: str, kind: str, tiered: bool) -> Column:
    """Graduated price of one counter: up to each tier at the running price. A tier without a price is skipped."""
    price = lambda c: F.greatest(F.coalesce(F.col(f"{rates}.{c}"), F.lit(0)), F.lit(0)).cast(RATE)
    n = F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long")
    if not tiered:
        return _exact(n, price(kind))
    steps = [(TIER_SIZES[t], f"{kind}_above_{t}") for t in TIERS[kind]]
    total, lower, running = None, F.lit(0).cast("long"), price(kind)
    for size, c in steps:
        has = F.col(f"{rates}.{c}").isNotNull()
        spent = _exact(F.greatest(F.least(n, F.lit(size)) - lower, F.lit(0)), running)
        spent = F.when(has, spent).otherwise(F.lit(0).cast(MONEY))
        total = spent if total is None else total + spent
        lower = F.when(has, F.lit(size).cast("long")).otherwise(lower)
        running = F.when(has, price(c)).otherwise(running)
    rest = _exact(F.greatest(n - lower, F.lit(0)), running)
    return rest if total is None else total + rest


def cost(rates: str = "rates", tiered: bool = True, counters: dict[str, Column] | None = None) -> Column:
    """Cost of a row's tokens as a decimal; 0 without rates. Output and reasoning are priced together."""
    c = counters or {
        "input": F.col("input_tokens"),
        "output": F.col("output_tokens") + F.col("reasoning_output_tokens"),
        "cache_read": F.col("cache_read_tokens"),
        "cache_write": F.col("cache_creation_tokens"),
    }
    total = _part(c["input"], rates, "input", tiered)
    for kind in ("output", "cache_read", "cache_write"):
        total = total + _part(c[kind], rates, kind, tiered)
    return F.coalesce(total, F.lit(0)).cast(MONEY)


def join_prices(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts (with model and provider; without one it is null) with `rates`. Broadcast where price_table found the prices to be few."""
    if "provider" not in facts.columns:
        facts = facts.withColumn("provider", F.lit(None).cast("string"))
    prices = resolved.withColumnsRenamed({"model": "_m", "provider": "_p"})
    return facts.join(prices, (F.col("model") == F.col("_m")) & F.col("provider").eqNullSafe(F.col("_p")), "left").drop("_m", "_p")


def cache_savings(rates: str = "rates") -> Column:
    """What the cached tokens would have cost more as plain input; never below 0."""
    think = F.col("output_tokens") + F.col("reasoning_output_tokens")
    cached = F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    zero = F.lit(0).cast("long")
    plain = cost(rates, counters={"input": F.col("input_tokens") + cached, "output": think, "cache_read": zero, "cache_write": zero})
    return F.when(cached > 0, F.greatest(plain - cost(rates), F.lit(0).cast(MONEY))).otherwise(F.lit(0).cast(MONEY))


def effective_cost(computed: Column, recorded: Column, policy: str) -> Column:
    """computed-first, recorded-first or computed-only."""
    some = lambda x: F.when(x > 0, x)
    zero = F.lit(0).cast(MONEY)
    if policy == "computed-only":
        return computed
    a, b = (computed, recorded) if policy == "computed-first" else (recorded, computed)
    return F.coalesce(some(a), some(b), zero)


def as_double(x: Column) -> Column:
    """Published money: the nearest double of the exact decimal."""
    return x.cast("string").cast("double")


def normalise_price_feed(feed: DataFrame) -> DataFrame:
    """Vendor feed rows (model_key, list_prompt, list_completion, endpoints of provider_name, prompt, completion) as prices.

    The author's own endpoint wins over the list price; prices are texts, and negative or odd ones are none; both are needed.
    """
    author = F.split("model_key", "/")[0]
    own = F.get(F.filter("endpoints", lambda e: F.lower(e["provider_name"]) == F.lower(author)), F.lit(0))
    number = lambda x: F.when(x.try_cast(RATE) >= 0, x.try_cast(RATE))
    out = feed.select("model_key", F.coalesce(number(own["prompt"]), number(F.col("list_prompt"))).alias("input"), F.coalesce(number(own["completion"]), number(F.col("list_completion"))).alias("output"))
    return out.where("input IS NOT NULL AND output IS NOT NULL").select(F.lit("d2").alias("dataset"), "*")
