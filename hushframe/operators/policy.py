"""Settings and decisions for pasted text, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.shared import settled
from . import detect

# Settings where none are stored, and the least length of a paste that is looked at.
DEFAULTS = {"enabled": "true", "blockBehavior": "confirm", "cooldownMinutes": "5", "warnBehavior": "banner", "warnAutoDismissSec": "5"}
MIN_PASTE = 8
# Hosts and the site each belongs to.
HOSTS = {
    "chatgpt.com": "ChatGPT", "chat.openai.com": "ChatGPT", "claude.ai": "Claude", "gemini.google.com": "Gemini",
    "www.perplexity.ai": "Perplexity", "perplexity.ai": "Perplexity", "copilot.microsoft.com": "Microsoft Copilot", "grok.com": "Grok",
    "chat.deepseek.com": "DeepSeek", "chat.mistral.ai": "Mistral Le Chat", "poe.com": "Poe",
}


def effective_settings(stored: Column, site: Column | None = None) -> Column:
    """Defaults, over them what is stored, over that the site's own; an old name of a behaviour is renewed."""
    base = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])
    layers = [base, F.coalesce(stored, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))]
    if site is not None:
        layers.append(F.coalesce(site, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    # The last value of a key wins.
    entries = F.flatten(F.array(*[F.map_entries(x) for x in layers]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    merged = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k))))
    return F.transform_values(merged, lambda k, v: F.when((k == "blockBehavior") & (v == "inline-confirm"), "confirm").otherwise(v))


def upsert_settings(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def kept_overrides(overrides: Column, policy: str = "shipped") -> Column:
    """Tier overrides that differ from the default tier."""
    return F.map_filter(overrides, lambda k, v: v != detect.tier_of(k, "warn", policy))


def site_of(url_host: Column) -> Column:
    sites = F.create_map(*[F.lit(x) for pair in HOSTS.items() for x in pair])
    return F.try_element_at(sites, url_host)


def accepted(events: DataFrame) -> DataFrame:
    """Trusted pastes of at least MIN_PASTE characters while enabled."""
    return events.where("trusted and input_type in ('paste', 'insertFromPaste') and enabled").where(F.length("text") >= MIN_PASTE)


def cooldown(events: Column, minutes: Column) -> Column:
    """Events (t seconds, needs) by time -> whether each is silent: a prompt opens a window that silent ones do not
    extend."""
    def step(last: Column, e: Column) -> tuple[Column, Column]:
        quiet = F.coalesce(e["t"] - last < minutes * 60, F.lit(False))
        prompt = e["needs"] & ~quiet
        one = F.array(F.struct(e["t"].alias("t"), (e["needs"] & quiet).alias("silent"), prompt.alias("prompt")))
        return F.when(prompt, e["t"]).otherwise(last), one

    return T.fold(events, F.lit(None), step, "struct<t:bigint,silent:boolean,prompt:boolean>", "bigint")


def cooldown_rows(events: DataFrame, minutes: int = 5) -> DataFrame:
    """events (host, t seconds, event_id, needs) with `silent` and `prompt`, as cooldown() gives them.

    Prompts are a chain: each is the first time in need that is a window or more after the last. So every time gets its
    successor, from buckets of one window: it lies in the next bucket, or is the first time of a later one. The chains
    begin where nothing in need lies within a window before, and grow by jumps of 1, 2, 4, ... successors, each a join on
    host and time. No task holds more of a host than the times of one bucket, and a row for each bucket; nulls are a host."""
    window = max(1, min(120, minutes or 5)) * 60
    rows = events.withColumn("_h", F.to_json(F.struct("host")))
    times = settled(rows.where("needs and t is not null").select("_h", "t", F.floor(F.col("t") / window).alias("_b")).distinct(), "times")
    by = Window.partitionBy("_h").orderBy("_b")
    lead = lambda c, n: F.lead(c, n).over(by)
    # One row for each host and bucket with an event in need.
    buckets = times.groupBy("_h", "_b").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(by) >= window, F.lit(True))
    buckets = settled(buckets.select("_h", "_b", "_lo", opens.alias("_opens"), lead("_b", 1).alias("_b1"), lead("_lo", 1).alias("_lo1"), lead("_lo", 2).alias("_lo2")), "buckets")
    # The times of a bucket, and those of the one before moved on by a window, in order.
    both = times.select("_h", "_b", F.col("t").alias("_at"), F.col("t").alias("_time"), F.lit(None).cast("long").alias("_from"))
    both = both.union(times.select("_h", F.col("_b") + 1, F.col("t") + window, F.lit(None).cast("long"), "t"))
    within = Window.partitionBy("_h", "_b").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    soon = both.withColumn("_soon", F.min("_time").over(within)).where("_from is not null").select("_h", F.col("_from").alias("t"), (F.col("_b") - 1).alias("_b"), "_soon")
    next_ = F.when(F.col("_b1") == F.col("_b") + 1, F.coalesce("_soon", "_lo2")).otherwise(F.col("_lo1"))
    jumps = settled(soon.join(buckets, ["_h", "_b"]).select("_h", "t", next_.alias("next")).where("next is not null"), "jumps")
    chain = settled(buckets.where("_opens").select("_h", F.col("_lo").alias("t")), "chain")
    n = chain.count()
    while n:
        reached = settled(chain.union(chain.join(jumps, ["_h", "t"]).select("_h", F.col("next").alias("t"))).distinct(), "chain")
        more = reached.count()
        chain = reached
        if more == n:
            break
        n = more
        jumps = settled(jumps.join(jumps.select("_h", F.col("t").alias("next"), F.col("next").alias("_further")), ["_h", "next"]).select("_h", "t", F.col("_further").alias("next")), "jumps")
    # Of several events in need at the time of a prompt the first is it.
    needs = F.coalesce(F.col("needs") & F.col("t").isNotNull(), F.lit(False))
    place = F.row_number().over(Window.partitionBy("_h", "t").orderBy(F.desc(needs), "event_id"))
    found = rows.join(chain.withColumn("_on", F.lit(True)), ["_h", "t"], "left").withColumn("prompt", needs & F.coalesce("_on", F.lit(False)) & (place == 1))
    return found.select(*events.columns, (needs & ~F.col("prompt")).alias("silent"), "prompt")


def decide(mode: Column, quiet: Column, has_block: Column, answer: Column, text: Column, masked: Column) -> Column:
    """What is inserted: masked when silent, by the answer when asked, null when cancelled; the text as it is where
    nothing is to block."""
    silent = (mode == rules.SILENT_MODE) | ((mode == rules.COOLDOWN_MODE) & quiet)
    asked = F.when(answer == rules.ANSWERS["mask"], masked).when(answer == rules.ANSWERS["send"], text)
    return F.when(~has_block, text).when(silent, masked).otherwise(asked)


def shows_banner(spans: Column, behaviour: Column) -> Column:
    return (F.size(detect.of_tier(spans, "warn")) > 0) & (behaviour == "banner")


#: What becomes of a text whose detection failed: it passes as it is, it is held back, or only the catalogue masks it.
FAILURES = ("open", "held", "patterns")


def fail_open(masked: Column, text: Column, open_: bool = True) -> Column:
    """Where detection gave nothing: the text as it is, or nothing."""
    return F.coalesce(masked, text) if open_ else masked


def released(masked: Column, text: Column, error: Column, on_error: str = "open") -> Column:
    """What goes out: the masked text, or where there was an error what the policy says."""
    if on_error not in FAILURES:
        raise ValueError(f"on_error is one of {', '.join(FAILURES)}")
    failed = {"open": text, "held": F.lit(None).cast("string"), "patterns": masked}[on_error]
    return F.when(error.isNotNull(), failed).otherwise(masked)


def chips(spans: Column, k: int = 3) -> Column:
    """The first k findings for display and how many more there are."""
    shown = F.transform(F.slice(spans, 1, k), lambda s: F.struct(T.pretty_label(s["label"]).alias("label"), T.mask_value(s["value"]).alias("value")))
    return F.struct(shown.alias("shown"), F.greatest(F.size(spans) - k, F.lit(0)).alias("more"))
