"""URL filtering by dated lists: entries as intervals, captures joined as of fetch.

A list changes over time: a dated entry adds a pattern to a list or removes it.
Entries become validity intervals [valid_from, valid_to) per list and pattern; a
capture is held against the entries that were active when it was fetched, never
against today's list.

Patterns are of three kinds: a host, a domain (the host itself and everything
below it) and a prefix (host and path, at a slash).  So a URL meets its patterns
by equality: its host, each suffix of the host and each prefix of the path are
its keys.  Time is cut into nested periods, of 32 days, 32 times 32 days and so on, as
many levels as the fetch times need; an interval is filed under the few largest periods
that make it up, 62 a level at most, and a capture under its own of each level.  So the
as-of join is an equality join of narrow rows on kind, key and period with a check of
the instant: a host with a third of all captures spreads over periods, adaptive
execution splits what is left, no group of captures is sorted or collected, and one late
capture adds a level, not a row per month until then.

A capture is blocked if a pattern of a blocking list is active and no pattern of
an allowing list at least as long is.

Cases: entries without pattern, list, kind or instant are void; at one instant an
addition beats a removal; a repeated addition or removal changes nothing; a
removal of what was never added is void; a capture without URL or fetch time
matches nothing and is not blocked; repeated captures each get their row; ids are any
64-bit numbers or null and only carried along; URLs of any length have a key per label
of their host and step of their path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskgauge.llm import common

ENTRY = ["list", "allows", "kind", "pattern"]
_MONTH = "month"


def _month(name: str) -> Column:
    return F.trunc(name, _MONTH)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of ``entries`` (list, allows, kind, pattern, adds, at).

    The state before an instant comes from the same month or, through one row
    per month, from an earlier one: a pattern with a third of all entries is
    not one sort.
    """
    states = (
        entries.filter(F.col("list").isNotNull() & F.col("kind").isNotNull()
                       & F.col("pattern").isNotNull() & F.col("at").isNotNull())
        .select("list", F.coalesce("allows", F.lit(False)).alias("allows"), "kind",
                F.lower("pattern").alias("pattern"), "at",
                F.coalesce("adds", F.lit(False)).alias("adds"))
        .groupBy(*ENTRY, _month("at").alias("month"), "at").agg(F.max("adds").alias("adds"))
    )
    months = Window.partitionBy(*ENTRY).orderBy("month")
    in_month = Window.partitionBy(*ENTRY, "month").orderBy("at")
    keys = [*ENTRY, "month"]
    carried = (states.groupBy(*keys).agg(F.max_by("adds", "at").alias("last"))
               .select(*keys, F.lag("last").over(months).alias("carried")))
    before = F.coalesce(F.lag("adds").over(in_month), "carried", F.lit(False))
    changes = (states.join(carried, keys).withColumn("before", before)
               .filter(F.col("adds") != F.col("before")).select(*keys, "at", "adds"))
    later = (changes.groupBy(*keys).agg(F.min("at").alias("first"))
             .select(*keys, F.lead("first").over(months).alias("later")))
    until = F.coalesce(F.lead("at").over(in_month), "later")
    return (changes.join(later, keys).withColumn("valid_to", until).filter("adds")
            .select(*ENTRY, F.col("at").alias("valid_from"), "valid_to"))


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """Structs (kind, key): all patterns that could match the URL."""
    name = host(url)
    labels = F.split(name, r"\.")
    steps = F.split(F.regexp_replace(path(url), r"^/|/$", ""), "/")
    count = F.when(steps[0] == "", 0).otherwise(F.size(steps))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key(
        "domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), count), lambda i: i > 0),
        lambda i: key("prefix", F.lower(F.concat(
            name, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))))
    found = F.concat(F.array(key("host", name)), domains, prefixes)
    return F.when(name != "", found)


def filter_captures(captures: DataFrame, valid: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``fetched_at``, the active lists, and ``blocked``.

    ``captures`` has page_id, url and fetched_at; ``valid`` comes from
    :func:`intervals`.  Captures are numbered in a written table, since ids may
    repeat; only numbers, keys and instants are shuffled.
    """
    spark = captures.sparkSession
    folder = common.scratch(spark)
    numbered = common.stored(
        captures.select("page_id", "url", "fetched_at",
                        F.monotonically_increasing_id().alias("row")), folder, "captures")
    first, last = numbered.agg(
        F.min(_period(F.col("fetched_at"))), F.max(_period(F.col("fetched_at")))).first()
    first, last = (0, -1) if first is None else (first, last)
    levels = levels_of(first, last)
    since = F.greatest(_period(F.col("valid_from")), F.lit(first))
    until = F.least(F.coalesce(_period(F.col("valid_to")), F.lit(last)), F.lit(last))
    filed = valid.filter(since <= until).select(
        "*", F.inline(periods(since, until, levels)))
    own = F.array(*[_place(k, F.shiftright(_period(F.col("fetched_at")), _STEP * k))
                    for k in range(levels)])
    asked = (
        numbered.filter(F.col("fetched_at").isNotNull())
        .select("row", "fetched_at", own.alias("own"), F.inline(keys(F.col("url"))))
        .select("row", "fetched_at", "kind", "key", F.inline("own"))
    )
    active = (F.col("valid_from") <= F.col("fetched_at")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    longest = lambda allows: F.coalesce(
        F.max(F.when(F.col("allows") == allows, F.length("pattern"))), F.lit(0))
    met = (
        asked.join(filed.withColumnRenamed("kind", "of"),
                   (F.col("key") == F.col("pattern")) & (F.col("kind") == F.col("of"))
                   & (asked["level"] == filed["level"]) & (asked["number"] == filed["number"]))
        .filter(active)
        .groupBy("row").agg(
            F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
            F.count("*").alias("n_entries"),
            (longest(False) > longest(True)).alias("blocked"))
    )
    return numbered.join(met, "row", "left").select(
        "page_id", "url", "fetched_at", F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"))


_STEP = 5  # bits: a period holds 32 of the level below


def _period(at: Column) -> Column:
    """Number of the 32 days an instant lies in."""
    return F.shiftright(F.unix_date(at.cast("date")), _STEP)


def levels_of(first: int, last: int) -> int:
    """Levels until the periods from first to last lie in 32 neighbours."""
    levels = 1
    while (last >> _STEP * (levels - 1)) - (first >> _STEP * (levels - 1)) >= 1 << _STEP:
        levels += 1
    return levels


def _place(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), number.alias("number"))


def periods(first: Column, last: Column, levels: int) -> Column:
    """The largest periods that make up those from first to last, inclusive."""
    none = F.array().cast("array<struct<level:int,number:int>>")

    def span(level: int, low: Column, high: Column) -> Column:
        return F.when(low <= high, F.transform(
            F.sequence(low, high), lambda n: _place(level, n))).otherwise(none)

    low, high, found = first, last, []
    for level in range(levels - 1):
        upper_low = F.shiftright(low + ((1 << _STEP) - 1), _STEP)
        upper_high = F.shiftright(high + 1, _STEP) - 1
        whole = upper_low <= upper_high
        found.append(F.when(whole, F.concat(
            span(level, low, F.shiftleft(upper_low, _STEP) - 1),
            span(level, F.shiftleft(upper_high + 1, _STEP), high))).otherwise(span(level, low, high)))
        low, high = F.when(whole, upper_low), F.when(whole, upper_high)
    found.append(span(levels - 1, low, high))
    return F.concat(*[F.coalesce(part, none) for part in found])


# ------------------------------------------------- captures and lists from pages

def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time spread over 2024 by their id."""
    minute = F.pmod(F.pmod(F.col("page_id").cast("bigint"), F.lit(525_600)) * 7919, F.lit(525_600))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        _after(minute * 60).alias("fetched_at"))


def _after(seconds: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def lists_of(pages: DataFrame) -> DataFrame:
    """Dated entries about every host of the pages, by the digits of its MD5.

    Hosts are on "spam" twice in the year, their domains on "reported" now and
    then, and the English part of some is "trusted" from a day on.
    """
    name = host(F.col("url"))
    hosts = pages.select(name.alias("host")).filter("host <> ''").distinct()
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(
        F.md5(F.col("host").cast("binary")), k, 1)) - 1
    bare = F.regexp_replace("host", r"^(www|blog|m)\.", "")
    day = lambda n: _after(n * 86_400)

    def entry(name, allows, kind, pattern, adds, at):
        return F.struct(F.lit(name).alias("list"), F.lit(allows).alias("allows"),
                        F.lit(kind).alias("kind"), pattern.alias("pattern"),
                        (adds if isinstance(adds, Column) else F.lit(adds)).alias("adds"), at.alias("at"))

    return hosts.select(F.inline(F.array(
        entry("spam", False, "host", F.col("host"), True, day(digit(1) * 10)),
        entry("spam", False, "host", F.col("host"), False, day(digit(1) * 10 + digit(2) * 5)),
        entry("spam", False, "host", F.col("host"), True, day(digit(3) + 200)),
        entry("spam", False, "host", F.col("host"), False, day(digit(3) + 200 + digit(4) * 12)),
        entry("reported", False, "domain", bare, True, day(digit(5) * 20)),
        entry("reported", False, "domain", bare, False, day(digit(6) * 24)),
        entry("trusted", True, "prefix", F.concat("host", F.lit("/en")), digit(7) < 8,
              day(digit(8) * 20)),
    )))
