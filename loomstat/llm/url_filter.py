"""URL filters by a temporal list join, in DataFrame functions alone.

A list is a log of dated entries: a pattern was added or removed. Per pattern the log becomes validity
intervals [added, next entry), and every capture is evaluated against the entries that were active when it
was fetched: the as-of join is an equi-join on the keys of its URL with the interval as condition.

A ``domain`` pattern covers a host and all hosts below it; a ``prefix`` pattern is host/path and covers
that path and all paths below it, whole segments only, or, with nothing after the host, all of this host.
Keys of a URL are therefore its host's parent domains and its path's leading segments. Patterns and URLs
go through the same functions: scheme, user, port, query, fragment, a final dot and the case of the host,
empty segments and a final slash do not count; the case of a path does. A pattern may stand without its
scheme, and a leading ``*.`` says no more than ``domain`` does. Of several active patterns the longest is
the rule, ties by name; the rule is reported as it is after normalisation.

Captures of one URL and time are evaluated once, before keys are exploded. Both joins have a plain shuffle
or a written table on either side, no aggregate over its own shuffle, so that AQE splits a key with a third
of all captures (a top-level domain that is on the list, or one URL that is fetched all the time), and
makes no shuffle of captures where the list is small.

A capture without URL or time, or whose URL has no ``//``, matches nothing and is kept; entries with a null
in pattern, kind, action or date, of another kind, without a host, or of kind ``domain`` with a path are
ignored; of entries of a pattern at one time a removal wins; repeated rows are repeated in the result.
Other columns of captures are kept, whatever their names; those of the list are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, written

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*/([^?#]*)"
#: Hosts that are numbers and have no parent domains.
ADDRESS = r"^([0-9.]+|\[.*)$"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def keys_of(url: Column) -> Column:
    """Parent domains and leading paths of a URL, as (kind, pattern)."""
    host, segments = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    domains = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    kind = lambda name: lambda p: F.struct(F.lit(name).alias("kind"), p.alias("pattern"))
    return F.when(host != "", F.concat(F.transform(domains, kind("domain")), F.transform(prefixes, kind("prefix"))))


def normal(kind: Column, pattern: Column) -> Column:
    """A pattern as one of the keys that it covers has it; null if there is none."""
    bare = F.regexp_replace(F.trim(pattern), r"^(\*?\.)+", "")
    url = F.when(bare.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//"), bare).otherwise(F.concat(F.lit("//"), bare))
    host, segments = host_of(url), segments_of(url)
    return F.when(host == "", F.lit(None)).when(kind == "prefix", F.concat(host, F.lit("/"), F.array_join(segments, "/"))).when((kind == "domain") & (F.size(segments) == 0), host)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until) from (kind, pattern, action, at); until is null for what is still active."""
    log = entries.select("kind", normal(F.col("kind"), F.col("pattern")).alias("pattern"), "action", "at").dropna()
    # Of the entries of a time the removal is the last word, and only that counts.
    log = log.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("kind", "pattern").orderBy("at")
    log = log.withColumn("until", F.lead("at").over(w)).withColumn("before", F.lag("action").over(w))
    active = log.where("action = 'add'")
    # An addition to an active pattern goes on with its interval; what the rule reports is the first date.
    run = F.sum(F.when(F.coalesce(F.col("before") == "add", F.lit(False)), 0).otherwise(1)).over(w)
    return active.withColumn("run", run).groupBy("kind", "pattern", "run").agg(F.min("at").alias("since"), F.max(F.struct("at", "until")).alias("last")).select("kind", "pattern", "since", F.col("last.until").alias("until"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with blocked, n_active, rule_kind, rule and rule_since: what the list said at the time of the fetch."""
    prepare(captures.sparkSession)
    once = captures.select(F.col(url).alias("u"), F.col(fetched).alias("t")).dropna().distinct()
    keyed = once.select("u", "t", F.explode(keys_of(F.col("u"))).alias("key")).select("u", "t", "key.*")
    valid = written(intervals(entries), "intervals")
    hit = keyed.join(valid, ["kind", "pattern"]).where((F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    best = F.max(F.struct(F.length("pattern").alias("length"), F.col("pattern"), F.col("kind"), F.col("since")))
    found = written(hit.groupBy("u", "t").agg(F.count("*").alias("n"), best.alias("best")), "blocked")
    c, f = captures.alias("c"), found.alias("f")
    return c.join(f, (F.col(f"c.{url}") == F.col("f.u")) & (F.col(f"c.{fetched}") == F.col("f.t")), "left").select(
        "c.*", F.col("f.n").isNotNull().alias("blocked"), F.coalesce("f.n", F.lit(0)).cast("long").alias("n_active"),
        F.col("f.best.kind").alias("rule_kind"), F.col("f.best.pattern").alias("rule"), F.col("f.best.since").alias("rule_since"),
    )


def demo_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of pages by a rule: the driver's tables have none."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    code = lambda salt: F.conv(F.substring(F.md5(F.concat("host", F.lit(salt))), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    kind = code("k") % 4
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (code("l") % 4 + 1).cast("int"))
    base = hosts.where(kind != 3).select(
        F.when(kind == 2, "prefix").otherwise("domain").alias("kind"),
        # Written as people write them: some hosts in capitals, some paths with a slash at the end, and some in capitals, which cover other paths.
        F.when(kind == 0, F.when(code("c") % 2 == 0, F.upper("host")).otherwise(F.col("host"))).when(kind == 1, F.substring_index("host", ".", -3))
        .otherwise(F.concat("host", F.lit("/"), F.when(code("u") % 4 == 0, F.upper(lang)).otherwise(lang), F.when(code("s") % 2 == 0, "/").otherwise(""))).alias("pattern"),
        (code("a") % 400).alias("a"), (code("r") % 300 + 20).alias("r"), (code("b") % 200 + 10).alias("b"),
    )
    event = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    a, r, b = F.col("a"), F.col("r"), F.col("b")
    events = F.array(event("add", a), event("remove", a + r), event("add", a + r + b))
    return base.select("kind", "pattern", F.explode(F.slice(events, F.lit(1), (a % 3 + 1).cast("int"))).alias("e")).select("kind", "pattern", "e.*")


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched); the driver's pages have no time, so a rule gives them one."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")).alias("fetched"))


#: evaluate(captures_of(pages), demo_list(pages)) with each active interval found as the last entry up to the fetch.
ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 730)::INT AS fetched,
                  regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\.$', '') AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
c AS (SELECT host, ('0x' || substr(md5(host || 'k'), 1, 6))::INT % 4 AS k, ('0x' || substr(md5(host || 'l'), 1, 6))::INT % 4 AS l,
             ('0x' || substr(md5(host || 'a'), 1, 6))::INT % 400 AS a, ('0x' || substr(md5(host || 'r'), 1, 6))::INT % 300 + 20 AS r,
             ('0x' || substr(md5(host || 'b'), 1, 6))::INT % 200 + 10 AS b, ('0x' || substr(md5(host || 'c'), 1, 6))::INT % 2 AS c,
             ('0x' || substr(md5(host || 's'), 1, 6))::INT % 2 AS s, ('0x' || substr(md5(host || 'u'), 1, 6))::INT % 4 AS u FROM h),
e AS (SELECT CASE k WHEN 2 THEN 'prefix' ELSE 'domain' END AS kind,
             CASE k WHEN 0 THEN CASE c WHEN 0 THEN upper(host) ELSE host END WHEN 1 THEN array_to_string(string_split(host, '.')[-3:], '.')
                    ELSE host || '/' || CASE u WHEN 0 THEN upper(['en', 'de', 'fr', 'es'][l + 1]) ELSE ['en', 'de', 'fr', 'es'][l + 1] END || CASE s WHEN 0 THEN '/' ELSE '' END END AS pattern,
             unnest([{{'action': 'add', 'day': DATE '2024-01-01' + a}}, {{'action': 'remove', 'day': DATE '2024-01-01' + (a + r)}}, {{'action': 'add', 'day': DATE '2024-01-01' + (a + r + b)}}][: a % 3 + 1]) AS e
      FROM c WHERE k <> 3),
log AS (SELECT kind, CASE kind WHEN 'domain' THEN lower(pattern) ELSE lower(split_part(pattern, '/', 1)) || '/' || rtrim(substr(pattern, strpos(pattern, '/') + 1), '/') END AS pattern,
               e.day AS day, max(e.action) AS action FROM e GROUP BY ALL),
keys AS (SELECT page_id, url, fetched, unnest(list_concat(
           list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: {{'kind': 'domain', 'pattern': array_to_string(string_split(host, '.')[i:], '.')}}),
           list_transform(range(0, len(list_filter(string_split(path, '/'), lambda s: s <> '')) + 1), lambda i: {{'kind': 'prefix', 'pattern': host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '')[:i], '/')}}))) AS key
         FROM p WHERE host <> ''),
last AS (SELECT page_id, url, fetched, log.kind, log.pattern, arg_max(action, day) AS action, max(day) AS day
         FROM keys JOIN log ON key.kind = log.kind AND key.pattern = log.pattern AND log.day <= fetched GROUP BY ALL),
-- The rule's date is where its run of additions began.
since AS (SELECT l.page_id, l.kind, l.pattern, min(g.day) AS since
          FROM last l JOIN log g ON g.kind = l.kind AND g.pattern = l.pattern AND g.day <= l.day
           AND NOT EXISTS (SELECT 1 FROM log x WHERE x.kind = l.kind AND x.pattern = l.pattern AND x.action = 'remove' AND x.day BETWEEN g.day AND l.day)
          WHERE l.action = 'add' GROUP BY ALL),
best AS (SELECT page_id, count(*) AS n, max({{'length': length(pattern), 'pattern': pattern, 'kind': kind, 'since': since}}) AS best FROM since GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, best.best.kind AS rule_kind, best.best.pattern AS rule, best.best.since AS rule_since
FROM p LEFT JOIN best USING (page_id)"""
