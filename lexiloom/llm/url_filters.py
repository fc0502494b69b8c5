"""URL filters as a sort-merge range join.

A host is turned round label by label (``www.example.com`` to ``com\\0example\\0www\\0``), so that a
host and all its subdomains are one interval of keys. Splitters drawn from the URLs' keys cut the
key space; a rule goes to each range that its interval meets. In each range rules and URLs are sorted
together and swept once with a stack of the rules whose interval is open: host intervals are nested or
disjoint, so the stack holds the host's own rules and those of its parents, and nothing else.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, shuffle_parts

SAMPLE_PER_RANGE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each ended by NUL; NUL and SOH inside a host are escaped."""
    safe = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.array_join(F.reverse(F.split(safe, "[.]")), "\x00"), F.lit("\x00"))


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the URL's path
    starts with the rule's path. The longest rule (host and path together; then the longer host, then
    the greater text) wins; ``rule`` is null and ``verdict`` is ``default`` where none fits.
    A null URL, or one without ``://``, has an empty host and path and fits no rule; so does a rule with
    an empty host. Repeated rules and pages are kept apart row by row; other columns are not read.
    No pages give no rows; no rules give ``default`` throughout.
    """
    spark = prepare(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    page = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.xxhash64(id_col, url_col).alias("salt"))
    page = page.withColumn("key", host_key(F.col("host")))
    ranges = 2 * shuffle_parts(spark)
    # A bounded sample of (key, salt); the salt cuts a host that holds many of the rows.
    drawn = page.select("key", "salt").orderBy(F.xxhash64("salt", "key")).limit(ranges * SAMPLE_PER_RANGE).collect()
    drawn = sorted((r.key, r.salt) for r in drawn)
    cuts = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key, salt)], dtype="int32")

    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    rule = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host != ''")
    rule = rule.withColumn("key", host_key(F.col("host")))
    rule = rule.withColumn("part", F.explode(F.sequence(range_of("key", low), range_of(F.concat("key", F.lit("\U0010ffff")), high))))
    id_type = page.schema["id"].dataType.simpleString()
    # Ids travel as text: beside the rules' nulls pandas would make numbers floats.
    both = page.select(range_of("key", "salt").alias("part"), "key", F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"), "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        rule.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "host", "path", "verdict")
    )

    def sweep(batches):
        stack: list[tuple[str, list]] = []
        part = None
        for b in batches:
            out = []
            for p, key, kind, id_, host, path, verdict in zip(*(b[c].tolist() for c in ("part", "key", "kind", "id", "host", "path", "verdict"))):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(host) + len(path), len(host), host + path, path, verdict))
                else:
                    best = max((r for _, own in stack for r in own if path.startswith(r[3])), default=(0, 0, None, None, default))
                    out.append((id_, host, path, best[2], best[4]))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"])

    swept = both.repartition(shuffle_parts(spark), "part").sortWithinPartitions("part", "key", "kind")
    swept = swept.mapInPandas(sweep, "id string, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").cast(id_type).alias(id_col), "host", "path", "rule", "verdict")
