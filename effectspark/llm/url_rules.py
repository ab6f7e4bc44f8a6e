"""URL filter by association rules, in DataFrame functions and Spark's FP-growth only.

A short list of given rules decides the URLs it fits. Those are the labelled rows from
which further rules are mined for all other URLs:

1. A URL is a set of tokens: its host labels, the first and the last part of its path
   with digits made alike, and the names in its query.
2. FP-growth finds every combination of tokens, with and without a verdict, that at
   least SUPPORT of the labelled URLs hold. A combination whose verdict is CONFIDENCE
   certain is a rule; it is pruned if leaving out one token does not lower the certainty.
3. Each rule stands in an inverted index under its rarest token. The distinct token sets
   of the undecided URLs look their tokens up, and a rule matches if the set holds all
   of its tokens. The most certain one decides; URLs with the same set share the answer.

URLs with one token set meet as a count only, however many they are. A token is mined
only if a share of SUPPORT of the labelled URLs hold it, which bounds the rules by the
parameters and not by the input; their table is broadcast only if its measured size allows it.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.operators.lookup import attach
from effectspark.sources.store import Stored, Workspace

SUPPORT = 10  # least number of labelled URLs in a thousand that hold a mined combination
LEAST_ROWS = 5  # and the least number of them
CONFIDENCE = 80  # percent of a combination's URLs that have the verdict of its rule
ALLOW, BLOCK = "allow", "block"
_MARK = "="  # begins the item that stands for a verdict; no token begins with it
_FOLD = (string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Rule:
    """Decides the URLs of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    ws: Workspace,
    support: int = SUPPORT,
    confidence: int = CONFIDENCE,
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row per input row.

    ``rule`` is the longest given rule that fits, else NULL; without one the mined rules
    decide, and where none matches, the more frequent verdict among the URLs that given
    rules decide (``allow`` if equal or if there are none). A URL that is NULL or has no
    ``://`` has an empty host and path and no token. Rows that repeat stay repeated, other
    columns are ignored, and an empty table gives no rows.
    """
    read = with_address(pages.select("page_id", F.col(url).alias("__url")), F.col("__url"))
    given = read.withColumn("__given", fitting(rules, F.col("host"), F.col("path")))
    tokens = url_tokens(F.col("__url"), F.col("host"), F.col("path"))
    rows = given.withColumn("__tokens", tokens).select(
        "page_id", "host", "path",
        F.col("__given.rule").alias("rule"), F.col("__given.verdict").alias("given"),
        "__tokens", F.array_join("__tokens", "\n").alias("tokens"),
    )
    open_rows = rows.filter("rule IS NULL")
    labelled = rows.filter("rule IS NOT NULL").select(F.col("__tokens").alias("tokens"), F.col("given").alias("verdict"))
    usual, mined = mine_rules(labelled, ws, support, confidence)
    sets = open_rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    answers = ws.save(match_rules(sets, mined, ws), "url-answers") if mined else None
    if answers is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(usual)).alias("verdict"))
    # decided URLs look nothing up: their key is the empty set
    keyed = rows.withColumn("tokens", F.when(F.col("rule").isNull(), F.col("tokens")).otherwise(F.lit("")))
    found = attach(keyed.drop("__tokens"), answers, ["tokens"], ["verdict"], ws.broadcast_bytes)
    verdict = F.coalesce("given", "verdict", F.lit(usual))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def with_address(rows: DataFrame, url: Column) -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return rows.withColumns({"host": F.translate(host, *_FOLD), "path": path})


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(length, rule, verdict) of the longest rule that fits, NULL without one."""
    if not rules:
        return F.lit(None).cast("struct<length int, rule string, verdict string>")
    one = lambda r: F.struct(
        F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"),
        F.lit(r.host).alias("host"), F.lit(r.path).alias("path"),
    )
    fits = F.filter(
        F.array(*[one(r) for r in rules]),
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    longest = F.array_max(fits)
    return F.when(longest.isNotNull(), F.struct(longest["length"].alias("length"), longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL in order, none with a line end."""
    filled = lambda x: x != ""
    labels = F.filter(F.split(host, "[.\r\n]"), filled)
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "[/\r\n]"), filled)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*[?]([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "[&\r\n]"), lambda x: F.substring_index(x, "=", 1)), filled)
    named = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(kind), x))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                named("host:", labels),
                named("first:", F.slice(parts, 1, 1)),
                named("last:", F.when(F.size(parts) > 1, F.slice(parts, -1, 1)).otherwise(F.array().cast("array<string>"))),
                named("query:", names),
            )
        )
    )


def mine_rules(labelled: DataFrame, ws: Workspace, support: int, confidence: int) -> tuple[str, Stored | None]:
    """The usual verdict, and (tokens, size, verdict, rows, hits) of the rules of ``labelled`` (tokens, verdict)."""
    stored = ws.save(labelled, "url-labelled").df
    counts = dict(stored.groupBy("verdict").count().collect())  # two rows
    usual = BLOCK if counts.get(BLOCK, 0) > counts.get(ALLOW, 0) else ALLOW
    total = sum(counts.values())
    if not total:
        return usual, None
    least = max(LEAST_ROWS, -(-support * total // 1000))
    items = stored.select(F.concat("tokens", F.array(F.concat(F.lit(_MARK), "verdict"))).alias("items"))
    if least > total:
        return usual, None
    # half a row less: the library multiplies the share by the number of rows and rounds up
    miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total)
    frequent = ws.save(_split_sets(miner.fit(items).freqItemsets), "url-token-sets")
    # the empty set has the usual certainty of each verdict
    of = lambda v, n: F.struct(
        F.lit("").alias("tokens"), F.lit(v).alias("verdict"), F.lit(total).cast("bigint").alias("rows"),
        F.lit(n).cast("bigint").alias("hits"),
    )
    empty = ws.spark.range(1).select(F.inline(F.array(*[of(v, n) for v, n in sorted(counts.items())])))
    bare = frequent.df.filter("verdict IS NULL").select("tokens", F.col("freq").alias("rows"))
    certain = (
        frequent.df.filter("verdict IS NOT NULL AND tokens != ''")
        .join(bare, "tokens")
        .select("tokens", "verdict", "rows", F.col("freq").alias("hits"))
    )
    return usual, ws.save(_prune(certain.unionByName(empty), confidence), "url-rules")


def _split_sets(frequent: DataFrame) -> DataFrame:
    """(tokens, verdict, freq): frequent sets with their verdict, if they hold one, on its own."""
    verdicts = F.filter("items", lambda x: F.startswith(x, F.lit(_MARK)))
    tokens = F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit(_MARK))))
    # a set with two verdicts does not occur: a URL has one
    return frequent.select(
        F.array_join(tokens, "\n").alias("tokens"),
        F.substring(F.get(verdicts, F.lit(0)), 2, 1 << 30).alias("verdict"),
        "freq",
    )


def _prune(sets: DataFrame, confidence: int) -> DataFrame:
    """Sets that are certain enough, and more certain than all sets with one token less."""
    listed = sets.withColumn("list", F.filter(F.split("tokens", "\n"), lambda x: x != ""))
    shorter = listed.filter("tokens != ''").select(
        "tokens", "verdict", F.explode("list").alias("without"), "list"
    ).select("tokens", "verdict", F.array_join(F.array_remove("list", F.col("without")), "\n").alias("part"))
    share = F.col("hits") / F.col("rows")
    parts = sets.select(F.col("tokens").alias("part"), "verdict", share.alias("share"))
    best = shorter.join(parts, ["part", "verdict"]).groupBy("tokens", "verdict").agg(F.max("share").alias("part_share"))
    return (
        listed.join(best, ["tokens", "verdict"])
        .filter((F.col("hits") * 100 >= F.col("rows") * confidence) & (share > F.col("part_share")))
        .select("tokens", F.size("list").alias("size"), "verdict", "rows", "hits")
    )


def rule_index(rules: DataFrame) -> DataFrame:
    """(token, needs, rank): each rule under the token that the fewest rules hold, the first of equal ones."""
    listed = rules.withColumn("needs", F.split("tokens", "\n"))
    held = listed.select("*", F.explode("needs").alias("token"))
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rarest = held.join(often, "token").groupBy("tokens", "verdict").agg(
        F.min(F.struct("uses", "token")).getField("token").alias("token")
    )
    # least for the rule that decides: the most certain, then the best supported, then the shortest
    rank = F.struct(
        (-F.col("hits") / F.col("rows")).alias("a"), (-F.col("hits")).alias("b"), F.col("size").alias("c"),
        F.col("tokens").alias("d"), F.col("verdict").alias("verdict"),
    )
    return listed.join(rarest, ["tokens", "verdict"]).select("token", "needs", rank.alias("rank"))


def match_rules(sets: DataFrame, rules: Stored, ws: Workspace) -> DataFrame:
    """(tokens, n, verdict) of the token sets that some rule matches."""
    index = rule_index(rules.df)
    index = F.broadcast(index) if rules.bytes * 2 <= ws.broadcast_bytes else index
    listed = sets.withColumn("__held", F.split("tokens", "\n"))
    looked = listed.withColumn("token", F.explode("__held")).join(index, "token")
    matched = looked.filter(F.size(F.array_except("needs", "__held")) == 0)
    best = matched.groupBy("tokens", "n").agg(F.min("rank").alias("rank"))
    return best.select("tokens", "n", F.col("rank.verdict").alias("verdict"))
