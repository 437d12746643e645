"""URL filtering by association rules (DataFrame operations and Spark's FP-growth only).

A short list of host and path rules decides first. All other urls are judged by rules mined
from labelled pages: FP-growth finds combinations of url tokens that are frequent together with
the label, rules below the confidence are pruned, and so are those that chance explains and those that a shorter rule makes
redundant. Tokens that stand in the same labelled pages (the words of a url that is repeated, say) are one item
of the mining, and a rule names all tokens of its items. Every frequent item of every page takes part. Where a page has more than
``ITEMS`` of them, all whose combinations FP-growth would list, the shortest rules are searched level by level
instead: a page that holds a longer rule holds a shortest one, so the verdicts are those of all rules.
Rules are matched by an inverted index: each is filed under its rarest token, and the rest of it is compared where
that occurs; urls with equal tokens are matched once.

A null url, or one without ``://``, has an empty host and path; it fits no rule of the list
and has no tokens, so it is allowed. Labels that are null count as good; of several labels of
one page the worst counts. Without frequent rules everything else is allowed. Repeated rows get
equal results, and other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import ascii_lower, staged
from feedloom.operators.joins import attach, if_few

#: Host (with its subdomains), path prefix and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A rule holds for this share of the labelled pages and for so many of them at least.
SUPPORT, LEAST = 0.002, 5
#: This share of the pages with the tokens is bad, and so many times the usual share.
CONFIDENCE, LIFT = 0.5, 1.2
#: Its bad pages are so many standard deviations above what the usual share would give: of a thousand
#: combinations that mean nothing, one gets so far.
DEVIATIONS = 3.1
#: Frequent items of a page up to which FP-growth lists every combination of them; beyond, ``shortest`` goes level by level.
ITEMS = 8
_BAD = "=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What the rules are made of: scheme, all labels of the host, all parts of the path, its ending, names and
    values of the query, the words of each of them, and whether there is a query or an anchor.
    The support, and not a place in the url, decides which of them count."""
    none = F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    own = F.when(F.size(labels) > 2, F.slice(labels, 1, F.size(labels) - 2)).otherwise(none)
    parts = F.split(path, "/")
    asked = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "[&;]")
    names = F.transform(asked, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(asked, lambda p: F.when(p.contains("="), F.regexp_extract(p, "=(.*)", 1)).otherwise(F.lit("")))

    def named(prefix: str, value: Column) -> Column:
        # rules are written with spaces between tokens
        return F.when(value != "", F.concat(F.lit(prefix), F.regexp_replace(value, r"\s", "+")))

    def each(prefix: str, of: Column) -> Column:
        return F.transform(of, lambda x: named(prefix, x))

    def words(of: Column) -> Column:
        """The words of names that have several."""
        cut = F.filter(F.transform(of, lambda x: F.split(ascii_lower(x), r"[^\p{L}\p{N}]+")), lambda w: F.size(w) > 1)
        return each("word:", F.flatten(cut))

    found = F.array(
        F.when(host != "", F.when(F.startswith(url, F.lit("https:")), F.lit("scheme:https")).otherwise(F.lit("scheme:other"))),
        named("top:", F.element_at(labels, -1)),
        F.when(F.size(labels) >= 2, named("domain:", F.array_join(F.slice(labels, -2, 2), "."))),
        named("ending:", F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)),
        F.when(F.contains(url, F.lit("?")), F.lit("query")),
        F.when(F.contains(url, F.lit("#")), F.lit("anchor")),
    )
    every = F.concat(
        found,
        each("name:", own),
        words(labels),
        each("part:", parts),
        words(parts),
        each("asks:", names),
        words(names),
        each("value:", values),
        words(values),
    )
    return F.when(host == "", none).otherwise(F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != "word:")))))


def deviations(n: Column, bad: Column, usual: float) -> Column:
    """How far the bad ones of n pages are above the usual share, in standard deviations."""
    return F.round((bad - n * usual) / F.sqrt(n * (usual * (1 - usual))), 9)


def _items(rows: DataFrame, least: float, usual: float) -> DataFrame:
    """``item``, its ``members`` (tokens in the same rows, told by two hashes of these) and how telling it is."""
    seen = rows.select(F.explode("items").alias("token"), "bad", F.xxhash64("row").alias("a"), F.xxhash64("row", F.lit(1)).alias("b"))
    counted = seen.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")
    )
    frequent = counted.filter(F.col("bad") >= least)
    same = frequent.groupBy("n", "bad", "a", "b").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members"))
    return same.select("item", "members", deviations(F.col("n"), F.col("bad"), usual).alias("telling"))


def mined(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (``antecedent``, ``confidence``) from ``items`` (array of text) and ``bad``, and the items they are made
    of (``item``, ``members``, ``telling``).

    What is kept depends on the support, not on the number of pages. Of baskets with more than ``ITEMS`` items the rules are the shortest.
    """
    rows = staged(transactions.select("items", "bad", F.monotonically_increasing_id().alias("row")), "url-transactions")
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad")).first()
    n, bad = counts["n"], counts["bad"] or 0
    none = rows.select(F.col("items").alias("antecedent"), F.lit(0.0).alias("confidence")).limit(0)
    if bad < LEAST or LIFT * bad > n:
        return none, none.select(F.lit("").alias("item"), F.col("antecedent").alias("members"), F.lit(0.0).alias("telling"))
    least, usual = max(LEAST, -(-n * SUPPORT // 1)), bad / n
    items = staged(_items(rows, least, usual), "url-items")
    held = rows.select("row", "bad", F.explode("items").alias("item")).join(if_few(items.select("item")), "item")
    baskets = staged(held.groupBy("row", "bad").agg(F.array_sort(F.collect_list("item")).alias("items")), "url-baskets")
    shape = baskets.agg(F.count("*").alias("n"), F.max(F.size("items")).alias("most")).first()
    size = shape["n"]  # pages without a frequent item have no basket
    if not size:
        return none, items
    if shape["most"] > ITEMS:
        return staged(shortest(baskets, least, usual), "url-rules"), items
    marked = F.when(F.col("bad"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items"))
    # half a page less, so that rounding cannot move the bound
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size, minConfidence=CONFIDENCE).fit(baskets.select(marked.alias("items")))
    rules = model.associationRules.filter(F.col("consequent")[0] == _BAD)
    both = F.round(F.col("support") * size)
    rules = rules.filter(_holds(F.round(both / F.col("confidence")), both, usual))
    return staged(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence"), "url-rules"), items


def _holds(n: Column, bad: Column, usual: float) -> Column:
    """Whether this many bad pages of n make a rule."""
    share = bad / n
    return (share >= CONFIDENCE) & (share >= LIFT * usual) & (deviations(n, bad, usual) >= DEVIATIONS)


def shortest(baskets: DataFrame, least: float, usual: float) -> DataFrame:
    """The rules (``antecedent``, ``confidence``) of ``baskets`` (``row``, ``bad``, sorted ``items``) that no part of them is.

    A level has the combinations of one size that ``least`` bad pages hold. One that is a rule is not lengthened, and neither is one
    that as many pages hold as a part of it, which cannot belong to a shortest rule. A combination is
    lengthened by later items. Good pages that hold it with all of these stay with whatever it is lengthened to, so
    where its bad pages and those alone make no rule, nothing that begins with it does.
    """
    rules, rows = [], baskets.select("row", "bad", "items", F.explode("items").alias("last"))
    later = F.filter("items", lambda x: x > F.col("last"))
    held = staged(rows.select("row", "bad", later.alias("items"), F.array("last").alias("own"), F.lit(None).cast("long").alias("ceiling")), "url-level")
    while True:
        counted = held.groupBy("own").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"), F.min("ceiling").alias("ceiling"))
        level = staged(counted.filter(F.col("bad") >= least).withColumn("rule", _holds(F.col("n"), F.col("bad"), usual)), "url-combinations")
        rules.append(level.filter("rule").select(F.col("own").alias("antecedent"), (F.col("bad") / F.col("n")).alias("confidence")))
        grows = level.filter("NOT rule AND (ceiling IS NULL OR n < ceiling)")
        grows = grows.select("own", "n", "bad", F.expr("slice(own, 1, size(own) - 1)").alias("stem"), F.element_at("own", -1).alias("last"))
        other = grows.select("stem", F.col("last").alias("more"), F.col("n").alias("m"))
        pairs = grows.join(other, "stem").filter(F.col("more") > F.col("last"))
        further = F.collect_list(F.struct("more", F.least("n", "m").alias("ceiling"))).alias("further")
        tails = staged(pairs.groupBy("own", "n", "bad").agg(further).withColumnRenamed("bad", "most"), "url-tails")
        met = held.drop("ceiling").join(if_few(tails.drop("n")), "own")
        stays = ~F.col("bad") & (F.size(F.array_except(F.col("further")["more"], F.col("items"))) == 0)
        bound = met.groupBy("own", "most").agg(F.sum(stays.cast("int")).alias("good"))
        open_ = staged(bound.filter(_holds(F.col("most") + F.col("good"), F.col("most"), usual)).select("own"), "url-open")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, rules)
        longer = met.join(if_few(open_), "own", "left_semi").select("row", "bad", "items", "own", F.explode("further").alias("next"))
        longer = longer.filter(F.array_contains(F.col("items"), F.col("next.more")))
        items = F.filter("items", lambda x: x > F.col("next.more")).alias("items")
        held = staged(longer.select("row", "bad", items, F.concat("own", F.array("next.more")).alias("own"), F.col("next.ceiling").alias("ceiling")), "url-level")


def concise(rules: DataFrame) -> DataFrame:
    """Rules that no rule with one token less, and at least the confidence, makes redundant."""
    ids = rules.withColumn("rule", F.array_join("antecedent", " "))
    shorter = ids.select("rule", "confidence", F.explode("antecedent").alias("left_out"), "antecedent")
    shorter = shorter.withColumn("parent", F.array_join(F.array_remove(F.col("antecedent"), F.col("left_out")), " "))
    parents = ids.select(F.col("rule").alias("parent"), F.col("confidence").alias("known"))
    needless = shorter.join(parents, "parent").filter(F.col("known") >= F.col("confidence")).select("rule").distinct()
    return ids.join(needless, "rule", "left_anti")


def spelled(rules: DataFrame, items: DataFrame) -> DataFrame:
    """``rules`` with all tokens of their items."""
    own = rules.select("rule", "confidence", F.explode("antecedent").alias("item")).join(if_few(items.select("item", "members")), "item")
    return own.groupBy("rule", "confidence").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("antecedent"))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Of distinct token ``sets`` (``key``, ``items``) those that hold all tokens of a rule, with the best ``confidence``."""
    named = rules.select("rule", F.explode("antecedent").alias("token"))
    held = sets.select(F.explode("items").alias("token")).join(if_few(named.select("token").distinct()), "token", "left_semi")
    common = held.groupBy("token").agg(F.count("*").alias("n"))
    rarest = named.join(if_few(common), "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = staged(rules.join(rarest, "rule").select("token", "antecedent", "confidence"), "url-index")
    met = sets.select("key", "items", F.explode("items").alias("token")).join(if_few(index), "token")
    whole = met.filter(F.size(F.array_except("antecedent", "items")) == 0)
    return whole.groupBy("key").agg(F.max("confidence").alias("confidence"))


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``confidence`` (of the best mined rule, else null)."""
    url = F.coalesce(pages["url"], F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, says = listed(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    found, items = mined(rows.select("page_id", "items").join(known, "page_id"))
    rules = staged(spelled(concise(found), items), "url-rules-spelled")
    keyed = rows.withColumn("key", F.array_join("items", " "))
    found = staged(matched(keyed.select("key", "items").distinct(), rules), "url-matches")
    result = attach(keyed, found, "key", ("page_id", "path"), "left")
    verdict = F.coalesce("listed", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return result.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(pages, labels).select("page_id", "host", "path", "rule", "verdict")
