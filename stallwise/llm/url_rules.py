"""URL filters: association rules over URL tokens, mined by FP-growth from labels.

Given rules (host and path prefix) decide first. The others follow mined rules:
token combinations that labelled bad URLs show often enough and mostly. A rule
waits in an inverted index under its rarest token, or the tokens that occur in
the same rows as that one, so a URL only meets rules that it shares it with.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from stallwise.llm.common import saved

#: Given rules: host and path start, and what they say.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
SUPPORT = 0.002
CONFIDENCE = 0.7
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def given_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits the host, or a domain above it, and starts the path; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, rule).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, domains of the host, words of the path and names in the query; numbers are alike."""
    name = host(url)
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    domains = F.transform(
        F.when(F.size(labels) > 0, F.sequence(F.lit(1), F.size(labels))).otherwise(F.array().cast("array<int>")),
        lambda at: F.concat(F.lit("domain="), F.array_join(F.slice(labels, at, F.size(labels)), ".")),
    )
    words = F.filter(F.split(path(url), r"[/._-]+"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    asked = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        domains,
        F.transform(words, lambda w: F.concat(F.lit("path="), F.lower(F.regexp_replace(w, r"\d+", "#")))),
        F.transform(asked, lambda q: F.concat(F.lit("query="), F.regexp_replace(F.split(q, "=")[0], r"\d+", "#"))),
    )
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _classes(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules ``classes, confidence, support`` from rows ``tokens, bad``: one token of each class makes the combination.

    What cannot be part of a rule, or only of one that a part of it already
    says, stays out of the mining, as combinations are exponential in the tokens
    that stand together: tokens of too few bad URLs; tokens of bad URLs only,
    each of which is a rule by itself; all but one of the tokens that occur in
    exactly the same rows, which form a class.
    """
    rows = labelled.filter(F.col("bad").isNotNull() & (F.size("tokens") > 0))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-tokens")
    total = rows.count()
    met = rows.select("row", "bad", F.explode("tokens").alias("token"))
    places = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)")).alias(f"rows{seed}") for seed in (1, 2)]
    counted = met.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *places)
    counted = saved(counted.filter(F.col("bad") >= support * total), "url-counts")
    sure = counted.filter("bad = n").select(
        F.array(F.array("token")).alias("classes"), F.lit(1.0).alias("confidence"), (F.col("bad") / F.lit(float(max(total, 1)))).alias("support")
    )
    classes = counted.filter("bad < n").groupBy("n", "rows1", "rows2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    classes = saved(classes.select(F.col("members")[0].alias("head"), "members"), "url-classes")
    heads = met.select("row", "token").join(classes, F.col("token") == F.col("head"), "left_semi")
    items = heads.groupBy("row").agg(F.collect_set("token").alias("items"))
    marked = rows.join(items, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad")
    marked = marked.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(marked)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD)
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    placed = rules.withColumn("token", F.explode("items")).join(single, "token")
    placed = placed.groupBy("items", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("token"))
    shorter = placed.select("token", F.col("items").alias("part"), F.col("confidence").alias("as_much"))
    implied = placed.withColumn("token", F.explode("items")).join(shorter, "token")
    implied = implied.filter((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("as_much") >= F.col("confidence")))
    kept = placed.join(implied.select("items").distinct(), "items", "left_anti")
    # The rarest class first: its tokens are what the rule waits under.
    kept = kept.select("items", "confidence", "support", F.posexplode(F.concat(F.array("token"), F.array_remove("items", F.col("token")))).alias("at", "head"))
    parts = kept.join(classes, "head").groupBy("items", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("at", "members"))).alias("_parts"))
    parts = parts.select(F.transform("_parts", lambda p: p["members"]).alias("classes"), "confidence", "support")
    return saved(parts.unionAll(sure), "url-rules")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules ``items, confidence, support`` from rows ``tokens, bad``.

    A rule is dropped if a part of its items already says as much. Rows without
    tokens or label teach nothing.
    """
    rules = _classes(labelled, support, confidence)
    none = F.array(F.array().cast("array<string>"))
    longer = lambda made, members: F.flatten(F.transform(made, lambda m: F.transform(members, lambda t: F.array_append(m, t))))
    items = F.explode(F.aggregate("classes", none, longer)).alias("items")
    return rules.select(items, "confidence", "support").withColumn("items", F.array_sort("items"))


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule of each distinct token set that any rule fits: ``tokens, best``.

    ``rules`` are rules over classes; a set meets those that wait under one of its
    tokens. The items of a rule are the last of its tokens in each class.
    """
    waiting = rules.select(F.explode(F.col("classes")[0]).alias("token"), "classes", "confidence", "support")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(waiting, "token")
    met = met.filter(F.forall("classes", lambda members: F.arrays_overlap(members, F.col("tokens"))))
    items = F.array_sort(F.transform("classes", lambda members: F.array_max(F.array_intersect(members, F.col("tokens")))))
    met = met.select("tokens", "confidence", "support", items.alias("items"))
    return met.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "items")).alias("best"))


#: Parts that the pages of one token set are dealt into; each matched set is copied to them.
SALTS = 16


def judge(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] = RULES, **options) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, mined, confidence``.

    ``labelled`` has rows ``url, bad``. ``mined`` holds the tokens of the mined
    rule that blocks a URL without a given one; all else is allowed, so are
    null and empty URLs. URLs of equal tokens are matched once.
    """
    url = F.col("url").cast("string")
    learned = _classes(labelled.select(tokens(url).alias("tokens"), "bad"), options.get("support", SUPPORT), options.get("confidence", CONFIDENCE))
    found = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    found = found.withColumn("rule", given_rule(F.col("host"), F.col("path"), rules))
    best = matches(found.filter("rule IS NULL").select("tokens").distinct(), learned)
    best = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Numbers are alike in tokens, so all pages of a section have one set.
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
    joined = salted.join(best, ["tokens", "_salt"], "left")
    mined = F.when(F.col("rule").isNull(), F.col("best"))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce(said, F.when(mined.isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join(mined["items"], " ").alias("mined"), mined["confidence"].alias("confidence"),
    )


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered form. A page shows the document that its path names by number, and so has its label."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    shown = F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)")
    labelled = pages.select("url", shown.alias("doc_id")).join(marks, "doc_id").select("url", "bad")
    return judge(pages, labelled)
