from pyspark.sql import functions as F

from stallwise.llm import url_rules


def test_parts_and_rules(spark):
    urls = {
        "HTTP://Blog.Example.ORG/en/12?x=1": ("blog.example.org", "/en/12", "example.org/en/1"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/"),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/"),
        "a://b://c/d": ("b:", "//c/d", None),
        "https://x.com#/fr/": ("x.com", "", None),
        "https://É.com/de/1": ("É.com", "/de/1", "com/de/"),
        "https://com/fr/\nx": ("com", "/fr/\nx", "com/fr/"),
        "://org/": ("org", "/", "org/"),
        "no scheme.org/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://x.org": ("x.org", "", None),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    found = {r["page_id"]: r for r in url_rules.judge(pages, labelled).collect()}
    for i, (host, path, rule) in enumerate(urls.values()):
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (url_rules.RULES[rule] if rule else "allow")


def labelled(spark):
    rows = [(f"http://s{i % 9}.net/cheap/pills/{i}", i % 10 > 0) for i in range(60)]
    rows += [(f"http://s{i % 9}.net/{'cheap' if i % 2 else 'pills'}/{i}", False) for i in range(120)]
    rows += [(f"http://bad.net/x{i}", True) for i in range(20)] + [("", True), (None, True), ("http://n.net/", None)]
    return spark.createDataFrame(rows, "url string, bad boolean")


def brute(rows, support, confidence):
    """All token sets, by counting subsets."""
    from itertools import chain, combinations

    total = len(rows)
    subsets = {}
    for items, bad in rows:
        for part in map(frozenset, chain.from_iterable(combinations(sorted(items), k) for k in range(1, len(items) + 1))):
            n = subsets.setdefault(part, [0, 0])
            n[0] += 1
            n[1] += bad
    rules = {p: b / n for p, (n, b) in subsets.items() if b >= support * total and b / n >= confidence}
    return {p: c for p, c in rules.items() if not any(q < p and rules[q] >= c for q in rules)}


def test_mined_rules_match_counting(spark):
    table = labelled(spark)
    rows = table.select(url_rules.tokens(F.col("url")).alias("tokens"), "bad")
    got = {frozenset(r["items"]): round(r["confidence"], 9) for r in url_rules.mine(rows, 0.05, 0.7).collect()}
    known = [(r["tokens"], r["bad"]) for r in rows.collect() if r["tokens"] and r["bad"] is not None]
    assert got == {p: round(c, 9) for p, c in brute(known, 0.05, 0.7).items()} and got


def test_verdicts(spark):
    pages = spark.createDataFrame(
        [(1, "http://new.net/cheap/pills/7"), (2, "http://new.net/cheap/7"), (3, "http://bad.net/"), (3, "http://bad.net/"), (None, None), (4, "http://bad.net/" + "a/" * 20_000)],
        "page_id long, url string",
    ).withColumns({"tokens": F.lit(1), "rule": F.lit("x"), "best": F.lit(2), "items": F.lit(3)})
    found = sorted(((r["page_id"], r["verdict"]) for r in url_rules.judge(pages, labelled(spark), support=0.05, confidence=0.7).collect()), key=str)
    assert found == [(1, "block"), (2, "allow"), (3, "block"), (3, "block"), (4, "block"), (None, "allow")]
    assert url_rules.judge(pages.limit(0), labelled(spark)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_rules.report(pages, labels).count() == 6


def test_classes_of_tokens_lose_no_rule(spark):
    """Tokens of exactly the same rows, tokens of bad rows only and tokens of good rows only, in random sets."""
    import random

    for seed in range(6):
        dice = random.Random(seed)
        rows = []
        for _ in range(60):
            own = {t for t in "abcd" if dice.random() < 0.4}
            own |= {"a1", "a2"} if "a" in own else set()  # with a always
            bad = dice.random() < 0.2 + 0.5 * ("b" in own) + 0.2 * ("a" in own)
            own |= {"only bad"} if bad and dice.random() < 0.4 else set()
            own |= {"only good"} if not bad and dice.random() < 0.4 else set()
            rows.append((sorted(own), bad))
        table = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
        found = url_rules.mine(table, 0.05, 0.6).collect()
        got = {frozenset(r["items"]): round(r["confidence"], 9) for r in found}
        want = brute([r for r in rows if r[0]], 0.05, 0.6)
        assert got == {p: round(c, 9) for p, c in want.items()} and len(found) == len(got)


def test_a_long_url_in_a_third_of_the_rows(spark):
    """Two hundred words that stand together are one class, whatever their label."""
    words = "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    rows = [(f"http://long.net/{words}", i % 10 > 3) for i in range(100)]
    rows += [(f"http://n{i % 7}.net/cheap/{i}", i % 5 > 0) for i in range(100)] + [(f"http://n{i % 7}.net/x", False) for i in range(100)]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://other.net/waa"), (2, "http://n1.net/cheap/9"), (3, "http://n1.net/x")], "page_id long, url string")
    found = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_rules.judge(pages, table, support=0.02, confidence=0.55).collect()}
    assert found == {1: ("block", "path=waa"), 2: ("block", "path=cheap"), 3: ("allow", None)}
    singles = url_rules.mine(table.select(url_rules.tokens(F.col("url")).alias("tokens"), "bad"), 0.02, 0.55)
    assert singles.filter(F.size("items") == 1).count() >= 200
