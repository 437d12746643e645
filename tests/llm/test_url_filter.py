import itertools
import random

from feedloom.llm import url_filter

LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string, rule int"


def test_hosts_paths_and_listed_rules(spark):
    urls = {
        "http://A.Example.NET/en/1?q=/x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "https://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
        "https://x.example.com/de/x#a": ("x.example.com", "/de/x", "example.com/de/", "block"),
        "https://example.net": ("example.net", "", None, "allow"),
        "ftp://a.org/fr/?y": ("a.org", "/fr/", "org/fr/", "allow"),
        "no scheme/net/": ("", "", None, "allow"),
        "://net/": ("net", "/", "net/", "block"),
        "http://h.net?x://y/": ("h.net", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)] + [(None, None, None, None)], PAGES)
    rows = url_filter.report(pages, spark.createDataFrame([], LABELS)).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert found == dict(enumerate(urls.values())) | {None: ("", "", None, "allow")}


def test_rules_are_those_of_all_combinations(spark):
    rng = random.Random(2)
    names = "abcdef"
    baskets = [(sorted(rng.sample(names, rng.randint(1, 5))), rng.random() < 0.3) for _ in range(300)]
    baskets = [(b, bad or {"a", "b"} <= set(b)) for b, bad in baskets]
    found, items = url_filter.mined(spark.createDataFrame(baskets, "items array<string>, bad boolean"))
    assert {r["item"]: r.members for r in items.collect()} == {n: [n] for n in names}
    usual = sum(bad for _, bad in baskets) / len(baskets)
    want = {}
    for size in range(1, 7):
        for combination in itertools.combinations(names, size):
            held = [bad for b, bad in baskets if set(combination) <= set(b)]
            share = sum(held) / len(held) if held else 0
            spread = (len(held) * usual * (1 - usual)) ** 0.5
            if sum(held) >= url_filter.LEAST and sum(held) - len(held) * usual >= url_filter.DEVIATIONS * spread and share >= url_filter.CONFIDENCE and share >= url_filter.LIFT * usual:
                want[combination] = round(share, 9)
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in found.collect()} == want
    left = {tuple(r.antecedent) for r in url_filter.concise(found).collect()}
    assert left == {c for c in want if not any(want.get(tuple(x for x in c if x != out), 0) >= want[c] for out in c)}


def test_mined_rules_block(spark):
    pages = [(i, f"https://{'bad-shop' if i % 4 == 0 else 'good' + str(i % 7)}.example.com/{'en' if i % 3 else 'fr'}/{i}", None, 0) for i in range(200)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(150)] + [(0, None, None), (None, 0, 1)]
    pages = spark.createDataFrame(pages + pages[:3], PAGES)
    rows = url_filter.judged(pages, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == 203
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in rows)


def test_empty_tables(spark):
    labels = spark.createDataFrame([(1, 0, 1)], LABELS)
    assert url_filter.report(spark.createDataFrame([], PAGES), labels).count() == 0
    assert url_filter.report(spark.createDataFrame([(1, "http://a.com/x", "", 0)], PAGES), labels).first().verdict == "allow"


def test_rules_from_any_place_of_a_url(spark):
    bad = ["/en/2024/casino-bonus", "/en/2024/a?id=bet365", "/a/porn/x", "/en/7/big-win-casino?x=1", "/en/x?u=1&q=cheap-pills#a"]
    good = ["/en/2024/city-news", "/en/2024/a?id=42", "/a/art/x", "/en/7/big-win-team?x=1", "/en/x?u=1&q=cheap-flights#a"]
    hosts = ("https://a.b.spam-farm.www.example.com/en/x", "https://a.b.book-farm.www.example.com/en/x")
    urls = [f"https://www.example.com{p}" for p in bad] + [hosts[0]] + [f"https://www.example.com{p}" for p in good] + [hosts[1]]
    pages = spark.createDataFrame([(i, urls[i % 12], None, 0) for i in range(240)], PAGES)
    labels = spark.createDataFrame([(i, int(i % 12 >= 6), 0) for i in range(120)], LABELS)
    found = url_filter.judged(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 12 < 6) for r in found)


def test_long_urls_that_are_repeated(spark):
    """Words of a repeated url stand elsewhere too, so that all their combinations are frequent and differ."""
    rng = random.Random(3)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwx"]
    urls = [f"https://spam.example.com/{'-'.join(words)}"] * 50
    urls += [f"https://news.example.com/{'-'.join(rng.sample(words, 6))}" for _ in range(250)]
    pages = spark.createDataFrame([(i, u, None, 0) for i, u in enumerate(urls)], PAGES)
    labels = spark.createDataFrame([(i, int(i >= 50), 0) for i in range(300)], LABELS)
    found = url_filter.judged(pages, labels).collect()
    assert all(r.verdict == "block" for r in found if r.page_id < 50)
    assert all(r.verdict == "allow" or r.confidence >= url_filter.CONFIDENCE for r in found)


def test_tokens_that_stand_in_the_same_pages_are_one_item(spark):
    rows = [(["a", "b", "c", "x"], True)] * 30 + [(["x"], False)] * 100 + [(["d", "x"], i % 5 == 0) for i in range(50)]
    found, items = url_filter.mined(spark.createDataFrame(rows, "items array<string>, bad boolean"))
    assert {r["item"]: r.members for r in items.collect()} == {"a": ["a", "b", "c"], "d": ["d"], "x": ["x"]}
    rules = url_filter.spelled(url_filter.concise(found), items).collect()
    assert [r.antecedent for r in rules] == [["a", "b", "c"]]
    sets = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["a", "b", "x"]), ("3", ["x"]), ("4", [])], "key string, items array<string>")
    met = url_filter.matched(sets, url_filter.spelled(url_filter.concise(found), items))
    assert [(r.key, r.confidence) for r in met.collect()] == [("1", 1.0)]


def test_chance_makes_no_rules(spark):
    rng = random.Random(4)
    pages = [(i, f"https://{rng.choice('abcdefgh')}{rng.choice('xyz')}.example.com/{rng.choice('pqr')}/{rng.choice('stuv')}-{rng.choice('wxyz')}", None, 0) for i in range(1500)]
    labels = [(i, int(rng.random() > 0.4), 0) for i in range(1000)]
    found = url_filter.judged(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS))
    assert found.filter("verdict = 'block'").count() < 0.03 * 1500


def test_all_bad_and_clashing_columns(spark):
    more = PAGES + ", verdict string, items string, key int, token string"
    pages = spark.createDataFrame([(i, f"https://a.com/x{i % 3}", None, 0, "v", "i", 1, "t") for i in range(60)], more)
    labels = spark.createDataFrame([(i, 0, 1) for i in range(60)], LABELS)
    rows = url_filter.report(pages, labels).collect()
    assert len(rows) == 60 and {r.verdict for r in rows} == {"allow"}  # nothing tells them from others


def test_items_beyond_a_pages_most_telling_ones_make_rules(spark):
    """x and y are bad together only, and stand in bad pages beside many items that tell more."""
    rng = random.Random(5)
    telling = [f"t{i:02}" for i in range(12)]
    rows = [([*rng.sample(telling, 10), "x", "y"], True) for _ in range(60)]
    rows += [(["x"], False)] * 100 + [(["y"], False)] * 100 + [([t], False) for t in telling for _ in range(2)]
    found, items = url_filter.mined(spark.createDataFrame([(sorted(r), bad) for r, bad in rows], "items array<string>, bad boolean"))
    rules = url_filter.spelled(url_filter.concise(found), items)
    assert ["x", "y"] in [r.antecedent for r in rules.collect()]
    sets = spark.createDataFrame([("1", ["x", "y"]), ("2", ["x"]), ("3", ["y"])], "key string, items array<string>")
    assert [r.key for r in url_filter.matched(sets, rules).collect()] == ["1"]


def test_shortest_rules_are_those_of_all_combinations(spark):
    rng = random.Random(6)
    names = "abcdefghijk"
    baskets = [(sorted(rng.sample(names, rng.randint(1, 11))), rng.random() < 0.25) for _ in range(300)]
    baskets = [(b, bad or {"a", "b", "c"} <= set(b) and "k" not in b or {"d", "k"} <= set(b) and rng.random() < 0.5) for b, bad in baskets]
    found, _ = url_filter.mined(spark.createDataFrame(baskets, "items array<string>, bad boolean"))
    usual, rules = sum(bad for _, bad in baskets) / len(baskets), {}
    for size in range(1, 12):
        for combination in itertools.combinations(names, size):
            held = [bad for b, bad in baskets if set(combination) <= set(b)]
            share, spread = sum(held) / max(1, len(held)), (len(held) * usual * (1 - usual)) ** 0.5
            if sum(held) >= url_filter.LEAST and sum(held) - len(held) * usual >= url_filter.DEVIATIONS * spread and share >= max(url_filter.CONFIDENCE, url_filter.LIFT * usual):
                rules[combination] = round(share, 9)
    want = {c: share for c, share in rules.items() if not any(set(r) < set(c) for r in rules)}
    assert len(want) > 3 and max(map(len, want)) > 2
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in found.collect()} == want


def test_a_long_url_of_good_and_bad_pages_is_searched_in_few_steps(spark):
    rng = random.Random(7)
    words = [f"w{i:02}" for i in range(24)]
    rows = [(words, i < 50) for i in range(150)] + [(sorted(rng.sample(words, 6)), False) for _ in range(250)] + [(["q"], True)] * 40
    found, _ = url_filter.mined(spark.createDataFrame(rows, "items array<string>, bad boolean"))
    assert [tuple(r.antecedent) for r in found.collect()] == [("q",)]
