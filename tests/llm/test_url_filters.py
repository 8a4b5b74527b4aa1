"""URL filters: parts, rules, model and edge cases."""

import math
from collections import Counter

from askgrid.llm import url_filters

URLS = [
    (1, "https://www.Example.NET/en/1?x=1#y"), (2, "http://a.net/"), (3, "http://a.net"), (4, "http://example.com/de/x"),
    (5, "http://fr.example.org/fr/9"), (6, "http://org/fr/"), (7, "http://xnet/"), (8, None), (9, "nothing"),
    (10, "ftp://h?q/de/"), (11, ""), (12, "http://example.com/en/"), (12, "http://example.com/en/"), (None, "://x/y"),
]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id LONG, url STRING").selectExpr("*", "'x' as host", "'y' as rule", "1 as score")
    return url_filters.judge_urls(df).collect()


def test_parts_and_rules(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in judged(spark, URLS)}
    assert got == {
        1: ("www.example.net", "/en/1", "example.net/en/"), 2: ("a.net", "/", "net/"), 3: ("a.net", "", None),
        4: ("example.com", "/de/x", "example.com/de/"), 5: ("fr.example.org", "/fr/9", "org/fr/"),
        6: ("org", "/fr/", "org/fr/"), 7: ("xnet", "/", None), 8: ("", "", None), 9: ("", "", None),
        10: ("h", "", None), 11: ("", "", None), 12: ("example.com", "/en/", None), None: ("x", "/y", None),
    }
    verdicts = {r["page_id"]: r["verdict"] for r in judged(spark, URLS)}
    assert verdicts[1] == verdicts[5] == "allow" and verdicts[2] == verdicts[4] == "block"
    assert {v for v in verdicts.values()} <= {"allow", "block"}


def test_without_rules_or_rows(spark):
    assert {r["verdict"] for r in judged(spark, [(1, "http://x/y"), (2, None)])} == {"allow"}
    assert judged(spark, []) == []


def test_the_model_tells_unsettled_urls_apart(spark):
    rows = [(i, f"http://good-reads.example.net/en/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://cheap-pills{i % 7}.net/x{i}") for i in range(300)]
    rows += [(5000, "http://good-reads.example.com/en/5"), (5001, "http://cheap-pills9.info/x5")]
    got = {r["page_id"]: r["verdict"] for r in judged(spark, rows)}
    assert got[5000] == "allow" and got[5001] == "block"


def test_scores_against_plain_python(spark):
    folder, a = "/root/testdata/sf0.001", url_filters
    rows = a.op3_url_filters(spark, folder).collect()
    import zlib

    def codes(host, path):
        text = "".join("0" if c in "123456789" else c.lower() if "A" <= c <= "Z" else c for c in host + path)
        return [0, 0] + [a.ALPHABET.find(c) + 1 or len(a.ALPHABET) for c in text]

    learnt = {(r["host"], r["path"], r["verdict"]) for r in rows if r["rule"]}
    learnt = [x for x in learnt if zlib.crc32((x[0] + x[1]).encode()) % 4]
    counts = {"allow": Counter(), "block": Counter()}
    for verdict in counts:
        grams = {(tuple(codes(h, p)), v) for h, p, v in learnt}
        for c, v in grams:
            if v == verdict:
                for i in range(2, len(c)):
                    counts[verdict].update([("n", *c[i - 2 : i + 1]), ("ab", *c[i - 2 : i]), ("bc", *c[i - 1 : i + 1]), ("b", c[i - 1]), ("c", c[i]), "all"])

    def log_p(n, x, y, z):
        p = (n["c", z] + 0.5) / (n["all"] + 0.5 * a.BASE)
        for context, longer in ((("b", y), ("bc", y, z)), (("ab", x, y), ("n", x, y, z))):
            if n[context] >= a.MIN_CONTEXT:
                p = (n[longer] + a.SMOOTHING * p) / (n[context] + a.SMOOTHING)
        return math.log(p)

    for row in rows:
        c = codes(row["host"], row["path"])
        ratios = [log_p(counts["allow"], *c[i - 2 : i + 1]) - log_p(counts["block"], *c[i - 2 : i + 1]) for i in range(2, len(c))]
        assert abs(row["score"] - sum(ratios) / len(ratios)) < 1e-6
