"""URL filters: rules first, then the ratio of two character language models.

URLs that a rule settles are the training rows: those allowed make one model, those blocked the
other. Each is a smoothed character model of variable order: the probability of a character after
its two predecessors is mixed with that after one and after none, in proportion to how often the
context was seen, and a context seen too seldom is not kept at all. A URL's score is the mean over
its characters of the log ratio of both models, so length does not matter. The threshold is
calibrated on a held-out part of the settled URLs.

Characters are folded into a fixed alphabet, so the model has at most (len(ALPHABET) + 1) ** 3
entries whatever the input's size. It goes to the rows as one array from a scalar subquery; scoring
needs no join, no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.session import materialise

#: (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Letters, "0" for any digit, punctuation, "~" for anything else.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_:@%+,;~"
BASE = len(ALPHABET) + 1
SMOOTHING = 8.0
MIN_CONTEXT = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BIN, _BINS = 0.005, 2000


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: int) -> Column:
    """Name (what=1) or verdict (what=0) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        F.when(
            ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2]),
            F.lit(rule[1] + rule[2] if what else rule[0]),
        )
        for rule in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _grams(text: Column) -> Column:
    """Codes of each character with its two predecessors; 0 stands before the start."""
    folded = F.translate(text, _UPPER + "123456789", _LOWER + "0" * 9)
    codes = F.transform(
        F.filter(F.split(folded, ""), lambda c: c != ""),
        lambda c: F.coalesce(
            F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(len(ALPHABET))
        ),
    )
    padded = F.concat(F.array(F.lit(0), F.lit(0)), codes)
    return F.transform(
        codes,
        lambda c, i: F.get(padded, i) * F.lit(BASE * BASE) + F.get(padded, i + 1) * F.lit(BASE) + c,
    )


def _counts(training: DataFrame) -> DataFrame:
    """How often each gram occurs in accepted and in rejected URLs: at most BASE ** 3 rows."""
    grams = training.select("accepted", F.explode("grams").alias("gram"))
    return grams.groupBy("gram").agg(
        F.count(F.when(F.col("accepted"), 1)).alias("n_a"),
        F.count(F.when(~F.col("accepted"), 1)).alias("n_r"),
    )


def _ratios(counts: DataFrame, totals: dict[str, int], smoothing: float, min_context: int) -> DataFrame:
    """Log ratio of both models for every possible gram."""
    spark = counts.sparkSession
    every = spark.range(0, BASE**3, numPartitions=1).select(
        F.col("id").cast("int").alias("gram"),
        (F.col("id") % BASE).cast("int").alias("c"),
        (F.floor(F.col("id") / BASE) % BASE).cast("int").alias("b"),
        F.floor(F.col("id") / (BASE * BASE)).cast("int").alias("a"),
    )
    every = every.join(F.broadcast(counts), "gram", "left").fillna(0, ["n_a", "n_r"])
    for name, keys in (("ab", ["a", "b"]), ("bc", ["b", "c"]), ("b", ["b"]), ("c", ["c"])):
        sums = every.groupBy(*keys).agg(*[F.sum(f"n_{m}").alias(f"{name}_{m}") for m in "ar"])
        every = every.join(F.broadcast(sums), keys)
    logs = {}
    for m in "ar":
        def kept(context: str, longer: str, shorter: Column, m: str = m) -> Column:
            seen = F.col(f"{context}_{m}")
            mixed = (F.col(longer) + F.lit(smoothing) * shorter) / (seen + F.lit(smoothing))
            return F.when(seen >= min_context, mixed).otherwise(shorter)

        none = (F.col(f"c_{m}") + 0.5) / F.lit(totals[m] + 0.5 * BASE)
        one = kept("b", f"bc_{m}", none)
        logs[m] = F.log(kept("ab", f"n_{m}", one))
    return every.select("gram", (logs["a"] - logs["r"]).alias("ratio"))


def _score(grams: Column, ratios: Column) -> Column:
    """Mean log ratio over the characters; 0 for no characters."""
    total = F.aggregate(grams, F.lit(0.0), lambda sum_, g: sum_ + F.get(ratios, g))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)


def _threshold(scored: DataFrame) -> float:
    """The cut that tells accepted and rejected URLs apart best (balanced accuracy)."""
    binned = scored.groupBy(
        F.greatest(F.least(F.floor(F.col("score") / _BIN), F.lit(_BINS)), F.lit(-_BINS)).alias("bin")
    ).agg(F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r"))
    rows = sorted(tuple(r) for r in binned.collect())  # at most 2 * _BINS + 1
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, cut, above, below = -1.0, 0.0, accepted, 0
    for bin_, a, r in rows:
        right = above / accepted + below / rejected
        if right > best + 1e-12 or (right > best - 1e-12 and abs(bin_ * _BIN) < abs(cut)):
            best, cut = right, bin_ * _BIN
        above, below = above - a, below + r
    return cut


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    smoothing: float = SMOOTHING,
    min_context: int = MIN_CONTEXT,
) -> DataFrame:
    """Verdict on each row of `pages` (page_id, url): page_id, host, path, rule, verdict, score.

    `rules` is a short list of (verdict, host, path prefix); a rule fits its host and all
    subdomains, the longest wins. URLs without a rule are allowed if their score reaches the
    threshold. Repeated rows are judged alike; the models learn from distinct URLs. A null URL, or
    one without `://`, has empty host and path and scores 0. Without training rows of both kinds,
    all scores and the threshold are 0, so such URLs are allowed. Empty table: empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select(
        "page_id",
        "url",
        "host",
        "path",
        rule_for(F.col("host"), F.col("path"), rules, 1).alias("rule"),
        rule_for(F.col("host"), F.col("path"), rules, 0).alias("settled"),
        _grams(F.concat("host", "path")).alias("grams"),
    )
    settled = judged.where(F.col("settled").isNotNull()).select(
        (F.col("settled") == "allow").alias("accepted"),
        "grams",
        (F.crc32(F.concat("host", "path").cast("binary")) % 4 == 0).alias("held"),
    )
    settled = settled.distinct()
    counts = materialise(_counts(settled.where(~F.col("held"))), "gram_counts")
    kinds = counts.agg(F.sum("n_a").alias("a"), F.sum("n_r").alias("r")).first()
    if kinds["a"] and kinds["r"]:
        ratios = materialise(_ratios(counts, kinds.asDict(), smoothing, min_context), "ratios")
        array = ratios.select(F.sort_array(F.collect_list(F.struct("gram", "ratio")))["ratio"].alias("all"))
        score = _score(F.col("grams"), F.col("_ratios"))
        held = settled.where("held").withColumn("_ratios", array.scalar()).withColumn("score", score)
        threshold = _threshold(held)
        scored = judged.withColumn("_ratios", array.scalar()).withColumn("score", score)
    else:
        threshold, scored = 0.0, judged.withColumn("score", F.lit(0.0))
    by_score = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("settled", by_score).alias("verdict"), "score"
    )


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
