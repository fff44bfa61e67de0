"""URL filters: rules by host and path, and logistic regression on hashed character n-grams.

Everything about the judged rows is DataFrame functions. The small labelled
table is hashed by the same expressions; its bounded feature rows are fitted
on the driver in plain Python.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BUCKETS, SIZES = 4096, (3, 4)
#: Most rows of a labelled table, passes over it, step and penalty of the fit.
MOST_ROWS, PASSES, RATE, PENALTY = 5000, 200, 4.0, 1e-4


def labelled() -> list[tuple[str, int]]:
    """Invented URLs with 1 for those to block, from word lists and patterns."""
    bad = ["casino", "spam-farm", "free-pills", "xxx-cams", "poker-bonus", "cheap-meds", "click-here", "get-rich", "warez", "adult-chat", "lottery-win", "seo-links", "replica-watches", "payday-loan", "bet-now"]
    good = ["library", "museum", "university", "news", "weather", "recipes", "garden", "history", "science", "school", "travel", "music", "the-archive", "cityhall", "books"]
    bad_paths = ["/win/free-bonus", "/buy/cheap?id=9", "/click.php?aff=77", "/xxx/video", "/promo/casino/spin", "/download/crack.exe"]
    good_paths = ["/en/12", "/de/article/7", "/fr/2040.html", "/es/33?page=2", "/about", "/blog/2021/05/a-walk", "/en/981#top", "/docs/index.html"]
    out = []
    for i, (b, g) in enumerate(zip(bad, good)):
        for j, zone in enumerate(("example.com", "example.net", "example.org")):
            out.append((f"http://{b}.{zone}{bad_paths[(i + j) % len(bad_paths)]}", 1))
            out.append((f"https://www.{b}.{zone}{good_paths[(i + j) % len(good_paths)]}", 1))
            out.append((f"https://{g}.{zone}{good_paths[(i + j) % len(good_paths)]}", 0))
            out.append((f"http://www.{g}.{zone}{good_paths[(i + j + 3) % len(good_paths)]}", 0))
        out.append((f"https://{g}.example.net{bad_paths[i % len(bad_paths)]}", 1))
        out.append((f"https://blog.th{g[:4]}on.example.com{good_paths[i % len(good_paths)]}", 0))
    return out


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without any. A rule fits its host, all subdomains and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, field: str, buckets: int = BUCKETS) -> Column:
    """Hashed n-grams of a text between marks, the field's name hashed with them."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*(_of_size(marked, field, n, buckets) for n in SIZES))


def _of_size(marked: Column, field: str, n: int, buckets: int) -> Column:
    last = F.length(marked) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(field), F.substr(marked, i, F.lit(n))), F.lit(buckets)).cast("int"))


def fit(rows: list[tuple[list[int], int]], buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights and bias of logistic regression on the mean of the grams' weights, by full gradient steps."""
    weights, bias = [0.0] * buckets, 0.0
    if not rows:
        return weights, -30.0
    for _ in range(PASSES):
        gradient: dict[int, float] = {}
        shift = 0.0
        for features, label in rows:
            scale = 1.0 / math.sqrt(max(1, len(features)))
            z = bias + scale * sum(weights[i] for i in features)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            shift += error
            for i in features:
                gradient[i] = gradient.get(i, 0.0) + error * scale
        for i, g in gradient.items():
            weights[i] -= RATE * (g / len(rows) + PENALTY * weights[i])
        bias -= RATE * 0.1 * shift / len(rows)
    return weights, bias


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled_urls: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    The verdict is the longest fitting rule's, else block where the model's
    probability reaches the threshold. Null urls and such without :// have
    empty host and path, which the model judges like any other. Rows are
    independent; other columns are not read. Of a labelled table at most
    MOST_ROWS rows are used; of an empty one nothing is learnt, and only rules
    block.
    """
    spark = pages.sparkSession
    table = (labelled_urls if labelled_urls is not None else labelled())[:MOST_ROWS]
    given = F.lit(json.dumps([{"url": u, "label": y} for u, y in table]))
    seeds = spark.range(1).select(F.explode(F.from_json(given, "array<struct<url string, label int>>")).alias("r")).select("r.*")
    features = lambda host, path: F.concat(grams(host, "h"), grams(path, "p"))
    known = seeds.select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), "label")
    weights, bias = fit([(r.f, r.label) for r in known.collect()])
    held = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    f = features(F.col("host"), F.col("path"))
    z = F.aggregate(f, F.lit(0.0), lambda s, i: s + F.get(held, i)) / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double")) + F.lit(bias)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"score": 1 / (1 + F.exp(-z)), "rule": rule, "told": verdict})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
