"""URL filters [native]: rules by host suffix and path prefix, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
PRIOR = 0.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(rest, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], of: str) -> Column:
    """The name or verdict of the longest rule that fits, else null. Rules are a short list, tried longest first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, of))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Bucket numbers of the character n-grams of host and path, each with its own hash seed and end marks; all digits count as 0."""

    def of(part: str, text: Column) -> list[Column]:
        text = F.translate(F.concat(F.lit("^"), text, F.lit("$")), "123456789", "000000000")
        return [
            F.when(
                F.length(text) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.length(text) - (n - 1)),
                    lambda i, n=n: F.pmod(F.xxhash64(F.lit(part), F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"),
                ),
            ).otherwise(F.array().cast("array<int>"))
            for n in GRAMS
        ]

    return F.concat(*of("host", host), *of("path", path))


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: 1 for hosts or paths of unwanted kinds, 0 for ordinary ones.

    Every word of a kind meets the same frames, so that only the words tell;
    made-up names among the ordinary ones teach that an unknown host is allowed.
    """
    unwanted = ["adult", "adult-x", "casino", "poker", "betting", "xxx", "porn", "sex-cams", "escort", "pills", "viagra", "warez", "torrent", "keygen", "free-prizes", "lottery", "hack-tool", "phish", "malware", "spam", "casino-bonus", "poker-bets", "cheap-viagra", "free-slots", "pills-shop"]
    ordinary = ["news", "docs", "wiki", "blog", "library", "museum", "school", "weather", "recipes", "garden", "travel", "history", "science", "health", "music", "forum", "store", "city", "sports", "theater", "city-news", "public-library", "health-science", "travel-blog", "open-docs"]
    out = []
    for label, words in ((1, unwanted), (0, ordinary)):
        for i, w in enumerate(words):
            for j, end in enumerate(("com", "net", "org", "example.com", "example.net")):
                sub = ("", "www.", "m.", "blog.", "")[(i + j) % 5]
                lang = ("en", "de", "fr", "es")[(i + j) % 4]
                tail = ("", ".html", "/", "?page=2&ref=x", "#top")[(2 * i + j) % 5]
                out.append((f"https://{sub}{w}.{end}/{lang}/{(7919 * (i + 3) * (j + 1)) % 250000}{tail}", label))
            out.append((f"http://site{i}.example.net/{w}/{(104729 * (i + 1)) % 9999}", label))
    syllables = ["lo", "ma", "ri", "ten", "sor", "vel", "dun", "kar", "the", "an", "ing", "er", "st", "ou", "ble", "mi"]
    for i in range(240):
        name = "".join(syllables[(i * k + i // 16 + k) % 16] for k in (1, 3, 5)[: 2 + i % 2])
        end, lang = ("com", "net", "org", "example.com", "example.net", "example.org")[i % 6], ("en", "de", "fr", "es")[i // 6 % 4]
        out.append((f"http{'s' * (i % 2)}://{('', 'www.', 'm.', 'blog.')[i // 3 % 4]}{name}.{end}/{lang}/{(7919 * (i + 3)) % 250000}{('', '.html', '/', '?page=2&ref=x', '#top')[i % 5]}", 0))
    return out


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None, rounds: int = 300, rate: float = 12.0, decay: float = 1e-4) -> tuple[float, list[float]]:
    """Bias and bucket weights by gradient descent on the labelled table.

    The table is small by its nature (a few hundred urls), so its hashed
    n-grams come to the driver; the corpus is not looked at.
    """
    labelled = labelled_urls() if labelled is None else labelled
    df = spark.createDataFrame(labelled, "url string, label int")
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = [(r["label"], r["g"]) for r in df.select("label", grams(F.col("host"), F.col("path")).alias("g")).collect()]
    share = sum(label for label, _ in rows) / len(rows)
    # As if the labelled table had this share of unwanted urls, however many it has.
    weigh = {1: PRIOR / max(share, 1e-9), 0: (1 - PRIOR) / max(1 - share, 1e-9)}
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        step, bias_step = {}, 0.0
        for label, g in rows:
            scale = 1 / math.sqrt(max(1, len(g)))
            off = weigh[label] * (label - 1 / (1 + math.exp(-(bias + scale * sum(weights[b] for b in g)))))
            bias_step += off
            for b in g:
                step[b] = step.get(b, 0.0) + off * scale
        bias += rate * bias_step / len(rows)
        weights = [w * (1 - decay) for w in weights]
        for b, s in step.items():
            weights[b] += rate * s / len(rows)
    return bias, weights


def score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """The model's probability that the url is unwanted."""
    bias, weights = model
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    g = grams(host, path)
    total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(g), F.lit(1))))))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, model: tuple[float, list[float]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the longest fitting rule decides, else the model.

    Null or malformed urls have an empty host and path, fit no rule and are left
    to the model like any other. Repeated rows stay; an empty table gives none.
    Score is null where a rule decided.
    """
    rules = RULES if rules is None else rules
    model = train(pages.sparkSession) if model is None else model
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.select("*", rule_of(F.col("host"), F.col("path"), rules, "name").alias("rule"), rule_of(F.col("host"), F.col("path"), rules, "verdict").alias("ruled"))
    df = df.withColumn("score", F.when(F.col("rule").isNull(), score(F.col("host"), F.col("path"), model)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
