"""URL filters: host rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs: by default those that a rule judges. A bounded sample of them is cut into
whole-number features; every round sums gradients by node, feature and value in one aggregation and the driver
picks the splits from these sums, which are bounded by nodes x features x values. Sums are of whole numbers, so their order doesn't
matter. The trained trees are one expression of nested conditions over the features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import file_count, stored, table

#: (host, path, verdict); the rule of the longest host and path wins.
RULES: tuple[tuple[str, str, str], ...] = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Bound of the labelled URLs that trees are trained on: those of the least hash of all labelled ones.
SAMPLE = 20_000
ROUNDS, DEPTH, RATE, L2, LEAST = 12, 3, 0.4, 1.0, 20
#: Features are binned to whole numbers from 0 to TOP, so that a histogram is bounded; what lies beyond is in the last bin.
TOP = 255
_SCALE = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict (null without a rule that fits)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    out = pages.withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    pick = lambda value: F.coalesce(*[F.when(fits(h, p), F.lit(value(h, p, v))) for h, p, v in ordered], F.lit(None).cast("string"))
    return out.withColumn("rule", pick(lambda h, p, v: h + p)).withColumn("rule_verdict", pick(lambda h, p, v: v))


def _times(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical() -> dict[str, Column]:
    """Whole-number features of host, path and url, each from 0 to TOP."""
    url, n = F.coalesce(F.col("url"), F.lit("")), F.greatest(F.length(F.coalesce(F.col("url"), F.lit(""))), F.lit(1))
    letters = F.split(url, "")
    share = lambda c: (n - F.length(F.replace(url, c))) / n
    entropy = F.when(F.length(url) == 0, F.lit(0.0)).otherwise(F.aggregate(F.filter(F.array_distinct(letters), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "host_labels": _times(F.col("host"), "[.]"),
        "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split(F.col("path"), "/"), lambda x: x != "")),
        "digits": F.floor(200 * _times(url, "[0-9]") / n),
        "path_digits": _times(F.col("path"), "[0-9]"),
        "entropy": F.floor(F.round(40 * entropy, 6)),
        "parameters": F.when(query == "", F.lit(0)).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.instr(url, "#") > 0,
        "secure": url.startswith("https://"),
        "hyphens": _times(url, "[-_]"),
        "vowels": F.floor(200 * _times(F.col("path"), "[aeiou]") / F.greatest(F.length("path"), F.lit(1))),
    }
    return {k: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(TOP)) for k, v in raw.items()}


def statistics() -> dict[str, Column]:
    """Parts of a URL whose share of blocked ones is a feature: the host's last label, its last two, the first directory."""
    return {"ending": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "directory": F.regexp_extract("path", "^/([^/]*)/", 1)}


@dataclass
class Model:
    """features by name; trees of nested tuples (feature, value, left, right) with leaves of whole numbers over _SCALE."""

    #: (statistic, value, share): shares of blocked URLs, times TOP, of all values in the bounded sample; None without a sample
    shares: DataFrame | None = None
    prior: int = TOP // 2
    base: int = 0
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        """Of block over allow, times _SCALE, over columns with the features' names."""
        return sum((_expression(t) for t in self.trees), F.lit(self.base).cast("long"))


def _expression(tree) -> Column:
    if isinstance(tree, int):
        return F.lit(tree).cast("long")
    feature, value, left, right = tree
    return F.when(F.col(f"__x_{feature}") <= value, _expression(left)).otherwise(_expression(right))


def _node(tree, number: int = 1) -> Column:
    """The number of the open leaf (None) that a row falls into; 0 if its leaf is closed."""
    if tree is None:
        return F.lit(number)
    if isinstance(tree, int):
        return F.lit(0)
    feature, value, left, right = tree
    return F.when(F.col(f"__x_{feature}") <= value, _node(left, 2 * number)).otherwise(_node(right, 2 * number + 1))


def feature_names() -> list[str]:
    return [*lexical(), *statistics()]


def _featured(pages: DataFrame, model: Model) -> DataFrame:
    """Adds a column __x_ for each feature. A statistic's value that the sample doesn't have gets the prior share."""
    out = pages.withColumns({f"__x_{k}": v for k, v in lexical().items()})
    for name, of in statistics().items():
        if model.shares is None:
            out = out.withColumn(f"__x_{name}", F.lit(model.prior))
            continue
        own = F.broadcast(model.shares.where(F.col("statistic") == name).select(F.col("value").alias("__value"), F.col("share").alias("__share")))  # at most as many rows as the sample
        out = out.join(own, of == F.col("__value"), "left").withColumn(f"__x_{name}", F.coalesce("__share", F.lit(model.prior))).drop("__value", "__share")
    return out


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, depth: int = DEPTH) -> Model:
    """Fits the trees to labelled (url, host, path, block as 0 or 1). Without rows of both kinds the model is a constant.

    The sample is of different URLs, each weighted with its number of rows, so copies of one don't crowd out others.
    """
    distinct = labelled.where("url is not null and block is not null").groupBy("url", "host", "path", "block").agg(F.count(F.lit(1)).alias("weight"))
    chosen = stored(distinct.orderBy(F.xxhash64("url"), "url", "block").limit(sample), "urls")
    model = Model()
    total = chosen.agg(F.sum("weight").alias("n"), F.sum(F.col("block") * F.col("weight")).alias("b")).first()
    n, b = total.n or 0, total.b or 0
    if not n:
        return model
    model.base = round(_SCALE * math.log((b + 1) / (n - b + 1)))
    if b in (0, n):
        return model
    model.prior = TOP * b // n
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), of.alias("value")) for k, of in statistics().items()]))
    counted = chosen.select(values.alias("s"), "block", "weight").groupBy("s.statistic", "s.value").agg(F.sum("weight").alias("n"), F.sum(F.col("block") * F.col("weight")).alias("b"))
    model.shares = stored(counted.select("statistic", "value", F.expr(f"cast(({TOP} * (b * {n} + 8 * {b})) div ({n} * (n + 8)) as int)").alias("share")), "shares", 1)
    names = feature_names()
    rows = _featured(chosen, model).groupBy("block", *[f"__x_{k}" for k in names]).agg(F.sum("weight").alias("__n"))
    rows = stored(rows, "features", 1)  # at most sample rows
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin() / float(_SCALE)))
        part = rows.withColumn("__g", F.round((F.col("block") - p) * _SCALE).cast("long") * F.col("__n")).withColumn("__q", F.round(p * (1 - p) * _SCALE).cast("long") * F.col("__n"))
        tree, open_leaves = None, {1: ()}
        for level in range(depth + 1):
            cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__x_{k}").alias("v")) for k in names]))
            sums = part.withColumn("__node", _node(tree)).where("__node > 0").select("__node", "__g", "__q", "__n", cells.alias("c")).groupBy("__node", "c.k", "c.v").agg(F.sum("__g").alias("g"), F.sum("__q").alias("h"), F.sum("__n").alias("n")).collect()
            histograms: dict[int, dict[str, list]] = {}
            for r in sums:
                histograms.setdefault(r["__node"], {}).setdefault(r.k, []).append((r.v, r.g, r.h, r.n))
            grown = {}
            for node, histogram in sorted(histograms.items()):
                grown[node] = _best(histogram) if level < depth else _leaf(histogram)
            tree = _grown(tree, grown)
            open_leaves = [x for x in grown.values() if not isinstance(x, int)]
            if not open_leaves:
                break
        model.trees.append(tree)
    return model


def _leaf(histogram: dict[str, list]) -> int:
    g, h = (sum(c[i] for c in next(iter(histogram.values()))) for i in (1, 2))
    return round(RATE * _SCALE * g / (h + L2 * _SCALE))


def _best(histogram: dict[str, list]):
    """(feature, value, None, None) of the best split, or a leaf if none gains."""
    score = lambda g, h: g * g / (h + L2 * _SCALE)
    best = (1e-6 * _SCALE, None)
    for name in sorted(histogram):
        cells = sorted(histogram[name])
        g, h, n = (sum(c[i] for c in cells) for i in (1, 2, 3))
        lg = lh = ln = 0
        for (value, cg, ch, cn), (after, *_) in pairwise(cells):
            lg, lh, ln = lg + cg, lh + ch, ln + cn
            if ln >= LEAST and n - ln >= LEAST:
                gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                if gain > best[0]:
                    # halfway to the next value, so that a value unseen goes with the nearer one
                    best = (gain, (name, (value + after) // 2, None, None))
    return best[1] or _leaf(histogram)


def _grown(tree, grown: dict, number: int = 1):
    if tree is None:
        return grown.get(number, 0)
    if isinstance(tree, int):
        return tree
    feature, value, left, right = tree
    return feature, value, _grown(left, grown, 2 * number), _grown(right, grown, 2 * number + 1)


def judged(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, margin (the model's, of block over allow).

    A null url, or one without ://, has an empty host and path, fits no rule, and goes to the model like any other.
    Repeated rows are judged one by one; an empty table gives no rows. Other columns of pages, whatever their names, play
    no part.
    """
    rows = _featured(with_parts(pages.select("page_id", "url"), rules), model).withColumn("margin", model.margin() / float(_SCALE))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin")


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    return with_parts(pages.select("url"), rules).where("rule is not null").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("block"))


def op7_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, train(labelled_by_rules(pages))).coalesce(file_count(pages))
