"""URL filter: host and path rules first, else gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import ascii_lower, prepare

#: Labelled URLs to train on, at most; taken in the order of a hash.
SAMPLE = 4096
FEATURES = ("f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix")
#: Parts of host names that mark the URLs to block among the labelled ones.
TERMS = ("pills", "adult", "casino", "spam", "viagra", "porn", "poker", "betting", "malware", "phish", "torrent", "warez")
#: (verdict, host, path prefix) of the query, as the contract gives them.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def url_parts(url: Column) -> dict[str, Column]:
    """host: after the first ://, up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return {"host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def rule_column(rules: list[tuple[str, str, str]], host: Column, path: Column, what: str) -> Column:
    """The longest fitting rule's text (host + path) or verdict, else null. Rules are configuration: few."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p if what == "rule" else verdict)).otherwise(out)
    return out


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """Add the lexical features of url_col; needs host and path. Null URLs count as empty."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("double")
    chars = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    parts = F.transform(chars, lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    return df.withColumns({
        "f_length": F.length(u).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_depth": count(F.col("path"), "[^/]+"),
        "f_digits": count(u, "[^0-9]+") / n,
        "f_entropy": F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "f_params": count(u, "[^&?]+"),
        "f_labels": count(F.col("host"), r"[^.]+"),
        "f_hyphens": count(F.col("host"), "[^-]+"),
        "_suffix": F.concat_ws("/", F.substring_index("host", ".", -2), F.split_part("path", F.lit("/"), F.lit(2))),
    })


class UrlModel:
    """Trees as a column expression, and the block rate of each suffix seen in training. fitted: the model they are of."""

    def __init__(self, suffixes: DataFrame, rate: float, margin: Column, fitted=None):
        self.suffixes, self.rate, self.margin, self.fitted = suffixes, rate, margin, fitted

    def apply(self, df: DataFrame) -> DataFrame:
        """Add `blocked`. The suffix table has at most SAMPLE rows, so it is broadcast."""
        d = df.join(F.broadcast(self.suffixes), "_suffix", "left")
        return d.withColumn("f_suffix", F.coalesce("_rate", F.lit(self.rate))).withColumn("blocked", self.margin > 0)


def tree_column(node) -> Column:
    if "Leaf" in node.getClass().getSimpleName():
        return F.lit(float(node.prediction()))
    split = node.split()
    at = F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(at, tree_column(node.leftChild())).otherwise(tree_column(node.rightChild()))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", sample: int = SAMPLE) -> UrlModel:
    """Fit boosted trees on at most `sample` distinct labelled URLs (label 1.0: block).

    Without both labels the model is constant: the one label there is, else allow.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = labelled.sparkSession
    d = labelled.where(F.col(url_col).isNotNull()).groupBy(url_col).agg(F.max(label_col).alias("label"))
    d = d.orderBy(F.xxhash64(url_col), url_col).limit(sample)
    d = lexical(d.withColumns(url_parts(F.col(url_col))), url_col).select("label", "_suffix", F.pmod(F.xxhash64(F.lit(5), url_col), F.lit(4)).alias("_fold"), *FEATURES[:-1]).checkpoint()
    n, hits = d.agg(F.count(F.lit(1)), F.sum("label")).first()
    rate = (hits or 0.0) / n if n else 0.0
    # a row's suffix rate in training comes from the other folds, so that it can't give away its label
    sums = d.groupBy("_suffix", "_fold").agg(F.sum("label").alias("_hit"), F.count(F.lit(1)).alias("_seen"))
    whole = sums.groupBy("_suffix").agg(F.sum("_hit").alias("_hits"), F.sum("_seen").alias("_all")).checkpoint()
    suffixes = whole.select("_suffix", ((F.col("_hits") + 4 * rate) / (F.col("_all") + 4)).alias("_rate"))
    if n == 0 or rate in (0.0, 1.0):
        return UrlModel(suffixes, rate, F.lit(1.0 if n and rate == 1.0 else -1.0))
    rows = d.join(F.broadcast(sums), ["_suffix", "_fold"]).join(F.broadcast(whole), "_suffix")
    rows = rows.withColumn("f_suffix", (F.col("_hits") - F.col("_hit") + 4 * rate) / (F.col("_all") - F.col("_seen") + 4))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select("label", *FEATURES)).select("label", "features")
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.2, seed=7).fit(rows.coalesce(1))
    margin = F.lit(0.0)
    for weight, tree in zip(model.treeWeights, model._java_obj.trees(), strict=True):
        margin = margin + F.lit(float(weight)) * tree_column(tree.rootNode())
    return UrlModel(suffixes, rate, margin, model)


def weak_labels(urls: DataFrame) -> DataFrame:
    """(url, blocked): a host label holding one of TERMS marks a URL to block, its lack one to allow.

    Stands in for labels given by hand, of which the tables have none: what the trees learn from it is this list. Equal numbers of both, at most SAMPLE / 2 each, by hash.
    """
    d = urls.where("host <> ''").select("url", F.when(F.col("host").rlike("|".join(TERMS)), 1.0).otherwise(0.0).alias("blocked")).distinct()
    pick = lambda v: d.where(F.col("blocked") == v).orderBy(F.xxhash64("url"), "url").limit(SAMPLE // 2)
    return pick(1.0).unionAll(pick(0.0))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; the rule's verdict, else the model's.

    labelled (url, blocked 0.0 or 1.0) trains the model if none is given; without both, weak_labels of the pages do. A null URL or
    one without :// has an empty host and path, fits no rule and is judged by its features.
    """
    prepare(pages.sparkSession)
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns(url_parts(F.col("url")))
    d = d.withColumns({"rule": rule_column(rules, F.col("host"), F.col("path"), "rule"), "_verdict": rule_column(rules, F.col("host"), F.col("path"), "verdict")})
    if model is None:
        model = train(weak_labels(d.select("url", "host")) if labelled is None else labelled.select("url", "blocked"))
    d = model.apply(lexical(d, "url"))
    return d.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
