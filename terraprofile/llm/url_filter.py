"""URL filter: rules by host and path, and gradient-boosted trees where no rule fits.

Everything is DataFrame functions and the DataFrame API of Spark's own trees. Trees
learn from the URLs that rules label, on lexical features: lengths, depth, digit ratio,
entropy, parameter counts, and the share of blocked URLs per host suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.session import materialize

TRAIN_ROWS = 20_000
MAX_RULES = 1_000
TREES, DEPTH = 20, 4
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_longest", "f_suffix"]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains and for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """``block example.com/en/`` -> verdict, host and path."""
    verdict, where = text.split(" ", 1)
    host, slash, path = where.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def with_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host (A-Z lower-cased) and path; both '' for null or without ``://``."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), letters, letters.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_column(rules: list[Rule], field: str) -> Column:
    """The longest fitting rule's ``name`` or ``verdict``; null if none fits. A few rules, checked in order of length."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        value = F.lit(getattr(r, field))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("string") if found is None else found


def with_features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Lexical features of URLs that have ``host`` and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    n = F.char_length(url)
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    classes = [count(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[/.:]", "[-_~%]", "[?&=#]")]
    shares = [c / F.greatest(n, F.lit(1)) for c in classes]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares[1:]), F.when(shares[0] > 0, -shares[0] * F.log2(shares[0])).otherwise(0.0))
    words = F.transform(F.split(F.concat("host", "path"), "[^A-Za-z]+"), F.char_length)
    return urls.select(
        "*",
        n.cast("double").alias("f_length"),
        F.char_length("host").cast("double").alias("f_host_length"),
        F.char_length("path").cast("double").alias("f_path_length"),
        F.regexp_count("host", F.lit(r"\.")).cast("double").alias("f_labels"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("f_depth"),
        shares[2].alias("f_digits"),
        entropy.alias("f_entropy"),
        count("[?&][^=&#]+=").alias("f_params"),
        count("-").alias("f_hyphens"),
        F.coalesce(F.array_max(words), F.lit(0)).cast("double").alias("f_longest"),
    )


def suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A fitting rule decides. Elsewhere the trees do, fitted on at most ``train_rows`` labelled URLs, those
    with the smallest hash; with labels of one kind only that kind decides, without labels ``allow``.
    Suffix statistics count every labelled row. Null URLs have empty host and path and no rule. Rows
    repeat as given; columns named like the results are replaced. An empty table gives an empty result.
    """
    ours = ["host", "path", "rule", "verdict", "suffix", "_given", *FEATURES]
    base = with_parts(pages.drop(*[c for c in ours if c != url_col]), url_col)
    base = base.withColumn("rule", rule_column(rules, "name")).withColumn("_given", rule_column(rules, "verdict")).withColumn("suffix", suffix(F.col("host")))
    blocked = (F.col("_given") == "block").cast("double")
    # counts per suffix are summed in the tasks first, so a suffix of most rows is no burden
    counts = base.groupBy("suffix").agg(F.sum(blocked).alias("bad"), F.count("_given").alias("known")).where("known > 0")
    totals = materialize(counts, "suffix-counts")
    bad, known = totals.agg(F.sum("bad"), F.sum("known")).first()
    if not known or bad in (0, known):
        verdict = F.lit("block" if known and bad else "allow")
        return base.withColumn("verdict", F.coalesce("_given", verdict)).drop("_given", "suffix")
    prior = bad / known
    rates = totals.select("suffix", ((F.col("bad") + 10 * prior) / (F.col("known") + 10)).alias("f_suffix"))
    labelled = base.where("_given is not null")
    sample = labelled.withColumn("_order", F.xxhash64(url_col)).orderBy("_order", url_col).limit(train_rows).drop("_order")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")

    def featured(rows: DataFrame) -> DataFrame:
        return assembler.transform(with_features(rows, url_col).join(rates, "suffix", "left").fillna({"f_suffix": prior}))

    train = materialize(featured(sample.select(url_col, "host", "path", "suffix", "_given")).select("_features", (F.col("_given") == "block").cast("double").alias("_label")), "url-labels")
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_block", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1)
    trees.set(trees.rawPredictionCol, "_raw")
    trees.set(trees.probabilityCol, "_p")
    judged = trees.fit(train).transform(featured(base))
    verdict = F.coalesce("_given", F.when(F.col("_block") == 1, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("_given", "suffix", "_features", "_raw", "_p", "_block", *FEATURES)
