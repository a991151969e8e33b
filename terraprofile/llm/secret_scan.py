"""Secret scans with an incremental blob ledger.

Every text is a version of some path and is addressed by the SHA-256 of its bytes. A ledger
lists which blob was scanned under which version of which rule, with what was found. A push
looks up the rules that each of its distinct blobs has not met yet, scans those pairs only,
and its findings are joined back to all paths that hold the blob. Changing a rule's pattern
means raising its version: that rule alone is run again.

Only DataFrame functions are used. A match's place is not given by the regular expression
functions, so it is the running sum of the lengths of the matches and of the text between
them (a text split by the pattern), as rows in a window per blob and rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.session import materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap, kept where ``group`` has at least ``least`` characters.

    A pattern must not match nothing.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """ASCII letters of a pattern in either case, whatever the engine's rules for other alphabets."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", 1, rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # a run is one match, so shorter ones need not be listed to be dropped
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)


def address(text: Column) -> Column:
    """The blob of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hits(rule: Rule, text: Column) -> Column:
    """Per match of a rule: characters between it and the match before, its own, and those of the rule's group."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), inner.alias("inner"))
    sizes = F.transform(zipped, lambda z: F.struct(F.char_length(z["gap"]).alias("gap"), F.char_length(z["whole"]).alias("size"), F.char_length(z["inner"]).alias("inner")))
    # behind the last match there is only text
    return F.filter(sizes, lambda s: s["size"].isNotNull())


def new_entries(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The entries that a push of ``docs`` adds: blob, scanned (rule keys), found (rule, kind, start, end).

    Blobs that the ledger knows under all rules are left out. Offsets count characters, the end is
    exclusive. Null texts are the empty blob, which is scanned like any other and holds nothing; an
    empty table adds nothing; repeated texts are one blob.
    """
    blobs = docs.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("scanned", wanted)
    else:
        known = ledger.select("blob", F.explode("scanned").alias("k")).groupBy("blob").agg(F.collect_set("k").alias("known"))
        left = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
        todo = blobs.join(known, "blob", "left").select("blob", "text", left.alias("scanned")).where(F.size("scanned") > 0)
    text = F.col("text")
    per_rule = [
        F.when(F.array_contains("scanned", r.key) & text.rlike(r.pattern), F.struct(F.lit(k).alias("rule"), _hits(r, text).alias("hits"))) for k, r in enumerate(rules)
    ]
    found = F.filter(F.array(*per_rule), lambda s: s.isNotNull())
    # blobs without a match stay as one row without rule
    by_rule = todo.select("blob", "scanned", F.explode_outer(found).alias("r")).select("blob", "scanned", "r.rule", F.posexplode_outer("r.hits").alias("k", "hit"))
    # one blob's matches under one rule, in text order
    before = "sum(hit.gap + hit.size) OVER (PARTITION BY blob, rule ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = by_rule.select("blob", "scanned", "rule", "hit", F.expr(before).alias("end"))
    kind, least, key = (_choose(F.col("rule"), [getattr(r, name) for r in rules]) for name in ("kind", "least", "key"))
    span = F.struct((F.col("end") - F.col("hit.size")).alias("start"), F.col("end"), kind.alias("kind"), key.alias("rule"))
    spans = F.collect_list(F.when(F.col("hit.inner") >= least, span))
    return placed.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.array_sort(spans).alias("found"))


def _choose(number: Column, values: Sequence) -> Column:
    return reduce(lambda c, kv: F.when(number == kv[0], F.lit(kv[1])).otherwise(c), enumerate(values), F.lit(None))


def push(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what ``docs`` brings that the ledger at ``path`` has not seen, append it there, and return the ledger.

    The folder is made by the first push. A push that fails before its commit leaves the ledger as it was.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    held = folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder)
    # the ledger read here must not change under the append
    ledger = spark.read.parquet(path) if held else None
    materialize(new_entries(docs, ledger, rules, text_col), "ledger-entries").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, blob and found, what the given rules found in its blob.

    ``found`` is in order of start, then of the rules. All rows stay, those without id, repeated ones
    and those whose blob the ledger lacks (found is then null) too; other columns are not read.
    """
    order = _choose_by_key(rules)
    current = F.filter("found", lambda s: s["rule"].isin(*[r.key for r in rules]))
    by_place = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list(current))), lambda s: F.struct(s["start"], order(s["rule"]).alias("order"), s["end"], s["kind"], s["rule"])))
    plain = F.transform(by_place, lambda s: F.struct(s["start"], s["end"], s["kind"], s["rule"]))
    known = ledger.groupBy("blob").agg(plain.alias("found"))
    paths = docs.select(F.col(id_col).alias("doc_id"), address(F.col(text_col)).alias("blob"))
    return paths.join(known, "blob", "left").select("doc_id", "blob", "found")


def _choose_by_key(rules: Sequence[Rule]):
    return lambda key: reduce(lambda c, kr: F.when(key == kr[1].key, F.lit(kr[0])).otherwise(c), enumerate(rules), F.lit(None).cast("int"))


def written(found: Column, kinds: Sequence[str] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined; of the given kinds only."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
