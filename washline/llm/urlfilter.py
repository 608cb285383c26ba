"""URL filters: host/path rules, and association rules mined from what they judge.

A list of (host, path) rules judges the urls it knows: a rule fits its host and all subdomains if
the url's path starts with the rule's, and the longest fitting rule wins. Their verdicts label the
urls. From the labelled urls Spark's FP-growth mines token combinations (domain parts, path
segments, extension, query keys); a combination whose urls almost all have one verdict is a rule.
Rules are pruned by confidence and support, and a rule that a more general one implies goes too. The
rest of the urls are judged by these: an inverted index from token to rules counts, for every
distinct set of tokens, how many tokens of each rule it has; the most confident rule that is met
whole decides, and without one the default verdict.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm.common import drop_scratch, scratch_table

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict) in production.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.95
_MARK = "verdict="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    part = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(part, F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(rule: tuple[str, str, str]) -> str:
    return f"{rule[0]}{rule[1]}"


def longest_rule(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. The list is a short parameter."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(rule_name(r)), rule_name(r))):
        fits = ((host_col == r[0]) | F.endswith(host_col, F.lit(f".{r[0]}"))) & F.startswith(
            path_col, F.lit(r[1]))
        out = F.when(fits, F.struct(F.lit(rule_name(r)).alias("rule"),
                                    F.lit(r[2]).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host_col: Column, path_col: Column) -> Column:
    """Sorted distinct tokens of a url: every suffix of the host, path segments, extension, query keys.

    Segments that are numbers are one token, so that page numbers do not make rare tokens.
    """
    labels = F.reverse(F.split(host_col, r"\."))
    domain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(
        F.lit("host:"), F.array_join(F.reverse(F.slice(labels, F.lit(1), n)), ".")))
    segments = F.filter(F.split(path_col, "/"), lambda s: s != "")
    named = F.transform(segments, lambda s: F.concat(
        F.lit("path:"), F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", ""), r"^\d+$", "#")))
    extension = F.regexp_extract(path_col, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""),
                       lambda s: F.concat(F.lit("query:"), F.get(F.split(s, "="), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(
        domain, named, F.when(extension != "", F.array(F.concat(F.lit("ext:"), extension)))
        .otherwise(F.array().cast("array<string>")), F.coalesce(keys, F.array().cast("array<string>"))),
        lambda t: t.isNotNull() & (t != "host:"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> list[dict]:
    """Association rules from ``labelled`` (tokens array, verdict): dicts of tokens, verdict, support,
    confidence, best first.

    FP-growth collects the combinations above ``min_support``, whose number depends on that
    threshold and not on the number of urls. Rows with a null verdict teach nothing.
    """
    items = labelled.where(F.col("verdict").isNotNull()).select(
        F.concat("tokens", F.array(F.concat(F.lit(_MARK), "verdict"))).alias("items"))
    if not items.limit(1).count():
        return []
    items, items_path = scratch_table(items, "baskets")
    total = items.count()
    found, found_path = scratch_table(
        FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets, "itemsets")
    mark = F.filter("items", lambda t: F.startswith(t, F.lit(_MARK)))
    split = found.select(
        F.array_sort(F.filter("items", lambda t: ~F.startswith(t, F.lit(_MARK)))).alias("tokens"),
        F.get(mark, F.lit(0)).alias("mark"), "freq")
    whole = split.where(F.col("mark").isNull()).select("tokens", F.col("freq").alias("n"))
    rules = (split.where(F.col("mark").isNotNull() & (F.size("tokens") > 0)).join(whole, "tokens")
             .withColumn("confidence", F.col("freq") / F.col("n"))
             .where(F.col("confidence") >= min_confidence)
             .select("tokens", F.substring("mark", len(_MARK) + 1, 1 << 20).alias("verdict"),
                     (F.col("freq") / total).alias("support"), "confidence")).collect()
    drop_scratch(labelled.sparkSession, items_path, found_path)
    ordered = sorted((r.asDict() for r in rules),
                     key=lambda r: (len(r["tokens"]), -r["confidence"], -r["support"], r["tokens"]))
    kept: list[dict] = []
    for r in ordered:  # a rule goes if a more general one has its verdict and is as confident
        if not any(set(g["tokens"]) <= set(r["tokens"]) and g["verdict"] == r["verdict"]
                   and g["confidence"] >= r["confidence"] for g in kept):
            kept.append(r)
    return sorted(kept, key=lambda r: (-r["confidence"], -r["support"], r["tokens"], r["verdict"]))


def match(sets: DataFrame, rules: list[dict]) -> DataFrame:
    """``sets`` (tokens, distinct) with the verdict of the first rule, in order, that is met whole."""
    spark = sets.sparkSession
    index = spark.createDataFrame(
        [(t, i, len(r["tokens"]), r["verdict"]) for i, r in enumerate(rules) for t in r["tokens"]],
        "token string, rule_no int, need int, mined string")
    met = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
           .groupBy("tokens", "rule_no", "need", "mined").agg(F.count(F.lit(1)).alias("have"))
           .where(F.col("have") == F.col("need"))
           .groupBy("tokens").agg(F.min(F.struct("rule_no", "mined")).alias("first")))
    return met.select("tokens", F.col("first.rule_no").alias("rule_no"), F.col("first.mined").alias("mined"))


def judge(pages: DataFrame, rules=RULES, default: str = ALLOW, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per row of ``pages`` (page_id, url, any others): host, path, rule, verdict and mined.

    ``rule`` names the listed rule that decided, else it is null; ``mined`` is the number of the
    mined rule that decided, else null. Null urls and urls without ``://`` have an empty host and
    path, no tokens, and the default verdict. Repeated rows are judged alike.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select("page_id", "url", h.alias("host"), p.alias("path"))
    rows = rows.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("listed"),
                       F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path")))
                       .otherwise(F.array().cast("array<string>")).alias("tokens"))
    rows, _ = scratch_table(rows.drop("url"), "urls")
    mined = mine(rows.where(F.col("listed").isNotNull()).select(
        "tokens", F.col("listed.verdict").alias("verdict")), min_support, min_confidence)
    rest = rows.where(F.col("listed").isNull()).select("tokens").distinct()
    found = match(rest, mined).select(F.col("tokens").alias("_t"), "rule_no", "mined")
    return rows.join(found, F.col("listed").isNull() & (rows["tokens"] == found["_t"]), "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined", F.lit(default)).alias("verdict"),
        F.col("rule_no").alias("mined"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")
