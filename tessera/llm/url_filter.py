"""URL filter: host and path rules, and gradient-boosted trees for what no rule decides."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, small, smallest_hashes, written

#: (verdict, host and path) of the production rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
FEATURES = (
    "length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "extension",
    "secure", "suffix_count", "suffix_blocked", "suffix_ruled", "head_count", "head_blocked", "head_ruled",
)
#: Features of a suffix that no rule touches: what is known of its labels is hidden from half of the learned rows.
HIDDEN = {"suffix_blocked": 0.5, "suffix_ruled": 0.0}
#: Buckets of hashed first parts of a path, and folds of URLs; fold 0 is held out.
HEADS, FOLDS = 4096, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def best_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct of verdict and rule, or null; the first of equals.

    A rule fits its host and all subdomains of it, if the path starts with the rule's path.
    """
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return -F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0)
    )


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical FEATURES of columns url, host and path, and what the statistics go by: suffix and head."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": _count(host, "."),
        "depth": _count(path, "/"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
        "entropy": F.when(F.length(url) > 0, entropy(url)).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "hyphens": _count(url, "-"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "secure": url.startswith("https:").cast("double"),
        "suffix": F.substring_index(host, ".", -1),
        "head": F.pmod(F.xxhash64(F.regexp_extract(path, "^/([^/]*)/", 1)), F.lit(HEADS)).cast("int"),
    })


def statistics(ruled: DataFrame, by: str) -> DataFrame:
    """Written: for each ``by``, how many pages have it, and in each fold how many a rule decides and blocks."""
    learned = F.col("best").isNotNull() & (F.col("fold") > 0)
    counts = [
        F.struct(
            F.count_if(learned & (F.col("fold") == f)).alias("n"),
            F.count_if(learned & (F.col("fold") == f) & (F.col("best.verdict") == "block")).alias("blocked"),
        )
        for f in range(FOLDS)
    ]
    return written(ruled.groupBy(by).agg(F.count("*").alias("pages"), F.array(*counts).alias("folds")), f"url-{by}")


def with_statistics(rows: DataFrame, stats: DataFrame, by: str, own_fold: bool) -> DataFrame:
    """Add three features of ``by``: the magnitude of its pages (a finer count would name it), labelled pages, and their smoothed blocked share, without the row's ``fold`` if ``own_fold``."""
    left = F.col("fold") if own_fold else F.lit(-1)
    total = lambda name: F.aggregate(
        F.transform("folds", lambda x, i: F.when(i == left, 0).otherwise(x[name])), F.lit(0).cast("long"), lambda a, x: a + x
    )
    joined = rows.join(F.broadcast(stats) if small(stats) else stats, by)
    return joined.withColumns({
        f"{by}_count": F.round(F.log2(F.col("pages") + 1)),
        f"{by}_blocked": (total("blocked") + 1) / (total("n") + 2),
        f"{by}_ruled": F.log1p(total("n")),
    }).drop("pages", "folds")


def url_rules(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, url (null as empty), host, path and ``best``, a struct of the verdict and rule that decide, or null."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    return rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))


def url_verdicts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    sample: int = 20_000,
    trees: int = 20,
    depth: int = 3,
    seed: int = 42,
    suffixes: bool = True,
) -> DataFrame:
    """Judge every URL: by the longest fitting rule, else by gradient-boosted trees.

    The trees learn from URLs that a rule decides, but for the fold of FOLDS that is held out by a hash of the URL; of
    those from at most ``sample``, the ones with the smallest hash. Their features are lexical: length, depth, digit
    ratio, entropy, counts of parameters, and for the host's last label and for the path's first part (hashed to HEADS
    buckets) how many of all pages have it, how many of them a rule decides, and the smoothed share that is blocked.
    These counts cover all pages; a learned row sees shares without its own fold. As the label of a suffix can
    give the rules away, each row is learned twice, once as if no rule touched its suffix: so the trees
    also learn what to do where the suffix tells nothing. Without ``suffixes``, all rows are judged so.
    Tables of counts are broadcast if they are small. Rules are a short list, checked in the expression.

    Null URLs count as empty, with empty host and path. Without both verdicts among the learned rows,
    what no rule decides is allowed. Ids may be null or repeat; there is a row for every input row. URLs may be of
    any length. Other columns are not read, whatever their names.

    Returns page_id, host, path, rule (null if none fits), verdict (allow or block), block_score and held_out.
    """
    ruled = url_rules(pages, id_col, url_col, rules)
    ruled = ruled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    rows = lexical(ruled)
    by_suffix, by_head = statistics(rows.select("suffix", "best", "fold"), "suffix"), statistics(rows.select("head", "best", "fold"), "head")
    known = by_head.select(F.explode("folds").alias("f")).agg(F.sum("f.n"), F.sum("f.blocked")).first()
    out = rows
    if known[0] and 0 < known[1] < known[0]:

        def described(df: DataFrame, own_fold: bool) -> DataFrame:
            return with_statistics(with_statistics(df, by_suffix, "suffix", own_fold), by_head, "head", own_fold)

        def vectors(df: DataFrame) -> DataFrame:
            return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df)

        labelled = (
            ruled.where("best is not null and fold > 0")
            .select("url", "host", "path", "fold", (F.col("best.verdict") == "block").cast("double").alias("label"))
        )
        chosen = smallest_hashes(labelled, "url", sample, known[0]).distinct().orderBy(F.xxhash64("url", F.lit(1)), "url").limit(sample)
        learned = written(described(lexical(chosen), True), "labelled-urls")
        both = learned.unionByName(learned.withColumns({k: F.lit(v) for k, v in HIDDEN.items()}))
        trainer = GBTClassifier(
            featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2
        )
        model = trainer.fit(vectors(both).select("_features", "label"))
        asked = described(rows, False)
        if not suffixes:
            asked = asked.withColumns({k: F.lit(v) for k, v in HIDDEN.items()})
        out = model.transform(vectors(asked)).withColumn("block_score", vector_to_array("probability")[1])
    else:
        out = out.withColumn("block_score", F.lit(0.0))
    judged = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", judged).alias("verdict"),
        "block_score",
        (F.col("fold") == 0).alias("held_out"),
    )
