"""URL verdicts from host and path rules, and from gradient-boosted trees where no rule fits.

The trees read lexical features: lengths, depths, the digit ratio, the entropy of the URL's and of the host's characters,
the number of parameters, and for the host's last one, two and three labels how many labelled URLs end in them and which
part of those is bad. They are trained from labelled URLs and everything runs in DataFrame operations:

* suffixes are counted over all labelled URLs; a URL that is learnt from never meets its own label in them: for half of the
  sample the counts of its whole host are left out, as if the host were new, for the rest those of its fold of FOLDS;
* a bounded sample of at most ``SAMPLE`` distinct URLs of each label, weighted to the true numbers, is binned at quantiles and counted by bins;
* each level of each tree is one aggregation of gradients by node, feature and bin, whose few hundred sums come to the
  driver, which picks the splits of best gain (ties: the first feature, the lowest bin);
* scoring is a sum of CASE expressions, next to the scan.

Cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is judged by its features, which
are all zero for null; without labelled URLs of both labels the method allows; repeated rows get the same answer; an empty
table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_per_class, checkpoint, class_counts, table

#: (verdict, host and path). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Pages carry no labels, so the query takes URLs whose host has one of these words as bad and all others as good.
BAD_WORDS = ("casino", "poker", "bets", "adult", "porn", "xxx", "pills", "viagra", "loans")

SAMPLE, BINS, ROUNDS, DEPTH, RATE, RIDGE, SMOOTH = 20_000, 16, 8, 3, 0.4, 1.0, 5.0
FOLDS = 5
LEVELS = (1, 2, 3)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, with A-Z lower-cased, and the path up to the query or fragment."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(longest rule that fits, its verdict), null where none fits. Of equally long rules a block wins, then text order."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block", x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(said)).otherwise(verdict)
    return found, verdict


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _entropy(text: Column) -> Column:
    """Bits a character of the distribution of the characters of ``text``."""
    n = F.greatest(F.length(text).cast("double"), F.lit(1.0))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text).cast("double")
    over = F.greatest(n, F.lit(1.0))
    filled = lambda parts: F.size(F.filter(parts, lambda x: x != "")).cast("double")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": filled(F.split(path, "/")),
        "host_depth": filled(F.split(host, "\\.")),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / over,
        "entropy": _entropy(text),
        "host_entropy": _entropy(host),
        "parameters": filled(F.split(query, "&")),
    }


def features(rows: DataFrame, statistics: list[DataFrame], folds: list[DataFrame] | None = None) -> DataFrame:
    """``rows(_url, _host, _path, ...)`` with the columns of NAMES added.

    Rows with a ``_fold`` do without the counts of that fold of their ending in ``folds``, rows with _fold -1 without those of
    their host. Statistics grow with the hosts, so they are joined to the distinct hosts, and those to the rows.
    """
    out = rows.withColumns(_lexical(F.col("_url"), F.col("_host"), F.col("_path")))
    by = ["_host"] if folds is None else ["_host", "_fold"]
    hosts = rows.select(*by).distinct()
    whole = statistics[-1].select(F.col("suffix").alias("_host"), F.col("n").alias("_host_n"), F.col("bad").alias("_host_bad"))
    if folds is not None:
        hosts = hosts.join(whole, "_host", "left")
    for k, known in zip(LEVELS, statistics, strict=False):
        hosts = hosts.withColumn("suffix", _suffix(F.col("_host"), k)).join(known, "suffix", "left")
        n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
        if folds is not None:
            hosts = hosts.join(folds[k - 1].select("suffix", "_fold", F.col("n").alias("_n"), F.col("bad").alias("_bad")), ["suffix", "_fold"], "left")
            new = F.col("_fold") < 0
            n -= F.coalesce(F.when(new, F.col("_host_n")).otherwise(F.col("_n")), F.lit(0))
            bad -= F.coalesce(F.when(new, F.col("_host_bad")).otherwise(F.col("_bad")), F.lit(0))
        rate = F.when(n > 0, (bad + SMOOTH * 0.5) / (n + SMOOTH)).otherwise(-1.0)
        times = F.coalesce("times", F.lit(0.0)) if folds is None else F.log1p(n.cast("double"))
        hosts = hosts.withColumns({f"rate_{k}": rate, f"times_{k}": times}).drop("suffix", "n", "bad", "times", "_n", "_bad")
    return out.join(hosts.drop("_host_n", "_host_bad"), by)


NAMES = [
    "length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy", "host_entropy", "parameters",
    *[f"{x}_{k}" for k in LEVELS for x in ("rate", "times")],
]


def suffix_statistics(labelled: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of ``labelled(_host, _label, _fold)``: (suffix, n, bad, times) for each number of labels, and at last for whole hosts, times being ln(1 + n); (suffix, n, bad) of the former by fold."""
    folds, sums = [], (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    for ending in [*[_suffix(F.col("_host"), k) for k in LEVELS], F.col("_host")]:
        folds.append(checkpoint(labelled.groupBy(ending.alias("suffix"), "_fold").agg(F.count("*").alias("n"), F.sum("_label").alias("bad"))))
    return [checkpoint(x.groupBy("suffix").agg(*sums).withColumn("times", F.log1p(F.col("n").cast("double")))) for x in folds], folds[:-1]


class Trees:
    """Boosted trees of logistic loss as nested tuples: (feature, threshold, low, high), or a leaf's number."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    @staticmethod
    def _sql(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{float(tree)!r}D"
        feature, cut, low, high = tree
        return f"CASE WHEN {feature} <= {float(cut)!r}D THEN {Trees._sql(low)} ELSE {Trees._sql(high)} END"

    def margin(self) -> Column:
        return F.expr(" + ".join([f"{float(self.base)!r}D", *map(self._sql, self.trees)]))

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


def _split(sums: dict, names: list[str]):
    """The best (gain, feature, bin) of a node from its gradient and curvature by feature and bin; None if none gains."""
    best = None
    for f in range(len(names)):
        bins = sorted(sums.get(f, {}).items())
        g, h = sum(x[1][0] for x in bins), sum(x[1][1] for x in bins)
        low_g = low_h = 0.0
        for b, (dg, dh) in bins[:-1]:
            low_g, low_h = low_g + dg, low_h + dh
            if low_h < 1e-3 or h - low_h < 1e-3:
                continue
            gain = round(low_g**2 / (low_h + RIDGE) + (g - low_g) ** 2 / (h - low_h + RIDGE) - g**2 / (h + RIDGE), 6)
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = gain, f, b
    return best


def train(binned: DataFrame, cuts: dict[str, list[float]]) -> Trees:
    """Fits trees to ``binned``: a column of bins per name in ``cuts``, ``n`` rows of which ``bad`` are bad."""
    names = list(cuts)
    n, bad = binned.agg(F.sum("n"), F.sum("bad")).first()
    if not n or not 0 < bad < n:
        return Trees(-20.0)
    model = Trees(log(bad / (n - bad)))
    by_bin = Trees(model.base)  # the same trees, with bins for thresholds
    for _ in range(ROUNDS):
        leaves: dict[int, tuple | float] = {}
        splits: dict[int, tuple[int, int]] = {}  # node -> feature, bin; the children of i are 2i+1 and 2i+2
        p = by_bin.probability()
        rows = binned.withColumns({"_g": F.col("n") * p - F.col("bad"), "_h": F.col("n") * p * (1 - p)})
        for level in range(DEPTH + 1):
            node = "0"
            for _ in range(level):
                steps = "".join(f" WHEN {i} THEN CASE WHEN {names[f]} <= {b} THEN {2 * i + 1} ELSE {2 * i + 2} END" for i, (f, b) in splits.items())
                node = f"CASE {node}{steps} ELSE -1 END"
            # All nodes of a level in one job: nodes * features * BINS sums at most.
            each = ", ".join(f"struct({f} AS f, {x} AS b)" for f, x in enumerate(names))
            sums = rows.withColumn("_node", F.expr(node)).where("_node >= 0").select("_node", "_g", "_h", F.expr(f"explode(array({each}))").alias("_at"))
            found: dict[int, dict] = {}
            for r in sums.groupBy("_node", "_at.f", "_at.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                found.setdefault(r["_node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            for i, own in found.items():
                g, h = (sum(x[k] for x in own[0].values()) for k in (0, 1))
                leaves[i] = round(-RATE * g / (h + RIDGE), 9)
                if level < DEPTH and (best := _split(own, names)):
                    splits[i] = best[1:]
            if level < DEPTH and not any(i in splits for i in found):
                break

        def build(i: int, cut):
            if i not in splits or 2 * i + 1 not in leaves or 2 * i + 2 not in leaves:
                return leaves.get(i, 0.0)
            f, b = splits[i]
            return names[f], cut(f, b), build(2 * i + 1, cut), build(2 * i + 2, cut)

        by_bin.trees.append(build(0, lambda f, b: float(b)))
        model.trees.append(build(0, lambda f, b: cuts[names[f]][b]))
    return model


def fit(labelled: DataFrame) -> tuple[Trees, list[DataFrame]]:
    """(trees, suffix statistics) from ``labelled(_key, _url, _host, _path, _label)``, from all of which suffixes are counted.

    The trees grow on a bounded sample, in which a row weighs as many rows as it stands for.
    """
    fold = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(FOLDS)).cast("int")
    labelled = labelled.where(F.col("_label").isNotNull()).withColumn("_fold", fold)
    # Copies of a URL are learnt from once, and weigh by the true numbers of their label like all others.
    sample = bounded_per_class(labelled.dropDuplicates(["_url", "_label"]), "_label", "_key", SAMPLE)
    sample = checkpoint(sample.withColumn("_fold", F.when(F.pmod(F.xxhash64("_key", F.lit(2)), F.lit(2)) == 0, F.lit(-1)).otherwise(F.col("_fold"))))
    statistics, folds = suffix_statistics(labelled)
    every, taken = class_counts(labelled, "_label"), class_counts(sample, "_label")
    weight = F.lit(0.0)
    for value, n in taken.items():
        weight = F.when(F.col("_label") == value, F.lit(every[value] / n)).otherwise(weight)
    made = checkpoint(features(sample, statistics, folds).select("_label", weight.alias("_weight"), *NAMES))
    quantiles = made.agg(*[F.percentile_approx(x, [i / BINS for i in range(1, BINS)], 1000).alias(x) for x in NAMES]).first()
    cuts = {x: sorted({float(v) for v in quantiles[x] or []}) for x in NAMES}
    bins = [sum((F.col(x) > c).cast("int") for c in cuts[x]) + F.lit(0) if cuts[x] else F.lit(0) for x in NAMES]
    binned = made.groupBy(*[b.alias(x) for b, x in zip(bins, NAMES, strict=True)]).agg(F.sum("_weight").alias("n"), F.sum(F.col("_weight") * F.col("_label")).alias("bad"))
    # At most 2 * SAMPLE small rows: in one partition each of the many aggregations is one stage without a shuffle.
    return train(checkpoint(binned.coalesce(1)), cuts), statistics


def judge(pages: DataFrame, model: tuple[Trees, list[DataFrame]], id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule, verdict, score (the trees' probability of bad)."""
    trees, statistics = model
    rows = _parsed(pages.select(F.col(id_col).alias("_key"), F.col(url_col).alias("_url")))
    rule, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    scored = features(rows, statistics).withColumn("_score", trees.probability())
    said = F.coalesce(verdict, F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("_key").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), said.alias("verdict"), F.col("_score").alias("score"))


def _parsed(rows: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("_url"))
    return rows.withColumns({"_host": host, "_path": path})


def labelled_urls(urls: DataFrame, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """What ``fit`` reads, from a table of URLs and labels (1: bad, 0: good); rows without either are left out. A URL's key is itself."""
    rows = urls.select(F.col(url_col).alias("_key"), F.col(url_col).alias("_url"), F.col(label_col).cast("int").alias("_label"))
    return _parsed(rows.where("_url IS NOT NULL AND _label IS NOT NULL"))


def weak_labels(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``label``: 1 where the host has one of BAD_WORDS."""
    return urls.withColumn("label", host_and_path(F.col(url_col))[0].rlike("|".join(BAD_WORDS)).cast("int"))


def op1_url_filter(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """Judges every page's url. ``labelled(url, label)`` is learnt from; pages have no labels, so without it they get weak ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_urls(weak_labels(pages.select("url")) if labelled is None else labelled)))
