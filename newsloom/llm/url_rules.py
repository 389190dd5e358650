"""URL filter: given host and path rules first, mined association rules for all other pages.

FP-growth runs on the tokens of labelled URLs together with an item for the label.  Tokens that occur in
exactly the same URLs are one item, and a token that only bad URLs have is a rule at once, since no
combination with it can be surer; neither is left to multiply combinations.  Rules from token combinations
to the label are pruned by support, confidence and lift, and dropped when a part of their tokens says the
same at least as surely.  The remaining rules form an inverted index from their rarest
token; every page looks up its own tokens and checks the few rules found there, all inside one native
expression without a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from newsloom.llm.common import kept_table
from newsloom.session import bounded_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"

# fixed values: (verdict, host, path) of the contract
GIVEN_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=GIVEN_RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null.  A rule fits its host and subdomains."""
    out = F.when(F.lit(False), F.lit(None))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = out.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, parts of hyphened labels, path segments without numbers, query keys."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(text), path_of(text)
    scheme = F.regexp_extract(text, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    segments = F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/")
    keys = F.transform(F.split(query, "&"), lambda pair: F.split(pair, "=")[0])

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(mark), x))

    return F.array_distinct(
        F.concat(
            marked("scheme:", F.array(F.lower(scheme))),
            marked("host:", labels),
            marked("word:", words),
            marked("path:", segments),
            marked("key:", keys),
        )
    )


@dataclass(frozen=True)
class MinedRule:
    """``tokens`` that have to be in a URL; any other token of the same set in ``alike`` stands for its own."""

    tokens: tuple[str, ...]
    confidence: float
    support: float
    alike: tuple[tuple[str, ...], ...] = ()

    @property
    def groups(self) -> list[list[str]]:
        return [list(next((a for a in self.alike if token in a), (token,))) for token in self.tokens]


def mine_rules(
    pages: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    min_support: float = 0.002,
    min_pages: int = 10,
    min_confidence: float = 0.6,
    min_lift: float = 1.5,
) -> list[MinedRule]:
    """Rules that name pages to block, from at most ``sample`` labelled pages (smallest hash of the id).

    A page is bad when its label has quality 0 or toxic 1; labels join on page_id = doc_id.  All rules that
    pass and are not redundant form the index, in order of confidence, then support.  A combination has to
    occur in ``min_pages`` pages, however small the sample is.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    chosen = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(bad).alias("_bad"))
    urls = pages.where("url IS NOT NULL").select(F.col("page_id").alias("_id"), "url")
    joined = urls.join(chosen, "_id").orderBy(F.xxhash64("_id"), "_id", "url").limit(sample)
    numbered = joined.select("_bad", url_tokens(F.col("url")).alias("tokens"), F.monotonically_increasing_id().alias("basket"))
    baskets = kept_table(numbered, "baskets")
    n, n_bad = baskets.agg(F.count("*"), F.count_if("_bad")).first()
    if n < min_pages or not n_bad:
        return []
    least = max(min_support, min_pages / n)
    classes = kept_table(_token_classes(baskets, -(-least * n // 1)), "classes")
    sure = (F.col("n_bad") == F.col("n")) & F.lit(n / n_bad >= min_lift)
    rules = [MinedRule((r.members[0],), 1.0, r.n / n, (tuple(r.members),)) for r in classes.where(sure).collect()]
    # frequent tokens that good URLs have too; a basket keeps one item of each class
    items = classes.where(~sure).select(F.explode("members").alias("token"), F.col("members")[0].alias("item"))
    found = baskets.select("basket", F.explode("tokens").alias("token")).join(bounded_broadcast(items), "token")
    mixed = found.groupBy("basket").agg(F.collect_set("item").alias("items"))
    label = F.when(F.col("_bad"), F.lit(BLOCK)).otherwise(F.lit("label:none"))
    mixed = baskets.join(mixed, "basket").select(F.array_append("items", label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(_all_baskets(mixed, baskets))
    sets = kept_table(model.freqItemsets.where(~F.array_contains("items", "label:none")), "itemsets")
    combined = _least_rules(sets, n, min_confidence, min_lift)
    wanted = sorted({t for r in combined for t in r.tokens})
    alike = {r.members[0]: tuple(r.members) for r in classes.where(F.col("members")[0].isin(wanted)).collect()} if wanted else {}
    rules += [MinedRule(tuple(r.tokens), r.confidence, r.support, tuple(alike[t] for t in r.tokens)) for r in combined]
    return sorted(rules, key=lambda r: (-r.confidence, -r.support, r.tokens))


def _token_classes(baskets: DataFrame, least: float) -> DataFrame:
    """``members, n, n_bad`` of sets of tokens that occur in the same baskets, ``least`` of them or more.

    Baskets are compared by two sums of hashes of their numbers.
    """

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64("basket", F.lit(seed)).cast("decimal(20,0)"))

    tokens = baskets.select("basket", "_bad", F.explode("tokens").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_if("_bad").alias("n_bad"), total(1).alias("a"), total(2).alias("b"))
    frequent = counted.where(F.col("n") >= least)
    return frequent.groupBy("n", "n_bad", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("members")).drop("a", "b")


def _all_baskets(mixed: DataFrame, baskets: DataFrame) -> DataFrame:
    """Baskets without any frequent mixed token count as well: support is a share of all."""
    empty = baskets.count() - mixed.count()
    spark = mixed.sparkSession
    return mixed.unionByName(spark.range(empty).select(F.array(F.lit("label:none")).alias("items"))) if empty else mixed


def _least_rules(sets: DataFrame, n: int, min_confidence: float, min_lift: float) -> list[Row]:
    """Passing rules (tokens, confidence, support) from all frequent sets of ``n`` baskets (items, freq).

    A rule goes when a proper part of its tokens passes with at least its confidence.  Parts of a frequent
    set are frequent, so sets learn level by level, from those with one token less, the best confidence
    of all their parts that pass.
    """
    blocked = F.array_contains("items", BLOCK)
    share = sets.where(blocked & (F.size("items") == 1)).select("freq").first()
    if share is None:
        return []
    both = sets.where(blocked & (F.size("items") > 1)).select(
        F.array_sort(F.array_remove("items", BLOCK)).alias("tokens"), F.col("freq").alias("both")
    )
    alone = sets.where(~blocked).select(F.array_sort("items").alias("tokens"), "freq")
    sure = F.col("both") / F.col("freq")
    passes = (sure >= min_confidence) & (sure / (share.freq / n) >= min_lift)
    combinations = both.join(alone, "tokens").select(
        "tokens", sure.alias("confidence"), (F.col("both") / n).alias("support"), passes.alias("passes")
    )
    combinations = kept_table(combinations, "combinations")
    smallest, largest = combinations.where("passes").select(F.min(F.size("tokens")), F.max(F.size("tokens"))).first()
    if smallest is None:
        return []
    best, levels = None, []
    for k in range(smallest, largest + 1):
        level = combinations.where(F.size("tokens") == k)
        if best is None:
            level = level.withColumn("below", F.lit(None).cast("double"))
        else:
            without = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.slice("tokens", 1, i - 1), F.slice("tokens", i + 1, k)))
            parts = level.select("tokens", F.explode(without).alias("part")).join(best, "part")
            level = level.join(parts.groupBy("tokens").agg(F.max("best").alias("below")), "tokens", "left")
        level = kept_table(level, "rules")
        levels.append(level.where("passes AND (below IS NULL OR below < confidence)").select("tokens", "confidence", "support"))
        # null while nothing below passes
        held = F.greatest("below", F.when(F.col("passes"), F.col("confidence")))
        best = level.select(F.col("tokens").alias("part"), held.alias("best")).where("best IS NOT NULL")
    return [row for level in levels for row in level.collect()]


def inverted_index(rules: list[MinedRule]) -> Column:
    """Constant map: every token of the rarest set of a rule (rarest among the rules) to the sets to check."""
    uses: dict[str, int] = {}
    for rule in rules:
        for token in rule.tokens:
            uses[token] = uses.get(token, 0) + 1
    index: dict[str, list[list[list[str]]]] = {}
    for rule in rules:
        groups = rule.groups
        rarest = min(range(len(groups)), key=lambda i: (uses[rule.tokens[i]], rule.tokens[i]))
        rest = groups[:rarest] + groups[rarest + 1 :]
        for token in groups[rarest]:
            index.setdefault(token, []).append(rest)
    return F.from_json(F.lit(json.dumps(index)), "map<string, array<array<array<string>>>>")


def mined_block(tokens: Column, rules: list[MinedRule]) -> Column:
    """True when some mined rule has a token of each of its sets among ``tokens``."""
    if not rules:
        return F.lit(False)
    index = inverted_index(rules)

    def fits(rule: Column) -> Column:
        return F.forall(rule, lambda group: F.arrays_overlap(group, tokens))

    return F.exists(tokens, lambda t: F.coalesce(F.exists(F.element_at(index, t), fits), F.lit(False)))


def judge_urls(pages: DataFrame, mined: list[MinedRule], given=GIVEN_RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict; columns of these names are replaced.

    A null URL, or one without ``://``, has empty host and path and no rule, so the mined rules decide;
    without a match a page is allowed.  Rows are judged one by one, so repeated rows stay repeated.
    """
    url = F.col(url_col)
    fitting = given_rule(F.col("host"), F.col("path"), given)
    mined_verdict = F.when(mined_block(url_tokens(url), mined), F.lit("block")).otherwise(F.lit("allow"))
    return (
        pages.withColumns({"host": host_of(url), "path": path_of(url)})
        .withColumn("_fit", fitting)
        .withColumns({"rule": F.col("_fit.rule"), "verdict": F.coalesce(F.col("_fit.verdict"), mined_verdict)})
        .drop("_fit")
    )
