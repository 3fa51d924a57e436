"""Operator 13, URL filters: rules first, gradient-boosted trees for the rest. DataFrame functions only.

Rules judge the URLs they fit. The URLs they judge are also the labelled examples: trees over lexical features
(lengths, depth, digits, entropy, parameters, statistics of the host's suffix and of the first folder) learn to tell allowed from blocked
URLs and judge those that no rule fits.

Boosting needs sums of gradients only. A level of a tree is one aggregation by node, feature and bin, of which the
driver reads a few hundred numbers. Gradients are whole numbers, so that their sums, and with them the model, do not
depend on the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.rows import replacing, unit
from corpuslake.session import cut_lineage

#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SEED = "url-1"
#: Expected number of labelled URLs that the trees are fitted on; with fewer, all of them.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 8, 3, 16, 0.5, 1.0
#: The bin of a node without a split: no row lies above it.
NO_SPLIT = 1 << 20
#: Undecided examples added to the judged URLs of a suffix or folder.
PRIOR = 20
#: Gradients are counted in steps of this size.
GRAIN = 1 << 20
FEATURES = ("url_chars", "host_chars", "path_chars", "labels", "depth", "digits", "entropy", "params", "suffix_chars",
            "suffix_urls", "suffix_allowed", "folder_urls", "folder_allowed")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> Column:
    """What follows the first `://`; empty for null and for texts without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(address: Column) -> Column:
    """Up to `/`, `?`, `#` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(address, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(address: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null. A rule fits its host and all subdomains of it if the path starts with
    the rule's path. Of rules of one length the one with the longer host wins, then the first in text order."""
    def cut(rule: str) -> tuple[str, str]:
        host, slash, path = rule.partition("/")
        return host, slash + path

    def fits(rule: str) -> Column:
        of, start = cut(rule)
        inside = (host == of) | host.endswith("." + of)
        return (inside & path.startswith(start)) if start else inside

    if len({rule for _, rule in rules}) < len(rules):
        raise ValueError("a rule is given twice")
    order = sorted((rule for _, rule in rules), key=lambda r: (-len(r), -len(cut(r)[0]), r))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(rule), F.lit(rule)) for rule in order])


def entropy_of(text: Column) -> Column:
    """Entropy of the UTF-8 bytes of a text in thousandths of a bit: sorted bytes form runs, whose lengths are counted."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    runs = F.regexp_extract_all(F.array_join(F.array_sort(pairs), " "), F.lit(r"([0-9A-F]{2})(?: \1)*"), F.lit(0))
    sizes = F.transform(runs, lambda r: ((F.length(r) + 1) / 3).cast("double"))
    total = F.octet_length(text).cast("double")
    bits = F.aggregate(sizes, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))
    return F.when(total > 0, F.round(bits * 1000)).otherwise(F.lit(0)).cast("bigint")


def lexical(url: Column, address: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of one URL, all whole numbers. Empty texts give zeros."""
    chars = F.length(url)
    ratio = F.floor(F.regexp_count(url, F.lit("[0-9]")) * 1000 / F.greatest(chars, F.lit(1)))
    asked = F.regexp_extract(address, r"^[^?#]*\?([^#]*)", 1)
    features = {"url_chars": chars, "host_chars": F.length(host), "path_chars": F.length(path),
                "labels": F.regexp_count(host, F.lit(r"[^.]+")), "depth": F.regexp_count(path, F.lit("[^/]+")),
                "digits": ratio, "entropy": entropy_of(url), "params": F.regexp_count(asked, F.lit("[^&]+"))}
    return {name: value.cast("bigint") for name, value in features.items()}


def suffix_of(host: Column) -> Column:
    """The last label of a host, without a port."""
    return F.regexp_extract(F.regexp_replace(host, ":[0-9]*$", ""), r"[^.]*$", 0)


@dataclass
class Tree:
    """A full binary tree in heap order: node i has the branches 2 i + 1 (not above the edge) and 2 i + 2."""
    feature: list[int]
    bin: list[int]
    value: list[float]  # of the leaves

    def sql(self) -> str:
        """As a value of Spark: the generated code then does not change from tree to tree."""
        lists = [", ".join(map(str, x)) for x in (self.feature, self.bin)] + [", ".join(f"{x!r}D" for x in self.value)]
        return f"named_struct('f', array({lists[0]}), 'b', array({lists[1]}), 'v', array({lists[2]}))"

    def column(self, names: Sequence[str], edges: Sequence[list[int]], node: int = 0) -> Column:
        inner = len(self.feature)
        if node >= inner:
            return F.lit(self.value[node - inner])
        below, above = (self.column(names, edges, 2 * node + side) for side in (1, 2))
        if self.bin[node] == NO_SPLIT:
            return below
        f = self.feature[node]
        return F.when(F.col(names[f]) > F.lit(edges[f][self.bin[node]]), above).otherwise(below)


def place(tree: str, levels: int) -> str:
    """The node that a row with the bins `x` reaches after `levels` steps, as SQL."""
    return f"aggregate(sequence(1, {levels}), 0, (i, l) -> 2 * i + 1 + CAST(x[{tree}.f[i]] > {tree}.b[i] AS INT))" if levels else "0"


@dataclass(frozen=True)
class Model:
    """Log odds that a URL is allowed."""
    start: float
    trees: tuple[Tree, ...]
    names: tuple[str, ...]
    edges: tuple[list[int], ...]

    def column(self) -> Column:
        return reduce(lambda total, tree: total + tree.column(self.names, self.edges), self.trees, F.lit(self.start))


def featured(urls: DataFrame, rules: Sequence[tuple[str, str]], url: str) -> DataFrame:
    """`urls` with host, path, rule, label (1 allowed, 0 blocked, null without a rule) and all features.

    Statistics of a suffix and of a folder (the first part of the path) cover all rows: how many URLs have it, and
    which share of the judged ones is allowed, in twentieths. `PRIOR` undecided examples are added, so that a folder
    with a few judged URLs does not give their label away. The tables are written first, so each is broadcast only if
    it is small, else joined by a shuffle whose large partitions are split.
    """
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rows = urls.withColumn("__address", address(text))
    rows = rows.withColumn("__host", host_of(F.col("__address"))).withColumn("__path", path_of(F.col("__address")))
    rows = rows.withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules)).withColumn("__suffix", suffix_of(F.col("__host")))
    rows = rows.withColumn("__folder", F.regexp_extract("__path", "^/([^/]*)", 1))
    allowed = [rule for verdict, rule in rules if verdict == "allow"]
    rows = rows.withColumn("__label", F.when(F.col("__rule").isNotNull(), F.col("__rule").isin(allowed).cast("int")))
    found = lexical(text, F.col("__address"), F.col("__host"), F.col("__path"))
    found["suffix_chars"] = F.length("__suffix").cast("bigint")
    out = rows.withColumns({"__" + name: value for name, value in found.items()}).drop("__address")
    for of in ("suffix", "folder"):
        counts = rows.groupBy(F.col(f"__{of}").alias("__of")).agg(
            F.count(F.lit(1)).alias("n"), F.count("__label").alias("judged"), F.coalesce(F.sum("__label"), F.lit(0)).alias("allowed"))
        share = F.floor((F.col("allowed") + PRIOR // 2) * 20 / (F.col("judged") + PRIOR) + 0.5).cast("bigint")
        counts = counts.select("__of", F.length(F.bin("n")).cast("bigint").alias(f"__{of}_urls"), share.alias(f"__{of}_allowed"))
        counts = cut_lineage(counts, f"url-{of}")
        out = out.join(counts, out[f"__{of}"] == counts["__of"]).drop("__of")
    return out


def learn(rows: DataFrame, url: str, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: str = SEED) -> Model:
    """Boosted trees on the labelled URLs of `rows` (as `featured` gives them), each distinct URL once.

    With more than `sample` labelled URLs, those with the smallest hashes are used, `sample` of them on average. Without
    labels every score is 0. Ties between splits go to the first feature in the list, then to the lowest edge.
    """
    names = tuple("__" + f for f in FEATURES)
    labelled = rows.where(F.col("__label").isNotNull()).select(F.col(url).alias("__url"), F.col("__label").alias("label"), *names)
    labelled = cut_lineage(labelled.dropDuplicates(["__url"]), "url-labelled")
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(unit(F.md5(F.concat(F.lit(seed + "|"), F.col("__url")))) < F.lit(sample / n))
    steps = [F.lit(i / BINS) for i in range(1, BINS)]
    cuts = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("allowed"),
                        *[F.percentile(f, F.array(*steps)).alias(f) for f in names]).first()
    if not cuts["n"]:
        return Model(0.0, (), names, ())
    edges = tuple(sorted({math.floor(x) for x in cuts[f]}) for f in names)
    start = math.log((cuts["allowed"] + 0.5) / (cuts["n"] - cuts["allowed"] + 0.5))
    x = F.array(*[reduce(lambda total, e: total + (F.col(f) > F.lit(e)).cast("int"), mine, F.lit(0)) for f, mine in zip(names, edges)])
    cells = cut_lineage(labelled.groupBy("label", x.alias("x")).agg(F.count(F.lit(1)).alias("n")), "url-cells")

    grown: list[Tree] = []
    for _ in range(trees):
        known = ", ".join(t.sql() for t in grown)
        score = f"aggregate(array({known}), {start!r}D, (a, t) -> a + t.v[{place('t', depth)} - {2 ** depth - 1}])" if grown else f"{start!r}D"
        scored = cells.selectExpr("x", "label", "n", f"1.0D / (1.0D + exp(-({score}))) AS p")
        scored = scored.selectExpr("x", f"CAST(round((label - p) * {GRAIN}) AS BIGINT) * n AS g", f"CAST(round(p * (1 - p) * {GRAIN}) AS BIGINT) * n AS h")
        tree = Tree([0] * (2 ** depth - 1), [NO_SPLIT] * (2 ** depth - 1), [0.0] * 2 ** depth)
        for level in range(depth):
            at = scored.selectExpr(f"transform(array({tree.sql()}), t -> {place('t', level)})[0] AS node", "posexplode(x) AS (f, bin)", "g", "h")
            sums = at.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            totals = _grow(tree, level, [tuple(r) for r in sums], edges)
        for node, (g, h) in totals.items():
            tree.value[node - len(tree.feature)] = RATE * (g / GRAIN) / (h / GRAIN + SMOOTH)
        grown.append(tree)
    return Model(start, tuple(grown), names, edges)


def _grow(tree: Tree, level: int, sums: list[tuple], edges: Sequence[list[int]]) -> dict[int, tuple]:
    """Split every node of a level where that gains most; returns gradient and curvature of the nodes of the next one.

    A node that no split improves hands all its rows to the lower branch.
    """
    def worth(g: int, h: int) -> float:
        return (g / GRAIN) ** 2 / (h / GRAIN + SMOOTH)

    below: dict[int, tuple] = {}
    for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
        bins = {(f, b): (g, h) for at, f, b, g, h in sums if at == node}
        g_all = sum(g for (f, _), (g, _) in bins.items() if f == 0)
        h_all = sum(h for (f, _), (_, h) in bins.items() if f == 0)
        best, choice = 1e-6, None
        for f, mine in enumerate(edges):
            g = h = 0
            for b in range(len(mine)):
                more = bins.get((f, b), (0, 0))
                g, h = g + more[0], h + more[1]
                gain = worth(g, h) + worth(g_all - g, h_all - h) - worth(g_all, h_all)
                if 0 < h < h_all and gain > best + 1e-9:
                    best, choice = gain, (f, b, g, h)
        f, b, g, h = choice or (0, NO_SPLIT, g_all, h_all)
        tree.feature[node], tree.bin[node] = f, b
        below[2 * node + 1], below[2 * node + 2] = (g, h), (g_all - g, h_all - h)
    return below


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Every row of `df` with `host`, `path`, `rule`, `verdict` (allow or block) and `score` (log odds of the trees).

    A rule that fits decides; else a score of at least 0 allows. A null URL or one without `://` has an empty host and
    path, so no rule fits and the trees judge it; equal URLs get equal verdicts; without any labelled URL all scores
    are 0; an empty table gives an empty result; URLs of any length are read whole; input columns with the names of
    the added ones are replaced.
    """
    added = ["host", "path", "rule", "verdict", "score"]
    row = F.struct(*[F.col(c) for c in df.columns], F.lit(0).alias("__")).alias("__row")
    rows = featured(df.select(row, F.col(url).alias("__url")), rules, "__url")
    model = learn(rows, "__url", sample)
    verdicts = [F.when(F.col("__rule").isin([r for v, r in rules if v == verdict]), F.lit(verdict)) for verdict in ("allow", "block")]
    judged = rows.withColumn("__score", model.column())
    keep = replacing(df.columns, added)
    return judged.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], F.col("__host").alias("host"), F.col("__path").alias("path"),
                         F.col("__rule").alias("rule"),
                         F.coalesce(*verdicts, F.when(F.col("__score") >= 0, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
                         F.col("__score").alias("score"))


@query("op13_boosted_url_filter")
def op13_boosted_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filter_urls(table(spark, sf, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
