"""URL filters: path rules, then a naive Bayes verdict over segmented host and path words.

Letter runs of hosts and paths (lower case, any script; digits and signs separate them) are split
into words by a unigram Viterbi. Its model is counted in Spark over the whole table: the words of the
paths and, where there is an ``html`` column, of the pages' texts, mixed half and half with a small
seed list, so that it doesn't change with the table's size. A name is not a word only because it is a
host's.

A multinomial naive Bayes then scores the words of every URL. It learns from the table itself: the
rows that a rule decides are its labelled examples, without the host suffix and path by which the
rule decided. Its class frequencies are mixed half and half with those of two generic seed lists and
smoothed by the frequency of a word in both classes, so a word that neither has seen says nothing.

Defined cases: a null URL or one without ``://`` has an empty host and path, no words, and so the
prior's verdict (allow); hosts and paths of any length are scored whole; repeated rows are judged
one by one; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import cut, skew_join, table


@dataclass(frozen=True)
class PathRule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    PathRule("com", "/en/", "block"),
    PathRule("example.com", "/en/7", "allow"),
    PathRule("net", "/de/", "allow"),
    PathRule("example.net", "/de/8", "block"),
    PathRule("org", "/es/", "block"),
)

#: Share of the seed lists in the word model and in each class of the classifier.
SEED_SHARE = 0.5
#: Share of the frequency in both classes in a class's frequencies.
BACKGROUND = 0.1
#: Letters of the longest substring that is looked up as a word; a whole run is one of any length.
LONGEST_WORD = 32
#: An unknown word of n letters has probability UNKNOWN / 4**n.
UNKNOWN = 0.01
#: Common English words of unwanted and wanted sites' names.
BLOCK_SEEDS = (
    "casino poker slots jackpot roulette betting gambling lottery", "porn xxx sex nude escort adult", "viagra pharmacy pills diet miracle", "replica watches discount",
    "warez crack keygen torrent", "spam phishing malware popup", "payday loan cash",
)
ALLOW_SEEDS = (
    "news world article", "blog post author", "wiki page", "docs guide reference", "university research paper", "library books archive", "weather city report", "recipe kitchen food",
    "school history health science", "journal data travel map", "music review sport match", "open source code", "government public service", "museum art garden", "software forum photo",
)
PRIOR_BLOCK = 0.2


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path and the longest rule that fits, with its verdict (else nulls)."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):  # the last that fits, and so the longest, is outermost
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(str(r))).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "rule_verdict": verdict})


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _seed_counts(seeds: tuple[str, ...]) -> Counter:
    return Counter(w for s in seeds for w in s.split())


def unigrams(pages: DataFrame, base: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """(word, p): the word model over paths, page texts and seeds."""
    texts = [base.select(F.explode(_runs(F.col("path"))).alias("word"))]
    if "html" in pages.columns:
        texts.append(pages.select(F.explode(_runs(F.regexp_replace("html", "<[^>]*>", " "))).alias("word")))
    counts = reduce(DataFrame.unionByName, texts).groupBy("word").agg(F.count("*").alias("n"))
    counts = cut(counts)
    total, seeded = counts.agg(F.sum("n")).first()[0], _seed_counts(seeds)
    share = SEED_SHARE if total and seeded else float(bool(seeded))
    parts = []
    if total:
        parts.append(counts.select("word", (F.col("n") * ((1 - share) / total)).alias("p")))
    if seeded or not parts:
        rows = [(w, share * k / seeded.total()) for w, k in seeded.items()]
        parts.append(base.sparkSession.createDataFrame(rows, "word string, p double"))
    return reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("p").alias("p"))


def segment(name: str, known: dict[str, float]) -> list[str]:
    """The most probable split of ``name`` into words; ties prefer the longer last word. Of the
    word probabilities ``known`` only those of words in ``name`` matter."""
    sizes = sorted({len(w) for w in known}, reverse=True)
    four, new = math.log(4.0), math.log(UNKNOWN)
    best, back = [0.0], [0]
    free = 0  # where the best unknown last word starts
    for end in range(1, len(name) + 1):
        score, start = best[free] + new - (end - free) * four, free
        for size in sizes:
            p = known.get(name[end - size : end]) if size <= end else None
            if p:
                value = best[end - size] + math.log(p)
                if (value, size) > (score, end - start):
                    score, start = value, end - size
        best.append(score)
        back.append(start)
        if score > best[free] - (end - free) * four:
            free = end
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, word) with one row a word of the best split of each distinct ``label``."""
    sized = labels.select("label", F.length("label").alias("size"))
    starts = sized.select("label", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.col("size") - F.col("start") + 1))
    parts = starts.select("label", "start", F.explode(lengths).alias("n")).select("label", F.substring("label", F.col("start"), F.col("n")).alias("word")).unionByName(labels.select("label", F.col("label").alias("word")))
    known = parts.distinct().join(words, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "p"))).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            split_ = [segment(x, dict(k or ())) for x, k in zip(names, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split_, pa.list_(pa.string()))], names=["label", "words"])

    return labels.join(known, "label", "left").select("label", "known").mapInArrow(split, "label string, words array<string>").select("label", F.explode("words").alias("word"))


def word_weights(examples: DataFrame, block: tuple[str, ...] = BLOCK_SEEDS, allow: tuple[str, ...] = ALLOW_SEEDS) -> DataFrame:
    """(word, weight): log odds of block of every word, from its numbers of uses in examples of both
    classes (word, n_block, n_allow) and the seed lists."""
    seeds = [_seed_counts(block), _seed_counts(allow)]
    seeded = examples.sparkSession.createDataFrame([(w, float(seeds[0][w]), float(seeds[1][w])) for w in sorted({*seeds[0], *seeds[1]})], "word string, s_block double, s_allow double")
    totals = examples.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_block", "n_allow")]).first()
    both = examples.join(seeded, "word", "full").na.fill(0)
    mixed = []
    for side, seed in zip(("block", "allow"), seeds, strict=True):
        share = SEED_SHARE if totals[f"n_{side}"] and seed else float(bool(seed))
        mixed.append(F.col(f"n_{side}") * ((1 - share) / max(1, totals[f"n_{side}"])) + F.col(f"s_{side}") * (share / max(1, seed.total())))
    usual = (mixed[0] + mixed[1]) / 2
    odds = [F.log((1 - BACKGROUND) * m + BACKGROUND * usual) for m in mixed]
    return both.select("word", (odds[0] - odds[1]).alias("weight"))


def _labels(host: Column, path: Column) -> Column:
    """Letter runs of a host without its last label, which is the registry's and not the owner's, and of a path."""
    owner = F.coalesce(F.nullif(F.regexp_extract(host, r"(?s)^(.*)\.", 1), F.lit("")), host)
    return F.concat(_runs(owner), _runs(path))


def url_filter(pages: DataFrame, rules=RULES, block=BLOCK_SEEDS, allow=ALLOW_SEEDS, prior: float = PRIOR_BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict and the classifier's log odds ``score``."""
    base = cut(with_rules(pages, rules).withColumn("__row", F.monotonically_increasing_id()))
    tokens = base.select("__row", F.explode(_labels(F.col("host"), F.col("path"))).alias("label"))
    # what a rule looks at is no example of what else it may mean
    free_host = F.expr("substring(host, 1, length(host) - length(regexp_extract(rule, '^([^/]*)', 1)))")
    free = F.concat(_runs(free_host), _runs(F.expr("substring(path, length(regexp_extract(rule, '^[^/]*(.*)$', 1)) + 1)")))
    examples = base.filter("rule_verdict IS NOT NULL").select("rule_verdict", F.explode(free).alias("label"))
    examples = examples.groupBy("label").agg(F.count_if(F.col("rule_verdict") == "block").alias("n_block"), F.count_if(F.col("rule_verdict") == "allow").alias("n_allow"))
    uses = cut(tokens.groupBy("label").agg(F.count("*").alias("n")))
    names = uses.select("label").unionByName(examples.select("label")).distinct()
    split = cut(segmented(names, unigrams(pages, base, (*block, *allow))))
    counted = split.join(examples, "label").groupBy("word").agg(F.sum("n_block").alias("n_block"), F.sum("n_allow").alias("n_allow"))
    weights = split.join(word_weights(cut(counted), block, allow), "word").groupBy("label").agg(F.sum("weight").alias("weight"))
    weighed = cut(uses.join(weights, "label"))  # a label such as www is in a large part of the rows
    found = skew_join(tokens, weighed, "label", uses.agg(F.sum("n")).first()[0] or 0).groupBy("__row").agg(F.sum("weight").alias("weight"))
    scored = base.join(found, "__row", "left").withColumn("score", F.round(F.lit(math.log(prior / (1 - prior))) + F.coalesce("weight", F.lit(0.0)), 9))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
