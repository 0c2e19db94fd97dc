"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over one row, so the whole operator is a single scan
without a shuffle and without Python. A null text counts as an empty one. Any further columns
of the input are ignored; repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import WORD, table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "for", "it", "on",
    "le", "la", "les", "de", "des", "et", "que", "un", "une", "en", "pour", "est", "dans",
    "der", "die", "das", "und", "zu", "mit", "von", "den", "ist", "ein", "eine", "nicht", "auf",
    "el", "los", "las", "del", "y", "para", "con", "por", "no", "una", "al", "se",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a bound of None is open. A document that breaks any rule goes."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("stop_words", 2, None),
    Rule("alphabetic_words", 0.7, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


#: A word without any letter, with the white space (or start) before it.
_NO_LETTER = r"(?:^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$(?!\n))"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``: a lambda variable is
    not inlined by the optimizer, unlike a projected column."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Low bits of a packed window that hold its index; texts of more words take the plain path.
_INDEX_BITS = 24


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, in two steps: sorted 64-bit
    values (window hash in the high bits, index in the low ones) leave the few windows that
    share a hash with another; sorting those by their words then finds the true repeats, and
    the sorted starts give the size of their union. A hash only skips work, it decides nothing."""
    n = F.size(words)

    def candidates(_: Column) -> Column:
        mask = (1 << _INDEX_BITS) - 1
        packed = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")),
        )

        def shared(p: Column) -> Column:
            high = F.transform(p, lambda x: F.shiftright(x, _INDEX_BITS))
            return bind(high, lambda h: F.filter(
                F.transform(p, lambda x, k: F.when(F.get(h, k).eqNullSafe(F.get(h, k + 1)) | ((k > 0) & F.get(h, k).eqNullSafe(F.get(h, k - 1))), x.bitwiseAND(F.lit(mask)).cast("int"))),
                lambda x: x.isNotNull(),
            ))

        return bind(F.sort_array(packed), shared)

    def repeats(at: Column) -> Column:
        windows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
        return F.when(F.size(at) > 0, bind(bind(F.sort_array(windows), _equal_neighbours), _union)).otherwise(F.lit(0))

    few = F.lit(1 << _INDEX_BITS)
    every = F.sequence(F.lit(0), n - 3)
    return F.when(n < 4, F.lit(0)).otherwise(bind(F.when(n < few, candidates(n)).otherwise(every), repeats)).cast("long")


def _equal_neighbours(s: Column) -> Column:
    """The sorted starts of the windows that equal a neighbour in the sorted list ``s``."""
    same = lambda a, b: F.get(s, a)["w"].eqNullSafe(F.get(s, b)["w"])
    kept = F.transform(s, lambda x, k: F.when(same(k, k + 1) | ((k > 0) & same(k, k - 1)), x["i"]))
    return F.sort_array(F.filter(kept, lambda x: x.isNotNull()))


def _union(r: Column) -> Column:
    """The number of words in the union of the windows that start at ``r`` (sorted)."""
    gaps = F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    text = F.coalesce(text, F.lit(""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

        def with_lines(s: Column) -> Column:
            n, chars = F.size(words).cast("long"), F.length(F.concat_ws("", words)).cast("long")
            symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
            n_lines = F.size(s).cast("long")
            dup = n_lines - F.size(F.array_distinct(s)).cast("long")
            count = lambda p: F.size(F.filter(s, lambda x: x.rlike(p)))
            return F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                dup.alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                _share(chars.cast("double"), n).alias("mean_word_chars"),
                _share(symbols.cast("double"), n).alias("symbols_per_word"),
                F.size(F.array_intersect(words, stop)).alias("stop_words"),
                _share((n - F.regexp_count(text, F.lit(_NO_LETTER))).cast("double"), n).alias("alphabetic_words"),
                _share(dup.cast("double"), n_lines).alias("dup_line_ratio"),
                _share(count(r"^\s*[-*•]").cast("double"), n_lines).alias("bullet_line_ratio"),
                _share(count(r"(\.\.\.|…)\s*$").cast("double"), n_lines).alias("ellipsis_line_ratio"),
            )

        return bind(lines, with_lines)

    return bind(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), of)


def passes(measured: Column, rules=RULES) -> Column:
    """The verdict of a rule table over the struct of :func:`measures`."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (measured[r.measure] >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (measured[r.measure] <= F.lit(r.high))
    return ok


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every document: the measures, ``base_failed`` and ``kept``.

    An empty or null text has zero of everything and fails the base rule of 50 words.
    """
    m = F.col("m")
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return (
        docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
        .select("doc_id", "m.*", base.alias("base_failed"), (~base & passes(m, rules)).alias("kept"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bound = {"symbols_per_word": "n_symbols::DOUBLE / n_words", "mean_word_chars": "word_chars::DOUBLE / n_words", "stop_words": "stop_words", "alphabetic_words": "alpha::DOUBLE / n_words",
             "dup_line_ratio": "n_dup_lines::DOUBLE / n_lines", "bullet_line_ratio": "bullets::DOUBLE / n_lines", "ellipsis_line_ratio": "dots::DOUBLE / n_lines"}
    tests = [f"{bound[r.measure]} >= {r.low}" for r in RULES if r.low is not None] + [f"{bound[r.measure]} <= {r.high}" for r in RULES if r.high is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{word}') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS t FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
ln AS (SELECT rid, l, regexp_matches(l, '{word}') AS has FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
  count(*) FILTER (WHERE regexp_matches(l, '^\s*[-*\x{{2022}}]')) AS bullets, count(*) FILTER (WHERE regexp_matches(l, '(\.\.\.|\x{{2026}})\s*$')) AS dots
  FROM ln WHERE has GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lc.n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lc.n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots,
  len(list_intersect(list_distinct(ws), [{stop}])) AS stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS alpha
  FROM w LEFT JOIN lc USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {" AND ".join(tests)} END AS kept FROM b"""


ORACLE_SQL = _sql()
