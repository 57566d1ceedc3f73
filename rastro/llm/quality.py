"""Quality rules: a table of thresholds compiled into one projection.

Each measure is a Column over a text's words and lines; a rule is a measure with its least and greatest value.
:func:`judge` computes the measures and compiles all rules of the table into two expressions, the failed
rules' names and the verdict. No user function runs, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.llm.common import SPACE, read

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    greatest: float | None = None


#: Frequent words of the corpus' languages.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "im", "für", "auf", "ein", "eine", "nicht", "sich", "des", "dem", "als", "auch"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "are", "this", "by", "from", "at", "have"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec", "pas"],
}

#: The base of the contract comes first; a text that fails it is not kept whatever the others say.
BASE = (Rule("too_few_words", "n_words", least=20), Rule("repeated_words", "repeat_percent", greatest=30))
RULES = (
    Rule("word_length", "mean_word_chars", least=2, greatest=14),
    Rule("symbols", "symbols_per_word", greatest=0.3),
    Rule("stop_words", "stop_percent", least=2),
    Rule("repeated_lines", "dup_line_percent", greatest=60),
    Rule("letters", "letter_word_percent", least=60),
    Rule("bullets", "bullet_line_percent", greatest=90),
    Rule("ellipses", "ellipsis_line_percent", greatest=30),
    Rule("capitals", "capital_percent", greatest=60),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in a window of ``n`` words found twice or more in the text.

    Windows are compared by 64-bit hashes. Most texts repeat none, which one distinct shows; the others sort
    their windows, so that equal ones stand side by side, and add up the stretches covered.
    """
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("bigint"),
                           lambda sum_, k: sum_ + F.when(k == last, F.lit(n)).otherwise(F.least(F.lit(n), F.get(places, k + 1) - F.get(places, k))))

    def sorted_places(windows_: Column) -> Column:
        ranked = F.sort_array(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(ranked, lambda r: F.sort_array(F.transform(F.filter(r, lambda x, k: (F.coalesce(F.get(r, k - 1)["h"] == x["h"], F.lit(False)))
                                                                        | (F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))

    def count(windows_: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows_)) == F.size(windows_), F.lit(0).cast("bigint")).otherwise(_let(sorted_places(windows_), covered))

    return F.when(F.size(words) < n, F.lit(0).cast("bigint")).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(windows(hashes), count)))


def _share(part: Column, whole: Column) -> Column:
    """Per cent, 0 of nothing."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("bigint")


def measures(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = ("_text", "_words", "_lines")) -> DataFrame:
    """Adds the measures to the documents' columns; columns of the same names are replaced. A null text has no words."""
    text, words, lines = (F.col(n) for n in names)
    stop = sorted({w for group in STOP_WORDS.values() for w in group})
    has_word = lambda x: x.rlike(f"[^{SPACE}]")
    counted = (docs.withColumn(names[0], F.coalesce(F.col(text_col), F.lit("")))
               .withColumns({names[1]: F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), 0), names[2]: F.filter(F.split(text, "\n", -1), has_word)})
               .withColumns({
                   "n_words": F.size(words).cast("bigint"),
                   "word_chars": F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)),
                   "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("bigint"),
                   "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
                   "n_repeat_words": repeated_words(words),
                   "n_lines": F.size(lines).cast("bigint"),
                   "n_stop": _count(words, lambda w: F.lower(w).isin(stop)),
                   "n_letter_words": _count(words, lambda w: w.rlike(r"\p{L}")),
                   "n_capital_words": _count(words, lambda w: w.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$")),
                   "n_bullets": _count(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•‣]")),
                   "n_ellipses": _count(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$")),
               }).drop(*names))
    return counted.withColumns({
        "mean_word_chars": F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0)),
        "symbols_per_word": F.when(F.col("n_words") > 0, F.col("n_symbols") / F.col("n_words")).otherwise(F.lit(0.0)),
        "repeat_percent": _share(F.col("n_repeat_words"), F.col("n_words")),
        "stop_percent": _share(F.col("n_stop"), F.col("n_words")),
        "letter_word_percent": _share(F.col("n_letter_words"), F.col("n_words")),
        "capital_percent": _share(F.col("n_capital_words"), F.col("n_words")),
        "dup_line_percent": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_percent": _share(F.col("n_bullets"), F.col("n_lines")),
        "ellipsis_line_percent": _share(F.col("n_ellipses"), F.col("n_lines")),
    })


def failed(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row breaks, in the table's order."""
    tests = []
    for r in rules:
        m = F.col(r.measure)
        broken = F.lit(False)
        if r.least is not None:
            broken = broken | (m < r.least)
        if r.greatest is not None:
            broken = broken | (m > r.greatest)
        tests.append(F.when(broken, F.lit(r.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def judge(docs: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents' columns, the measures, ``failed_rules``, ``base_failed`` and ``kept``.

    Columns of these names in the input are replaced. A null or empty text has no words and fails the least
    number of words. Every row is judged by itself.
    """
    helpers = []
    for name in ("_text", "_words", "_lines"):
        while name in docs.columns:
            name += "_"
        helpers.append(name)
    return (measures(docs, text_col, tuple(helpers))
            .withColumns({"failed_rules": failed(base + rules), "base_failed": F.size(failed(base)) > 0})
            .withColumn("kept", F.size("failed_rules") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
g AS (SELECT rid, i, list_slice(w, i, i + 7) g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) i FROM w WHERE len(w) >= 8)),
r AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 8)) p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
  len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(ls) n_lines,
  len(list_filter(w, lambda x: list_contains([{stop}], lower(x)))) n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) n_letter,
  len(list_filter(w, lambda x: regexp_matches(x, '^\P{{Ll}}*\p{{Lu}}\P{{Ll}}*\p{{Lu}}\P{{Ll}}*$'))) n_capital,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) n_ellipses
  FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN n_words < 20 THEN 'too_few_words' END, CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_words' END,
  CASE WHEN n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 14 THEN 'word_length' END, CASE WHEN n_words > 0 AND n_symbols / n_words > 0.3 THEN 'symbols' END,
  CASE WHEN n_words = 0 OR 100.0 * n_stop / n_words < 2 THEN 'stop_words' END, CASE WHEN n_lines > 0 AND 100.0 * n_dup_lines / n_lines > 60 THEN 'repeated_lines' END,
  CASE WHEN n_words = 0 OR 100.0 * n_letter / n_words < 60 THEN 'letters' END, CASE WHEN n_lines > 0 AND 100.0 * n_bullets / n_lines > 90 THEN 'bullets' END,
  CASE WHEN n_lines > 0 AND 100.0 * n_ellipses / n_lines > 30 THEN 'ellipses' END, CASE WHEN n_words > 0 AND 100.0 * n_capital / n_words > 60 THEN 'capitals' END], lambda x: x IS NOT NULL), ',') failed_rules FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed, failed_rules = '' kept, failed_rules FROM f
""".format(stop=", ".join(f"'{w}'" for w in sorted({w for group in STOP_WORDS.values() for w in group})))

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": _SQL}
