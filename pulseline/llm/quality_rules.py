"""Quality rules over whole texts: measures of a text, and a table of thresholds on their ratios.

``THRESHOLDS`` is data. ``verdict`` compiles it, whatever rules it holds, into one column expression, which
is evaluated with the measures in the same projection: no user functions, no shuffle. Ratios are compared as
products of whole numbers, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import bind, texts

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Words of a window that must not come twice.
WINDOW = 5
# Frequent function words of four languages; a word counts if it stands between spaces, without marks.
STOP_WORDS = {
    "en": "the be to of and that have with a in is it for on are was as by this from or an at not what",
    "de": "der die das und ist nicht ein eine zu von mit den im für auf als auch dem des sich sie er",
    "fr": "le la les et de des du un une est que dans pour qui sur par ce il en au ne pas plus",
    "es": "el la los las de que y en un una es por con para se del al lo como su no más",
}


@dataclass(frozen=True)
class Rule:
    """A text fails if ``part`` per 100 of ``whole`` is under ``least`` or over ``most``.

    The rule holds for texts of at least ``from_words`` words: in shorter ones a ratio says little.
    """

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    from_words: int = 0


BASE = (
    Rule("too_short", "n_words", "one", least=1_000),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=20),
)
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1_400),
    Rule("too_long", "n_words", "one", most=10_000_000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("doubled_marks", "n_doubled_marks", "n_words", most=10),
    Rule("capitals", "n_capitals", "word_chars", most=40),
    Rule("words_without_letters", "n_plain_words", "n_words", least=70),
    Rule("stop_words", "n_stop_words", "n_words", least=2, from_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30, from_words=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("open_lines", "n_open_lines", "n_lines", most=30),
)


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("bigint")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _windows(words: Column) -> Column:
    """A hash of each window of ``WINDOW`` words."""
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    last = F.size(words) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>"))


def _repeated(words: Column, windows: Column) -> Column:
    """Words that stand in a window of ``WINDOW`` words that the text holds twice or more.

    Windows are sorted by a hash of their words, so equal ones stand side by side, where their words are
    compared. Only texts in which a hash comes twice are sorted.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def same(a: Column, b: Column) -> Column:
        word = lambda x, k: F.get(words, x["at"] + k)
        equal = [word(a, k) == word(b, k) for k in range(WINDOW)]
        return F.coalesce(reduce(and_, [a["h"] == b["h"], *equal]), F.lit(False))

    def starts(s: Column) -> Column:
        twice = lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["at"]))

    def added(p: Column) -> Column:
        """What each window covers before the next one begins."""
        return F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))

    covered = F.aggregate(bind(bind(placed, starts), added), F.lit(0), lambda total, x: total + x)
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, covered).otherwise(F.lit(0)).cast("bigint")


def measures(text: Column, words: Column, lines: Column, windows: Column) -> dict[str, Column]:
    """Counts by name, of a text that is not NULL, its words, its lines that hold a word, and its windows."""
    stop = sorted({w for listed in STOP_WORDS.values() for w in listed.split()})
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(_without(text, " \t\n\x0b\x0c\r")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": _repeated(words, windows),
        "n_lines": F.size(lines).cast("bigint"),
        "n_bullet_lines": _count(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣▪·]")),
        "n_open_lines": _count(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
        "n_stop_words": _count(words, lambda w: F.lower(w).isin(stop)),
        "n_plain_words": _count(words, lambda w: w.rlike(r"\p{L}")),
        "n_doubled_marks": F.regexp_count(text, F.lit(r"[!?]{2,}|\.{4,}")).cast("bigint"),
        "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("bigint"),
    }


def broken(rule: Rule, value=F.col) -> Column:
    """Whether a text breaks a rule; ``value`` gives the column of a measure by name."""
    whole = F.lit(1) if rule.whole == "one" else value(rule.whole)
    part, whole = 100 * value(rule.part), whole.cast("bigint")
    out = F.lit(False)
    if rule.least is not None:
        out = out | (part < rule.least * whole)
    if rule.most is not None:
        out = out | (part > rule.most * whole)
    return out & (value("n_words") >= rule.from_words) if rule.from_words else out


def verdict(rules: Sequence[Rule], value=F.col) -> Column:
    """Whether a text breaks any of the rules."""
    return reduce(or_, [broken(r, value) for r in rules], F.lit(False))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = THRESHOLDS, base: Sequence[Rule] = BASE) -> DataFrame:
    """Measures and verdict of every whole text, a row per row of ``docs``.

    ``doc_id``, all measures (long), ``base_failed`` (breaks a rule of ``base``), ``broken`` (names of the
    other rules it breaks, in the order of the table) and ``kept`` (breaks none at all). A NULL or empty
    text has no words: its measures are 0, it fails the base. Repeated rows are judged alike, a NULL id
    stays NULL, an empty table gives no rows, other columns of ``docs`` are not read.
    """
    split = texts(docs).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    split = split.withColumn("windows", _windows(F.col("words")))
    found = measures(F.col("text"), F.col("words"), F.col("lines"), F.col("windows"))
    names = F.filter(
        F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string")), lambda x: x.isNotNull()
    )
    measured = split.select("doc_id", *[c.alias(name) for name, c in found.items()])
    return measured.select(
        "*", verdict(base).alias("base_failed"), names.alias("broken"), (~(verdict(base) | verdict(rules))).alias("kept")
    )


def sql(rules: Sequence[Rule] = THRESHOLDS, base: Sequence[Rule] = BASE) -> str:
    """DuckDB SQL for ``quality_rules`` without ``broken``, from the same tables of rules."""
    space = r"[\x20\x09-\x0D]"
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))

    def condition(r: Rule) -> str:
        whole = "1" if r.whole == "one" else r.whole
        tests = [f"100 * {r.part} < {r.least} * {whole}"] * (r.least is not None)
        tests += [f"100 * {r.part} > {r.most} * {whole}"] * (r.most is not None)
        return f"(n_words >= {r.from_words} AND ({' OR '.join(tests)}))"

    fails = " OR ".join(map(condition, base))
    breaks = " OR ".join(map(condition, [*base, *rules]))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)
), twice AS (
  SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), again AS (
  SELECT r, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS place FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^{space}*[-*•‣▪·]'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){space}*$'))) AS BIGINT) AS n_open_lines,
    CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_plain_words,
    CAST(len(regexp_extract_all(text, '[!?]{{2,}}|\.{{4,}}')) AS BIGINT) AS n_doubled_marks,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN again USING (r)
)
SELECT *, ({fails}) AS base_failed, NOT ({breaks}) AS kept FROM m
"""
