"""Quality rules, line first.

Every line is held against rules on punctuation, navigation and boilerplate; failing lines are
removed, and a document that loses too much of its text is rejected, as is one that fails the
base rules (too few words, too much repetition). All of it is per row and inside the JVM.

Defined cases: a null text has no words and is rejected; blank lines neither fail nor count;
equal texts get equal verdicts; texts of any length are read whole; an empty table gives an empty table; other columns pass through,
those named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, let, text_of, words_of

MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows of WINDOW words.
MAX_REPEAT, WINDOW = 20, 5
#: Percent of the characters that failing lines may take.
MAX_LOST = 50

SYMBOLS = r"[#*$%&|<>]"
#: Fixed phrases of page furniture, looked for in short lines only.
BOILERPLATE = r"(?i)all rights reserved|copyright (\(c\)|©|\d{4})|©|privacy policy|terms of (use|service)|cookie (policy|settings)|(accept|uses?) cookies|enable javascript|lorem ipsum|sign (in|up) |log ?in to|subscribe to|click here|share (this|on)|powered by"
BOILERPLATE_CHARS = 240
SEPARATORS = r"[|•·»›→]"
TERMINAL = r"[.!?…:;。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*$"
FRAGMENT_CHARS = 24


def line_fails(line: Column) -> Column:
    """True for a line that is symbols, shouting, a menu, a stock phrase or a loose fragment."""
    size = F.length(line)
    symbols = F.regexp_count(line, F.lit(r"[#*$%&<>{}=~^\\_]")) * 10 >= size
    shouting = let(F.regexp_count(line, F.lit(r"[!?]{2,}")), lambda n: (n >= 3) & (n * 20 >= size))
    navigation = let(F.regexp_count(line, F.lit(SEPARATORS)), lambda n: (n >= 2) & (n * 25 >= size))
    boilerplate = (size <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    fragment = (size <= FRAGMENT_CHARS) & ~line.rlike(TERMINAL)
    return symbols | navigation | shouting | boilerplate | fragment


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text.

    Window hashes without a repeat settle almost every text (equal windows have equal hashes);
    the rest sorts its windows as text, keeps the positions whose window equals a neighbour's,
    and sums the words that those positions cover. O(n log n) for the worst text.
    """
    last = F.size(words) - WINDOW

    def last_of(w: Column) -> Column:
        return F.size(w) - WINDOW

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last_of(w)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), last_of(w)), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, WINDOW)).alias("w"), i.alias("i")))
        return let(F.array_sort(windows), lambda s: let(twice(s), span))

    def twice(s: Column) -> Column:
        n = F.size(s)
        marked = F.transform(s, lambda x, k: F.when((F.get(s, k + 1)["w"] == x["w"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["w"] == x["w"])), x["i"]))
        return F.when(n > 0, F.sort_array(F.array_compact(marked)))

    def span(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    any_repeat = let(hashes(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 1, 0).when(any_repeat, covered(words)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, line_chars, base_failed, kept and clean_text."""
    text = text_of()

    def body(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def with_word(lines: Column) -> Column:
        return F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    blankless = text
    for b in BLANKS:
        blankless = F.replace(blankless, F.lit(b))
    lines = F.split(text, "\n")
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))

    def chars(js: Column, failing: bool) -> Column:
        return F.aggregate(js, F.lit(0).cast("long"), lambda n, j: n + F.when((F.btrim(j["line"], F.lit(BLANKS)) != "") & (j["fails"] if failing else F.lit(True)), F.length(j["line"])).otherwise(0))

    def verdict(js: Column) -> Column:
        kept = F.transform(F.filter(js, lambda j: ~j["fails"] | (F.btrim(j["line"], F.lit(BLANKS)) == "")), lambda j: j["line"])
        return F.struct(chars(js, True).alias("lost_chars"), chars(js, False).alias("line_chars"), F.array_join(kept, "\n").alias("clean_text"))

    repeated_lines = let(with_word(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    # a generated row is worked out once, however many results and filters read it
    both = F.struct(let(words_of(text), body).alias("words"), let(judged, verdict).alias("lines"))
    out = docs.withColumn("__all", F.explode_outer(F.array(both))).withColumns({
        "word_chars": F.length(blankless).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": repeated_lines.cast("long"),
        **{c: F.col(f"__all.words.{c}") for c in ("n_words", "n_repeat_words")},
        **{c: F.col(f"__all.lines.{c}") for c in ("lost_chars", "line_chars", "clean_text")},
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("line_chars"))).drop("__all")
