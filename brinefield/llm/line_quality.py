"""Line-first cleaning in column expressions only.

Each line is judged by itself (punctuation, navigation, boilerplate), failing lines go,
and a document that loses too much of its text goes as well. The document's own counts
(repeated lines, words in repeated five-word windows) are taken from arrays within the
row, so nothing shuffles: repeated windows are found by sorting window hashes, and only
for documents that have one. Arrays that later expressions read more than once pass
through a one-row generator, which keeps the optimizer from copying their expressions
into every use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinefield.llm.common import fresh_name, SPACES, WORD, whole_text

GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MOST_REPEATED = 20
FEWEST_WORDS = 10
MOST_LOST = 50
SHORT_LINE = 8

#: Words of menus, and phrases of page furniture.
MENU = "home|menu|login|log in|logout|sign in|sign up|register|search|next|previous|prev|back|share|contact|contact us|about|about us|help|faq|sitemap|more"
FURNITURE = ("cookies|javascript|all rights reserved|privacy policy|terms of (use|service)|subscribe to|newsletter|click here|read more|"
             "lorem ipsum|skip to (main )?content|powered by")
ENDS = "[.!?…:;)\\]\"'”’»。！？؟।]\\s*$"


def failing_rule(line: Column) -> Column:
    """The first rule that a line fails, or null. A line without a word fails none."""
    words = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(r"[!?]{2,}|[#*$%&<>]{2,}"))
    return (F.when(~F.regexp_like(line, F.lit(HAS_WORD)), F.lit(None).cast("string"))
            .when((F.regexp_count(line, F.lit(r"[|»›]")) >= 2) | F.regexp_like(F.lower(line), F.lit(rf"^\W*({MENU})(\W+({MENU}))*\W*$")), F.lit("navigation"))
            .when(F.regexp_like(F.lower(line), F.lit(f"({FURNITURE})")), F.lit("boilerplate"))
            .when((marks * 4 >= words) | ((words < SHORT_LINE) & ~F.regexp_like(line, F.lit(ENDS))), F.lit("punctuation")))


def staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns through a one-row generator."""
    ready = df.select(*keep, *[c.alias(f"_n_{n}") for n, c in columns.items()])
    return ready.select(*keep, F.inline(F.array(F.struct(*[F.col(f"_n_{n}").alias(n) for n in columns]))))


def word_array(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def without_spaces(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add n_repeat_words from the array ``_w``: words covered by windows that occur twice or more."""
    hashes = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW),
                                                        lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])))
    df = staged(docs, [*keep], _h=F.coalesce(hashes, F.array().cast("array<bigint>")))
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = staged(df, [*keep], _s=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    twice = F.filter("_s", lambda e, i: e["h"].eqNullSafe(F.get("_s", i - 1)["h"]) | e["h"].eqNullSafe(F.get("_s", i + 1)["h"]))
    df = staged(df, [*keep], _p=F.sort_array(F.transform(twice, lambda e: e["i"])))
    span = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    return df.select(*keep, F.coalesce(F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, base verdict, lines removed and the verdict.

    Null text has no words: all counts 0, base_failed, not kept. A line without a word is
    never removed. Repeated rows get the same verdict each; other columns are not looked
    at; an empty table gives no rows. Windows are compared by 64-bit hashes.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_t"))
    df = staged(body, ["doc_id"], _w=word_array(F.col("_t")), _lines=F.filter(F.split("_t", "\n", -1), lambda x: F.regexp_like(x, F.lit(HAS_WORD))),
                word_chars=F.char_length(without_spaces(F.col("_t"))).cast("long"), n_symbols=F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
    failed = F.filter("_lines", lambda x: failing_rule(x).isNotNull())
    counts = ["doc_id", "_w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_removed", "lost_chars"]
    df = staged(df, ["doc_id", "_w", "_lines", "word_chars", "n_symbols"], _failed=failed)
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "n_lines": F.size("_lines").cast("long"), "n_removed": F.size("_failed").cast("long"),
                         "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                         "lost_chars": F.char_length(without_spaces(F.array_join("_failed", ""))).cast("long")}).select(*counts)
    df = _repeats(df, [c for c in counts if c != "_w"])
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (df.withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "lost_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with failing lines removed from the text, all columns kept; documents that fail stay out."""
    row = fresh_name(docs, "_row")
    lines = F.filter(F.split(whole_text(), "\n", -1), lambda x: failing_rule(x).isNull())
    verdict = judge(docs.select("doc_id", F.col("text")).withColumn("doc_id", F.xxhash64("doc_id", "text")))
    good = verdict.filter("kept").select(F.col("doc_id").alias(row)).distinct()
    marked = docs.withColumn(row, F.xxhash64(F.col("doc_id"), F.col("text")))
    return marked.join(good, row, "left_semi").drop(row).withColumn("text", F.array_join(lines, "\n"))
