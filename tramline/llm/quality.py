"""Quality rules: measures of each document, and lines that a host's documents share.

Lines are normalised and hashed.  For each host it is counted in how many
different texts a line occurs; exact copies of a document count once.  Lines
above the limits are removed, and documents that keep too little are rejected.
Short lines, such as headings, may be common in a large host, so for them the
limit is also a share of the host's texts; a long line is judged by its count alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.textsql import BLANKS, let, packed, trimmed

_WORD = r"[^\x20\x09-\x0D]"


def _repeated_words(grams: Column, size: int) -> Column:
    """Words within windows of `size` words whose hash occurs twice or more; grams is a plain column."""
    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])),
        )
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + size - F.greatest(acc["end"], p)).cast("long").alias("n"), (p + size).alias("end")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ordered, covered))


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANKS, " "))))


def measures(documents: DataFrame, text_col: str = "text", repeat_words: int = 3) -> DataFrame:
    """All columns, and m_words, m_word_chars, m_symbols, m_dup_lines, m_repeat_words and m_lines (the lines with a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = documents.withColumns(
        {"m_parts": F.split(text, BLANKS, -1), "m_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD)), "m_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")}
    )
    words = parts.withColumn("m_list", trimmed(F.col("m_parts"))).drop("m_parts")
    last = F.size("m_list") - repeat_words
    grams = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get("m_list", i + j) for j in range(repeat_words))))
    )
    counted = words.withColumns(
        {
            "m_n": F.size("m_list").cast("long"),
            "m_word_chars": F.char_length(F.array_join("m_list", "")).cast("long"),
            "m_dup_lines": (F.size("m_lines") - F.size(F.array_distinct("m_lines"))).cast("long"),
            "m_grams": grams,
        }
    ).drop("m_list")
    # A filter on a generator's output stays above it.  Below, it would repeat the word list's expression for every window.
    made = F.struct(F.col("m_n").alias("m_words"), _repeated_words(F.col("m_grams"), repeat_words).alias("m_repeat_words"))
    return counted.drop("m_words", "m_repeat_words").select("*", F.inline(F.array(made))).drop("m_n", "m_grams")


def judged(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_docs: int = 20,
    line_percent: int = 10,
    long_line: int = 8,
    min_left_percent: int = 50,
) -> DataFrame:
    """All input columns and the measures, base_failed, removed_words, clean_text and kept for each row.

    A line is above the limits if it is in line_docs or more different texts of
    its host and has long_line words or more, or is in more than line_percent of
    them all.  kept is false where base_failed is, or where removing such lines
    leaves less than min_left_percent of the words.  Null and empty texts fail;
    texts of any length are judged whole; null hosts are one host.  Limits that
    are just reached: line_docs counts, line_percent and max_repeat_percent don't,
    min_left_percent is enough.  Rows that repeat an id or have none are judged by
    their texts, equal texts of a host alike.  Columns that are called as a result
    are replaced, other names are free.  An empty table gives an empty one.
    """
    results = ("m_words", "m_word_chars", "m_symbols", "m_dup_lines", "m_repeat_words", "base_failed", "removed_words", "clean_text", "kept")
    rows, columns = packed(documents, results, shared=True, q_id=id_col, q_t=text_col, q_host=host_col)
    rows = rows.withColumn("q_text", F.xxhash64(F.coalesce(F.col("q_t"), F.lit(""))))
    lines = rows.select(
        "q_id", "q_host", "q_text", F.posexplode(F.filter(F.split(F.coalesce(F.col("q_t"), F.lit("")), "\n", -1), lambda x: x.rlike(_WORD))).alias("q_at", "q_line")
    )
    lines = lines.select("q_id", "q_host", "q_text", "q_at", _line_key(F.col("q_line")).alias("q_key"), F.size(F.split(F.trim(F.regexp_replace("q_line", BLANKS, " ")), " ")).alias("q_words"))
    common = lines.groupBy("q_host", "q_key").agg(F.count_distinct("q_text").alias("n"), F.max("q_words").alias("long")).where(F.col("n") >= line_docs)
    hosts = rows.groupBy(F.col("q_host").alias("h_host")).agg(F.count_distinct("q_text").alias("texts"))
    above = (
        common.join(hosts, F.col("q_host").eqNullSafe(F.col("h_host"))).where((F.col("long") >= long_line) | (100 * F.col("n") > line_percent * F.col("texts")))
        .select(F.col("q_host").alias("a_host"), F.col("q_key").alias("a_key"))
    )
    hit = (
        lines.join(above, (F.col("q_key") == F.col("a_key")) & F.col("q_host").eqNullSafe(F.col("a_host")))
        .groupBy("q_id", "q_host", "q_text").agg(F.collect_set(F.struct("q_at", "q_key", "q_words")).alias("q_gone"))  # a document's own lines
        .select(
            F.col("q_id").alias("h_id"), F.col("q_host").alias("h_host"), F.col("q_text").alias("h_text"), F.transform("q_gone", lambda x: x["q_key"]).alias("q_keys"),
            F.aggregate("q_gone", F.lit(0), lambda acc, x: acc + x["q_words"]).alias("q_lost"),
        )
    )
    both = measures(rows, "q_t").join(
        hit, F.col("q_id").eqNullSafe(F.col("h_id")) & F.col("q_host").eqNullSafe(F.col("h_host")) & (F.col("q_text") == F.col("h_text")), "left"
    )
    clean = F.array_join(F.filter(F.split(F.col("q_t"), "\n", -1), lambda x: ~F.array_contains("q_keys", _line_key(x))), "\n")
    failed = (F.col("m_words") < min_words) | (100 * F.col("m_repeat_words") > max_repeat_percent * F.col("m_words"))
    judged_ = both.withColumns(
        {
            "base_failed": failed,
            "removed_words": F.coalesce("q_lost", F.lit(0)).cast("long"),
            "clean_text": F.when(F.col("q_keys").isNull(), F.col("q_t")).otherwise(clean),
        }
    ).withColumn("kept", ~F.col("base_failed") & (100 * (F.col("m_words") - F.col("removed_words")) >= min_left_percent * F.col("m_words")))
    return judged_.select(*columns, *results)
