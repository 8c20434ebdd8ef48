"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into item-sized windows, each window into word
shingles.  Shingles are ordered by how rare they are in the corpus.  As a window
only counts if it is contained whole, one shingle is a sufficient prefix: the
documents' shingles are joined with every window's rarest one.  Length and
positional bounds drop matches whose window would not lie within the document,
and the window's words are compared with the document's at that place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.graph import Scratch, numbered_rows
from tramline.llm.textsql import lower_ascii, trimmed

#: What separates words after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    parts = df.select(F.col(key).alias(name), F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), SEPARATORS, -1).alias("parts"))
    return parts.select(name, trimmed(F.col("parts")).alias("words"))


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(n)))


def _form(window: Column) -> Column:
    """A window's words joined by blanks; where they are long, the SHA-256 of that, so that a window takes at most 256 bytes."""
    return F.when(F.octet_length(window) <= 256, window).otherwise(F.concat(F.lit("sha-256 "), F.sha2(window, 256)))


def _placed(words: DataFrame, name: str, n: int) -> DataFrame:
    """A row for each shingle of n words; a row at 0 even where there is none."""
    last = F.greatest(F.size("words") - n, F.lit(0))
    out = words.select(name, "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return out.select(name, "words", "at", _hash(F.col("words"), F.col("at"), n).alias("h"))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
    block: int = 1_000_000,
) -> DataFrame:
    """Which words of which documents lie in a window of a benchmark item.

    Words are runs of digits, letters a-z (A-Z count as these) and anything
    beyond ASCII.  A window is `window` consecutive words of an item, or all of
    them if there are fewer.  Returns (doc_id, n_words, n_hit, spans, items):
    spans are the hit words as merged [start, end) word positions, items the
    sorted ids, as strings, of the items with a window in the document.

    At most `block` windows of 300 bytes each are broadcast at a time; a larger
    benchmark takes one pass over the documents per block.  Null or empty texts
    have no words; items without words or id match nothing; repeated items and
    texts of any length are searched whole.  Every row is judged by itself, also
    where ids repeat or are null.  Other columns are left out, whatever their names.
    Empty tables give an empty one, or one without hits.
    """
    work = Scratch(documents.sparkSession)
    plain = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, odd = numbered_rows(plain, work)
    out = _hits(rows.select("row", "text"), "row", benchmark, item_col, item_text_col, window, shingle, block, work)
    if not odd:
        return out.withColumnRenamed("key", "doc_id")
    names = rows.select("doc_id", F.col("row").alias("key"))
    return out.join(names, "key").select("doc_id", *out.columns[1:])


def contaminated_texts(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5, block: int = 1_000_000) -> DataFrame:
    """SHA-256 (as bytes, in the column digest) of all texts with a word in a window of a benchmark item; equal texts are told apart by nothing."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    texts = documents.select(digest.alias("key"), F.col(text_col).alias("text"))
    found = _hits(texts, "key", benchmark, item_col, item_text_col, window, shingle, block, Scratch(documents.sparkSession))
    return found.where("n_hit > 0").select(F.col("key").alias("digest"))


def _hits(documents: DataFrame, key: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, shingle: int, block: int, work: Scratch) -> DataFrame:
    """(key, n_words, n_hit, spans, items) of each key; rows that share a key must have equal texts."""
    docs = _words(documents, key, "text", "doc_id")
    items = _words(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col, "item_id").where(F.size("words") > 0)
    windows = work.keep(
        items.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at"))
        .select("item_id", F.slice("words", F.col("at") + 1, window).alias("words"))
        .select("item_id", _form(F.array_join("words", " ")).alias("window"), F.size("words").alias("size"), "words")
        .distinct()
    )
    distinct = windows.select("window", "size", "words").distinct()
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect()]  # at most `shingle` numbers
    hits = []
    for n in sizes or [shingle]:
        mine = distinct.where(F.least("size", F.lit(shingle)) == n)
        shingles = (
            mine.select("window", "size", "words", F.explode(F.sequence(F.lit(0), F.col("size") - n)).alias("o"))
            .select("window", "size", "o", _hash(F.col("words"), F.col("o"), n).alias("h"))
        )
        wanted = work.keep(shingles.select("h").distinct().withColumn("part", F.pmod("h", F.lit(_parts(shingles.count(), block)))))
        counts = [
            _placed(docs, "doc_id", n).select("h").join(F.broadcast(part.select("h")), "h").groupBy("h").agg(F.count("*").alias("seen"))
            for part in _blocks(wanted)
        ]
        seen = reduce(DataFrame.unionByName, counts)
        prefix = shingles.join(seen, "h", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "o", "h")).alias("x"))
        # A window whose rarest shingle is in no document can't occur.
        prefix = work.keep(
            prefix.where("x.seen > 0").select("window", "size", F.col("x.o").alias("o"), F.col("x.h").alias("h"))
        )
        prefix = work.keep(prefix.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(_parts(prefix.count(), block)))))
        for part in _blocks(prefix):
            placed = _placed(docs, "doc_id", n).withColumn("n_words", F.size("words"))
            p = part.select(F.col("h").alias("ph"), "window", "size", "o")
            start = F.col("at") - F.col("o")
            match = (
                (F.col("h") == F.col("ph")) & (start >= 0) & (start + F.col("size") <= F.col("n_words"))
                & (_form(F.array_join(F.slice("words", start + 1, F.col("size")), " ")) == F.col("window"))
            )
            hits.append(
                placed.join(F.broadcast(p), match, "left").where("window IS NOT NULL OR at = 0")
                .select("doc_id", "n_words", start.alias("start"), (start + F.col("size")).alias("end"), "window")
            )
    found = work.keep(reduce(DataFrame.unionByName, hits))
    merged = F.aggregate(
        F.array_sort("places"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    per_doc = found.groupBy("doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.collect_set(F.when(F.col("window").isNotNull(), F.struct("start", "end"))).alias("places")
    ).select("doc_id", "n_words", merged.alias("spans"))
    per_item = (
        found.where("window IS NOT NULL").select("doc_id", "window").distinct().join(windows.select("window", "item_id"), "window")
        .groupBy(F.col("doc_id").alias("hit_id")).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return per_doc.join(per_item, F.col("doc_id") == F.col("hit_id"), "left").select(
        F.col("doc_id").alias("key"),
        "n_words",
        F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["start"]).cast("long").alias("n_hit"),
        "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _parts(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def _blocks(df: DataFrame) -> list[DataFrame]:
    parts = max([0, *(r[0] for r in df.select("part").distinct().collect())])  # as many numbers as blocks
    return [df.where(F.col("part") == i) for i in range(parts + 1)]
