"""Folded substring search with an index of trigrams.

The index holds one row per text and distinct trigram of its folded form. A
keyword's rarest trigram gives the texts to read, and only these are folded and
searched for the whole keyword.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.functions.text import accent_fold
from erario.operators.upsert import stage

BUCKETS = 64


def trigrams(folded) -> Column:
    """The distinct substrings of three characters; empty for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("(?s)(?=(...))"), F.lit(1)))


def write_trigram_index(texts: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the postings ``gram, key`` of every row. The texts are dealt out
    evenly, however few files hold them. Each task sorts its postings by gram and
    writes them where it made them: the many postings are not shuffled, a search
    skips the pages without its grams, and a gram of every text is no single
    task's work. Rows with a NULL key or text have no postings. ``buckets`` is
    accepted as before; the files need none.
    """
    dealt = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).repartition(key, text)
    postings = (dealt
                .select(F.col(key).alias("key"), F.explode(trigrams(accent_fold(text))).alias("gram")))
    postings.sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def _grams_of(spark: SparkSession, keywords: Sequence[str]) -> dict[str, tuple[str, list[str]]]:
    """The folded form and the trigrams of each keyword, folded as the texts are."""
    asked = spark.createDataFrame([(k,) for k in dict.fromkeys(keywords)], "keyword string")
    folded = asked.withColumn("folded", accent_fold("keyword"))
    return {r.keyword: (r.folded, r.grams) for r in folded.select("*", trigrams("folded").alias("grams")).collect()}


def _asked(keywords: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(f).alias("folded")) for k, f in keywords]).alias("asked")


def search_folded(texts: DataFrame, key: str, text: str, index: str, keywords: Sequence[str],
                  buckets: int = BUCKETS) -> DataFrame:
    """Return ``keyword``, the key and ``n_read``: each row of ``texts`` whose text contains
    a keyword regardless of accents and case, and the number of rows read for
    that keyword.

    ``index`` is what ``write_trigram_index`` wrote for these texts. A keyword of fewer than three characters has no trigram: all
    rows are read for it (the empty keyword is in every text). Rows with a NULL
    key or text are not found; rows with the same key are found each for itself.
    Repeated keywords count once; without keywords there are no rows.
    """
    spark = texts.sparkSession
    known = _grams_of(spark, keywords)
    held = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = texts.schema[key].dataType.simpleString()
    wanted = sorted({g for _, grams in known.values() for g in grams})
    postings = spark.read.schema(f"key {kind}, gram string").parquet(index).where(F.col("gram").isin(wanted))
    # one row for each trigram of the keywords
    sizes = {r["gram"]: r["count"] for r in postings.groupBy("gram").count().collect()} if wanted else {}
    read, by_gram, everywhere = {}, {}, []
    for keyword, (folded, grams) in known.items():
        if not grams:
            everywhere.append((keyword, folded))
        elif all(g in sizes for g in grams):  # else no text holds it
            rarest = min(grams, key=lambda g: (sizes[g], g))
            by_gram.setdefault(rarest, []).append((keyword, folded))
            read[keyword] = sizes[rarest]
    if everywhere:
        read.update(dict.fromkeys([k for k, _ in everywhere], held.count()))
    none = F.array().cast("array<struct<keyword:string,folded:string>>")
    asked = held.select("key", "text", _asked(everywhere) if everywhere else none.alias("asked"))
    if by_gram:
        lists = reduce(lambda c, item: c.when(F.col("gram") == item[0], _asked(item[1])), by_gram.items(), F)
        # a key's keywords in one row, so that its text is folded once
        candidates = (postings.where(F.col("gram").isin(list(by_gram))).select("key", lists.alias("asked"))
                      .groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked")))
        picked = held.join(stage(candidates, "search-candidates"), "key").select("key", "text", "asked")
        asked = picked.unionByName(asked) if everywhere else picked
    hits = F.transform(F.array(accent_fold("text")), lambda t: F.filter("asked", lambda a: F.contains(t, a["folded"])))[0]
    counted = F.create_map(*[F.lit(x) for item in read.items() for x in item]) if read else F.create_map().cast("map<string,bigint>")
    return (asked.select("key", F.explode(hits["keyword"]).alias("keyword"))
            .select("keyword", F.col("key").alias(key), counted[F.col("keyword")].cast("long").alias("n_read")))
