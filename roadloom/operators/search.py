"""Places by words, with an optional rectangle, through a trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import in_geo_rect, to_e7
from roadloom.functions.text import filter_query, item_label, query_words, searchable_text
from roadloom.session import cut, large

TOP = 20
#: Most rows of words, trigrams or queries that are broadcast.
SMALL = 100_000
_RECT = ["lat_min", "lat_max", "lon_min", "lon_max"]


def _sent(rows: DataFrame) -> DataFrame:
    """``rows`` at rest for a join: few are sent to all tasks, as few words or queries would make few groups, some of them with most of the items."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def positioned_items(items: DataFrame) -> DataFrame:
    """Items with a position and a string."""
    return items.where((F.size("positions") > 0) & (F.size("strs") > 0))


def item_position(items: DataFrame) -> DataFrame:
    """Items with the first position as ``lat``, ``lon`` and E7; null where there is none."""
    first = F.get("positions", F.lit(0))
    at = items.withColumn("lat", first["lat"]).withColumn("lon", first["lon"])
    return at.withColumn("lat_e7", to_e7(F.col("lat"))).withColumn("lon_e7", to_e7(F.col("lon")))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Searchable queries with ``filtered`` and ``first_id``: the smallest id with the same words and rectangle."""
    live = queries.where(searchable_text(F.col("q"))).withColumn("filtered", filter_query(F.col("q"))).where("filtered <> ''")
    keys = ["filtered", *_RECT]
    firsts = live.groupBy(*keys).agg(F.min("query_id").alias("first_id"))
    same = [live[k].eqNullSafe(firsts[k]) for k in keys]
    return live.join(firsts, same).select(live["*"], "first_id")


def _grams(text):
    last = F.length(text) - 2
    return F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))


def trigram_index(items: DataFrame) -> DataFrame:
    """``(gram, item_id)``: the different trigrams of each item's strings, in lower case."""
    grams = F.array_distinct(F.flatten(F.transform("strs", lambda s: _grams(F.lower(s)))))
    return items.select("item_id", F.explode(grams).alias("gram")).where(F.length("gram") == 3)


def match_items(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(query_id, item_id)``: items that hold all the query's words, each as a part of one of its strings, in any case.

    Of the index only the trigrams of the words asked for are counted. Each query looks the rarest trigram of its words up, and what comes back
    is verified for all its words where the item lies, so items aren't gathered by words or queries, however many hold one.
    """
    words = cut(queries.select("query_id", F.explode(F.array_distinct(query_words(F.lower("q")))).alias("word")))
    grams = cut(words.select("query_id", "word", F.explode(F.array_distinct(_grams(F.col("word")))).alias("gram")))
    asked = _sent(cut(grams.select("gram").distinct()))
    frequency = trigram_index(items).join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    least = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))["gram"].alias("gram")
    rarest = grams.join(frequency, "gram", "left").groupBy("query_id").agg(least, F.collect_set("word").alias("words"))
    texts = items.select("item_id", F.transform("strs", lambda s: F.lower(s)).alias("low"))
    index = texts.select("*", F.explode(F.array_distinct(F.flatten(F.transform("low", _grams)))).alias("gram"))
    holds = F.forall("words", lambda w: F.exists("low", lambda s: F.contains(s, w)))
    return index.join(_sent(cut(rarest)), "gram").where(holds).select("query_id", "item_id")


def match_in_rect(queries: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches whose item lies in the query's rectangle; queries without one keep all."""
    at = item_position(items).select("item_id", "lat", "lon")
    rows = matches.join(_sent(cut(queries.select("query_id", *_RECT))), "query_id").join(large(at), "item_id")
    inside = in_geo_rect(F.col("lat"), F.col("lon"), *(F.col(c) for c in _RECT))
    return rows.where(F.col("lat_min").isNull() | inside).select("query_id", "item_id")


def top_results(matches: DataFrame, limit: int = TOP) -> DataFrame:
    """The first matches of each query, in order of item id, with ``rn`` from 1."""
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))
    return matches.withColumn("rn", rn).where(F.col("rn") <= limit)


def backfill_outside_rect(queries: DataFrame, items: DataFrame, matches: DataFrame, hits: DataFrame, limit: int = TOP) -> DataFrame:
    """``(query_id, item_id)`` to add for queries with a rectangle and under ``limit`` hits.

    The first ``limit - have`` unrestricted matches are taken before those without
    a string or position, and those at a position that a hit has, are left out; so the total may stay smaller.
    """
    have = hits.groupBy("query_id").agg(F.count("*").alias("have"))
    short = queries.where("lat_min IS NOT NULL").select("query_id").join(have, "query_id", "left")
    short = short.select("query_id", (F.lit(limit) - F.coalesce("have", F.lit(0))).alias("room")).where("room > 0")
    more = top_results(matches, limit).join(short, "query_id").where("rn <= room").select("query_id", "item_id")
    at = item_position(positioned_items(items)).select("item_id", "lat_e7", "lon_e7")
    taken = hits.join(large(at), "item_id").select("query_id", "lat_e7", "lon_e7")
    return more.join(large(at), "item_id").join(taken, ["query_id", "lat_e7", "lon_e7"], "left_anti").select("query_id", "item_id")


def search(queries: DataFrame, items: DataFrame, limit: int = TOP) -> DataFrame:
    """``(query_id, rank, item_id, label, lat_e7, lon_e7)``: at most ``limit`` places a query, those in its rectangle first.

    The same words and rectangle are searched once. Queries of three characters or
    fewer, or without a word of three, find nothing; null queries too.
    """
    live = cut(distinct_queries(queries))
    once = live.where("query_id = first_id")
    matches = cut(match_items(once, items))
    own = positioned_items(items).select("item_id")
    inside = match_in_rect(once, items, matches).join(large(own), "item_id", "left_semi")
    hits = cut(top_results(inside, limit).select("query_id", "item_id"))
    more = backfill_outside_rect(once, items, matches, hits, limit)
    both = hits.withColumn("phase", F.lit(1)).unionByName(more.withColumn("phase", F.lit(2)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("phase", "item_id"))
    ranked = both.withColumn("rank", rank).withColumnRenamed("query_id", "first_id")
    shown = item_position(items).select("item_id", item_label(F.col("strs")).alias("label"), "lat_e7", "lon_e7")
    return live.select("query_id", "first_id").join(ranked, "first_id").join(large(shown), "item_id").select(
        "query_id", "rank", "item_id", "label", "lat_e7", "lon_e7"
    )
