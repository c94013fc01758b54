"""The verdict on a chain: its narrators looked up, graded by the weakest, and its links held against the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuschain.functions import extract as X
from corpuschain.functions import grades as G
from corpuschain.functions import text as T
from corpuschain.operators import entity, graph


def graded_entries(entries: DataFrame, entry: str, grade: str, opinions: str) -> DataFrame:
    """(entry, rank): the rank of an entry's grade, or of the worst opinion on it where that is lower; null where nothing is read."""
    said = entries.select(F.col(entry).alias("entry"), F.explode(F.concat(F.array(F.col(grade)), F.coalesce(F.col(f"{opinions}.grade"), F.array().cast("array<string>")))).alias("said"))
    return said.groupBy("entry").agg(F.min(G.classify(F.col("said"))["rank"]).alias("rank"))


def is_prophet(words: Column) -> Column:
    """Whether the words of a folded name are the Prophet's title, with eulogies or without."""
    return F.coalesce(F.get(words, F.lit(0)).isin(*X.PROPHET) & F.forall(words, lambda w: w.isin(*X.PROPHET, *X.EULOGY)), F.lit(False))


def matches(chains: DataFrame, forms: DataFrame, graded: DataFrame) -> DataFrame:
    """(chain, pos, via, key, entry, score, ambiguous, rank, unnamed): each narrator but the Prophet with what is known of the name.

    ``chains``: (chain, pos, name, via); ``forms``: (entry, tokens).  Each different name is looked up once.  Of several
    entries that a name may stand for the smallest is given, and a rank only where all that have one agree.
    """
    words = T.words(T.normalize(F.col("name")))
    named = chains.select("chain", "pos", "via", words.alias("tokens")).where((F.size("tokens") > 0) & ~is_prophet(F.col("tokens"))).withColumn("key", F.array_join("tokens", " "))
    asked = named.groupBy("key").agg(F.first("tokens").alias("tokens")).select(F.col("key").alias("q"), "tokens")
    found = entity.lookup(asked, forms).join(graded, "entry", "left").groupBy(F.col("q").alias("key")).agg(
        F.min("entry").alias("entry"), F.max("score").alias("score"), F.bool_or("ambiguous").alias("ambiguous"), F.when(F.count_distinct("rank") == 1, F.min("rank")).alias("rank")
    )
    unnamed = F.get("tokens", F.lit(0)).isin(*X.UNNAMED)
    return named.withColumn("unnamed", unnamed).join(found, "key", "left").select("chain", "pos", "via", "key", "entry", "score", "ambiguous", "rank", "unnamed")


def verdicts(chains: DataFrame, forms: DataFrame, graded: DataFrame, least: int = 2) -> DataFrame:
    """(chain, weakest, n_known, n_unknown, n_unnamed, n_links, n_seen, ruling) of each chain with a narrator.

    ``chains`` has route_start besides.  A link counts as seen when ``least`` chains have it, this one included; pairs across a
    route's start are no link.  Hearing is confirmed where no narrator has the word "from".
    """
    found = matches(chains, forms, graded)
    worst = graph.weakest(found, "chain", "rank", "unnamed")
    manner = found.groupBy("chain").agg(F.bool_and(F.col("via") != "from").alias("heard"))
    named = chains.select("chain", "pos", "route_start", T.normalize(F.col("name")).alias("name"))
    adjacent = graph.links(named, "chain", "pos", "name", "route_start")
    seen = graph.continuity(adjacent, graph.edge_weights(adjacent).where(F.col("weight") >= least), "chain")
    ruled = worst.join(manner, "chain").join(seen, "chain", "left")
    return ruled.select(
        "chain", "weakest", "n_known", "n_unknown", "n_unnamed", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_seen", F.lit(0)).alias("n_seen"),
        graph.ruling(F.col("weakest"), F.col("n_unknown"), F.col("n_unnamed"), F.col("heard")).alias("ruling"),
    )
