"""Entity work on narrator records: blocks of like names, same-person rules, merges and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuschain.functions.text import normalize, words
from corpuschain.operators.graph import connected

# Words between names.
SON = ("بن", "ابن")
# Fixed values (search forms): "father of" and "mother of", the servant's prefix, and marks of generation.
TEKNONYMS = ("ابو", "ابا", "ام")
SERVANT = "عبد"
GENERATIONS = ("الكبير", "الاكبر", "الحفيد", "حفيد", "الاصغر", "الصغير", "الابن", "الاب", "الجد")


def name_tokens(name: Column) -> Column:
    """The sorted distinct words of a folded name, without the word for son."""
    return F.array_sort(F.array_distinct(F.filter(words(normalize(name)), lambda w: ~w.isin(*SON))))


def nisbas(name: Column) -> Column:
    """Words of origin: with the article, ending in i, of four letters or more."""
    return F.filter(name_tokens(name), lambda w: F.startswith(w, F.lit("ال")) & F.endswith(w, F.lit("ي")) & (F.length(w) >= 4))


def lineage(name: Column) -> Column:
    """A man's own name, his father's, his grandfather's and so on, each with all its words.

    It ends where his own descriptors begin: a teknonym, an origin or a mark of generation that does not follow "son of";
    an origin after "servant of" completes the name.
    """
    own = words(normalize(name))
    before = lambda i, n: F.coalesce(F.get(own, i - n), F.lit(SON[0]))

    def describes(t: Column, i: Column) -> Column:
        origin = F.startswith(t, F.lit("ال")) & F.endswith(t, F.lit("ي")) & (F.length(t) >= 4)
        servant = (before(i, F.lit(1)) == SERVANT) & before(i, F.lit(2)).isin(*SON)
        begins = (i > 0) & before(i, F.lit(1)).isin(*SON)
        return ~t.isin(*SON) & ~begins & (t.isin(*TEKNONYMS, *GENERATIONS) | (origin & ~servant))

    stop = F.array_position(F.transform(own, describes), F.lit(True)).cast("int")
    kept = F.when(stop > 0, F.slice(own, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(own)
    marked = F.array_join(F.transform(kept, lambda t: F.when(t.isin(*SON), F.lit("|")).otherwise(t)), " ")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda part: F.trim(part)), lambda part: part != "")


def ident_key(name: Column) -> Column:
    """The block of a name: own name and father, or the own name alone, or the first three words where no lineage is found."""
    line = lineage(name)
    return F.when(F.size(line) >= 1, F.array_join(F.slice(line, 1, 2), " ")).otherwise(F.array_join(F.slice(words(normalize(name)), 1, 3), " "))


def block_pairs(df: DataFrame, key: str, block: Column, extra: Sequence[str] = ()) -> DataFrame:
    """(block, a, b, …_a, …_b): all pairs of *different values* inside a block, smaller key first."""
    rows = df.select(block.alias("block"), F.col(key).alias("k"), *extra).where(F.col("block").isNotNull() & (F.col("block") != ""))
    a = rows.select("block", F.col("k").alias("a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    b = rows.select("block", F.col("k").alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    return a.join(b, "block").where(F.col("a") < F.col("b"))


#: What the same-person rule looks at, and how many years two dates of death may differ.
TRAITS = ("line", "nisbas", "marks", "year", "kunya", "rank")
YEARS = 20
#: Rank from which a judgement trusts a narrator, and that of a Companion.
TRUSTED, COMPANION = 5, 10


def traits(name: Column, year: Column, kunya: Column, rank: Column) -> list[Column]:
    marks = F.array_sort(F.array_intersect(name_tokens(name), F.array(*map(F.lit, GENERATIONS))))
    folded = normalize(kunya)
    return [lineage(name).alias("line"), nisbas(name).alias("nisbas"), marks.alias("marks"), year.cast("int").alias("year"), F.when(folded != "", folded).alias("kunya"), rank.alias("rank")]


def same_man(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two names of one block are one man, from the ``traits`` of both.

    The lineages must agree as far as both go, and so must the marks of generation; origins that exclude each other say no.
    A shared origin says yes, but no where one is trusted and the other weak.  Else the dates of death decide, else the
    teknonyms.  Three agreeing generations say yes where nothing of these does, unless the judgements clash or one alone is a Companion.
    """
    shared = F.least(F.size(a["line"]), F.size(b["line"]))
    agree = (shared > 0) & (F.slice(a["line"], 1, shared) == F.slice(b["line"], 1, shared)) & (a["marks"] == b["marks"])
    meet = F.size(F.array_intersect(a["nisbas"], b["nisbas"])) > 0
    apart = (F.size(a["nisbas"]) > 0) & (F.size(b["nisbas"]) > 0) & ~meet
    clash = F.coalesce((a["rank"] >= TRUSTED) != (b["rank"] >= TRUSTED), F.lit(False))
    eras = F.coalesce((a["rank"] == COMPANION) != (b["rank"] == COMPANION), F.lit(False))
    dated, both_kunya = a["year"].isNotNull() & b["year"].isNotNull(), a["kunya"].isNotNull() & b["kunya"].isNotNull()
    plain = F.when(meet, ~clash).when(dated, F.abs(a["year"] - b["year"]) <= YEARS).when(both_kunya, a["kunya"] == b["kunya"]).otherwise(F.lit(False))
    deep = (shared >= 3) & ~clash & ~eras
    return F.coalesce(agree & ~apart & (plain | deep), F.lit(False))


def collapse(df: DataFrame, key: str, name: str, year: str, kunya: str, rank: str) -> DataFrame:
    """(key, man): each record with the smallest key among the records of the same man.

    Records that agree in all ``traits`` are one profile; profiles of one block that share an origin, a teknonym, a
    grandfather or dates of death within reach of each other are compared, as no others can be the same, so that a
    frequent pair of names is divided.  What is the same directly or through others is one man.  Records without a name stand alone.
    """
    seen = df.select(F.col(key).cast("bigint").alias("k"), ident_key(F.col(name)).alias("block"), *traits(F.col(name), F.col(year), F.col(kunya), F.col(rank)))
    parts = ["block", *TRAITS]
    shaped = seen.withColumn("shape", F.sha2(F.to_json(F.struct(*parts)), 256))
    profiles = shaped.where(F.coalesce("block", F.lit("")) != "").groupBy("shape").agg(F.min("k").alias("p"), *[F.first(c).alias(c) for c in parts])
    step = F.floor(F.col("year") / (YEARS + 1))
    spots = F.concat(
        F.transform("nisbas", lambda n: F.concat(F.lit("n"), n)),
        F.array_compact(F.array(F.concat(F.lit("k"), "kunya"), F.concat(F.lit("g"), F.get("line", F.lit(2))), F.concat(F.lit("y"), step.cast("string")), F.concat(F.lit("y"), (step + 1).cast("string")))),
    )
    spread = profiles.select("p", *TRAITS, F.explode(F.transform(spots, lambda x: F.concat(F.col("block"), F.lit("|"), x))).alias("spot"))
    pairs = block_pairs(spread, "p", F.col("spot"), TRAITS)
    side = lambda s: {c: F.col(f"{c}_{s}") for c in TRAITS}
    same = pairs.where(same_man(side("a"), side("b"))).select("a", "b").distinct()
    men = connected(same).withColumnRenamed("id", "p")
    of_shape = profiles.select("shape", "p").join(men, "p", "left").select("shape", F.coalesce("component", "p").alias("man"))
    return shaped.select("k", "shape").join(of_shape, "shape", "left").select(F.col("k").alias(key), F.coalesce("man", "k").alias("man"))


def merged_gaps(df: DataFrame, by: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(by, n, fields): one record for each group; each field is the first non-null value in the order, in one aggregation."""
    place = F.struct(*order)
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *first)


def not_covered(df: DataFrame, seed: DataFrame, tokens: Column, seed_tokens: Column) -> DataFrame:
    """Records whose set of name words is none of the seed's."""
    covered = seed.select(F.array_join(seed_tokens, " ").alias("_t")).distinct()
    return df.withColumn("_t", F.array_join(tokens, " ")).join(covered, "_t", "left_anti").drop("_t")


def distinctive(df: DataFrame, group: str, member: str, feature: str) -> DataFrame:
    """(group, member, feature): the features that only one member of a group of namesakes has."""
    own = df.select(group, member, feature).where(F.col(feature).isNotNull()).distinct()
    return own.groupBy(group, feature).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias(member)).where("n = 1").select(group, member, feature)


def opinions_by_source(df: DataFrame, key: str, opinions: str) -> DataFrame:
    """(key, opinions, disputed): the first opinion of each source in the list, sorted by source; disputed with two grades or more."""
    listed = df.select(key, F.posexplode(opinions)).select(key, "pos", F.col("col.source").alias("source"), F.col("col.grade").alias("grade")).where(F.col("source").isNotNull() & F.col("grade").isNotNull())
    kept = listed.groupBy(key, "source").agg(F.min_by("grade", "pos").alias("grade"))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "grade"))).alias("opinions"), (F.count_distinct("grade") >= 2).alias("disputed"))


def lookup(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """(q, entry, score, ambiguous): the entries that a cited name stands for.

    ``queries``: (q, tokens) in order; ``forms``: (entry, tokens).  A form that the query begins with is contained and
    beats every partial match, the longest one first; a query whose words all stand in a form, in order, matches it
    partially, better where the form begins with it.  A single-word form matches a single-word query only.
    Candidates come from an equi-join on the rarest word of the query or form.
    """
    words_ = forms.select("entry", "tokens", F.explode(F.array_distinct("tokens")).alias("w"))
    spread = words_.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("q", F.col("tokens").alias("qt"), F.explode(F.array_distinct("tokens")).alias("w")).join(spread, "w")
    rarest = asked.groupBy("q", "qt").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    by_query = rarest.join(words_, "w").select("q", "qt", "entry", "tokens")
    own = words_.join(spread, "w").groupBy("entry", "tokens").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    by_form = asked.select("q", "qt", "w").join(own, "w").select("q", "qt", "entry", "tokens")
    met = by_query.unionByName(by_form).distinct()
    n, m = F.size("tokens"), F.size("qt")
    single = (n == 1) & (F.size(F.array_distinct("qt")) > 1)
    leads = F.slice("qt", 1, n) == F.col("tokens")
    begins = F.slice("tokens", 1, m) == F.col("qt")
    inside = (F.filter("tokens", lambda t: F.array_contains("qt", t)) == F.col("qt")) & (F.size(F.array_except("qt", "tokens")) == 0)
    level = F.when(leads & ~single, F.struct(F.lit(2), n, F.lit(0))).when(begins, F.struct(F.lit(1), m, F.lit(1))).when(inside, F.struct(F.lit(1), m, F.lit(0)))
    scored = met.where(F.size("qt") > 0).select("q", "entry", level.alias("level")).where(F.col("level").isNotNull()).groupBy("q", "entry").agg(F.max("level").alias("level"))
    best = Window.partitionBy("q")
    top = scored.withColumn("best", F.max("level").over(best)).where(F.col("level") == F.col("best")).withColumn("rivals", F.count(F.lit(1)).over(best))
    score = F.when(F.col("level.col1") == 2, 1.0).when(F.col("level.col3") == 1, 0.8).otherwise(0.5)
    return top.select("q", "entry", score.alias("score"), (F.col("rivals") > 1).alias("ambiguous"))
