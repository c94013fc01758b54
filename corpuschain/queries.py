"""Queries of the core, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuschain.functions import extract as X
from corpuschain.functions import grades as G
from corpuschain.functions import text as T
from corpuschain.operators import books, entity, graph, index, overlap, search, skew
from corpuschain.plans import retrieval
from corpuschain.plans import verdicts as V
from corpuschain.sources import io
from corpuschain.sqltext import bm25_sql, grades_sql, latin_sql, lineage_sql, norm_sql, quoted, strip_sql, words_sql
from corpuschain.streaming import events as stream
from corpuschain.tables import table, texts

Query = Callable[[SparkSession, str], DataFrame]

def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf, "link"), "teacher", percent=1, value="student").select("teacher")


def p7_teachers(spark: SparkSession, sf: str) -> DataFrame:
    """Each teacher's rows, distinct students, most frequent student, and median and 90th percentile of weight."""
    links = table(spark, sf, "link").where(F.col("teacher").isNotNull())
    students = skew.distinct_and_mode(skew.compress(links, "teacher", ["student"]), "teacher", "student")
    weights = skew.percentiles(skew.compress(links, "teacher", ["weight"]), "teacher", "weight", [0.5, 0.9])
    return students.join(weights.drop("n_values"), "teacher", "left").select(
        "teacher", skew.N, F.col("n_distinct").alias("n_students"), F.col("mode").alias("top_student"),
        F.col("mode_rows").alias("top_student_rows"), F.col("p50").alias("weight_p50"), F.col("p90").alias("weight_p90"),
    )


def p7_narrators(spark: SparkSession, sf: str) -> DataFrame:
    """Each narrator's stored freq beside the rows that now name them as teacher; links are counted before the join."""
    counted = skew.compress(table(spark, sf, "link").where(F.col("teacher").isNotNull()), "teacher", [])
    narrators = table(spark, sf, "narrator").select("id", "freq")
    return narrators.join(counted, narrators["id"] == counted["teacher"], "left").select(
        "id", "freq", F.coalesce(skew.N, F.lit(0)).alias(skew.N)
    )



# -- retrieval ------------------------------------------------------------------------------

#: Terms of the searches, rare and common ones; the limits below are those of a top-k report.
ENGLISH = ["ledger", "orchard", "chain"]
ARABIC = ["ناسخ", "المعنى", "قريب"]
SEARCHED = [t.replace("ى", "ي") for t in ARABIC]
TOGETHER = ["الكتاب", "ذكر"]
TOP = 20


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents")
    hits = index.kept("documents", sf, docs, "doc_id", {"text": T.latin_words(F.col("text"))}).search(ENGLISH, {"text": 1.0}, "or")
    return _hits(search.ranked(hits, TOP, F.desc("score"), F.asc("id")))


def _reports(spark: SparkSession, sf: str) -> index.Index:
    return retrieval.indexed(texts(spark, sf, "hadith"), sf)


def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored index of the reports holds of each term and column."""
    return _reports(spark, sf).postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_records"), F.sum("tf").alias("n_places"), F.sum("length").alias("length"))


def _search(match: str, where=None, fields=None, terms=SEARCHED) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _hits(retrieval.lexical(_reports(spark, sf), terms, TOP, match, where, fields))

    return run


def facets(spark: SparkSession, sf: str) -> DataFrame:
    """Books and grades of all reports that match any term."""
    known = _reports(spark, sf)
    hits = known.of(SEARCHED).select("id")
    return search.facet_counts(known.records.join(hits, "id", "left_semi"), "book_id", "grade")


def facets_multi_select(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language under the other filters, by genre under the other filters."""
    docs = texts(spark, sf, "documents")
    return search.multi_select_facets(docs, {"lang": F.lower("lang") == "ar", "genre": F.col("genre").isin("web", "misc")}, "lang", "genre", "book_id")


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents")
    return search.term_frequencies(docs, "doc_id", T.latin_words(F.col("text")))


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "hadith").select("id", T.normalize(F.col("matn")).alias("norm"), T.strip_diacritics(F.col("matn")).alias("plain"), T.text_key(F.col("matn")).alias("key"))


def kunya_folding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "seed").select("seed_id", F.array_join(T.fold_kunya(T.words(T.normalize(F.col("name")))), " ").alias("folded"))


def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", F.md5(T.clean_body(F.col("text")).cast("binary")).alias("clean"))


def page_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every report whose folded body holds the phrase, with its surroundings."""
    found = texts(spark, sf, "hadith").select("id", T.page_hit(F.col("matn"), "في الكتاب").alias("hit"))
    return found.where(F.col("hit").isNotNull())


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The words around the first term in every report."""
    terms = F.array(*map(F.lit, SEARCHED))
    return texts(spark, sf, "hadith").select("id", T.excerpt(F.col("matn"), terms).alias("excerpt"))


def chunk_passages(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "chunk"))


def passage_rejoin(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each document joined again: its words with single spaces."""
    return books.passages(chunk_passages(spark, sf), ["doc_id"], "pos", "chunk").select("doc_id", F.md5(F.col("text").cast("binary")).alias("words"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to the first one."""
    vectors = table(spark, sf, "embeddings")
    query = vectors.orderBy("vec_id").select("embedding").head()
    return search.vector_top(vectors, "vec_id", "embedding", query["embedding"] if query else [1.0], TOP)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of all documents, by length and by title, fused."""
    docs = texts(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "title")
    one = search.ranked(docs.select("id", "n_chars"), 200, F.desc("n_chars"), F.asc("id"))
    two = search.ranked(docs.select("id", "title"), 200, F.asc_nulls_last("title"), F.asc("id"))
    return search.reciprocal_rank_fusion(one, two).select("id", F.round("score", 8).alias("score"))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    h, v = texts(spark, sf, "hadith"), table(spark, sf, "vec")
    query = v.orderBy("id").select("v").head()
    lexical = retrieval.lexical(_reports(spark, sf), SEARCHED, 80, "or")
    return retrieval.hybrid(lexical, v, query["v"] if query else [1.0], retrieval.reports(h), TOP)


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Hash embeddings of all reports' bodies at the default size, as their non-zero buckets."""
    found = search.hash_buckets(texts(spark, sf, "hadith"), "id", T.words(T.normalize(F.col("matn"))))
    return found.select("id", "bucket", F.round("x", 6).alias("x"))


def cited_answer(spark: SparkSession, sf: str) -> DataFrame:
    h = texts(spark, sf, "hadith")
    return retrieval.cited_answer(retrieval.lexical(_reports(spark, sf), SEARCHED, 5), h, table(spark, sf, "book"))


# -- parallels ------------------------------------------------------------------------------

def overlap_parallels(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every report whose id is divisible by 20, against all reports, from the operator's least overlap on."""
    h = texts(spark, sf, "hadith")
    return retrieval.parallels(h, h.where("id % 20 = 0").select("id"))


#: Distinct words from which a document can overlap with another; smaller ones would chain.
LEAST = 10


def _document_sets(spark: SparkSession, sf: str, least: int = LEAST) -> DataFrame:
    return overlap.word_sets(texts(spark, sf, "documents"), "doc_id", T.latin_words(F.col("text")), least)


def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different word sets that overlap by 0.8 or more, under their smallest document."""
    distinct, _ = overlap.representatives(_document_sets(spark, sf))
    return overlap.similar_pairs(distinct, 0.8).select("a", "b", F.round("overlap", 6).alias("overlap"))


def near_dup_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the smallest one of its group of near copies.

    Documents of few distinct words are copies of those with the same words only, those without words of none.
    """
    distinct, members = overlap.representatives(_document_sets(spark, sf, 1))
    groups = graph.connected(overlap.similar_links(distinct.where(F.size("words") >= LEAST), 0.8)).withColumnRenamed("id", "rep")
    found = table(spark, sf, "documents").select("doc_id").join(members.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(groups, "rep", "left")
    return found.select("doc_id", F.coalesce("component", "rep", "doc_id").alias("component"))


def leader_clusters(spark: SparkSession, sf: str) -> DataFrame:
    h = texts(spark, sf, "hadith")
    """All hits of a search, best first, with their leaders."""
    found = retrieval.lexical(_reports(spark, sf), SEARCHED, None, "or").select("id", (-F.col("score")).alias("order"))
    return overlap.leaders(found.join(h.select("id", T.words(T.normalize(F.col("matn"))).alias("words")), "id"), "order", "id", "words")


# -- chains and networks --------------------------------------------------------------------

def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each order in line order, as chains."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain"), (F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey")).alias("pos"), F.col("l_suppkey").alias("name"))


def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_weights(graph.links(_sequences(spark, sf), "chain", "pos", "name"))


def node_freq(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_frequencies(_sequences(spark, sf), F.col("name"), "pos", "chain", "pos").select("node", "freq", F.col("name").alias("first_pos"))


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "link").where("teacher <> student").select("teacher", "student")
    return graph.adjacency(edges).select("node", F.size("neighbours").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").cast("binary")).alias("neighbours"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """All students of the teacher with the most of them, by weight."""
    edges = table(spark, sf, "link").where("teacher <> student").groupBy("teacher", "student").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("weight"))
    first = table(spark, sf, "link").where("teacher IS NOT NULL").groupBy("teacher").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "teacher").limit(1).select("teacher")
    return graph.neighbours(edges, table(spark, sf, "narrator"), "id", "name", first.scalar(), as_teacher=True)


def continuity(spark: SparkSession, sf: str) -> DataFrame:
    """How many links of each order's sequence other orders know."""
    adjacent = graph.links(_sequences(spark, sf), "chain", "pos", "name")
    return graph.continuity(adjacent, graph.edge_weights(adjacent).where("weight >= 2"), "chain")


def _named_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of each order's lines in line order; open lines have a longer name."""
    name = F.concat_ws(" ", "l_returnflag", F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.col("l_linestatus")))
    place = F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain"), F.struct(place, "l_partkey", name).alias("pos"), name.alias("name"))


def context_map(spark: SparkSession, sf: str) -> DataFrame:
    return graph.context_map(_named_sequences(spark, sf), "chain", "pos", "name")


def weakest_link(spark: SparkSession, sf: str) -> DataFrame:
    """The worst discount rank of each order, its unknown and unnamed lines, and the ruling."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain"), F.when(F.col("l_tax") > 0, F.round(F.col("l_discount") * 100).cast("int")).alias("rank"), (F.col("l_returnflag") == "R").alias("hidden"))
    worst = graph.weakest(lines, "chain", "rank", "hidden")
    return worst.select("*", graph.ruling(F.col("weakest"), F.col("n_unknown"), F.col("n_unnamed"), F.col("n_known") >= 3).alias("ruling"))


def max_min_strength(spark: SparkSession, sf: str) -> DataFrame:
    """For each customer the best of their orders' worst discounts."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.strength(lines.withColumn("rank", F.round(F.col("l_discount") * 100).cast("int")), ["o_custkey"], "l_orderkey", "rank")


def isnad_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The narrators of every chain."""
    return texts(spark, sf, "hadith").select("id", F.posexplode(X.narrators(True)(F.col("isnad"))).alias("pos", "n")).select("id", "pos", "n.*")


def isnad_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Teacher and student by search form, with the number of chains that link them."""
    named = isnad_chains(spark, sf).select("id", "pos", "route_start", T.normalize(F.col("name")).alias("name"))
    return graph.edge_weights(graph.links(named, "id", "pos", "name", "route_start"))


def chain_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The ruling on the chain of every report, its narrators looked up among the entries."""
    entries = table(spark, sf, "rijal_entry")
    forms = entries.select(F.col("entry_id").alias("entry"), T.words(T.normalize(F.col("name"))).alias("tokens")).where(F.size("tokens") > 0)
    chains = isnad_chains(spark, sf).withColumnRenamed("id", "chain")
    return V.verdicts(chains, forms, V.graded_entries(entries, "entry_id", "grade_text", "opinions"))


def report_split(spark: SparkSession, sf: str) -> DataFrame:
    """Chain and body joined and taken apart again."""
    h = texts(spark, sf, "hadith")
    return h.select("id", X.report_parts(F.concat_ws(" ", "isnad", "matn")).alias("r")).select("id", "r.*")


# -- books ----------------------------------------------------------------------------------

def collections_ordered(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "hadith").join(table(spark, sf, "book").select(F.col("id").alias("book_id"), "name"), "book_id", "left")
    return books.collections(named, "book_id", "id", "name").withColumn("name", F.coalesce("name", F.col("book_id").cast("string")))


def chapter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return books.chapters(table(spark, sf, "hadith").withColumn("number", F.col("number").cast("string")), "book_id", "chapter", "number", "page_id", "id")


def topk_paged(spark: SparkSession, sf: str) -> DataFrame:
    return books.paged(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 40, 20, F.desc("o_totalprice"), F.asc("o_orderkey"))


def inherit_previous(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "hadith").select("id", "book_id", "chapter")
    return books.inherited(h, "book_id", ["id"], "chapter", F.col("chapter").isNull())


def running_max(spark: SparkSession, sf: str) -> DataFrame:
    return books.running_max(table(spark, sf, "hadith").select("id", "book_id", "number"), "book_id", ["id"], "number", "highest")


def range_end(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "hadith").where("page_id IS NOT NULL").select("book_id", "page_id").distinct()
    return books.ranges(starts, "book_id", "page_id", "last_page")


def dense_run(spark: SparkSession, sf: str) -> DataFrame:
    return books.dense_start(table(spark, sf, "hadith"), "book_id", "id", F.col("grade").isNotNull())


def citation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each chapter's books with the numbers of its reports."""
    h = table(spark, sf, "hadith").where("chapter IS NOT NULL").withColumn("collection", F.col("book_id").cast("string"))
    return books.citation_line(h, "chapter", "collection", "number", "id").select("chapter", F.md5(F.col("line").cast("binary")).alias("line"))


# -- entities -------------------------------------------------------------------------------

def grade_classify(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "rijal_entry").select("entry_id", G.classify(F.col("grade_text")).alias("g")).select("entry_id", "g.*")


def grade_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return grade_classify(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def merge_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "rijal_entry").where("person_no IS NOT NULL")
    return entity.merged_gaps(entries, "person_no", ["entry_id"], ["name", "kunya", "grade_text", "death_year", "source"])


def collapse_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry with the smallest one of the same man."""
    entries = table(spark, sf, "rijal_entry").withColumn("graded", G.classify(F.col("grade_text"))["rank"])
    return entity.collapse(entries, "entry_id", "name", "death_year", "kunya", "graded")


def anti_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose name words are those of no seed."""
    tokens = entity.name_tokens(F.col("name"))
    return entity.not_covered(table(spark, sf, "rijal_entry").select("entry_id", "name"), table(spark, sf, "seed"), tokens, tokens).select("entry_id")


def distinctive_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books in which only one of the narrators with the same given name teaches."""
    named = table(spark, sf, "narrator").select(F.col("id").alias("teacher"), F.split(T.normalize(F.col("norm")), " ")[0].alias("ism"))
    taught = table(spark, sf, "link").where("teacher IS NOT NULL").select("teacher", "book_id").distinct()
    return entity.distinctive(taught.join(named, "teacher"), "ism", "teacher", "book_id")


def block_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different names with the same own name and father, with the number of shared words."""
    folded = T.normalize(F.col("name"))
    named = table(spark, sf, "rijal_entry").select("entry_id", folded.alias("name")).where("name <> ''").groupBy("name").agg(F.min("entry_id").alias("id"))
    pairs = entity.block_pairs(named.withColumn("tokens", entity.name_tokens(F.col("name"))), "id", entity.ident_key(F.col("name")), ["tokens"])
    return pairs.select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("bigint").alias("shared"))


def opinion_sets(spark: SparkSession, sf: str) -> DataFrame:
    kept = entity.opinions_by_source(table(spark, sf, "seed"), "seed_id", "opinions")
    return kept.select("seed_id", F.size("opinions").cast("bigint").alias("n_sources"), "disputed")


def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every different name of the entries looked up among the names of the persons."""
    words = T.words(T.normalize(F.col("name")))
    entries = table(spark, sf, "rijal_entry").select("entry_id", "person_no", words.alias("tokens")).where(F.size("tokens") > 0)
    asked = entries.groupBy("tokens").agg(F.min("entry_id").alias("q")).select("q", "tokens")
    forms = entries.where("person_no IS NOT NULL").select(F.col("person_no").alias("entry"), "tokens").distinct()
    return entity.lookup(asked, forms)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Narrators that teach, learn, both or neither: nodes, and their share of all links."""
    links = table(spark, sf, "link")
    taught = links.where("teacher IS NOT NULL").groupBy(F.col("teacher").alias("id")).agg(F.count(F.lit(1)).alias("n_t"))
    learnt = links.where("student IS NOT NULL").groupBy(F.col("student").alias("id")).agg(F.count(F.lit(1)).alias("n_s"))
    role = F.when(F.col("n_t").isNotNull() & F.col("n_s").isNotNull(), "both").when(F.col("n_t").isNotNull(), "teacher").when(F.col("n_s").isNotNull(), "student").otherwise("neither")
    every = table(spark, sf, "narrator").select("id", "freq").join(taught, "id", "left").join(learnt, "id", "left")
    return every.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"), F.sum(F.coalesce("n_t", F.lit(0)) + F.coalesce("n_s", F.lit(0))).alias("links"))


def flag_body(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "hadith").select("id", F.array_join(X.body_flags(F.col("matn"), F.col("isnad")), "").alias("flags"))


def report_grades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hadith").select("id", G.bare_grade(F.col("grade")).alias("bare"), G.report_grade(F.concat(F.lit("["), F.col("grade"), F.lit("]"))).alias("bracketed"))


def incremental_embed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What an incremental run over the bodies finds in a cache of the folded bodies."""
    h = table(spark, sf, "hadith")
    cache = h.where("matn_norm IS NOT NULL").select(io.cache_key(F.col("matn_norm"), "hash", 64).alias("h"))
    return io.cache_counts(h, cache, "matn", "hash", 64)


# -- extension: windows over events ---------------------------------------------------------

def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return stream.tumbling(table(spark, sf, "events"), "1 day")


def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sessions(table(spark, sf, "events"), "6 hours")


def queries() -> dict[str, Query]:
    plain = [
        p7_found,
        p7_teachers,
        p7_narrators,
        bm25_topk,
        index_build,
        facets,
        facets_multi_select,
        term_df,
        text_normalize,
        kunya_folding,
        html_clean,
        page_search,
        excerpts,
        chunk_passages,
        passage_rejoin,
        vector_topk,
        rrf_fusion,
        hybrid_topk,
        hash_embed,
        cited_answer,
        overlap_parallels,
        near_dup_pairs,
        near_dup_components,
        leader_clusters,
        edge_weights,
        node_freq,
        adjacency,
        neighbours,
        continuity,
        context_map,
        weakest_link,
        max_min_strength,
        isnad_chains,
        isnad_edges,
        chain_verdicts,
        report_split,
        collections_ordered,
        chapter_counts,
        topk_paged,
        inherit_previous,
        running_max,
        range_end,
        dense_run,
        citation_lines,
        grade_classify,
        grade_distribution,
        merge_gap_fill,
        collapse_duplicates,
        anti_seed,
        distinctive_books,
        block_pairs,
        opinion_sets,
        name_lookup,
        coverage,
        flag_body,
        report_grades,
        incremental_embed_counts,
        events_tumbling,
        events_sessions,
    ]
    return {f.__name__: f for f in plain} | {
        "search_or": _search("or"),
        "search_and": _search("and", terms=TOGETHER),
        "search_auto": _search("auto"),
        "search_filtered": _search("or", "grade = 'ضعيف'"),
        "search_in_field": _search("or", None, ["matn"]),
    }


def oracle_sql() -> dict[str, str]:
    words = {f: words_sql(norm_sql(f)) for f in ("matn", "chapter", "isnad")}
    body = "coalesce(kind, 'hadith') = 'hadith' AND trim(matn) <> ''"
    found = lambda match, keep=body, terms=SEARCHED, fields=(): bm25_sql("hadith", words, terms, search.WEIGHTS, match, keep, TOP, fields)
    any_term = " OR ".join(f"list_has_any({w}, [{', '.join(map(quoted, SEARCHED))}])" for w in words.values())
    sequences = "SELECT l_orderkey AS chain, l_linenumber * 10000000 + l_suppkey AS pos, l_suppkey AS name FROM lineitem"
    adjacent = f"SELECT * FROM (SELECT chain, pos, name AS student, lead(name) OVER (PARTITION BY chain ORDER BY pos) AS teacher FROM ({sequences})) WHERE student <> teacher"
    tokens = lambda c: f"list_sort(list_distinct(list_filter({words_sql(norm_sql(c))}, lambda w: w NOT IN ('بن', 'ابن'))))"
    return {
        "p7_found": "SELECT teacher FROM link WHERE teacher IS NOT NULL GROUP BY teacher HAVING count(*) * 100 >= (SELECT count(*) FROM link)",
        "p7_teachers": """
            WITH l AS (SELECT * FROM link WHERE teacher IS NOT NULL),
            s AS (SELECT teacher, student, count(*) AS n FROM l GROUP BY ALL),
            top AS (SELECT teacher, student, n, row_number() OVER (PARTITION BY teacher ORDER BY n DESC, student) AS r
                    FROM s WHERE student IS NOT NULL),
            w AS (SELECT teacher, weight, row_number() OVER (PARTITION BY teacher ORDER BY weight) AS r,
                         count(*) OVER (PARTITION BY teacher) AS n FROM l WHERE weight IS NOT NULL),
            q AS (SELECT teacher, min(weight) FILTER (WHERE r >= ceil(0.5 * n)) AS weight_p50,
                         min(weight) FILTER (WHERE r >= ceil(0.9 * n)) AS weight_p90 FROM w GROUP BY teacher)
            SELECT a.teacher, a.n_rows, a.n_students, top.student AS top_student, top.n AS top_student_rows, weight_p50, weight_p90
            FROM (SELECT teacher, count(*) AS n_rows, count(DISTINCT student) AS n_students FROM l GROUP BY teacher) a
            LEFT JOIN top ON top.teacher = a.teacher AND top.r = 1 LEFT JOIN q ON q.teacher = a.teacher""",
        "p7_narrators": """
            SELECT id, freq, coalesce(n, 0) AS n_rows FROM narrator
            LEFT JOIN (SELECT teacher, count(*) AS n FROM link GROUP BY teacher) ON teacher = id""",
        "bm25_topk": bm25_sql("(SELECT doc_id AS id, text FROM documents)", {"text": latin_sql("text")}, ENGLISH, {"text": 1.0}, "or", "true", TOP),
        "search_or": found("or"),
        "search_and": found("and", terms=TOGETHER),
        "search_auto": found("auto"),
        "search_filtered": found("or", body + " AND grade = 'ضعيف'"),
        "search_in_field": found("or", fields=("matn",)),
        "facets": f"""
            WITH m AS (SELECT * FROM hadith WHERE {any_term})
            SELECT 'book_id' AS facet, CAST(book_id AS VARCHAR) AS value, count(*) AS n FROM m WHERE book_id IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'grade', grade, count(*) FROM m WHERE grade IS NOT NULL GROUP BY ALL""",
        "kunya_folding": f"""
            WITH k AS (SELECT seed_id, {words_sql(norm_sql('name'))} AS ws FROM seed)
            SELECT seed_id, array_to_string(list_transform(ws, lambda x, i: CASE WHEN x = 'ابي' AND coalesce(ws[i + 1], '') = 'بن' THEN x WHEN x IN ('ابو', 'ابا', 'ابي') THEN 'ابو' ELSE x END), ' ') AS folded FROM k""",
        "hash_embed": f"""
            WITH w AS (SELECT id, unnest({words['matn']}) AS w FROM hadith), c AS (SELECT id, CAST('0x' || right(md5(w), 2) AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY ALL)
            SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM c""",
        "hybrid_topk": f"""
            WITH q AS MATERIALIZED (SELECT CAST(v AS DOUBLE[]) AS qv FROM vec ORDER BY id LIMIT 1),
            v AS MATERIALIZED (SELECT id, CAST(v AS DOUBLE[]) AS v FROM vec WHERE len(v) = (SELECT len(qv) FROM q) AND id IN (SELECT id FROM hadith WHERE {body})),
            a AS (SELECT id, round(list_dot_product(v, qv), 6) AS s FROM v, q), b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM a),
            l AS ({bm25_sql("hadith", words, SEARCHED, search.WEIGHTS, "or", body, 80)}),
            r AS (SELECT id, rank FROM l UNION ALL SELECT id, rank FROM b WHERE rank <= 80)
            SELECT id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT {TOP}""",
        "block_pairs": f"""
            WITH n AS (SELECT min(entry_id) AS id, name FROM (SELECT entry_id, {norm_sql('name')} AS name FROM rijal_entry) WHERE name <> '' GROUP BY name),
            w AS (SELECT id, {words_sql('name')} AS ws FROM n), l AS (SELECT *, {lineage_sql('ws')} AS line FROM w),
            k AS (SELECT id, CASE WHEN len(line) > 0 THEN array_to_string(line[1:2], ' ') ELSE array_to_string(ws[1:3], ' ') END AS block, list_distinct(list_filter(ws, lambda x: x NOT IN ('بن', 'ابن'))) AS ts FROM l)
            SELECT a.id AS a, b.id AS b, len(list_intersect(a.ts, b.ts)) AS shared FROM k a JOIN k b USING (block) WHERE a.id < b.id AND block <> ''""",
        "collapse_duplicates": f"""
            WITH RECURSIVE g AS ({grades_sql('rijal_entry', 'entry_id', 'grade_text')}),
            w AS (SELECT e.entry_id AS k, death_year AS y, nullif({norm_sql('kunya')}, '') AS ku, g.rank AS r, {words_sql(norm_sql('name'))} AS ws FROM rijal_entry e JOIN g ON g.entry_id = e.entry_id),
            l AS (SELECT *, {lineage_sql('ws')} AS line, list_sort(list_distinct(list_filter(ws, lambda x: x LIKE 'ال%ي' AND len(x) >= 4))) AS nis,
                         list_sort(list_distinct(list_filter(ws, lambda x: x IN ('الكبير', 'الاكبر', 'الحفيد', 'حفيد', 'الاصغر', 'الصغير', 'الابن', 'الاب', 'الجد')))) AS marks FROM w),
            e AS (SELECT *, CASE WHEN len(line) > 0 THEN array_to_string(line[1:2], ' ') ELSE array_to_string(ws[1:3], ' ') END AS block FROM l WHERE len(ws) > 0),
            p AS (SELECT a.k AS a, b.k AS b, least(len(a.line), len(b.line)) AS n, a.line AS la, b.line AS lb, a.marks = b.marks AS same_marks, list_has_any(a.nis, b.nis) AS meet,
                         len(a.nis) > 0 AND len(b.nis) > 0 AND NOT list_has_any(a.nis, b.nis) AS apart, coalesce((a.r >= 5) <> (b.r >= 5), false) AS clash, coalesce((a.r = 10) <> (b.r = 10), false) AS eras,
                         abs(a.y - b.y) <= 20 AS near, a.ku = b.ku AS kin,
                         (a.line, a.nis, a.marks) = (b.line, b.nis, b.marks) AND a.y IS NOT DISTINCT FROM b.y AND a.ku IS NOT DISTINCT FROM b.ku AND a.r IS NOT DISTINCT FROM b.r AS alike
                  FROM e a JOIN e b ON a.block = b.block AND a.k < b.k),
            s AS (SELECT a, b FROM p WHERE alike OR (n > 0 AND la[1:n] = lb[1:n] AND same_marks AND NOT apart AND (CASE WHEN meet THEN NOT clash WHEN near IS NOT NULL THEN near WHEN kin IS NOT NULL THEN kin ELSE false END OR (n >= 3 AND NOT clash AND NOT eras)))),
            d AS (SELECT a, b FROM s UNION SELECT b, a FROM s), c AS (SELECT a AS k, a AS top FROM d UNION SELECT c.k, d.b FROM c JOIN d ON c.top = d.a), m AS (SELECT k, min(top) AS man FROM c GROUP BY k)
            SELECT entry_id, least(coalesce(man, entry_id), entry_id) AS man FROM rijal_entry LEFT JOIN m ON m.k = entry_id""",
        "name_lookup": f"""
            WITH e AS (SELECT entry_id, person_no, {words_sql(norm_sql('name'))} AS ts FROM rijal_entry WHERE len({words_sql(norm_sql('name'))}) > 0),
            q AS (SELECT min(entry_id) AS q, ts AS qt FROM e GROUP BY ts), f AS (SELECT DISTINCT person_no AS entry, ts FROM e WHERE person_no IS NOT NULL),
            l AS (SELECT q, entry, CASE WHEN qt[1:len(ts)] = ts AND NOT (len(ts) = 1 AND len(list_distinct(qt)) > 1) THEN [2, len(ts), 0] WHEN ts[1:len(qt)] = qt THEN [1, len(qt), 1]
                                        WHEN list_filter(ts, lambda x: list_contains(qt, x)) = qt THEN [1, len(qt), 0] END AS level FROM q, f),
            b AS (SELECT q, entry, max(level) AS level FROM l WHERE level IS NOT NULL GROUP BY ALL), t AS (SELECT *, max(level) OVER (PARTITION BY q) AS best FROM b)
            SELECT q, entry, CASE WHEN level[1] = 2 THEN 1.0 WHEN level[3] = 1 THEN 0.8 ELSE 0.5 END AS score, count(*) OVER (PARTITION BY q) > 1 AS ambiguous FROM t WHERE level = best""",
        "facets_multi_select": """
            SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE genre IN ('web', 'misc') AND lang IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'genre', genre, count(*) FROM documents WHERE lower(lang) = 'ar' AND genre IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'book_id', CAST(book_id AS VARCHAR), count(*) FROM documents WHERE genre IN ('web', 'misc') AND lower(lang) = 'ar' AND book_id IS NOT NULL GROUP BY ALL""",
        "term_df": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({latin_sql('text')})) AS term FROM documents) GROUP BY term",
        "text_normalize": f"SELECT id, {norm_sql('matn')} AS norm, {strip_sql('matn')} AS plain, sha256({norm_sql('matn')}) AS key FROM hadith",
        "page_search": f"""
            WITH p AS (SELECT id, {norm_sql('matn')} AS t, instr({norm_sql('matn')}, 'في الكتاب') AS hit_at FROM hadith),
            q AS (SELECT *, greatest(hit_at - 40, 1) AS s FROM p WHERE hit_at > 0), r AS (SELECT *, substring(t, s, hit_at - s + 49) AS piece FROM q)
            SELECT id, CASE WHEN s > 1 THEN '…' ELSE '' END || piece || CASE WHEN s + length(piece) <= length(t) THEN '…' ELSE '' END AS hit FROM r""",
        "passage_rejoin": r"""
            SELECT doc_id, md5(trim(regexp_replace(trim(text), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS words FROM documents
            WHERE text IS NOT NULL AND trim(regexp_replace(trim(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) <> ''""",
        "html_clean": f"""
            SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'),
                   '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g'), '[\\(\\[]\\s*[0-9\\x{{660}}-\\x{{669}}]{{1,3}}\\s*[\\)\\]]', '', 'g'), {quoted(T.SPACES)}, ' ', 'g'))) AS clean FROM documents""",
        "vector_topk": f"""
            WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
            SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q
            ORDER BY score DESC, id LIMIT {TOP}""",
        "rrf_fusion": """
            WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents),
            b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY title NULLS LAST, doc_id) AS r FROM documents)
            SELECT id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM a WHERE r <= 200 UNION ALL SELECT * FROM b WHERE r <= 200) GROUP BY id""",
        "overlap_parallels": f"""
            WITH w AS (SELECT id, book_id, coalesce(number, -id) AS slot, list_distinct({words['matn']}) AS ws FROM hadith WHERE {body}),
            t AS (SELECT id, book_id, slot, len(ws) AS m, unnest(ws) AS word FROM w),
            s AS (SELECT a.id AS q, b.id AS id, any_value(b.book_id) AS book_id, any_value(b.slot) AS slot, count(*) / least(any_value(a.m), any_value(b.m)) AS o
                  FROM t a JOIN t b USING (word) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY a.id, b.id),
            r AS (SELECT *, row_number() OVER (PARTITION BY q, book_id, slot ORDER BY o DESC, id) AS r FROM s WHERE round(o, 9) >= 0.4)
            SELECT q, id, round(o, 3) AS overlap, CASE WHEN round(o, 3) >= 0.85 THEN 'verbatim' WHEN round(o, 3) >= 0.6 THEN 'near' ELSE 'by meaning' END AS label FROM r WHERE r = 1""",
        "near_dup_pairs": f"""
            WITH w AS (SELECT doc_id, list_sort(list_distinct({latin_sql('text')})) AS ws FROM documents), k AS (SELECT min(doc_id) AS id, ws FROM w WHERE len(ws) >= 10 GROUP BY ws),
            t AS (SELECT id, len(ws) AS m, unnest(ws) AS word FROM k),
            s AS (SELECT a.id AS a, b.id AS b, count(*) / least(any_value(a.m), any_value(b.m)) AS o FROM t a JOIN t b USING (word) WHERE a.id < b.id GROUP BY a.id, b.id)
            SELECT a, b, round(o, 6) AS overlap FROM s WHERE round(o, 9) >= 0.8""",
        "near_dup_components": f"""
            WITH RECURSIVE w AS (SELECT doc_id, list_sort(list_distinct({latin_sql('text')})) AS ws FROM documents), k AS (SELECT min(doc_id) AS id, ws FROM w WHERE len(ws) > 0 GROUP BY ws),
            t AS (SELECT id, len(ws) AS m, unnest(ws) AS word FROM k WHERE len(ws) >= 10),
            s AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b USING (word) WHERE a.id < b.id GROUP BY a.id, b.id HAVING round(count(*) / least(any_value(a.m), any_value(b.m)), 9) >= 0.8),
            e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
            r AS (SELECT id, id AS top FROM k UNION SELECT r.id, e.b FROM r JOIN e ON r.top = e.a), g AS (SELECT id, min(top) AS component FROM r GROUP BY id)
            SELECT w.doc_id, coalesce(g.component, w.doc_id) AS component FROM w LEFT JOIN k ON w.ws = k.ws LEFT JOIN g ON g.id = k.id""",
        "index_build": "SELECT field, term, count(*) AS n_records, CAST(sum(tf) AS BIGINT) AS n_places, CAST(sum(length) AS BIGINT) AS length FROM (SELECT id, field, term, count(*) AS tf, any_value(length) AS length FROM ("
        + " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest({w}) AS term, {' + '.join(f'coalesce(len({x}), 0)' for x in words.values())} AS length FROM hadith" for f, w in words.items())
        + ") GROUP BY id, field, term) GROUP BY field, term",
        # the survey's rules for bodies: missing beside a chain, begins as a chain, an editor's note, a heading or a verse alone
        "flag_body": f"""
            WITH k AS (SELECT id, coalesce(matn, '') AS m, coalesce(isnad, '') AS c, coalesce({norm_sql('matn')}, '') AS b, coalesce({norm_sql('isnad')}, '') AS l,
                              coalesce({norm_sql("regexp_replace(coalesce(matn, ''), '﴿[^﴾]*﴾', ' ', 'g')")}, '') AS rest FROM hadith),
            n AS (SELECT *, len({words_sql('b')}) AS bw, len({words_sql('l')}) AS lw, {words_sql('b')} AS ws,
                         regexp_matches(b || chr(10) || l || chr(10), 'نحوه|مثله|نحو ذلك|مثل ذلك|فذكر|بهذا|باسناده|بسنده|بمعناه|الحديث\n') AS refers FROM k)
            SELECT id, concat(
                CASE WHEN NOT refers AND ((bw = 0 AND lw >= 6) OR (bw <= 3 AND lw >= 8 AND (contains(c, '«') OR contains(c, chr(34)) OR contains(c, '“')))) THEN 'V' END,
                CASE WHEN NOT refers AND (list_has_any(ws[1:2], ['حدثنا', 'حدثني', 'اخبرنا', 'اخبرني', 'انبانا', 'انباني', 'ثنا']) OR b LIKE 'عن %') THEN 'I' END,
                CASE WHEN regexp_matches(b, 'هذا حديث|هذا اسناد|هذا خبر|علي شرط|اخرجاه|وفي الباب|قال ابو داود|قال ابو عيسي|تلخيص الذهبي')
                       OR regexp_matches(replace(b, 'اخرجه الله', ''), 'اخرجه') OR regexp_matches(replace(b, 'رواه عنه', ''), 'رواه') THEN 'G' END,
                CASE WHEN ws[1] IN ('باب', 'كتاب', 'فصل', 'جماع') OR ((contains(m, '﴿') OR contains(m, '﴾')) AND len({words_sql('rest')}) <= 3) THEN 'Q' END) AS flags FROM n""",
        "edge_weights": f"SELECT teacher, student, count(*) AS weight FROM ({adjacent}) GROUP BY ALL",
        "node_freq": f"SELECT name AS node, count(*) AS freq, arg_min(pos, [chain, pos]) AS first_pos FROM ({sequences}) GROUP BY name",
        "adjacency": """
            WITH e AS (SELECT DISTINCT teacher AS node, student AS other FROM link WHERE teacher <> student UNION SELECT student, teacher FROM link WHERE teacher <> student)
            SELECT node, count(*) AS n, md5(string_agg(CAST(other AS VARCHAR), ',' ORDER BY other)) AS neighbours FROM e GROUP BY node""",
        "neighbours": """
            WITH f AS (SELECT teacher FROM link WHERE teacher IS NOT NULL GROUP BY teacher ORDER BY count(*) DESC, teacher LIMIT 1)
            SELECT n.id, n.name, sum(coalesce(weight, 0)) AS weight FROM link l JOIN f USING (teacher) JOIN narrator n ON n.id = l.student WHERE teacher <> student GROUP BY n.id, n.name""",
        "continuity": f"""
            WITH a AS ({adjacent}), k AS (SELECT teacher, student FROM a GROUP BY ALL HAVING count(*) >= 2)
            SELECT chain, count(*) AS n_links, count(k.teacher) AS n_seen FROM a LEFT JOIN k ON a.teacher = k.teacher AND a.student = k.student GROUP BY chain""",
        "context_map": """
            WITH s AS (SELECT l_orderkey AS chain, l_linenumber * 10000000 + l_suppkey AS pos, l_partkey, concat_ws(' ', l_returnflag, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'O' END) AS name FROM lineitem),
            w AS (SELECT lag(name) OVER c AS prev, name AS "full", lead(name) OVER c AS next FROM s WINDOW c AS (PARTITION BY chain ORDER BY pos, l_partkey, name)),
            g AS (SELECT prev, next, "full", count(*) AS n, len(string_split("full", ' ')) AS size FROM w WHERE prev IS NOT NULL AND next IS NOT NULL GROUP BY ALL),
            m AS (SELECT *, max(size) OVER (PARTITION BY prev, next) AS most FROM g WHERE size >= 2),
            r AS (SELECT *, count(*) OVER (PARTITION BY prev, next) AS rivals FROM m WHERE size = most)
            SELECT prev, next, "full", n FROM r WHERE rivals = 1 AND n >= 2""",
        "weakest_link": """
            WITH l AS (SELECT l_orderkey AS chain, CASE WHEN l_tax > 0 THEN CAST(round(l_discount * 100) AS INT) END AS rank, l_returnflag = 'R' AS hidden FROM lineitem),
            g AS (SELECT chain, min(rank) FILTER (NOT hidden) AS weakest, count(rank) FILTER (NOT hidden) AS n_known,
                         count(*) FILTER (NOT hidden AND rank IS NULL) AS n_unknown, count(*) FILTER (hidden) AS n_unnamed FROM l GROUP BY chain),
            a AS (SELECT *, CASE WHEN weakest IS NULL THEN 'not ruled' WHEN weakest <= 1 THEN 'very weak' WHEN weakest <= 3 THEN 'weak' WHEN weakest <= 6 THEN 'supporting'
                                 WHEN weakest <= 8 THEN 'good' ELSE 'sound' END AS x FROM g),
            b AS (SELECT * REPLACE (CASE WHEN n_unknown > 0 AND x IN ('sound', 'good') THEN 'suspended' ELSE x END AS x) FROM a),
            c AS (SELECT * REPLACE (CASE WHEN n_unnamed > 0 AND x <> 'very weak' THEN 'weak' ELSE x END AS x) FROM b)
            SELECT chain, weakest, n_known, n_unknown, n_unnamed, CASE WHEN x = 'sound' AND n_known < 3 THEN 'sound if hearing is confirmed' ELSE x END AS ruling FROM c""",
        "max_min_strength": """
            SELECT o_custkey, max(w) AS strength FROM (SELECT o_custkey, l_orderkey, min(CAST(round(l_discount * 100) AS INT)) AS w
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey""",
        "collections_ordered": """
            SELECT h.book_id, count(*) AS n, min(h.id) AS first_id, coalesce(any_value(b.name), CAST(h.book_id AS VARCHAR)) AS name FROM hadith h LEFT JOIN book b ON b.id = h.book_id GROUP BY h.book_id""",
        "chapter_counts": "SELECT book_id, chapter, count(*) AS n, min(coalesce(number, page_id)) AS first_number, min(id) AS first_id FROM hadith GROUP BY ALL",
        "topk_paged": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
        "inherit_previous": """
            SELECT id, book_id, coalesce(chapter, last_value(chapter IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS chapter FROM hadith""",
        "running_max": "SELECT id, book_id, number, max(number) OVER (PARTITION BY book_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS highest FROM hadith",
        "range_end": """
            SELECT book_id, page_id, greatest(lead(page_id) OVER (PARTITION BY book_id ORDER BY page_id) - 1, page_id) AS last_page
            FROM (SELECT DISTINCT book_id, page_id FROM hadith WHERE page_id IS NOT NULL)""",
        "dense_run": """
            SELECT book_id, min(id) AS first FROM (SELECT book_id, id, count(grade) OVER (PARTITION BY book_id ORDER BY id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS n FROM hadith)
            WHERE n >= 12 GROUP BY book_id""",
        "citation_lines": """
            WITH p AS (SELECT chapter, CAST(book_id AS VARCHAR) AS c, min(id) AS f, list_sort(list_distinct(list(number) FILTER (number IS NOT NULL))) AS ns FROM hadith WHERE chapter IS NOT NULL GROUP BY ALL)
            SELECT chapter, md5(string_agg(c || CASE WHEN len(ns) > 0 THEN ' ' || array_to_string(ns, ', ') ELSE '' END, '; ' ORDER BY f)) AS line FROM p GROUP BY chapter""",
        "grade_classify": grades_sql("rijal_entry", "entry_id", "grade_text"),
        "grade_distribution": f"SELECT category, count(*) AS n FROM ({grades_sql('rijal_entry', 'entry_id', 'grade_text')}) GROUP BY category",
        "merge_gap_fill": "SELECT person_no, count(*) AS n, " + ", ".join(f"arg_min({c}, entry_id) AS {c}" for c in ("name", "kunya", "grade_text", "death_year", "source")) + " FROM rijal_entry WHERE person_no IS NOT NULL GROUP BY person_no",
        "anti_seed": f"SELECT entry_id FROM rijal_entry WHERE coalesce(array_to_string({tokens('name')}, ' '), chr(1)) NOT IN (SELECT coalesce(array_to_string({tokens('name')}, ' '), chr(2)) FROM seed)",
        "distinctive_books": f"""
            WITH n AS (SELECT id AS teacher, string_split({norm_sql('norm')}, ' ')[1] AS ism FROM narrator),
            o AS (SELECT DISTINCT ism, teacher, book_id FROM link JOIN n USING (teacher) WHERE book_id IS NOT NULL)
            SELECT ism, min(teacher) AS teacher, book_id FROM o GROUP BY ism, book_id HAVING count(*) = 1""",
        "opinion_sets": """
            WITH o AS (SELECT seed_id, unnest(opinions) AS o, generate_subscripts(opinions, 1) AS pos FROM seed),
            k AS (SELECT seed_id, o.source AS s, arg_min(o.grade, pos) AS g FROM o WHERE o.source IS NOT NULL AND o.grade IS NOT NULL GROUP BY ALL)
            SELECT seed_id, count(*) AS n_sources, count(DISTINCT g) >= 2 AS disputed FROM k GROUP BY seed_id""",
        "coverage": """
            WITH e AS (SELECT id, freq, (SELECT count(*) FROM link WHERE teacher = n.id) AS t, (SELECT count(*) FROM link WHERE student = n.id) AS s FROM narrator n)
            SELECT CASE WHEN t > 0 AND s > 0 THEN 'both' WHEN t > 0 THEN 'teacher' WHEN s > 0 THEN 'student' ELSE 'neither' END AS role,
                   count(*) AS nodes, CAST(coalesce(sum(freq), 0) AS BIGINT) AS freq, CAST(sum(t + s) AS BIGINT) AS links FROM e GROUP BY role""",
        "report_grades": f"""
            SELECT id, nullif(regexp_extract({strip_sql('grade')}, '({'|'.join(G.REPORT_GRADES)})', 1), '') AS bare,
                   nullif(regexp_extract({strip_sql("('[' || grade || ']')")}, '[\\[(]\\s*({'|'.join(G.REPORT_GRADES)})\\s*[\\])]', 1), '') AS bracketed FROM hadith""",
        "incremental_embed_counts": """
            WITH c AS (SELECT DISTINCT sha1('hash:64' || chr(0) || matn_norm) AS h FROM hadith WHERE matn_norm IS NOT NULL),
            k AS (SELECT sha1('hash:64' || chr(0) || matn) AS h, count(*) AS n FROM hadith WHERE matn IS NOT NULL GROUP BY h)
            SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) FILTER (c.h IS NULL) AS new, CAST(coalesce(sum(n) FILTER (c.h IS NOT NULL), 0) AS BIGINT) AS reused FROM k LEFT JOIN c USING (h)""",
        "events_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "events_sessions": """
            WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
            SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    }
