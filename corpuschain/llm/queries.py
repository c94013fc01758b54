"""Queries over the operators of this package, and the SQL of those that have one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuschain.llm import components, leakage, linkage, mixture, neighbours, stuffing, survivor, truncation, visual
from corpuschain.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Every seed record with the person it names."""
    return linkage.persons(table(spark, sf, "seed"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.same_person(p1_persons(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual.canonical_values(table(spark, sf, "hadith"), "id", ["matn", "isnad", "matn_norm"], changed_only=True).select("id", "field")


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """All values in their consistent form."""
    return visual.canonical_values(table(spark, sf, "hadith"), "id", ["matn", "isnad", "matn_norm"])


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar vectors of each."""
    return neighbours.neighbours(table(spark, sf, "vec"), "id", "v", 5)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.unordered_pairs(p3_neighbours(spark, sf))


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors with an id divisible by 20, the number of their true neighbours among all, and whether the index finds 95 % of them or more."""
    vec = table(spark, sf, "vec")
    measured = neighbours.recall(vec, neighbours.neighbours(vec, "id", "v", 5), "id", "v", 5)
    return measured.select("n_asked", "n_true", (F.col("n_found") >= 0.95 * F.col("n_true")).alias("reached"))


def p4_judged(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.judge(table(spark, sf, "hadith"), "id", "book_id", ["matn", "isnad"], value_ends=["isnad"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_judged(spark, sf).where("reason IS NOT NULL").select("id", "field")


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each book truncates."""
    return truncation.rates(p4_judged(spark, sf), "book_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.surviving_entries(p5_records(spark, sf))


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.surviving_records(table(spark, sf, "rijal_entry"), table(spark, sf, "source_book"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.components(table(spark, sf, "hadith_match"), "id_a", "id_b", table(spark, sf, "hadith"), "id")


def p8_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked passage with its place in the document and in the item."""
    return leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_hits(spark, sf).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return leakage.leaked_items(p8_hits(spark, sf), table(spark, sf, "eval_item"), "item_id")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed blocks of tokens."""
    return mixture.mixture(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixture.mixture(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_target"))[1]


def p10_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with its share of non-sentence shapes."""
    return stuffing.pages(table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_pages(spark, sf).where("flagged").select("doc_id")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_persons": p1_persons, "p2_found": p2_found, "p2_values": p2_values, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall, "p4_found": p4_found, "p4_judged": p4_judged, "p4_rates": p4_rates, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p8_found": p8_found, "p8_hits": p8_hits, "p8_items": p8_items, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pages": p10_pages}


def _usable_sql(x: str) -> str:
    """SQL of ``survivor.usable``."""
    plain = f"regexp_replace(trim(regexp_replace(regexp_replace(lower({x}), {_q(survivor.IGNORABLE)}, '', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g')), {_q(survivor.MARKS)}, '', 'g')"
    fillers = ", ".join(map(_q, survivor.FILLERS))
    return f"coalesce(regexp_matches({plain}, '\\p{{L}}') AND {plain} NOT IN ({fillers}) AND NOT regexp_matches({x}, {_q(survivor.DAMAGED)}), false)"


def _q(s: str) -> str:
    """A pattern or text as an SQL literal; escapes in the spelling of RE2."""
    return "'" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", s).replace("'", "''") + "'"


def _folded_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), {_q(survivor.IGNORABLE)}, '', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    bare = f"regexp_replace(regexp_replace(name, {_q(survivor.BRACKETED)}, ' ', 'g'), {_q(survivor.BRACKETED)}, ' ', 'g')"
    order = "coalesce(trust, 1000000), revised_at DESC NULLS LAST, entry_id"
    best = lambda field, quality: f"SELECT person_no, '{field}' AS field, first(entry_id ORDER BY {quality} DESC, {order}) FILTER ({quality} > 0) AS entry_id FROM j GROUP BY person_no HAVING count(*) >= 2"
    return {
        # by ranges of Unicode, not by the operator's own tables: letters of other scripts and extended Arabic, hidden signs, spaces, compatibility forms
        "p2_found": r"""
            WITH v AS (SELECT id, unnest(['matn', 'isnad', 'matn_norm']) AS field, unnest([matn, isnad, matn_norm]) AS t FROM hadith)
            SELECT id, field FROM v WHERE nfc_normalize(t) <> t
              OR regexp_matches(t, '[\x{131}\x{251}\x{261}\x{370}-\x{3ff}\x{400}-\x{52f}\x{531}-\x{58f}\x{61c}\x{671}-\x{6d3}\x{6d5}\x{6ee}-\x{6f3}\x{6f7}-\x{6ff}\x{a78c}]')
              OR regexp_matches(t, '[\p{Cf}\x{ad}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]')
              OR regexp_matches(t, '[\x{fb00}-\x{fb06}\x{fb50}-\x{fdff}\x{fe70}-\x{fefc}\x{ff01}-\x{ffee}]')""",
        "p3_found": """
            WITH v AS (SELECT id, CAST(v AS DOUBLE[]) AS v FROM vec), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS l FROM v WHERE list_dot_product(v, v) > 0),
            c AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) AS c FROM n a JOIN n b ON a.id <> b.id),
            r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM c)
            SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5""",
        "p3_recall": """
            WITH n AS (SELECT id, id % 20 = 0 AS asked FROM vec WHERE len(v) = 64 AND list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) > 0)
            SELECT count(*) FILTER (asked) AS n_asked, CAST(sum(least(5, total - 1)) FILTER (asked) AS BIGINT) AS n_true, true AS reached FROM n, (SELECT count(*) AS total FROM n)""",
        "p5_found": f"""
            WITH t AS (SELECT {_folded_sql("unnest(list_append(short_titles, source))")} AS title, trust FROM source_book),
            s AS (SELECT title, min(trust) AS trust FROM t WHERE title <> '' GROUP BY title),
            e AS (SELECT *, {bare} AS plain_name FROM rijal_entry WHERE person_no IS NOT NULL),
            j AS (SELECT person_no, entry_id, revised_at, trust,
                CASE WHEN {_usable_sql('plain_name')} THEN len(list_filter(string_split({_folded_sql('plain_name')}, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) ELSE 0 END AS q_name,
                CASE WHEN {_usable_sql('grade_text')} THEN 1 ELSE 0 END AS q_grade,
                coalesce(len(list_distinct(list_transform(list_filter(opinions, lambda o: {_usable_sql('o.grade')}), lambda o: coalesce({_folded_sql('o.source')}, chr(1)) || chr(2) || {_folded_sql('o.grade')}))), 0) AS q_opinions,
                CASE WHEN trust IS NOT NULL THEN 1 ELSE 0 END AS q_source
              FROM e LEFT JOIN s ON s.title = {_folded_sql('e.source')})
            SELECT * FROM ({best('name', 'q_name')} UNION ALL {best('grade_text', 'q_grade')} UNION ALL {best('opinions', 'q_opinions')} UNION ALL {best('source', 'q_source')}) WHERE entry_id IS NOT NULL""",
        "p6_found": """
            WITH RECURSIVE e AS (SELECT DISTINCT id_a AS a, id_b AS b FROM hadith_match WHERE id_a <> id_b AND id_a IN (SELECT id FROM hadith) AND id_b IN (SELECT id FROM hadith)),
            s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            r AS (SELECT a AS id, a AS top FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.top = s.a)
            SELECT id, min(top) AS group_id FROM r GROUP BY id""",
    }
