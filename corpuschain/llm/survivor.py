"""Best representative of each duplicate group: field-by-field survivorship in one aggregation.

For every attribute the aggregation keeps the maximum of a composite struct
``(quality, source priority, timestamp, smaller id, value)``, non-null only where the
value is usable.  All attributes are maxima of one ``groupBy``, so the table is
shuffled once and a group of any size is reduced to one row per task before that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries that say nothing, compared in lower case without spaces around.
FILLERS = (
    "لا يوجد", "لم يذكر", "غير مذكور", "قيد المراجعة", "غير معروف", "لا شيء", "بلا", "بدون", "غير متوفر",
    "null", "none", "nil", "nan", "n/a", "na", "n.a.", "unknown", "not available", "not given", "tbd", "todo", "missing",
)

MARKS = r"[\u0610-\u061a\u0640\u064b-\u065f\u0670\u06d6-\u06ed]"
IGNORABLE = r"[\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
BRACKETED = r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|\uff08[^\uff08\uff09]*\uff09|\uff3b[^\uff3b\uff3d]*\uff3d"
# U+FFFD, runs of question marks, C1 controls, and UTF-8 bytes read in an eight-bit code page.
DAMAGED = (
    r"\ufffd|\?\?|[\u0080-\u009f]"
    r"|[\u00c2-\u00c5\u00d8-\u00db][\u00a0-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192ˆ˜–-›€™]"
)


def folded(value: Column) -> Column:
    """Lower case, single spaces, no ignorable characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), IGNORABLE, ""), r"(?U)\s+", " "))


def usable(value: Column) -> Column:
    """True where the text says something: not null or blank, at least one letter, no filler, no damaged character."""
    plain = F.regexp_replace(folded(value), MARKS, "")
    says = plain.rlike(r"\p{L}") & ~plain.isin(*FILLERS) & ~value.rlike(DAMAGED)
    return F.coalesce(says, F.lit(False))


def without_remarks(name: Column) -> Column:
    """The name without bracketed remarks (nested up to twice)."""
    once = F.regexp_replace(name, BRACKETED, " ")
    return F.regexp_replace(once, BRACKETED, " ")


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(folded(text), " "), lambda w: w.rlike(r"[\p{L}\p{N}]")))


@dataclass(frozen=True)
class Rule:
    """How the value of a field is judged: ``quality`` is null where it is unusable, and higher is better."""

    field: str
    quality: Column
    value: Column


def ranked_sources(df: DataFrame, source: str, books: DataFrame) -> DataFrame:
    """``df`` with ``_trust``: the trust of its source in ``books`` (1 is best), or null where it is not there.

    ``books`` has ``source``, ``short_titles`` and ``trust``; titles match ignoring case and
    extra spaces.  Where a title stands for several books, the most trusted one counts.
    The titles are joined on equality; Spark broadcasts them by their measured size only.
    """
    titles = (
        books.select(F.explode(F.concat(F.array("source"), F.coalesce("short_titles", F.array().cast("array<string>")))).alias("t"), "trust")
        .where(F.col("t").isNotNull() & F.col("trust").isNotNull())
        .groupBy(folded(F.col("t")).alias("_title"))
        .agg(F.min("trust").alias("_trust"))
        .where(F.length("_title") > 0)
    )
    return df.withColumn("_title", folded(F.col(source))).join(titles, "_title", "left").drop("_title")


def survivors(df: DataFrame, group: str, entry: str, revised: str, rules: list[Rule], trust: str = "_trust", at_least: int = 2) -> DataFrame:
    """One row for each group of ``at_least`` rows: ``group``, ``n_entries``, and for each field a struct ``(value, entry)``.

    The struct is null where no entry has a usable value.  Order: quality, then trust
    (smaller is better, null last), then ``revised`` (null last), then the smaller entry id.
    Rows with a null group are left out, as they are not grouped yet.  Repeated rows count
    as rows.  An empty table gives no rows.
    """
    def composite(rule: Rule) -> Column:
        order = F.struct(
            rule.quality.alias("q"),
            F.coalesce(-F.col(trust).cast("bigint"), F.lit(-(2**62))).alias("t"),
            F.col(revised).isNotNull().alias("dated"),
            F.coalesce(F.unix_micros(F.col(revised).cast("timestamp")), F.lit(0)).alias("r"),
            (-F.col(entry).cast("bigint")).alias("e"),
            rule.value.alias("value"),
        )
        return F.max(F.when(rule.quality.isNotNull(), order)).alias(rule.field)

    kept = (
        df.where(F.col(group).isNotNull())
        .groupBy(F.col(group).alias("_group"))
        .agg(F.count(F.lit(1)).alias("n_entries"), *[composite(r) for r in rules])
        .where(F.col("n_entries") >= at_least)
    )
    return kept.select(
        F.col("_group").alias(group),
        "n_entries",
        *[
            F.when(F.col(r.field).isNotNull(), F.struct(F.col(r.field)["value"].alias("value"), (-F.col(r.field)["e"]).alias("entry"))).alias(r.field)
            for r in rules
        ],
    )


def narrator_rules() -> list[Rule]:
    """Name: most words, remarks left out.  Opinions: most distinct (source, grade) with a usable grade.  Grade and source: any usable."""
    name = without_remarks(F.col("name"))
    judged = F.array_distinct(
        F.transform(
            F.filter(F.coalesce("opinions", F.array().cast("array<struct<source:string,grade:string>>")), lambda o: o.isNotNull() & usable(o["grade"])),
            lambda o: F.struct(folded(o["source"]).alias("s"), folded(o["grade"]).alias("g")),
        )
    )
    one = F.lit(1)
    return [
        Rule("name", F.when(usable(name), words(name)), F.col("name")),
        Rule("grade_text", F.when(usable(F.col("grade_text")), one), F.col("grade_text")),
        Rule("opinions", F.when(F.size(judged) > 0, F.size(judged)), F.to_json("opinions")),
        Rule("source", F.when(F.col("_trust").isNotNull(), one), F.col("source")),
    ]


def surviving_records(entries: DataFrame, books: DataFrame) -> DataFrame:
    """The surviving record of each person: values and the entries that they come from."""
    needed = entries.select("entry_id", "person_no", "name", "grade_text", "opinions", "source", "revised_at")
    return survivors(ranked_sources(needed, "source", books), "person_no", "entry_id", "revised_at", narrator_rules())


def surviving_entries(records: DataFrame, fields: tuple[str, ...] = ("name", "grade_text", "opinions", "source")) -> DataFrame:
    """(person_no, field, entry_id) for each field that has a surviving value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["entry"].alias("entry_id")) for f in fields])
    return records.select("person_no", F.inline(pairs)).where(F.col("entry_id").isNotNull())
