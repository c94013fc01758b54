"""Grades of narrators and reports as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuschain.functions.text import NEGATORS, normalize, strip_diacritics

# The scale from best to worst.
RANKS = {"صحابي": 10, "ثقة": 9, "صدوق": 7, "صدوق له أوهام": 6, "مقبول": 5, "لين": 4, "مجهول": 3, "ضعيف": 2, "متروك": 1, "كذاب": 0}
UNREAD = "غير معروف"
# The phrases of each grade; of phrases at the same place the earlier grade here wins.
PHRASES = {
    "كذاب": ("كذاب", "وضاع", "يضع الحديث", "متهم بالكذب", "متهم بالوضع", "دجال", "يكذب"),
    "متروك": ("متروك", "ساقط", "ذاهب الحديث", "هالك", "ليس بشيء", "تركوه", "متهم"),
    "ضعيف": ("ضعيف", "واه", "منكر الحديث", "ليس بثقة", "فيه ضعف", "لا يحتج به", "ضعفوه"),
    "لين": ("لين الحديث", "لين", "فيه لين", "يعتبر به", "ليس بالقوي", "ليس بذاك القوي", "ليس بذاك"),
    "مجهول": ("مجهول", "مستور", "لا يعرف", "لا يعرف حاله"),
    "مقبول": ("مقبول",),
    "صدوق": ("صدوق", "لا بأس به", "ليس به بأس", "صالح الحديث", "محله الصدق"),
    "ثقة": ("ثقة", "ثبت", "حافظ", "حجة", "امام", "متقن", "عدل", "جبل"),
    "صحابي": (
        "صحابي", "صحابية", "صحبة", "له صحبة", "أحد العشرة", "من العشرة", "العشرة المبشرة", "أسلم قديما", "من السابقين", "بدري",
        "شهد بدرا", "شهد أحدا", "شهد الحديبية", "رأى النبي", "رأى رسول الله", "له رؤية", "بايع تحت الشجرة", "من أهل بدر",
        "من أصحاب النبي", "من أصحاب رسول الله", "أحد الصحابة", "مذكور في الصحابة", "ذكر في الصحابة", "ذكره في الصحابة", "له إدراك",
    ),
}
# Grades that a negator before them cancels, remarks that lower the truthful, and a by-name that is no judgement.
CANCELLED = ("ثقة", "صدوق", "مقبول", "صحابي")
LOWERING = ("يهم", "يخطئ", "اوهام", "اختلط", "خلط", "تغير", "سيئ الحفظ", "له مناكير", "ربما وهم")
BY_NAME = r"(?:مسيلمه|الاسود|طليحه|سجاح|المختار)\s+(?:العنسي\s+|الثقفي\s+)?الكذاب"
# Grades of reports, longer ones first.
REPORT_GRADES = ("حسن صحيح", "صحيح لغيره", "حسن لغيره", "ضعيف جدا", "صحيح", "حسن", "ضعيف", "موضوع", "منكر", "شاذ", "متروك")

_FOLDED = str.maketrans("أإآٱىؤئة", "اااايويه", "ء")
_NOWHERE = 10**9


def _place(padded: Column, phrase: str) -> Column:
    """0-based place of a phrase as whole words, with or without the article."""
    phrase = phrase.translate(_FOLDED)
    plain, article = F.instr(padded, f" {phrase} "), F.instr(padded, f" ال{phrase} ")
    return F.when(plain > 0, plain - 1).when(article > 0, article - 1).otherwise(_NOWHERE)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a one-element array gives it a name."""
    return F.transform(F.array(value), body)[0]


def classify(verdict: Column) -> Column:
    """(category, rank) of a judgement in words: the grade whose phrase comes first; rank is null where none does.

    A negator within the twelve characters before a good grade cancels it.
    """
    padded = F.regexp_replace(F.concat(F.lit(" "), normalize(F.coalesce(verdict, F.lit(""))), F.lit(" ")), BY_NAME, " مسيلمه ")

    def places(text: Column) -> Column:
        earliest = [reduce(F.least, [_place(text, p) for p in phrases]) for phrases in PHRASES.values()]
        first = F.array_min(F.array(*[F.struct(at.alias("at"), F.lit(i).alias("which")) for i, at in enumerate(earliest)]))
        return F.struct(text.alias("text"), first.alias("first"))

    def judged(seen: Column) -> Column:
        text, at, which = seen["text"], seen["first"]["at"], seen["first"]["which"]
        category = F.element_at(F.array(*map(F.lit, PHRASES)), which + 1)
        window = F.substring(text, F.greatest(at - 12, F.lit(0)) + 1, F.least(at, F.lit(12)) + 1)
        negated = reduce(lambda a, b: a | b, [F.contains(window, F.lit(f" {n} ")) for n in NEGATORS])
        lowered = reduce(lambda a, b: a | b, [_place(text, q) < _NOWHERE for q in LOWERING])
        return (
            F.when(at >= _NOWHERE, UNREAD)
            .when(category.isin(*CANCELLED) & negated, UNREAD)
            .when((category == "صدوق") & lowered, "صدوق له أوهام")
            .otherwise(category)
        )

    return _bind(_bind(_bind(padded, places), judged), lambda c: F.struct(c.alias("category"), rank(c).alias("rank")))


def rank(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), category).cast("int")


def report_grade(text: Column) -> Column:
    """The grade of a report where it stands as a ruling: in brackets, else after a cue; null elsewhere."""
    plain = strip_diacritics(text)
    any_grade = "|".join(REPORT_GRADES)
    bracket = F.regexp_extract(plain, rf"[\[(]\s*({any_grade})\s*[\])]", 1)
    cue = F.regexp_extract(plain, rf"(?:[إا]سناده|(?:هذا|وهذا|فهذا)\s+حديث|حكم|قال[^:]{{0,25}}:)\s*[«\"]?({any_grade})", 1)
    return F.when(bracket != "", bracket).when(cue != "", cue)


def bare_grade(ruling: Column) -> Column:
    """The grade in a text that is itself a ruling."""
    found = F.regexp_extract(strip_diacritics(ruling), "(" + "|".join(REPORT_GRADES) + ")", 1)
    return F.when(found != "", found)
