"""The SQL spelling of the text profiles, for the queries' SQL."""

from __future__ import annotations

from corpuschain.functions import grades as G
from corpuschain.functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    for apart, composed in T.COMPOSED:
        x = f"replace({x}, {quoted(apart)}, {quoted(composed)})"
    x = f"regexp_replace({x}, {quoted(T.ACCUSATIVE)}, '', 'g')"
    x = f"regexp_replace({x}, {quoted(T.MARKS + '|' + T.KASHIDA)}, '', 'g')"
    return f"trim(regexp_replace({x}, {quoted(T.SPACES)}, ' ', 'g'))"


def norm_sql(x: str) -> str:
    x = f"translate({strip_sql(x)}, {quoted(T.FOLD_FROM)}, {quoted(T.FOLD_TO)})"
    x = f"regexp_replace({x}, {quoted(T.COMPOUND)}, {quoted(T.COMPOUND_AS)}, 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, {quoted(T.NOT_ARABIC)}, ' ', 'g'), {quoted(T.SPACES)}, ' ', 'g'))"


def words_sql(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda w: w <> '')"


def lineage_sql(ws: str) -> str:
    """A man's lineage from the list of his name's words: up to the first word of his own description, cut at "son of"."""
    son = "('بن', 'ابن')"
    described = f"""list_position(list_transform({ws}, lambda x, i: x NOT IN {son} AND NOT (i > 1 AND {ws}[i - 1] IN {son}) AND (
        x IN ('ابو', 'ابا', 'ام', 'الكبير', 'الاكبر', 'الحفيد', 'حفيد', 'الاصغر', 'الصغير', 'الابن', 'الاب', 'الجد')
        OR (x LIKE 'ال%ي' AND len(x) >= 4 AND NOT (i > 1 AND {ws}[i - 1] = 'عبد' AND (i = 2 OR {ws}[i - 2] IN {son}))))), true)"""
    kept = f"{ws}[1:coalesce(nullif({described}, 0) - 1, len({ws}))]"
    marked = f"array_to_string(list_transform({kept}, lambda x: CASE WHEN x IN {son} THEN '|' ELSE x END), ' ')"
    return f"list_filter(list_transform(string_split({marked}, '|'), lambda x: trim(x)), lambda x: x <> '')"


def latin_sql(x: str) -> str:
    return words_sql(f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")


def bm25_sql(source: str, words: dict[str, str], terms: list[str], weights: dict[str, float], match: str, keep: str, k: int, fields: tuple[str, ...] = ()) -> str:
    """Weighted BM25 over the rows of ``source`` (id and columns), the first k of those for which ``keep`` holds."""
    listed = ", ".join(quoted(t) for t in terms)
    length = " + ".join(f"coalesce(len({w}), 0)" for w in words.values())
    parts = " UNION ALL ".join(f"SELECT id, {weights.get(f, 1.0)} AS w, unnest({w}) AS term FROM s" for f, w in words.items() if not fields or f in fields)
    need = {"or": "true", "and": f"n_terms = {len(terms)}", "auto": f"(n_terms = {len(terms)} OR (SELECT max(n_terms) FROM h) < {len(terms)})"}[match]
    return f"""
        WITH s AS (SELECT * FROM {source}),
        l AS (SELECT id, {length} AS len FROM s), a AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
        p AS (SELECT id, term, sum(w) AS f FROM ({parts}) WHERE term IN ({listed}) GROUP BY id, term),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM d, a),
        h AS (SELECT id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score, count(*) AS n_terms
              FROM p JOIN i USING (term) JOIN l USING (id), a GROUP BY id)
        SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank
        FROM h WHERE {need} AND id IN (SELECT id FROM s WHERE {keep}) ORDER BY h.score DESC, id LIMIT {k}"""


def classify_sql(x: str) -> str:
    """``category`` and ``rank`` of grade text ``x``, as two expressions over a row ``padded``."""
    return f"regexp_replace(' ' || {norm_sql(f'coalesce({x}, {quoted(chr(32))})')} || ' ', {quoted(G.BY_NAME)}, ' مسيلمه ', 'g')"


def place_sql(phrase: str) -> str:
    p = phrase.translate(G._FOLDED)
    a, b = f"instr(padded, {quoted(f' {p} ')})", f"instr(padded, {quoted(f' ال{p} ')})"
    return f"CASE WHEN {a} > 0 THEN {a} - 1 WHEN {b} > 0 THEN {b} - 1 ELSE 1000000000 END"


def grades_sql(source: str, key: str, x: str) -> str:
    columns = ", ".join(f"least({', '.join(place_sql(p) for p in ps)}) AS p{i}" for i, ps in enumerate(G.PHRASES.values()))
    n = len(G.PHRASES)
    names = "[" + ", ".join(quoted(c) for c in G.PHRASES) + "]"
    at = f"least({', '.join(f'p{i}' for i in range(n))})"
    which = "CASE " + " ".join(f"WHEN p{i} = hit_at THEN {i + 1}" for i in range(n)) + " END"
    negated = " OR ".join(f"contains(win, {quoted(f' {w} ')})" for w in G.NEGATORS)
    lowered = " OR ".join(f"({place_sql(q)}) < 1000000000" for q in G.LOWERING)
    good = ", ".join(quoted(c) for c in G.CANCELLED)
    ranks = "CASE " + " ".join(f"WHEN category = {quoted(c)} THEN {r}" for c, r in G.RANKS.items()) + " END"
    return f"""
        WITH a AS (SELECT {key}, {classify_sql(x)} AS padded FROM {source}),
        b AS (SELECT *, {columns} FROM a), c AS (SELECT *, {at} AS hit_at FROM b),
        d AS (SELECT *, {names}[{which}] AS cat, substring(padded, greatest(hit_at - 12, 0) + 1, least(hit_at, 12) + 1) AS win FROM c),
        e AS (SELECT {key}, CASE WHEN hit_at >= 1000000000 OR (cat IN ({good}) AND ({negated})) THEN {quoted(G.UNREAD)}
                     WHEN cat = 'صدوق' AND ({lowered}) THEN 'صدوق له أوهام' ELSE cat END AS category FROM d)
        SELECT {key}, category, {ranks} AS rank FROM e"""
