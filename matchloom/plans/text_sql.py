"""The text views, string ratios, decoy features and folds said in SQL, for the catalogue's comparisons."""

from __future__ import annotations

from ..functions import text as tx

#: Marks put round words; no text of the tables has them.
ON, OFF = "\x01", "\x02"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ascii_form(c: str) -> str:
    singles = tx.LATIN | tx.LATIN_ONE
    c = f"translate({c}, {quoted(''.join(singles))}, {quoted(''.join(singles.values()))})"
    for a, b in tx.LATIN_MORE.items():
        c = f"replace({c}, {quoted(a)}, {quoted(b)})"
    return rf"regexp_replace({c}, '[^\x00-\x7f]', '', 'g')"


def basic(c: str) -> str:
    c = f"replace(replace(lower({c}), '&', ' and '), '''', '')"
    c = f"regexp_replace({c}, '\\b([a-z])\\b', '{ON}\\1{OFF}', 'g')"
    c = f"replace(replace(replace({c}, '{OFF}.{ON}', ''), '{ON}', ''), '{OFF}', '')"
    return f"trim(regexp_replace(regexp_replace({c}, '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ' '), '')"


def members(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def lookup(table: dict[str, str], c: str) -> str:
    return "coalesce(map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + f"}}[{c}], {c})"


def skeleton(c: str) -> str:
    for a, b in tx.SOUNDS:
        c = f"replace({c}, '{a}', '{b}')"
    c = f"array_to_string(list_transform(string_split({c}, ' '), lambda v: substr(v, 1, 1) || regexp_replace(substr(v, 2), '[aeiouy]', '', 'g')), ' ')"
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        c = f"regexp_replace({c}, '{letter}+', '{letter}', 'g')"
    return f"coalesce({c}, '')"


def unique_sorted(c: str) -> str:
    return joined(f"list_sort(list_distinct({c}))")


_STEM = lambda c: basic(rf"regexp_replace({c}, '{tx.URL}', ' \1 ', 'g')")
_ALIAS = tx.ALIAS.removeprefix("(?i)")
_SOUNDS = sorted({tx._skeleton(x) for x in tx.LEGAL_BY_SOUND} | {tx.LEGAL_SOUND})
_OCR = "CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z].*[a-z]') THEN translate(x, '0136', 'oieg') ELSE x END"
_INITIALS = lambda c: f"trim(regexp_replace(replace(replace(replace(regexp_replace(replace(' ' || {c} || ' ', ' ', '  '), ' ([a-z]) ', ' {ON}\\1{OFF} ', 'g'), '{OFF}  {ON}', ''), '{ON}', ''), '{OFF}', ''), ' +', ' ', 'g'))"


def name_views(source: str) -> str:
    """CTEs up to `names`: doc_id, name_clean, name_core, name_skel, name_ns, name_alt, name_alt_skel of a table with doc_id, business_name."""
    return rf"""n0 AS (SELECT doc_id, regexp_replace({ascii_form('business_name')}, '{tx.ID_TAG}', ' ', 'g') AS t FROM {source}),
n1 AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\s\|\s') THEN regexp_extract(t, '(?s)^(.*?)\s\|\s', 1) ELSE t END AS t, regexp_extract(t, '(?s)^.*?\s\|\s(.*)$', 1) AS alt FROM n0),
n2 AS (SELECT doc_id, t, alt, regexp_matches(t, '{tx.ALIAS}') AS known, regexp_extract(t, '(?is)^(.*?){_ALIAS}', 1) AS head, regexp_extract(t, '(?is)^.*?{_ALIAS}(.*)$', 1) AS tail FROM n1),
n3 AS (SELECT doc_id, CASE WHEN NOT known THEN t WHEN {basic('tail')} <> '' THEN tail ELSE head END AS t, CASE WHEN known AND {basic('tail')} <> '' THEN head ELSE alt END AS alt FROM n2),
n4 AS (SELECT doc_id, alt, {joined(f"list_transform({words(_STEM('t'))}, lambda x: {_OCR})")} AS w FROM n3),
n5 AS (SELECT doc_id, alt, list_transform({words(_INITIALS('w'))}, lambda x: {lookup(tx.NAME_SHORT, 'x')}) AS w FROM n4),
n6 AS (SELECT doc_id, {joined('w')} AS name_clean, {joined(f"list_filter(w, lambda x: NOT list_contains({members(tx.LEGAL)}, x) AND NOT list_contains({members(_SOUNDS)}, {skeleton('x')}))")} AS core, {joined(f"list_filter({words(_STEM('alt'))}, lambda x: NOT list_contains({members(tx.LEGAL)}, x))")} AS name_alt FROM n5),
n7 AS (SELECT doc_id, name_clean, CASE WHEN core <> '' THEN core ELSE name_clean END AS name_core, name_alt FROM n6),
names AS (SELECT doc_id, name_clean, name_core, {skeleton('name_core')} AS name_skel, replace(name_core, ' ', '') AS name_ns, name_alt, {skeleton('name_alt')} AS name_alt_skel FROM n7)"""


def address_views(source: str) -> str:
    """CTEs up to `addresses`: doc_id, addr_clean, postal, nums, landmarks of a table with doc_id, business_address."""
    marks = members(tx.LANDMARKS)
    near = f"list_filter(flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains({marks}, w[i]) THEN w[i + 1 : i + 3] ELSE [] END)), lambda x: NOT list_contains({marks}, x))"
    return rf"""a0 AS (SELECT doc_id, {ascii_form('business_address')} AS a FROM {source}),
a1 AS (SELECT doc_id, a, list_filter(list_transform({words(basic('a'))}, lambda x: {lookup(tx.ADDRESS_SHORT, 'x')}), lambda x: x <> '') AS w FROM a0),
addresses AS (SELECT doc_id, {joined('w')} AS addr_clean, {unique_sorted(f"list_transform(regexp_extract_all(a, '{tx.POSTAL}', 1), lambda x: replace(x, ' ', ''))")} AS postal,
  {unique_sorted(r"regexp_extract_all(a, '(\d+)', 1)")} AS nums, {unique_sorted(near)} AS landmarks FROM a1)"""


def decoys(pairs: str) -> str:
    """The decoy features of a table with doc_id and both sides' name_skel, name_clean, addr_clean, as a_ and b_ columns."""
    tokens = lambda c: f"list_distinct({words(c)})"
    alpha = lambda c: f"list_distinct(list_transform(list_filter({words(c)}, lambda x: regexp_full_match(x, '[a-z]{{3,}}')), lambda x: {skeleton('x')}))"
    forms = "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in tx.LEGAL_FORMS.items()) + "}"
    legal = lambda c: f"list_distinct(list_filter(list_transform({words(c)}, lambda x: {forms}[x]), lambda x: x IS NOT NULL))"
    house = lambda c: rf"regexp_extract({c}, '(?:^| )(\d+)(?: |$)', 1)"
    less = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
    return f"""d0 AS (SELECT doc_id, {tokens('a_name_skel')} AS sa, {tokens('b_name_skel')} AS sb, {alpha('a_addr_clean')} AS ta, {alpha('b_addr_clean')} AS tb, {legal('a_name_clean')} AS la, {legal('b_name_clean')} AS lb, {house('a_addr_clean')} AS ha, {house('b_addr_clean')} AS hb FROM {pairs}),
d1 AS (SELECT *, {less('sb', 'sa')} AS extra, len(ta) > 0 AND len(tb) > 0 AS streets, len(la) > 0 AND len(lb) > 0 AS legal, ha <> '' AND hb <> '' AS house FROM d0)
SELECT doc_id, round(len(extra), 6) AS n_extra_b, round(len({less('sa', 'sb')}), 6) AS n_extra_a, round(coalesce(list_max(list_transform(extra, lambda x: len(x))), 0), 6) AS n_extra_b_len,
  CASE WHEN streets THEN len({less('tb', 'ta')}) ELSE -1 END AS a_extra_b, CASE WHEN streets THEN len({less('ta', 'tb')}) ELSE -1 END AS a_extra_a, CASE WHEN streets THEN round(len({less('tb', 'ta')}) / len(tb), 6) ELSE -1.0 END AS a_extra_b_frac,
  CASE WHEN legal THEN CAST(len(list_intersect(la, lb)) = 0 AS INT) ELSE -1 END AS legal_conflict, CAST(legal AS INT) AS legal_both,
  CASE WHEN house THEN CAST(ha <> hb AND (starts_with(ha, hb) OR starts_with(hb, ha)) AS INT) ELSE -1 END AS house_prefix,
  CASE WHEN house THEN round(ln(1 + abs(CAST(substr(ha, 1, 9) AS BIGINT) - CAST(substr(hb, 1, 9) AS BIGINT))), 6) ELSE -1.0 END AS house_absdiff,
  CASE WHEN house THEN levenshtein(ha, hb) ELSE -1 END AS house_lev, CASE WHEN house THEN CAST(len(ha) = len(hb) AS INT) ELSE -1 END AS house_samelen FROM d1"""


def ratios(pairs: str) -> str:
    """CTEs up to `ratio_of`: x, y and r = 2 LCS / (|x| + |y|) of all rows x, y (fewer than 60 letters) of a table.

    The recursion runs over the letters of x; the state's bits are the places of y."""
    return f"""lcs AS (SELECT DISTINCT x, y, 0 AS i, (1::HUGEINT << len(y)) - 1 AS row FROM {pairs}
  UNION ALL SELECT x, y, i + 1, ((row + (row & m)) | (row - (row & m))) & ((1::HUGEINT << len(y)) - 1) FROM
   (SELECT x, y, i, row, CAST(coalesce(list_sum(list_transform(range(0, len(y)), lambda j: CASE WHEN substr(y, j + 1, 1) = substr(x, i + 1, 1) THEN 1::HUGEINT << j ELSE 0 END)), 0) AS HUGEINT) AS m FROM lcs WHERE i < len(x))),
ratio_of AS (SELECT x, y, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2 * (len(y) - bit_count(row)) / (len(x) + len(y)) END AS r FROM lcs WHERE i = len(x))"""


def fuzzy(pairs: str) -> str:
    """ratio, partial, token_sort and token_set of the rows a, b of a table."""
    ordered = lambda c: f"array_to_string(list_sort({words(c)}), ' ')"
    kept = lambda one, two, sign: f"coalesce(array_to_string(list_sort(list_filter(list_distinct({words(one)}), lambda x: {sign} list_contains({words(two)}, x))), ' '), '')"
    return f"""f0 AS (SELECT a, b, CASE WHEN len(a) > len(b) THEN b ELSE a END AS s, CASE WHEN len(a) > len(b) THEN a ELSE b END AS l, coalesce({ordered('a')}, '') AS oa, coalesce({ordered('b')}, '') AS ob,
  {kept('a', 'b', '')} AS both_, {kept('a', 'b', 'NOT')} AS left_, {kept('b', 'a', 'NOT')} AS right_ FROM {pairs}),
f1 AS (SELECT *, trim(both_ || ' ' || left_) AS one, trim(both_ || ' ' || right_) AS two FROM f0),
f2 AS (SELECT DISTINCT s, l, unnest(range(1, len(l) + len(s))) AS e FROM f1 WHERE s <> ''),
f3 AS (SELECT s, l, substr(l, greatest(0, e - len(s)) + 1, least(e, len(l)) - greatest(0, e - len(s))) AS part FROM f2),
f4 AS (SELECT DISTINCT s, l, part FROM f3 WHERE contains(s, right(part, 1)) OR contains(s, left(part, 1))),
asked AS (SELECT a AS x, b AS y FROM f1 UNION SELECT oa, ob FROM f1 UNION SELECT one, two FROM f1 UNION SELECT both_, one FROM f1 UNION SELECT both_, two FROM f1 UNION SELECT s, part FROM f4),
{ratios('asked')},
f5 AS (SELECT s, l, max(r) AS r FROM f4 JOIN ratio_of ON x = s AND y = part GROUP BY ALL),
fuzzy AS (SELECT f1.a, f1.b, p.r AS ratio, CASE WHEN f1.s = '' THEN CASE WHEN f1.l = '' THEN 1.0 ELSE 0.0 END ELSE coalesce(f5.r, 0.0) END AS partial, q.r AS token_sort,
  CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0 WHEN both_ <> '' AND (left_ = '' OR right_ = '') THEN 1.0 ELSE greatest(t.r, CASE WHEN both_ <> '' THEN greatest(u.r, v.r) ELSE 0.0 END) END AS token_set
  FROM f1 JOIN ratio_of p ON p.x = a AND p.y = b JOIN ratio_of q ON q.x = oa AND q.y = ob JOIN ratio_of t ON t.x = one AND t.y = two JOIN ratio_of u ON u.x = both_ AND u.y = one JOIN ratio_of v ON v.x = both_ AND v.y = two LEFT JOIN f5 ON f5.s = f1.s AND f5.l = f1.l)"""


def crc32(keys: str) -> str:
    """CTEs up to `crc`: k and v, the CRC-32 of the digits of each k of a table."""
    return f"""bits AS (SELECT b, 0 AS i, b::BIGINT AS v FROM (SELECT unnest(range(0, 256)) AS b) UNION ALL SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
steps AS (SELECT DISTINCT k, 0 AS i, 4294967295::BIGINT AS v FROM {keys}
  UNION ALL SELECT k, steps.i + 1, xor(steps.v >> 8, t.v) FROM steps JOIN bits t ON t.i = 8 AND t.b = xor(steps.v, ascii(substr(k::VARCHAR, steps.i + 1, 1))) & 255 WHERE steps.i < len(k::VARCHAR)),
crc AS (SELECT k, xor(v, 4294967295) AS v FROM steps WHERE i = len(k::VARCHAR))"""
