"""The stemmer's steps as SQL, for the check of the registered query in the other engine."""

from __future__ import annotations

# Fixed values of the published algorithm, written out here once more: an error in the stemmer's own tables must show.
_TWOS = (
    "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate "
    "alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble fulli>ful logi>log"
)
_THREES = "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"
_FOURS = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_OTHERS = (
    "sky>sky skies>sky dying>die lying>lie tying>tie news>news innings>inning inning>inning outings>outing outing>outing "
    "cannings>canning canning>canning howe>howe proceed>proceed exceed>exceed succeed>succeed"
)


def _pairs(text: str) -> dict[str, str]:
    return dict(pair.split(">") for pair in text.split(" "))


STEP_2, STEP_3, STEP_4, IRREGULAR = _pairs(_TWOS), _pairs(_THREES), tuple(_FOURS.split(" ")), _pairs(_OTHERS)
_POS = "regexp_matches({0}, '^[^aeiouY]*[aeiouY]+[^aeiouY]+')"
_TWO = "regexp_matches({0}, '^[^aeiouY]*[aeiouY]+[^aeiouY]+[aeiouY]+[^aeiouY]+')"
_ONE = "(" + _POS + " AND NOT " + _TWO + ")"
_SHORT = "(regexp_matches({0}, '[^aeiouY][aeiouY][^aeiouYwxy]$') OR regexp_matches({0}, '^[aeiouY][^aeiouY]$'))"
_TWIN = "(length({0}) > 1 AND right({0}, 1) = left(right({0}, 2), 1) AND regexp_matches({0}, '[^aeiouY]$'))"


def _case(table: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def stem_ctes(source: str) -> str:
    """CTEs from ``source(word)`` to ``stemmed(word, stem)``."""
    pos, two, one, short, twin = (x.format("b") for x in (_POS, _TWO, _ONE, _SHORT, _TWIN))
    steps = [
        (("sses", "ies", "ss", "s"), "CASE s WHEN 'sses' THEN b || 'ss' WHEN 'ies' THEN b || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END WHEN 's' THEN b ELSE w END"),
        (
            ("eed", "ied", "ed", "ing"),
            f"""CASE WHEN s = 'ied' THEN b || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END
            WHEN s = 'eed' THEN CASE WHEN {pos} THEN b || 'ee' ELSE w END
            WHEN s IN ('ed', 'ing') AND regexp_matches(b, '[aeiouY]') THEN
              CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN {twin} THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END
              WHEN {one} AND {short} THEN b || 'e' ELSE b END
            ELSE w END""",
        ),
        (("Y",), "CASE WHEN s = 'Y' AND length(b) > 1 AND regexp_matches(b, '[^aeiouY]$') THEN b || 'i' ELSE w END"),
        (("alli",), f"CASE WHEN s <> '' AND {pos} THEN b || 'al' ELSE w END"),
        (tuple(STEP_2), f"CASE WHEN s <> '' AND {_POS.format("(b || CASE WHEN s = 'logi' THEN 'l' ELSE '' END)")} THEN b || {_case(STEP_2)} ELSE w END"),
        (tuple(STEP_3), f"CASE WHEN s <> '' AND {pos} THEN b || {_case(STEP_3)} ELSE w END"),
        (STEP_4, f"CASE WHEN s <> '' AND {two} AND (s <> 'ion' OR right(b, 1) IN ('s', 't')) THEN b ELSE w END"),
        (("e",), f"CASE WHEN s <> '' AND ({two} OR ({one} AND NOT {short})) THEN b ELSE w END"),
        (("l",), f"CASE WHEN s <> '' AND right(b, 1) = 'l' AND {two} THEN b ELSE w END"),
    ]
    kept = ", ".join(f"'{w}'" for w in IRREGULAR)
    ctes = [
        f"""s0 AS (SELECT word, length(word) > 2 AND lower(word) NOT IN ({kept}) AS cut, regexp_replace(lower(word), '([^aeiou])y', '\\1Y', 'g') AS w FROM {source})"""
    ]
    for i, (suffixes, result) in enumerate(steps):
        ctes.append(f"x{i} AS (SELECT word, cut, w, regexp_extract(w, '({'|'.join(suffixes)})$', 1) AS s FROM s{i})")
        ctes.append(f"y{i} AS (SELECT word, cut, w, s, substr(w, 1, length(w) - length(s)) AS b FROM x{i})")
        ctes.append(f"s{i + 1} AS (SELECT word, cut, {result} AS w FROM y{i})")
    other = "CASE lower(word) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items()) + " ELSE lower(word) END"
    ctes.append(f"stemmed AS (SELECT word, CASE WHEN cut THEN lower(w) ELSE {other} END AS stem FROM s{len(steps)})")
    return ", ".join(ctes)
