"""SQL fragments of the oracle, in the dialect of the checking database."""

from __future__ import annotations

from stemma.functions import codes
from stemma.functions.text import FOLD_FROM, FOLD_TO, LANGUAGE_SIGNS, LANGUAGE_WORDS, SEARCH_STOP


def fold(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}'), '[̀-ͯ]', '', 'g')"


def norm_title(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in SEARCH_STOP)
    return f"list_filter(regexp_split_to_array({fold(x)}, '[^0-9a-z'']+'), lambda t: len(t) > 2 and t not in ({stop}))"


def marker_score(lang: str) -> str:
    """struct(lang, score) of one language: marker words among the words ``w``, other signs in the text ``t`` or, with wide blanks, ``wide``."""
    parts = [f"{k} * len(list_filter(w, lambda x: x in ({', '.join(repr(m) for m in words.split())})))" for k, words in LANGUAGE_WORDS[lang].items()]
    for of, k, begins, pattern in LANGUAGE_SIGNS:
        if of == lang:
            head = "(?:^|[^\\p{L}\\p{N}_])" if begins else ""
            tail = pattern.replace(" ", "  ").replace("\\b", "(?:$|[^\\p{L}\\p{N}_])")
            parts.append(f"{k} * len(regexp_extract_all({'wide' if ' ' in pattern else 't'}, '{head}{tail}'))")
    return f"struct_pack(lang := '{lang}', score := {' + '.join(parts)})"


def roman(x: str) -> str:
    """The number that the digits or the roman numeral ``x`` stand for."""
    value = lambda c: f"case {c} when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 else 0 end"
    one = value(f"substring({x}, i, 1)")
    nxt = value(f"substring({x}, i + 1, 1)")
    return f"case when regexp_matches({x}, '^[0-9]+$') then cast({x} as bigint) else cast(list_sum(list_transform(range(1, length({x}) + 1), lambda i: case when ({one}) < ({nxt}) then -({one}) else ({one}) end)) as bigint) end"


def norm_doi(x: str) -> str:
    a = f"regexp_replace(lower(trim({x})), '^(?:https?://[^/]+/|doi:\\s*)', '')"
    a = f"case when contains({a}, '%') then url_decode({a}) else {a} end"
    b = f"regexp_replace(regexp_replace({a}, '\\s+', '', 'g'), '[.,;:\"'']+$', '')"
    return f"case when regexp_matches({b}, '^10\\.[0-9]{{4,}}/.+') then {b} end"


def mapped(x: str, table: dict[str, str]) -> str:
    whens = " ".join(f"when lower(trim({x})) in ({', '.join(repr(w) for w in words.split())}) then '{k}'" for k, words in table.items())
    return f"case {whens} end"


def norm_lang(x: str) -> str:
    first = f"regexp_replace({x}, '[;,/|].*$', '')"
    return f"coalesce({mapped(first, codes.LANGUAGES)}, '?')"


def norm_type(x: str) -> str:
    return f"case when {x} is null or trim({x}) in ('', '?') then '?' else coalesce({mapped(x, codes.TYPES)}, 'other') end"


def decade(y: str) -> str:
    return f"case when {y} is null then '?' else cast(({y} // 10) * 10 as varchar) || 's' end"


LATEST = "(select * exclude (rn) from (select *, row_number() over (partition by notice_id order by tagged_at desc, tag_row_id desc) rn from tag_log) where rn = 1)"
NOTICES = "(select source || ':' || source_id as notice_id, max(record_id) as record_id from corpus group by 1)"
#: current row of each notice, with the columns that queries use
CURRENT = "(select n.notice_id, c.* from (select source || ':' || source_id as notice_id, max(record_id) as record_id from corpus group by 1) n join corpus c on c.record_id = n.record_id)"
