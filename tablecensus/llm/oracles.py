"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .personal_data import ACCOUNT_CUES, KINDS, spellings
from .quality_rules import CLASSES, COMMON_WORDS, SYMBOLS
from .url_filters import RULES

BLANK = r"[\x20\x09-\x0D]"
WORDS = rf"list_filter(string_split_regex(coalesce({{0}}, ''), '{BLANK}+'), lambda x: x <> '')"


def line_dedup_sql(min_lines: int = 3, min_words: int = 20) -> str:
    ahead = ", ".join(f"lead(line, {k}) over w as l{k}" for k in range(1, min_lines))
    keys = ", ".join(["line", *(f"l{k}" for k in range(1, min_lines))])
    shifts = ", ".join(f"({k})" for k in range(min_lines))
    return f"""
      with raw as (
        select doc_id, pl, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') as worded
        from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pl from documents)),
      lines as (select *, row_number() over (partition by doc_id order by pl) as i from raw where worded),
      runs as (select *, {ahead}, count(*) over (partition by doc_id) as n from lines window w as (partition by doc_id order by i)),
      gone as (
        select doc_id, i from (
          select doc_id, i, row_number() over (partition by line order by doc_id nulls last, i) as copy,
                 len({WORDS.format("line")}) as words from lines) where copy > 1 and words >= {min_words}
        union
        select doc_id, i + shift from (
          select doc_id, i, row_number() over (partition by {keys} order by doc_id nulls last, i) as copy
          from runs where i + {min_lines} - 1 <= n), (values {shifts}) s(shift) where copy > 1),
      kept as (
        select r.doc_id, string_agg(r.line, chr(10) order by r.pl) filter (where g.i is null) as text,
               count(*) filter (where r.worded) as n_lines, count(g.i) as n_removed
        from raw r left join lines l on r.doc_id = l.doc_id and r.pl = l.pl
        left join gone g on l.doc_id = g.doc_id and l.i = g.i group by r.doc_id),
      heads as (
        select doc_id, count(*) as n_runs from (
          select doc_id, i - lag(i) over (partition by doc_id order by i) as gap from gone) where gap is null or gap > 1 group by doc_id)
      select kept.doc_id, n_lines, n_removed, coalesce(n_runs, 0) as n_runs, sha256(coalesce(text, '')) as kept_sha256
      from kept left join heads on kept.doc_id = heads.doc_id"""


def mixing_sql(weights=(1, 2, 3), max_repeats: int = 3) -> str:
    cases = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(weights))
    return f"""
      with docs as (
        select doc_id, source, len({WORDS.format("text")})::bigint as size,
               ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15))::bigint as h
        from documents),
      sums as (select source, sum(size)::bigint as total from docs group by source),
      ranked as (
        select *, case (row_number() over (order by source is null, encode(coalesce(source, ''))) - 1) % {len(weights)} {cases} end::double as w,
               ({max_repeats} * total)::double as cap from sums),
      waterline as (
        select *, row_number() over o as k, sum(total) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
               sum(w) over (o rows between current row and unbounded following) as open
        from ranked window o as (order by cap / w, source is null, encode(coalesce(source, '')))),
      level as (select arg_min(rest / open, k) as rate from waterline where cap >= rest / open * w),
      goals as (
        select source, total, least(cap, coalesce(rate * w, cap)) as target from waterline, level),
      plans as (
        select *, case when total > 0 then floor(target / total + 1e-12) else 0 end::bigint as passes from goals),
      runs as (
        select d.*, total, target, passes, target - passes * total as rest,
               sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
               sum(size) over (partition by d.source, h) as own
        from docs d join plans p on d.source is not distinct from p.source),
      crossing as (select source, min(upto) filter (where upto >= rest) as crossed from runs group by source)
      select doc_id, size, total as source_size, target,
        (size * (passes + case
          when upto < crossed then 1
          when upto = crossed and own > 0 and upto - rest <= greatest(0.0, rest - (upto - own)) then 1 else 0 end))::bigint as taken
      from runs r join crossing c on r.source is not distinct from c.source"""


def url_filters_sql(default: str = "allow") -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
      with rules(rule_host, rule_path, rule_verdict) as (values {rules}),
      cut as (
        select page_id, row_number() over () as k,
               case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
      parts as (
        select page_id, k, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
               regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
      hits as (
        select k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
               arg_max(rule_verdict, length(rule_host || rule_path)) as verdict
        from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by k)
      select page_id, host, path, rule, coalesce(verdict, '{default}') as verdict from parts left join hits using (k)"""


def quality_rules_sql(max_class: float = 0.25, max_word: float = 0.27, min_words: int = 100, min_reference: int = 10_000) -> str:
    steps, last = [], "joined"
    for i, (name, pattern) in enumerate(CLASSES):
        quoted = pattern.replace("'", "''")
        steps.append((f"regexp_replace({last}, '{quoted}', '', 'g')", f"q{i}"))
        last = f"q{i}"
    nested = "select *, array_to_string(words, '') as joined from split"
    for expression, name in steps:
        nested = f"select *, {expression} as {name} from ({nested})"
    names = ["joined", *(n for _, n in steps)]
    classes = [f"length({a}) - length({b})" for a, b in zip(names, names[1:])] + [f"length({names[-1]})"]
    case = lambda i: "case lang " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in COMMON_WORDS.items()) + f" else '{COMMON_WORDS['en'][i]}' end"
    common = [f"len(list_filter(lowered, lambda x: x = {case(i)}))" for i in range(12)]
    cols = ", ".join([f"{c} as c{i}" for i, c in enumerate(classes)] + [f"{c} as w{i}" for i, c in enumerate(common)])
    k, n = len(classes), 13

    def jsd(p: list[str], q: list[str]) -> str:
        part = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
        return "sqrt(greatest(0, (" + " + ".join(f"{part(a, b)} + {part(b, a)}" for a, b in zip(p, q)) + ") / 2))"

    c_all, rc_all = " + ".join(f"c{i}" for i in range(k)), " + ".join(f"rc{i}" for i in range(k))
    w_other = "n_words - (" + " + ".join(f"w{i}" for i in range(12)) + ")"
    rw_other = "r_words - (" + " + ".join(f"rw{i}" for i in range(12)) + ")"
    by_class = jsd([f"(c{i}::double / ({c_all}))" for i in range(k)], [f"(rc{i}::double / ({rc_all}))" for i in range(k)])
    by_word = jsd(
        [f"(({x})::double / n_words)" for x in [*(f"w{i}" for i in range(12)), w_other]],
        [f"(({x})::double / r_words)" for x in [*(f"rw{i}" for i in range(12)), rw_other]],
    )
    sums = ", ".join([f"sum(c{i}) as rc{i}" for i in range(k)] + [f"sum(w{i}) as rw{i}" for i in range(12)])
    assert n == 13
    return f"""
      with split as (
        select doc_id, coalesce(lang, '') as lang, row_number() over () as k, coalesce(text, '') as body, {WORDS.format("text")} as words from documents),
      counted as (
        select *, len(words)::bigint as n_words, length(joined)::bigint as word_chars,
               (length(joined) - length(regexp_replace(joined, '{SYMBOLS}', '', 'g')))::bigint as n_symbols,
               list_transform(words, lambda x: lower(x)) as lowered,
               list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from ({nested})),
      grams as (
        select k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
        from (select k, words, unnest(generate_series(1, len(words) - 2)) as i from split where len(words) > 2)),
      repeats as (
        select k, count(distinct j)::bigint as n from (
          select k, unnest([i, i + 1, i + 2]) as j from (select *, count(*) over (partition by k, g) as c from grams) where c > 1) group by k),
      full_ as (
        select doc_id, lang, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
               coalesce(r.n, 0)::bigint as n_repeat_words, {cols} from counted left join repeats r on counted.k = r.k),
      based as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from full_),
      refs as (select lang as r_lang, sum(n_words) as r_words, {sums} from based where not base_failed group by lang),
      judged as (
        select *, case when n_words >= {min_words} and coalesce(r_words, 0) >= {min_reference} then {by_class} end as dc,
               case when n_words >= {min_words} and coalesce(r_words, 0) >= {min_reference} then {by_word} end as dw
        from based left join refs on lang = r_lang)
      select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
             (not base_failed and not (coalesce(dc, 0) > {max_class} or coalesce(dw, 0) > {max_word})) as kept from judged"""


def personal_data_sql() -> str:
    """Every kind is marked by a pattern with characters for private use, then located by lengths of parts."""
    account = "|".join(s for word in ACCOUNT_CUES for s in spellings(word))
    patterns = {
        "email": ("", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": ("", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(body, '.'), lambda p: len(ltrim(p, '0')) > 3 or coalesce(try_cast(p as integer), 0) > 255)) = 0"),
        "card": ("", r"[0-9](?:[\x20-]?[0-9])+", "len(digits) between 14 and 19 and list_sum(list_transform(range(1, len(digits) + 1), lambda i: case when (len(digits) - i) % 2 = 0 then digits[i] else 2 * digits[i] - 9 * (digits[i] > 4)::int end)) % 10 = 0"),
        "phone": ("", r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) between 10 and 15"),
        "login": ("", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\t\n\v\f\r/?#\x22\x27<>]+", "regexp_matches(body, '://.+@[^@]+$')"),
        "iban": ("(?:iban|Iban|IBAN)[\\x20:#.=]*", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])*", "len(replace(body, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(substr(replace(body, ' ', ''), 5) || substr(replace(body, ' ', ''), 1, 4), ''), lambda c: case when c between '0' and '9' then c::int else ascii(c) - 55 end)), lambda r, v: case when v > 9 then (r * 100 + v) % 97 else (r * 10 + v) % 97 end) = 1"),
        "account": (f"(?:{account})[\\x20:#.=]*", r"[0-9](?:[\x20-]?[0-9])*", "len(digits) between 6 and 18"),
    }
    kinds = " union all ".join(
        f"""select r, {KINDS.index(kind)} as k, '{kind}' as kind, string_split(regexp_replace(body, '({pre})({body})', '\\1' || chr(57344) || '\\2' || chr(57345), 'g'), chr(57344)) as parts from docs"""
        for kind, (pre, body, _) in patterns.items()
    )
    valid = " ".join(f"when '{kind}' then {test}" for kind, (_, _, test) in patterns.items())
    base = [f"count(*) filter (where kind = '{kind}')::bigint as n_{kind}" for kind in KINDS[:4]]
    return f"""
      with docs as (
        select row_number() over () as r, doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) as body from documents),
      pieces as (select r, k, kind, unnest(parts) as part, generate_subscripts(parts, 1) as i from ({kinds}) where len(parts) > 1),
      placed as (
        select r, k, kind, i, split_part(part, chr(57345), 1) as body,
               coalesce(sum(len(part) - (i > 1)::int) over (partition by r, k order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start
        from pieces),
      spans as (
        select *, kind || ':' || start || ':' || (start + len(body)) as span
        from (select *, list_transform(list_filter(string_split(body, ''), lambda c: c between '0' and '9'), lambda c: c::int) as digits from placed where i > 1)
        where case kind {valid} end),
      told as (
        select r, {", ".join(base)},
               coalesce(string_agg(span, ',' order by start, k) filter (where k < 4), '') as base, string_agg(span, ',' order by start, k) as spans
        from spans group by r)
      select doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in KINDS[:4])},
             sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
      from docs left join told on docs.r = told.r"""


def hard_negatives_sql(positives: int = 5, negatives: int = 5, every: int = 100) -> str:
    return f"""
      with sound as (
        select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
      base as (
        select *, row_number() over () as k from (
          select distinct vec_id, label, list_transform(embedding, lambda c: floor(c::double * 256)) as x from sound
          where len(embedding) = (select len(embedding) from sound group by 1 order by count(*) desc, 1 desc limit 1))),
      scored as (
        select a.k, a.vec_id as anchor_id, c.vec_id as other_id, list_dot_product(a.x, c.x)::bigint as score, a.label = c.label as same
        from base a, base c where a.vec_id % {every} = 0),
      near as (
        select k, anchor_id, other_id, score from scored where same and other_id is distinct from anchor_id
        qualify row_number() over (partition by k order by score desc, other_id) <= {positives})
      select n.anchor_id, n.other_id as positive_id,
             row_number() over (partition by n.k, n.other_id, n.score order by s.score desc, s.other_id)::int as rank,
             s.other_id as negative_id, n.score as positive_score, s.score as negative_score
      from near n join scored s on n.k = s.k and not s.same and 80 * n.score <= 100 * s.score and 100 * s.score <= 100 * n.score
      qualify row_number() over (partition by n.k, n.other_id, n.score order by s.score desc, s.other_id) <= {negatives}"""


ORACLES = {
    "op1_line_dedup": line_dedup_sql(),
    "op2_mixing": mixing_sql(),
    "op6_url_filters": url_filters_sql(),
    "op9_quality_rules": quality_rules_sql(),
    "op12_personal_data": personal_data_sql(),
    "op13_hard_negatives": hard_negatives_sql(),
}
