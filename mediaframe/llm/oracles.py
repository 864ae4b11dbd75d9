"""DuckDB SQL of the queries that SQL can express, built from the same rules and patterns."""

from __future__ import annotations

from . import hosts, pii, rules, secrets

SPACE = r"[\x20\x09-\x0D]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rules_sql() -> str:
    bits = " | ".join(f"case when {condition} then {rules.BIT[name]} else 0 end" for name, condition in rules.RULES)
    return rf"""
with w as (
  select doc_id, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), wins as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from wins) where c > 1
), covered as (
  select doc_id, count(distinct i + k) as n from twice, range(0, 8) r(k) group by doc_id
), m as (
  select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
    (len(ls) - list_unique(ls))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::bigint as n_stutter,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::bigint as n_letters
  from w left join covered on w.doc_id = covered.doc_id
), f as (select *, ({bits})::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {rules.POLICIES["base-1"]}) <> 0 as base_failed,
  (failed & {rules.POLICIES["base-1"] | rules.POLICIES[rules.POLICY]}) = 0 as kept, failed, '{rules.POLICY}' as policy
from f
"""


def located(text: str, pattern: str) -> str:
    """A list of structs (s, m): start in code points and text of every match."""
    p, m = f"string_split_regex({text}, {quoted(pattern)})", f"regexp_extract_all({text}, {quoted(pattern)})"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': length(array_to_string(({p})[1:i], '')) + length(array_to_string(({m})[1:i - 1], '')), 'm': ({m})[i]}})"


def secrets_sql() -> str:
    lists = []
    for n, (kind, pattern, fold) in enumerate(secrets.RULES):
        good = f"length(x.m) >= {secrets.LEAST.get(kind, 0)}"
        if kind == "assign":
            good = f"length(regexp_extract(x.m, {quoted('^[^:=]*[:=] *[\"' + chr(39) + ']?(.*)$')}, 1)) >= {secrets.LEAST_VALUE}"
        found = located("t", ("(?i)" if fold else "") + pattern)
        lists.append(f"list_transform(list_filter({found}, lambda x: {good}), lambda x: {{'s': x.s, 'k': {n}, 'e': x.s + length(x.m)}})")
    names = "[" + ", ".join(quoted(k) for k, _, _ in secrets.RULES) + "]"
    text = lambda spans: f"array_to_string(list_transform({spans}, lambda x: ({names})[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    base = f"list_filter(found, lambda x: x.k < {len(secrets.BASE)})"
    counts = ", ".join(f"len(list_filter(found, lambda x: x.k = {n}))::bigint as n_{k}" for n, k in enumerate(secrets.BASE))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
a as (select doc_id, list_sort({" || ".join(lists)}) as found from d)
select doc_id, {counts}, sha256({text(base)}) as base_sha256, {text("found")} as spans from a
"""


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def pii_sql() -> str:
    part = "0*([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    n = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    double = f"2 * substr({n}, (length({n}) - i + 1)::bigint, 1)::int"
    good = {
        "email": "true",
        "ip": rf"regexp_matches(x.m, '^{part}(\.{part}){{3}}$')",
        "card": f"length({n}) between 16 and 19 and list_sum(list_transform(range(1, length({n}) + 1), lambda i: case when i % 2 = 1 then substr({n}, (length({n}) - i + 1)::bigint, 1)::int when {double} > 9 then {double} - 9 else {double} end)) % 10 = 0",
        "phone": f"length({n}) between 8 and 15",
    }
    spans = ", ".join(f"list_transform(list_filter({located('t', PLAIN[k])}, lambda x: {good[k]}), lambda x: {{'s': x.s, 'e': x.s + length(x.m), 'm': x.m}}) as {k}" for k in pii.KINDS)
    flags = ", ".join(f"(len({k}) > 0)::bigint as f_{k}" for k in pii.KINDS)
    over = []

    def exceeds(sure: str, prior: str, proof: str) -> str:
        return f"({sure} >= {pii.CERTAIN} and {proof} * log2({sure} / {prior}) >= {pii.EVIDENCE} and log2({sure} / {prior}) >= -{pii.GAIN} * log2({prior}))"

    values = " || ".join(f"list_transform({k}, lambda x: '{k}:' || " + ("regexp_replace(x.m, '[^0-9]', '', 'g')" if k in ("card", "phone") else "lower(x.m)") + ")" for k in pii.KINDS)
    for k in pii.KINDS:
        sure = f"((c_{k} + 1) / (n + 2))"
        over.append(exceeds(sure, f"((a_{k} + 1) / (docs + 2))", f"c_{k}"))
    text = lambda kind: f"list_transform({kind}, lambda x: '{kind}:' || x.s || ':' || x.e)"
    listed = " || ".join(text(k) for k in pii.KINDS)
    base = " || ".join(pii.KINDS)
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
s as (select rid, doc_id, t, {spans} from d),
g as (select *, {flags}, list_distinct(regexp_extract_all(lower(regexp_replace(t, {quoted(PLAIN["email"])}, ' ', 'g')), '\p{{L}}{{2,}}')) as terms from s),
whole as (select count(*) as docs, {", ".join(f"sum(f_{k}) as a_{k}" for k in pii.KINDS)} from g),
each as (select unnest(terms) as term, {", ".join(f"f_{k}" for k in pii.KINDS)} from g),
counts as (select term, count(*) as n, {", ".join(f"sum(f_{k}) as c_{k}" for k in pii.KINDS)} from each group by term),
private as (select t, count(*) as m, any_value(terms) as terms, any_value(list_distinct({values})) as vs from g where {" + ".join(f"f_{k}" for k in pii.KINDS)} > 0 group by t),
owned as (select t, m, unnest(vs) as v from private),
common as (select v, sum(m) as docs_v from owned group by v having count(*) >= {pii.SUPPORT}),
words as (select t, unnest(terms) as term from private),
pairs as (select term, v, count(*) as texts, sum(m) as joint, any_value(docs_v) as docs_v from owned join common using (v) join words using (t) group by term, v having count(*) >= {pii.SUPPORT}),
single as (select term from pairs join counts using (term), whole where {exceeds("((joint + 1) / (n + 2))", "((docs_v + 1) / (docs + 2))", "texts")}),
listed as (select list(term) as all_terms from (select term from counts, whole where {" or ".join(over)} union select term from single)),
o as (
  select g.*, case when {" + ".join(f"f_{k}" for k in pii.KINDS)} > 0 and len(all_terms) > 0 then
    list_filter(list_transform(list_filter({located("t", r"\p{L}+")}, lambda x: list_contains(all_terms, lower(x.m))), lambda x: {{'s': x.s, 'e': x.s + length(x.m)}}),
      lambda x: len(list_filter({base}, lambda b: b.s < x.e and x.s < b.e)) = 0) else [] end as term
  from g, listed
)
select doc_id, {", ".join(f"len({k})::bigint as n_{k}" for k in pii.KINDS)}, sha256(array_to_string({listed}, ',')) as base_sha256,
  array_to_string({listed} || {text("term")}, ',') as spans
from o
"""


def hosts_sql() -> str:
    ordered = sorted(hosts.RULES, key=lambda r: (-len(r), r))

    def fits(rule: str) -> str:
        name, slash, rest = rule.partition("/")
        return f"(host = {quoted(name)} or ends_with(host, {quoted('.' + name)})) and starts_with(path, {quoted(slash + rest)})"

    rule = "case " + " ".join(f"when {fits(r)} then {quoted(r)}" for r in ordered) + " end"
    ruled = "case " + " ".join(f"when rule = {quoted(r)} then {quoted(v)}" for r, v in hosts.RULES.items()) + " end"
    case = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}')"
    steps = [
        "u as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages)",
        f"h as (select page_id, html, coalesce({case}, '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u)",
        f"r as (select *, {rule} as rule from h)",
        f"v as (select *, {ruled} as ruled from r)",
        "seeds as (select host, avg(case when ruled = 'allow' then 1.0::double else 0.0::double end) as allow, avg(case when ruled = 'block' then 1.0::double else 0.0::double end) as block from v group by host)",
        f"links as (select host as src, unnest(regexp_extract_all(html, {quoted(hosts.LINK)}, 1)) as dst from h)",
        f"named as (select src, regexp_replace(translate(dst, '{hosts.UPPER}', '{hosts.LOWER}'), '^.*@', '') as dst from links)",
        "edges as (select src, dst, count(*) as n from named where src <> '' and dst <> '' and src <> dst group by src, dst)",
    ]
    for seed, a, b in (("allow", "src", "dst"), ("block", "dst", "src")):
        steps.append(f"share_{seed} as (select {a} as src, {b} as dst, n / sum(n) over (partition by {a}) as share from edges)")
        steps.append(f"links_{seed} as (select {a} as host, sum(n)::double as links from edges group by {a})")
        steps.append(f"start_{seed} as (select host, coalesce({seed}, 0) as own, coalesce(links, 0) as links from seeds full join links_{seed} using (host))")
        steps.append(f"{seed}_0 as (select host, own * links as score, links as whole from start_{seed})")
        for i in range(1, hosts.ROUNDS + 1):
            steps.append(
                f"{seed}_{i} as (select coalesce(s.host, m.host) as host, coalesce(s.score, 0) + {hosts.DAMPING} * coalesce(m.score, 0) as score, coalesce(s.whole, 0) + {hosts.DAMPING} * coalesce(m.whole, 0) as whole from {seed}_0 s full join "
                f"(select dst as host, sum(share * score) as score, sum(share * whole) as whole from share_{seed} e join {seed}_{i - 1} x on e.src = x.host group by dst) m on s.host = m.host)"
            )
        brought = "(r.whole - coalesce(links, 0))"
        part = f"case when {brought} > 1e-9 then (r.score - coalesce(own * links, 0)) / {brought} else 0 end"
        steps.append(f"f_{seed} as (select host, round(greatest(coalesce(own, 0), {part}), 9) as figure from {seed}_{hosts.ROUNDS} r left join start_{seed} s using (host))")
    return (
        "with "
        + ",\n".join(steps)
        + f"""
select page_id, v.host, path, rule, coalesce(ruled, case when b.figure >= {hosts.THRESHOLD} and b.figure > coalesce(a.figure, 0) then 'block' else 'allow' end) as verdict
from v left join f_allow a on v.host = a.host left join f_block b on v.host = b.host
"""
    )


def search_sql() -> str:
    term = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    words = lambda text: f"unnest(list_transform(regexp_extract_all(coalesce({text}, ''), '{term}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))"
    return f"""
with d as (
  select row_number() over () as r, doc_id, text from documents
), dt as (
  select r, doc_id, {words("text")} as term from d
), n as (
  select r, count(*) as n from dt group by r
), whole as (
  select count(*) as nd, sum(n)::bigint as l from n
), it as (
  select item_id, term, count(*) as q from (select item_id, {words("text")} as term from benchmark) group by item_id, term
), tf as (
  select r, doc_id, term, count(*) as tf from dt where term in (select term from it) group by r, doc_id, term
), w as (
  select term, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), whole
), s as (
  select item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::bigint as score
  from it join tf using (term) join w using (term) join n using (r), whole group by item_id, r, doc_id
), k as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0
)
select item_id, rank, doc_id, score from k where rank <= 10
"""


def audit_sql() -> str:
    return r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), f as (
  select part, doc_id,
    (case when len(ws) < 100 then 1 else 0 end) | (case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end)
    | (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end)
    | (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    | (case when coalesce(doc_id > min(doc_id) over (partition by t), false) then 16 else 0 end) as mask
  from d
), l as (
  select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id
), c as (
  select part, mask, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x
  from f left join l using (doc_id) group by part, mask
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as a
), orders as (
  select a.a || b.a || c.a || d.a || e.a as o from letters a, letters b, letters c, letters d, letters e
  where length(a.a || b.a || c.a || d.a || e.a) = len(list_distinct([a.a, b.a, c.a, d.a, e.a]))
), steps as (
  select o, step, 1 << (ascii(substr(o, step, 1)) - 65) as bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i::int, 1)) - 65))) as before
  from orders, (select unnest(range(1, 6))::int as step)
), r as (
  select part, o, step, bit, coalesce(before, 0)::bigint as before,
    sum(case when mask & (coalesce(before, 0)::bigint | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & coalesce(before, 0)::bigint = 0 and mask & bit <> 0 then n else 0 end) as removed,
    sum(case when mask & coalesce(before, 0)::bigint <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & coalesce(before, 0)::bigint = 0 and mask & bit <> 0 then g else 0 end) as good_lost,
    sum(case when mask & coalesce(before, 0)::bigint = 0 and mask & bit <> 0 then x else 0 end) as toxic_lost
  from c, steps group by all
)
select part, o as filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""


ORACLES = {
    "op5_secrets": secrets_sql(),
    "op7_rules": rules_sql(),
    "op9_hosts": hosts_sql(),
    "op10_pii": pii_sql(),
    "op11_search": search_sql(),
    "op12_audit": audit_sql(),
}
