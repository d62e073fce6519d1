"""DuckDB SQL of the operators that SQL can express; parameters come from the operators' modules."""

from __future__ import annotations

from basketlens.llm import filter_audit, lexical_search, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _one_of(name: str, values: tuple) -> str:
    return " OR ".join(f"{name} = '{v}' OR ends_with({name}, '.{v}')" for v in values)


def _rules() -> str:
    rows = []
    for verdict, rule in url_filter.RULES:
        at = rule.index("/")
        rows.append(f"('{verdict}', '{rule}', '{rule[:at]}', '{rule[at:]}')")
    return ", ".join(rows)


def _weight(table: str, mean: str) -> str:
    least, most = url_filter.SPREAD
    return f"""SELECT CASE WHEN coalesce(sum(room), 0) = 0 THEN {url_filter.PRIOR_PAGES}
             ELSE 1 / least(greatest(sum(extra) / sum(room), {least}), {most}) - 1 END AS weight
      FROM (SELECT pow(k - n * ({mean}), 2) / n - ({mean}) * (1 - ({mean})) AS extra,
                   (n - 1) * ({mean}) * (1 - ({mean})) AS room FROM {table} WHERE n > 0)"""


URL_FILTER = rf"""
WITH urls AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(html, '{url_filter._UNSEEN}', ' ', 'g'), '(?s)<[^>]*(?:>|\z)', ' ', 'g') AS seen
  FROM urls
), judged AS (
  SELECT page_id, host, path, (words < {url_filter.MIN_WORDS} OR 100 * signs > {url_filter.MAX_SIGN_PERCENT} * words)::INT AS bad
  FROM (SELECT page_id, host, path, len(regexp_extract_all(seen, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(seen, '{url_filter._SIGNS}')) AS signs FROM parts)
), counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM judged GROUP BY host
), named AS (
  SELECT *, string_split(name, '.') AS labels, regexp_matches(name, '^[0-9.]+$|^\[') AS address,
    {_one_of("name", url_filter.SUFFIXES)} AS long FROM counted
), hosts AS (
  SELECT host, n, k,
    CASE WHEN address THEN name WHEN long THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
    CASE WHEN address THEN '' WHEN long THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix
  FROM named
), total AS (SELECT coalesce(sum(n), 0)::BIGINT AS tn, coalesce(sum(k), 0)::BIGINT AS tk FROM hosts),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes AS (
  SELECT suffix, n, k, (tk - k + 0.5::DOUBLE) / (tn - n + 1) AS m FROM (
    SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL), total
), w1 AS ({_weight("suffixes", "m")}),
domains2 AS (
  SELECT d.*, s.n AS sn, s.k AS sk,
    (weight * ((tk - d.k + 0.5::DOUBLE) / (tn - d.n + 1)) + s.k - d.k) / (weight + s.n - d.n) AS m
  FROM domains d JOIN suffixes s USING (suffix), total, w1
), w2 AS ({_weight("domains2", "m")}),
hosts2 AS (
  SELECT h.host, h.n, h.k,
    (w2.weight * ((w1.weight * ((tk - h.k + 0.5::DOUBLE) / (tn - h.n + 1)) + sk - h.k) / (w1.weight + sn - h.n)) + d.k - h.k)
      / (w2.weight + d.n - h.n) AS m
  FROM hosts h JOIN domains2 d USING (domain, suffix), total, w1, w2
), w3 AS ({_weight("hosts2", "m")}),
posterior AS (SELECT host, weight * m + k AS a, weight * (1 - m) + n - k AS b FROM hosts2, w3),
blocked AS (
  SELECT host FROM posterior
  WHERE a / (a + b) - {(url_filter.LEVEL / (1 - url_filter.LEVEL)) ** 0.5!r} * sqrt(a * b / (a + b + 1)) / (a + b) >= {url_filter.MAX_BAD}
), rules(verdict, rule, rule_host, rule_path) AS (VALUES {_rules()})
SELECT page_id, host, path, r.rule,
  coalesce(r.verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN LATERAL (
  SELECT rule, verdict FROM rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule) DESC, length(rule_host) DESC, rule LIMIT 1
) r ON true
"""

_TERMS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH = f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus
), scored AS (
  SELECT item, item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score,
    any_value(doc_id) AS doc_id
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r), corpus GROUP BY item, item_id, r
), numbered AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= {lexical_search.TOP}
"""


def _filter_audit() -> str:
    letters = filter_audit.FILTERS
    bits = {c: 1 << i for i, c in enumerate(letters)}
    names = [f"f{i}" for i in range(1, len(letters) + 1)]
    orders = f"""SELECT {" || ".join(names)} AS filter_order, {", ".join(names)}
      FROM {", ".join(f"(SELECT unnest([{', '.join(repr(c) for c in letters)}]) AS {n})" for n in names)}
      WHERE len(list_distinct([{", ".join(names)}])) = {len(letters)}"""
    bit = "CASE {0} " + " ".join(f"WHEN '{c}' THEN {b}" for c, b in bits.items()) + " END"
    steps = " UNION ALL ".join(
        f"SELECT filter_order, {i}::INT AS step, {bit.format(n)} AS own, {' + '.join(['0', *[bit.format(x) for x in names[: i - 1]]])} AS before FROM orders"
        for i, n in enumerate(names, 1)
    )
    failed = "(mask & own) > 0"
    first = f"{failed} AND (mask & before) = 0"
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), facts AS (
  SELECT doc_id, part,
    (len(words) < {filter_audit.MIN_WORDS})::INT * {bits["A"]}
    + (100 * list_unique(words) < {filter_audit.MIN_DISTINCT_PERCENT} * len(words))::INT * {bits["B"]}
    + (100 * len(regexp_extract_all(text, '[A-Z]')) > {filter_audit.MAX_CAPITAL_PERCENT} * length(text))::INT * {bits["C"]}
    + regexp_matches(text, '{filter_audit.SIGNS}')::INT * {bits["D"]}
    + coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT * {bits["E"]} AS mask
  FROM texts
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM facts LEFT JOIN marks USING (doc_id) GROUP BY ALL
), orders AS ({orders}),
steps AS ({steps}),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(docs) FILTER (WHERE (mask & (before + own)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(docs) FILTER (WHERE {first}), 0)::BIGINT AS removed,
    coalesce(sum(docs) FILTER (WHERE {failed} AND (mask & before) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(docs) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE {first}), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE {first}), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""


FILTER_AUDIT = _filter_audit()
