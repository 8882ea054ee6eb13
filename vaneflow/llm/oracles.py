"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

#: Places of matches: gaps and matches alternate, so their lengths add up.
_PLACES = """
CREATE_NAME AS (
  SELECT doc_id, row, KIND AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'm': m[i]})) AS span
  FROM (SELECT doc_id, row, regexp_extract_all(text, PATTERN) AS m, regexp_split_to_array(text, PATTERN) AS g FROM d WHERE regexp_matches(text, PATTERN)) WHERE len(m) > 0)"""


def _places(name: str, kind: int, pattern: str) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return _PLACES.replace("CREATE_NAME", name).replace("KIND", str(kind)).replace("PATTERN", quoted)


def _scored(kinds: list[str]) -> str:
    """Score of a span (row, kind, s) of `a`: the prior of its kind, halfway to 1 if one of the kind's words is near before it."""
    before = "lower(substr(text, (greatest(0, s - 40) + 1)::BIGINT, (s - greatest(0, s - 40))::BIGINT))"
    near = lambda k: "(" + " OR ".join(f"contains({before}, '{w}')" for w in _NEAR[k]) + ")"
    cases = " ".join(f"WHEN {i} THEN CASE WHEN {near(k)} THEN round({_PRIOR[k]}::DOUBLE + (1 - {_PRIOR[k]}::DOUBLE) * 0.5, 6) ELSE {_PRIOR[k]}::DOUBLE END" for i, k in enumerate(kinds))
    return f"a AS (SELECT * FROM (SELECT b.*, CASE kind {cases} END AS score FROM a0 b JOIN d USING (row)) WHERE kind < 4 OR score >= 0.5)"


def _spans(kinds: list[str], parts: dict[str, tuple[str, str]], base: int, counts: list[str], table_columns: str = "", scores: bool = False) -> str:
    """Counts, digest and list from one part (pattern, validity over `m`) for each kind."""
    ctes = ["d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents)"]
    ctes += [_places(f"p_{k}", i, parts[k][0]) for i, k in enumerate(kinds)]
    union = " UNION ALL ".join(f"SELECT row, kind, span.s AS s, span.s + length(span.m) AS e, span.m AS m FROM p_{k} WHERE {parts[k][1].replace('$m', 'span.m')}" for k in kinds)
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    ctes += [f"a0 AS ({union})", _scored(kinds)] if scores else [f"a AS ({union})"]
    more = ", string_agg(score::VARCHAR, ',' ORDER BY s, kind, e) AS sc" if scores else ""
    ctes.append(
        f"g AS (SELECT row, {', '.join(f'count(*) FILTER (kind = {kinds.index(k)}) AS n_{k}' for k in counts)}, "
        f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < {base}) AS b, "
        f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS every{more} FROM a GROUP BY row)"
    )
    columns = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in counts)
    return f"WITH {', '.join(ctes)} SELECT doc_id, {columns}, sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans{table_columns} FROM d LEFT JOIN g USING (row)"


_DIGITS = "regexp_replace($m, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 "
    f"THEN 2 * substr(reverse({_DIGITS}), i, 1)::INT - CASE WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr(reverse({_DIGITS}), i, 1)::INT END)) % 10 = 0"
)
_IBAN = "replace($m, ' ', '')"
_MOD97 = (
    f"list_reduce(list_prepend(0, list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), "
    "lambda acc, v: CASE WHEN v >= 10 THEN (acc * 100 + v) % 97 ELSE (acc * 10 + v) % 97 END) = 1"
)
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split($m, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL OR try_cast(p AS HUGEINT) > 255)) = 0"),
    "card": (r"[0-9](?:[ -]?[0-9])+", _LUHN),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", _MOD97),
    # Without look-around in SQL the digits and hyphens around are matched too; only three parts of these sizes count.
    "ssn": (r"[0-9-]*[0-9]{3}-[0-9]{2}-[0-9]{4}[0-9-]*", "regexp_full_match($m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
}
_PRIOR = {"email": "0.9", "ip": "0.6", "card": "0.8", "phone": "0.7", "iban": "0.95", "ssn": "0.4"}
_NEAR = {"email": ["mail", "contact", "@"], "ip": ["ip", "address", "host", "server"], "card": ["card", "credit", "visa", "payment"],
         "phone": ["phone", "call", "tel", "mobile"], "iban": ["iban", "bank", "account"], "ssn": ["ssn", "social security", "tax id"]}
_SECRETS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+", r"length(regexp_extract($m, '^(?i:password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    "access": (r"AKIA[A-Z0-9]+", "length($m) >= 20"),
    "hex": (r"[0-9a-f]{24,}", "true"),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    "webtoken": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
}

OP2 = "SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, scores FROM (" + _spans(list(_PII), _PII, 4, list(_PII), ", coalesce(sc, '') AS scores", scores=True) + ")"
OP7 = _spans(list(_SECRETS), _SECRETS, 3, ["assign", "access", "hex"], ", sha256(text) AS blob")

OP8 = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, r.vec_id AS vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.c), len(r.c)) + 1), lambda i: q.c[i] * r.c[i])), 0)::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.n <> r.n)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 10"""


def _share_out(children: str, parent: str, name: str, weight: str) -> str:
    """One level of the tree: children (parent, name, held, budget) get `given`."""
    return f"""(
  WITH w AS (SELECT *, {weight} AS wt FROM {children}),
  o AS (SELECT *, budget - coalesce(sum(held) OVER (PARTITION BY {parent} ORDER BY held / wt::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(wt) OVER (PARTITION BY {parent} ORDER BY held / wt::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts FROM w),
  f AS (SELECT *, held::HUGEINT * wts <= lft::HUGEINT * wt AS filled, row_number() OVER (PARTITION BY {parent} ORDER BY held / wt::DOUBLE, {name}) AS rn FROM o),
  x AS (SELECT {parent}, arg_min(lft, rn) AS l, arg_min(wts, rn) AS ws FROM f WHERE NOT filled GROUP BY ALL)
  SELECT f.*, CASE WHEN filled THEN held ELSE greatest(x.l::HUGEINT * wt // x.ws, 0) END::BIGINT AS given FROM f LEFT JOIN x USING ({parent}))"""


OP9 = f"""
WITH r AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS ident, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, ' ')) END::BIGINT AS tokens FROM documents),
t AS (SELECT *, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_full_match(source, 'src[1-9]') THEN 'reference' ELSE 'community' END AS domain FROM r WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 2 AS held FROM t GROUP BY ALL),
b0 AS (SELECT domain, 0 AS root, sum(held)::BIGINT AS held, (SELECT floor(sum(tokens) * 80 / 100)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY ALL),
b1 AS {_share_out("b0", "root", "domain", "CASE domain WHEN 'crawl' THEN 40 WHEN 'reference' THEN 35 ELSE 25 END")},
c1 AS (SELECT domain, lang, sum(held)::BIGINT AS held, any_value(given) AS budget FROM (SELECT leaf.*, b1.given FROM leaf JOIN b1 USING (domain)) GROUP BY ALL),
b2 AS {_share_out("c1", "domain", "lang", "CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END")},
c2 AS (SELECT domain || '/' || leaf.lang AS node, leaf.domain, leaf.lang, leaf.source, leaf.tokens, leaf.held, b2.given AS budget FROM leaf JOIN b2 USING (domain, lang)),
b3 AS {_share_out("c2", "node", "source", "1")},
e AS (SELECT domain, lang, source, epoch::INT AS epoch, given AS leaf_budget, least(tokens, given - epoch * tokens) AS room FROM b3, (VALUES (0), (1)) AS n(epoch) WHERE given > 0),
o AS (SELECT t.*, e.epoch, e.leaf_budget, e.room, sum(t.tokens) OVER (PARTITION BY t.domain, t.lang, t.source, e.epoch ORDER BY md5('11:' || e.epoch || ':' || t.ident), t.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM t JOIN e USING (domain, lang, source) WHERE e.room > 0)
SELECT doc_id, domain, lang, source, epoch, tokens, leaf_budget FROM o WHERE upto <= room"""

OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM x GROUP BY g HAVING count(*) > 1),
rk AS (SELECT x.doc_id, g, row_number() OVER (PARTITION BY x.doc_id ORDER BY coalesce(f.df, 1), g) AS rn FROM x LEFT JOIN f USING (g)),
pre AS (SELECT rk.doc_id, g, n.n FROM rk JOIN n USING (doc_id) WHERE rn <= n.n - ceil(n.n * 0.85) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
sim AS (SELECT a, b, len(list_intersect(s1.sh, s2.sh)) AS i, len(s1.sh) + len(s2.sh) AS t FROM cand JOIN s s1 ON a = s1.doc_id JOIN s s2 ON b = s2.doc_id),
lk AS MATERIALIZED (SELECT a, b FROM sim WHERE 100 * i >= 85 * (t - i) UNION SELECT b, a FROM sim WHERE 100 * i >= 85 * (t - i)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM lk UNION SELECT r.a, lk.b FROM r JOIN lk ON r.b = lk.a) SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) AS kept FROM n LEFT JOIN reach ON n.doc_id = reach.a"""


def _tree(name: str, nodes: str, levels: int = 8) -> str:
    """Levels of the trees over `nodes` (g, pos, n, d), and for each node id its path: `name`_r0, `name`_r1, ... hold the runs."""
    parts, now = [], nodes
    for k in range(levels):
        parts.append(f"{name}_r{k} AS (SELECT g, pos // 16 AS pos, any_value(n) AS n, string_agg(d, '' ORDER BY pos) AS ds FROM {now} GROUP BY g, pos // 16)")
        parts.append(f"{name}_l{k} AS (SELECT g, pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(ds) ELSE ds END AS d FROM {name}_r{k})")
        now = f"{name}_l{k}"
    return ",\n".join(parts)


def _climb(name: str, start: str, levels: int = 8) -> str:
    """`start` (id, g, pos, cur, proof) taken up all levels: cur is the folded digest, proof the siblings so far."""
    parts, now = [], start
    for k in range(levels):
        before, after = "substr(ds, 1, (u.pos % 16 * 64)::BIGINT)", "substr(ds, (u.pos % 16 * 64 + 65)::BIGINT)"
        parts.append(
            f"{name}_u{k} AS (SELECT u.id, u.g, u.pos // 16 AS pos, CASE WHEN r.n > 1 THEN sha256({before} || u.cur || {after}) ELSE u.cur END AS cur, "
            f"CASE WHEN r.n > 1 THEN u.proof || {before} || {after} ELSE u.proof END AS proof FROM {now} u JOIN {name}_r{k} r ON u.g = r.g AND u.pos // 16 = r.pos)"
        )
        now = f"{name}_u{k}"
    return ",\n".join(parts)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, (y & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
)
_BENT = f"CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({_LEAF} || {_field("text")}) AS leaf, sha256({_LEAF} || {_field("bent")}) AS bent FROM (SELECT *, {_BENT} AS bent FROM documents)),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM d)),
a0 AS MATERIALIZED (SELECT id, g, leaf AS d, bent, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
{_tree("a", "a0")},
b0 AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, d FROM a_l7),
{_tree("b", "b0")},
a_in AS (SELECT id, g, pos, bent AS cur, '' AS proof FROM a0),
{_climb("a", "a_in")},
b_in AS (SELECT id, 0 AS g, g AS pos, cur, proof FROM a_u7),
{_climb("b", "b_in")}
SELECT d.doc_id, d.leaf, a_l7.d AS subroot, b_l7.d AS root, sha256(u.proof) AS proof_sha256, u.cur AS folded_root, u.cur = b_l7.d AS verified
FROM d JOIN b_u7 u USING (id) JOIN a0 USING (id) JOIN a_l7 ON a0.g = a_l7.g CROSS JOIN b_l7"""

OP12 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS newest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN newest IS DISTINCT FROM page_id THEN newest END AS refers_to FROM m"""

ORACLES = {"op2_pii_spans": OP2, "op3_setsketch_dedup": OP3, "op7_secret_ledger": OP7, "op8_exact_top_k": OP8, "op9_source_mix": OP9, "op11_merkle_manifest": OP11, "op12_warc_archives": OP12}
