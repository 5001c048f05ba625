"""The same results as plain SQL over the given tables, for comparison in DuckDB."""

from __future__ import annotations

from riskflow import dims
from riskflow.plans import views as v

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = lambda items: "[" + ", ".join(_Q(i) for i in items) + "]"
_IN = lambda items: "(" + ", ".join(_Q(i) for i in items) + ")"


def _flags(pairs) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {name if name.startswith('concat') else _Q(name)} END"
                      for name, cond in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SQL: dict[str, str] = {}

# ------------------------------------------------------------------ links
_HOST = "regexp_extract(url, '^[a-z]+://(?:[^/?#]*@)?([^/?#:]*)', 1)"
_URL = f"""u0 AS ({v.view_sql(v.SCAN_URLS)}),
u1 AS (SELECT *, string_split(string_split(url, '://')[-1], '/')[1] AS nh,
  regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query,
  regexp_extract(url, '^[a-z]+://(?:[^/?#]*@)?[^/?#:]*:([0-9]+)', 1) AS port FROM u0),
u2 AS (SELECT *, length(nh) - length(replace(nh, '-', '')) AS hyphens,
  greatest(length(nh) - length(replace(nh, '.', '')) - 1, 0) AS d0,
  list_filter({_LIST(dims.URL_KEYWORDS)}, lambda w: contains(lower(concat(nh, path)), w)) AS words,
  CASE WHEN instr(substr(url, instr(url, '://') + 3), '//') > 0
    THEN instr(substr(url, instr(url, '://') + 3), '//') + instr(url, '://') + 1 ELSE -1 END AS slashes,
  coalesce(list_sum(list_transform(list_distinct(string_split(nh, '')),
    lambda c: -((length(nh) - length(replace(nh, c, ''))) / length(nh))
      * log2((length(nh) - length(replace(nh, c, ''))) / length(nh)))), 0.0) AS entropy,
  length(regexp_replace(nh, '[^0-9]', '', 'g')) AS digits,
  length(regexp_replace(nh, '[^\\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(url, '[^?=&%_]', '', 'g')) AS specials,
  len(list_filter(string_split(query, '&'), lambda kv: regexp_matches(
    replace(regexp_extract(kv, '^[^=]*=(.*)$', 1), '+', ' '), '^[A-Za-z0-9/\\-_]{{30,}}={{0,2}}$'))) > 0 AS b64,
  regexp_matches(url, '://\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') AS ip,
  contains(url, '@') AS at_sign,
  regexp_matches(nh, '\\.({"|".join(dims.SUSPICIOUS_TLDS)})$') AS tld FROM u1),
u3 AS (SELECT *, greatest(d0 - CASE WHEN nh LIKE 'www.%' THEN 1 ELSE 0 END, 0) AS depth,
  CASE WHEN letters > 0 THEN digits / letters WHEN digits > 0 THEN 1.0 ELSE 0.0 END AS ratio FROM u2),
u AS (SELECT *, CASE WHEN ip THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN at_sign THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN hyphens >= 3 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN tld THEN 0.4 ELSE 0 END::DOUBLE AS lex0,
  {_flags([("ip_based_host", "ip"), ("at_symbol_present", "at_sign"),
           ("concat('high_hyphen_count(', hyphens, ')')", "hyphens >= 3"), ("suspicious_tld", "tld"),
           ("url_shortener", " OR ".join(f"contains(nh, '{s}')" for s in dims.SHORTENERS)),
           ("url_length_anomaly", "length(url) >= 75"), ("path_length_anomaly", "length(path) >= 20"),
           ("subdomain_depth_anomaly", "depth >= 2"), ("suspicious_keywords", "len(words) > 0"),
           ("double_slash_redirect", "slashes >= 0"), ("http_without_https", "scheme = 'http'"),
           ("non_standard_port", "port <> '' AND port NOT IN ('80', '443')"),
           ("https_in_hostname", "contains(lower(nh), 'http')"),
           ("high_shannon_entropy", "entropy >= 4.0"), ("high_digit_ratio", "ratio >= 0.2"),
           ("special_char_overload", "specials >= 5"), ("base64_obfuscation", "b64")])} AS flags FROM u3)"""
_EV = lambda key, val, cond: f"CASE WHEN {cond} THEN concat('{key}=', {val}) END"
_EVID = "array_to_string(list_filter([" + ", ".join([
    _EV("URL_LENGTH", "length(url)", "length(url) >= 75"),
    _EV("PATH_LENGTH", "length(path)", "length(path) >= 20"),
    _EV("SUBDOMAIN_DEPTH", "depth", "depth >= 2"),
    _EV("SUSPICIOUS_KEYWORDS", "concat('[\"', array_to_string(words, '\",\"'), '\"]')", "len(words) > 0"),
    _EV("DOUBLE_SLASH_REDIRECT", "slashes", "slashes >= 0"),
    _EV("HTTP_WITHOUT_HTTPS", "'true'", "scheme = 'http'"),
    _EV("NON_STANDARD_PORT", "port", "port <> '' AND port NOT IN ('80', '443')"),
    _EV("HTTPS_IN_HOSTNAME", "'true'", "contains(lower(nh), 'http')"),
    _EV("SHANNON_ENTROPY", "round(entropy, 2)", "entropy >= 4.0"),
    _EV("DIGIT_TO_LETTER_RATIO", "round(ratio, 3)", "ratio >= 0.2"),
    _EV("SPECIAL_CHAR_COUNT", "specials", "specials >= 5"),
    _EV("BASE64_OBFUSCATION", "'true'", "b64"),
]) + "], lambda x: x IS NOT NULL), ';')"
SQL["url_flags"] = f"""WITH {_URL} SELECT page_id, round(least(lex0, 1.0), 4) AS lex_score,
  array_to_string(flags, ',') AS flags, {_EVID} AS evidence FROM u"""

_DOMAINS = ", ".join(f"('{d}')" for d in dims.SEED_DOMAINS)
_SCORED = f"""{_URL}, feed AS ({v.FEED_URLS_SQL}),
byhost AS (SELECT domain, min(url) AS url FROM feed GROUP BY domain),
allow(domain) AS (VALUES {_DOMAINS}),
h AS (SELECT u.*, lower({_HOST}) AS host FROM u),
m AS (SELECT h.*, least(lex0, 1.0) AS lex, f.url IS NOT NULL OR b.url IS NOT NULL AS hit,
    coalesce(f.url, b.url) AS hit_url,
    host IN (SELECT domain FROM allow) OR (len(string_split(host, '.')) > 2 AND
      concat(string_split(host, '.')[-2], '.', string_split(host, '.')[-1]) IN (SELECT domain FROM allow)) AS allowed
  FROM h LEFT JOIN feed f ON h.url = f.url LEFT JOIN byhost b ON h.host = b.domain),
s AS (SELECT *, CASE WHEN hit THEN 100.0 WHEN allowed AND NOT ip AND NOT at_sign
      THEN least(lex * 0.25, 0.15) * 100.0 ELSE lex * 0.7 * 100.0 END AS score,
    CASE WHEN hit THEN 0.95 WHEN allowed AND NOT ip AND NOT at_sign THEN 0.9 ELSE 0.8 END AS conf,
    CASE WHEN hit THEN 'success' ELSE 'partial' END AS status,
    list_sort(list_concat(flags, {_flags([("known_malicious_url", "hit"), ("urlhaus_malicious", "hit"),
                                          ("whitelisted_trusted_domain", "allowed AND NOT hit")])})) AS all_flags
  FROM m)"""
SQL["url_scored"] = f"""WITH {_SCORED} SELECT page_id, round(score, 4)::DOUBLE AS risk_score, conf::DOUBLE AS confidence,
  status, array_to_string(all_flags, ',') AS flags FROM s"""
SQL["url_feed_match"] = f"""WITH {_SCORED} SELECT page_id, hit_url,
  CASE WHEN hit THEN 'malware_download' END AS threat_type FROM s"""
SQL["url_allowlist"] = f"WITH {_SCORED} SELECT page_id, allowed AS allow_listed FROM s"
SQL["url_reputation"] = f"""WITH u0 AS ({v.view_sql(v.SCAN_URLS)}),
r AS (SELECT url, bool_or(page_id % 12 = 0) AS bad, max(CASE WHEN page_id % 18 = 0 THEN 503 ELSE 200 END) AS st
  FROM u0 WHERE page_id % 6 = 0 GROUP BY url)
SELECT page_id, CASE WHEN bad AND st = 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS rep_score,
  CASE WHEN bad AND st = 200 THEN 'MALWARE,SOCIAL_ENGINEERING' ELSE '' END AS threats,
  CASE WHEN st <> 200 THEN concat('GSB_API_ERROR_', st) END AS rep_error
FROM u0 LEFT JOIN r USING (url)"""
SQL["url_domain_age"] = f"""WITH p AS (SELECT page_id, lower({_HOST}) AS host FROM pages),
d AS (SELECT page_id, array_to_string(string_split(host, '.')[-2:], '.') AS dom FROM p),
a AS (SELECT dom, min(page_id % 40) AS first_day FROM d GROUP BY dom)
SELECT page_id, greatest(10 - first_day, 0)::BIGINT AS domain_age FROM d JOIN a USING (dom)"""
SQL["url_normalize"] = f"""WITH r AS ({v.view_sql(v.RAW_URLS)})
SELECT page_id, CASE page_id % 12
    WHEN 0 THEN substr(url, 2, length(url) - 2) WHEN 3 THEN substr(url, 2, length(url) - 2)
    WHEN 1 THEN concat('https://example.com/', page_id, '?A=b#C')
    WHEN 5 THEN concat('http://', url)
    WHEN 6 THEN concat('http://u:p@host.example.com:8080/', page_id)
    WHEN 7 THEN concat('http://example.com/', page_id, ';v=1')
    WHEN 11 THEN url END AS clean,
  CASE page_id % 12 WHEN 2 THEN 'unsupported_scheme_javascript' WHEN 4 THEN 'unsupported_scheme_ftp'
    WHEN 8 THEN 'missing_url_host' WHEN 9 THEN 'preprocessing_error: Port out of range 0-65535'
    WHEN 10 THEN 'url_exceeds_max_length' WHEN 5 THEN 'url_scheme_defaulted_to_http'
    WHEN 6 THEN 'url_embedded_credentials_present' ELSE '' END AS warnings,
  CASE page_id % 12 WHEN 2 THEN 'unsupported_scheme_javascript' WHEN 4 THEN 'unsupported_scheme_ftp'
    WHEN 8 THEN 'missing_url_host' WHEN 9 THEN 'preprocessing_error: Port out of range 0-65535'
    WHEN 10 THEN 'url_exceeds_max_length' END AS error FROM r"""
_ON = lambda k, value: f"CASE WHEN m = {k} THEN {value} END"
SQL["scan_requests"] = f"""SELECT doc_id, CASE WHEN m < 5 THEN concat('s', doc_id) END AS scan_id, CASE WHEN m < 5 THEN md5(text) END AS text_md5,
  CASE m WHEN 0 THEN doc_id + 0.5 WHEN 1 THEN doc_id END::DOUBLE AS meta_ts, CASE WHEN m < 5 THEN m IN (0, 1, 3) END AS has_headers,
  CASE m WHEN 0 THEN concat('a', doc_id, '@x.org') WHEN 1 THEN 'b@x.org' END AS h_from, {_ON(1, "concat('c', doc_id, '@y.org')")} AS h_reply_to,
  {_ON(3, "'Mon, 1 Jan 2024 00:00:00 +0000'")} AS h_date, {_ON(3, "'<m@x.org>'")} AS h_message_id,
  {_ON(0, "concat('from h1;:from h', doc_id)")} AS received, {_ON(2, "concat('z', doc_id, '.org')")} AS sender_domain,
  {_ON(2, "concat('c', doc_id)")} AS client_id, CASE m WHEN 1 THEN concat('inv', doc_id, '.exe') WHEN 2 THEN concat('f', doc_id, '.js') END AS att_name,
  CASE m WHEN 1 THEN md5(text) WHEN 2 THEN md5('MZ') END AS att_md5, {_ON(3, "'strict'")} AS profile, {_ON(3, """'{"a":[1,2]}'""")} AS nested,
  {_ON(5, "'unreadable request'")} AS reject_reason FROM (SELECT *, doc_id % 6 AS m FROM documents)"""
_BOUND = lambda b: f"WHEN {b} < 0 OR {b} > 100 THEN concat('Threshold ''{b}'' must be between 0.0 and 100.0, got ', {b})"
_RISE = lambda a, b: (
    f"WHEN {a} >= {b} THEN concat('Invalid threshold ordering: {a} (', {a}, ') must be strictly less than {b} (', {b}, ')')")
_UPPERS = ["safe_upper", "suspicious_upper", "deceptive_upper", "phishing_upper"]
SQL["profile_check"] = f"""WITH p AS (SELECT CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE concat('P', doc_id // 2, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END) END AS name,
  (n_chars % 60 - 2)::DOUBLE AS safe_upper, (n_chars % 60 + doc_id % 30)::DOUBLE AS suspicious_upper,
  (n_chars % 60 + doc_id % 30 + doc_id % 7)::DOUBLE AS deceptive_upper, (n_chars % 60 + 40)::DOUBLE AS phishing_upper FROM documents),
c AS (SELECT *, CASE {" ".join(map(_BOUND, _UPPERS))} {" ".join(_RISE(a, b) for a, b in zip(_UPPERS, _UPPERS[1:]))}
  WHEN trim(name) = '' THEN 'Profile has no name' END AS reason FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY trim(name), reason IS NULL ORDER BY {", ".join(_UPPERS)}, name) AS rk FROM c)
SELECT coalesce(reason, CASE WHEN rk > 1 THEN 'Profile name is taken' ELSE '' END) AS reason, count(*) AS profiles, sum(safe_upper) AS safe_sum,
  min(name) AS first_name FROM d GROUP BY 1"""
SQL["scan_gate"] = f"""WITH n AS ({SQL["url_normalize"]})
SELECT cast(page_id AS VARCHAR) AS scan_id,
  CASE WHEN error IS NOT NULL THEN 'rejected' WHEN warnings <> '' THEN 'partial' ELSE 'success' END AS prep_status,
  CASE WHEN error LIKE 'preprocessing_error: %' THEN concat('Preprocessing failed: ', substr(error, 22))
    WHEN error IS NOT NULL THEN concat('Invalid or rejected URL: ', error) END AS prep_error, warnings FROM n"""

_EXTRACT = lambda col: (
    "list_filter(list_transform(regexp_extract_all(" + col + ", '(?i)https?://[^\\s<>\"'']+'),"
    " lambda x: regexp_replace(x, '[.,;!)\\]}]+$', '')), lambda x: x <> '')")
_DISTINCT = lambda lst: f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"
SQL["url_extract"] = f"""WITH t AS ({v.view_sql(v.LINK_TEXT)}), e AS (SELECT doc_id, {_EXTRACT('text')} AS l FROM t)
SELECT doc_id, array_to_string({_DISTINCT('l')}, ' ') AS urls, l[1] AS first_url FROM e"""
SQL["url_extract_html"] = f"""WITH e AS (SELECT page_id, {_EXTRACT("concat(html, ' source ', url, '.')")} AS l FROM pages),
d AS (SELECT page_id, {_DISTINCT('l')} AS l FROM e)
SELECT page_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS link FROM d"""
_SCREEN = ("(?i)\\b(?:https?://[^\\s<>\"'']+|www\\d{0,3}\\.[^\\s<>\"'']+|\\b[a-zA-Z0-9.-]+\\.(?:"
           + "|".join(dims.SCREEN_TLDS) + ")(?:/[^\\s<>\"'']*)?)")
SQL["url_extract_screen"] = f"""WITH t AS ({v.view_sql(v.LINK_TEXT)}),
e AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all(text, '{_SCREEN}'),
    lambda x: regexp_replace(regexp_replace(x, '^[(\\[{{<"'']+', ''), '[.,)\\]}}!?;:"''>]+$', '')), lambda x: trim(x) <> ''),
    lambda x: CASE WHEN regexp_matches(x, '(?i)^https?://') THEN x ELSE concat('https://', x) END) AS l FROM t)
SELECT doc_id, array_to_string({_DISTINCT('l')}, ' ') AS urls FROM e"""
_REASON = "CASE flag " + " ".join(
    f"WHEN {_Q(k)} THEN {_Q(r)}" for k, r in dims.FLAG_REASONS.items()
) + f" ELSE CASE WHEN flag LIKE 'high_hyphen_count%' THEN {_Q(dims.REASON_HYPHENS)} END END"
SQL["url_flag_reasons"] = f"""WITH {_URL}, f AS (SELECT unnest(flags) AS flag FROM u)
SELECT flag, count(*) AS links, {_REASON} AS reason FROM f GROUP BY flag"""
# 44 points at itself, 40 and 49 end a chain, the target of 46 is unsafe
SQL["redirect_resolve"] = """WITH RECURSIVE p AS (SELECT page_id, substr(sha256(url), 1, 8) AS tag FROM pages),
l AS (SELECT a.page_id AS i, a.page_id % 50 <> 46 AS ok,
    CASE a.page_id % 50 WHEN 44 THEN a.page_id ELSE a.page_id + 1 END AS nxt
  FROM p a JOIN p b ON b.page_id = a.page_id + 1 WHERE a.page_id % 50 NOT IN (40, 49)),
r AS (SELECT page_id, page_id AS at_page, 0 AS hops, true AS ok FROM p
  UNION ALL SELECT page_id, nxt, hops + 1, r.ok AND l.ok FROM r JOIN l ON l.i = r.at_page WHERE hops < 60),
e AS (SELECT page_id, max(hops) AS n, arg_max(at_page, hops) AS at_page, bool_and(ok) AS ok,
    arg_max(at_page, hops) FILTER (WHERE hops <= 6) AS at_six, coalesce(bool_and(ok) FILTER (WHERE hops <= 5), true) AS ok_six FROM r GROUP BY 1)
SELECT e.page_id, concat('https://go.example.com/r/', f.page_id, '-', f.tag) AS final_url,
  CASE WHEN e.ok_six AND e.at_six % 50 = 47 AND e.page_id <> e.at_six AND e.n >= 6
      THEN concat('https://u:p@go.example.com/r/', g.page_id, '-', g.tag)
    ELSE concat('https://go.example.com/r/', g.page_id, '-', g.tag) END AS after_six
FROM e JOIN p f ON f.page_id = CASE WHEN e.ok AND e.n < 60 THEN e.at_page ELSE e.page_id END
JOIN p g ON g.page_id = CASE WHEN e.ok_six THEN e.at_six ELSE e.page_id END"""
_A = lambda i: f"string_split(address, '.')[{i}]::INT"
SQL["public_address"] = f"""WITH a AS (SELECT event_id, concat_ws('.', event_id % 256, (event_id * 7) % 256, user_id % 256, 1) AS address FROM events)
SELECT event_id, NOT ({_A(1)} IN (0, 10, 127) OR {_A(1)} >= 224 OR ({_A(1)} = 100 AND {_A(2)} BETWEEN 64 AND 127)
  OR ({_A(1)} = 169 AND {_A(2)} = 254) OR ({_A(1)} = 172 AND {_A(2)} BETWEEN 16 AND 31)
  OR ({_A(1)} = 192 AND {_A(2)} = 0 AND {_A(3)} IN (0, 2)) OR ({_A(1)} = 192 AND {_A(2)} = 168)
  OR ({_A(1)} = 198 AND {_A(2)} IN (18, 19)) OR ({_A(1)} = 198 AND {_A(2)} = 51 AND {_A(3)} = 100)
  OR ({_A(1)} = 203 AND {_A(2)} = 0 AND {_A(3)} = 113)) AS is_public FROM a"""

# blocks by the bits of the digits the texts are made from; equal blocks: the least text
_PAGE_ADDRESSES = v.page_addresses(lambda e: f"concat('0x', {e})::INT")
SQL["address_blocks"] = f"""WITH a AS ({_PAGE_ADDRESSES}),
n AS (SELECT *, CASE WHEN address LIKE 'x%' THEN NULL WHEN address LIKE '%.%' THEN substr(h, 9, 8)
    WHEN substr(h, 32, 1) < 'd' THEN concat(substr(h, 1, 8), repeat('0', 16), substr(h, 9, 8))
    ELSE concat('20010', substr(h, 6, 3), repeat('0', 16), substr(h, 9, 8)) END AS num FROM a),
b AS (SELECT *, substr(num, 5, 4) AS g, ('0x' || substr(num, 1, 2))::INT AS o1, ('0x' || substr(num, 3, 2))::INT AS o2, ('0x' || substr(num, 5, 2))::INT AS o3,
    array_to_string(list_transform(string_split(num, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits FROM n),
k AS (SELECT length(bits) AS w, len, left(bits, len) AS pre, min(cidr) AS cidr, min(struct_pack(c := cidr, o := concat('p', page_id))).o AS owner
  FROM (SELECT *, {v.BLOCK_BITS} AS len, concat(address, '/', {v.BLOCK_BITS}) AS cidr FROM b WHERE page_id % 20 = 0 AND bits IS NOT NULL) GROUP BY 1, 2, 3),
f AS (SELECT b.page_id, arg_max(k.cidr, k.len) AS cidr, arg_max(k.owner, k.len) AS owner
  FROM b JOIN k ON k.w = length(b.bits) AND k.pre = left(b.bits, k.len) GROUP BY 1)
SELECT b.page_id, CASE WHEN num IS NULL THEN false
    WHEN length(num) = 8 THEN NOT (o1 IN (0, 10, 127) OR o1 >= 224 OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254)
      OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 0 AND o3 IN (0, 2)) OR (o1 = 192 AND o2 = 168) OR (o1 = 198 AND o2 IN (18, 19))
      OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113))
    WHEN num LIKE '2001%' THEN (g >= '0200' AND g <> '0db8') OR g = '0003' OR g BETWEEN '0020' AND '003f'
    WHEN num LIKE '2002%' OR num LIKE '3fff0%' THEN false
    ELSE left(bits, 3) = '001' OR left(bits, 10) = '1111111011' END AS is_public, f.cidr, f.owner
FROM b LEFT JOIN f USING (page_id)"""

# ------------------------------------------------------------------ texts
_HITS = {
    c: "list_concat(" + ", ".join(f"regexp_extract_all(low, {_Q(p)}, 1)" for p in [*ps, *([] if len(ps) > 1 else [])])
    + (", []::VARCHAR[])" if len(ps) == 1 else ")")
    for c, ps in dims.TEXT_CATEGORIES.items()
}
_ANY = lambda x, ws: "(" + " OR ".join(f"contains({x}, {_Q(w)})" for w in ws) + ")"
_TEXT = f"""x0 AS ({v.view_sql(v.TEXT)}), x1 AS (SELECT *, lower(text) AS low FROM x0),
x2 AS (SELECT *, regexp_matches(low, {_Q(dims.OTP_DISCLAIMER)}) AS notice,
  {", ".join(f"{e} AS h_{c}" for c, e in _HITS.items())} FROM x1),
x3 AS (SELECT * REPLACE (CASE WHEN notice THEN list_filter(h_credential_request,
  lambda m: NOT ({_ANY('m', dims.OTP_WORDS)} AND {_ANY('m', dims.OTP_VERBS)})) ELSE h_credential_request END
  AS h_credential_request) FROM x2),
x AS (SELECT doc_id, least(0.35 * ({" + ".join(f"(len(h_{c}) > 0)::INT" for c in _HITS)}), 1.0) * 100 AS score,
  list_sort({_flags([(f"nlp_{c}", f"len(h_{c}) > 0") for c in _HITS])}) AS flags,
  list_sort(list_distinct(list_concat(list_concat(list_concat(h_urgency, h_credential_request),
    list_concat(h_account_suspension, h_prize_lottery)), h_unusual_payment))) AS phrases FROM x3)"""
SQL["text_signals"] = f"""WITH {_TEXT} SELECT doc_id, round(score, 4)::DOUBLE AS text_score,
  array_to_string(flags, ',') AS flags, array_to_string(phrases, ',') AS phrases FROM x"""
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _re(value: str, *pairs: tuple[str, str]) -> str:
    """Nested global replacements."""
    for pattern, new in pairs:
        value = "regexp_replace({}, '{}', '{}', 'g')".format(value, pattern.replace("'", "''"), new)
    return value


_CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_BLANKS = r"[ \t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NEWLINE = chr(10)
# the texts hold no character whose NFKC and NFC forms differ
_NORMAL = _re("nfc_normalize(text)", (_CONTROLS, ""), (r"\r\n?", _NEWLINE), (_BLANKS, " "), (r" ?\n ?", _NEWLINE),
              (r"\n{3,}", _NEWLINE * 2), (r"^[ \n]+|[ \n]+$", ""))
SQL["text_normalize"] = f"""SELECT doc_id, nullif({_NORMAL}, '') AS text,
  CASE WHEN regexp_matches(text, '{_CONTROLS}') THEN 'control_characters_stripped' ELSE '' END AS warnings FROM ({v.view_sql(v.TEXT)})"""
# no look-around here: the mark of a code and the ends of a number are matched with it
_SECRET = (r"(?i)\b(password|passcode|otp|one[- ]time code|verification code|login code|security code|auth(?:entication)? code"
           r"|pin|cvv|cvc|token|api key)\b\s*(?:(?:is\s+|[:=]\s*)[^\s,;]+|\s*\d{3}[^\s,;]*)")
_PHONE = (r"(^|\W)\+?\d[\d ().-]{6,}\d($|\W)", r"\1[number]\2")
_TRIM = (f"^{_WS}+|{_WS}+$", "")
_REDACTED = _re("text", (_SECRET, r"\1: [redacted]"), (dims.REDACT_URL, "[link]"), (dims.REDACT_EMAIL, "[address]"), _PHONE, _PHONE,
                (dims.REDACT_TOKEN, "[redacted]"), (dims.REDACT_DIGITS, "[number]"), (r"[\x00-\x08\x0b-\x1f]", ""), _TRIM)
SQL["redact_text"] = f"SELECT doc_id, {_REDACTED} AS redacted FROM ({v.view_sql(v.LINK_TEXT)})"
SQL["mostly_redacted"] = f"""SELECT doc_id, length(trimmed) = 0 OR length(left_over) < length(trimmed) * 0.5 AS mostly FROM (
  SELECT doc_id, {_re("text", _TRIM)} AS trimmed, {_re(_REDACTED, (r"\[(?:redacted|link|address|number)\]", ""), _TRIM)} AS left_over
  FROM ({v.view_sql(v.LINK_TEXT)}))"""
_REF = "(?i)&(#x[0-9a-f]+|#[0-9]+|amp|lt|gt|quot|apos|nbsp);"
_LINK = r"""(?is)<a\b[^>]*href\s*=\s*(?:"(.*?)"|'(.*?)')[^>]*>(.*?)</a>"""
_STRIPPED = _re("html", (r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " "), (_LINK, r"\3 \1\2"),
                (r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])\s*>", _NEWLINE), (r"(?s)<[^>]*>", " "))
_CHAR = """CASE lower(z[2]) WHEN '' THEN '' WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '"'
  WHEN 'apos' THEN chr(39) WHEN 'nbsp' THEN ' '
  ELSE chr(CASE WHEN lower(z[2]) LIKE '#x%' THEN concat('0x', substr(z[2], 3)) ELSE substr(z[2], 2) END::INT) END"""
SQL["html_to_text"] = f"""SELECT page_id, {_re("t", (r"[\t\r ]+", " "), (r" *\n *", _NEWLINE), _TRIM)} AS text FROM (
  SELECT page_id, array_to_string(list_transform(list_zip(string_split_regex(s, '{_REF}'),
    list_append(regexp_extract_all(s, '{_REF}', 1), '')), lambda z: concat(z[1], {_CHAR})), '') AS t
  FROM (SELECT page_id, {_STRIPPED} AS s FROM pages))"""
SQL["safe_keys"] = """SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.()\\-]', '_', 'g') AS key FROM pages"""
_R = [
    (dims.REDACT_SECRET.replace(r"\s*(?=\d{3,})", r"\s*").replace(r"|\s*)[^", r")[^"), "\\1: [redacted]"),
    (dims.REDACT_URL, "[link]"), (dims.REDACT_EMAIL, "[address]"),
]
SQL["screen_text"] = f"""WITH s AS ({v.view_sql(v.SCREEN)}), t AS (SELECT *,
  regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS tr FROM s)
SELECT conv_id, turn, CASE WHEN length(tr) > 0 AND {_ANY('lower(text)', dims.SCREEN_PHRASES)}
  THEN tr END AS snippet FROM t"""

# ------------------------------------------------------------------ headers
_E = lambda c: f"lower(trim(CASE WHEN regexp_matches({c}, '<[^>]+>') THEN regexp_extract({c}, '<([^>]+)>', 1) ELSE {c} END))"
_D = lambda c: f"regexp_extract({_E(c)}, '([^@]*)$', 1)"
SQL["header_signals"] = f"""WITH h AS ({v.view_sql(v.HEADERS)}),
a AS (SELECT *, h_reply_to IS NOT NULL AND {_E('h_reply_to')} <> {_E('h_from')} AS rep,
  h_reply_to IS NOT NULL AND {_D('h_reply_to')} <> {_D('h_from')} AS repd,
  h_return_path IS NOT NULL AND {_D('h_return_path')} <> {_D('h_from')} AS ret,
  lower(h_spf) IN {_IN(dims.SPF_FAIL)} AS spf, coalesce(contains(h_auth, 'dkim'), false) AS dkim,
  coalesce(contains(h_auth, 'dmarc'), false) AS dmarc,
  h_message_id IS NULL OR trim(h_message_id) = '' OR {_D('h_message_id')} <> {_D('h_from')} AS mid,
  contains(h_received, 'forged') AS rec FROM h)
SELECT scan_id, round(least(CASE WHEN repd THEN 0.3 WHEN rep THEN 0.1 ELSE 0 END + CASE WHEN ret THEN 0.3 ELSE 0 END
  + CASE WHEN spf OR dkim OR dmarc THEN 0.4 ELSE 0 END + CASE WHEN mid THEN 0.1 ELSE 0 END
  + CASE WHEN rec THEN 0.3 ELSE 0 END, 0.9) * 100, 4)::DOUBLE AS header_score,
  array_to_string(list_sort({_flags([
      ("REPLY_TO_MISMATCH", "rep"), ("RETURN_PATH_MISMATCH", "ret"), ("SPF_FAILURE", "spf"),
      ("DKIM_FAILURE", "dkim"), ("DMARC_FAILURE", "dmarc"),
      ("AUTHENTICATION_FAILURE", "spf OR dkim OR dmarc"), ("MESSAGE_ID_ANOMALY", "mid"),
      ("RECEIVED_CHAIN_ANOMALY", "rec")])}), ',') AS flags FROM a"""

# ------------------------------------------------------------------ senders
_PARSED = lambda c: f"""m0 AS ({v.messages_sql(c)}), m AS (SELECT *,
  lower(regexp_extract(sender_raw, '<([^>]+)>', 1)) AS k, lower(trim(regexp_extract(sender_raw, '^(.*)<', 1))) AS nm,
  (t_us // 3600000000) % 24 AS hr, row_number() OVER (PARTITION BY client_id, sender_raw ORDER BY arrival_seq) AS rn FROM m0)"""  # noqa: E731
_ANCHOR = """r AS (SELECT client_id, k, arrival_seq, rn, t_us AS w, 1 AS cnt FROM m WHERE rn = 1
  UNION ALL SELECT m.client_id, m.k, m.arrival_seq, m.rn,
    CASE WHEN m.t_us - r.w > 3600000000 THEN m.t_us ELSE r.w END,
    CASE WHEN m.t_us - r.w > 3600000000 THEN 1 ELSE r.cnt + 1 END
  FROM r JOIN m ON m.client_id = r.client_id AND m.k = r.k AND m.rn = r.rn + 1)"""
_PRIOR = """w AS (SELECT m.*, r.cnt, r.w,
  max(t_us) OVER p AS last_t, count(*) OVER p AS n, sum(has_link::INT) OVER p AS links, sum(has_file::INT) OVER p AS files,
  lag(sender_domain) OVER (PARTITION BY m.client_id, m.k ORDER BY m.arrival_seq) AS pd,
  count(*) OVER (PARTITION BY m.client_id, m.k, hr ORDER BY m.arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_hour,
  first_value(sender_domain) OVER (PARTITION BY m.client_id, nm ORDER BY m.arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nd
  FROM m JOIN r USING (arrival_seq)
  WINDOW p AS (PARTITION BY m.client_id, m.k ORDER BY m.arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, n = 0 AS f_new, n > 0 AND last_t > 0 AND t_us - last_t < 60000000 AS f_rapid, n > 5 AND cnt > 10 AS f_freq,
  n > 5 AND same_hour = 0 AS f_time, n > 0 AND pd <> sender_domain AS f_dom, coalesce(has_link AND links = 0 AND n > 3, false) AS f_link,
  coalesce(has_file AND files = 0 AND n > 3, false) AS f_file, coalesce(nd <> sender_domain, false) AS f_name FROM w)"""
_SENDER_FLAGS = _flags([
    ("new_sender", "f_new"), ("rapid_sender_activity", "f_rapid"), ("unusual_frequency", "f_freq"),
    ("unusual_time", "f_time"), ("sender_change", "f_dom OR f_name"),
    ("out_of_character_link", "f_link"), ("out_of_character_file", "f_file")])
_SENDER_SCORE = """round(least(CASE WHEN f_new THEN 0.2 ELSE 0 END + CASE WHEN f_rapid THEN 0.3 ELSE 0 END
  + CASE WHEN f_freq THEN 0.2 ELSE 0 END + CASE WHEN f_time THEN 0.2 ELSE 0 END
  + CASE WHEN f_dom OR f_name THEN 0.4 ELSE 0 END + CASE WHEN f_link THEN 0.3 ELSE 0 END
  + CASE WHEN f_file THEN 0.3 ELSE 0 END, 1.0) * 100, 4)::DOUBLE AS sender_score"""
SQL["sender_rules"] = f"""WITH RECURSIVE {_PARSED(True)}, {_ANCHOR}, {_PRIOR}
SELECT arrival_seq, {_SENDER_SCORE}, CASE WHEN f_new THEN 0.5 ELSE 0.8 END::DOUBLE AS sender_confidence,
  array_to_string(list_sort({_SENDER_FLAGS}), ',') AS flags FROM f"""
SQL["sender_handover"] = f"""WITH RECURSIVE {_PARSED(True)}, {_ANCHOR}, {_PRIOR}
SELECT arrival_seq, {_SENDER_SCORE}, cnt::BIGINT AS recent_count, w::BIGINT AS recent_start_us,
  array_to_string(list_sort({_SENDER_FLAGS}), ',') AS flags FROM f WHERE arrival_seq >= (SELECT max(event_id) // 2 FROM events)"""
SQL["sender_odd_hour"] = f"""WITH {_PARSED(False)}, c AS (SELECT arrival_seq,
  count(*) OVER (PARTITION BY client_id, k ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
  count(*) OVER (PARTITION BY client_id, k, hr ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM m)
SELECT arrival_seq, n > 5 AND same = 0 AS odd FROM c"""
SQL["sender_anchored_hour"] = f"""WITH RECURSIVE {_PARSED(True)}, {_ANCHOR}
SELECT arrival_seq, cnt::BIGINT AS recent_count, w::BIGINT AS recent_start_us FROM r"""
SQL["sender_snapshot"] = f"""WITH RECURSIVE {_PARSED(True)}, {_ANCHOR},
b AS (SELECT client_id, k, lpad(hr::VARCHAR, 2, '0') AS h, count(*) AS c FROM m GROUP BY ALL),
bb AS (SELECT client_id, k, string_agg(concat(h, '=', c), ',' ORDER BY h) AS time_buckets FROM b GROUP BY ALL)
SELECT m.client_id, m.k AS profile_key, count(*) AS message_count, sum(has_link::INT)::BIGINT AS link_count,
  sum(has_file::INT)::BIGINT AS file_count, arg_min(t_us, m.arrival_seq) AS first_seen_us, max(t_us) AS last_seen_us,
  any_value(time_buckets) AS time_buckets, arg_max(sender_domain, m.arrival_seq) AS last_domain,
  arg_max(cnt, m.arrival_seq)::BIGINT AS recent_count, arg_max(w, m.arrival_seq)::BIGINT AS recent_window_start_us
FROM m JOIN r USING (arrival_seq) JOIN bb ON bb.client_id = m.client_id AND bb.k = m.k GROUP BY m.client_id, m.k"""
SQL["sender_names"] = f"""WITH {_PARSED(True)} SELECT client_id, nm AS display_name,
  arg_min(sender_domain, arrival_seq) AS last_domain, arg_max(k, arrival_seq) AS last_email, max(t_us) AS last_seen_us,
  count(*) AS count FROM m GROUP BY client_id, nm"""
SQL["sender_state_fold"] = f"""SELECT client_id, profile_key AS name, message_count AS count, last_seen_us, last_domain,
  concat_ws('|', link_count, file_count, first_seen_us, recent_count, recent_window_start_us, time_buckets) AS more
FROM ({SQL["sender_snapshot"]}) UNION ALL
SELECT client_id, display_name, count, last_seen_us, last_domain, last_email FROM ({SQL["sender_names"]})"""
SQL["sender_evict"] = f"""WITH {_PARSED(True)}, p AS (SELECT client_id, sender_raw, max(t_us) AS last_seen_us FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY last_seen_us, client_id, sender_raw) AS rk, count(*) OVER () AS n FROM p)
SELECT client_id, sender_raw, last_seen_us FROM o WHERE n <= 100 OR rk > 20"""

# ------------------------------------------------------------------ files
SQL["hash_match"] = """WITH f AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 50 = 3)
SELECT doc_id, sha256(text) AS sha256, CASE WHEN h IS NOT NULL THEN 100.0 ELSE 0.0 END::DOUBLE AS risk_score,
  CASE WHEN h IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN h IS NOT NULL THEN 'success' ELSE 'error' END AS status,
  CASE WHEN h IS NOT NULL THEN 'MALWARE,malware_detected,malwarebazaar_verified,threat_family:Test.Family' ELSE '' END AS flags
FROM documents LEFT JOIN f ON sha256(text) = f.h"""
SQL["file_reports"] = f"""WITH r AS (SELECT DISTINCT sha256(text) AS h, length(text) % 5 AS bad, length(text) % 3 AS odd
  FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN h IS NULL THEN 0.0 ELSE round((bad + odd) / (bad + odd + 50) * 100, 4) END::DOUBLE AS risk_score,
  CASE WHEN h IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN h IS NULL THEN 'error' ELSE 'success' END AS status,
  array_to_string({_flags([("vt_malicious", "bad > 0"), ("vt_suspicious", "odd > 0")])}, ',') AS flags
FROM documents LEFT JOIN r ON sha256(text) = r.h"""
_EXT_IN = lambda names, ext="ext": f"{ext} IN (" + ", ".join(f"'{n}'" for n in names) + ")"
_PAYLOAD = _EXT_IN([e for e in dims.DANGEROUS_EXT if e not in dims.ARCHIVE_EXT])
_FINDING = lambda cond, key, value, runs="NULL": f"CASE WHEN {cond} THEN {{'key': '{key}', 'value': {value}, 'runs': {runs}}} END"
_RUNS = f"CASE WHEN {_EXT_IN(dims.EXECUTABLE_EXT)} THEN 'EXECUTABLE_ATTACHMENT' ELSE 'SCRIPT_ATTACHMENT' END"
_ARCHIVE_FLAG = {
    "SUSPICIOUS_ARCHIVE": "bool_or(key IN ('archive_path_traversal', 'archive_encrypted_entry', 'archive_contained_double_extension', 'archive_contained_payload',"
    " 'nested_archive_payload', 'archive_single_payload_dropper', 'archive_entry_limit_exceeded'))",
    "ARCHIVE_DEPTH_ANOMALY": "bool_or(key = 'archive_depth_anomaly')", "NESTED_ARCHIVE": "bool_or(key = 'nested_archive')",
    "DOUBLE_EXTENSION": "bool_or(key = 'archive_contained_double_extension')", "ARCHIVE_EXPANSION_ANOMALY": "bool_or(key = 'archive_expansion_anomaly')",
    "EXECUTABLE_ATTACHMENT": "bool_or(coalesce(runs, '') = 'EXECUTABLE_ATTACHMENT')", "SCRIPT_ATTACHMENT": "bool_or(coalesce(runs, '') = 'SCRIPT_ATTACHMENT')",
}
SQL["archive_rules"] = f"""WITH RECURSIVE e AS (SELECT *, regexp_extract(name, '[^/\\\\]*$') AS base, lower(regexp_extract(name, '[^./\\\\]*$')) AS ext,
  len(regexp_extract_all(name, '[/\\\\]')) + 1 AS steps FROM ({v.ENTRIES_SQL})),
lv AS (SELECT file_id, entry_id, 1 AS level FROM e WHERE parent_id IS NULL
  UNION ALL SELECT e.file_id, e.entry_id, lv.level + 1 FROM lv JOIN e ON e.file_id = lv.file_id AND e.parent_id = lv.entry_id),
st AS (SELECT file_id, parent_id, min(entry_id) AS stop FROM e WHERE parent_id IS NOT NULL AND {_EXT_IN(dims.ARCHIVE_EXT)} GROUP BY ALL),
x AS (SELECT e.*, lv.level, lv.level > 1 AND (stop IS NULL OR e.entry_id <= stop) AS seen
  FROM e JOIN lv USING (file_id, entry_id) LEFT JOIN st ON st.file_id = e.file_id AND st.parent_id = e.parent_id),
f AS (SELECT file_id, entry_id, unnest([
  {_FINDING("level = 1 AND name LIKE '../%'", "archive_path_traversal", "base")},
  {_FINDING("level = 1 AND encrypted", "archive_encrypted_entry", "base")},
  {_FINDING("level = 1 AND steps > 5", "archive_depth_anomaly", "concat('depth=', steps)")},
  {_FINDING("level = 1 AND regexp_matches(base, '[.](pdf|doc)[.](exe|iso)$')", "archive_contained_double_extension", "base")},
  {_FINDING("level = 1 AND " + _PAYLOAD, "archive_contained_payload", "concat(base, ' (.', ext, ')')", _RUNS)},
  {_FINDING("level = 1 AND " + _EXT_IN(dims.ARCHIVE_EXT), "nested_archive", "base")},
  {_FINDING("seen AND " + _EXT_IN(dims.ARCHIVE_EXT), "archive_depth_anomaly", "concat('nested_level_', level, ' (', base, ')')")},
  {_FINDING("seen AND " + _PAYLOAD, "nested_archive_payload", "base", _RUNS)}]) AS x FROM x),
s AS (SELECT file_id, bool_or(kind = 'tar') AS tar, count(*) AS n, sum(size)::BIGINT AS total, sum(packed)::BIGINT AS packed,
  count(*) FILTER (WHERE NOT is_dir) AS files, arg_min(base, entry_id) FILTER (WHERE NOT is_dir) AS only_one,
  arg_min(ext, entry_id) FILTER (WHERE NOT is_dir) AS ext FROM e WHERE parent_id IS NULL GROUP BY file_id),
w AS (SELECT file_id, NULL AS entry_id, unnest([
  {_FINDING("tar AND total > 52428800", "archive_expansion_anomaly", "concat('uncompressed=', total, 'B')")},
  {_FINDING("NOT tar AND (total > 52428800 OR (total > 1000000 AND total / greatest(packed, 1) > 50))", "archive_expansion_anomaly",
            "concat('ratio=', format('{:.1f}', total / greatest(packed, 1)), ':1, uncompressed=', total, 'B')")},
  {_FINDING("files = 1 AND " + _EXT_IN(dims.DANGEROUS_EXT) + " AND NOT (tar AND n > 40)", "archive_single_payload_dropper", "only_one")},
  {_FINDING("tar AND n > 40", "archive_entry_limit_exceeded", "'entries_exceeded>40'")}]) AS x FROM s),
a AS (SELECT file_id, entry_id, x.key AS key, x.value AS value, x.runs AS runs FROM (SELECT * FROM f UNION ALL SELECT * FROM w) WHERE x IS NOT NULL),
g AS (SELECT file_id, key, count(*) AS c, arg_min(value, coalesce(entry_id, 0)) AS value FROM a GROUP BY ALL),
gg AS (SELECT file_id, array_to_string(list_sort(list(concat(key, '=', c, ':', value))), '; ') AS findings FROM g GROUP BY file_id),
h AS (SELECT file_id, {", ".join(f"{c} AS {n}" for n, c in _ARCHIVE_FLAG.items())} FROM a GROUP BY file_id)
SELECT t.file_id, t.entries, coalesce(array_to_string(list_sort({_flags([(n, n) for n in _ARCHIVE_FLAG])}), ','), '') AS flags,
  least({" + ".join(f"CASE WHEN {n} THEN {dims.ATTACHMENT_WEIGHTS[n]} ELSE 0 END" for n in _ARCHIVE_FLAG)}, 85.0)::DOUBLE AS score,
  coalesce(findings, '') AS findings
FROM (SELECT file_id, count(*) AS entries FROM e GROUP BY file_id) t LEFT JOIN h USING (file_id) LEFT JOIN gg USING (file_id)"""
_FILE = {  # doc_id % 16 -> type, flags
    0: ("document/pdf", []), 1: ("executable/pe", ["DOUBLE_EXTENSION", "EXECUTABLE_ATTACHMENT", "SUSPICIOUS_FILENAME"]),
    2: ("unknown", []), 3: ("unknown", ["SCRIPT_ATTACHMENT", "SUSPICIOUS_FILENAME"]), 4: ("unknown", ["MACRO_PRESENT"]),
    5: ("executable/pe", ["ATTACHMENT_TYPE_MISMATCH", "EXECUTABLE_ATTACHMENT"]), 6: ("document/html", ["EMBEDDED_SCRIPT"]),
    7: ("document/rtf", ["EMBEDDED_SCRIPT"]), 8: ("unknown", []),
    9: ("unknown", ["EXECUTABLE_ATTACHMENT", "SUSPICIOUS_EXTENSION", "SUSPICIOUS_FILENAME"]), 10: ("unknown", []),
    11: ("script/shebang", ["SCRIPT_ATTACHMENT"]),
    12: ("unknown", ["DOUBLE_EXTENSION", "EXECUTABLE_ATTACHMENT", "SUSPICIOUS_EXTENSION"]),
    13: ("unknown", ["EXECUTABLE_ATTACHMENT"]), 14: ("document/pdf", ["EMBEDDED_SCRIPT"]), 15: ("unknown", []),
}
_CASE16 = lambda f: "CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN {f(t, fl)}" for k, (t, fl) in _FILE.items()) + " END"
SQL["attachment_rules"] = f"""SELECT doc_id, {_CASE16(lambda t, fl: _Q(t))} AS att_type,
  {_CASE16(lambda t, fl: min(sum(dims.ATTACHMENT_WEIGHTS[x] for x in fl), 85.0))}::DOUBLE AS att_score,
  {_CASE16(lambda t, fl: 1.0 if not fl else 0.95 if set(fl) & set(dims.STRONG_ATTACHMENT_FLAGS) else 0.85)}::DOUBLE AS att_confidence,
  {_CASE16(lambda t, fl: _Q(",".join(fl)))} AS flags FROM documents"""
SQL["file_type_check"] = """SELECT doc_id, CASE doc_id % 16 WHEN 0 THEN 'pdf' WHEN 14 THEN 'pdf' WHEN 1 THEN 'exe' WHEN 5 THEN 'exe'
  WHEN 7 THEN 'rtf' ELSE 'unknown' END AS actual_ext, doc_id % 16 = 5 AS mismatch FROM documents"""
SQL["payload_decode"] = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 <> 1 THEN sha256(text) END AS sha256,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 1 THEN 'must be base64-encoded when sent as a string.' END AS error FROM documents"""
SQL["visual_rules"] = f"""WITH a AS (SELECT doc_id, doc_id % 11 <> 0 AS ok, CASE doc_id % 4 WHEN 0 THEN concat('https://qr.example.com/', doc_id)
   WHEN 1 THEN 'plain code' END AS qr, CASE doc_id % 3 WHEN 0 THEN 'Sign in with your password' WHEN 1 THEN concat('hello ', doc_id) END AS ocr,
   doc_id % 2 AS boxes FROM documents), b AS (SELECT *, ocr LIKE 'Sign%' AS cred FROM a)
SELECT doc_id, CASE WHEN NOT ok THEN 0.0 ELSE CASE WHEN qr IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN cred AND boxes > 0 THEN 60
   WHEN cred THEN 30 ELSE 0 END END::DOUBLE AS risk_score, CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
  CASE WHEN ok THEN array_to_string({_flags([("qr_code_detected", "qr IS NOT NULL"), ("ocr_text_extracted", "ocr IS NOT NULL"),
     ("visual_phishing_detected", "cred AND boxes > 0"), ("visual_credential_prompt", "cred AND boxes = 0")])}, ',') ELSE '' END AS flags,
  CASE WHEN ok THEN CASE WHEN qr = 'plain code' AND ocr IS NOT NULL THEN concat(qr, chr(10), ocr) WHEN qr = 'plain code' THEN qr ELSE ocr END END AS extracted_text,
  CASE WHEN ok AND qr LIKE 'https%' THEN qr END AS extracted_url FROM b"""

# ------------------------------------------------------------------ fusion
_TWO = f"""{_SCORED}, {_TEXT}, two AS (SELECT x.doc_id, x.score AS ts, x.flags AS tf, s.score AS us, s.conf AS uc, s.all_flags AS uf,
  s.status AS ust, CASE WHEN s.page_id IS NULL THEN 0 WHEN s.status = 'partial' THEN 0.45 ELSE 0.9 END AS ur
  FROM x LEFT JOIN s ON s.page_id = x.doc_id),
fz AS (SELECT *, round((ts * 0.65 * 0.8 + coalesce(us * uc * ur, 0)) / (0.65 * 0.8 + coalesce(uc * ur, 0)), 2)::DOUBLE AS risk_score,
  round(least(1.0, (0.65 * 0.8 + coalesce(uc * ur, 0)) / (0.8 + ur)), 4)::DOUBLE AS confidence,
  list_sort(list_distinct(list_concat(tf, coalesce(uf, []::VARCHAR[])))) AS flags FROM two)"""
_CLASS = lambda a, b, c, d: (
    f"CASE WHEN risk_score < {a} THEN 'Safe' WHEN risk_score < {b} THEN 'Suspicious'"
    f" WHEN risk_score < {c} THEN 'Deceptive' ELSE 'Phishing' END")
SQL["fuse_verdict"] = f"""WITH {_TWO} SELECT doc_id, risk_score, confidence, {_CLASS(20, 45, 70, 90)} AS classification,
  array_to_string(flags, ',') AS flags, CASE WHEN us IS NULL THEN 'nlp_engine' ELSE 'nlp_engine,url_engine' END AS used,
  CASE WHEN us IS NULL THEN 'malware_engine,url_engine' ELSE 'malware_engine' END AS ignored FROM fz"""
SQL["fuse_long"] = f"""WITH {_TWO} SELECT doc_id,
  round((ts * 0.65 * 0.8 + coalesce(us * uc * ur, 0) + (doc_id % 100) * 0.6 * 0.75) / (0.65 * 0.8 + coalesce(uc * ur, 0) + 0.45), 2)::DOUBLE AS risk_score,
  round(least(1.0, (0.65 * 0.8 + coalesce(uc * ur, 0) + 0.45) / (0.8 + ur + 0.75)), 4)::DOUBLE AS confidence FROM fz"""
SQL["verdict_by_profile"] = f"""WITH {_TWO}, p AS (SELECT ['default', ' STRICT ', 'enterprise', 'other'][doc_id % 4 + 1] AS profile, risk_score FROM fz)
SELECT profile, CASE trim(profile) WHEN 'STRICT' THEN {_CLASS(15, 35, 55, 80)} WHEN 'enterprise' THEN {_CLASS(10, 30, 50, 75)}
  ELSE {_CLASS(20, 45, 70, 90)} END AS classification, count(*) AS scans FROM p GROUP BY ALL"""
# every document as a full scan: link, text, header, sender and attachment results fused
_FULL = f"""{_TWO}, sc AS (SELECT d.doc_id, d.doc_id % 10 = 0 AS att, d.doc_id % 20 = 0 AS spf, s.page_id IS NOT NULL AS linked,
    (1704067200 + d.doc_id * 30) // 3600 % 24 AS hr, concat(d.doc_id % 3, '/', d.doc_id % 50) AS k FROM documents d LEFT JOIN s ON s.page_id = d.doc_id),
sn AS (SELECT *, count(*) OVER p AS n, coalesce(sum(linked::INT) OVER p, 0) AS links, coalesce(sum(att::INT) OVER p, 0) AS files,
    count(*) OVER (PARTITION BY k, hr ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same
  FROM sc WINDOW p AS (PARTITION BY k ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sf AS (SELECT *, n = 0 AS f_new, n > 5 AND same = 0 AS f_hour, linked AND links = 0 AND n > 3 AS f_link, att AND files = 0 AND n > 3 AS f_file FROM sn),
ew AS (SELECT two.*, sf.*, CASE WHEN att THEN 0.75 * 0.95 ELSE 0 END AS aw, CASE WHEN spf THEN 40 ELSE 0 END AS hs,
    CASE WHEN spf THEN 0.8 ELSE 1.0 END * 0.75 AS hw, CASE WHEN f_new THEN 0.5 ELSE 0.8 END * 0.6 AS sw,
    least(CASE WHEN f_new THEN 0.2 ELSE 0 END + CASE WHEN f_hour THEN 0.2 ELSE 0 END + CASE WHEN f_link THEN 0.3 ELSE 0 END
      + CASE WHEN f_file THEN 0.3 ELSE 0 END, 1.0) * 100 AS ss, coalesce(uc * ur, 0) AS uw FROM two JOIN sf USING (doc_id)),
fv AS (SELECT *, round((85 * aw + hs * hw + ts * 0.65 * 0.8 + ss * sw + coalesce(us, 0) * uw) / (aw + hw + 0.65 * 0.8 + sw + uw), 2)::DOUBLE AS risk_score,
    round(least(1.0, (aw + hw + 0.65 * 0.8 + sw + uw) / (CASE WHEN att THEN 0.75 ELSE 0 END + 0.75 + 0.8 + 0.6 + ur)), 4)::DOUBLE AS confidence,
    list_sort(list_distinct(list_concat(list_concat(tf, coalesce(uf, []::VARCHAR[])), {_flags([
        ("DOUBLE_EXTENSION", "att"), ("EXECUTABLE_ATTACHMENT", "att"), ("SUSPICIOUS_FILENAME", "att"), ("SPF_FAILURE", "spf"),
        ("AUTHENTICATION_FAILURE", "spf"), ("new_sender", "f_new"), ("unusual_time", "f_hour"), ("out_of_character_link", "f_link"),
        ("out_of_character_file", "f_file")])}))) AS fl FROM ew)"""
SQL["scan_assessments"] = f"""WITH {_FULL}, v AS (SELECT *, {_CLASS(20, 45, 70, 90)} AS cls FROM fv)
SELECT concat('00000000-0000-4000-8000-', lpad(doc_id::VARCHAR, 12, '0')) AS scan_id, risk_score, cls AS classification, confidence,
  CASE cls WHEN 'Safe' THEN {_Q(dims.ACTION_NO_MALWARE_SCAN)} {" ".join(f"WHEN {_Q(k)} THEN {_Q(a)}" for k, a in dims.ACTIONS.items() if k != "Safe")} END
    AS recommended_action, array_to_string(fl, ',') AS flags, 7::BIGINT AS total_engines,
  (CASE WHEN att THEN 1 ELSE 3 END + CASE WHEN linked THEN 0 ELSE 1 END)::BIGINT AS skipped_engines,
  array_to_string(list_sort({_flags([("attachment_behavior_engine", "att"), ("header_analysis_engine", "true"), ("nlp_engine", "true"),
                                     ("sender_engine", "true"), ("url_engine", "linked")])}), ',') AS used,
  CASE WHEN att THEN 'malware scan unavailable: VIRUSTOTAL_API_KEY_NOT_CONFIGURED' ELSE '' END AS warnings FROM v"""
SQL["verdict_counts"] = f"""WITH {_SCORED}, z AS (SELECT round(score, 2) AS risk_score FROM s)
SELECT {_CLASS(20, 45, 70, 90)} AS classification, count(*) AS links, round(avg(risk_score), 4)::DOUBLE AS mean_score FROM z GROUP BY 1"""
_NLP_REASON = lambda f: f"concat('Natural language processing found signs of ', replace(replace({f}, 'nlp_', ''), '_', ' '), '.')"
SQL["explain_reasons"] = f"""WITH {_TEXT}, z AS (SELECT doc_id, round(score, 2) AS risk_score, flags FROM x),
c AS (SELECT *, {_CLASS(20, 45, 70, 90)} AS cls FROM z)
SELECT doc_id, array_to_string(list_concat(list_concat(list_transform(flags, lambda f: {_NLP_REASON('f')}),
    list_transform(list_filter({_LIST(list(dims.TEXT_CATEGORIES))}, lambda k: list_contains(flags, concat('nlp_', k))),
      lambda k: concat(replace(k, '_', '-'), ' language was detected.'))), [{_Q(dims.REASON_NO_MALWARE_SCAN)}]), ' | ') AS reasons,
  CASE cls WHEN 'Safe' THEN {_Q(dims.ACTION_NO_MALWARE_SCAN)} {" ".join(f"WHEN {_Q(k)} THEN {_Q(a)}" for k, a in dims.ACTIONS.items() if k != "Safe")} END
    AS recommended_action FROM c"""

# ------------------------------------------------------------------ triage
_TLDS = "|".join(dims.TRIAGE_TLDS)
_TRIAGE = f"""u0 AS ({v.view_sql(v.SCAN_URLS)}), d0 AS ({v.view_sql(v.TEXT)}),
t0 AS (SELECT page_id, url, text FROM u0 LEFT JOIN d0 ON doc_id = page_id),
t1 AS (SELECT *, {_HOST} AS host, list_filter({_LIST(dims.TRIAGE_URL_WORDS)}, lambda w: contains(lower(url), w)) AS words,
  len(list_filter({_LIST(dims.TRIAGE_URGENCY)}, lambda w: contains(lower(text), w))) AS nu,
  len(list_filter({_LIST(dims.TRIAGE_HARVEST)}, lambda w: contains(lower(text), w))) AS nh_ FROM t0),
t2 AS (SELECT *, regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') AS ip, contains(url, '@') AS at_sign, url LIKE 'http:%' AS http,
  regexp_matches(lower(host), '\\.({_TLDS})$') AS tld, length(host) - length(replace(host, '.', '')) AS dots,
  list_sum(list_transform(list_distinct(string_split(host, '')), lambda c: -((length(host) - length(replace(host, c, ''))) / length(host))
      * log2((length(host) - length(replace(host, c, ''))) / length(host)))) AS ent,
  length(regexp_replace(host, '[^0-9]', '', 'g')) / length(host) AS dr FROM t1),
t3 AS (SELECT *, least(100, CASE WHEN ip THEN 35 ELSE 0 END + CASE WHEN at_sign THEN 30 ELSE 0 END + CASE WHEN http THEN 10 ELSE 0 END
  + CASE WHEN tld THEN 25 ELSE 0 END + least(35, len(words) * 10) + CASE WHEN dots >= 3 AND NOT ip THEN 20 ELSE 0 END
  + CASE WHEN ent > 4.0 THEN 15 ELSE 0 END + CASE WHEN dr > 0.25 AND NOT ip THEN 15 ELSE 0 END) AS us,
  CASE WHEN nu > 0 THEN least(40, 25 + nu * 10) ELSE 0 END + CASE WHEN nh_ > 0 THEN least(40, 30 + nh_ * 10) ELSE 0 END AS ts,
  {_flags([("ip_based_host", "ip"), ("at_symbol_present", "at_sign"), ("http_without_https", "http"), ("suspicious_tld", "tld"),
           ("suspicious_keywords", "len(words) > 0"), ("subdomain_depth_anomaly", "dots >= 3 AND NOT ip"),
           ("high_shannon_entropy", "ent > 4.0"), ("high_digit_ratio", "dr > 0.25 AND NOT ip"),
           ("urgency_and_fear_cues", "nu > 0"), ("credential_harvesting_intent", "nh_ > 0")])} AS flags FROM t2)"""
_TCLASS = "CASE WHEN risk_score >= 80 THEN 'Phishing' WHEN risk_score >= 50 THEN 'Deceptive' WHEN risk_score >= 25 THEN 'Suspicious' ELSE 'Safe' END"
SQL["triage_verdict"] = f"""WITH {_TRIAGE}, t4 AS (SELECT *, least(100, greatest(us, ts) + CASE WHEN us >= 40 AND ts >= 40 THEN 15 ELSE 0 END)::DOUBLE AS risk_score FROM t3)
SELECT page_id, risk_score, {_TCLASS} AS classification, array_to_string(flags, ',') AS flags FROM t4"""
_SCANS = f"""SELECT concat('00000000-0000-4000-8000-', lpad(d.doc_id::VARCHAR, 12, '0')) AS scan_id, d.doc_id, 1704067200 + d.doc_id * 30 AS sec,
  d.text, u.url FROM ({v.view_sql(v.TEXT)}) d LEFT JOIN ({v.view_sql(v.SCAN_URLS)}) u ON u.page_id = d.doc_id"""
_FIRST_LINK = "regexp_extract(text, '(?i)https?://[^\\s<>\"'']+')"
SQL["history_records"] = "WITH " + _TRIAGE.replace(
    "t0 AS (SELECT page_id, url, text FROM u0 LEFT JOIN d0 ON doc_id = page_id)",
    f"t0 AS (SELECT scan_id, sec, coalesce(url, nullif(regexp_replace({_FIRST_LINK}, '[.,;!)\\]}}]+$', ''), '')) AS url, text FROM ({_SCANS}))",
) + f""", t4 AS (SELECT *, least(100, greatest(coalesce(us, 0), ts) + CASE WHEN us >= 40 AND ts >= 40 THEN 15 ELSE 0 END)::DOUBLE AS risk_score FROM t3)
SELECT scan_id, (sec * 1000)::BIGINT AS timestamp_millis, 'gmail' AS source_type, {_TCLASS} AS classification, risk_score,
  array_to_string(flags, ',') AS flags FROM t4"""
SQL["verdict_with_fallback"] = f"""WITH {_TRIAGE}, t4 AS (SELECT page_id, us::DOUBLE AS risk_score FROM t3),
t5 AS (SELECT page_id, risk_score, {_TCLASS} AS cls, page_id % 3 = 0 AND page_id % 30 <> 0 AS full_one FROM t4)
SELECT page_id, CASE WHEN full_one THEN (page_id % 100)::DOUBLE ELSE risk_score END AS risk_score,
  CASE WHEN full_one THEN 'Deceptive' ELSE cls END AS classification, NOT full_one AS is_fallback FROM t5"""

# ------------------------------------------------------------------ feedback and history
_VOTES = f"""fb AS ({v.FEEDBACK_SQL}), fw AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY arrival_seq) AS rk FROM fb) WHERE rk = 1),
g AS (SELECT *, CASE WHEN source_type IN {_IN(dims.FEEDBACK_SOURCES)} THEN source_type ELSE 'unknown' END AS src FROM fw WHERE user_feedback IS NOT NULL)"""
SQL["feedback_first_wins"] = f"WITH {_VOTES} SELECT * EXCLUDE (confidence_at_scan_time) FROM fw"
SQL["feedback_validate"] = f"""WITH {_VOTES} SELECT CASE WHEN user_feedback IS NULL THEN 'user_feedback' ELSE 'source_type' END AS reason, count(*) AS votes
FROM fb WHERE user_feedback IS NULL OR source_type = 'sms' GROUP BY 1"""
SQL["feedback_inserted"] = f"""WITH {_VOTES}, st AS (SELECT DISTINCT scan_id FROM fb WHERE arrival_seq % 10 = 0)
SELECT fb.arrival_seq, fw.arrival_seq IS NOT NULL AND st.scan_id IS NULL AS inserted FROM fb LEFT JOIN fw USING (arrival_seq) LEFT JOIN st ON st.scan_id = fb.scan_id"""
SQL["feedback_metrics"] = f"""WITH {_VOTES} SELECT count(*) AS total_feedback_count, count(*) FILTER (user_feedback = 'positive') AS positive_feedback_count,
  count(*) FILTER (user_feedback = 'negative') AS negative_feedback_count,
  round(avg(risk_score_at_scan_time) FILTER (user_feedback = 'positive'), 4) AS average_risk_score_positive,
  round(avg(risk_score_at_scan_time) FILTER (user_feedback = 'negative'), 4) AS average_risk_score_negative,
  round(count(*) FILTER (user_feedback = 'positive') / count(*), 4) AS positive_feedback_rate,
  round(count(*) FILTER (user_feedback = 'negative') / count(*), 4) AS negative_feedback_rate FROM g"""
SQL["feedback_by_class"] = f"""WITH {_VOTES}, d AS (SELECT unnest({_LIST(dims.CLASSES)}) AS classification),
c AS (SELECT d.classification, count(*) FILTER (user_feedback = 'positive') AS positive_count,
  count(*) FILTER (user_feedback = 'negative') AS negative_count FROM d LEFT JOIN g ON g.classification_at_scan_time = d.classification GROUP BY 1)
SELECT *, positive_count + negative_count AS total_count,
  coalesce(round(positive_count / nullif(positive_count + negative_count, 0), 4), 0.0)::DOUBLE AS positive_rate,
  coalesce(round(negative_count / nullif(positive_count + negative_count, 0), 4), 0.0)::DOUBLE AS negative_rate FROM c"""
SQL["feedback_by_source"] = f"""WITH {_VOTES}, d AS (SELECT unnest({_LIST(dims.FEEDBACK_SOURCES)}) AS source_type)
SELECT d.source_type, count(g.src) AS feedback_count FROM d LEFT JOIN g ON g.src = d.source_type GROUP BY 1"""
_HIST = f"hs AS (SELECT * EXCLUDE (ts), epoch_us(ts) // 1000 AS timestamp_millis FROM ({v.view_sql(v.HISTORY)}))"
SQL["history_page"] = f"""WITH {_HIST} SELECT * FROM hs WHERE classification = 'Phishing' AND source_type = 'url'
ORDER BY timestamp_millis DESC, scan_id DESC LIMIT 50 OFFSET 10"""
SQL["history_lookup"] = f"WITH {_HIST} SELECT * FROM hs WHERE scan_id = '00000000-0000-4000-8000-000000000042' LIMIT 1"
SQL["history_stats"] = f"WITH {_HIST} SELECT count(*) AS total, count(*) FILTER (classification <> 'Safe') AS threats FROM hs"
SQL["history_feedback_state"] = f"""WITH {_HIST} SELECT CASE timestamp_millis % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END AS feedback_state,
  count(*) AS scans FROM hs GROUP BY 1"""
SQL["history_delete"] = f"WITH {_HIST} SELECT source_type, count(*) AS scans FROM hs WHERE source_type <> 'share' GROUP BY 1"
_INBOX = f"{_HIST}, ib AS (SELECT * FROM hs WHERE source_type IN ('gmail', 'demo'))"
SQL["inbox_summary"] = f"""WITH {_INBOX}, c AS (SELECT count(*) AS audited, count(*) FILTER (classification <> 'Safe') AS threats FROM ib)
SELECT *, CASE WHEN audited = 0 THEN 100 ELSE greatest(0, 100 - threats * 25) END::BIGINT AS integrity FROM c"""
SQL["inbox_latest"] = f"WITH {_INBOX} SELECT * FROM ib ORDER BY timestamp_millis DESC, scan_id DESC LIMIT 5"
SQL["watch_alerts"] = f"""WITH {_HIST} SELECT scan_id, classification <> 'Safe' AS watch_alert,
  classification IN ('Phishing', 'Malware') AS inbox_alert FROM hs WHERE classification <> 'Safe'"""

# marks are key, time and event; the report of a failed scan takes back the mark of its own event
SQL["link_watch"] = f"""WITH RECURSIVE s AS (SELECT *, {v.T_US_SQL} AS t_us FROM ({v.view_sql(v.WATCH_SCREENS)})),
l AS (SELECT *, regexp_extract_all(text, 'https://[^ ]+') AS u FROM s),
x AS (SELECT device_id, arrival_seq, t_us, unnest(range(len(u))) AS position, unnest(u) AS key FROM l
  UNION ALL SELECT device_id, arrival_seq, t_us, 0, 'text' FROM s WHERE text LIKE 'Security%'),
g AS (SELECT *, false AS failed FROM x UNION ALL SELECT device_id, arrival_seq, t_us + 20000000, position, key, true FROM x WHERE arrival_seq % 5 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_us, arrival_seq, position) AS rn FROM g),
r AS (SELECT device_id, 0::BIGINT AS rn, 0::BIGINT AS arrival_seq, 0::BIGINT AS position, '' AS key, true AS failed, false AS accepted,
    []::STRUCT(k VARCHAR, t BIGINT, s BIGINT)[] AS marks, []::BIGINT[] AS rec FROM (SELECT DISTINCT device_id FROM g)
  UNION ALL SELECT device_id, rn, arrival_seq, position, key, failed, ok,
    CASE WHEN failed THEN list_filter(marks, lambda m: NOT (m.k = key AND m.s = arrival_seq))
      WHEN ok THEN list_append(list_filter(marks, lambda m: m.k <> key AND t_us - m.t <= 1200000000), {{'k': key, 't': t_us, 's': arrival_seq}}) ELSE marks END,
    CASE WHEN ok THEN list_append(recent, t_us) ELSE recent END
  FROM (SELECT *, NOT failed AND len(recent) < 2 AND len(list_filter(marks, lambda m: m.k = key AND t_us - m.t < 1200000000)) = 0 AS ok
    FROM (SELECT q.*, r.marks, list_filter(r.rec, lambda a: q.t_us - a <= 300000000) AS recent FROM r JOIN q ON q.device_id = r.device_id AND q.rn = r.rn + 1)))
SELECT device_id, arrival_seq, position, CASE WHEN key <> 'text' THEN key END AS url, accepted FROM r WHERE rn > 0 AND NOT failed"""

# ------------------------------------------------------------------ repeats, admission, sessions
SQL["pending_messages"] = "SELECT event_id AS message_id, user_id FROM events WHERE NOT (event_id % 3 = 0 AND user_id % 2 = 0)"
SQL["last_500"] = """WITH f AS (SELECT concat('m', event_id % 4000) AS message_id, min(event_id) AS seq FROM events GROUP BY 1)
SELECT * FROM f ORDER BY seq DESC, message_id DESC LIMIT 500"""
SQL["debounce"] = """SELECT seq, window_id, content FROM (SELECT event_id AS seq, user_id AS window_id, event_type AS content,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> content"""
_REP = f"""q AS (SELECT arrival_seq, t_us, concat('k', regexp_extract(sender_raw, '<u(\\d+)@', 1)) AS key, arrival_seq % 4 <> 0 AS ok,
  row_number() OVER (PARTITION BY sender_raw ORDER BY arrival_seq) AS rn FROM ({v.messages_sql()}))"""
SQL["ttl_dedup"] = f"""WITH RECURSIVE {_REP}, r AS (SELECT key, rn, arrival_seq, true AS accepted, CASE WHEN ok THEN t_us END AS mark FROM q WHERE rn = 1
  UNION ALL SELECT q.key, q.rn, q.arrival_seq, r.mark IS NULL OR q.t_us - r.mark >= 600000000,
    CASE WHEN r.mark IS NULL OR q.t_us - r.mark >= 600000000 THEN CASE WHEN q.ok THEN q.t_us END ELSE r.mark END
  FROM r JOIN q ON q.key = r.key AND q.rn = r.rn + 1)
SELECT arrival_seq, accepted FROM r"""
_ADMIT = lambda limit, op: f"""WITH RECURSIVE {_REP}, r AS (SELECT key, rn, arrival_seq, t_us, true AS allowed, [t_us] AS rec, 0::BIGINT AS wait FROM q WHERE rn = 1
  UNION ALL SELECT key, rn, arrival_seq, t_us, len(kept) < {limit}, CASE WHEN len(kept) < {limit} THEN list_append(kept, t_us) ELSE kept END,
    CASE WHEN len(kept) < {limit} THEN 0 ELSE greatest(1, ceil((kept[1] + 600000000 - t_us) / 1000000.0)) END::BIGINT
  FROM (SELECT q.key, q.rn, q.arrival_seq, q.t_us, list_filter(r.rec, lambda x: q.t_us - x {op} 600000000) AS kept
    FROM r JOIN q ON q.key = r.key AND q.rn = r.rn + 1))"""  # noqa: E731
SQL["admission_server"] = _ADMIT(3, "<") + " SELECT arrival_seq, allowed, wait AS retry_after FROM r"
_TWO_KEYS = """WITH RECURSIVE q AS (SELECT arrival_seq, t_us, concat('10.0.0.', arrival_seq % 7) AS ip,
  concat('k', regexp_extract(sender_raw, '<u(\\d+)@', 1)) AS key FROM (""" + v.messages_sql() + """)),
qi AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY arrival_seq) AS rn FROM q),
i AS (SELECT ip, key, rn, arrival_seq, t_us, true AS ok, [t_us] AS rec FROM qi WHERE rn = 1
  UNION ALL SELECT ip, key, rn, arrival_seq, t_us, len(kept) < 30, CASE WHEN len(kept) < 30 THEN list_append(kept, t_us) ELSE kept END
  FROM (SELECT qi.*, list_filter(i.rec, lambda x: qi.t_us - x < 60000000) AS kept FROM i JOIN qi ON qi.ip = i.ip AND qi.rn = i.rn + 1)),
qk AS (SELECT key, arrival_seq, t_us, row_number() OVER (PARTITION BY key ORDER BY arrival_seq) AS rn FROM i WHERE ok),
k AS (SELECT key, rn, arrival_seq, true AS ok, [t_us] AS rec FROM qk WHERE rn = 1
  UNION ALL SELECT key, rn, arrival_seq, len(kept) < 30, CASE WHEN len(kept) < 30 THEN list_append(kept, t_us) ELSE kept END
  FROM (SELECT qk.*, list_filter(k.rec, lambda x: qk.t_us - x < 60000000) AS kept FROM k JOIN qk ON qk.key = k.key AND qk.rn = k.rn + 1))
SELECT i.arrival_seq, coalesce(k.ok, false) AS allowed FROM i LEFT JOIN k USING (arrival_seq)"""
SQL["admission_request"] = _TWO_KEYS
SQL["admission_client"] = _ADMIT(2, "<=") + " SELECT arrival_seq, allowed FROM r"
SQL["live_session_join"] = """WITH s AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS expires_at FROM events GROUP BY 1)
SELECT event_id, user_id, c_name AS full_name FROM events JOIN s USING (user_id) JOIN customer ON c_custkey = user_id WHERE expires_at > ts"""

# ------------------------------------------------------------------ feeds, mail, shares
_UP = f"""fd AS ({v.FEED_URLS_SQL}), ld AS (SELECT DISTINCT url, lower({_HOST}) AS domain FROM pages WHERE page_id % 50 = 9),
up AS (SELECT url, domain, 'phishing' AS threat_type, 'OpenPhish' AS source FROM ld
  UNION ALL SELECT url, domain, threat_type, source FROM fd WHERE url NOT IN (SELECT url FROM ld))"""
SQL["feed_upsert"] = f"WITH {_UP} SELECT * FROM up"
SQL["feed_file_lines"] = f"""WITH fd AS ({v.FEED_URLS_SQL}), ln AS (
  SELECT page_id, concat('https://feed.example.com/', page_id % 40, substr(md5(url), 1, 1)) AS url FROM pages WHERE page_id % 7 <> 3 AND page_id % 11 <> 5)
SELECT url, 'feed.example.com' AS domain, concat('t', max(page_id)) AS threat_type, 'one,"two"' AS tags, 'URLhaus' AS source FROM ln GROUP BY url
UNION ALL SELECT url, domain, threat_type, tags, source FROM fd WHERE url NOT IN (SELECT url FROM ln)"""
SQL["feed_counts"] = f"WITH {_UP} SELECT source, count(*) AS added FROM up GROUP BY 1"
SQL["feed_stats"] = f"""WITH {_UP} SELECT (SELECT count(*) FROM fd) AS threat_urls_count, {len(dims.SEED_HASHES)}::BIGINT AS malware_hashes_count,
  {len(dims.SEED_DOMAINS)}::BIGINT AS whitelisted_domains_count, 'baseline' AS last_synced, 'ready' AS status"""
_MAIL = f"""l AS ({v.view_sql(v.LINK_TEXT)}), ml AS (SELECT doc_id, concat('m', doc_id) AS message_id, doc_id % 13 <> 0 AS ok,
  concat('u', doc_id, '@example.com') AS sender, concat('Note ', doc_id) AS subject,
  regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body, {_EXTRACT('text')} AS ul FROM l),
mx AS (SELECT *, {_DISTINCT('ul')} AS urls FROM ml)"""
SQL["mail_extract"] = f"""WITH {_MAIL} SELECT message_id, CASE WHEN ok THEN 'extracted' ELSE 'missing_body' END AS status, sender, subject,
  CASE WHEN ok THEN body END AS body_text, CASE WHEN ok THEN array_to_string(urls, ' ') ELSE '' END AS urls FROM mx"""
SQL["mail_scans"] = f"""WITH {_MAIL} SELECT message_id AS scan_id, concat('Subject: ', subject, chr(10), 'From: ', sender, chr(10), chr(10), body) AS text,
  urls[1] AS url, sender AS sender_id, 'gmail' AS source_channel FROM mx WHERE ok"""
SQL["mail_fetch_summary"] = f"""WITH {_MAIL} SELECT count(*) FILTER (ok) AS emails, count(*) FILTER (NOT ok) AS skipped_messages, 'messages' AS outcome FROM mx"""
SQL["share_routes"] = f"""WITH l AS ({v.view_sql(v.LINK_TEXT)}), a AS (SELECT doc_id, doc_id % 17 <> 0 AS send,
  CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS mime_ok, doc_id % 4 = 1 AS file, doc_id % 8 = 1 AS empty_file,
  CASE WHEN doc_id % 7 <> 3 THEN text END AS text, CASE WHEN doc_id % 3 = 0 THEN concat('http://data.example.com/', doc_id) END AS data FROM l),
b AS (SELECT *, CASE WHEN file THEN text ELSE coalesce(text, data) END AS shared FROM a),
c AS (SELECT *, {_EXTRACT('shared')}[1] AS found, CASE WHEN NOT send THEN 'Unsupported share action.'
   WHEN file AND NOT coalesce(mime_ok, false) THEN 'Unsupported shared file type.' WHEN file AND empty_file THEN 'Shared file is empty.'
   WHEN NOT file AND mime_ok = false THEN 'Unsupported shared content type.'
   WHEN NOT file AND shared IS NULL THEN 'No shared text or URL was provided.' END AS reject_reason FROM b),
e AS (SELECT *, CASE WHEN file THEN found ELSE coalesce(found, data) END AS url FROM c)
SELECT doc_id, CASE WHEN reject_reason IS NULL THEN CASE WHEN file THEN 'File' WHEN url IS NOT NULL THEN 'URL' ELSE 'Text' END END AS kind,
  CASE WHEN reject_reason IS NULL THEN url END AS scan_url, reject_reason FROM e"""
