"""DuckDB counterparts of the registered queries, written independently over the driver's views."""

from echolens.fixed import ACTIONS, CATEGORY_LABELS, DEFAULT_ACTION, PROVIDERS, REASON_FALLBACK
from echolens.plans import registry as r

# Rules, patterns and terms are written out here on their own, so that a wrong one in the library shows.
TERMS = ["from", "than", "of the", "of", "tion", "de la"]
SPACES = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CAPITALISED = r"\p{Lu}(?:\p{L}|\p{N})+(?:(?: |-)\p{Lu}(?:\p{L}|\p{N})+)*"
DOMAIN_WEIGHTS = {"review_site": 1.0, "tech_media": 0.9, "business_media": 0.8, "community": 0.7, "developer": 0.7, "blog_platform": 0.5, "brand_owned": 0.3, "professional_social": 0.4, "video": 0.5, "reference": 0.6, "other": 0.2}
_CLASSES = [("community", "reddit.com"), ("developer", "stackoverflow.com dev.to hackernews"), ("review_site", "g2.com capterra.com trustradius.com getapp.com"),
            ("tech_media", "techcrunch wired theverge zdnet techradar infoworld"), ("business_media", "forbes businessinsider entrepreneur inc.com"),
            ("blog_platform", "medium.com substack.com ghost.io"), ("video", "youtube.com youtu.be"), ("reference", "wikipedia.org"),
            ("professional_social", "linkedin.com"), ("social", "twitter.com x.com")]

W = r"[\p{L}\p{N}_]"


def q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def pct(part: str, whole: str, digits: int = 1) -> str:
    """100·part/whole, half-up, in integers."""
    scale = 10 ** digits
    return f"(CAST((200*{scale}*({part}) + ({whole})) // (2*({whole})) AS DOUBLE) / {scale})"


def case(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def classify(domain: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({domain}), {q(part)})' for part in parts.split())} THEN {q(name)}" for name, parts in _CLASSES)
    return f"CASE {whens} WHEN len(string_split(ltrim({domain}, 'w.'), '.')) = 2 THEN 'brand_owned' ELSE 'other' END"


# --- adapters as CTEs ------------------------------------------------------------------------------------------

_SLOT = """concat('r', CAST(o_orderkey % 50 AS VARCHAR)) AS run_id, concat('p', CAST(o_custkey AS VARCHAR)) AS prompt_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider"""
_DOMAINS = ["reddit.com", "stackoverflow.com", "g2.com", "techcrunch.com", "forbes.com", "medium.com", "youtube.com",
            "en.wikipedia.org", "linkedin.com", "x.com", "asana.com", "docs.some.site.xyz", "capterra.com", "dev.to"]
_TYPES = ["community", "developer", "review_site", "tech_media", "business_media", "blog_platform", "video", "reference",
          "professional_social", "social", "brand_owned", "other", "review_site", "developer"]
_pick = lambda values: "CASE l_suppkey % 14 " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"

STAR = f"""
prompts AS MATERIALIZED (
 SELECT concat('p', CAST(c_custkey AS VARCHAR)) AS prompt_id, concat('Best tool for ', c_name, '?') AS prompt_text,
  lower(c_mktsegment) AS category,
  [concat('Brand#', CAST(c_custkey % 5 * 5 + i AS VARCHAR)) FOR i IN [1, 2, 3]] AS brands,
  concat('["Brand#', CAST(c_custkey % 5 * 5 + 1 AS VARCHAR), '","Brand#', CAST(c_custkey % 5 * 5 + 2 AS VARCHAR), '","Brand#', CAST(c_custkey % 5 * 5 + 3 AS VARCHAR), '"]') AS target_brands,
  CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS TIMESTAMP) AS created_at
 FROM customer),
llm_responses AS MATERIALIZED (
 SELECT {_SLOT}, min(o_orderdate) AS created_at, max(CAST(trunc(o_totalprice) AS INTEGER)) AS latency_ms,
  max(CASE WHEN o_orderstatus = 'P' THEN 'timeout' END) AS error
 FROM orders GROUP BY 1, 2, 3),
brand_mentions AS MATERIALIZED (
 SELECT {_SLOT}, p_brand AS brand, min(l_linenumber) AS position,
  CASE min(l_returnflag) WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS sentiment,
  min(o_orderdate) AS created_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
citation_sources AS MATERIALIZED (
 SELECT DISTINCT {_SLOT}, concat('https://', {_pick(_DOMAINS)}, '/', CAST(l_partkey AS VARCHAR)) AS url,
  {_pick(_DOMAINS)} AS domain, {_pick(_TYPES)} AS domain_type
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_TEXT_URL = """CASE doc_id % 6 WHEN 0 THEN ' See (https://www.g2.com/p/1), and HTTPS://Reddit.com/r/x.'
 WHEN 1 THEN ' Sources: https://wired.com/a; https://www.wikipedia.org/b' WHEN 2 THEN ' https://x.com:8080/t https://x.com:8080/t'
 WHEN 3 THEN ' [docs](https://docs.some.site.xyz/z),' WHEN 4 THEN ' http://asana.com' ELSE '' END"""
TEXT = f"""
answers AS MATERIALIZED (
 SELECT concat('base-t', CAST(doc_id % 3 AS VARCHAR)) AS run_id, concat('d', CAST(doc_id // 3 AS VARCHAR)) AS prompt_id,
  CASE (doc_id // 3) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider,
  concat(text, {_TEXT_URL}) AS response_text, CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS error,
  doc_id % 3 AS trial, DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS day
 FROM documents),
valid AS MATERIALIZED (SELECT * FROM answers WHERE coalesce(error, '') = '' AND coalesce(response_text, '') <> '')"""

_STRIP = lambda s: f"regexp_replace(regexp_replace({s}, {q(f'^[{SPACES}]+')}, ''), {q(f'[{SPACES}]+$')}, '')"
_terms = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(TERMS))
_offset = " ".join(
    f"WHEN {q(t)} THEN CASE WHEN regexp_matches(response_text, {q(f'(?i)(^|[^{W[1:-1]}]){t}($|[^{W[1:-1]}])')}) THEN "
    f"length(regexp_extract(response_text, {q(f'(?is)^(.*?(?:^|[^{W[1:-1]}])){t}(?:[^{W[1:-1]}]|$)')}, 1)) END" for t in TERMS)
HITS = f"""
terms(idx, brand) AS (VALUES {_terms}),
offsets AS (SELECT v.*, idx, brand, CASE brand {_offset} END AS char_offset FROM valid v CROSS JOIN terms),
hits AS MATERIALIZED (
 SELECT *, row_number() OVER (PARTITION BY run_id, prompt_id, provider ORDER BY char_offset, idx) AS position,
  {_STRIP('substring(response_text, greatest(char_offset - 100, 0) + 1, char_offset + length(brand) + 100 - greatest(char_offset - 100, 0))')} AS snippet
 FROM offsets WHERE char_offset IS NOT NULL)"""
_words = lambda s: f"regexp_extract_all(lower({s}), {q(W + '+')})"
_count = lambda s, words: f"len(list_filter({_words(s)}, lambda w: w IN ({listed(words)})))"
_balance = lambda s: f"({_count(s, r.CORPUS_POSITIVE)} - {_count(s, r.CORPUS_NEGATIVE)})"
MOOD = lambda s: f"CASE WHEN {_balance(s)} > 0 THEN 'positive' WHEN {_balance(s)} < 0 THEN 'negative' ELSE 'neutral' END"

_url_re = rf"(?i)https?://[^{SPACES})\],\"'<>]+"
URLS = f"""
raw_urls AS (SELECT *, list_transform(regexp_extract_all(response_text, {q(_url_re)}), lambda u: rtrim(u, '.,;)')) AS urls FROM valid),
at_urls AS (SELECT run_id, prompt_id, provider, trial, unnest(urls) AS url, generate_subscripts(urls, 1) AS idx FROM raw_urls),
first_urls AS (SELECT run_id, prompt_id, provider, trial, url, min(idx) AS idx FROM at_urls GROUP BY ALL),
urls AS (SELECT *, row_number() OVER (PARTITION BY run_id, prompt_id, provider ORDER BY idx) - 1 AS url_index,
 ltrim(lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)), 'w.') AS domain FROM first_urls),
cited AS MATERIALIZED (SELECT *, {classify('domain')} AS domain_type FROM urls)"""

VOTE = """
per_brand AS (
 SELECT prompt_id, provider, brand, count(*) AS hits, median(position) AS middle, min(idx) AS idx,
  arg_min(char_offset, trial) AS char_offset, arg_min(snippet, trial) AS snippet, min(trial) AS first_trial, arg_min(position, trial) AS first_position
 FROM hits GROUP BY 1, 2, 3 HAVING count(*) >= 2),
groups AS (SELECT prompt_id, provider, count(*) AS n, list(run_id ORDER BY trial) AS runs FROM valid GROUP BY 1, 2),
voted AS MATERIALIZED (
 SELECT runs[CAST(n // 2 AS INTEGER) + 1] AS run_id, prompt_id, provider, brand,
  row_number() OVER (PARTITION BY prompt_id, provider ORDER BY round_even(middle, 0), first_trial, first_position) AS position,
  char_offset, snippet, round(hits / n, 6) AS appearance_rate
 FROM per_brand JOIN groups USING (prompt_id, provider))"""

FANOUT = f"""
records AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines, CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS error FROM documents),
ok AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category, lines[1] AS original, lines[2:] AS qs, len(lines) - 1 AS n FROM records WHERE error IS NULL),
fan AS MATERIALIZED (SELECT id, category, original, unnest(qs) AS fanout_query FROM ok)"""
_class_case = "CASE " + " ".join(
    f"WHEN token IN ({listed([*ws, r.YEAR] if n == 'temporal' else ws)}) THEN {q(n)}" for n, ws in r.CORPUS_CLASSES.items()) + " ELSE 'other' END"
TOKENS = f"""
runs AS (SELECT category AS prompt_category, unnest({_words('fanout_query')}) AS token FROM fan),
tokens AS (SELECT token, {_class_case} AS category, prompt_category FROM runs
 WHERE regexp_full_match(token, '[a-zA-Z0-9]{{3,}}') AND token NOT IN ({listed(r.CORPUS_STOP_WORDS)}))"""
_named = f"list_filter([{listed(TERMS)}], lambda b: contains(lower(fanout_query), b))"
_new = f"list_filter({_named}, lambda b: NOT contains(lower(original), b))"
INJECTION = f"""
injected AS (SELECT id, category, original, concat(substring(original, 1, 70), '...') AS shown, fanout_query,
 len({_named}) AS n_brands_fanout, coalesce(nullif(array_to_string({_named}, ', '), ''), '—') AS brands_in_fanout,
 coalesce(nullif(array_to_string({_new}, ', '), ''), '—') AS new_brands, len({_new}) > 0 AS brand_injected FROM fan)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# --- shared metric pieces --------------------------------------------------------------------------------------

_RATES = f"""count(*) AS mentions, avg(position) AS avg_position,
 {pct("count(*) FILTER (sentiment = 'positive')", "count(*)")} AS pos_rate,
 {pct("count(*) FILTER (sentiment = 'negative')", "count(*)")} AS neg_rate"""
VISIBILITY = f"""
cat_slots AS (SELECT category, count(DISTINCT (run_id, prompt_id, provider)) AS n FROM llm_responses JOIN prompts USING (prompt_id) GROUP BY 1),
visibility AS MATERIALIZED (SELECT category, brand, {_RATES}, {pct("count(*)", "any_value(n)")} AS visibility_pct
 FROM brand_mentions m JOIN prompts p USING (prompt_id) JOIN cat_slots USING (category) GROUP BY 1, 2)"""

COOC = """
pairs AS MATERIALIZED (
 SELECT c.domain_type, b.brand, count(DISTINCT (b.prompt_id, b.provider)) AS keys, count(DISTINCT (b.run_id, b.prompt_id, b.provider)) AS runs,
  avg(b.position) AS avg_position_with_source, count(DISTINCT c.domain) AS domains
 FROM citation_sources c JOIN brand_mentions b ON c.prompt_id = b.prompt_id AND c.provider = b.provider
 WHERE c.domain_type IS NOT NULL GROUP BY 1, 2),
volume AS (SELECT domain_type, count(*) AS citation_count, count(DISTINCT domain) AS unique_domains, count(DISTINCT prompt_id) AS prompts_with_citations
 FROM citation_sources WHERE domain_type IS NOT NULL GROUP BY 1),
features AS MATERIALIZED (SELECT domain_type, brand, keys AS cooccurrence_count, avg_position_with_source, citation_count, unique_domains, prompts_with_citations
 FROM pairs JOIN volume USING (domain_type))"""
TOTALS = """
totals AS MATERIALIZED (SELECT brand, count(*) AS total_mentions, avg(position) AS avg_position, count(DISTINCT prompt_id) AS prompts_mentioned FROM brand_mentions GROUP BY 1)"""
MATRIX = f"""
matrix AS MATERIALIZED (
 SELECT domain_type, brand, runs AS cooccurrence, avg_position_with_source, domains AS unique_domains,
  avg(runs) OVER (PARTITION BY domain_type) AS competitor_avg_cooccurrence, total_mentions, t.avg_position AS brand_avg_position,
  prompts_mentioned AS brand_prompt_count, avg(runs) OVER (PARTITION BY domain_type) - runs AS opportunity_gap,
  CAST({case('domain_type', DOMAIN_WEIGHTS, '0.2')} AS DOUBLE) AS domain_authority_weight, 1 / greatest(avg_position_with_source, 0.1) AS position_score
 FROM pairs JOIN totals t USING (brand))"""
_weights = ", ".join(f"({i}, {q(n)}, CAST({w} AS DOUBLE))" for i, (n, w) in enumerate(DOMAIN_WEIGHTS.items()))
_band = lambda s, hi=60, mid=35: f"CASE WHEN {s} >= {hi} THEN 'HIGH' WHEN {s} >= {mid} THEN 'MEDIUM' ELSE 'LOW' END"
GRID = f"""
weights(weight_rank, domain_type, weight) AS (VALUES {_weights}),
targets AS (SELECT DISTINCT brand AS target FROM brand_mentions UNION ALL SELECT 'Nobody')"""


def scores(competitors: list[str], name: str = "scores") -> str:
    rivals = (f"(SELECT domain_type, avg(cooccurrence_count) AS rivals FROM features WHERE brand IN ({listed(competitors)}) GROUP BY 1)"
              if competitors else "(SELECT NULL AS domain_type, NULL::DOUBLE AS rivals WHERE false)")
    return f"""
{name}_parts AS (
 SELECT target, w.domain_type, weight_rank, weight, f.brand IS NOT NULL AS present, coalesce(cooccurrence_count, 0) AS own, coalesce(rivals, 0.0) AS rivals,
  citation_count, avg_position_with_source
 FROM targets CROSS JOIN weights w LEFT JOIN features f ON f.brand = target AND f.domain_type = w.domain_type LEFT JOIN {rivals} x ON x.domain_type = w.domain_type),
{name}_raw AS (SELECT *, CAST(printf('%.1f', weight * 40 + least(30.0::DOUBLE, greatest(0.0::DOUBLE, rivals - own) * 10)
  + CASE WHEN present THEN least(20, citation_count * 2) ELSE 0 END
  + CASE WHEN present THEN greatest(0.0::DOUBLE, 10 - avg_position_with_source * 2) ELSE 5.0::DOUBLE END) AS DOUBLE) AS opportunity_score FROM {name}_parts),
{name} AS MATERIALIZED (SELECT target, domain_type, opportunity_score, {_band('opportunity_score')} AS priority,
 CASE WHEN rivals > own THEN concat('Competitors appear ', printf('%.1f', rivals), '× in ', domain_type, ' sources vs your ', printf('%.1f', CAST(own AS DOUBLE)), '× — high gap opportunity')
  WHEN opportunity_score >= 60 THEN concat(domain_type, ' is high-authority and you have room to grow presence')
  ELSE concat(domain_type, ' sources contribute to AI citation signals in this category') END AS reason,
 {case('domain_type', ACTIONS, q(DEFAULT_ACTION))} AS action, weight_rank FROM {name}_raw)"""


_GAP = lambda targets, cat: f"""
targets AS (SELECT unnest([{listed(targets)}]) AS target),
has AS (SELECT DISTINCT run_id, prompt_id, provider, brand AS target FROM brand_mentions),
gaps AS MATERIALIZED (SELECT {cat} t.target, m.brand, count(*) AS appears_when_target_absent, avg(position) AS avg_position
 FROM brand_mentions m {'JOIN prompts USING (prompt_id)' if cat else ''} CROSS JOIN targets t
 LEFT JOIN has h ON h.run_id = m.run_id AND h.prompt_id = m.prompt_id AND h.provider = m.provider AND h.target = t.target
 WHERE h.target IS NULL AND m.brand <> t.target GROUP BY ALL)"""

_LABEL = case("provider", {"openai": "OpenAI", "anthropic": "Anthropic", "gemini": "Gemini"}, "provider")
MIX = f"""
by_provider AS (SELECT provider, domain_type, count(*) AS count FROM citation_sources WHERE domain_type IS NOT NULL AND provider IS NOT NULL GROUP BY 1, 2),
shares AS (SELECT *, {pct('count', 'CAST(sum(count) OVER (PARTITION BY provider) AS BIGINT)')} AS pct FROM by_provider),
mix AS (SELECT provider, domain_type, count, pct, {_LABEL} AS provider_label, CASE WHEN pct >= 5 THEN printf('%.0f%%', pct) ELSE '' END AS label FROM shares)"""

_ALERT = """
alerts AS MATERIALIZED (SELECT category, brand, visibility_pct AS current, previous,
 visibility_pct < 75.5 OR coalesce(previous - visibility_pct >= 5, false) AS triggered,
 CASE WHEN visibility_pct < 75.5 THEN 'below threshold' WHEN previous - visibility_pct >= 5 THEN 'significant drop' ELSE '' END AS reason, mentions
 FROM visibility LEFT JOIN before USING (category, brand))"""
ALERT_COMPAT = f"""
days AS (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM brand_mentions ORDER BY day DESC LIMIT 1 OFFSET 1),
prev AS (SELECT category, brand, count(*) AS n FROM brand_mentions m JOIN prompts USING (prompt_id) WHERE CAST(m.created_at AS DATE) IN (FROM days) GROUP BY 1, 2),
before AS (SELECT category, brand, {pct('n', 'CAST(sum(n) OVER (PARTITION BY category) AS BIGINT)')} AS previous FROM prev),{_ALERT}"""
ALERT_SLOTS = f"""
per_day AS (SELECT category, CAST(l.created_at AS DATE) AS day, count(DISTINCT (run_id, prompt_id, provider)) AS slots FROM llm_responses l JOIN prompts USING (prompt_id) GROUP BY 1, 2),
second AS (SELECT * FROM per_day QUALIFY row_number() OVER (PARTITION BY category ORDER BY day DESC) = 2),
before AS (SELECT category, brand, {pct('count(*)', 'any_value(slots)')} AS previous FROM brand_mentions m JOIN prompts USING (prompt_id)
 JOIN second USING (category) WHERE CAST(m.created_at AS DATE) = second.day GROUP BY 1, 2),{_ALERT}"""

_STORED = "CASE WHEN category = 'building' THEN"


def oracle_sql() -> dict[str, str]:
    star = with_(STAR)
    sql = {
        "read_raw_runs": with_(TEXT) + "SELECT run_id, prompt_id, provider, response_text, 100 AS latency_ms, error, day FROM answers",
        "latest_run": with_(TEXT) + "SELECT run_id, prompt_id, provider FROM answers WHERE run_id = 'base-t2'",
        "valid_responses": with_(TEXT) + "SELECT run_id, prompt_id, provider FROM valid",
        "save_responses": f"""WITH rows AS (SELECT {_SLOT}, CAST(trunc(o_totalprice) AS INTEGER) AS latency_ms, o_orderpriority AS response_text, o_orderdate AS created_at FROM orders)
 SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY run_id, prompt_id, provider ORDER BY created_at DESC, latency_ms DESC, response_text DESC) = 1""",
        "save_mentions": star + "SELECT run_id, prompt_id, provider, brand, position, sentiment, created_at FROM brand_mentions",
        "save_citations": star + "SELECT run_id, prompt_id, provider, url, domain, domain_type FROM citation_sources",
        "unseen_runs": with_(TEXT) + "SELECT run_id, prompt_id, provider FROM answers WHERE run_id = 'base-t1'",
        "upsert_prompts": star + f"""SELECT prompt_id, {_STORED} upper(prompt_text) ELSE prompt_text END AS prompt_text, category, target_brands,
 {_STORED} TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-02-01' END AS created_at FROM prompts""",
        "seed_prompts": star + f"""SELECT prompt_id, {_STORED} prompt_text ELSE upper(prompt_text) END AS prompt_text, category, target_brands,
 {_STORED} TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-03-01' END AS created_at,
 CAST((SELECT count(*) FROM prompts WHERE category <> 'building') AS INTEGER) AS seeded FROM prompts""",
        "list_prompts": star + "SELECT prompt_id, prompt_text, category, array_to_string(brands, '|') AS target_brands, created_at FROM prompts",
        "get_prompt": star + "SELECT prompt_id, prompt_text, category, array_to_string(brands, '|') AS target_brands FROM prompts WHERE prompt_id = (SELECT max(prompt_id) FROM prompts)",
        "create_prompt": star + "SELECT prompt_id, category, (SELECT count(*) FROM prompts) AS stored FROM prompts WHERE category = 'building'",
        "delete_prompt": star + "SELECT prompt_id, category, (SELECT count(*) FROM prompts WHERE category = 'machinery') AS deleted FROM prompts WHERE category <> 'machinery'",
        "table_schemas": star + " UNION ALL ".join(
            f"SELECT {q(t)} AS table_name, count(*) AS rows, count(DISTINCT prompt_id) AS prompts FROM {t}"
            for t in ("llm_responses", "brand_mentions", "citation_sources", "prompts")),
        "request_plan": star + """SELECT (row_number() OVER (ORDER BY created_at, prompt_id) - 1) // 10 AS batch, prompt_id, prompt_text FROM prompts""",
        "run_summary": with_(TEXT) + "SELECT run_id, provider, prompt_id, 100 AS latency_ms, length(response_text) AS chars, CASE WHEN error IS NULL THEN 'OK' ELSE 'ERR' END AS status FROM answers",
        "detect_brands": with_(TEXT, HITS) + "SELECT run_id, prompt_id, provider, brand, position, char_offset, snippet FROM hits",
        "match_target_brands": with_(TEXT, STAR) + f"""SELECT run_id, prompt_id, provider, {len(TERMS)} AS n_brands, {q('|'.join(TERMS))} AS target_brands FROM valid
 UNION ALL SELECT run_id, prompt_id, provider, 0, '' FROM llm_responses""",
        "extract_citations": with_(TEXT, URLS) + "SELECT run_id, prompt_id, provider, url_index, url, domain, domain_type FROM cited",
        "classify_domain": with_(STAR) + f"""SELECT page_id, domain, {classify('domain')} AS domain_type FROM (
 SELECT page_id, ltrim(lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)), 'w.') AS domain FROM pages
 UNION ALL SELECT count(*), domain FROM citation_sources GROUP BY domain)""",
        "discover_entities": with_(TEXT) + f"""SELECT entity, count(*) AS answers FROM (
 SELECT unnest(list_distinct(regexp_extract_all(response_text, {q(CAPITALISED)}))) AS entity FROM valid)
 WHERE lower(entity) NOT IN ({listed(t.lower() for t in TERMS)}) GROUP BY 1""",
        "judge_sentiment": with_(TEXT, HITS) + f"SELECT run_id, prompt_id, provider, brand, {MOOD('snippet')} AS sentiment FROM hits",
        "parse_judgement": """SELECT doc_id,
 CASE WHEN quality = 1 AND toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS sentiment,
 CASE WHEN quality = 1 AND toxic = 1 THEN 'judge_error' WHEN quality = 1 THEN concat('doc ', CAST(doc_id AS VARCHAR)) WHEN toxic = 1 THEN ''
  WHEN doc_id % 3 = 0 THEN 'no class' WHEN doc_id % 3 = 1 THEN 'judge_error' ELSE '' END AS reason FROM labels""",
        "majority_vote": with_(TEXT, HITS, VOTE) + "SELECT * FROM voted",
        "analyze_responses": with_(TEXT, HITS) + f"SELECT run_id, prompt_id, provider, brand, position, {MOOD('snippet')} AS sentiment, day FROM hits",
        "analyze_voted_responses": with_(TEXT, HITS, VOTE) + f"SELECT run_id, prompt_id, provider, brand, position, {MOOD('snippet')} AS sentiment FROM voted",
        "voted_citations": with_(TEXT, URLS) + """SELECT run_id, prompt_id, provider, url, domain, domain_type FROM cited
 QUALIFY row_number() OVER (PARTITION BY prompt_id, provider, url ORDER BY trial, url_index) = 1""",
        "mention_counts": star + """SELECT brand, count(*) AS mentions, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative
 FROM brand_mentions GROUP BY 1 ORDER BY mentions DESC, brand LIMIT 10""",
        "position_trend": star + "SELECT brand, CAST(created_at AS DATE) AS date, avg(position) AS avg_position, count(*) AS mention_count FROM brand_mentions GROUP BY 1, 2",
        "competitor_gap": with_(STAR, _GAP(r.BRANDS, "")) + "SELECT * FROM gaps",
        "competitor_gap_by_category": with_(STAR, _GAP(r.BRANDS, "category,")) + "SELECT * FROM gaps",
        "visibility_by_category": with_(STAR, VISIBILITY) + "SELECT * FROM visibility",
        "category_stats": star + """, m AS (SELECT category, count(*) AS mentions, count(DISTINCT brand) AS brands FROM brand_mentions JOIN prompts USING (prompt_id) GROUP BY 1),
 l AS (SELECT category, count(*) AS responses, min(CAST(x.created_at AS DATE)) AS lo, max(CAST(x.created_at AS DATE)) AS hi FROM llm_responses x JOIN prompts USING (prompt_id) GROUP BY 1)
 SELECT category, coalesce(mentions, 0) AS mentions, coalesce(responses, 0) AS responses, coalesce(brands, 0) AS brands, coalesce(CAST(lo AS VARCHAR), '—') AS d0,
  coalesce(CAST(hi AS VARCHAR), '—') AS d1, coalesce(strftime(lo, '%Y-%m') || ' → ' || strftime(hi, '%Y-%m'), '—') AS date_range
 FROM (SELECT DISTINCT category FROM prompts) LEFT JOIN m USING (category) LEFT JOIN l USING (category)""",
        "list_tracked_brands": star + "SELECT DISTINCT brand FROM brand_mentions",
        "provider_breakdown": star + "SELECT brand, provider, sentiment, count(*) AS count FROM brand_mentions GROUP BY ALL",
        "brands_by_category": star + """SELECT category, string_agg(brand, '|' ORDER BY brand) AS brands
 FROM (SELECT DISTINCT category, unnest(brands) AS brand FROM prompts WHERE NOT prompt_text LIKE '%7?') GROUP BY 1""",
        "prompts_by_category": star + """SELECT category, prompt_id, prompt_text, row_number() OVER (PARTITION BY category ORDER BY prompt_id) AS rank FROM prompts QUALIFY rank <= 5""",
        "citation_type_breakdown": star + "SELECT domain_type, count(*) AS count, count(DISTINCT domain) AS unique_domains FROM citation_sources GROUP BY 1",
        "llm_disagreement": with_(STAR) + f""", d AS (SELECT category, provider, count(DISTINCT (run_id, prompt_id)) AS n FROM llm_responses JOIN prompts USING (prompt_id) GROUP BY 1, 2),
 c AS (SELECT category, brand, provider, {pct('count(*)', 'any_value(n)')} AS v FROM brand_mentions JOIN prompts USING (prompt_id) JOIN d USING (category, provider) GROUP BY 1, 2, 3)
 SELECT category, brand, {', '.join(f"coalesce(max(v) FILTER (provider = {q(p)}), 0) AS {p}" for p in PROVIDERS)} FROM c GROUP BY 1, 2""",
        "citation_by_provider": with_(STAR, MIX) + "SELECT * FROM by_provider",
        "citation_by_provider_and_category": star + "SELECT category, provider, domain_type, count(*) AS count FROM citation_sources JOIN prompts USING (prompt_id) GROUP BY ALL",
        "kpi_row": with_(STAR, VISIBILITY) + """, wanted AS (SELECT DISTINCT category, unnest(brands) AS brand FROM prompts UNION SELECT category, 'Nobody' FROM prompts)
 SELECT category, brand, CASE WHEN mentions IS NULL THEN 'No data' ELSE printf('%.1f%%', visibility_pct) END AS visibility,
  CASE WHEN mentions IS NULL THEN 'No data' ELSE printf('%.1f', avg_position) END AS avg_position,
  CASE WHEN mentions IS NULL THEN 'No data' ELSE printf('%.0f%%', pos_rate) END AS pos_rate,
  CASE WHEN mentions IS NULL THEN 'No data' ELSE printf('%.0f%%', neg_rate) END AS neg_rate FROM wanted LEFT JOIN visibility USING (category, brand)""",
        "sentiment_shares": with_(STAR, VISIBILITY) + "SELECT category, brand, pos_rate, greatest(0.0::DOUBLE, 100.0::DOUBLE - pos_rate - neg_rate) AS neutral_rate, neg_rate FROM visibility",
        "gap_top10": with_(STAR, _GAP(r.BRANDS, "")) + "SELECT *, row_number() OVER (PARTITION BY target ORDER BY appears_when_target_absent DESC, brand) AS rank FROM gaps QUALIFY rank <= 10",
        "provider_sentiment_pivot": star + "SELECT brand, provider, " + ", ".join(
            f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in ("positive", "neutral", "negative")) + " FROM brand_mentions GROUP BY 1, 2",
        "citation_mix": with_(STAR, MIX) + "SELECT * FROM mix",
        "global_stats": star + """SELECT (SELECT count(*) FROM brand_mentions) AS mentions, (SELECT count(*) FROM llm_responses) AS responses,
 (SELECT count(DISTINCT brand) FROM brand_mentions) AS brands, (SELECT count(DISTINCT provider) FROM llm_responses) AS providers,
 (SELECT CAST(min(CAST(created_at AS DATE)) AS VARCHAR) FROM llm_responses) AS d0, (SELECT CAST(max(CAST(created_at AS DATE)) AS VARCHAR) FROM llm_responses) AS d1""",
        "prompt_coverage": star + f"""SELECT category, {case('category', CATEGORY_LABELS, "upper(category[1]) || category[2:]")} AS label, count(*) AS n,
 CAST(sum(count(*)) OVER () AS BIGINT) AS total_prompts FROM prompts GROUP BY 1""",
        "source_features": with_(STAR, COOC) + "SELECT * FROM features",
        "brand_features": with_(STAR, TOTALS) + f"""SELECT target, brand, total_mentions, avg_position, prompts_mentioned,
 total_mentions - (SELECT total_mentions FROM totals o WHERE o.brand = target) AS gap_vs_target
 FROM totals CROSS JOIN (SELECT unnest([{listed([*r.COMPETITORS, 'Nobody'])}]) AS target)""",
        "opportunity_scores": with_(STAR, COOC, GRID, scores(r.COMPETITORS)) + "SELECT target, domain_type, opportunity_score, priority, reason, action FROM scores",
        "score_band": with_(STAR, COOC, GRID, scores(r.COMPETITORS)) + """SELECT target, domain_type, opportunity_score, priority,
 CASE priority WHEN 'HIGH' THEN 'red' WHEN 'MEDIUM' THEN 'amber' ELSE 'green' END AS color FROM scores""",
        "fallback_scores": with_(STAR, GRID) + f"""SELECT target, domain_type, round(weight * 100, 1) AS opportunity_score, {_band('round(weight * 100, 1)', 70, 40)} AS priority,
 {q(REASON_FALLBACK)} AS reason, {case('domain_type', ACTIONS, q(DEFAULT_ACTION))} AS action FROM targets CROSS JOIN weights""",
        "reason_action_text": with_(STAR, COOC, GRID, scores(r.COMPETITORS), scores([], "alone")) + """SELECT target, domain_type, priority, reason, action FROM scores
 UNION ALL SELECT target, domain_type, priority, reason, action FROM alone""",
        "recommend_by_rules": with_(STAR, COOC, GRID, scores(r.COMPETITORS)) + """SELECT target, row_number() OVER (PARTITION BY target ORDER BY opportunity_score DESC, weight_rank) AS rank,
 domain_type, opportunity_score, priority, reason, action, 'rule_based' AS model_used FROM scores QUALIFY rank <= 5""",
        "training_matrix": with_(STAR, COOC, TOTALS, MATRIX) + "SELECT * FROM matrix",
        "scale_per_brand": with_(STAR, COOC, TOTALS, MATRIX) + """, x AS (SELECT *, min(opportunity_gap) OVER (PARTITION BY brand) AS lo, max(opportunity_gap) OVER (PARTITION BY brand) AS hi FROM matrix)
 SELECT brand, domain_type, CASE WHEN hi > lo THEN round((opportunity_gap - lo) / (hi - lo) * 100, 1) ELSE 50.0::DOUBLE END AS opportunity_score FROM x""",
        "retrain_stats": with_(STAR, COOC, TOTALS, MATRIX) + "SELECT count(*) AS rows, count(DISTINCT brand) AS brands, count(DISTINCT domain_type) AS domain_types FROM matrix",
        "visibility_alerts": with_(STAR, VISIBILITY, ALERT_COMPAT) + "SELECT category, brand, current, previous, triggered, reason FROM alerts",
        "visibility_alerts_by_slot": with_(STAR, VISIBILITY, ALERT_SLOTS) + "SELECT category, brand, current, previous, triggered, reason FROM alerts",
        "alert_message": with_(STAR, VISIBILITY, ALERT_COMPAT) + """, lines AS (SELECT category, mentions, brand,
  CASE WHEN reason = 'below threshold' THEN concat('• *', brand, '*: visibility dropped to *', printf('%.1f', current), '%* (threshold: ', printf('%.0f', 75.5::DOUBLE), '%)')
  ELSE concat('• *', brand, '*: visibility fell *', printf('%.1f', previous - current), 'pp* (', printf('%.1f', previous), '% → ', printf('%.1f', current), '%)') END AS line FROM alerts WHERE triggered)
 SELECT category, count(*) AS n_alerts, concat(':warning: *Brand Visibility Alert* — category: `', category, '`', chr(10), chr(10), string_agg(line, chr(10) ORDER BY mentions DESC, brand)) AS message FROM lines GROUP BY 1""",
        "fanout_explode": with_(FANOUT) + "SELECT id, category, fanout_query FROM fan",
        "fanout_count_stats": with_(FANOUT) + """SELECT count(n) AS count, round(avg(n), 2) AS mean, round(stddev_samp(n), 2) AS std, min(n) AS min, round(quantile_cont(n, 0.25), 2) AS p25,
 round(quantile_cont(n, 0.5), 2) AS p50, round(quantile_cont(n, 0.75), 2) AS p75, max(n) AS max FROM ok""",
        "fanout_histogram": with_(FANOUT) + """, l AS (SELECT min(n) AS lo, max(n) AS hi FROM ok)
 SELECT category, CASE WHEN hi = lo THEN 1 ELSE least(((n - lo) * 6) // (hi - lo) + 1, 6) END AS bin, count(*) AS prompts FROM ok, l GROUP BY 1, 2""",
        "fanout_by_category": with_(FANOUT) + """SELECT category, CAST((20 * CAST(sum(n) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS mean, min(n) AS min, max(n) AS max FROM ok GROUP BY 1""",
        "fanout_tokens": with_(FANOUT, TOKENS) + "SELECT token, category, prompt_category, count(*) AS n FROM tokens GROUP BY ALL",
        "top_words": with_(FANOUT, TOKENS) + "SELECT token AS word, category, count(*) AS count FROM tokens GROUP BY 1, 2 ORDER BY count DESC, word LIMIT 25",
        "keyword_share": with_(FANOUT, TOKENS) + f"""SELECT category, count(*) AS count, {pct('count(*)', 'CAST(sum(count(*)) OVER () AS BIGINT)')} AS share FROM tokens WHERE category <> 'other' GROUP BY 1""",
        "brand_injection": with_(FANOUT, INJECTION) + "SELECT * FROM injected",
        "injection_summary": with_(FANOUT, INJECTION) + f"""SELECT count(*) AS total_queries, count(*) FILTER (n_brands_fanout > 0) AS with_brand, {pct('count(*) FILTER (n_brands_fanout > 0)', 'count(*)', 0)} AS with_brand_pct,
 count(*) FILTER (brand_injected) AS new_injection, {pct('count(*) FILTER (brand_injected)', 'count(*)', 0)} AS new_injection_pct FROM injected""",
        "ingest_runs": with_(TEXT, HITS) + "SELECT run_id, prompt_id, provider, brand, position FROM hits",
        "daily_metrics_stream": star + """SELECT brand, CAST(created_at AS DATE) AS date, avg(position) AS avg_position, count(*) AS mention_count,
 round(avg(CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END), 6) + 0.0::DOUBLE AS sentiment_score FROM brand_mentions GROUP BY 1, 2""",
    }
    for name, brands in (("visibility_summary", None), ("visibility_summary_brands", r.COMPETITORS)):
        where = f"WHERE brand IN ({listed(brands)})" if brands else ""
        sql[name] = star + f"""SELECT brand, {_RATES}, {pct("count(*)", "(SELECT count(DISTINCT (run_id, prompt_id, provider)) FROM llm_responses)")} AS visibility_pct
 FROM brand_mentions {where} GROUP BY 1"""
    daily = """, daily AS (SELECT brand, CAST(created_at AS DATE) AS date, avg(CASE sentiment WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.0::DOUBLE AS s,
 count(*) AS mentions FROM brand_mentions GROUP BY 1, 2)
 SELECT brand, date, round(s, 6) + 0.0::DOUBLE AS sentiment_score, mentions, round(avg(s) OVER (PARTITION BY brand ORDER BY """
    sql["sentiment_trend"] = star + daily + "date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) + 0.0::DOUBLE AS rolling_sentiment FROM daily"
    sql["sentiment_trend_calendar"] = star + daily + "date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) + 0.0::DOUBLE AS rolling_sentiment FROM daily"
    plan = sql["request_plan"]
    sql["request_plan"] = f"""SELECT batch, concat('base-t', CAST(trial AS VARCHAR)) AS run_id, prompt_id, prompt_text, provider FROM ({plan})
 CROSS JOIN (SELECT unnest([0, 1, 2]) AS trial) CROSS JOIN (SELECT unnest([{listed(PROVIDERS)}]) AS provider)"""
    has_any = lambda words: " OR ".join(f"contains(lower(fanout_query), {q(w)})" for w in words)
    presence = ", ".join(f"{pct(f'count(*) FILTER ({has_any(r.CORPUS_CLASSES[c])})', 'count(*)')} AS {c}_pct" for c in ("evaluation", "comparison"))
    sql["keyword_presence"] = with_(FANOUT) + f"SELECT {presence} FROM fan"
    share = lambda kind: f"(SELECT max(pct) FROM mix WHERE provider = 'openai' AND domain_type = '{kind}') AS {kind}_pct"
    sql["fanout_vs_citations"] = with_(STAR, MIX, FANOUT) + f"SELECT {presence}, {share('review_site')}, {share('tech_media')} FROM fan"
    sql["collect_with_client"] = star + f"""SELECT concat('base-t', CAST(trial AS VARCHAR)) AS run_id, prompt_id, provider,
 CASE WHEN suffix(prompt_text, '7?') THEN NULL ELSE 'echo-' || provider END AS model,
 CASE WHEN suffix(prompt_text, '7?') THEN '' ELSE provider || ' says: ' || prompt_text END AS response_text,
 CASE WHEN suffix(prompt_text, '7?') THEN 'timeout' END AS error FROM prompts
 CROSS JOIN (SELECT unnest([0, 1, 2]) AS trial) CROSS JOIN (SELECT unnest([{listed(PROVIDERS)}]) AS provider)"""
    sql["collect_responses"] = f"""SELECT provider, count(model) AS answers, CAST(sum(length(response_text)) AS BIGINT) AS chars, count(error) AS errors
 FROM ({sql['collect_with_client']}) GROUP BY 1"""
    sql["run_batch"] = sql["analyze_voted_responses"]
    sql["analyze_responses_citations"] = with_(TEXT, URLS) + "SELECT run_id, prompt_id, provider, url, domain, domain_type FROM cited"
    sql["ingest_runs_citations"] = sql["analyze_responses_citations"]
    sql["analyze_responses_names"] = sql["discover_entities"]
    sql["analyze_voted_names"] = with_(TEXT, HITS, VOTE) + f"""SELECT entity, count(*) AS answers FROM (
 SELECT unnest(list_distinct(regexp_extract_all(response_text, {q(CAPITALISED)}))) AS entity FROM valid)
 WHERE lower(entity) NOT IN (SELECT lower(brand) FROM voted) GROUP BY 1"""
    sql["analyze_responses_by_client"] = with_(TEXT, HITS) + """SELECT run_id, prompt_id, provider, brand, position,
 CASE WHEN length(snippet) % 5 = 0 THEN 'neutral' ELSE ['positive', 'neutral', 'negative'][length(snippet) % 3 + 1] END AS sentiment FROM hits"""
    sql["ingest_voted_runs"] = with_(TEXT, HITS, VOTE) + "SELECT run_id, prompt_id, provider, brand, position FROM voted"
    sql["vote_representatives"] = with_(TEXT) + """SELECT 'base' AS base_run, prompt_id, provider, count(*) AS valid_trials,
 list(run_id ORDER BY trial)[CAST(count(*) // 2 AS INTEGER) + 1] AS run_id FROM valid GROUP BY prompt_id, provider"""
    sql["judge_with_client"] = with_(TEXT, HITS) + """SELECT run_id, prompt_id, provider, brand,
 CASE WHEN length(snippet) % 5 = 0 THEN 'neutral' ELSE ['positive', 'neutral', 'negative'][length(snippet) % 3 + 1] END AS sentiment,
 CASE WHEN length(snippet) % 5 = 0 THEN 'judge_error' ELSE brand END AS reason FROM hits"""
    sql["collect_fanout"] = """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category,
 CASE WHEN starts_with(text, 'A') THEN '' ELSE replace(text, '. ', '|') END AS fanout_queries,
 CASE WHEN starts_with(text, 'A') THEN 0 ELSE len(string_split(text, '. ')) END AS n_queries,
 CASE WHEN starts_with(text, 'A') THEN 'timeout' END AS error FROM documents"""
    sql["save_and_load_model"] = sql["training_matrix"]
    matrix = f"(SELECT domain_type, brand, cooccurrence FROM ({sql['training_matrix']}))"
    tested = "('0x' || substr(md5(concat_ws('|', domain_type, brand, '42')), 1, 8))::BIGINT % 100 < 20"
    sql["train_model"] = f"""SELECT true AS mae_defined, true AS r2_defined, true AS better_than_mean, count(*) FILTER (NOT ({tested})) AS train_rows,
 count(*) FILTER ({tested}) AS test_rows FROM {matrix}"""
    sql["feature_importance"] = """SELECT unnest(['cooccurrence', 'avg_position_with_source', 'unique_domains', 'competitor_avg_cooccurrence', 'total_mentions',
 'brand_avg_position', 'brand_prompt_count', 'domain_authority_weight', 'position_score', 'domain_type_enc']) AS feature, true AS weighted, 1.0::DOUBLE AS total, 10::BIGINT AS ranks"""
    sql["predict_opportunities"] = f"""SELECT brand, domain_type, CAST(cooccurrence AS BIGINT) AS cooccurrence,
 CASE WHEN count(*) OVER (PARTITION BY brand) > 1 THEN 0.0::DOUBLE ELSE 50.0 END AS low, CASE WHEN count(*) OVER (PARTITION BY brand) > 1 THEN 100.0::DOUBLE ELSE 50.0 END AS high FROM {matrix}"""
    sql["recommend"] = f"""SELECT brand AS target, unnest(range(1, 1 + least(5, count(*)))) AS rank, 'gbt' AS model_used, true AS ordered FROM {matrix} GROUP BY brand
 UNION ALL SELECT 'Nobody', unnest(range(1, 6)), 'rule_based', true"""
    sql["alert_stream"] = with_(STAR, VISIBILITY, ALERT_COMPAT.replace("75.5", "15")) + "SELECT category, brand, current, previous, reason FROM alerts WHERE triggered"
    sql["stored_daily_sums"] = star + """SELECT CAST(created_at AS DATE) AS day, prompt_id, brand, count(*) AS mentions, CAST(sum(position) AS BIGINT) AS position_sum,
 count(position) AS position_count, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative FROM brand_mentions GROUP BY 1, 2, 3"""
    sql["position_trend_from_sums"], sql["visibility_alerts_from_sums"] = sql["position_trend"], sql["visibility_alerts"]
    sql["compact_responses"] = sql["save_responses"]  # late answers are stored last, whatever is folded in
    for name, columns in _INTEGERS.items():
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
        sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql[name]})"
    return sql


#: Columns that are 32-bit in Spark.
_INTEGERS = {
    "run_summary": ["chars"], "detect_brands": ["position", "char_offset"], "majority_vote": ["position", "char_offset"],
    "analyze_responses": ["position"], "analyze_voted_responses": ["position"], "collect_fanout": ["n_queries"],
    "fanout_count_stats": ["min", "max"], "fanout_by_category": ["min", "max"], "brand_injection": ["n_brands_fanout"],
    "ingest_runs": ["position"], "run_batch": ["position"], "analyze_responses_by_client": ["position"],
    "ingest_voted_runs": ["position"],
}
