"""DuckDB SQL for the registered queries, written against the tables, not against the library."""

from __future__ import annotations

from quarry.functions import freshness, record
from quarry.functions.text import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '(\w)\s*&\s*(\w)', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def normal(x: str) -> str:
    return NORMAL.replace("{0}", x)


def tokens(x: str) -> str:
    return f"list_filter(string_split({normal(x)}, ' '), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"


TYPES = "['Refinish Operations', 'Body Operations', 'Paint Operations', 'Frame', 'Mechanical']"
MAKES = "['Ford', 'Land Rover', 'toyota', 'Mercedes Benz', 'HONDA', 'Alfa Romeo', 'Great Wall']"
MODELS = "['F150', 'Range Sport', 'Corolla', 'C 300', 'Civic', 'Giulia', 'H6']"
BODIES = "['Sedan', 'Pickup', 'SUV']"
AREA = "CASE lang WHEN 'en' THEN 'Front Bumper' WHEN 'de' THEN 'Rear Door' WHEN 'fr' THEN 'Roof' WHEN 'es' THEN 'Quarter Panel' END"
LABOUR = "CASE lower(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in record.LABOUR_OF_TYPE.items()) + " END"
STAMP, SEEN = "'2026-05-07T12:00:00.000Z'", "'2026-04-01T00:00:00.000Z'"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


DOCS = f"""docs AS (
  SELECT doc_id AS db_id, source, lang, n_chars, TRY_CAST(substr(source, 4) AS INTEGER) AS number, lines[1] AS first, lines[2] AS second,
    CASE WHEN len(lines) > 2 THEN array_to_string(lines[3:], chr(10)) END AS rest,
    epoch_ms(1420070400000 + (doc_id % 4000) * 86400000 + (doc_id % 86400) * 1000) AS at_,
    {TYPES}[(number % 5 + 1)::INT] AS kind, {MAKES}[(n_chars % 7 + 1)::INT] AS mk, {MODELS}[(n_chars % 7 + 1)::INT] AS md,
    {BODIES}[(n_chars % 3 + 1)::INT] AS bd, {AREA} AS area
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"""
CORPUS = DOCS + f""", corpus AS (
  SELECT db_id, db_id::VARCHAR AS id, concat_ws(': ', kind, area) AS title, 'https://inquiries.example/' || db_id || '/' AS url,
    ['CCC', 'Mitchell', 'Audatex'][(number % 4 + 1)::INT] AS ip, kind AS inquiry_type, area AS area_of_vehicle, (2005 + n_chars % 20)::INT AS vehicle_year,
    mk AS vehicle_make, md AS vehicle_model, bd AS body, {LABOUR.replace("{0}", "kind")} AS labor_type, first AS issue_summary, second AS suggested_action,
    rest AS resolution, CASE WHEN rest IS NULL THEN 'pending' ELSE 'resolved' END AS status, at_ AS submitted_at,
    CASE WHEN rest IS NOT NULL THEN at_ + to_days((1 + n_chars % 60)::INT) END AS resolved_at, '2026-05-0' || (1 + number % 6) AS seen
  FROM docs), c AS (SELECT *, coalesce(resolved_at, submitted_at) AS effective FROM corpus)"""
RAW = DOCS + f""", raw AS (
  SELECT db_id, ['CCC', 'Mitchell', 'Audatex', 'Other'][(number % 4 + 1)::INT] AS database, kind AS inquiry_type,
    CASE WHEN rest IS NOT NULL THEN 'Resolved (Final Response)' ELSE 'Submitted to IP' END AS status,
    CASE WHEN rest IS NOT NULL THEN 'resolved' ELSE 'pending' END AS resolution_status, (2005 + n_chars % 20)::INT AS year,
    string_split(mk, ' ')[1] AS make, concat_ws(' ', string_split(mk, ' ')[2], md) AS model, bd AS body, area AS area_of_vehicle, NULL::VARCHAR AS oem_part_number,
    nullif(first, '') AS issue_summary, second AS suggested_action,
    CASE WHEN rest IS NULL OR length(rest) < 40 THEN 'Awaiting resolution' ELSE rest END AS resolution,
    strftime(at_, '%Y-%m-%d') AS submission_date, CASE WHEN rest IS NOT NULL THEN strftime(at_ + to_days(30), '%Y-%m-%d') END AS resolution_date,
    strftime(at_, '%Y-%m-%d') || ' 09:30:00' AS submitted_datetime, 'https://inquiries.example/' || db_id || '/' AS source_url,
    CASE WHEN number <> 2 THEN {SEEN} END AS body_fetched_at, {SEEN} AS last_seen_at, NULL::VARCHAR AS content_hash,
    CASE WHEN source = 'src5' THEN {SEEN} END AS delisted_at, CASE WHEN source IN ('src4', 'src3') THEN {SEEN} END AS dead_suspected_at,
    CASE WHEN source = 'src3' THEN {SEEN} END AS dead_at, mk, md, bd, n_chars, kind, number, first, second, rest, area
  FROM docs WHERE lang IS NULL OR lang <> 'es')"""
FEED = """, feed AS (
  SELECT e.event_id AS pos, d.db_id, ['CCC', 'Mitchell', 'Audatex', 'Other'][(d.number % 4 + 1)::INT] AS database, d.kind AS inquiry_type,
    (2005 + n_chars % 20) || ' ' || mk || ' ' || md AS vehicle_data, (2005 + n_chars % 20)::INT AS year, mk AS make, md AS model,
    ['Submitted to IP', 'Resolved (IP Change)', 'Resolved (No IP Change)', 'Resolved (Final Response)', ' resolved (late) '][(k + 1)::INT] AS status,
    strftime(at_, '%Y-%m-%d') AS submission_date, CASE WHEN k > 0 THEN strftime(at_ + to_days(30), '%Y-%m-%d') ELSE '' END AS resolution_date
  FROM (SELECT *, (length(event_type) + user_id) % 5 AS k, event_id % (SELECT count(*) FROM documents) AS to_id FROM events) e
  JOIN docs d ON d.db_id = e.to_id WHERE d.source IS NULL OR d.source <> 'src7'),
live AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY pos DESC) = 1)"""
BOTH = RAW + FEED


def corpus(sql: str) -> str:
    return f"WITH {CORPUS} {sql}"


def raw(sql: str) -> str:
    return f"WITH {RAW} {sql}"


def both(sql: str) -> str:
    return f"WITH {BOTH} {sql}"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


HAY = r"lower(concat_ws(chr(32) || chr(10) || chr(32), title, issue_summary, suggested_action, resolution, inquiry_type, area_of_vehicle, vehicle_make, vehicle_model, body))"


def cover(words: list[str]) -> str:
    return "(" + " + ".join(f"contains({HAY}, {quoted(w)})::INT" for w in words) + f") / {float(len(words))}::DOUBLE"


def excerpt(needles: list[str]) -> str:
    found = []
    for field in ("issue_summary", "resolution", "suggested_action"):
        for needle in needles:
            at = f"instr(lower({field}), {quoted(needle)})" if needle else f"CASE WHEN {field} <> '' THEN 1 END"
            start, end = f"greatest(0, {at} - 61)", f"least(length({field}), {at} - 1 + {len(needle)} + 120)"
            cut = f"CASE WHEN {start} > 0 THEN '…' ELSE '' END || substr({field}, {start} + 1, {end} - {start}) || CASE WHEN {end} < length({field}) THEN '…' ELSE '' END"
            found.append(f"CASE WHEN {at} > 0 THEN {cut} END")
    head = "CASE WHEN issue_summary <> '' THEN substr(issue_summary, 1, 200) || CASE WHEN length(issue_summary) > 200 THEN '…' ELSE '' END END"
    return f"coalesce({', '.join([*found, head])})"


def searched(score: str, query: str, where: str, limit: int, offset: int = 0) -> str:
    return corpus(
        f"SELECT id, score, {iso('submitted_at')} AS submitted_at, {excerpt([query.lower()])} AS snippet FROM (SELECT *, {score} AS score FROM corpus) WHERE {where} ORDER BY score DESC, corpus_at DESC, db_id LIMIT {limit} OFFSET {offset}".replace(
            "corpus_at", "epoch_ms(submitted_at::TIMESTAMP)"
        ).replace("SELECT id, score, ", "SELECT id, score, ", 1)
    )


def support(tokens_: list[str], now: str, ip: str | None, year: int | None, make: str, model: str) -> str:
    """A CTE s with the parts of the score."""
    pairs = [f"{a} {b}" for a, b in zip(tokens_, tokens_[1:], strict=False)]
    body = normal("concat_ws(' ', issue_summary, suggested_action, resolution)")

    def share(needles: list[str]) -> str:
        return "(" + " + ".join(f"contains(hay, '{n}')::INT" for n in needles) + f") / {float(len(needles))}::DOUBLE" if needles else "0.0::DOUBLE"

    vehicle = " + ".join(
        ["0.0::DOUBLE"]
        + ([f"CASE WHEN vehicle_year = {year} THEN 0.1::DOUBLE ELSE 0 END"] if year else [])
        + ([f"CASE WHEN contains(lower(vehicle_make), '{make}') THEN 0.1::DOUBLE ELSE 0 END"] if make else [])
        + ([f"CASE WHEN contains(lower(vehicle_model), '{model}') THEN 0.1::DOUBLE ELSE 0 END"] if model else [])
    )
    operation = " OR ".join(f"contains(lower(inquiry_type), '{t}')" for t in tokens_)
    age = f"(epoch_ms(TIMESTAMP '{now}') - epoch_ms(effective))"
    provider = f"CASE WHEN ip = '{ip}' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END" if ip else "0.0::DOUBLE"
    return f""", s0 AS (SELECT *, {body} AS hay FROM c), s1 AS (SELECT *, {share(pairs)} AS bigram, {share(tokens_)} AS unigram FROM s0),
s2 AS (SELECT *, least(1.0::DOUBLE, bigram * 0.7::DOUBLE + unigram * 0.5::DOUBLE) AS text, {provider} AS ip_, least(0.3::DOUBLE, {vehicle}) AS vehicle,
  CASE WHEN {operation} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS operation, CASE WHEN {age} BETWEEN 0 AND 62208000000 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS recency FROM s1),
s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, text + ip_ + vehicle + operation + recency)) AS score FROM s2)"""


PARTS = "id, bigram, unigram, text, ip_ AS ip, vehicle, operation, recency, score"


def supported(tokens_: list[str], now: str, ip: str | None = None, year: int | None = None, make: str = "", model: str = "", where: str = "", more: str = "") -> str:
    return f"WITH {CORPUS}{more}{support(tokens_, now, ip, year, make, model)} SELECT {PARTS}, {excerpt(tokens_)} AS snippet FROM s {where} ORDER BY score DESC, effective DESC, db_id DESC LIMIT 20"


FIELDS = {"title": 8.0, "issue_summary": 4.0, "suggested_action": 3.0, "resolution": 4.0, "inquiry_type": 2.0, "area_of_vehicle": 1.0, "vehicle_make": 0.5, "vehicle_model": 0.5, "body": 0.5}


def terms(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


INDEX = (
    ", each AS ("
    + " UNION ALL ".join(f"SELECT db_id, unnest({terms(c)}) AS term, {w}::DOUBLE AS weight FROM corpus" for c, w in FIELDS.items())
    + "), post AS (SELECT term, db_id, sum(weight) AS f FROM each GROUP BY ALL), lens AS (SELECT db_id, "
    + " + ".join(f"len({terms(c)})" for c in FIELDS)
    + " AS n_tokens FROM corpus)"
)


def ranking(tokens_: list[str]) -> str:
    phrases = ", ".join(f"({i}, '{t}', {len(t) >= 3})" for i, t in enumerate(tokens_))
    return f"""{INDEX}, phrases(p, t, pre) AS (VALUES {phrases}),
per AS (SELECT p, db_id, sum(f) AS f FROM post JOIN phrases ON term = t OR (pre AND starts_with(term, t)) GROUP BY ALL),
freq AS (SELECT p, count(*) AS n FROM per GROUP BY p), whole AS (SELECT count(*) AS nd, avg(n_tokens) AS mean FROM lens),
weights AS (SELECT p, mean, CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) > 0 THEN ln((nd - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM freq, whole),
bm AS (SELECT db_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS rank FROM per JOIN weights USING (p) JOIN lens USING (db_id) GROUP BY db_id)"""


Q3 = ["thble", "ertion", "attion"]
POOL = ranking(Q3) + ", pool AS (SELECT db_id FROM (SELECT db_id FROM bm ORDER BY rank, db_id LIMIT 500) UNION SELECT db_id FROM (SELECT db_id FROM bm JOIN c USING (db_id) ORDER BY effective DESC, db_id DESC LIMIT 500))"
NEW = "SELECT db_id FROM live WHERE db_id NOT IN (SELECT db_id FROM raw)"
BARE = "trim(coalesce({0}, ''))"
CHANGED = "SELECT l.db_id FROM live l JOIN raw r USING (db_id) WHERE trim(coalesce(l.status, '')) <> trim(coalesce(r.status, '')) OR trim(coalesce(l.resolution_date, '')) <> trim(coalesce(r.resolution_date, ''))"
DELISTED = "SELECT db_id FROM raw WHERE delisted_at IS NULL AND db_id NOT IN (SELECT db_id FROM live)"
REAPPEARED = "SELECT db_id FROM raw WHERE delisted_at IS NOT NULL AND db_id IN (SELECT db_id FROM live)"
UNRESOLVED = "SELECT db_id FROM raw WHERE delisted_at IS NULL AND dead_at IS NULL AND (resolution_status = 'pending' OR status = 'Submitted to IP')"


def blank(today: str) -> str:
    return f"SELECT db_id FROM raw WHERE delisted_at IS NULL AND dead_at IS NULL AND lower(status) LIKE 'resolved%' AND (resolution IS NULL OR resolution IN ('', 'Awaiting resolution')) AND (resolution_date IS NULL OR resolution_date = '' OR resolution_date >= (DATE '{today}' - 365)::VARCHAR)"


SUSPECTED = "SELECT db_id FROM raw WHERE dead_suspected_at IS NOT NULL AND dead_at IS NULL"
TRAILING = "SELECT db_id FROM raw WHERE delisted_at IS NULL AND dead_at IS NULL ORDER BY db_id DESC LIMIT 300"
QUEUE = f"""SELECT 'new' AS pass, db_id FROM ({NEW}) UNION ALL
SELECT 'refresh', db_id FROM (({CHANGED}) UNION ({UNRESOLVED}) UNION ({blank("2026-05-07")}) UNION ({SUSPECTED}) UNION (SELECT db_id FROM ({TRAILING})))
WHERE db_id NOT IN ({DELISTED}) AND db_id NOT IN (SELECT db_id FROM raw WHERE dead_at IS NOT NULL) AND db_id NOT IN ({NEW})"""


def same(x: str) -> str:
    return rf"trim(regexp_replace(coalesce(({x})::VARCHAR, ''), '\s+', ' ', 'g'))"


def hashed(field) -> str:
    return "sha256(" + " || ".join(f"'{n}' || chr(30) || {same(field(n))} || chr(31)" for n in record.HASHED_FIELDS) + ")"


def differing(before, after) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {same(before(n))} <> {same(after(n))} THEN '{n}' END" for n in record.HASHED_FIELDS) + "], lambda x: x IS NOT NULL), ',')"


UP = """up AS (SELECT coalesce(r.db_id, l.db_id) AS db_id, CASE WHEN l.db_id IS NOT NULL THEN l.database ELSE r.database END AS database,
  CASE WHEN l.db_id IS NOT NULL THEN l.inquiry_type ELSE r.inquiry_type END AS inquiry_type, CASE WHEN l.db_id IS NOT NULL THEN l.status ELSE r.status END AS status,
  CASE WHEN l.db_id IS NOT NULL THEN CASE WHEN starts_with(lower(trim(l.status)), 'resolved') THEN 'resolved' ELSE 'pending' END ELSE r.resolution_status END AS resolution_status,
  coalesce(r.year, l.year) AS year, coalesce(r.make, l.make) AS make, coalesce(r.model, l.model) AS model,
  CASE WHEN l.db_id IS NOT NULL THEN l.resolution_date ELSE r.resolution_date END AS resolution_date,
  CASE WHEN l.db_id IS NOT NULL THEN 'https://inquiries.example/' || l.db_id || '/' ELSE r.source_url END AS source_url,
  CASE WHEN l.status <> r.status OR l.resolution_date <> r.resolution_date THEN NULL ELSE r.body_fetched_at END AS body_fetched_at,
  CASE WHEN l.db_id IS NOT NULL THEN '2026-05-07T12:00:00.000Z' ELSE r.last_seen_at END AS last_seen_at, r.issue_summary, r.suggested_action, r.resolution, r.area_of_vehicle,
  r.oem_part_number, r.body, r.submitted_datetime
  FROM raw r FULL OUTER JOIN live l ON r.db_id = l.db_id)"""
WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
PAGES = f"""pages_ AS (SELECT db_id, CASE WHEN n_chars % 9 = 0 THEN {TYPES}[((number + 1) % 5 + 1)::INT] ELSE kind END AS inquiry_type, area AS area_of_vehicle,
  {WS.replace("{0}", "first")} AS issue_summary, {WS.replace("{0}", "second")} AS suggested_action, coalesce(nullif({WS.replace("{0}", "rest")}, ''), 'Awaiting resolution') AS resolution,
  CASE WHEN {WS.replace("{0}", "rest")} = '' THEN 'pending' ELSE 'resolved' END AS resolution_status, (2005 + n_chars % 20)::INT AS year,
  CASE WHEN n_chars % 11 = 0 THEN 'unknown' ELSE mk END AS make, md AS model, bd AS body, strftime(at_, '%Y-%m-%d') || ' 09:30:00' AS submitted_datetime,
  CASE WHEN rest IS NOT NULL THEN 'Resolved (Final Response)' ELSE 'Submitted to IP' END AS status_raw FROM docs)"""
PROVIDER_COUNTS = {
    p: " + ".join(f"len(regexp_extract_all(x, {quoted(pattern)}))" for pattern in patterns) for p, patterns in record.TEXT_PROVIDERS.items()
}
PROVIDER = "CASE WHEN a > b AND a > g THEN 'CCC' WHEN b > a AND b > g THEN 'Mitchell' WHEN g > a AND g > b THEN 'Audatex' END"


def provider(select: str, rest: str) -> str:
    return f"SELECT {select}, {PROVIDER} AS ip FROM (SELECT *, {PROVIDER_COUNTS['CCC']} AS a, {PROVIDER_COUNTS['Mitchell']} AS b, {PROVIDER_COUNTS['Audatex']} AS g FROM ({rest}))"


MERGED = {
    "status": "r.status", "resolution_date": "r.resolution_date", "inquiry_type": "coalesce(p.inquiry_type, nullif(r.inquiry_type, ''))", "area_of_vehicle": "coalesce(p.area_of_vehicle, nullif(r.area_of_vehicle, ''))",
    "oem_part_number": "nullif(r.oem_part_number, '')", "issue_summary": "coalesce(p.issue_summary, nullif(r.issue_summary, ''))", "suggested_action": "coalesce(p.suggested_action, nullif(r.suggested_action, ''))",
    "resolution": "p.resolution", "year": "coalesce(p.year, r.year)",
    "make": r"CASE WHEN p.make IS NULL OR lower(trim(p.make)) IN ('', 'na', 'n/a', 'none', 'unknown', 'other', 'tbd') OR regexp_matches(p.make, '\b[0-9]{4}\b') OR length(trim(p.make)) > 20 THEN nullif(r.make, '') ELSE p.make END",
    "model": "coalesce(p.model, nullif(r.model, ''))", "body": "coalesce(p.body, nullif(r.body, ''))", "submitted_datetime": "coalesce(p.submitted_datetime, nullif(r.submitted_datetime, ''))",
}
SUSPECT = "coalesce(p.inquiry_type, '') = '' AND coalesce(p.area_of_vehicle, '') = '' AND p.issue_summary = '' AND p.suggested_action = '' AND p.resolution = 'Awaiting resolution' AND coalesce(r.inquiry_type, r.issue_summary, r.suggested_action, '') <> ''"
REFRESH = f"m AS (SELECT r.db_id, r.body_fetched_at, {', '.join(f'r.{n} AS r_{n}, {MERGED[n]} AS m_{n}' for n in record.HASHED_FIELDS)}, ({SUSPECT}) AS suspect FROM raw r JOIN pages_ p USING (db_id)), m2 AS (SELECT *, {hashed(lambda n: 'm_' + n)} AS h, {differing(lambda n: 'r_' + n, lambda n: 'm_' + n)} AS diff FROM m), m3 AS (SELECT *, CASE WHEN suspect THEN 'skipped' WHEN diff = '' THEN 'unchanged' ELSE 'written' END AS outcome FROM m2)"
ITEMS = """items AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS run_id, event_id AS db_id, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'refresh' END AS pass,
  CASE event_type WHEN 'purchase' THEN 'written' WHEN 'click' THEN 'unchanged' WHEN 'error' THEN 'queued' ELSE 'skipped' END AS state, 1 AS attempts,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 0 END AS changed,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 10 THEN 'status,resolution' WHEN value < 40 THEN 'resolution' ELSE 'make,model,body' END END AS changed_fields FROM events)"""
OUTCOMES = """outc AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS run_id, event_id AS seq, user_id AS db_id,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'view' THEN 302 ELSE 200 END AS http_status,
  CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'soft-404: redirect' ELSE 'parse error' END WHEN event_type = 'error' THEN 'transient' END AS reason FROM events)"""
STRIKES = """o1 AS (SELECT *, max(CASE WHEN http_status = 200 THEN seq END) OVER (PARTITION BY db_id) AS last_ok FROM outc),
st AS (SELECT db_id, count(*) FILTER (WHERE (http_status = 404 OR coalesce(starts_with(reason, 'soft-404'), FALSE)) AND seq > coalesce(last_ok, -1)) AS strikes, max(last_ok) IS NOT NULL AS cleared FROM o1 GROUP BY db_id)"""
REPAIRED = """SELECT db_id, CASE WHEN hit IS NOT NULL THEN make || ' ' || substr(model, 1, length(rest_)) ELSE make END AS make,
  CASE WHEN hit IS NOT NULL THEN nullif(trim(substr(model, length(rest_) + 1)), '') ELSE model END AS model, hit AS repaired
FROM (SELECT *, string_split(hit, ' ')[2] AS rest_ FROM (SELECT *, list_filter(['Land Rover', 'Mercedes Benz', 'Alfa Romeo', 'Aston Martin', 'Rolls Royce', 'Great Wall'],
  lambda f: lower(make) = lower(string_split(f, ' ')[1]) AND (lower(model) = lower(string_split(f, ' ')[2]) OR starts_with(lower(model), lower(string_split(f, ' ')[2]) || ' ')))[1] AS hit FROM raw))"""
SERVED = f"""served AS (SELECT *, CASE WHEN starts_with(coalesce(status, resolution_status), 'Resolved') THEN 'resolved' ELSE 'pending' END AS st,
  (submission_date)::TIMESTAMP AS sub, resolution_date::TIMESTAMP AS res, nullif(CASE WHEN resolution <> 'Awaiting resolution' THEN resolution END, '') AS real_,
  coalesce(nullif(issue_summary, ''), substr(nullif(suggested_action, ''), 1, 200) || CASE WHEN length(suggested_action) > 200 THEN '...' ELSE '' END,
    substr(CASE WHEN resolution <> 'Awaiting resolution' THEN nullif(resolution, '') END, 1, 200) || CASE WHEN length(resolution) > 200 THEN '...' ELSE '' END) AS issue,
  CASE WHEN delisted_at IS NOT NULL THEN 'delisted' WHEN dead_at IS NOT NULL THEN 'dead'
    WHEN issue IS NULL AND real_ IS NULL AND nullif(suggested_action, '') IS NULL THEN 'nothing to surface' ELSE 'served' END AS disposition FROM raw)"""
VALUE = "coalesce('''' || replace({0}, '''', '''''') || '''', 'NULL')"


def value(x: str) -> str:
    return VALUE.replace("{0}", x)


SIZES = "length('(' || concat_ws(', ', db_id::VARCHAR, " + ", ".join(value(x) for x in ("title", "issue_summary", "suggested_action", "resolution")) + ") || ')')"

ORACLES: dict[str, str] = {
    "text_normalize": f"SELECT doc_id, {normal('text')} AS normalised FROM documents",
    "text_tokenize": f"SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "text_bigrams": f"SELECT doc_id, len(b)::INT AS n_bigrams, array_to_string(b, '|') AS bigrams FROM (SELECT doc_id, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) AS b FROM (SELECT doc_id, {tokens('text')} AS t FROM documents))",
    "search_coverage": searched(cover(["thing", "ertion,", "the", "thble"]), "Thing ertion, the thble", "score > 0", 50),
    "search_browse": searched("1.0::DOUBLE", "", "TRUE", 50),
    "search_filtered": searched(cover(["the"]), "the", "score > 0 AND contains(lower(vehicle_make), 'rover') AND ip IS NULL AND status = 'resolved' AND contains(lower(inquiry_type), 'operations')", 50),
    "search_paged": searched(cover(["thing"]), "thing", "score > 0", 20, 20),
    "search_indexed": corpus("").rstrip() + ranking(Q3) + f" SELECT id, {cover(Q3)} AS score, round(rank, 9) AS rank FROM corpus JOIN bm USING (db_id) WHERE status = 'resolved' ORDER BY bm.rank, db_id LIMIT 20",
    "get_by_id": corpus(f"SELECT db_id, id, title, issue_summary, resolution, {iso('effective')} AS last_updated FROM c WHERE db_id = 42"),
    "list_recent": corpus(f"SELECT id, title, {iso('submitted_at')} AS submitted_at FROM c ORDER BY c.submitted_at DESC, db_id LIMIT 25"),
    "list_recent_since": corpus(f"SELECT id, title, {iso('submitted_at')} AS submitted_at FROM c WHERE c.submitted_at >= TIMESTAMP '2016-01-01' ORDER BY c.submitted_at DESC, db_id LIMIT 1000"),
    "find_supporting_scan": supported(Q3, "2026-05-07 12:00:00"),
    "find_supporting_all_scores": f"WITH {CORPUS}{support(['ri', 'thing', 'atti'], '2019-05-07 12:00:00', None, 2010, 'rover', 'range')} SELECT {PARTS} FROM s",
    "find_supporting_vehicle": supported(["thing"], "2026-05-07 12:00:00", None, 2011, "rover", "sport"),
    "find_supporting_ip": supported(["mitchell", "refinish", "thing", "erble"], "2020-05-07 12:00:00", "Mitchell"),
    "fts_match": corpus("").rstrip() + ranking(["ri", "thing", "atti"]) + " SELECT db_id FROM bm",
    "bm25_rank": corpus("").rstrip() + ranking(Q3) + " SELECT db_id, round(rank, 9) AS rank FROM bm",
    "postings": corpus("").rstrip() + INDEX + " SELECT term, db_id, f FROM post",
    "candidate_pool": corpus("").rstrip() + POOL + " SELECT db_id FROM pool",
    "find_supporting_two_arm": supported(Q3, "2026-05-07 12:00:00", where="WHERE db_id IN (SELECT db_id FROM pool)", more=POOL),
    "find_supporting_exact": supported(Q3, "2026-05-07 12:00:00"),
    "phrase_hits": f"WITH {CORPUS}{support(['ri', 'thing', 'atti'], '2019-05-07 12:00:00', None, None, '', '')} SELECT db_id, round(unigram * 3)::INT AS unigrams, round(bigram * 2)::INT AS bigrams FROM s WHERE unigram > 0 OR bigram > 0",
    "snippet_literal": corpus(f"SELECT id, {excerpt(['the thing'])} AS snippet FROM corpus"),
    "snippet_token": corpus(f"SELECT id, {excerpt(['attion', 'erble'])} AS snippet FROM corpus"),
    "citation": corpus("SELECT id, 'QIG #' || id || ' (' || strftime(effective, '%-m/%-d/%Y') || ')' AS short_form, concat_ws(', ', 'Quarry Inquiry Gateway inquiry #' || id, 'resolved ' || strftime(resolved_at, '%-m/%-d/%Y'), url) AS long_form FROM c"),
    "document_flatten": corpus(
        "SELECT id, concat_ws(chr(10) || chr(10), 'Inquiry: QIG #' || id, 'Information provider: ' || coalesce(ip, 'not identified'), 'Inquiry type: ' || inquiry_type, 'Area of vehicle: ' || area_of_vehicle, 'Vehicle: ' || concat_ws(' ', vehicle_year::VARCHAR, vehicle_make, vehicle_model, body), 'Status: ' || status, CASE WHEN trim(issue_summary) <> '' THEN 'Issue: ' || trim(issue_summary) END, CASE WHEN trim(suggested_action) <> '' THEN 'Suggested action: ' || trim(suggested_action) END, CASE WHEN trim(resolution) <> '' THEN 'Resolution: ' || trim(resolution) END) AS document FROM corpus"
    ),
    "corpus_freshness": corpus("SELECT strftime(max(effective), '%Y-%m-%d') AS current_through, max(seen) AS synced_at, count(*) AS record_count FROM c"),
    "freshness_pairs": corpus(", f AS (SELECT strftime(max(effective), '%Y-%m-%d') AS a, max(seen) AS b, count(*)::VARCHAR AS n FROM c) SELECT 'currentThrough' AS key, a AS value FROM f UNION ALL SELECT 'syncedAt', b FROM f UNION ALL SELECT 'recordCount', n FROM f"),
    "recency_intent": "SELECT conv_id, turn, ("
    + " OR ".join(f"regexp_matches(t, {quoted(p)})" for p in freshness.RECENT)
    + r" OR len(list_filter(regexp_extract_all(t, '\b(\d{4})\b', 1), lambda y: y::INT >= 2024)) > 0) AS asked FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)",
    "dedup_last_wins": both("SELECT db_id, pos, status, resolution_date, vehicle_data FROM live"),
    "cohort_new": both(NEW),
    "cohort_changed": both(CHANGED),
    "cohort_delisted": both(DELISTED),
    "cohort_reappeared": both(REAPPEARED),
    "unresolved_cohort": raw(UNRESOLVED),
    "resolved_blank_cohort": raw(blank("2016-06-01")),
    "suspected_cohort": raw(SUSPECTED),
    "trailing_window": raw(TRAILING),
    "sync_queue": both(QUEUE),
    "plan_sanity": both(
        f"SELECT held, live, max_id, delisted, live / held AS share, live / held >= 0.9 AS covered, delisted <= 50 AS bounded, live / held >= 0.9 AND delisted <= 50 AS ok FROM (SELECT (SELECT count(*) FROM raw WHERE delisted_at IS NULL) AS held, (SELECT count(*) FROM live) AS live, (SELECT max(db_id) FROM live) AS max_id, (SELECT count(*) FROM ({DELISTED})) AS delisted)"
    ),
    "gaps_below_high_water": both(f"SELECT db_id FROM ({NEW}) WHERE db_id <= (SELECT max(db_id) FROM raw)"),
    "queued_items": f"WITH {ITEMS} SELECT run_id, pass, count(*) AS n FROM items WHERE state = 'queued' GROUP BY ALL",
    "find_baseline": corpus(f"SELECT id, score AS confidence, {excerpt(['thing the'])} AS snippet FROM (SELECT *, {cover(['thing', 'the'])} AS score FROM corpus WHERE vehicle_year = 2011 AND contains(lower(vehicle_make), 'rover') AND contains(lower(vehicle_model), 'sport')) WHERE score > 0 ORDER BY score DESC, submitted_at DESC, db_id LIMIT 20"),
    "queue_estimate": both(f"SELECT pass, count(*) AS n, round(count(*) * 2 / 60)::BIGINT AS minutes, ceil(count(*) / 500)::BIGINT AS batches FROM ({QUEUE}) GROUP BY pass"),
    "upsert_metadata": both(", " + UP + " SELECT db_id, database, status, resolution_status, year, make, model, resolution_date, source_url, body_fetched_at, last_seen_at, issue_summary FROM up"),
    "delist_stamp": both(f"SELECT db_id, CASE WHEN db_id IN ({DELISTED}) THEN {STAMP} WHEN db_id IN ({REAPPEARED}) THEN NULL ELSE delisted_at END AS delisted_at FROM raw"),
    "html_detail_parse": f"WITH {DOCS}, {PAGES} SELECT db_id, inquiry_type, coalesce(area_of_vehicle, '') AS area_of_vehicle, NULL::VARCHAR AS oem_part_number, issue_summary, suggested_action, resolution, resolution_status, year, make, model, body, submitted_datetime, status_raw FROM pages_",
    "html_detail_record": f"WITH {DOCS}, {PAGES}, t AS (SELECT *, concat_ws(chr(10), CASE WHEN resolution_status = 'resolved' THEN resolution END, nullif(issue_summary, ''), nullif(suggested_action, '')) AS x FROM pages_) "
    + provider(
        f"db_id, concat_ws(' ', year::VARCHAR, make, model) || ' — ' || concat_ws(': ', inquiry_type, area_of_vehicle) AS title, {LABOUR.replace('{0}', 'inquiry_type')} AS labor_type, CASE WHEN starts_with(lower(status_raw), 'resolved') THEN 'resolved' ELSE 'pending' END AS status, {iso('submitted_datetime::TIMESTAMP')} AS submitted_at, {iso('submitted_datetime::TIMESTAMP')} AS last_updated",
        "SELECT * FROM t",
    ),
    "backfill_merge": raw(f", {PAGES} SELECT r.db_id, coalesce(r.inquiry_type, p.inquiry_type) AS inquiry_type, coalesce(r.make, p.make) AS make, coalesce(r.model, p.model) AS model, p.issue_summary, p.resolution, p.resolution_status, p.submitted_datetime, {STAMP} AS body_fetched_at FROM raw r JOIN pages_ p USING (db_id)"),
    "refresh_merge": raw(
        f", {PAGES}, {REFRESH} SELECT db_id, outcome, CASE WHEN outcome = 'written' THEN diff END AS changed_fields, "
        + ", ".join(f"CASE WHEN outcome = 'written' THEN m_{n} ELSE r_{n} END AS {n}" for n in ("inquiry_type", "make", "model", "issue_summary", "suggested_action", "resolution"))
        + f", CASE WHEN outcome <> 'skipped' THEN h END AS content_hash, CASE WHEN outcome = 'written' THEN {STAMP} ELSE body_fetched_at END AS body_fetched_at FROM m3"
    ),
    "repair_makes": raw(REPAIRED),
    "repaired_by_make": raw(f"SELECT repaired, count(*) AS n FROM ({REPAIRED}) WHERE repaired IS NOT NULL GROUP BY repaired"),
    "content_hash": raw(f"SELECT db_id, {hashed(lambda n: n)} AS content_hash FROM raw"),
    "field_diff": both(f", {UP} SELECT r.db_id, {differing(lambda n: 'r.' + n, lambda n: 'u.' + n)} AS changed_fields FROM raw r JOIN up u ON r.db_id = u.db_id"),
    "change_histogram": f"WITH {ITEMS} SELECT field, count(*) AS n FROM (SELECT unnest(string_split(changed_fields, ',')) AS field FROM items WHERE pass = 'refresh' AND changed = 1) WHERE field <> '' GROUP BY field",
    "run_summary": f"WITH {ITEMS} SELECT run_id, "
    + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ("written", "unchanged", "skipped", "queued"))
    + ", count(*) AS total FROM items GROUP BY run_id",
    "record_outcomes": f"WITH {ITEMS}, {OUTCOMES} SELECT i.run_id, i.db_id, CASE WHEN o.http_status >= 500 THEN i.state WHEN o.http_status = 200 THEN 'unchanged' ELSE 'skipped' END AS state, 2 AS attempts, o.http_status, o.reason, 0 AS changed FROM items i JOIN outc o ON i.run_id = o.run_id AND i.db_id = o.seq",
    "queue_enqueue": both(
        f", {ITEMS}, q AS ({QUEUE}) SELECT run_id, db_id, pass, state, attempts FROM items WHERE run_id = 19723 UNION ALL SELECT 19723, db_id, pass, 'queued', 0 FROM q WHERE db_id NOT IN (SELECT db_id FROM items WHERE run_id = 19723)"
    ),
    "status_counts": raw("SELECT count(*) FILTER (WHERE resolution_status = 'resolved') AS resolved, count(*) FILTER (WHERE resolution_status = 'pending') AS pending, count(*) AS total FROM raw"),
    "non_delisted": raw("SELECT count(*) AS n FROM raw WHERE delisted_at IS NULL"),
    "pending_bodies": raw("SELECT db_id FROM raw WHERE body_fetched_at IS NULL"),
    "high_water": raw("SELECT coalesce(max(db_id), 0) AS high_water, 'derived' AS provenance FROM raw"),
    "freq_by_ip": corpus("SELECT coalesce(ip, 'unknown') AS value, count(*) AS n FROM corpus GROUP BY 1"),
    "freq_by_make": corpus("SELECT coalesce(vehicle_make, 'unknown') AS value, count(*) AS n FROM corpus GROUP BY 1"),
    "freq_by_type": corpus("SELECT coalesce(inquiry_type, 'unknown') AS value, count(*) AS n FROM corpus GROUP BY 1"),
    "corpus_span": corpus(f"SELECT count(*) AS n, {iso('min(submitted_at)')} AS first_at, {iso('max(submitted_at)')} AS last_at FROM corpus"),
    "corpus_positions": corpus("SELECT place, id FROM (SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS n FROM corpus) WHERE place IN (1, n // 2 + 1, n)"),
    "transform_served": raw(
        f", {SERVED} SELECT db_id, db_id::VARCHAR AS id, coalesce(nullif(inquiry_type, '') || ': ' || nullif(area_of_vehicle, ''), nullif(inquiry_type, ''), substr(nullif(issue_summary, ''), 1, 80) || CASE WHEN length(issue_summary) > 80 THEN '...' ELSE '' END, 'Inquiry ' || db_id) AS title, source_url AS url, CASE WHEN database IN ('CCC', 'Mitchell', 'Audatex') THEN database END AS ip, inquiry_type, year AS vehicle_year, make AS vehicle_make, issue AS issue_summary, suggested_action, CASE WHEN NOT (st = 'resolved' AND resolution = 'Awaiting resolution') THEN nullif(resolution, '') END AS resolution, st AS status, {iso('sub')} AS submitted_at, {iso('res')} AS resolved_at, {iso('coalesce(res, sub)')} AS last_updated FROM served WHERE disposition = 'served'"
    ),
    "transform_dispositions": raw(f", {SERVED} SELECT disposition, count(*) AS n, count(*) FILTER (WHERE nullif(issue_summary, '') IS NULL AND issue IS NOT NULL) AS derived FROM served GROUP BY disposition"),
    "served_diff": raw(f", {SERVED} SELECT db_id, 'removed' AS change FROM docs WHERE db_id NOT IN (SELECT db_id FROM served WHERE disposition = 'served')"),
    "load_values": corpus(f"SELECT db_id, '(' || concat_ws(', ', db_id::VARCHAR, {value('id')}, {value('title')}, {value('ip')}, vehicle_year::VARCHAR, {value('issue_summary')}, {value(iso('submitted_at'))}) || ')' AS \"values\" FROM corpus"),
    "load_sizes": corpus(f"SELECT count(*) AS n, sum(s)::BIGINT AS characters, max(s) AS longest FROM (SELECT {SIZES} AS s FROM corpus)"),
    "vehicle_parse": both("SELECT db_id, vehicle_data, year, make, model FROM live"),
    "classify_ip": provider("doc_id", "SELECT doc_id, concat_ws(' ', text, ['MOTOR and P-Pages', 'mitchell dbrm', 'Qapter, Mitchell', 'DBRM section; Solera'][(doc_id % 5 + 1)::INT]) AS x FROM documents"),
    "section_parse": corpus(f"SELECT db_id, nullif({WS.replace('{0}', 'issue_summary')}, '') AS a, nullif({WS.replace('{0}', 'suggested_action')}, '') AS suggested_action, area_of_vehicle, coalesce(a, 'again') AS issue_summary FROM corpus").replace("SELECT db_id, nullif", "SELECT * EXCLUDE (a) FROM (SELECT db_id, nullif", 1) + ")",
    "lenient_ids": r"SELECT doc_id, TRY_CAST(regexp_extract(coalesce(['', '  ', '+', '-', 'x'][(doc_id % 6 + 1)::INT] || doc_id || 'x', ''), '^\s*([+-]?[0-9]{1,18})', 1) AS BIGINT) AS number FROM documents",
    "implausible_makes": raw(
        r"SELECT db_id, (lower(trim(x)) IN ('', 'na', 'n/a', 'none', 'unknown', 'other', 'tbd') OR regexp_matches(x, '\b[0-9]{4}\b') OR length(trim(x)) > 20) AS implausible FROM (SELECT db_id, concat_ws(' ', CASE WHEN year < 2008 THEN year::VARCHAR END, nullif(make, 'Ford'), CASE WHEN year > 2020 THEN 'with a long tail of words' END) AS x FROM raw)"
    ),
    "circuit_breaker": f"WITH {OUTCOMES}, a AS (SELECT *, (http_status = 0 OR http_status = 429 OR http_status >= 500) AS bad FROM outc), b AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM a), e AS (SELECT *, sum(bad::INT) OVER (PARTITION BY run_id, island ORDER BY seq) AS in_row FROM b) SELECT run_id, min(seq) FILTER (WHERE in_row >= 3) AS stopped_at, max(in_row)::BIGINT AS longest FROM e GROUP BY run_id",
    "dead_two_strike": f"WITH {OUTCOMES}, {STRIKES} SELECT db_id, CASE WHEN strikes = 0 THEN 'alive' WHEN strikes = 1 THEN 'suspected' ELSE 'dead' END AS state, strikes, cleared FROM st",
    "dead_marks": raw(
        f", {OUTCOMES}, {STRIKES} SELECT r.db_id, CASE WHEN s.strikes IS NULL THEN dead_suspected_at WHEN cleared THEN CASE WHEN strikes > 0 THEN {STAMP} END WHEN strikes > 0 THEN coalesce(dead_suspected_at, {STAMP}) ELSE dead_suspected_at END AS dead_suspected_at, CASE WHEN s.strikes IS NULL THEN dead_at WHEN cleared THEN CASE WHEN strikes > 1 THEN {STAMP} END WHEN strikes > 0 AND strikes + (dead_suspected_at IS NOT NULL)::INT > 1 THEN coalesce(dead_at, {STAMP}) ELSE dead_at END AS dead_at FROM raw r LEFT JOIN st s USING (db_id)"
    ),
    "served_readback": corpus("SELECT db_id, ip, CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'pending' END AS status, labor_type FROM corpus"),
}

SHORT_FORM = "'QIG #' || id || ' (' || strftime(effective, '%-m/%-d/%Y') || ')'"
LONG_FORM = "concat_ws(', ', 'Quarry Inquiry Gateway inquiry #' || id, 'resolved ' || strftime(resolved_at, '%-m/%-d/%Y'), url)"
RUNS = f"""{ITEMS}, runs AS (SELECT run_id, CASE WHEN bool_or(state = 'queued') THEN 'running' ELSE 'completed' END AS status, max(db_id) AS index_max_db_id, count(*) AS index_count FROM items GROUP BY run_id)"""
COHORTS = {"new": "cohort_new", "gaps": "gaps_below_high_water", "changed": "cohort_changed", "unresolved": "unresolved_cohort", "suspected": "suspected_cohort", "trailing": "trailing_window", "delisted": "cohort_delisted", "reappeared": "cohort_reappeared", "queue": "sync_queue"}
ROW = [
    "db_id::VARCHAR", *[value(x) for x in ("id", "id", "title", "url", "ip", "inquiry_type", "area_of_vehicle")], "vehicle_year::VARCHAR",
    *[value(x) for x in ("vehicle_make", "vehicle_model", "body", "labor_type", "issue_summary", "suggested_action", "resolution", "status")],
    value(iso("submitted_at")), value(iso("resolved_at")), value(iso("effective")), value("'{\"lastSeenAt\":\"' || seen || 'T08:00:00.000Z\"}'"),
]
COLUMNS = "db_id, id, inquiry_number, title, url, ip, inquiry_type, area_of_vehicle, vehicle_year, vehicle_make, vehicle_model, body, labor_type, issue_summary, suggested_action, resolution, status, submitted_at, resolved_at, last_updated, metadata"
HEAD_CHARS = len(f"INSERT INTO inquiry ({COLUMNS}) VALUES\n")

ORACLES |= {
    "corpus_count": "SELECT count(*) AS n FROM documents",
    "search_payload": ORACLES["search_coverage"].replace(f"SELECT id, score, {iso('submitted_at')} AS submitted_at,", f"SELECT id, title, url, score, status, {SHORT_FORM.replace('effective', 'coalesce(resolved_at, submitted_at)')} AS citation,", 1),
    "support_payload": ORACLES["find_supporting_vehicle"].replace(f"SELECT {PARTS},", f"SELECT id, score AS confidence, bigram, unigram, text, ip_ AS ip, vehicle, operation, recency, score AS total, vehicle_year, vehicle_make, vehicle_model, {SHORT_FORM} AS citation,", 1),
    "connector_documents": ORACLES["document_flatten"].replace("SELECT id,", f"SELECT id, title, url, {SHORT_FORM.replace('effective', 'coalesce(resolved_at, submitted_at)')} AS citation, {LONG_FORM} AS citation_long, ip, status, inquiry_type, area_of_vehicle, vehicle_year, vehicle_make, vehicle_model, {iso('submitted_at')} AS submitted_at, {iso('resolved_at')} AS resolved_at,", 1).replace("AS document", "AS text"),
    "cohort_report": " UNION ALL ".join(f"SELECT '{name}' AS cohort, count(*) AS n, min(db_id) AS first_id, max(db_id) AS last_id FROM ({ORACLES[q]})" for name, q in COHORTS.items()) + f" UNION ALL SELECT 'blank', count(*), min(db_id), max(db_id) FROM ({raw(blank('2025-05-07'))})",
    "skipped_items": f"WITH {ITEMS} SELECT db_id, 200 AS http_status, NULL::VARCHAR AS reason FROM items WHERE run_id = 19723 AND state = 'skipped' ORDER BY db_id LIMIT 25",
    "first_ids": "SELECT doc_id AS db_id FROM documents ORDER BY 1 LIMIT 5",
    "queue_order": f"WITH {ITEMS} SELECT run_id, db_id, pass FROM items WHERE state = 'queued' ORDER BY pass <> 'new', db_id LIMIT 500",
    "key_value_upsert": "SELECT coalesce(n.source, h.source) AS key, coalesce(n.top, h.top)::VARCHAR AS value FROM (SELECT source, max(doc_id) AS top FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL GROUP BY source) h FULL JOIN (SELECT source, max(doc_id) AS top FROM documents WHERE lang = 'en' AND source IS NOT NULL GROUP BY source) n ON h.source = n.source",
    "run_lifecycle": f"WITH {RUNS} SELECT run_id, CASE WHEN run_id = 19723 THEN {STAMP} END AS finished_at, 'nightly' AS mode, 300 AS refresh_window, index_max_db_id, index_count, CASE WHEN run_id = 19723 THEN 'interrupted' ELSE status END AS status FROM runs UNION ALL SELECT max(run_id) + 1, NULL, 'catchup', 1000, 90, 80, 'running' FROM runs",
    "resumable_run": f"WITH {RUNS} SELECT run_id, status FROM runs WHERE status = 'running' ORDER BY run_id DESC LIMIT 1",
    "high_water_advance": f"WITH {RUNS}, l AS (SELECT count(*) FILTER (WHERE state = 'queued') AS n FROM items WHERE run_id = 19723 AND pass = 'new'), t AS (SELECT index_max_db_id::VARCHAR AS top FROM runs WHERE run_id = 19723) SELECT 'other' AS key, 'x' AS value, unnest([FALSE, TRUE]) AS drained UNION ALL SELECT 'last_id', coalesce(CASE WHEN d OR (SELECT n FROM l) = 0 THEN (SELECT top FROM t) END, '5'), d FROM (SELECT unnest([FALSE, TRUE]) AS d)",
    "release_dates": f"WITH {DOCS} SELECT db_id, {iso('r')} AS resolved_at, {iso('coalesce(r, s)')} AS last_updated FROM (SELECT db_id, CASE WHEN db_id % 3 <> 0 THEN make_timestamp(2025, db_id % 12 + 1, db_id % 28 + 1, 0, 0, 0.0) END AS r, date_trunc('day', at_) + INTERVAL '9 hours 30 minutes' AS s FROM docs)",
    "transform_errors": raw(f", {SERVED} SELECT db_id, concat_ws('; ', CASE WHEN db_id % 7 < 2 THEN 'url is no address' END, CASE WHEN db_id % 5 = 0 THEN 'ip is not listed' END) AS issue FROM served WHERE disposition = 'served' AND (db_id % 7 < 2 OR db_id % 5 = 0)"),
    "load_statements": f"WITH RECURSIVE {CORPUS}, v AS (SELECT db_id // 500 AS lane, row_number() OVER (PARTITION BY db_id // 500 ORDER BY db_id) AS i, length('(' || concat_ws(', ', {', '.join(ROW)}) || ')') + 2 AS n FROM c), p AS (SELECT lane, i, {HEAD_CHARS} + n AS size, 0 AS number FROM v WHERE i = 1 UNION ALL SELECT v.lane, v.i, CASE WHEN p.size + v.n > 80000 THEN {HEAD_CHARS} + v.n ELSE p.size + v.n END, CASE WHEN p.size + v.n > 80000 THEN p.number + 1 ELSE p.number END FROM p JOIN v ON v.lane = p.lane AND v.i = p.i + 1) SELECT lane::BIGINT AS lane, number::INT AS number, (max(size) - 1)::INT AS size FROM p GROUP BY ALL",
}
ORACLES |= {
    "row_readback": corpus(f"SELECT db_id, ip, status, {iso('submitted_at')} AS submitted_at, {iso('resolved_at')} AS resolved_at, seen || 'T08:00:00.000Z' AS seen FROM corpus"),
    "scraped_pages": f"SELECT db_id, CASE WHEN db_id % 5 <> 0 THEN title END AS title, CASE WHEN db_id % 5 = 0 THEN 404 END AS http_status FROM ({ORACLES['html_detail_record']})",
}
ORACLES |= {
    "load_refusals": "SELECT doc_id AS db_id, CASE WHEN doc_id % 11 = 0 THEN 'control character' ELSE 'transaction phrase' END AS reason FROM documents WHERE doc_id % 11 < 2",
    "since_beyond_end": corpus("SELECT db_id, coalesce(CASE WHEN db_id % 9 <> 0 THEN strftime(submitted_at + to_days(60), '%Y-%m-%d') END > (SELECT strftime(max(effective), '%Y-%m-%d') FROM c), FALSE) AS beyond FROM c"),
    "postings_updated": corpus("").rstrip() + ", was AS (SELECT * FROM corpus)" + INDEX.replace("FROM corpus", "FROM now_").replace(", each AS", ", now_ AS (SELECT * REPLACE (CASE WHEN db_id % 3 = 0 THEN 'Amended ' || title ELSE title END AS title) FROM was WHERE db_id % 7 <> 0), each AS", 1) + " SELECT term, db_id, f FROM post",
}
