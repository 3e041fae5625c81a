"""The derivation of ``adapter`` and the features again, as DuckDB SQL views.

Formulated differently from the Spark code where that is possible: ordered
firsts by ``row_number``, working days by listing days, rates as a table.
"""

from __future__ import annotations

import re

from checks import adapter
from deskgauge import constants as K

NOW = f"TIMESTAMP '{adapter.AS_OF}'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(text(i) if isinstance(i, str) else str(i) for i in items)


def listed(items) -> str:
    return "[" + ", ".join("NULL" if i is None else text(i) if isinstance(i, str) else str(i)
                           for i in items) + "]"


def local(column: str) -> str:
    return f"timezone('{K.LOCAL_ZONE}', timezone('UTC', {column}))"


def minutes(start: str, end: str = NOW) -> str:
    return f"CAST(round_even(date_diff('microsecond', {start}, {end}) / 6e7, 0) AS BIGINT)"


def days(minute_column: str) -> str:
    return f"CAST(floor({minute_column} / 1440.0) AS BIGINT)"


def plus_business_days(wall: str, count: int) -> str:
    day = f"CAST({wall} AS DATE)"
    return (f"(list_filter(generate_series({day} + 1, {day} + 12, INTERVAL 1 DAY), "
            f"lambda x: isodow(x) < 6)[{count}] + ({wall} - date_trunc('day', {wall})))")


def business_days(first: str, last: str) -> str:
    start = (f"CASE WHEN isodow({first}) > 5 THEN {first} + to_days(CAST(8 - isodow({first}) AS INTEGER)) "
             f"ELSE {first} END")
    end = (f"CASE WHEN isodow({first}) < 6 AND isodow({last}) > 5 "
           f"THEN {last} - to_days(CAST(isodow({last}) - 5 AS INTEGER)) ELSE {last} END")
    return (f"coalesce(len(list_filter(generate_series({start}, {end}, INTERVAL 1 DAY), "
            f"lambda x: isodow(x) < 6)), 0)")


def found(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {text(pattern)}, 'i'), false)"


def pick(selector: str, items) -> str:
    pairs = items.items() if isinstance(items, dict) else enumerate(items)
    branches = " ".join(
        f"WHEN {key} THEN {'NULL' if value is None else text(value) if isinstance(value, str) else value}"
        for key, value in pairs)
    return f"CASE {selector} {branches} END"


def location(column: str) -> str:
    branches = " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in K.LOCATIONS.items())
    return f"coalesce(CASE {column} {branches} END, {column}, {text(K.FILL_LOCATION)})"


def title(column: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({column}, "
            r"'[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+'), "
            "lambda s: upper(left(s, 1)) || lower(substr(s, 2))), '')")


def _rates(rates: dict, reason: str, with_base: bool) -> str:
    rows = []
    for (urgency, kind), (base, per_day) in rates.items():
        lead = f"{base} base + " if with_base and urgency != K.URGENCY_NORMAL else "+"
        name = f"{K.TICKET_TYPE_NAMES[kind]}-{K.URGENCY_NAMES[urgency]}"
        rows.append(f"({urgency}, {kind}, {base}, {per_day}, "
                    f"{text(f'{lead}{per_day} pt/jour pour {name} {reason}')})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(urgency, kind, base, per_day, words)"


_LOCATION_KEYS = (*K.LOCATIONS, None, adapter.UNKNOWN_SITE, adapter.UNKNOWN_SITE)
_ARRIVAL = (f"SD_CATALOG_ID = {K.CATALOG_NEW_ARRIVAL} AND RFC_NUMBER IS NOT NULL "
            f"AND STATUS_ID NOT IN ({values(K.STATUS_CLOSED)})")
_CONTACT = found("label", K.PATTERN_CONTACT)
_LOCAL_START = local("start")
_LOCAL_NOW = local(NOW)

SECURITY = f"(coalesce(ci_id IN ({values(K.CI_ID_SECURITY)}), false) OR {found('comment', K.PATTERN_SECURITY)})"
INDUSTRIAL = f"(coalesce(ci IN ({values(K.CI_INDUSTRIAL)}), false) OR {found('comment', K.PATTERN_INDUSTRIAL)})"
VIP = f"(requestor IN ({values(adapter.VIP_NAMES)}) OR recipient IN ({values(adapter.VIP_NAMES)}))"
UNSUSPENDED = f"status NOT IN ({values(K.STATUS_SUSPENDED)})"
PROXY = "itype BETWEEN 3 AND 16"
SEGMENTS = {
    "hotline": "itype = 2", "proxy": PROXY, "unclassified": "itype = 1",
    "incident": "kind = 0", "request": "kind = 1",
    "incident+hotline": "kind = 0 AND itype = 2", "incident+proxy": f"kind = 0 AND {PROXY}",
    "request+hotline": "kind = 1 AND itype = 2", "request+proxy": f"kind = 1 AND {PROXY}",
}

VIEWS: dict[str, str] = {
    # raw tickets and actions
    "rt": f"""
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE 'I' END
                 || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS rfc,
               o_orderdate + to_minutes(o_orderkey % 1440) AS submitted,
               o_orderdate + to_days(CAST(60 + o_orderkey % 90 AS INTEGER)) AS due,
               CAST({pick('o_orderkey % 9', adapter.STATUSES)} AS BIGINT) AS status,
               CAST(left(o_orderpriority, 1) AS BIGINT) AS urgency,
               CASE WHEN left(o_orderpriority, 1) <> '4' THEN o_orderpriority END AS urgency_name,
               CAST(CASE o_orderkey % 20 WHEN 0 THEN 5535 WHEN 1 THEN 5687 WHEN 2 THEN 5564
                    ELSE 1000 END AS BIGINT) AS catalog_id,
               CAST(CASE o_orderkey % 50 WHEN 0 THEN 9926 WHEN 1 THEN 8696
                    ELSE o_orderkey % 50 END AS BIGINT) AS ci_id,
               {pick('o_orderkey % 40', adapter.CI_NAMES)} AS ci,
               CASE WHEN o_orderkey % 25 < {len(adapter.COMMENTS)}
                    THEN {pick('o_orderkey % 25', adapter.COMMENTS)}
                    ELSE '<b>écran</b> noir' END AS raw_comment,
               'Customer#' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0') AS requestor,
               c_name AS raw_recipient,
               {listed(_LOCATION_KEYS)}[o_orderkey % 30 + 1] AS raw_location
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ra": f"""
        SELECT l_orderkey * 10 + l_linenumber AS action_id, l_orderkey AS id,
               CAST(l_linenumber AS BIGINT) AS n,
               CASE WHEN l_orderkey % 4 = 0 THEN 'D' ELSE 'I' END
                 || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS rfc,
               CAST({pick('l_linenumber', adapter.ACTION_TYPES)} AS BIGINT) AS type_id,
               coalesce({pick(pick('l_linenumber', adapter.ACTION_TYPES), adapter.LABELS)},
                        'Traitement') AS label,
               CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN max(l_shipdate)
                 + to_minutes((7 * l_orderkey + 131 * l_linenumber) % 1440) END AS start,
               min(l_suppkey) AS supplier,
               CASE WHEN (l_orderkey + 2 * l_linenumber) % 5 <> 0
                    THEN 'Supplier#' || lpad(CAST(min(l_suppkey) AS VARCHAR), 9, '0') END AS raw_done_by,
               CASE WHEN (l_orderkey + l_linenumber) % 2 <> 0 THEN 'Hotline' END AS raw_group,
               CASE WHEN l_linenumber = 6 THEN {pick('l_orderkey % 5', adapter.NOTES)} END AS note
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "cl": """
        SELECT o_orderkey AS id, 1 + o_custkey % 16 AS itype,
               CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE 'I' END
                 || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS rfc
        FROM orders WHERE o_orderkey % 7 <> 0""",
    "ty": """
        SELECT CAST(range AS BIGINT) AS type_id, 'Type ' || CAST(range AS VARCHAR) AS type_name
        FROM range(1, 17)""",
    "an": """
        SELECT id, rfc, catalog_id, CAST(q.question AS BIGINT) AS question, q.raw, q.answer FROM (
            SELECT id, rfc, catalog_id, unnest([
                {'question': 45, 'raw': NULL, 'answer': 'dupont ' || CAST(id AS VARCHAR)},
                {'question': 46, 'raw': NULL, 'answer': 'jean-pierre'},
                {'question': 48, 'raw': NULL, 'answer': raw_location},
                {'question': 49, 'raw': NULL, 'answer': 'CDI'},
                {'question': 50, 'raw': NULL, 'answer': strftime(submitted, '%d/%m/%Y')},
                {'question': 55, 'raw': NULL,
                 'answer': CASE WHEN id % 40 = 0 THEN 'Non' ELSE 'Oui' END},
                {'question': 58, 'raw': CASE WHEN id % 3 = 1 THEN 'Non' END,
                 'answer': CASE WHEN id % 3 = 0 THEN 'Oui' END}
            ]) AS q FROM rt WHERE catalog_id = 5535)""",
    # cleaned
    "t": f"""
        SELECT id, rfc, submitted, due, status, 'Statut ' || CAST(status AS VARCHAR) AS status_name,
               urgency, coalesce(urgency_name, '{K.FILL_URGENCY}') AS urgency_name, catalog_id,
               ci_id, ci, requestor, strip_accents(coalesce(raw_recipient, '{K.FILL_NAME}')) AS recipient,
               coalesce(raw_location, '{K.FILL_LOCATION}') AS location,
               regexp_replace(regexp_replace(
                   CASE WHEN raw_comment = 'N/A' OR contains(raw_comment, '<NA>') THEN NULL
                        ELSE raw_comment END, '<[^<]+?>', '', 'g'), 'bonjour.?', '', 'gi') AS comment,
               CASE WHEN rfc LIKE 'D%' THEN 1 ELSE 0 END AS kind,
               CASE WHEN rfc LIKE 'D%' THEN 'Demande' ELSE 'Incident' END AS kind_name
        FROM rt WHERE id NOT IN ({values(K.REQUEST_IDS_KNOWN_BAD)})""",
    "a": f"""
        SELECT action_id, id, rfc, type_id, label, start, coalesce(raw_done_by, raw_group) AS done_by, note
        FROM ra WHERE id NOT IN ({values(K.REQUEST_IDS_KNOWN_BAD)})""",
    # features
    "tech": f"""
        SELECT id, max(start) AS start,
               arg_max(done_by, -rn) FILTER (WHERE done_by IS NOT NULL) AS done_by,
               max(CASE WHEN rn = 1 THEN action_id END) AS action_id,
               max(CASE WHEN rn = 1 THEN type_id END) AS type_id
        FROM (SELECT *, row_number() OVER (PARTITION BY id
                     ORDER BY start DESC NULLS FIRST, action_id DESC) AS rn
              FROM a WHERE type_id IN ({values(K.ACTION_ASSIGNMENT)}))
        GROUP BY id""",
    "firstact": f"""
        SELECT id, min(start) AS first_start, max(start) AS latest_start FROM a
        WHERE type_id NOT IN ({values(K.ACTION_NOT_WORK)}) GROUP BY id""",
    "rdv": f"""
        SELECT id, rdv_date, note FROM (
            SELECT *, row_number() OVER (PARTITION BY id
                ORDER BY rdv_date DESC NULLS LAST, action_id DESC) AS rn
            FROM (SELECT id, action_id, note, try_strptime(
                      regexp_extract(note, ':([0-9]{{2}}.[0-9]{{2}}.[0-9]{{4}})', 1), '%d/%m/%Y') AS rdv_date
                  FROM a WHERE type_id IN (65, 108) AND contains(note, '{K.TAG_RDV}')))
        WHERE rn = 1""",
    "observed": f"""
        SELECT DISTINCT id FROM a
        WHERE type_id IN (65, 108) AND contains(note, '{K.TAG_OBSERVATION}')""",
    "suspension": "SELECT id, max(start) AS suspended_at FROM a WHERE type_id = 5 GROUP BY id",
    "contactdays": f"""
        SELECT id, CAST({_LOCAL_START} AS DATE) AS day, max(start) AS latest
        FROM a WHERE {_CONTACT} AND start IS NOT NULL GROUP BY ALL""",
    "contacts": f"""
        SELECT x.id, x.was_contacted, coalesce(d.n, 0) AS n, d.first_contact, d.last_contact
        FROM (SELECT id, bool_or({_CONTACT}) AS was_contacted FROM a GROUP BY id) x
        LEFT JOIN (SELECT id, count(*) AS n, min(latest) AS first_contact, max(latest) AS last_contact
                   FROM contactdays GROUP BY id) d USING (id)""",
    "due_contact": f"""
        SELECT id FROM contacts WHERE NOT was_contacted
            OR (n >= 3 AND {_LOCAL_NOW} > {plus_business_days(local('last_contact'), 3)})
            OR (n = 2 AND {_LOCAL_NOW} > {plus_business_days(local('last_contact'), 2)})
            OR (n = 1 AND {_LOCAL_NOW} > {plus_business_days(local('last_contact'), 1)})""",
    "often_contacted": f"""
        SELECT id FROM contacts
        WHERE n >= 3 AND {business_days(local('first_contact'), local('last_contact'))} >= 7""",
    "rate1": _rates(K.RATE_SINCE_CREATION, K.REASON_SINCE_CREATION, True),
    "rate2": _rates(K.RATE_SINCE_LAST_ACTION, K.REASON_SINCE_LAST_ACTION, False),
    "rate3": _rates(K.RATE_NOT_SUSPENDED, K.REASON_NOT_SUSPENDED, False),
    "aged": f"""
        SELECT t.*, {minutes('t.submitted')} AS age, {minutes('f.first_start')} AS last_action
        FROM t LEFT JOIN firstact f USING (id)""",
    "parts": f"""
        SELECT x.*,
               coalesce(r1.base + r1.per_day * {days('age')}, 0) AS c1, coalesce(r1.words, '') AS w1,
               coalesce(r2.base + r2.per_day * {days('last_action')}, 0) AS c2, coalesce(r2.words, '') AS w2,
               coalesce(r3.base + r3.per_day * {days('last_action')}, 0) AS c3, coalesce(r3.words, '') AS w3,
               CASE WHEN {SECURITY} THEN {K.SECURITY_POINTS} ELSE 0 END AS c4,
               CASE WHEN {SECURITY} THEN {text(K.SECURITY_TEXT)} ELSE '' END AS w4,
               CASE WHEN {VIP} THEN coalesce(500 + 100 * {days('last_action')}, 0) ELSE 0 END AS c5,
               CASE WHEN {VIP} THEN {text(K.VIP_TEXT)} ELSE '' END AS w5,
               CASE WHEN {INDUSTRIAL} THEN {K.INDUSTRIAL_POINTS} ELSE 0 END AS c6,
               CASE WHEN {INDUSTRIAL} THEN {text(K.INDUSTRIAL_TEXT)} ELSE '' END AS w6
        FROM aged x
        LEFT JOIN rate1 r1 ON r1.urgency = x.urgency AND r1.kind = x.kind
        LEFT JOIN rate2 r2 ON r2.urgency = x.urgency AND r2.kind = x.kind
        LEFT JOIN rate3 r3 ON r3.urgency = x.urgency AND r3.kind = x.kind
             AND x.status NOT IN ({values(K.STATUS_SUSPENDED_FOR_SCORE)})""",
    "scored": """
        SELECT *, CAST(c1 + c2 + c3 + c4 + c5 + c6 AS BIGINT) AS points,
               ' // ' || w1 || ' // ' || w2 || ' // ' || w3 || ' // ' || w4 || ' // ' || w5
                 || ' // ' || w6 AS why
        FROM parts""",
    "classed": """
        SELECT t.id, coalesce(cl.itype, 1) AS itype, ty.type_name
        FROM t LEFT JOIN cl ON cl.id = t.id LEFT JOIN ty ON ty.type_id = coalesce(cl.itype, 1)""",
    "rdvstate": f"""
        SELECT t.id, r.rdv_date, CASE WHEN r.id IS NULL THEN '{K.RDV_NONE}'
               WHEN r.rdv_date IS NULL THEN '{K.RDV_INVALID}'
               WHEN r.rdv_date <= {NOW} THEN '{K.RDV_LATE}' ELSE '{K.RDV_PENDING}' END AS rdv_state
        FROM t LEFT JOIN rdv r USING (id)""",
    "complete": """
        SELECT s.*, c.itype, c.type_name, k.done_by, v.rdv_date, v.rdv_state, u.suspended_at
        FROM scored s JOIN classed c USING (id) JOIN rdvstate v USING (id)
        LEFT JOIN tech k USING (id) LEFT JOIN suspension u USING (id)""",
    # source tables of the extracts
    "sd_request": f"""
        SELECT o_orderkey AS REQUEST_ID, o_orderkey - 1 AS PARENT_REQUEST_ID,
               CASE WHEN o_orderkey % 29 <> 0 THEN
                 CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE 'I' END
                   || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS RFC_NUMBER,
               o_orderdate AS CREATION_DATE_UT,
               o_orderdate + to_minutes(o_orderkey % 1440) AS SUBMIT_DATE_UT,
               CASE WHEN o_orderkey % 17 <> 0
                    THEN o_orderdate + to_days(CAST(60 + o_orderkey % 90 AS INTEGER)) END AS MAX_RESOLUTION_DATE_UT,
               o_custkey AS SUBMITTED_BY, o_custkey + 1 AS REQUESTOR_ID, o_custkey AS RECIPIENT_ID,
               CAST(CASE o_orderkey % 20 WHEN 0 THEN 5535 WHEN 1 THEN 5687 WHEN 2 THEN 5564
                    ELSE 1000 END AS BIGINT) AS SD_CATALOG_ID,
               CAST({pick('o_orderkey % 9', adapter.STATUSES)} AS BIGINT) AS STATUS_ID,
               CAST(left(o_orderpriority, 1) AS BIGINT) AS URGENCY_ID,
               o_orderkey % 3000 AS CI_ID,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 1000 END AS OWNER_ID,
               1 + o_orderkey % 7 AS OWNING_GROUP_ID,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 300 END AS ASSET_ID
        FROM orders""",
    "am_action": """
        SELECT action_id AS ACTION_ID, id AS REQUEST_ID, n AS ACTION_NUMBER,
               CASE WHEN id % 19 = 0 AND n = 2 THEN 23 ELSE type_id END AS ACTION_TYPE_ID,
               CASE WHEN id % 19 = 0 AND n = 2 THEN 'Traitement' ELSE label END AS ACTION_LABEL_FR,
               start AS START_DATE_UT, start + INTERVAL 60 MINUTE AS END_DATE_UT, note AS DESCRIPTION,
               CASE WHEN id % 13 <> 0 THEN supplier END AS DONE_BY_ID,
               CASE WHEN n <= 3 THEN 5 ELSE n + 1 END AS GROUP_ID
        FROM ra""",
    "sd_question": """
        SELECT REQUEST_ID, CAST(q.question AS BIGINT) AS QUESTION_ID, q.raw AS RESULT, q.answer AS RESULT_STRING_FR FROM (
            SELECT REQUEST_ID, unnest([
                {'question': 45, 'raw': NULL, 'answer': 'dupont ' || CAST(REQUEST_ID AS VARCHAR)},
                {'question': 46, 'raw': NULL, 'answer': 'jean-pierre'},
                {'question': 48, 'raw': NULL, 'answer': 'CNR JEAN BART'},
                {'question': CASE WHEN REQUEST_ID % 3 = 0 THEN 99 ELSE 49 END, 'raw': NULL, 'answer': 'CDI'},
                {'question': 50, 'raw': NULL, 'answer': strftime(SUBMIT_DATE_UT, '%d/%m/%Y')},
                {'question': 55, 'raw': NULL,
                 'answer': CASE WHEN REQUEST_ID % 40 = 0 THEN 'Non' ELSE 'Oui' END},
                {'question': 58, 'raw': CASE WHEN REQUEST_ID % 3 = 1 THEN 'Non' END,
                 'answer': CASE WHEN REQUEST_ID % 3 = 0 THEN 'Oui' END}
            ]) AS q FROM sd_request)""",
    "hotline_ids": """
        SELECT DISTINCT REQUEST_ID FROM am_action
        WHERE END_DATE_UT IS NULL AND GROUP_ID = 5""",
    "arrival_ids": f"SELECT REQUEST_ID FROM sd_request WHERE {_ARRIVAL}",
    "open_request": """
        SELECT * FROM sd_request
        WHERE (REQUEST_ID IN (SELECT REQUEST_ID FROM hotline_ids) AND MAX_RESOLUTION_DATE_UT IS NOT NULL)
           OR REQUEST_ID IN (SELECT REQUEST_ID FROM arrival_ids)""",
    "employee": """
        SELECT c_custkey AS EMPLOYEE_ID, c_name AS LAST_NAME, n_name AS AVAILABLE_FIELD_6
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
}


def star_tickets(requests: str) -> str:
    """The 12-way star join, with one join per name and location."""
    return f"""
        SELECT r.REQUEST_ID, r.PARENT_REQUEST_ID, r.RFC_NUMBER, r.SUBMIT_DATE_UT,
               e1.LAST_NAME AS SUBMITTED_BY_LAST_NAME, e2.LAST_NAME AS REQUESTOR_LAST_NAME,
               l2.AVAILABLE_FIELD_6 AS REQUESTOR_LOCATION_RH, e3.LAST_NAME AS RECIPIENT_LAST_NAME,
               l3.AVAILABLE_FIELD_6 AS RECIPIENT_LOCATION_RH,
               'Catalogue ' || CAST(r.SD_CATALOG_ID AS VARCHAR) AS CATALOG_NAME,
               r.STATUS_ID, 'Statut ' || CAST(r.STATUS_ID AS VARCHAR) AS STATUS_FR,
               'Urgence ' || CAST(r.URGENCY_ID AS VARCHAR) AS URGENCY_FR,
               p1.p_name AS CI_NAME, e4.LAST_NAME AS OWNER_LAST_NAME,
               g.r_name AS OWNING_GROUP_NAME, p2.p_brand AS ASSET_TAG
        FROM {requests} r
        JOIN employee e1 ON r.SUBMITTED_BY = e1.EMPLOYEE_ID
        JOIN employee e2 ON r.REQUESTOR_ID = e2.EMPLOYEE_ID
        JOIN employee e3 ON r.RECIPIENT_ID = e3.EMPLOYEE_ID
        LEFT JOIN employee e4 ON r.OWNER_ID = e4.EMPLOYEE_ID
        LEFT JOIN employee l2 ON r.REQUESTOR_ID = l2.EMPLOYEE_ID
        LEFT JOIN employee l3 ON r.RECIPIENT_ID = l3.EMPLOYEE_ID
        LEFT JOIN part p1 ON r.CI_ID = p1.p_partkey
        LEFT JOIN part p2 ON r.ASSET_ID = p2.p_partkey
        LEFT JOIN region g ON r.OWNING_GROUP_ID = g.r_regionkey + 1
        WHERE r.STATUS_ID <> 36"""


def star_actions(where: str) -> str:
    return f"""
        SELECT x.ACTION_ID, x.REQUEST_ID, r.RFC_NUMBER, x.ACTION_TYPE_ID, x.ACTION_LABEL_FR,
               CASE WHEN x.ACTION_TYPE_ID NOT IN (54, 23)
                    THEN 'Action ' || CAST(x.ACTION_TYPE_ID AS VARCHAR) END AS ACTION_TYPE,
               x.START_DATE_UT, x.DESCRIPTION, e.LAST_NAME AS DONE_BY_NAME, g.r_name AS GROUP_FR
        FROM am_action x
        LEFT JOIN region g ON x.GROUP_ID = g.r_regionkey + 1
        LEFT JOIN employee e ON x.DONE_BY_ID = e.EMPLOYEE_ID
        LEFT JOIN sd_request r ON x.REQUEST_ID = r.REQUEST_ID
        WHERE {where}"""


def row_list(where: str = "true") -> str:
    """The 17-column row list of the tickets that fit."""
    return f"""
        SELECT rfc AS SPOT, status_name AS Statut, recipient AS Beneficiaire,
               {location('location')} AS Location, urgency_name AS Priorite, ci AS CI,
               comment AS Description,
               coalesce(CAST(CAST(epoch_ms(rdv_date) AS BIGINT) + 3600000 AS VARCHAR), '') AS C_RDV_DATE,
               rdv_state AS C_RDV_STATE, done_by AS AP_AM_DONE_BY_OPERATOR_NAME, points AS Score,
               why AS C_POINTS_JUSTIFICATION, CAST(itype AS BIGINT) AS AP_INTERVENTION_TYPE,
               type_name AS Inter_Type, CAST(kind AS BIGINT) AS C_TICKET_TYPE,
               kind_name AS C_TICKET_TYPE_STRING_FR, CAST(id AS VARCHAR) AS AP_SD_REQUEST_ID
        FROM complete WHERE {where}"""


def count(where: str = "true", view: str = "complete") -> str:
    return f"SELECT count(*) AS value FROM {view} WHERE {where}"


def with_views(select: str) -> str:
    """``select`` preceded by the views it uses, directly or through others."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                visit(VIEWS[name])

    visit(select)
    views = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + select.strip()
