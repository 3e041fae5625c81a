"""One query per operator over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskgauge.llm import (
    byte_bpe, chat_rotation, compression_quality, decontamination, fill_in_middle,
    merkle_manifest, near_duplicates, pitman_yor, quality_rules, toxicity, url_lists, winnowing,
    wrapper_extraction,
)
from deskgauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


_LOWERED = ("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_LEDGER_SQL = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    word AS (
        SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
    top AS (
        SELECT r, max(n) AS n_top_word
        FROM (SELECT r, x, count(*) AS n FROM word GROUP BY r, x) GROUP BY r),
    win AS (
        SELECT a.r, a.i, count(*) OVER (PARTITION BY a.r, a.x, b.x, c.x) AS n
        FROM word a JOIN word b ON b.r = a.r AND b.i = a.i + 1
                    JOIN word c ON c.r = a.r AND c.i = a.i + 2),
    rep AS (
        SELECT r, count(*) AS n_repeat_words
        FROM (SELECT DISTINCT r, i + k AS i FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2)
        GROUP BY r),
    m AS (
        SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
               coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               list_filter(string_split(t, chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
               length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
               length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
        FROM d),
    f AS (
        SELECT m.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
               coalesce(n_top_word, 0) AS n_top_word
        FROM m LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
    b AS (
        SELECT *,
               CASE WHEN n_words < 50 THEN 1 ELSE 0 END
               + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
               + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
               + CASE WHEN 100 * n_dup_lines > 50 * len(lines) THEN 8 ELSE 0 END
               + CASE WHEN 100 * n_top_word > 30 * n_words THEN 16 ELSE 0 END
               + CASE WHEN 100 * n_capitals > 50 * n_letters THEN 32 ELSE 0 END
               + CASE WHEN 10 * word_chars < 20 * n_words THEN 64 ELSE 0 END
               + CASE WHEN word_chars > 20 * n_words THEN 128 ELSE 0 END AS failed
        FROM f)"""

_QUALITY_RULES_SQL = _LEDGER_SQL + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           len(lines)::BIGINT AS n_lines, n_top_word::BIGINT AS n_top_word,
           n_letters::BIGINT AS n_letters, n_capitals::BIGINT AS n_capitals,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           '2' AS policy, failed = 0 AS kept, failed::BIGINT AS failed
    FROM b"""

_ABLATIONS_SQL = _LEDGER_SQL + """,
    rules(rule, bit) AS (VALUES
        ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8),
        ('one_word', 16), ('capitals', 32), ('short_words', 64), ('long_words', 128))
    SELECT '2' AS policy, rule, (SELECT count(*) FROM b WHERE failed & bit <> 0) AS n_failed,
           (SELECT count(*) FROM b WHERE failed = bit) AS n_only
    FROM rules"""


@query("op1_quality_rules", _QUALITY_RULES_SQL)
def _(spark, sf_dir):
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.verdicts(rows, quality_rules.STRICT)
    return judged.select(
        "doc_id", *quality_rules.MEASURES,
        quality_rules.fails(quality_rules.BASE).alias("base_failed"), "policy", "kept", "failed")


@query("quality_rule_ablations", _ABLATIONS_SQL)
def _(spark, sf_dir):
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.ablations(rows, quality_rules.STRICT)


@query("op2_simhash_pigeonring")
def _(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_compression_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model)


_DECONTAMINATION_SQL = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            {_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    item AS (
        SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
            {_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    gram AS (
        SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
              FROM item WHERE len(w) > 0)),
    size AS (SELECT DISTINCT n FROM gram),
    win AS (
        SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
              FROM d JOIN size ON len(w) >= n)),
    hit AS (SELECT r, win.n, i, item FROM win JOIN gram ON win.n = gram.n AND win.g = gram.g),
    word AS (
        SELECT r, count(DISTINCT i + k) AS n_hit
        FROM (SELECT r, i, unnest(generate_series(0, n - 1)) AS k FROM hit) GROUP BY r),
    items AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN word USING (r) LEFT JOIN items USING (r)"""


@query("op4_decontamination", _DECONTAMINATION_SQL)
def _(spark, sf_dir):
    return decontamination.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_pitman_yor")
def _(spark, sf_dir):
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


_CHAT_ROTATION_SQL = """
    WITH m AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS copies
        FROM conversations GROUP BY ALL),
    side AS (SELECT DISTINCT conv_id, role AS side FROM m WHERE role <> 'system'),
    v AS (
        SELECT m.conv_id, side, turn, m.role AS speaker, text, copies,
               coalesce(m.role = side, false) AS learned,
               CASE WHEN m.role = side THEN 'assistant' WHEN m.role = 'system' THEN 'system'
                    ELSE 'user' END AS role
        FROM m JOIN side ON m.conv_id IS NOT DISTINCT FROM side.conv_id),
    r AS (
        SELECT *, CASE WHEN role = 'user' THEN coalesce(speaker, 'unknown') END AS name,
               '<|im_start|>' || role || CASE WHEN role = 'user'
                   THEN ' name=' || coalesce(speaker, 'unknown') ELSE '' END || chr(10) AS head
        FROM v),
    s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM r),
    p AS (
        SELECT *, row_number() OVER w - 1 AS position,
               coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0)::BIGINT AS start
        FROM s WINDOW w AS (PARTITION BY conv_id, side
                            ORDER BY turn NULLS LAST, speaker NULLS LAST, text))
    SELECT conv_id, side, position, turn, role, name, segment, copies, start, learned,
           (start + CASE WHEN learned THEN length(head) ELSE 0 END)::BIGINT AS mask_start,
           (start + CASE WHEN learned THEN length(segment) - 1 ELSE 0 END)::BIGINT AS mask_end
    FROM p"""


@query("op6_chat_rotation", _CHAT_ROTATION_SQL)
def _(spark, sf_dir):
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


@query("op7_byte_bpe")
def _(spark, sf_dir):
    return byte_bpe.digest_documents(
        table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op8_wrapper_extraction")
def _(spark, sf_dir):
    return wrapper_extraction.main_text(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


_HOST = ("lower(regexp_replace(regexp_replace(regexp_extract(url, "
         "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))")
_DIGIT = "(instr('0123456789abcdef', substr(md5(host), {}, 1)) - 1)"


def _day(days: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_days(({days})::INTEGER)"


def _entries_sql() -> str:
    d = [None, *(_DIGIT.format(k) for k in range(1, 9))]
    bare = "regexp_replace(host, '^(www|blog|m)[.]', '')"
    rows = [
        ("spam", False, "host", "host", "true", f"{d[1]} * 10"),
        ("spam", False, "host", "host", "false", f"{d[1]} * 10 + {d[2]} * 5"),
        ("spam", False, "host", "host", "true", f"{d[3]} + 200"),
        ("spam", False, "host", "host", "false", f"{d[3]} + 200 + {d[4]} * 12"),
        ("reported", False, "domain", bare, "true", f"{d[5]} * 20"),
        ("reported", False, "domain", bare, "false", f"{d[6]} * 24"),
        ("trusted", True, "prefix", "host || '/en'", f"{d[7]} < 8", f"{d[8]} * 20"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS list, {allows} AS allows, '{kind}' AS kind, {pattern} AS pattern, "
        f"{adds} AS adds, {_day(at)} AS since FROM hosts" for name, allows, kind, pattern, adds, at in rows)


_URL_LISTS_SQL = f"""
    WITH page AS (
        SELECT row_number() OVER () AS r, page_id, url, {_HOST} AS host,
               regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1),
                              '/$', '') AS path,
               TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919 % 525600)::INTEGER) AS fetched_at
        FROM pages),
    hosts AS (SELECT DISTINCT host FROM page WHERE host <> ''),
    entry AS (
        SELECT list, allows, kind, pattern, since, bool_or(adds) AS adds
        FROM ({_entries_sql()}) GROUP BY ALL),
    met AS (
        SELECT r, list, allows, kind, pattern, arg_max(adds, since) AS active
        FROM page JOIN entry ON since <= fetched_at AND (
            kind = 'host' AND host = pattern
            OR kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern))
            OR kind = 'prefix' AND starts_with(lower(host || path) || '/', pattern || '/'))
        GROUP BY ALL),
    found AS (
        SELECT r, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n_entries,
               coalesce(max(length(pattern)) FILTER (NOT allows), 0)
               > coalesce(max(length(pattern)) FILTER (allows), 0) AS blocked
        FROM met WHERE active GROUP BY r)
    SELECT page_id, url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at,
           coalesce(lists, '') AS lists, coalesce(n_entries, 0) AS n_entries,
           coalesce(blocked, false) AS blocked
    FROM page LEFT JOIN found USING (r)"""


@query("op10_url_lists", _URL_LISTS_SQL)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    valid = url_lists.intervals(url_lists.lists_of(pages))
    judged = url_lists.filter_captures(url_lists.captures_of(pages), valid)
    return judged.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


_ONE = "1::UHUGEINT"
_MODULUS = "18446744073709551616::UHUGEINT"


def _powers(base: int, name: str) -> str:
    """A macro-like CTE: powers of ``base`` modulo 2**64 for every place of the longest text."""
    factors = ", ".join(f"{pow(base, 1 << bit, 1 << 64)}::UHUGEINT" for bit in range(26))
    return f"""{name} AS (
        SELECT i, list_reduce(
            list_transform(generate_series(1, 26), lambda b:
                CASE WHEN (i >> (b - 1)::INT) % 2 = 1 THEN ([{factors}])[b]
                     ELSE {_ONE} END),
            lambda x, y: x * y % {_MODULUS}) AS p
        FROM (SELECT unnest(generate_series(0, (SELECT max(length(t)) FROM e))) AS i))"""


_WINNOWING_SQL = rf"""
    WITH ordered AS (
        SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id,
               coalesce(text, '') AS t FROM documents),
    d AS (
        SELECT r, doc_id, t, length(t) AS n,
               coalesce(lead(t) OVER (ORDER BY r), (SELECT t FROM ordered WHERE r = 1)) AS following,
               coalesce(lead(r) OVER (ORDER BY r), 1) AS next_r
        FROM ordered),
    e AS (SELECT *, left(t, n - (n // 4)) || left(following, (n // 4)) AS edited FROM d),
    {_powers(pow(winnowing.BASE, -1, 1 << 64), "down")},
    {_powers(winnowing.BASE, "up")},
    side AS (
        SELECT r, false AS changed, t AS x FROM e UNION ALL SELECT r, true, edited FROM e),
    code AS (
        SELECT r, changed, length(x) AS n, least({winnowing.GRAM}, length(x)) AS g,
               unnest(string_split(x, '')) AS c, unnest(generate_series(0, length(x) - 1)) AS i
        FROM side WHERE x <> ''),
    total AS (
        SELECT r, changed, n, g, i, sum((unicode(c)::UHUGEINT * p % {_MODULUS})::HUGEINT)
                   OVER (PARTITION BY r, changed ORDER BY i
                         ROWS BETWEEN CURRENT ROW AND g - 1 FOLLOWING) AS s
        FROM code JOIN down USING (i)),
    gram AS (
        SELECT r, changed, n, g, total.i AS i,
               ((s::UHUGEINT % {_MODULUS}) * p % {_MODULUS}) // {1 << winnowing.PLACE_BITS} AS h
        FROM total JOIN up ON up.i = total.i + g - 1 WHERE total.i + g <= n),
    least_of AS (
        SELECT r, changed, i, n, g, min(h::HUGEINT * {1 << 27} + ({(1 << 27) - 1} - i)) OVER (
                   PARTITION BY r, changed ORDER BY i
                   ROWS BETWEEN CURRENT ROW AND {winnowing.WINDOW - 1} FOLLOWING) AS k
        FROM gram),
    found AS (
        SELECT DISTINCT r, changed, (k // {1 << 27})::BIGINT AS h,
               ({(1 << 27) - 1} - k % {1 << 27})::BIGINT AS pos
        FROM least_of WHERE i <= greatest(0, n - g + 1 - {winnowing.WINDOW})),
    prints AS (
        SELECT r, changed, to_base64(unhex(string_agg(
                   format('{{:014x}}', h * 256 + gap), '' ORDER BY pos))) AS fp
        FROM (SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY r, changed ORDER BY pos) AS gap
              FROM found)
        GROUP BY ALL),
    mark AS (SELECT DISTINCT r, changed, h FROM found),
    sizes AS (SELECT r, changed, count(*) AS m FROM mark GROUP BY ALL),
    meeting AS (
        SELECT a.r, b.changed, count(*) AS shared
        FROM mark a JOIN e ON e.r = a.r
             JOIN mark b ON b.h = a.h AND (b.changed AND b.r = a.r OR NOT b.changed AND b.r = e.next_r)
        WHERE NOT a.changed GROUP BY ALL),
    likeness AS (
        SELECT e.r, w.changed,
               CASE WHEN coalesce(a.m, 0) + coalesce(b.m, 0) = 0 THEN 1.0::DOUBLE
                    ELSE coalesce(shared, 0)::DOUBLE
                         / (coalesce(a.m, 0) + coalesce(b.m, 0) - coalesce(shared, 0)) END AS x
        FROM e CROSS JOIN (SELECT unnest([true, false]) AS changed) w
             LEFT JOIN sizes a ON a.r = e.r AND NOT a.changed
             LEFT JOIN sizes b ON b.changed = w.changed
                       AND b.r = CASE WHEN w.changed THEN e.r ELSE e.next_r END
             LEFT JOIN meeting ON meeting.r = e.r AND meeting.changed = w.changed)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
           coalesce(p.fp, '') AS fingerprint, coalesce(q.fp, '') AS edited_fingerprint,
           y.x AS near_edited, z.x AS near_next
    FROM e JOIN likeness y ON y.r = e.r AND y.changed JOIN likeness z ON z.r = e.r AND NOT z.changed
         LEFT JOIN prints p ON p.r = e.r AND NOT p.changed
         LEFT JOIN prints q ON q.r = e.r AND q.changed"""


@query("op11_winnowing", _WINNOWING_SQL)
def _(spark, sf_dir):
    return winnowing.with_next(table(spark, sf_dir, "documents"))


def _encoded(value: str) -> str:
    return (f"CASE WHEN {value} IS NULL THEN '-' "
            f"ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END")


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(map(_encoded, values))})"


# CRC-32 of ASCII text, a bit at a time.
_CRC = """(xor(4294967295::BIGINT, list_reduce(
    list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT),
    lambda crc, byte: list_reduce(generate_series(1, 8)::BIGINT[], lambda x, step:
        xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END),
        xor(crc, byte)),
    4294967295::BIGINT)))"""

_MERKLE_SQL = f"""
    WITH RECURSIVE d AS (
        SELECT coalesce('1' || lang, '0') AS grp, doc_id, {_leaf_sql("n_chars")} AS leaf,
               CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 7 = 0
                    THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS claimed
        FROM documents),
    leaf AS (
        SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM d),
    node AS (
        SELECT 0 AS level, grp, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM leaf
        UNION ALL
        SELECT DISTINCT level + 1, grp, pos // 2,
               sha256(string_agg(digest, '') OVER (PARTITION BY grp, pos // 2 ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2
        FROM node WHERE n > 1),
    sub AS (
        SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS j
        FROM node WHERE n = 1),
    top AS (
        SELECT 0 AS level, j AS pos, subroot AS digest, count(*) OVER () AS n FROM sub
        UNION ALL
        SELECT DISTINCT level + 1, pos // 2,
               sha256(string_agg(digest, '') OVER (PARTITION BY pos // 2 ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 1) // 2
        FROM top WHERE n > 1),
    both_trees AS (
        SELECT grp, level, pos, digest, n FROM node
        UNION ALL
        SELECT '' AS grp, level, pos, digest, n FROM top),
    climb AS (
        SELECT grp AS own, pos AS place, grp, 0 AS level, pos,
               (SELECT max(n) FROM node WHERE node.grp = leaf.grp AND level = 0) AS n,
               claimed AS digest, '' AS proof
        FROM leaf
        UNION ALL
        SELECT own, place, CASE WHEN c.n = 1 THEN '' ELSE c.grp END,
               CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
               CASE WHEN c.n = 1 THEN j ELSE c.pos // 2 END,
               CASE WHEN c.n = 1 THEN (SELECT count(*) FROM sub) ELSE (c.n + 1) // 2 END,
               CASE WHEN c.n = 1 THEN c.digest
                    WHEN c.pos % 2 = 1 THEN sha256(s.digest || c.digest)
                    ELSE sha256(c.digest || coalesce(s.digest, '')) END,
               c.proof || CASE WHEN c.n = 1 THEN '' ELSE coalesce(s.digest, '') END
        FROM climb c LEFT JOIN both_trees s
             ON s.grp = c.grp AND s.level = c.level AND s.pos = xor(c.pos, 1::BIGINT)
             LEFT JOIN sub ON sub.grp = c.own
        WHERE c.n > 1 OR c.grp <> '')
    SELECT doc_id, leaf.leaf, subroot, root, sha256(proof) AS proof_sha256,
           climb.digest AS folded_root, climb.digest = root AS verified
    FROM leaf JOIN climb ON own = leaf.grp AND place = leaf.pos AND climb.grp = '' AND climb.n = 1
         JOIN sub ON sub.grp = leaf.grp, (SELECT digest AS root FROM top WHERE n = 1)"""


@query("op12_merkle_manifest", _MERKLE_SQL)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return merkle_manifest.build(docs, claims=merkle_manifest.tampered()).verified()


_FILL_IN_MIDDLE_SQL = r"""
    WITH h AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS line,
               sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x
        FROM documents),
    d AS (
        SELECT *, len(line) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
               ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
    c AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                         OR h3 % 100 >= 100 THEN 'plain'
                    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM d),
    p AS (
        SELECT *, array_to_string(line[1:a], '') AS prefix, array_to_string(line[a + 1:b], '') AS middle,
               array_to_string(line[b + 1:n], '') AS suffix
        FROM c)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                  WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END)
               AS restored_sha256
    FROM p"""


@query("op13_fill_in_middle", _FILL_IN_MIDDLE_SQL)
def _(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))
