"""DuckDB SQL that states what each query must return, over the same tables."""

from __future__ import annotations

from threadlake.plans.fixtures import OWNER
from threadlake.plans.queries import EXTENSIONS, SEARCH_TERM

GROUP_NOTICE = (
    r"(?i)(created (this )?group|added\b|left\b|removed\b|became an admin|changed the subject|"
    r"group description|criou o grupo|adicionou|saiu do grupo|removeu|cre[óo] el grupo|"
    r"a[ñn]adi[óo])"
)

V = r"""
v AS (
  SELECT c.conv_id * 2 + s.side AS unit_idx,
         concat('conv', c.conv_id, CASE WHEN s.side = 0 THEN '-a.zip' ELSE '-b.zip' END) AS label,
         c.conv_id, s.side, c.turn AS msg_no, c.text AS body,
         CASE WHEN s.side = 0 THEN c.ts ELSE date_trunc('minute', c.ts) END AS ts,
         s.side = 0 AS has_seconds,
         CASE WHEN c.role = 'system' THEN NULL
              WHEN c.role = 'user' THEN 'Owner Example'
              WHEN c.conv_id % 5 = 0 THEN concat('Member ', c.conv_id % 7, '-',
                   CASE WHEN c.turn % 4 >= 2 THEN '1' ELSE '0' END)
              ELSE concat('Contact ', c.conv_id % 40) END AS sender,
         CASE WHEN c.role = 'system' THEN 'system' WHEN c.turn % 3 = 1 THEN 'media'
              ELSE 'text' END AS kind,
         c.role <> 'system' AND c.turn % 3 = 1 AND s.side = 0 AND c.conv_id % 2 = 0 AS omitted,
         CASE WHEN c.role = 'system' OR c.turn % 3 <> 1 OR (s.side = 0 AND c.conv_id % 2 = 0) THEN NULL
              ELSE concat('0000000', s.side, '-PHOTO-', c.conv_id, '-', c.turn, '.jpg') END AS filename,
         CASE WHEN c.role <> 'system' AND c.turn % 3 = 1 THEN '' ELSE c.text END AS text,
         CASE WHEN s.side = 1 AND c.conv_id % 3 = 2 THEN concat('backup ', c.conv_id)
              WHEN c.conv_id % 5 = 0 THEN concat(CASE WHEN s.side = 1 AND c.conv_id % 3 = 1
                   THEN 'Weekend-Planning Group ' ELSE 'Weekend Planning Group ' END, c.conv_id)
              ELSE concat('Contact ', c.conv_id % 40) END AS title
  FROM (SELECT *, TIMESTAMP '2026-01-01 00:00:00' + to_hours(conv_id * 3) + to_seconds(turn * 20) AS ts
        FROM conversations) c
  CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side) s
  WHERE (s.side = 0 AND c.turn <= 4)
     OR (s.side = 1 AND c.turn >= CASE WHEN c.conv_id % 4 = 3 THEN 5 ELSE 2 END)
),
k AS (
  SELECT *, date_trunc('minute', ts) AS minute, lower(coalesce(sender, '<system>')) AS who,
         CASE WHEN kind = 'media' AND NOT omitted
              THEN concat('media:', lower(regexp_replace(filename, '^[0-9]{6,10}-', '')))
              ELSE lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) END AS said
  FROM v
)"""

MERGED = V + r""",
d AS (
  SELECT r.*, s.sources FROM (
    SELECT *,
      row_number() OVER (PARTITION BY conv_id, minute, who, said
                         ORDER BY has_seconds DESC, length(text) DESC, unit_idx, msg_no) AS best,
      first_value(unit_idx) OVER (PARTITION BY conv_id, minute, who, said
                                  ORDER BY unit_idx, msg_no) AS first_unit,
      first_value(msg_no) OVER (PARTITION BY conv_id, minute, who, said
                                ORDER BY unit_idx, msg_no) AS first_no
    FROM k) r
  JOIN (SELECT conv_id, minute, who, said, list_sort(list(DISTINCT unit_idx)) AS sources
        FROM k GROUP BY conv_id, minute, who, said) s
    ON r.conv_id = s.conv_id AND r.minute = s.minute AND r.who = s.who AND r.said = s.said
  WHERE best = 1
),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, minute, who, kind = 'media', omitted
                               ORDER BY first_unit, first_no) AS nth
  FROM d
),
q AS (
  SELECT a.conv_id, a.ts, a.sender, a.text, a.kind, a.omitted, a.filename, a.has_seconds,
         a.first_unit, a.first_no,
         CASE WHEN b.conv_id IS NULL THEN a.sources
              ELSE list_sort(list_distinct(list_concat(a.sources, b.sources))) END AS sources
  FROM t a LEFT JOIN t b
    ON a.kind = 'media' AND b.kind = 'media' AND a.conv_id = b.conv_id AND a.minute = b.minute
   AND a.who = b.who AND a.nth = b.nth AND a.omitted <> b.omitted
  WHERE NOT (a.omitted AND b.conv_id IS NOT NULL)
),
m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts, first_unit, first_no) - 1 AS msg_idx
  FROM q
),
u AS (SELECT unit_idx, any_value(label) AS label, any_value(title) AS title,
             any_value(conv_id) AS conv_id FROM v GROUP BY unit_idx)"""

PROFILES = V + f""",
profile AS (
  SELECT unit_idx, any_value(title) AS title, lower(any_value(title)) AS norm_title,
         false AS placeholder,
         count(DISTINCT sender) AS n_senders,
         count(DISTINCT sender) > 2
           OR coalesce(bool_or(kind = 'system' AND regexp_matches(text, '{GROUP_NOTICE}')), false)
           AS groupish,
         count(*) AS n_messages,
         string_agg(DISTINCT lower(sender), '|' ORDER BY lower(sender)) AS people
  FROM v GROUP BY unit_idx
)"""

EDGES = PROFILES + """,
keyset AS (SELECT DISTINCT unit_idx, minute, who, said FROM k),
size AS (SELECT unit_idx, count(*) AS n FROM keyset GROUP BY unit_idx),
shared AS (
  SELECT x.unit_idx AS a, y.unit_idx AS b, count(*) AS shared
  FROM keyset x JOIN keyset y
    ON x.minute = y.minute AND x.who = y.who AND x.said = y.said AND x.unit_idx < y.unit_idx
  GROUP BY x.unit_idx, y.unit_idx
),
edge AS (
  SELECT unit_idx AS a, min(unit_idx) OVER (PARTITION BY norm_title) AS b FROM profile
  UNION
  SELECT unit_idx, min(unit_idx) OVER (PARTITION BY people) FROM profile
  WHERE NOT groupish AND people IS NOT NULL
  UNION
  SELECT s.a, s.b FROM shared s
  JOIN profile x ON x.unit_idx = s.a JOIN profile y ON y.unit_idx = s.b
  JOIN size m ON m.unit_idx = s.a JOIN size n ON n.unit_idx = s.b
  WHERE s.shared / least(m.n, n.n) >= 0.15
    AND (x.people = y.people
         OR (length(x.norm_title) = length(y.norm_title)
             AND levenshtein(x.norm_title, y.norm_title) = 1
             AND 1 - 1.0 / length(x.norm_title) > 0.92))
),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (
  SELECT unit_idx AS node, unit_idx AS other FROM profile
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
),
component AS (SELECT node AS unit_idx, min(other) AS chat_id FROM reach GROUP BY node)"""

CHATS = MERGED + f""",
people AS (
  SELECT conv_id, sender, count(*) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, sender) - 1 AS person_idx
  FROM m WHERE sender IS NOT NULL GROUP BY conv_id, sender
),
title AS (
  SELECT conv_id, title FROM (
    SELECT conv_id, title,
           row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(unit_idx)) AS rn
    FROM u GROUP BY conv_id, title) WHERE rn = 1
),
looks AS (
  SELECT conv_id, bool_or(g) AS g FROM (
    SELECT unit_idx, any_value(conv_id) AS conv_id, count(DISTINCT sender) > 2
      OR coalesce(bool_or(kind = 'system' AND regexp_matches(text, '{GROUP_NOTICE}')), false) AS g
    FROM v GROUP BY unit_idx) GROUP BY conv_id
),
span AS (SELECT conv_id, count(*) AS n_messages, min(ts) AS start_ts, max(ts) AS end_ts
         FROM m GROUP BY conv_id),
chat AS (
  SELECT conv_id AS chat_id, title, is_group, n_people, n_sources, start_ts, end_ts, n_messages,
         chat_rank,
         concat(lower(title), CASE WHEN nth > 1 THEN concat('-', nth) ELSE '' END) AS key
  FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY chat_rank) AS nth FROM (
      SELECT s.conv_id, t.title, l.g OR coalesce(pp.n, 0) > 2 AS is_group,
             coalesce(pp.n, 0) AS n_people, uu.n AS n_sources,
             s.start_ts, s.end_ts, s.n_messages,
             row_number() OVER (ORDER BY s.end_ts DESC, s.conv_id) - 1 AS chat_rank
      FROM span s JOIN title t ON s.conv_id = t.conv_id JOIN looks l ON s.conv_id = l.conv_id
      LEFT JOIN (SELECT conv_id, count(*) AS n FROM people GROUP BY conv_id) pp ON s.conv_id = pp.conv_id
      JOIN (SELECT conv_id, count(*) AS n FROM u GROUP BY conv_id) uu ON s.conv_id = uu.conv_id)))"""

SCORES = MERGED + """,
score AS (
  SELECT sender, sum(n)::BIGINT AS messages, count(*) AS chats,
         count(*) FILTER (WHERE lower(sender) = lower(first_title)) AS titled_as_other
  FROM (SELECT sender, conv_id, count(*) AS n FROM m WHERE sender IS NOT NULL GROUP BY sender, conv_id) x
  JOIN (SELECT conv_id, arg_min(title, unit_idx) AS first_title FROM u GROUP BY conv_id) y
    ON x.conv_id = y.conv_id
  GROUP BY sender
)"""

LINES = """
w AS (
  SELECT *, CASE WHEN sender IS NULL THEN text
                 WHEN kind <> 'media' THEN concat(sender, ': ', text)
                 WHEN omitted THEN concat(sender, ': <Media omitted>')
                 WHEN has_seconds THEN concat(sender, ': <attached: ', filename, '>')
                 ELSE concat(sender, ': ', filename, ' (file attached)') END AS content
  FROM v
),
doc AS (
  SELECT unit_idx, any_value(label) AS label,
    string_agg(CASE WHEN has_seconds
      THEN concat('[', strftime(ts, '%d/%m/%Y, %H:%M:%S'), '] ',
                  CASE WHEN sender IS NULL THEN chr(8206) ELSE '' END, content)
      ELSE concat(strftime(ts, '%d/%m/%Y, %H:%M'), ' - ', content) END, chr(10) ORDER BY msg_no) AS content
  FROM w GROUP BY unit_idx
)"""

RESOLVED = """
file AS (
  SELECT label, unit_idx, msg_no, conv_id, filename,
         concat(label, '!/media/', filename) AS path,
         concat(conv_id, '-', msg_no) AS bytes,
         sha256(concat(conv_id, '-', msg_no)) AS content_hash
  FROM v WHERE filename IS NOT NULL
)"""

#: Merged messages with resolved files: the surviving copy has a file if any copy has one.
RESOLVED_MERGED = MERGED.replace(
    "lower(regexp_replace(filename, '^[0-9]{6,10}-', ''))",
    "sha256(concat(conv_id, '-', msg_no))",
)

def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.lstrip()}\n{body}"


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SOURCES = "array_to_string(sources, ',') AS sources"

EVENTS = """
e AS (
  SELECT user_id % 10 AS chat_id, event_id, ts,
         CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS sender,
         CASE WHEN event_type = 'error' THEN 'system' ELSE 'text' END AS kind,
         row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS msg_idx
  FROM events
)"""


def day_label(ts: str) -> str:
    return f"""CASE WHEN CAST({ts} AS DATE) = DATE '2026-01-06' THEN 'Today'
      WHEN CAST({ts} AS DATE) = DATE '2026-01-05' THEN 'Yesterday'
      WHEN {ts} <= TIMESTAMP '2026-01-06 12:00:00' AND {ts} > TIMESTAMP '2025-12-30 12:00:00'
        THEN dayname({ts})
      ELSE strftime({ts}, '%d/%m/%Y') END"""


def pct(part: str, whole: str) -> str:
    return f"CAST(floor({part} * 100 / {whole} + 0.5) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    exts = _sql_list(EXTENSIONS)
    sql = {
        "dedup_messages": _with(
            MERGED,
            f"""SELECT conv_id AS chat_id, ts, sender, text, kind,
                CASE WHEN kind = 'media' THEN coalesce(filename, '') END AS filename,
                has_seconds, first_unit, first_no, {SOURCES} FROM d""",
        ),
        "pair_placeholders": _with(
            MERGED,
            f"SELECT conv_id AS chat_id, first_unit, first_no, kind, omitted, {SOURCES} FROM q",
        ),
        "chronological_index": _with(
            MERGED,
            "SELECT conv_id AS chat_id, msg_idx, ts, sender, kind, first_unit, first_no FROM m",
        ),
        "merge_stats": _with(
            MERGED,
            """SELECT count(DISTINCT conv_id) AS chats, count(*) AS messages,
               count(*) FILTER (WHERE len(sources) > 1) AS overlapping,
               count(*) FILTER (WHERE kind = 'media') AS media,
               CAST(0 AS BIGINT) AS media_resolved FROM m""",
        ),
        "unit_profiles": _with(
            PROFILES,
            "SELECT unit_idx, norm_title, placeholder, n_senders, groupish, n_messages FROM profile",
        ),
        "same_title_edges": _with(
            PROFILES,
            """SELECT unit_idx, hub FROM (SELECT unit_idx,
               min(unit_idx) OVER (PARTITION BY norm_title) AS hub FROM profile)
               WHERE unit_idx > hub""",
        ),
        "same_people_edges": _with(
            PROFILES,
            """SELECT unit_idx, hub FROM (SELECT unit_idx,
               min(unit_idx) OVER (PARTITION BY people) AS hub FROM profile
               WHERE NOT groupish AND people IS NOT NULL) WHERE unit_idx > hub""",
        ),
        "unit_overlap": _with(
            EDGES,
            """SELECT g.a, g.b, coalesce(s.shared, 0) AS shared,
                 coalesce(s.shared, 0) / least(x.n, y.n) AS overlap
               FROM (SELECT lag(unit_idx) OVER (PARTITION BY people ORDER BY unit_idx) AS a,
                            unit_idx AS b FROM profile WHERE people IS NOT NULL) g
               LEFT JOIN shared s ON s.a = g.a AND s.b = g.b
               JOIN size x ON x.unit_idx = g.a JOIN size y ON y.unit_idx = g.b""",
            recursive=True,
        ),
        # The fixture's near titles differ in one replaced character, where the ratio is (n - 1) / n.
        "close_titles": _with(
            EDGES,
            """SELECT a, b, title_a, title_b, CAST(2 * (n - off) AS DOUBLE) / (2 * n) AS ratio FROM (
               SELECT s.a, s.b, x.norm_title AS title_a, y.norm_title AS title_b,
                      length(x.norm_title) AS n, levenshtein(x.norm_title, y.norm_title) AS off
               FROM shared s JOIN profile x ON x.unit_idx = s.a JOIN profile y ON y.unit_idx = s.b
               WHERE length(x.norm_title) = length(y.norm_title))
               WHERE off = 1 AND 1 - off * 1.0 / n > 0.92""",
            recursive=True,
        ),
        "stitch_components": _with(EDGES, "SELECT unit_idx, chat_id FROM component", recursive=True),
        "stitch_exact_titles": _with(
            PROFILES,
            "SELECT unit_idx, min(unit_idx) OVER (PARTITION BY norm_title) AS chat_id FROM profile",
        ),
        "merged_archive": _with(
            EDGES,
            _merged_archive_body(),
            recursive=True,
        ),
        "sender_scores": _with(SCORES, "SELECT * FROM score"),
        "detect_owner": _with(
            SCORES,
            """SELECT sender AS owner FROM score
               ORDER BY chats - titled_as_other DESC, messages DESC LIMIT 1""",
        ),
        "owner_override_exact": _with(
            SCORES, "SELECT sender AS owner FROM score WHERE lower(sender) = 'contact 7'"
        ),
        "owner_override_unknown": "SELECT 'Quentin Zyx' AS owner",
        "outgoing_flags": _with(
            MERGED,
            f"""SELECT conv_id AS chat_id, count(*) FILTER (WHERE sender = '{OWNER}') AS outgoing,
                count(*) AS n FROM m GROUP BY conv_id""",
        ),
        "chat_list": _with(
            CHATS,
            """SELECT chat_rank, chat_id, title, key, is_group, n_people, n_sources,
               start_ts, end_ts, n_messages FROM chat""",
        ),
        "direct_chats": _with(CHATS, "SELECT chat_id, title FROM chat WHERE NOT is_group"),
        "media_chats": _with(
            CHATS,
            """SELECT chat_id, title FROM chat
               WHERE chat_id IN (SELECT conv_id FROM m WHERE kind = 'media')""",
        ),
        "participants": _with(CHATS, "SELECT conv_id AS chat_id, sender, n, person_idx FROM people"),
        "chat_header": _with(
            CHATS,
            f"""SELECT chat_id, CASE WHEN is_group
                 THEN concat(coalesce((SELECT string_agg(sender, ', ' ORDER BY rn) FROM other o
                        WHERE o.conv_id = chat_id AND rn <= 6), ''),
                      CASE WHEN coalesce((SELECT max(rn) FROM other o WHERE o.conv_id = chat_id), 0)
                           > 6 THEN concat(' +', (SELECT max(rn) FROM other o
                             WHERE o.conv_id = chat_id) - 6) ELSE '' END)
                 ELSE concat(strftime(start_ts, '%d/%m/%Y'), ' – ', strftime(end_ts, '%d/%m/%Y'),
                      '  ·  ', format('{{:,}}', n_messages), ' messages') END AS line
               FROM chat""".replace(
                "FROM other o", f"FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY person_idx) AS rn FROM people WHERE sender <> '{OWNER}') o"
            ),
        ),
        "archive_title": _with(
            CHATS, "SELECT concat('Archive · ', count(*), ' conversations') AS title FROM chat"
        ),
        "parse_roundtrip": _with(
            V,
            r"""SELECT unit_idx, row_number() OVER (PARTITION BY unit_idx ORDER BY msg_no) - 1 AS msg_no,
                ts, sender, kind, omitted, filename, has_seconds,
                rtrim(text, concat(' ', chr(9), chr(10), chr(13))) AS text FROM v""",
        ),
        "date_order_sniff": f"""
WITH s AS (
  SELECT CAST(user_id AS BIGINT) AS unit_idx, user_id % 3 AS style,
         date_trunc('second', ts) AS ts FROM events
),
o AS (
  SELECT unit_idx, CASE WHEN any_value(style) = 2 THEN 'ymd'
    WHEN any_value(style) = 1 AND max(day(ts)) > 12 THEN 'mdy' ELSE 'dmy' END AS date_order
  FROM s GROUP BY unit_idx
),
r AS (
  SELECT s.unit_idx, o.date_order,
    CASE WHEN s.style = 1 AND o.date_order = 'dmy'
         THEN make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), second(ts)::DOUBLE)
         ELSE ts END AS ts
  FROM s JOIN o ON s.unit_idx = o.unit_idx
)
SELECT unit_idx, any_value(date_order) AS date_order, max(day(ts)) <= 12 AS ambiguous,
       count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY unit_idx""",
        "attachment_kinds": f"""
WITH f AS (
  SELECT doc_id, ([{exts}])[doc_id % {len(EXTENSIONS)} + 1] AS ext,
         concat(CASE WHEN doc_id % 5 = 0 THEN 'PTT-' ELSE 'FILE-' END, doc_id, '.',
                ([{exts}])[doc_id % {len(EXTENSIONS)} + 1]) AS filename
  FROM documents
),
t(ext, kind, mime) AS (VALUES
  ('jpg', 'image', 'image/jpeg'),
  ('jpeg', 'image', 'image/jpeg'),
  ('png', 'image', 'image/png'),
  ('gif', 'gif', 'image/gif'),
  ('webp', 'sticker', 'image/webp'),
  ('heic', 'image', 'image/heic'),
  ('bmp', 'image', 'image/bmp'),
  ('mp4', 'video', 'video/mp4'),
  ('mov', 'video', 'video/quicktime'),
  ('3gp', 'video', 'video/3gpp'),
  ('webm', 'video', 'video/webm'),
  ('avi', 'video', 'video/x-msvideo'),
  ('opus', 'voice', 'audio/ogg'),
  ('ogg', 'voice', 'audio/ogg'),
  ('m4a', 'audio', 'audio/mp4'),
  ('aac', 'audio', 'audio/aac'),
  ('mp3', 'audio', 'audio/mpeg'),
  ('wav', 'audio', 'audio/wav'),
  ('amr', 'audio', 'audio/amr'),
  ('vcf', 'contact', 'text/vcard'),
  ('pdf', 'document', 'application/pdf'))
SELECT doc_id, CASE WHEN t.kind = 'contact' THEN 'contact' ELSE 'media' END AS kind, filename,
       CASE WHEN t.kind = 'audio' AND starts_with(filename, 'PTT-') THEN 'voice'
            ELSE coalesce(t.kind, 'document') END AS attachment_kind,
       coalesce(mime, 'application/octet-stream') AS mime
FROM f LEFT JOIN t ON f.ext = t.ext""",
        "message_kinds": """
WITH c AS (SELECT *, conv_id % 8 AS style, translate(text, chr(13) || chr(10), '  ') AS first FROM conversations),
h AS (
  SELECT *, CASE style WHEN 0 THEN 'deleted' WHEN 1 THEN 'poll' WHEN 2 THEN 'call' WHEN 3 THEN 'location'
    WHEN 4 THEN 'media' WHEN 6 THEN 'contact' ELSE 'text' END AS spoken,
    CASE style WHEN 0 THEN 'This message was deleted' WHEN 1 THEN concat('POLL: ', first)
      WHEN 2 THEN 'Missed voice call' WHEN 3 THEN concat(first, ' https://maps.google.com/?q=1,2')
      WHEN 4 THEN '' WHEN 5 THEN rtrim(first, concat(' ', chr(9), chr(13))) WHEN 6 THEN '' ELSE first END AS kept,
    CASE style WHEN 0 THEN concat(chr(8206), 'This message was deleted') WHEN 4 THEN 'image omitted'
      WHEN 6 THEN concat('Card-', turn, '.vcf (file attached)') END AS notice
  FROM c
)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system' ELSE spoken END AS kind,
       style = 5 AS edited,
       CASE WHEN role = 'system' THEN coalesce(notice, kept) ELSE kept END AS text
FROM h""",
        "system_lines": """
SELECT conv_id, turn,
  CASE WHEN turn % 4 = 0 THEN role
       WHEN turn % 4 = 3 AND length(repeat(role, 20)) <= 72 THEN repeat(role, 20) END AS sender,
  CASE turn % 4 WHEN 0 THEN translate(text, chr(13) || chr(10), '  ')
    WHEN 1 THEN concat(role, ' changed the subject to "Q1: close" ', translate(text, chr(13) || chr(10), '  '))
    WHEN 2 THEN concat(role, ': ', translate(text, chr(13) || chr(10), '  '))
    ELSE concat(repeat(role, 20), ': ', translate(text, chr(13) || chr(10), '  ')) END AS text
FROM conversations""",
        "rare_senders": """
WITH r AS (
  SELECT conv_id AS unit_idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_no,
    CASE WHEN turn = 1 OR (turn = 2 AND conv_id % 2 = 0) THEN 'Zoe left' ELSE role END AS sender,
    count(*) FILTER (WHERE turn = 1 OR (turn = 2 AND conv_id % 2 = 0)) OVER (PARTITION BY conv_id) AS n,
    trim(translate(text, chr(13) || chr(10), '  ')) AS body
  FROM conversations
)
SELECT unit_idx, msg_no, CASE WHEN sender = 'Zoe left' AND n = 1 THEN NULL ELSE sender END AS sender,
  CASE WHEN sender = 'Zoe left' AND n = 1 THEN 'system' ELSE 'text' END AS kind,
  CASE WHEN sender = 'Zoe left' AND n = 1 THEN concat('Zoe left: ', body) ELSE body END AS text
FROM r""",
        "parse_warnings": """
WITH c AS (
  SELECT conv_id AS unit_idx, conv_id % 4 AS style, concat('t', conv_id, '.txt') AS label,
    count(*) FILTER (WHERE conv_id % 4 = 3 OR (conv_id % 4 = 2 AND turn = 0)) AS loose,
    count(*) FILTER (WHERE NOT (conv_id % 4 = 3 OR (conv_id % 4 = 2 AND turn = 0))) AS kept
  FROM conversations GROUP BY conv_id
)
SELECT unit_idx, 'ignored_lines' AS code,
  concat(label, ': ', loose, ' line(s) stand before any message and belong to none') AS message
FROM c WHERE loose > 0
UNION ALL
SELECT unit_idx, 'no_messages', concat(label, ': found no line that begins with a date and time')
FROM c WHERE kept = 0
UNION ALL
SELECT unit_idx, 'ambiguous_dates', concat(label, ': day and month cannot be told apart in any date; read as day first, '
  'date_order=''mdy'' reads them the other way') FROM c WHERE style <> 1""",
        "clean_titles": """
SELECT doc_id, CASE doc_id % 7
  WHEN 4 THEN concat(lang, ' ', doc_id) WHEN 5 THEN 'Unknown chat'
  ELSE concat(lang, '.', doc_id) END AS title FROM documents""",
        "unit_labels": """
SELECT doc_id, concat(source, '.zip', CASE WHEN rn > 1 THEN concat(' (', rn, ')') ELSE '' END) AS label
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""",
        "expand_archives": _with(
            V + "," + LINES,
            """SELECT concat('/exports/', label) AS archive, member AS path,
                 CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes, sha1(content) AS sha1 FROM (
               SELECT label, CASE WHEN unit_idx % 2 = 0 THEN '_chat.txt'
                  ELSE concat(replace(label, '.zip', ''), '.txt') END AS member, content FROM doc
               UNION ALL
               SELECT label, 'pictures/one.jpg', CASE WHEN unit_idx % 2 = 0 THEN '_chat.txt'
                  ELSE concat(replace(label, '.zip', ''), '.txt') END FROM doc)""",
        ),
        "archive_units": _with(
            V + "," + LINES,
            """SELECT concat('/exports/', label) AS archive,
                 CASE WHEN unit_idx % 2 = 0 THEN '_chat.txt'
                  ELSE concat(replace(label, '.zip', ''), '.txt') END AS path,
                 replace(label, '.zip', '') AS hint_title, CAST(1 AS BIGINT) AS n_transcripts FROM doc""",
        ),
        "archives_to_messages": _with(
            V,
            """SELECT concat('/exports/', label) AS archive,
                 row_number() OVER (PARTITION BY unit_idx ORDER BY msg_no) - 1 AS msg_no,
                 ts, sender, kind, has_seconds,
                 sha1(rtrim(text, concat(' ', chr(9), chr(10), chr(13)))) AS text_sha1 FROM v""",
        ),
        "media_resolve": _with(
            V + "," + RESOLVED,
            """SELECT v.unit_idx, v.msg_no, f.path, coalesce(length(f.bytes), 0) AS size, f.content_hash
               FROM v LEFT JOIN file f ON v.unit_idx = f.unit_idx AND v.msg_no = f.msg_no
               WHERE v.kind = 'media'""",
        ),
        "media_catalog": _with(
            RESOLVED_MERGED,
            """SELECT media_key, arg_min(filename, struct_pack(c := conv_id, i := msg_idx)) AS filename,
                 'image' AS kind, CAST(max(length(bytes)) AS BIGINT) AS size, count(*) AS n_messages,
                 'inlined' AS status,
                 concat('data:image/jpeg;base64,', base64(encode(max(bytes)))) AS src
               FROM (SELECT *, sha256(b) AS media_key, b AS bytes FROM (
                 SELECT *, concat(conv_id, '-', regexp_extract(filename, '-([0-9]+)[.]jpg$', 1)) AS b
                 FROM m WHERE filename IS NOT NULL)) GROUP BY media_key""",
        ),
        "media_external_names": _with(
            RESOLVED_MERGED,
            """SELECT media_key, name, concat('media/', name) AS src FROM (
               SELECT media_key, CASE WHEN rn = 1 THEN 'photo_1.jpg'
                        ELSE concat('photo_1_', rn, '.jpg') END AS name FROM (
                 SELECT media_key, row_number() OVER (ORDER BY c, i) AS rn FROM (
                   SELECT sha256(concat(conv_id, '-', regexp_extract(filename, '-([0-9]+)[.]jpg$', 1)))
                     AS media_key, min(conv_id) AS c, min(msg_idx) AS i
                   FROM m WHERE filename IS NOT NULL GROUP BY 1)))""",
        ),
        "media_report": _with(
            RESOLVED_MERGED,
            """SELECT count(*) FILTER (WHERE filename IS NOT NULL AND size <= 3) AS inlined,
                 count(*) FILTER (WHERE filename IS NOT NULL AND size > 3) AS copied,
                 count(*) FILTER (WHERE filename IS NULL) AS missing,
                 CAST(coalesce(sum(size * 4 // 3) FILTER (WHERE filename IS NOT NULL AND size <= 3), 0) AS BIGINT)
                   AS bytes_embedded
               FROM (SELECT *, length(concat(conv_id, '-', regexp_extract(filename, '-([0-9]+)[.]jpg$', 1)))
                       AS size FROM m WHERE kind = 'media')""",
        ),
        "stored_messages": _with(
            MERGED,
            "SELECT conv_id AS chat_id, msg_idx, ts, sender, text FROM m WHERE conv_id = 7 AND msg_idx BETWEEN 1 AND 3",
        ),
        "search_messages": _with(
            CHATS,
            f"""SELECT chat_rank, chat_id, title, msg_idx, ts, sender,
                 concat(CASE WHEN pos > 34 + 1 THEN '…' ELSE '' END,
                   substr(hay, greatest(pos - 34, 1), pos - greatest(pos - 34, 1)),
                   '«', substr(hay, pos, {len(SEARCH_TERM)}), '»',
                   substr(hay, pos + {len(SEARCH_TERM)}, 90)) AS snippet
               FROM (SELECT c.chat_rank, c.chat_id, c.title, x.*,
                       strpos(lower(strip_accents(hay)), '{SEARCH_TERM}') AS pos
                     FROM (SELECT conv_id, msg_idx, ts, sender,
                             CASE WHEN text <> '' THEN text ELSE coalesce(filename, '') END AS hay FROM m) x
                     JOIN chat c ON c.chat_id = x.conv_id)
               WHERE pos > 0""",
        ),
        "search_indexed": _with(
            CHATS,
            f"""SELECT chat_rank, chat_id, title, msg_idx, ts, sender,
                 concat(CASE WHEN pos > 34 + 1 THEN '…' ELSE '' END,
                   substr(hay, greatest(pos - 34, 1), pos - greatest(pos - 34, 1)),
                   '«', substr(hay, pos, {len(SEARCH_TERM)}), '»',
                   substr(hay, pos + {len(SEARCH_TERM)}, 90)) AS snippet
               FROM (SELECT c.chat_rank, c.chat_id, c.title, x.*,
                       strpos(lower(strip_accents(hay)), '{SEARCH_TERM}') AS pos
                     FROM (SELECT conv_id, msg_idx, ts, sender,
                             CASE WHEN text <> '' THEN text ELSE coalesce(filename, '') END AS hay FROM m) x
                     JOIN chat c ON c.chat_id = x.conv_id)
               WHERE pos > 0""",
        ),
        "search_accents": _with(
            CHATS,
            f"""SELECT c.chat_rank, c.chat_id, m.msg_idx FROM m JOIN chat c ON c.chat_id = m.conv_id
               WHERE c.is_group AND contains(lower(strip_accents(
                 CASE WHEN text <> '' THEN text ELSE coalesce(filename, '') END)), 'le')""",
        ),
        "last_preview": _with(
            CHATS,
            rf"""SELECT c.chat_id, x.ts, coalesce(x.sender = '{OWNER}', false) AS outgoing,
                 CASE WHEN c.is_group AND x.sender IS NOT NULL AND x.sender <> '{OWNER}'
                      THEN concat(x.sender, ': ') ELSE '' END AS prefix,
                 substr(regexp_replace(CASE WHEN x.kind = 'media' AND x.text = ''
                   THEN CASE WHEN x.omitted THEN 'Media' ELSE 'Photo' END ELSE x.text END,
                   '\s+', ' ', 'g'), 1, 120) AS body
               FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS back FROM m) x
               JOIN chat c ON c.chat_id = x.conv_id WHERE back = 1""",
        ),
        "sender_share": _with(
            MERGED,
            f"""SELECT conv_id AS chat_id, sender, n, {pct('n', 'total')} AS pct FROM (
                 SELECT conv_id, sender, count(*) AS n,
                   CAST(sum(count(*)) OVER (PARTITION BY conv_id) AS BIGINT) AS total
                 FROM m GROUP BY conv_id, sender) WHERE sender IS NOT NULL""",
        ),
        "attachment_share": _with(
            MERGED,
            f"""SELECT conv_id AS chat_id, att AS kind, n, {pct('n', 'total')} AS pct FROM (
                 SELECT conv_id, CASE WHEN omitted THEN 'missing' ELSE 'image' END AS att, count(*) AS n,
                   CAST(sum(count(*)) OVER (PARTITION BY conv_id) AS BIGINT) AS total
                 FROM m WHERE kind = 'media' GROUP BY conv_id, omitted)""",
        ),
        "source_contribution": _with(
            MERGED,
            """SELECT u.conv_id AS chat_id, u.unit_idx AS source_idx, u.label, coalesce(n, 0) AS n
               FROM u LEFT JOIN (SELECT unnest(sources) AS s, count(*) AS n FROM m GROUP BY 1) x
                 ON u.unit_idx = x.s""",
        ),
        "archive_sources": _with(
            MERGED,
            """SELECT u.unit_idx AS source_idx, u.label, coalesce(n, 0) AS n
               FROM u LEFT JOIN (SELECT unnest(sources) AS s, count(*) AS n FROM m GROUP BY 1) x
                 ON u.unit_idx = x.s""",
        ),
        "chat_overview": _with(
            MERGED,
            """SELECT conv_id AS chat_id, count(*) AS n_messages, min(ts) AS first_ts, max(ts) AS last_ts,
                 greatest(1, CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400 + 0.5) AS BIGINT) + 1) AS span_days,
                 count(*) FILTER (WHERE kind = 'media') AS n_attachments,
                 count(*) FILTER (WHERE len(sources) > 1) AS n_confirmed
               FROM m GROUP BY conv_id""",
        ),
        "archive_stats": _with(
            MERGED,
            f"""SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages,
                 count(*) FILTER (WHERE kind = 'media') AS attachments,
                 (SELECT count(*) FROM u) AS sources,
                 count(*) FILTER (WHERE len(sources) > 1) AS confirmed,
                 min(ts) AS first_ts, max(ts) AS last_ts, '{OWNER}' AS owner FROM m""",
        ),
        "busiest_chats": _with(
            CHATS,
            f"""SELECT chat_id, title, n_messages, {pct('n_messages', 'total')} AS pct FROM (
                 SELECT *, CAST(sum(n_messages) OVER () AS BIGINT) AS total FROM chat)
               ORDER BY n_messages DESC, chat_rank LIMIT 10""",
        ),
        "latest_media_archive": _with(
            CHATS,
            f"""SELECT m.conv_id AS chat_id, m.msg_idx, m.ts, m.filename, 'image' AS kind
               FROM m JOIN chat c ON c.chat_id = m.conv_id WHERE m.filename IS NOT NULL
               ORDER BY m.ts DESC, c.chat_rank, m.msg_idx LIMIT 300""",
        ),
        "latest_media_per_chat": _with(
            MERGED,
            """SELECT conv_id AS chat_id, msg_idx, ts, filename, 'image' AS kind, nth FROM (
                 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx DESC) AS nth
                 FROM (SELECT conv_id, msg_idx, ts, filename FROM m WHERE filename IS NOT NULL))
               WHERE nth <= 1""",
        ),
        "media_ordinals": _with(
            MERGED,
            """SELECT conv_id AS chat_id, msg_idx,
                 row_number() OVER (PARTITION BY conv_id ORDER BY msg_idx) - 1 AS media_idx,
                 CASE WHEN filename IS NOT NULL THEN
                   count(filename) OVER (PARTITION BY conv_id ORDER BY msg_idx) - 1
                   ELSE -1 END AS viewable_idx
               FROM m WHERE kind = 'media'""",
        ),
        "sender_runs": _with(
            EVENTS,
            f"""SELECT chat_id, msg_idx, sender, run_start,
                 CASE WHEN kind <> 'system' THEN
                   CAST(sum(CASE WHEN run_start THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY msg_idx)
                     AS BIGINT) ELSE 0 END AS run_no
               FROM (SELECT *, kind <> 'system' AND (pt IS NULL OR CAST(ts AS DATE) <> CAST(pt AS DATE)
                   OR sender IS DISTINCT FROM ps OR pk = 'system'
                   OR floor(epoch(ts)) - floor(epoch(pt)) > 900) AS run_start
                 FROM (SELECT *, lag(ts) OVER w AS pt, lag(sender) OVER w AS ps, lag(kind) OVER w AS pk
                       FROM e WINDOW w AS (PARTITION BY chat_id ORDER BY msg_idx)))""",
        ),
        "day_labels": _with(
            MERGED,
            f"""SELECT conv_id AS chat_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, min(msg_idx) AS first_idx, count(*) AS n,
                 {day_label('arg_min(ts, msg_idx)')} AS label
               FROM m GROUP BY conv_id, CAST(ts AS DATE)""",
        ),
        "chat_stamps": _with(
            MERGED,
            f"""SELECT chat_id, CASE WHEN label = 'Today' THEN strftime(ts, '%H:%M') ELSE label END AS stamp
               FROM (SELECT conv_id AS chat_id, max(ts) AS ts, {day_label('max(ts)')} AS label
                     FROM m GROUP BY conv_id)""",
        ),
        "page_window": _with(
            EVENTS,
            f"""SELECT e.chat_id, e.msg_idx, e.event_id, from_idx AS above FROM e JOIN (
                 SELECT chat_id, greatest(greatest(CASE WHEN chat_id = 3 THEN 500 - 83
                   ELSE count(*) - 250 END, 0) - 250, 0) AS from_idx
                 FROM e GROUP BY chat_id) s ON e.chat_id = s.chat_id
               WHERE e.msg_idx >= s.from_idx""",
        ),
        "deep_link": _with(
            CHATS,
            """SELECT c.chat_id, c.title, m.ts, m.sender FROM chat c JOIN m ON c.chat_id = m.conv_id
               WHERE c.key = 'contact 7' AND m.msg_idx = 1""",
        ),
        "payload_codes": _with(
            CHATS,
            f"""SELECT m.conv_id AS chat_id, m.msg_idx, CAST(epoch(m.ts) AS BIGINT) AS t,
                 coalesce(pe.person_idx, -1) AS w,
                 CASE m.kind WHEN 'system' THEN 'y' WHEN 'media' THEN 'm' END AS k,
                 nullif(m.text, '') AS b,
                 CASE WHEN m.sender = '{OWNER}' THEN 1 ELSE 0 END AS o,
                 array_to_string(m.sources, ',') AS r
               FROM m LEFT JOIN people pe ON m.conv_id = pe.conv_id AND m.sender = pe.sender""",
        ),
        "chat_documents": _with(
            CHATS,
            f"""SELECT m.conv_id AS chat_id, m.msg_idx, c.title, CAST(epoch(m.ts) AS BIGINT) AS t,
                 coalesce(pe.person_idx, -1) AS w,
                 CASE m.kind WHEN 'system' THEN 'y' WHEN 'media' THEN 'm' END AS k,
                 nullif(m.text, '') AS b,
                 CASE WHEN m.kind = 'media' THEN CASE WHEN m.omitted THEN 'missing' ELSE 'image' END END AS file_kind,
                 m.filename AS file,
                 CASE WHEN m.sender = '{OWNER}' THEN 1 ELSE 0 END AS o,
                 array_to_string(m.sources, ',') AS r
               FROM m JOIN chat c ON c.chat_id = m.conv_id
               LEFT JOIN people pe ON m.conv_id = pe.conv_id AND m.sender = pe.sender""",
        ),
        "archive_documents": _with(
            PROFILES,
            f"""SELECT part, row_number() OVER (PARTITION BY part ORDER BY unit_idx) - 1 AS nth, entry, 'All' AS title,
                 '{OWNER}' AS owner, (SELECT count(DISTINCT label) FROM v) AS n_sources
               FROM (SELECT 'sources' AS part, min(unit_idx) AS unit_idx, label AS entry FROM v GROUP BY label
                     UNION ALL
                     SELECT 'notes', unit_idx, concat(unit_idx, '|short|', title, ' is short')
                     FROM profile WHERE n_messages < 3)""",
        ),
        "jumbo": """
SELECT conv_id, turn, turn % 4 IN (0, 3) AS jumbo, false AS text_jumbo FROM conversations""",
        "stamps_and_sizes": """
WITH b AS (SELECT *, floor(pow(value + 1, 6.0)) AS n FROM events)
SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS stamp, strftime(ts, '%H:%M') AS clock,
  CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
  CASE WHEN n < 1024 THEN concat(CAST(n AS BIGINT), ' B')
       WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
       WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576)
       ELSE printf('%.1f GB', n / 1073741824) END AS size
FROM b""",
        "plain_text": r"""
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN concat('bold text and ', chr(57344), 'x', chr(57345), chr(57348), 'a ', chr(57346), text)
  WHEN 1 THEN concat('slanted, gone *code* ', text)
  WHEN 2 THEN concat('block _x_', chr(10), text)
  ELSE text END AS text
FROM documents""",
        "links": r"""
WITH x AS (
  SELECT page_id, regexp_extract_all(concat('see ', url, '), www.example.org/a! ', html),
    '((?:https?://|www\.)[^\s<>"'']+[^\s<>"''.,;:!?)\]}])', 1) AS urls FROM pages
)
SELECT page_id AS chat_id, CAST(i - 1 AS INTEGER) AS nth,
  CASE WHEN starts_with(urls[i], 'www.') THEN concat('https://', urls[i]) ELSE urls[i] END AS url
FROM (SELECT page_id, urls, unnest(range(1, len(urls) + 1)) AS i FROM x)""",
    }
    return sql


def _merged_archive_body() -> str:
    """The merged archive with stitched chats instead of given ones."""
    merged = MERGED[MERGED.index(",\nd AS") + 1 :]
    chats = CHATS[CHATS.index(",\npeople AS") + 1 :]
    keyed = "k2 AS (SELECT k.* REPLACE (c.chat_id AS conv_id) FROM k JOIN component c ON k.unit_idx = c.unit_idx)"
    merged = merged.replace("FROM k", "FROM k2").replace("FROM v GROUP BY unit_idx)", "FROM k2 GROUP BY unit_idx)")
    chats = chats.replace("FROM v GROUP BY unit_idx)", "FROM k2 GROUP BY unit_idx)")
    return f"""
, {keyed}, {merged}, {chats}
SELECT chat_id, title, is_group, n_people, n_sources,
  (SELECT sender FROM (
     SELECT x.sender, sum(n) AS messages,
            count(*) - count(*) FILTER (WHERE lower(x.sender) = lower(first_title)) AS score
     FROM (SELECT sender, conv_id, count(*) AS n FROM m WHERE sender IS NOT NULL GROUP BY sender, conv_id) x
     JOIN (SELECT conv_id, arg_min(title, unit_idx) AS first_title FROM u GROUP BY conv_id) y
       ON x.conv_id = y.conv_id
     GROUP BY x.sender) ORDER BY score DESC, messages DESC LIMIT 1) AS owner,
  start_ts, end_ts, n_messages FROM chat"""
