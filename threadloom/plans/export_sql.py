"""DuckDB SQL of the queries over raw exports: nested JSON taken apart by its own functions, ancestors by recursion."""

from __future__ import annotations

_SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def decoded(x: str, times: int = 2) -> str:
    """JSON text inside a JSON string, read as what it encodes."""
    for _ in range(times):
        x = (
            f"list_transform([{x}], lambda v: CASE WHEN json_type(v) = 'VARCHAR' AND left(ltrim(v->>'$'), 1) IN ('{{', '[', '\"') AND json_valid(v->>'$') "
            "AND json_type((v->>'$')::JSON) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN (v->>'$')::JSON ELSE v END)[1]"
        )
    return x


def scalar(x: str) -> str:
    """A field as text where it is text or a number and not blank."""
    return f"CASE WHEN json_type({x}) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') AND {strip(f'({x})->>{chr(39)}${chr(39)}')} <> '' THEN ({x})->>'$' END"


def items(x: str, where: str, columns: str) -> str:
    """The elements of the JSON list ``x`` of ``where``, with their positions from 0."""
    return f"SELECT {columns}, CAST(i AS INTEGER) AS i, json_extract({x}, '$[' || CAST(i AS VARCHAR) || ']') AS item FROM {where}, unnest(range(CAST(json_array_length({x}) AS BIGINT))) AS g(i) WHERE json_type({x}) = 'ARRAY'"


CONVERSATIONS = f"""
    WITH RECURSIVE records AS (
      SELECT export_id, {decoded('record::JSON')} AS v FROM (SELECT DISTINCT export_id, record FROM export_records WHERE trim(coalesce(record, '')) <> '' AND json_valid(record))),
    tops AS (SELECT export_id, v, CASE WHEN json_type(v) = 'OBJECT' THEN {decoded("v->'conversations'")} WHEN json_type(v) = 'ARRAY' THEN v END AS many FROM records),
    found AS (
      SELECT export_id, 0 AS pos, v AS c FROM tops WHERE json_type(v) = 'OBJECT' AND coalesce(json_type(many), '') <> 'ARRAY'
      UNION ALL SELECT export_id, i, {decoded('item')} FROM ({items('many', 'tops', 'export_id')})),
    convs AS (SELECT export_id, pos, c FROM found WHERE json_type(c) = 'OBJECT')"""

P3_FOUND = (
    CONVERSATIONS
    + f""",
    keyed AS (
      SELECT export_id, pos, coalesce({scalar("c->'id'")}, {scalar("c->'conversation_id'")}, {scalar("c->'uuid'")}, CAST(export_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)) AS ck,
        {decoded("c->'mapping'")} AS m, {decoded("c->'chat_messages'")} AS chat, {decoded("c->'messages'")} AS plain FROM convs),
    tree AS (
      SELECT export_id, pos, ck, k, {decoded('''json_extract(m, '$."' || k || '"')''')} AS entry
      FROM (SELECT export_id, pos, ck, m, unnest(json_keys(m)) AS k FROM keyed WHERE json_type(m) = 'OBJECT')),
    nodes AS (
      SELECT export_id, pos, ck, k, CASE WHEN json_type(entry) = 'OBJECT' AND json_type(entry->'parent') = 'VARCHAR' THEN entry->>'parent' END AS up,
        CASE WHEN json_type(entry) = 'OBJECT' THEN {decoded("entry->'message'")} END AS msg FROM tree),
    climb AS (
      SELECT export_id, pos, k AS start, up AS at, 0 AS steps FROM nodes WHERE json_type(msg) = 'OBJECT'
      UNION ALL
      SELECT c.export_id, c.pos, c.start, n.up, c.steps + 1 FROM climb c JOIN nodes n ON n.export_id = c.export_id AND n.pos = c.pos AND n.k = c.at
      WHERE coalesce(json_type(n.msg), '') <> 'OBJECT' AND c.steps < 1000),
    above AS (
      SELECT c.export_id, c.pos, c.start, max(n.k) AS parent FROM climb c JOIN nodes n ON n.export_id = c.export_id AND n.pos = c.pos AND n.k = c.at AND json_type(n.msg) = 'OBJECT' GROUP BY ALL),
    listed AS (
      SELECT export_id, pos, ck, i, 1 AS rank, {decoded('item')} AS msg FROM ({items('chat', 'keyed', 'export_id, pos, ck, m')}) WHERE NOT coalesce(json_type(m) = 'OBJECT' AND len(json_keys(m)) > 0, false)
      UNION ALL
      SELECT export_id, pos, ck, i, 2, {decoded('item')} FROM ({items('plain', 'keyed', 'export_id, pos, ck, m')}) WHERE NOT coalesce(json_type(m) = 'OBJECT' AND len(json_keys(m)) > 0, false)),
    objects AS (SELECT *, min(rank) OVER (PARTITION BY export_id, pos) AS least FROM listed WHERE json_type(msg) = 'OBJECT'),
    messages AS (
      SELECT n.export_id, n.ck, n.k AS key, coalesce(a.parent, n.ck) AS parent, n.msg FROM nodes n LEFT JOIN above a ON a.export_id = n.export_id AND a.pos = n.pos AND a.start = n.k WHERE json_type(n.msg) = 'OBJECT'
      UNION ALL
      SELECT export_id, ck, coalesce({scalar("msg->'uuid'")}, CAST(i AS VARCHAR)), ck, msg FROM objects WHERE rank = least),
    fields AS (
      SELECT export_id, ck, key, {decoded("msg->'content'")} AS content, {decoded("msg->'text'")} AS said, {decoded("msg->'attachments'")} AS att, {decoded("msg->'metadata'")} AS meta FROM messages),
    lists AS (
      SELECT export_id, ck, key, CASE WHEN json_type(content) = 'OBJECT' THEN {decoded("content->'parts'")} ELSE content END AS parts, said, att, CASE WHEN json_type(meta) = 'OBJECT' THEN {decoded("meta->'attachments'")} END AS more FROM fields),
    chosen AS (
      SELECT export_id, ck, key, CASE WHEN json_type(parts) = 'ARRAY' AND len(list_filter(CAST(parts AS JSON[]), lambda x: json_type(x) <> 'NULL')) > 0 THEN parts ELSE said END AS parts,
        CASE WHEN json_type(att) = 'ARRAY' AND len(list_filter(CAST(att AS JSON[]), lambda x: json_type(x) <> 'NULL')) > 0 THEN att ELSE more END AS att FROM lists)
    SELECT export_id, ck AS conversation_key, 'conversation' AS kind, ck AS child_key, CAST(export_id AS VARCHAR) AS parent_key FROM keyed
    UNION SELECT export_id, ck, 'message', key, parent FROM messages
    UNION SELECT export_id, ck, 'part', key || '/parts/' || CAST(i AS VARCHAR), key FROM ({items('parts', 'chosen', 'export_id, ck, key')}) WHERE json_type(item) <> 'NULL'
    UNION SELECT export_id, ck, 'attachment', key || '/attachments/' || CAST(i AS VARCHAR), key FROM ({items('att', 'chosen', 'export_id, ck, key')}) WHERE json_type(item) <> 'NULL'"""
)


def truthy(x: str) -> str:
    return f"(coalesce(json_type({x}), 'NULL') <> 'NULL' AND CAST({x} AS VARCHAR) NOT IN ('\"\"', '0', '0.0', '-0.0', 'false', '[]', '{{}}'))"


def first(*values: str) -> str:
    """The first value that isn't empty, as JSON."""
    return "CASE " + " ".join(f"WHEN {truthy(x)} THEN {x}" for x in values) + " END"


def text(x: str) -> str:
    return f"CASE WHEN json_type({x}) <> 'NULL' THEN ({x})->>'$' END"


def instant(x: str) -> str:
    """Seconds since 1970 as text in UTC; only numbers state a time."""
    micros = f"CAST(round_even(CAST(({x})->>'$' AS DOUBLE) * 1e6, 0) AS BIGINT)"
    return (
        f"CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN {micros} % 1000000 <> 0 THEN strftime(make_timestamp({micros}), '.%f') ELSE '' END || '+00:00' END"
    )


_FORMATS = f"""{CONVERSATIONS},
    formats AS (
      SELECT export_id, CASE WHEN list_has_any(json_keys(c), ['mapping', 'conversation_id']) THEN 'chatgpt' WHEN list_has_any(json_keys(c), ['chat_messages', 'uuid']) THEN 'claude' ELSE 'unknown' END AS format
      FROM (SELECT export_id, arg_min(c, pos) AS c FROM convs GROUP BY export_id)),
    talks AS (
      SELECT export_id, pos, format, c, {decoded("c->'mapping'")} AS m,
        CASE WHEN format = 'claude' AND list_contains(json_keys(c), 'chat_messages') THEN {decoded("c->'chat_messages'")} ELSE {decoded("c->'messages'")} END AS listed
      FROM convs JOIN formats USING (export_id) WHERE format <> 'unknown')"""

EXPORT_HEADS = f"""{_FORMATS}
    SELECT export_id, pos AS "position", format,
      CASE format WHEN 'chatgpt' THEN coalesce({text(first("c->'id'", "c->'conversation_id'"))}, left(sha1(coalesce(c->>'title', '') || coalesce(c->>'create_time', '')), 12))
        ELSE coalesce({text(first("c->'uuid'", "c->'id'"))}, left(sha1(coalesce(c->>'name', '') || coalesce(c->>'created_at', '')), 12)) END AS id,
      coalesce(CASE format WHEN 'chatgpt' THEN {text(first("c->'title'"))} ELSE {text(first("c->'name'", "c->'title'"))} END, 'Untitled') AS title,
      CASE format WHEN 'chatgpt' THEN {instant("c->'create_time'")} ELSE {text("c->'created_at'")} END AS created_at,
      CASE format WHEN 'chatgpt' THEN {instant("c->'update_time'")} ELSE {text("c->'updated_at'")} END AS updated_at
    FROM talks"""

_JOINED = "array_to_string(list_filter(list_transform(CAST({0} AS JSON[]), lambda p: {1}), lambda t: t IS NOT NULL), chr(10))"
_SAID = _JOINED.format("parts", "CASE WHEN json_type(p) = 'VARCHAR' THEN p->>'$' END")
_LISTED = _JOINED.format("body", "CASE json_type(p) WHEN 'OBJECT' THEN coalesce(p->>'text', '') WHEN 'NULL' THEN NULL ELSE p->>'$' END")

EXPORT_MESSAGES = f"""{_FORMATS},
    entries AS (SELECT export_id, pos, m, unnest(json_keys(m)) AS k, unnest(range(CAST(len(json_keys(m)) AS BIGINT))) AS no FROM talks WHERE format = 'chatgpt' AND json_type(m) = 'OBJECT'),
    opened AS (SELECT export_id, pos, no, {decoded('''json_extract(m, '$."' || k || '"')''')} AS entry FROM entries),
    nodes AS (SELECT export_id, pos, no, CASE WHEN json_type(entry) = 'OBJECT' THEN {decoded("entry->'message'")} END AS msg FROM opened),
    tree AS (
      SELECT export_id, pos, no, msg, CASE WHEN json_type(msg->'create_time') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(msg->>'create_time' AS DOUBLE) ELSE 0 END AS moment,
        CASE WHEN json_type(msg->'content') = 'OBJECT' THEN {decoded("msg->'content'->'parts'")} END AS parts FROM nodes WHERE json_type(msg) = 'OBJECT'),
    spoken AS (
      SELECT export_id, pos, moment, no, CASE WHEN json_type(msg->'author') <> 'OBJECT' OR NOT list_contains(json_keys(msg->'author'), 'role') THEN 'unknown' ELSE msg->'author'->>'role' END AS role,
        CASE WHEN json_type(parts) = 'ARRAY' THEN {strip(_SAID)} ELSE '' END AS content, {instant("msg->'create_time'")} AS stamp FROM tree),
    rows_ AS (
      SELECT export_id, pos, format, i, {decoded('item')} AS msg
      FROM ({items('listed', 'talks', 'export_id, pos, format, m')}) WHERE NOT coalesce(format = 'chatgpt' AND json_type(m) = 'OBJECT' AND len(json_keys(m)) > 0, false)),
    bodies AS (SELECT export_id, pos, format, i, msg, CASE format WHEN 'chatgpt' THEN {first("msg->'content'")} ELSE {first("msg->'text'", "msg->'content'")} END AS body FROM rows_ WHERE json_type(msg) = 'OBJECT'),
    plain AS (
      SELECT export_id, pos, CAST(0 AS DOUBLE) AS moment, i AS no,
        CASE format WHEN 'chatgpt' THEN CASE WHEN list_contains(json_keys(msg), 'role') THEN msg->>'role' ELSE 'unknown' END ELSE coalesce({text(first("msg->'sender'", "msg->'role'"))}, 'unknown') END AS role,
        CASE format WHEN 'chatgpt' THEN body->>'$' ELSE {strip(f"CASE WHEN json_type(body) = 'ARRAY' THEN {_LISTED} ELSE coalesce(body->>'$', '') END")} END AS content,
        CASE format WHEN 'chatgpt' THEN {text("msg->'timestamp'")} ELSE {text(first("msg->'created_at'", "msg->'timestamp'"))} END AS stamp FROM bodies WHERE format = 'claude' OR body IS NOT NULL)
    SELECT export_id, pos AS "position", CAST(row_number() OVER (PARTITION BY export_id, pos ORDER BY moment, no) - 1 AS INTEGER) AS "pos", role, content, stamp AS "timestamp"
    FROM (SELECT * FROM spoken UNION ALL SELECT * FROM plain) WHERE coalesce(content, '') <> ''"""

EXPORT_REJECTS = f"""{CONVERSATIONS},
    formats AS (SELECT export_id, list_has_any(json_keys(arg_min(c, pos)), ['mapping', 'conversation_id', 'chat_messages', 'uuid']) AS known FROM convs GROUP BY export_id)
    SELECT export_id, CASE WHEN {strip("coalesce(record, '')")} = '' THEN 'blank' WHEN NOT json_valid(record) THEN 'invalid' ELSE 'unknown' END AS reason
    FROM export_records LEFT JOIN formats USING (export_id) WHERE NOT coalesce(known, false)"""
