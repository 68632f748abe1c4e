"""DuckDB SQL that each registered query is compared with.

The shared views are written out once, in dependency order, and put in front of
each query; DuckDB evaluates only those a query uses.
"""

from __future__ import annotations

_ALLOWED = "('.jpg','.jpeg','.heic','.png','.mp4','.mov','.mkv','.webm','.avi')"
_IMAGES = "('.jpg','.jpeg','.heic','.heif')"
_VIDEOS = "('.mp4','.mov','.mkv','.webm','.avi')"
_AS_OF = "TIMESTAMP '2024-03-05 12:34:56'"
_WALL = "'%Y-%m-%d %H:%M:%S'"


def _ext(path: str) -> str:
    return rf"lower(regexp_extract({path}, '\.[^./]*$'))"


def _parsed(value: str, colon_only: bool = False) -> str:
    """Wall clock text of a tag date, or NULL."""
    clock = r"([01]?\d|2[0-3]):[0-5]\d:[0-5]\d([.,]\d+)?"
    zone = r"(Z|[+-]([01]\d|2[0-4]):([0-5]\d|60))"
    day = r"\d{4}-\d{2}-\d{2}"
    shapes = [rf"\d{{4}}:\d{{2}}:\d{{2}} +{clock}"]
    if not colon_only:
        shapes += [rf"{day}T{clock}{zone}?", rf"{day} +{clock}"]
    at = rf"lpad(regexp_extract({value}, '[T ](\d{{1,2}}:\d{{2}}:\d{{2}})', 1), 8, '0')"
    stamp = f"try_cast(replace(substr({value}, 1, 10), ':', '-') || ' ' || {at} AS TIMESTAMP)"
    return (
        f"CASE WHEN regexp_full_match({value}, '{'|'.join(shapes)}') "
        f"THEN strftime({stamp}, {_WALL}) END"
    )


def _size_text(size: str) -> str:
    cases = [f"WHEN coalesce({size}, 0) = 0 THEN '-'", f"WHEN {size} < 1024 THEN {size} || ' B'"]
    for power, unit in enumerate("KMGTPE", start=1):
        test = f"WHEN {size} < {1024 ** (power + 1)}" if power < 6 else "ELSE"
        then = "THEN " if power < 6 else ""
        shown = f"printf('%.1f', {size} / {1024 ** power}.0::DOUBLE) || ' {unit}B'"
        cases.append(f"{test} {then}{shown}")
    return f"CASE {' '.join(cases)} END"


def _age_text(seconds: str) -> str:
    def counted(number: str, unit: str) -> str:
        return f"({number}) || CASE WHEN {number} = 1 THEN ' {unit}' ELSE ' {unit}s' END"

    return f"""CASE
      WHEN {seconds} // 86400 > 365 THEN {counted(f'{seconds} // 86400 // 365', 'year')}
      WHEN {seconds} // 86400 > 30 THEN {counted(f'{seconds} // 86400 // 30', 'month')}
      WHEN {seconds} // 86400 > 0 THEN {counted(f'{seconds} // 86400', 'day')}
      WHEN {seconds} > 3600 THEN {counted(f'{seconds} // 3600', 'hour')}
      ELSE 'moments' END"""


def _ago(seconds: str) -> str:
    return f"""CASE
      WHEN {seconds} // 86400 > 0 THEN printf('%d days, %d hours, %d minutes ago',
        {seconds} // 86400, {seconds} // 3600 % 24, {seconds} // 60 % 60)
      WHEN {seconds} // 3600 > 0 THEN printf('%d hours, %d minutes ago',
        {seconds} // 3600 % 24, {seconds} // 60 % 60)
      WHEN {seconds} // 60 > 0 THEN printf('%d minutes ago', {seconds} // 60)
      ELSE 'just now' END"""


def _placement(rows: str, name: str) -> str:
    """Views that walk rows one by one, carrying the keys taken so far."""
    return f"""
{name}_ordered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS n, path, dest_path, hash
  FROM {rows}
),
{name}_walk AS (
  SELECT 0::BIGINT AS n, NULL::VARCHAR AS path, NULL::VARCHAR AS state,
    NULL::VARCHAR AS existing_path, []::VARCHAR[] AS dests, []::VARCHAR[] AS hashes
  UNION ALL
  SELECT o.n, o.path,
    CASE WHEN list_contains(w.dests, o.dest_path) THEN 'skipped (destination exists)'
         WHEN list_contains(w.hashes, o.hash) THEN 'duplicate (hash exists)'
         ELSE 'copied' END,
    CASE WHEN NOT list_contains(w.dests, o.dest_path) AND list_contains(w.hashes, o.hash)
         THEN w.dests[list_position(w.hashes, o.hash)] END,
    CASE WHEN list_contains(w.dests, o.dest_path) OR list_contains(w.hashes, o.hash)
         THEN w.dests ELSE list_append(w.dests, o.dest_path) END,
    CASE WHEN list_contains(w.dests, o.dest_path) OR list_contains(w.hashes, o.hash)
         THEN w.hashes ELSE list_append(w.hashes, o.hash) END
  FROM {name}_walk w JOIN {name}_ordered o ON o.n = w.n + 1
)"""


_VIEWS = rf"""
base AS (
  SELECT doc_id,
    '/src/' || source || '/b' || (doc_id // 240) || '/IMG_'
      || printf('%06d', CASE WHEN doc_id % 9 = 0 THEN greatest(doc_id - 12, 0) ELSE doc_id END)
      || (['.jpg','.JPG','.jpeg','.heic','.png','.mp4','.MOV','.mkv','.webm','.avi','.txt',
           '.heif'])[doc_id % 12 + 1] AS path,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 7919 % 86400) AS mtime,
    strlen(text)::BIGINT AS size, md5(text) AS hash, text
  FROM documents
),
keyed AS (
  SELECT doc_id, path, mtime, size, hash, strftime(mtime, '%Y-%m') AS month,
    '/dest/' || strftime(mtime, '%Y-%m') || '/' || regexp_extract(path, '[^/]+$') AS dest_path
  FROM base
),
faulty AS (
  SELECT doc_id, path, CASE WHEN doc_id % 61 <> 5 THEN mtime END AS mtime, size,
    CASE WHEN doc_id % 53 <> 0 THEN hash END AS hash,
    CASE WHEN doc_id % 53 = 0 THEN 'permission denied' END AS read_error
  FROM base
),
ledger AS (
  SELECT path AS src_path, dest_path, hash, size, epoch(mtime)::BIGINT AS mtime,
    TIMESTAMP '2024-01-10 00:00:00' AS copied_at
  FROM keyed WHERE doc_id % 10 = 0 AND {_ext('path')} IN {_ALLOWED}
  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1
),
full_ledger AS (
  SELECT path AS src_path, dest_path, hash, size, epoch(mtime)::BIGINT AS mtime,
    mtime + INTERVAL 1 DAY AS copied_at
  FROM keyed WHERE {_ext('path')} IN {_ALLOWED}
  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1
),
full_worn AS (
  SELECT * FROM full_ledger UNION ALL
  SELECT src_path, dest_path || '~', CASE WHEN size % 3 > 0 THEN hash END, size, mtime, copied_at FROM full_ledger WHERE size % 2 = 0
),
dest_listing AS (SELECT DISTINCT dest_path FROM ledger),
worn_ledger AS (
  SELECT * FROM ledger UNION ALL
  SELECT src_path, dest_path || '~', CASE WHEN size % 3 > 0 THEN hash END, size, mtime, copied_at FROM ledger WHERE size % 2 = 0
),
known AS (SELECT hash, min(dest_path) AS dest_path FROM worn_ledger WHERE hash IS NOT NULL GROUP BY hash),
scan_errors AS (
  SELECT '/src/unreadable/' || doc_id AS path, 'permission denied' AS message
  FROM documents WHERE doc_id % 97 = 0
),
tag_base AS (
  SELECT path, doc_id % 7 AS k, {_ext('path')} IN {_IMAGES} AS image,
    {_ext('path')} IN {_VIDEOS} AS video,
    strftime(mtime - INTERVAL 40 DAY, '%Y:%m:%d %H:%M:%S') AS colon,
    strftime(mtime - INTERVAL 40 DAY, {_WALL}) AS spaced,
    strftime(mtime - INTERVAL 40 DAY, '%Y-%m-%dT%H:%M:%S') || '.000000Z' AS zulu
  FROM base
),
tags AS (
  SELECT path, 'exif' AS scope, 'DateTimeOriginal' AS tag, -1 AS stream_index, colon AS value
  FROM tag_base WHERE image AND k = 0
  UNION ALL SELECT path, 'exif', 'DateTime', -1, colon FROM tag_base WHERE image AND k IN (0, 2)
  UNION ALL SELECT path, 'exif', 'DateTimeOriginal', -1, '0000:00:00 00:00:00'
  FROM tag_base WHERE image AND k = 1
  UNION ALL SELECT path, 'exif', 'DateTimeDigitized', -1, colon FROM tag_base WHERE image AND k = 1
  UNION ALL SELECT path, 'format', 'creation_time', -1, zulu FROM tag_base WHERE video AND k = 0
  UNION ALL SELECT path, 'format', 'creation_time', -1, '2023' FROM tag_base WHERE video AND k = 1
  UNION ALL SELECT path, 'format', 'date', -1, spaced FROM tag_base WHERE video AND k = 1
  UNION ALL SELECT path, 'format', 'com.apple.quicktime.creationdate', -1,
    '2024-01-31T23:30:00-05:00' FROM tag_base WHERE video AND k = 2
  UNION ALL SELECT path, 'stream', 'creation_time', 0, '' FROM tag_base WHERE video AND k = 3
  UNION ALL SELECT path, 'stream', 'creation_time', 1, colon FROM tag_base WHERE video AND k = 3
),
exif_options AS (
  SELECT path, {_parsed('value', colon_only=True)} AS date_wall, 3 AS confidence,
    'EXIF ' || tag AS source,
    list_position(['DateTimeOriginal','DateTimeDigitized','DateTime'], tag) AS pos
  FROM tags WHERE scope = 'exif' AND {_ext('path')} IN {_IMAGES}
),
exif_dates AS (
  SELECT path, date_wall, confidence, source FROM exif_options
  WHERE date_wall IS NOT NULL AND pos IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos) = 1
),
video_values AS (
  SELECT path, value, tag AS name,
    list_position(['creation_time','date','com.apple.quicktime.creationdate'], tag) AS pos
  FROM tags WHERE scope = 'format'
  UNION ALL
  SELECT path, arg_min(value, stream_index), 'stream creation_time', 4
  FROM tags WHERE scope = 'stream' AND tag = 'creation_time' AND value <> '' GROUP BY path
),
video_dates AS (
  SELECT path, {_parsed('value')} AS date_wall,
    CASE WHEN {_ext('path')} IN ('.avi', '.webm') THEN 2 ELSE 3 END AS confidence,
    'Video ' || name AS source
  FROM video_values
  WHERE pos IS NOT NULL AND {_ext('path')} IN {_VIDEOS} AND ({_parsed('value')}) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos) = 1
),
mtime_dates AS (
  SELECT path, strftime(mtime, {_WALL}) AS date_wall, 1 AS confidence, 'Filesystem mtime' AS source
  FROM faulty WHERE mtime IS NOT NULL
),
best_dates AS (
  SELECT * FROM (
    SELECT *, 1 AS extractor FROM exif_dates
    UNION ALL SELECT *, 2 FROM video_dates
    UNION ALL SELECT *, 3 FROM mtime_dates
    UNION ALL SELECT path, NULL, 0, NULL, 4 FROM faulty
  )
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY confidence DESC, extractor) = 1
),
static AS (
  SELECT f.path, f.size, f.mtime, f.hash,
    CASE WHEN early IS NULL THEN b.date_wall END AS date_wall,
    CASE WHEN early IS NULL THEN substr(b.date_wall, 1, 7) END AS month,
    CASE WHEN early IS NULL THEN d.dest_path END AS dest_path,
    CASE WHEN early IS NOT NULL THEN early
         WHEN b.date_wall IS NULL THEN 'skipped (no date)'
         WHEN d.dest_path IN (FROM dest_listing) THEN 'skipped (destination exists)'
         WHEN f.hash IS NULL THEN 'error (hash computation)'
         WHEN l.hash IS NOT NULL THEN 'duplicate (hash exists)'
         ELSE 'candidate' END AS state,
    l.dest_path AS ledger_path, f.read_error
  FROM (
    SELECT *, CASE WHEN {_ext('path')} NOT IN {_ALLOWED} THEN 'skipped (extension)'
        WHEN floor(epoch(mtime)) <= (SELECT max(epoch(copied_at)) FROM ledger)
        THEN 'skipped (incremental)' END AS early
    FROM faulty) f
  JOIN best_dates b ON b.path = f.path
  CROSS JOIN LATERAL (SELECT '/dest/' || substr(b.date_wall, 1, 7) || '/'
    || regexp_extract(f.path, '[^/]+$') AS dest_path) d
  LEFT JOIN ledger l ON l.hash = f.hash
),
static_rows AS (
  SELECT path, dest_path, month, hash, size, mtime, state,
    CASE WHEN state = 'duplicate (hash exists)' THEN ledger_path END AS existing_path,
    CASE WHEN state = 'error (hash computation)' THEN read_error END AS error
  FROM static
),
candidates AS (SELECT * FROM static_rows WHERE state = 'candidate'),
{_placement('candidates', 'run').strip()},
results AS (
  SELECT s.path, s.dest_path, s.month, s.hash, s.size, s.mtime,
    coalesce(w.state, s.state) AS state, coalesce(w.existing_path, s.existing_path) AS existing_path,
    s.error, CASE WHEN w.state = 'copied' THEN s.size ELSE 0 END AS bytes_copied
  FROM static_rows s LEFT JOIN run_walk w ON w.path = s.path
),
accepted AS (SELECT * FROM keyed WHERE {_ext('path')} IN {_ALLOWED}),
{_placement('accepted', 'whole').strip()},
planned AS (
  SELECT path, reason = 'File ready for backup' AS should_copy,
    CASE WHEN reason = 'File ready for backup' THEN size ELSE 0 END::BIGINT AS planned_size, reason
  FROM (
    SELECT path, size,
      CASE WHEN {_ext('path')} NOT IN {_ALLOWED} THEN 'Extension not allowed'
        WHEN floor(epoch(mtime)) <= (SELECT max(epoch(copied_at)) FROM ledger)
          THEN 'File older than last backup'
        WHEN mtime IS NULL THEN 'No valid filesystem date'
        WHEN '/dest/' || strftime(mtime, '%Y-%m') || '/' || regexp_extract(path, '[^/]+$')
          IN (FROM dest_listing) THEN 'File already exists at destination'
        ELSE 'File ready for backup' END AS reason
    FROM faulty)
),
estimate AS (
  SELECT count(*) AS files_found, count(*) FILTER (should_copy) AS files_to_copy,
    coalesce(sum(planned_size), 0)::BIGINT AS estimated_bytes
  FROM planned
),
summary AS (
  SELECT count(*) FILTER (state = 'copied') AS copied,
    count(*) FILTER (starts_with(state, 'skipped')) AS skipped,
    count(*) FILTER (starts_with(state, 'duplicate')) AS duplicates,
    count(*) FILTER (starts_with(state, 'error')) + (SELECT count(*) FROM scan_errors) AS errors,
    coalesce(sum(bytes_copied), 0)::BIGINT AS total_bytes,
    count(*) AS total_files,
    (SELECT count(*) FROM scan_errors) AS walk_errors
  FROM results
),
oldest AS (
  SELECT coalesce(max(CASE WHEN age > 0 THEN age END), 86400)::BIGINT AS seconds
  FROM (SELECT floor(epoch({_AS_OF})) - floor(epoch(mtime)) AS age FROM results
        WHERE state = 'copied')
),
context AS (
  SELECT (SELECT strftime(max(copied_at), {_WALL}) FROM ledger) AS last_backup,
    (SELECT max(copied_at) FROM ledger) IS NULL
      OR coalesce(copied / nullif(total_files + walk_errors, 0), 0) > 0.8 AS is_first_run,
    (SELECT seconds FROM oldest) AS oldest_seconds
  FROM summary
),
report AS (
  SELECT 'src' || substr(path, 5) AS path, regexp_extract(state, '^[a-z]+') AS status,
    CASE WHEN state = 'copied' THEN 'dest' || substr(dest_path, 6)
         WHEN starts_with(state, 'duplicate') THEN 'dest' || substr(existing_path, 6)
         ELSE '' END AS destination,
    size, {_size_text('size')} AS size_text,
    CASE WHEN state = 'copied' THEN 'Successfully copied'
         WHEN starts_with(state, 'duplicate') THEN 'Duplicate of existing file'
         WHEN starts_with(state, 'skipped') THEN state
         ELSE coalesce(error, state) END AS details
  FROM results
  UNION ALL
  SELECT 'src' || substr(path, 5), 'error', '', NULL, '-', message FROM scan_errors
),
spans AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 7919 % 7300
    WHEN 1 THEN o_orderkey * 7919 % 260000
    WHEN 2 THEN o_orderkey * 7919 % 6000000
    ELSE o_orderkey * 7919 % 200000000 END AS seconds
  FROM orders
),
sizes AS (
  SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 0
    ELSE strlen(text) * (1::BIGINT << (doc_id % 40)::INTEGER) END AS size
  FROM documents
),
date_texts AS (
  SELECT event_id, CASE event_id % 12
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.125+05:30'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(ts, '%Y:%m:%d %H:%M:%S')
    WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0200'
    WHEN 6 THEN strftime(ts, '%Y-%m-%d')
    WHEN 7 THEN strftime(ts, '%Y-%m-') || '31 ' || strftime(ts, '%H:%M:%S')
    WHEN 8 THEN strftime(ts, '%Y:%m:%d') || '  ' || hour(ts) || strftime(ts, ':%M:%S') || ',5'
    WHEN 9 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z'
    WHEN 10 THEN strftime(ts, '%Y-00-%d %H:%M:%S')
    ELSE '' END AS value
  FROM events
),
messages AS (
  SELECT path || ': ' || coalesce(read_error, 'error (hash computation)') AS message FROM faulty
  UNION ALL
  SELECT 'walk error: ' || path || ': ' || message FROM scan_errors
)
"""

_GIB = "1073741824.0::DOUBLE"

_SNAPSHOTS = """
        sb AS (
          SELECT CASE WHEN doc_id % 13 = 4 THEN '/old/' ELSE '/s/' END || source || '/' || doc_id || '.jpg' AS path,
            CASE WHEN doc_id % 17 = 5 THEN size + 1 ELSE size END AS size, mtime,
            CASE WHEN doc_id % 17 = 5 THEN md5(hash) ELSE hash END AS hash
          FROM base JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE doc_id % 11 <> 3),
        sa AS (
          SELECT '/s/' || source || '/' || doc_id || '.jpg' AS path, size, mtime, hash
          FROM base JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE doc_id % 19 <> 6),
        news AS (FROM sa WHERE path NOT IN (SELECT path FROM sb)),
        olds AS (FROM sb WHERE path NOT IN (SELECT path FROM sa))"""


def _tree_hash(part: int, fan: int, levels: int) -> str:
    """Levels of a hash tree over texts, as many as are ever needed here."""
    steps = [f"""
        l0 AS (SELECT doc_id, k AS part, sha256('l'::BLOB || encode(text)[k * {part} + 1 : (k + 1) * {part}]) AS digest
               FROM documents, range(0, greatest(1, ceil(strlen(text) / {part}.0))::BIGINT) AS parts(k))"""]
    for i in range(1, levels + 1):
        steps.append(f"""
        l{i} AS (SELECT doc_id, part // {fan} AS part,
                   CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256('n' || string_agg(digest, '' ORDER BY part)) END AS digest
                 FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l{i - 1}) GROUP BY doc_id, part // {fan})""")
    return f", {','.join(steps)} SELECT doc_id, digest AS hash FROM l{levels}"


_SELECTS = {
    "inventory_scan": """
        SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source""",
    "walk_order": "SELECT path, hex(replace(path, '/', chr(0))) AS walk_key FROM base",
    "scan_errors": "SELECT path, 'No such file or directory' AS message FROM scan_errors",
    "content_tree_hash": _tree_hash(100, 8, 6),
    "snapshot_difference": f"""
        , {_SNAPSHOTS.strip()}
        SELECT path, CASE WHEN sa.size = sb.size AND sa.mtime = sb.mtime AND sa.hash = sb.hash THEN 'same' ELSE 'changed' END AS change,
          NULL AS other_path FROM sa JOIN sb USING (path)
        UNION ALL
        SELECT path, CASE WHEN o.hash IS NULL THEN 'added' ELSE 'moved' END, other
        FROM news LEFT JOIN (SELECT hash, min(path) AS other FROM olds GROUP BY hash) o USING (hash)
        UNION ALL
        SELECT path, CASE WHEN o.hash IS NULL THEN 'gone' ELSE 'left' END, other
        FROM olds LEFT JOIN (SELECT hash, min(path) AS other FROM news GROUP BY hash) o USING (hash)""",
    "carried_hashes": f"""
        , {_SNAPSHOTS.strip()},
        once AS (SELECT regexp_extract(path, '[^/]+$') AS name, size, mtime, min(hash) AS hash FROM olds GROUP BY ALL HAVING count(*) = 1)
        SELECT sa.path, coalesce(sb.hash, once.hash) AS hash FROM sa
        LEFT JOIN sb ON sb.path = sa.path AND sb.size = sa.size AND sb.mtime = sa.mtime
        LEFT JOIN once ON sa.path NOT IN (SELECT path FROM sb) AND once.name = regexp_extract(sa.path, '[^/]+$')
          AND once.size = sa.size AND once.mtime = sa.mtime""",
    "distinct_estimate": """
        , v AS (SELECT ('0x' || substr(md5(hash), 1, 15))::BIGINT AS value, min(size) AS size FROM base GROUP BY ALL),
        k AS (FROM v ORDER BY value LIMIT 128),
        t AS (SELECT count(*) AS n, max(value)::DOUBLE / 1152921504606846976::DOUBLE AS theta, sum(size) AS total, arg_max(size, value) AS last FROM k)
        SELECT floor(CASE WHEN n < 128 THEN n ELSE (n - 1) / theta END)::BIGINT AS contents,
          floor(CASE WHEN n < 128 THEN total ELSE (total - last) / theta END)::BIGINT AS bytes FROM t""",
    "run_recovery": """
        SELECT CASE WHEN size % 4 = 0 OR size % 6 NOT IN (0, 3) THEN 'ledger' ELSE 'due' END AS kind,
          src_path AS path, CASE WHEN size % 4 = 0 OR size % 6 NOT IN (0, 3) THEN hash END AS hash
        FROM (FROM full_ledger QUALIFY row_number() OVER (PARTITION BY dest_path ORDER BY hash) = 1)""",
    "incremental_retry": f"""
        SELECT path, size FROM base
        WHERE {_ext('path')} IN {_ALLOWED} AND (
          floor(epoch(mtime)) > (SELECT max(epoch(copied_at)) FROM ledger)
          OR path IN (SELECT path FROM base WHERE doc_id % 50 = 7)
          OR regexp_replace(path, '/[^/]*$', '') IN (
            SELECT regexp_replace(path, '/[^/]*$', '') FROM base WHERE doc_id % 240 = 17 AND doc_id % 7 < 3))""",
    "bucketed_duplicates": """
        SELECT b.path, b.hash, l.dest_path AS existing_path
        FROM base b JOIN known l ON l.hash = b.hash""",
    "filtered_duplicates": """
        SELECT hash, dest_path AS existing_path FROM known WHERE hash IN (SELECT hash FROM base)""",
    "ledger_load": """
        SELECT hash, min(dest_path) AS dest_path FROM full_worn WHERE hash IS NOT NULL GROUP BY hash""",
    "dest_listing": "SELECT DISTINCT dest_path FROM full_ledger",
    "content_hash": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "month_partition_sink": f"""
        SELECT r.month, r.path, r.dest_path, strftime(r.mtime, {_WALL}) AS mtime,
          md5(b.text) AS content
        FROM results r JOIN base b ON b.path = r.path WHERE r.state = 'copied'""",
    "ledger_append": f"""
        SELECT src_path, dest_path, hash, size, mtime, strftime(copied_at, {_WALL}) AS copied_at
        FROM ledger
        UNION ALL
        SELECT * FROM (
          SELECT path, dest_path, hash, size, epoch(mtime)::BIGINT, strftime({_AS_OF}, {_WALL})
          FROM accepted WHERE hash NOT IN (SELECT hash FROM ledger)
          QUALIFY row_number() OVER (PARTITION BY hash ORDER BY string_split(path, '/')) = 1)""",
    "report_sink": "SELECT path, status, destination, size, size_text, details FROM report",
    "normalize_ext": f"SELECT path, {_ext('path')} AS ext FROM base",
    "basename": "SELECT path, regexp_extract(path, '[^/]+$') AS name FROM base",
    "month_bucket": "SELECT path, month FROM keyed",
    "dest_path": "SELECT path, dest_path FROM keyed",
    "state_label": """
        SELECT doc_id, coalesce((['copied','skipped (extension)','skipped (incremental)',
          'skipped (no date)','skipped (destination exists)','duplicate (hash exists)',
          'error (stat)','error (date extraction)','error (hash computation)',
          'error (copy failed)','error (walk failed)'])[doc_id % 13 + 1], 'unknown') AS label
        FROM documents""",
    "extractor_eligibility": f"""
        SELECT path, {_ext('path')} AS ext, extractor
        FROM base CROSS JOIN (VALUES ('EXIF'), ('Video'), ('PNG'), ('Filesystem')) e(extractor)
        WHERE CASE extractor WHEN 'EXIF' THEN {_ext('path')} IN {_IMAGES}
          WHEN 'Video' THEN {_ext('path')} IN {_VIDEOS}
          WHEN 'PNG' THEN {_ext('path')} = '.png' ELSE true END""",
    "confidence_label": """
        SELECT doc_id, coalesce((['none','low','medium','high'])[doc_id % 5 + 1], 'unknown') AS label
        FROM documents""",
    "parse_tag_date": f"""
        SELECT event_id, value, {_parsed('value')} AS wall,
          {_parsed('value', colon_only=True)} AS exif_wall FROM date_texts""",
    "confidence_downgrade": f"""
        SELECT path, CASE WHEN {_ext('path')} IN ('.avi', '.webm') THEN 'medium' ELSE 'high' END
          AS label FROM base""",
    "relative_path": """
        SELECT path, 'src' || substr(path, 5) AS shown, '..' || path AS shown_outside,
          path AS unchanged FROM base""",
    "human_size": f"SELECT doc_id, {_size_text('size')} AS shown FROM sizes",
    "parse_size": rf"""
        SELECT doc_id, CASE WHEN shown = '-' THEN 0.0::DOUBLE
          ELSE regexp_extract(shown, '^[\d.]+')::DOUBLE
            * pow(1024, coalesce(strpos('KMGTPE', nullif(regexp_extract(shown, ' ([KMGTPE]?)B', 1), '')), 0))
          END AS bytes
        FROM (SELECT doc_id, {_size_text('size')} AS shown FROM sizes)""",
    "human_duration": """
        SELECT o_orderkey, CASE
          WHEN seconds >= 3600 THEN printf('%.1fh', seconds / 3600.0::DOUBLE)
          WHEN seconds >= 60 THEN printf('%.1fm', seconds / 60.0::DOUBLE)
          ELSE printf('%.1fs', seconds::DOUBLE) END AS shown FROM spans""",
    "human_age": f"SELECT o_orderkey, {_age_text('seconds')} AS shown FROM spans",
    "ago_text": f"SELECT o_orderkey, {_ago('seconds')} AS shown FROM spans",
    "error_message": "SELECT message FROM messages",
    "split_error_message": """
        SELECT message, substr(message, 1, strpos(message, ': ') - 1) AS path,
          substr(message, strpos(message, ': ') + 2) AS details FROM messages""",
    "tag_flatten": "SELECT path, scope, tag, stream_index, value FROM tags WHERE scope <> 'exif'",
    "ext_allow_list": "SELECT path, size FROM accepted",
    "incremental_filter": """
        SELECT path, size FROM base
        WHERE floor(epoch(mtime)) > (SELECT max(epoch(copied_at)) FROM ledger)""",
    "valid_date_filter": "SELECT path, date_wall FROM best_dates WHERE date_wall IS NOT NULL",
    "report_filter": """
        SELECT path, status, destination, size, size_text, details FROM report
        WHERE status = 'skipped' AND contains(lower(path), 'img_0000')""",
    "report_search": """
        SELECT path, status, destination, size, size_text, details FROM report
        WHERE status = 'skipped' AND contains(lower(path), 'img_0000')""",
    "exif_date": "SELECT path, date_wall, confidence, source FROM exif_dates",
    "video_date": "SELECT path, date_wall, confidence, source FROM video_dates",
    "mtime_date": "SELECT path, date_wall, confidence, source FROM mtime_dates",
    "best_date": "SELECT path, date_wall, confidence, source FROM best_dates",
    "effective_date": "SELECT path, date_wall FROM best_dates",
    "date_source_profile": """
        SELECT source, (['none','low','medium','high'])[confidence + 1] AS confidence,
          count(*) AS files FROM best_dates GROUP BY ALL""",
    "ledger_duplicates": """
        SELECT b.path, b.hash, l.dest_path AS existing_path
        FROM base b JOIN known l ON l.hash = b.hash""",
    "dest_exists": "SELECT path, dest_path FROM keyed WHERE dest_path IN (FROM dest_listing)",
    "new_content": """
        SELECT path, dest_path, hash FROM keyed
        WHERE hash NOT IN (SELECT hash FROM known) AND dest_path NOT IN (FROM dest_listing)""",
    "insert_or_ignore": "SELECT path, hash FROM base WHERE hash NOT IN (SELECT hash FROM known)",
    "plan_classification": "SELECT path, should_copy, planned_size, reason FROM planned",
    "static_classification": """
        SELECT path, dest_path, state, existing_path, error FROM static_rows""",
    "greedy_placement": """
        SELECT w.path, o.dest_path, w.state, w.existing_path
        FROM whole_walk w JOIN whole_ordered o ON o.n = w.n""",
    "final_results": """
        SELECT path, dest_path, state, existing_path, error, month, bytes_copied::BIGINT AS bytes_copied
        FROM results""",
    "content_duplicate_groups": """
        SELECT hash, arg_min(path, string_split(path, '/')) AS keeper, count(*) AS copies,
          count(*) - 1 AS duplicates, (sum(size) - max(size))::BIGINT AS duplicate_bytes
        FROM base GROUP BY hash HAVING count(*) > 1""",
    "content_duplicate_pairs": """
        SELECT b.hash, b.path, b.size, k.keeper
        FROM base b JOIN (SELECT hash, arg_min(path, string_split(path, '/')) AS keeper FROM base GROUP BY hash HAVING count(*) > 1) k
          ON k.hash = b.hash AND k.keeper <> b.path""",
    "plan_estimate": "SELECT files_found, files_to_copy, estimated_bytes FROM estimate",
    "capacity_gate": f"""
        SELECT files_found, files_to_copy, estimated_bytes,
          estimated_bytes + 104857600 AS required_bytes, 107000000::BIGINT AS available_bytes,
          printf('%.2f', estimated_bytes / {_GIB}) AS estimated_gib,
          printf('%.2f', (estimated_bytes + 104857600) / {_GIB}) AS required_gib,
          printf('%.2f', 107000000 / {_GIB}) AS available_gib,
          107000000 >= estimated_bytes + 104857600 AS sufficient
        FROM estimate""",
    "accounting_summary": """
        SELECT copied, skipped, duplicates, errors, total_bytes, total_files, walk_errors
        FROM summary""",
    "accounting_by_state": """
        SELECT state, count(*) AS files, sum(size)::BIGINT AS bytes,
          sum(bytes_copied)::BIGINT AS bytes_copied FROM results GROUP BY state""",
    "reconciliation": """
        SELECT copied + skipped + duplicates + errors AS accounted, total_files, walk_errors,
          copied + skipped + duplicates + errors = total_files + walk_errors AS reconciled,
          copied + skipped + duplicates + errors = total_files AS files_only
        FROM summary""",
    "watermark": f"SELECT strftime(max(copied_at), {_WALL}) AS last_backup FROM full_ledger",
    "ledger_status": f"""
        SELECT strftime(last, {_WALL}) AS last_backup, {_ago('since')} AS ago, unique_hashes
        FROM (SELECT max(copied_at) AS last, count(DISTINCT hash) AS unique_hashes,
          date_diff('second', max(copied_at), {_AS_OF}) AS since FROM full_worn)""",
    "oldest_file_age": f"""
        SELECT seconds AS oldest_seconds, {_age_text('seconds')} AS oldest_age FROM oldest""",
    "report_badges": f"""
        SELECT total_files + walk_errors AS total_files, total_bytes AS data_bytes,
          {_size_text('total_bytes')} AS data_size, '1.4m' AS time_taken,
          copied, duplicates, skipped, errors FROM summary""",
    "run_context": "SELECT last_backup, is_first_run, oldest_seconds FROM context",
    "outcome_bucket": """
        SELECT *, CASE
          WHEN coalesce(errors / nullif(total_files, 0), 0) > 0.1 THEN 'errors'
          WHEN copied = 0 THEN 'nothing'
          WHEN coalesce(duplicates / nullif(total_files, 0), 0) > 0.1 THEN 'duplicates'
          WHEN coalesce(skipped / nullif(total_files, 0), 0) > 0.9 THEN 'skipped'
          ELSE 'clean' END AS outcome
        FROM summary""",
    "recency_bucket": f"""
        SELECT CASE WHEN is_first_run THEN 'first' WHEN since < 2592000 THEN 'recent' ELSE 'gap' END
          AS recency,
          CASE WHEN is_first_run THEN {_age_text('oldest_seconds')} ELSE {_age_text('since')} END
          AS span
        FROM (SELECT *, date_diff('second', last_backup::TIMESTAMP, {_AS_OF}) AS since
              FROM context)""",
    "month_totals": """
        SELECT month, count(*) AS files, sum(size)::BIGINT AS bytes
        FROM results WHERE state = 'copied' GROUP BY month""",
    "report_rows": "SELECT path, status, destination, size, size_text, details FROM report",
    "report_sort": """
        SELECT path, status, destination, size, size_text, details FROM report
        ORDER BY coalesce(size, 0) DESC""",
    "error_rows": """
        SELECT path, path || ': ' || coalesce(error, state) AS message
        FROM results WHERE starts_with(state, 'error')
        UNION ALL
        SELECT path, 'walk error: ' || path || ': ' || message FROM scan_errors""",
}

ORACLES = {name: f"WITH RECURSIVE {_VIEWS} {sql}" for name, sql in _SELECTS.items()}
