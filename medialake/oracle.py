"""DuckDB oracle SQL for every registered query (the correctness gate).

Each statement starts from the driver's pre-registered views (``documents``,
``events``, ...) and derives the catalog-shaped views with the same rules as
``medialake.sources.fixtures``.  Column names equal the Spark query's.
"""

from __future__ import annotations

from . import schema as _S

# media_files over documents (FIXTURES.md §3); i = doc_id, k = i // 2, n = n_chars.
MEDIA_FILES = r"""
mf_base AS (
  SELECT doc_id AS i, doc_id // 2 AS k, n_chars AS n, text FROM documents
),
mf_parts AS (
  SELECT *,
    CASE k % 6
      WHEN 0 THEN '/library/photos/2019/dev' || (k % 7)
      WHEN 1 THEN '/library/photos/2021/2021.06.xx - trip/dev' || (k % 7)
      WHEN 2 THEN '/library/photos/2020/2020.09.13-event'
      WHEN 3 THEN '/library/videos/set' || (k % 3)
      WHEN 4 THEN '/library/Camera Uploads/dev' || (k % 7)
      ELSE '/library' END AS dir,
    CASE
      WHEN k % 4 < 2 THEN 'IMG_' || k || CASE WHEN i % 2 = 1 THEN '_720p' ELSE '' END
      WHEN k % 4 = 2 THEN '2018-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '-'
                          || lpad(CAST(1 + k % 31 AS VARCHAR), 2, '0') || ' 21-30-'
                          || lpad(CAST(i % 60 AS VARCHAR), 2, '0') || ' ' || i
      ELSE 'VID_2021' || lpad(CAST(1 + k % 13 AS VARCHAR), 2, '0') || '05_122219_' || i END AS stem,
    CASE
      WHEN i % 8 < 4 THEN 'jpg'
      WHEN i % 8 = 4 THEN CASE k % 3 WHEN 0 THEN 'dng' WHEN 1 THEN 'CR2' ELSE 'nef' END
      WHEN i % 8 IN (5, 6) THEN 'mp4'
      WHEN k % 2 = 0 THEN 'avi'
      ELSE 'mpg' END AS ext,
    i % 17 = 0 AS corrupt,
    i % 8 >= 5 AS video
  FROM mf_base
),
media_files AS (
  SELECT
    i + 1 AS id,
    dir || '/' || stem || '.' || ext AS file_path,
    stem || '.' || ext AS file_name,
    n * 4096 AS file_size,
    CASE WHEN corrupt THEN NULL ELSE md5(text) END AS file_hash,
    CASE WHEN video THEN 'video' ELSE 'image' END AS media_type,
    CASE WHEN i % 3 = 0 OR i % 8 = 4 OR corrupt THEN NULL
         ELSE TIMESTAMP '2022-05-01 00:00:00' + to_days(CAST(i % 3650 AS INTEGER)) END AS creation_date,
    CASE WHEN video AND NOT corrupt THEN CAST(i % 7200 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS duration,
    CASE WHEN i % 8 = 4 OR corrupt THEN NULL
         ELSE [1920, 1179, 2556, 1280][CAST(i % 4 AS INTEGER) + 1] END AS width,
    CASE WHEN i % 8 = 4 OR corrupt THEN NULL
         ELSE [1080, 2556, 1179, 720][CAST(i % 4 AS INTEGER) + 1] END AS height,
    CASE WHEN NOT video OR corrupt THEN NULL
         WHEN ext = 'mp4' THEN CASE WHEN k % 3 = 0 THEN 'hevc' ELSE 'h264' END
         WHEN ext = 'avi' THEN 'mjpeg' ELSE 'mpeg2video' END AS codec_name,
    CASE WHEN NOT video OR corrupt THEN NULL
         WHEN ext = 'mp4' THEN CASE WHEN k % 3 = 0 THEN 'H.265 / HEVC (High Efficiency Video Coding)'
                                    ELSE 'H.264 / AVC / MPEG-4 AVC / MPEG-4 part 10' END
         WHEN ext = 'avi' THEN 'Motion JPEG' ELSE 'MPEG-2 video' END AS codec_long_name,
    CASE WHEN video AND NOT corrupt THEN (n % 40) * 1000000 END AS bit_rate,
    CASE WHEN video AND NOT corrupt THEN CAST(24 + i % 7 AS DOUBLE) END AS frame_rate,
    CASE WHEN corrupt THEN NULL
         WHEN ext = 'mp4' THEN 'mov,mp4,m4a,3gp,3g2,mj2'
         WHEN ext = 'avi' THEN 'avi' WHEN ext = 'mpg' THEN 'mpeg'
         WHEN ext = 'jpg' THEN 'jpeg' ELSE lower(ext) END AS format_name,
    CASE WHEN corrupt THEN NULL
         WHEN ext = 'mp4' THEN 'QuickTime / MOV'
         WHEN ext = 'avi' THEN 'AVI (Audio Video Interleaved)'
         WHEN ext = 'mpg' THEN 'MPEG-PS (MPEG-2 Program Stream)'
         WHEN ext = 'jpg' THEN 'JPEG Image' ELSE upper(ext) || ' RAW Image' END AS format_long_name,
    corrupt AS is_corrupted,
    CASE WHEN NOT corrupt THEN NULL
         WHEN video THEN 'ffprobe error: moov atom not found'
         ELSE 'Critical image corruption: cannot identify image file' END AS error_message,
    TIMESTAMP '2024-01-15 10:30:00' AS analyzed_at,
    CAST(1600000000 + i * 3600 AS DOUBLE) AS modified_at
  FROM mf_parts
)"""


def with_media(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join((MEDIA_FILES.strip(),) + tuple(c.strip() for c in extra_ctes))
    return f"WITH {ctes}\n{body.strip()}"


# Duplicate detection pattern set used by the registered queries.
DUP_PATTERNS = ("Camera Uploads", "_720p")


def _matches_sql(col: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in patterns) + ")"


_HASHED = """hashed AS (
  SELECT * FROM media_files
  WHERE file_hash IS NOT NULL AND file_hash <> '' AND NOT is_corrupted
)"""

_DUP_GROUPS = """dup_groups AS (
  SELECT file_hash, count(*) AS file_count, max(file_size) AS group_size,
         max(file_size) * (count(*) - 1) AS wasted_bytes
  FROM hashed GROUP BY file_hash HAVING count(*) >= 2
)"""

_DUP_MEMBERS = f"""dup_members AS (
  SELECT h.*, {_matches_sql('h.file_path', DUP_PATTERNS)} AS matches_pattern, g.file_count,
         row_number() OVER (PARTITION BY h.file_hash
                            ORDER BY {_matches_sql('h.file_path', DUP_PATTERNS)}, h.file_path) - 1
           AS copy_no
  FROM hashed h JOIN dup_groups g USING (file_hash)
)"""


# --- catalog reports -------------------------------------------------------------

RAW_SQL = ", ".join(f"'{e}'" for e in _S.RAW_EXTENSIONS)
OLD_CODECS_SQL = ", ".join(f"'{c}'" for c in _S.OUTDATED_CODECS)
OLD_FORMATS_SQL = ", ".join(f"'{c}'" for c in _S.OUTDATED_FORMATS)

REPORT_COLS = ("file_path, file_name, file_size, media_type, duration, bit_rate, "
               "CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution, codec_name")

# Path helpers in DuckDB (same rules as medialake.functions.paths).
def dirname_sql(p: str) -> str:
    return (f"(CASE WHEN NOT contains({p}, '/') THEN '' "
            f"WHEN regexp_extract({p}, '(?s)^(.*)/[^/]*$', 1) = '' AND starts_with({p}, '/') THEN '/' "
            f"ELSE regexp_extract({p}, '(?s)^(.*)/[^/]*$', 1) END)")


def basename_sql(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def stem_sql(p: str) -> str:
    n = basename_sql(p)
    return (f"(CASE WHEN regexp_extract({n}, '(?s)^(.*[^.].*)(\\.[^.]*)$', 1) = '' THEN {n} "
            f"ELSE regexp_extract({n}, '(?s)^(.*[^.].*)(\\.[^.]*)$', 1) END)")


def ext_sql(p: str) -> str:
    return f"regexp_extract({basename_sql(p)}, '(?s)^(.*[^.].*)(\\.[^.]*)$', 2)"


def _report_sql(q: dict[str, str]) -> None:
    raw_where = (f"NOT is_corrupted AND media_type = 'image' "
                 f"AND lower(right(file_path, 4)) IN ({RAW_SQL})")
    crowded = (
        f"""crowded AS (SELECT id, file_size, 'photo' || (id % 97) AS stem, {ext_sql('file_path')} AS ext FROM media_files)""",
        """asked AS (SELECT '/library/in/' || id || '/' || stem || ext AS source_path, stem, ext, file_size,
                            row_number() OVER (PARTITION BY stem, ext ORDER BY '/library/in/' || id || '/' || stem || ext) AS r
                     FROM crowded WHERE id % 89 <> 0)""",
        """held AS (SELECT DISTINCT stem, ext, id % 5 + 1 AS k FROM crowded WHERE id % 89 = 0)""",
        """open_slots AS (SELECT stem, ext, k, row_number() OVER (PARTITION BY stem, ext ORDER BY k) AS r
                          FROM (SELECT stem, ext, unnest(range(0, count(*) + 6)) AS k FROM asked GROUP BY stem, ext)
                          ANTI JOIN held USING (stem, ext, k))""",
        """fc AS (SELECT source_path, file_size, k > 0 AS renamed,
                         stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END || ext AS target_name
                  FROM asked JOIN open_slots USING (stem, ext, r))""")
    q["flatten_conflicts_plan"] = with_media(
        "SELECT source_path, target_name, renamed, '/library/' || target_name AS target_path FROM fc", *crowded)
    q["flatten_conflicts_totals"] = with_media(
        """SELECT count(*) AS moved, count(*) FILTER (WHERE renamed) AS conflicts,
                  CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size FROM fc""", *crowded)
    old_where = (f"NOT is_corrupted AND media_type = 'video' AND (codec_name IN ({OLD_CODECS_SQL}) "
                 f"OR format_name IN ({OLD_FORMATS_SQL}))")
    q["raw_files"] = with_media(f"SELECT {REPORT_COLS} FROM media_files WHERE {raw_where}")
    q["raw_by_extension"] = with_media(
        f"""SELECT lower({ext_sql('file_path')}) AS extension, count(*) AS files,
                   CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size
            FROM media_files WHERE {raw_where} GROUP BY 1""")
    q["outdated_videos"] = with_media(
        f"""SELECT {REPORT_COLS}, format_name,
                   coalesce(nullif(codec_name, ''), 'N/A') ||
                   CASE WHEN format_name IN ({OLD_FORMATS_SQL})
                        THEN ' (format: ' || format_name || ')' ELSE '' END AS codec_label
            FROM media_files WHERE {old_where}""")
    q["outdated_by_codec_format"] = with_media(
        f"""SELECT kind, name, count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size
            FROM (SELECT 'codec' AS kind, codec_name AS name, file_size FROM media_files
                  WHERE {old_where} AND codec_name IN ({OLD_CODECS_SQL})
                  UNION ALL
                  SELECT 'format', format_name, file_size FROM media_files
                  WHERE {old_where} AND format_name IN ({OLD_FORMATS_SQL}))
            GROUP BY kind, name""")
    q["corrupted_files"] = with_media(f"SELECT {REPORT_COLS} FROM media_files WHERE is_corrupted")
    q["corrupted_by_type"] = with_media(
        """SELECT media_type, count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size
           FROM media_files WHERE is_corrupted GROUP BY media_type""")
    q["high_bitrate_export"] = with_media(
        f"""SELECT {REPORT_COLS} FROM media_files
            WHERE bit_rate IS NOT NULL AND bit_rate >= 15 * 1000000
              AND file_size IS NOT NULL AND file_size >= 50 * 1024 * 1024 AND NOT is_corrupted""")
    q["export_summary"] = with_media(
        f"""SELECT count(*) AS files, count(*) FILTER (WHERE media_type = 'video') AS videos,
                   count(*) FILTER (WHERE media_type = 'image') AS images,
                   CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size,
                   coalesce(sum(duration), 0.0) AS total_duration
            FROM media_files WHERE {old_where}""")
    q["library_stats"] = with_media(
        """SELECT count(*) AS total_files,
                  count(*) FILTER (WHERE media_type = 'video') AS video_files,
                  count(*) FILTER (WHERE media_type = 'image') AS image_files,
                  count(*) FILTER (WHERE is_corrupted) AS corrupted_files,
                  count(*) FILTER (WHERE NOT is_corrupted) AS valid_files,
                  CAST(coalesce(sum(file_size) FILTER (WHERE NOT is_corrupted), 0) AS BIGINT) AS total_size,
                  coalesce(sum(duration) FILTER (WHERE NOT is_corrupted AND media_type = 'video'), 0.0)
                    AS total_duration,
                  round(CAST(coalesce(sum(file_size) FILTER (WHERE NOT is_corrupted), 0) AS DOUBLE)
                        / (1024.0 * 1024 * 1024), 6) AS total_size_gb,
                  round(coalesce(sum(duration) FILTER (WHERE NOT is_corrupted AND media_type = 'video'), 0.0)
                        / 3600.0, 6) AS total_duration_hours
           FROM media_files""")
    codec_counts = """SELECT codec_name, count(*) AS count FROM media_files
        WHERE NOT is_corrupted AND media_type = 'video' AND codec_name IS NOT NULL GROUP BY codec_name"""
    res_counts = """SELECT width, height, count(*) AS count,
           CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution
        FROM media_files WHERE NOT is_corrupted AND width > 0 AND height > 0 GROUP BY width, height"""
    q["group_by_codec"] = with_media(codec_counts)
    q["group_by_resolution"] = with_media(res_counts)
    q["top_codecs"] = with_media(
        f"""SELECT *, row_number() OVER (ORDER BY count DESC, codec_name) AS rank
            FROM ({codec_counts}) ORDER BY count DESC, codec_name LIMIT 10""")
    q["top_resolutions"] = with_media(
        f"""SELECT *, row_number() OVER (ORDER BY count DESC, width, height) AS rank
            FROM ({res_counts}) ORDER BY count DESC, width, height LIMIT 10""")
    top_cols = ("file_path, file_name, file_size, duration, bit_rate, "
                "CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution, "
                "codec_name, is_corrupted")

    def top(where: str, key: str, k: int = 20) -> str:
        return (f"SELECT *, row_number() OVER (ORDER BY {key} DESC, file_path) AS rank FROM "
                f"(SELECT {top_cols}, {key} AS _k FROM media_files WHERE {where} "
                f"ORDER BY {key} DESC, file_path LIMIT {k})")

    q["largest_files"] = with_media(
        top("file_size IS NOT NULL", "file_size").replace("SELECT *,", "SELECT * EXCLUDE (_k),", 1))
    q["high_bitrate_top"] = with_media(
        top("bit_rate IS NOT NULL AND bit_rate >= 10 * 1000000 AND NOT is_corrupted", "bit_rate")
        .replace("SELECT *,", "SELECT * EXCLUDE (_k),", 1))
    q["longest_files"] = with_media(
        top("duration IS NOT NULL AND duration > 0 AND NOT is_corrupted", "duration")
        .replace("SELECT *,", "SELECT * EXCLUDE (_k),", 1))
    q["default_report"] = (
        "SELECT *, 'largest' AS report FROM (" + q["largest_files"] + ")\nUNION ALL\n"
        "SELECT *, 'high_bitrate' AS report FROM (" + q["high_bitrate_top"] + ")\nUNION ALL\n"
        "SELECT *, 'longest' AS report FROM (" + q["longest_files"] + ")")
    q["max_files"] = with_media(
        "SELECT file_path, file_size FROM media_files ORDER BY file_path LIMIT 25")
    d, s = dirname_sql("file_path"), stem_sql("file_path")
    q["suffix_with_original"] = with_media(
        f"""SELECT {REPORT_COLS}, original_base FROM (
              SELECT *, left(_stem, length(_stem) - 5) AS original_base
              FROM (SELECT *, {d} AS _dir, {s} AS _stem FROM media_files WHERE NOT is_corrupted)
              WHERE ends_with(_stem, '_720p')) a
            WHERE EXISTS (SELECT 1 FROM media_files b WHERE NOT b.is_corrupted
                          AND {dirname_sql('b.file_path')} = a._dir
                          AND {stem_sql('b.file_path')} = a.original_base)""")
    q["catalog_scan"] = with_media(
        "SELECT file_path, file_size, media_type FROM media_files WHERE NOT is_corrupted")
    q["catalog_paths"] = with_media("SELECT DISTINCT file_path FROM media_files")
    q["catalog_nonempty_guard"] = with_media(
        "SELECT count(*) AS total_records, count(*) > 0 AS has_records FROM media_files")


# --- formatting in DuckDB (same rules as medialake.functions.formats) ---------------

def size_label_sql(x: str, units=("B", "KB", "MB", "GB", "TB"), last="PB") -> str:
    parts = []
    for k, u in enumerate(units):
        parts.append(f"WHEN CAST({x} AS DOUBLE) < {float(1024 ** (k + 1))} THEN "
                     f"printf('%.1f {u}', round_even(CAST({x} AS DOUBLE) / {float(1024 ** k)}, 1))")
    return (f"(CASE WHEN {x} IS NULL THEN 'N/A' " + " ".join(parts) +
            f" ELSE printf('%.1f {last}', round_even(CAST({x} AS DOUBLE) / {float(1024 ** len(units))}, 1)) END)")


def bitrate_label_sql(x: str) -> str:
    b = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN 'N/A' "
            f"WHEN {b} < 1000000 THEN printf('%.1f kbit/s', round_even({b} / 100.0, 0) / 10.0) "
            f"WHEN {b} < 1000000000 THEN printf('%.1f Mbit/s', round_even({b} / 100000.0, 0) / 10.0) "
            f"ELSE printf('%.1f Gbit/s', round_even({b} / 100000000.0, 0) / 10.0) END)")


def duration_label_sql(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    h, m, s = f"floor({d} / 3600)", f"floor(({d} - 3600 * floor({d} / 3600)) / 60)", \
        f"floor({d} - 60 * floor({d} / 60))"
    return (f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN 'N/A' "
            f"WHEN {h} > 0 THEN printf('%02d:%02d:%02d', CAST({h} AS BIGINT), CAST({m} AS BIGINT), CAST({s} AS BIGINT)) "
            f"ELSE printf('%02d:%02d', CAST({m} AS BIGINT), CAST({s} AS BIGINT)) END)")


# --- directory rollup --------------------------------------------------------------

def ancestors_sql(d: str) -> str:
    return (f"list_transform(range(2, len(string_split({d}, '/')) + 1), "
            f"lambda i: array_to_string(string_split({d}, '/')[1:i], '/'))")


_DIR_CTES = (
    f"""dfiles AS (
  SELECT {dirname_sql('file_path')} AS dir, file_size, media_type FROM media_files WHERE NOT is_corrupted
)""",
    """ddirs AS (SELECT DISTINCT dir FROM dfiles)""",
    f"""danc AS (SELECT DISTINCT unnest({ancestors_sql('dir')}) AS a FROM ddirs)""",
    """droot AS (
  SELECT a AS root FROM danc
  WHERE (SELECT count(*) FROM ddirs WHERE dir = a OR starts_with(dir, a || '/')) = (SELECT count(*) FROM ddirs)
  ORDER BY length(a) DESC LIMIT 1
)""",
    """dtree AS (SELECT a AS dir_path FROM danc, droot WHERE a = root OR starts_with(a, root || '/'))""",
    """drollup AS (
  SELECT t.dir_path,
         count(*) AS total_files,
         count(*) FILTER (WHERE media_type = 'image') AS images,
         count(*) FILTER (WHERE media_type = 'video') AS videos,
         count(*) FILTER (WHERE media_type IS NULL OR media_type NOT IN ('image', 'video')) AS other_files,
         CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size,
         count(*) FILTER (WHERE f.dir = t.dir_path) AS direct_files,
         CAST(coalesce(sum(file_size) FILTER (WHERE f.dir = t.dir_path), 0) AS BIGINT) AS direct_size
  FROM dtree t JOIN dfiles f ON f.dir = t.dir_path OR starts_with(f.dir, t.dir_path || '/')
  GROUP BY t.dir_path
)""",
    f"""dfull AS (
  SELECT r.*, length(r.dir_path) - length(replace(r.dir_path, '/', '')) AS depth,
         (SELECT count(*) FROM dtree c WHERE {dirname_sql('c.dir_path')} = r.dir_path
                                        AND c.dir_path <> r.dir_path) AS subdirs_count,
         CASE WHEN r.dir_path = (SELECT root FROM droot) THEN NULL
              ELSE {dirname_sql('r.dir_path')} END AS parent_path
  FROM drollup r
)""",
)


def _dir_sql(q: dict[str, str]) -> None:
    q["dir_direct_stats"] = with_media(
        """SELECT dir AS dir_path, count(*) AS total_files,
                  count(*) FILTER (WHERE media_type = 'image') AS images,
                  count(*) FILTER (WHERE media_type = 'video') AS videos,
                  count(*) FILTER (WHERE media_type IS NULL OR media_type NOT IN ('image', 'video')) AS other_files,
                  CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size
           FROM dfiles GROUP BY dir""", *_DIR_CTES)
    q["common_root"] = with_media("SELECT root FROM droot", *_DIR_CTES)
    q["dir_rollup"] = with_media(
        """SELECT dir_path, depth, direct_files, direct_size, total_files, images, videos,
                  other_files, total_size, subdirs_count, parent_path FROM dfull""", *_DIR_CTES)
    q["dir_subdir_count"] = with_media(
        "SELECT dir_path, subdirs_count FROM dfull WHERE subdirs_count > 0", *_DIR_CTES)
    q["dir_parent_edges"] = with_media(
        "SELECT parent_path, dir_path FROM dfull WHERE parent_path IS NOT NULL", *_DIR_CTES)
    q["largest_dirs"] = with_media(
        """SELECT row_number() OVER (ORDER BY total_size DESC, depth, dir_path) AS rank,
                  dir_path, total_size, total_files,
                  greatest((SELECT count(*) FROM dfull) - 5, 0) AS remaining_dirs
           FROM (SELECT * FROM dfull ORDER BY total_size DESC, depth, dir_path LIMIT 5)""",
        *_DIR_CTES)
    plural = lambda n, w: f"CAST({n} AS VARCHAR) || ' {w}' || CASE WHEN {n} <> 1 THEN 's' ELSE '' END"
    q["tree_preorder"] = with_media(
        f"""SELECT dir_path, row_number() OVER (ORDER BY string_split(dir_path, '/')) AS position,
                  dir_path || '/ ' || CASE WHEN total_files = 0 THEN '[empty]' ELSE
                    '[' || concat_ws(', ',
                       CASE WHEN subdirs_count > 0 THEN {plural('subdirs_count', 'dir')} END,
                       CASE WHEN images > 0 THEN {plural('images', 'image')} END,
                       CASE WHEN videos > 0 THEN {plural('videos', 'video')} END,
                       CASE WHEN other_files > 0 THEN {plural('other_files', 'file')} END,
                       {size_label_sql('total_size')}) || ']' END AS line
           FROM dfull""", *_DIR_CTES)
    q["root_directories"] = with_media(
        """SELECT dir_path FROM cand c
           WHERE NOT EXISTS (SELECT 1 FROM cand p WHERE p.dir_path <> '/'
                             AND starts_with(c.dir_path, p.dir_path || '/'))""",
        *_DIR_CTES,
        """cand AS (SELECT DISTINCT dir AS dir_path FROM dfiles WHERE dir <> (SELECT root FROM droot))""")


# --- dates in DuckDB (same rules as medialake.functions.dates) ----------------------

from .functions import dates as _D  # noqa: E402


def ts_sql(y: str, mo: str, d: str, h: str = "0", mi: str = "0", s: str = "0") -> str:
    return (f"(CASE WHEN {y} >= 1 AND {h} <= 23 AND {mi} <= 59 AND {s} <= 59 THEN "
            f"try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', {y}, {mo}, {d}, {h}, {mi}, {s}) "
            f"AS TIMESTAMP) END)")


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def groups_ts_sql(text: str, pattern: str, first: int = 1) -> str:
    g = [f"try_cast(regexp_extract({text}, {_lit(pattern)}, {first + j}) AS INTEGER)" for j in range(6)]
    return f"(CASE WHEN regexp_matches({text}, {_lit(pattern)}) THEN {ts_sql(*g)} END)"


def path_date_sql(p: str) -> str:
    name = basename_sql(p)
    tries = [groups_ts_sql(name, pat) for pat in _D.PATH_NAME_PATTERNS]
    parts = f"list_concat(['/'], list_filter(string_split({p}, '/'), lambda s: s <> ''))"
    dp, mp = _lit(_D.PATH_DAY_PATTERN), _lit(_D.PATH_MONTH_PATTERN)
    day = (f"CASE WHEN regexp_matches(c, {dp}) THEN " +
           ts_sql(*(f"try_cast(regexp_extract(c, {dp}, {j}) AS INTEGER)" for j in (1, 2, 3))) + " END")
    month = (f"CASE WHEN regexp_matches(c, {mp}) THEN " +
             ts_sql(f"try_cast(regexp_extract(c, {mp}, 1) AS INTEGER)",
                    f"try_cast(regexp_extract(c, {mp}, 2) AS INTEGER)", "1") + " END")
    lo, hi = _D.PATH_YEAR_RANGE
    year = (f"CASE WHEN regexp_matches(c, {_lit(_D.PATH_YEAR_PATTERN)}) "
            f"AND try_cast(c AS INTEGER) BETWEEN {lo} AND {hi} THEN "
            + ts_sql("try_cast(c AS INTEGER)", "1", "1") + " END")
    for fn in (day, month, year):
        tries.append(f"list_filter(list_transform({parts}, lambda c: {fn}), lambda x: x IS NOT NULL)[1]")
    return "coalesce(" + ", ".join(tries) + ")"


def name_date_sql(n: str) -> str:
    tries = []
    for pat in _D.NAME_PATTERNS:
        ipat = "(?i)" + pat
        if pat.startswith("(IMG|VID)"):
            tries.append(f"(CASE WHEN regexp_extract({n}, {_lit(ipat)}, 1) IN ('IMG', 'VID') THEN "
                         f"{groups_ts_sql(n, ipat, 2)} END)")
        else:
            tries.append(groups_ts_sql(n, ipat, 1))
    return "coalesce(" + ", ".join(tries) + ")"


def ts_text_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def epoch_text_sql(x: str) -> str:
    return ts_text_sql(f"(TIMESTAMP '1970-01-01 00:00:00' + to_microseconds(CAST(round({x} * 1000000) AS BIGINT)))")


# assets over events (FIXTURES.md §3)
ASSETS = r"""
assets AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE WHEN event_id % 10 < 8 THEN 'IMAGE' ELSE 'VIDEO' END AS type,
         event_id % 23 = 0 AS isTrashed,
         CASE event_id % 4
           WHEN 0 THEN 'IMG_2018' || lpad(CAST(1 + event_id % 13 AS VARCHAR), 2, '0')
                       || lpad(CAST(1 + event_id % 31 AS VARCHAR), 2, '0') || '_213006.jpg'
           WHEN 1 THEN '2018-' || lpad(CAST(1 + event_id % 13 AS VARCHAR), 2, '0') || '-'
                       || lpad(CAST(1 + event_id % 31 AS VARCHAR), 2, '0') || ' 21-30-06.JPG'
           WHEN 2 THEN '2021-' || lpad(CAST(1 + event_id % 13 AS VARCHAR), 2, '0') || '-'
                       || lpad(CAST(1 + event_id % 31 AS VARCHAR), 2, '0') || 'T12:22:19.mp4'
           ELSE 'DSC_' || event_id || '.jpg' END AS originalFileName,
         CASE WHEN event_id % 11 = 0 THEN NULL
              ELSE [1179, 2556, 1185, 1920, 1290][CAST(event_id % 5 AS INTEGER) + 1] END AS width,
         CASE WHEN event_id % 11 = 0 THEN NULL
              ELSE [2556, 1179, 2550, 1080, 2796][CAST(event_id % 5 AS INTEGER) + 1] END AS height,
         CASE WHEN event_id % 13 = 0 THEN NULL
              WHEN event_id % 29 = 0 THEN 'n/a'
              WHEN event_id % 3 = 0 THEN '2025' || substr(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', 5)
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS dateTimeOriginal,
         event_type AS album
  FROM events
)"""


def with_assets(body: str, *extra: str) -> str:
    ctes = ",\n".join((ASSETS.strip(),) + tuple(c.strip() for c in extra))
    return f"WITH {ctes}\n{body.strip()}"


def _date_sql(q: dict[str, str]) -> None:
    q["datetime_from_path"] = with_media(
        f"SELECT file_path, {ts_text_sql(path_date_sql('file_path'))} AS path_date FROM media_files")
    q["no_creation_date"] = with_media(
        f"""SELECT {REPORT_COLS},
                   {ts_text_sql(path_date_sql('file_path'))} AS path_date,
                   {epoch_text_sql('modified_at')} AS mtime_date,
                   coalesce({ts_text_sql(path_date_sql('file_path'))}, {epoch_text_sql('modified_at')})
                     AS suggested_date
            FROM media_files WHERE creation_date IS NULL AND NOT is_corrupted""")
    q["datetime_from_filename"] = with_assets(
        f"SELECT id, originalFileName, {ts_text_sql(name_date_sql('originalFileName'))} AS name_date FROM assets")
    q["assets_scan"] = with_assets("SELECT id FROM assets WHERE NOT coalesce(isTrashed, false) AND type = 'IMAGE'")
    q["assets_first"] = q["assets_scan"] + " ORDER BY id LIMIT 100"
    q["asset_records_scan"] = with_assets(
        "SELECT id, originalFileName, width, dateTimeOriginal FROM assets "
        "WHERE NOT coalesce(isTrashed, false) AND type = 'IMAGE'")
    q["asset_line_counts"] = with_assets(
        "SELECT count(*) + count(*) FILTER (CAST(id AS BIGINT) % 50 BETWEEN 7 AND 10) AS lines, count(*) AS records, "
        "count(*) FILTER (CAST(id AS BIGINT) % 50 BETWEEN 7 AND 10) AS bad_lines FROM assets")
    q["asset_detail"] = with_assets(
        "SELECT id, type, originalFileName, width, height, dateTimeOriginal FROM assets")
    q["album_assets"] = with_assets(
        "SELECT id, originalFileName FROM assets WHERE NOT coalesce(isTrashed, false) AND album = 'purchase'")
    q["album_first_assets"] = with_assets(
        "SELECT id, originalFileName FROM assets WHERE NOT coalesce(isTrashed, false) AND album = 'purchase' "
        "AND CAST(id AS BIGINT) % 3 = (SELECT max(CAST(id AS BIGINT) % 3) FROM assets WHERE album = 'purchase')")
    match = ("((abs(width - 1179) <= 10 AND abs(height - 2556) <= 10) OR "
             "(abs(height - 1179) <= 10 AND abs(width - 2556) <= 10))")
    q["resolution_match"] = with_assets(
        f"""SELECT id FROM assets WHERE NOT coalesce(isTrashed, false) AND type = 'IMAGE'
            AND width IS NOT NULL AND height IS NOT NULL AND {match}""")
    q["resolution_match_counts"] = with_assets(
        f"""SELECT count(*) AS scanned,
                   count(*) FILTER (WHERE width IS NOT NULL AND height IS NOT NULL AND {match}) AS matched,
                   count(*) FILTER (WHERE width IS NULL OR height IS NULL) AS no_size
            FROM assets WHERE NOT coalesce(isTrashed, false) AND type = 'IMAGE'""")
    year = ("CASE WHEN dateTimeOriginal IS NOT NULL AND dateTimeOriginal <> '' "
            "THEN try_cast(substr(dateTimeOriginal, 1, 4) AS INTEGER) END")
    q["target_year_filter"] = with_assets(
        f"SELECT id, exif_year FROM (SELECT id, {year} AS exif_year FROM assets) WHERE exif_year = 2025")
    nd = name_date_sql("originalFileName")
    q["date_from_name_plan"] = with_assets(
        f"""SELECT id AS asset_id, originalFileName, dateTimeOriginal AS old_date, exif_year,
                   CASE WHEN dateTimeOriginal IS NULL OR dateTimeOriginal = '' THEN 'no_exif_date'
                        WHEN exif_year IS NULL THEN 'bad_exif_year'
                        WHEN exif_year <> 2025 THEN 'other_year'
                        WHEN {nd} IS NULL THEN 'no_name_date'
                        ELSE 'update' END AS status,
                   CASE WHEN exif_year = 2025 THEN strftime({nd}, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS new_date
            FROM (SELECT *, {year} AS exif_year FROM assets
                  WHERE NOT coalesce(isTrashed, false) AND album = 'purchase')""")
    q["album_by_resolution_plan"] = with_assets(
        f"""SELECT 'Screenshots' AS album_name, id AS asset_id FROM assets
            WHERE NOT coalesce(isTrashed, false) AND type = 'IMAGE'
              AND width IS NOT NULL AND height IS NOT NULL AND {match}""")


# --- ingest (expected results from the catalog the scan records were rendered from) --

RUN_CLOCK = "2024-02-01 00:00:00"
CATALOG_COLS = ("file_path, file_name, file_size, file_hash, media_type, creation_date, duration, "
                "width, height, codec_name, codec_long_name, bit_rate, frame_rate, format_name, "
                "format_long_name, is_corrupted, error_message, analyzed_at, modified_at")

_NEW_FILES = f"""newf AS (
  SELECT {dirname_sql('file_path')} || '/new_' || id || '.jpg' AS file_path,
         'new_' || id || '.jpg' AS file_name, file_size, file_hash AS content_md5,
         id % 30 = 0 AS c30, id % 30 <> 0 AND id % 50 = 0 AS c50,
         id % 30 <> 0 AND id % 50 <> 0 AND id % 20 = 0 AS c20, modified_at + 7 AS modified_at
  FROM media_files WHERE id % 10 = 0
)"""

_NEW_ROWS = f"""new_rows AS (
  SELECT file_path, file_name, file_size,
         CASE WHEN c30 OR c50 THEN NULL ELSE content_md5 END AS file_hash,
         'image' AS media_type,
         CASE WHEN c30 OR c50 THEN NULL ELSE TIMESTAMP '2023-03-20 10:15:00' END AS creation_date,
         CAST(NULL AS DOUBLE) AS duration,
         CASE WHEN c30 OR c50 OR c20 THEN NULL ELSE 4000 END AS width,
         CASE WHEN c30 OR c50 OR c20 THEN NULL ELSE 3000 END AS height,
         CAST(NULL AS VARCHAR) AS codec_name, CAST(NULL AS VARCHAR) AS codec_long_name,
         CAST(NULL AS BIGINT) AS bit_rate, CAST(NULL AS DOUBLE) AS frame_rate,
         CASE WHEN c30 OR c50 OR c20 THEN 'jpg' ELSE 'jpeg' END AS format_name,
         CASE WHEN c30 OR c50 OR c20 THEN 'JPG Image' ELSE 'JPEG Image' END AS format_long_name,
         c30 OR c50 AS is_corrupted,
         CASE WHEN c30 THEN 'Critical image corruption: image file is truncated (17 bytes not processed)'
              WHEN c50 THEN 'PIL error (continuing with exiftool): unknown EXIF orientation tag | Exiftool also failed'
              WHEN c20 THEN 'PIL error (continuing with exiftool): unknown EXIF orientation tag' END AS error_message,
         TIMESTAMP '{RUN_CLOCK}' AS analyzed_at, modified_at
  FROM newf
)"""

_REANALYZED = f"""reanalyzed AS (
  SELECT file_path, file_name, file_size, file_hash, media_type, creation_date, duration, width, height,
         codec_name, codec_long_name, bit_rate, frame_rate,
         CASE WHEN is_corrupted AND media_type = 'image'
              THEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) ELSE format_name END AS format_name,
         CASE WHEN is_corrupted AND raw
              THEN upper(regexp_extract(file_name, '\\.([^.]*)$', 1)) || ' RAW Image'
              WHEN is_corrupted AND media_type = 'image'
              THEN upper(regexp_extract(file_name, '\\.([^.]*)$', 1)) || ' Image' ELSE format_long_name END
           AS format_long_name,
         is_corrupted AND NOT raw AS is_corrupted,
         CASE WHEN raw THEN NULL ELSE error_message END AS error_message,
         TIMESTAMP '{RUN_CLOCK}' AS analyzed_at,
         modified_at + CASE WHEN id % 4 = 0 THEN 60 ELSE 0 END AS modified_at,
         id % 4 = 0 AS touched
  FROM (SELECT *, media_type = 'image' AND lower(right(file_path, 4)) IN ({RAW_SQL}) AS raw
        FROM media_files)
)"""


def _ingest_sql(q: dict[str, str]) -> None:
    ctes = (_NEW_FILES, _NEW_ROWS, _REANALYZED)
    q["media_inventory"] = with_media(
        f"""SELECT file_path, 'media' AS inventory_status FROM media_files
            UNION ALL SELECT file_path, 'media' FROM newf
            UNION ALL SELECT {dirname_sql('file_path')} || '/.DS_Store_' || id, 'nonmedia' FROM media_files WHERE id % 25 = 0
            UNION ALL SELECT {dirname_sql('file_path')} || '/.thumbnails/t_' || id || '.jpg', 'hidden_dir' FROM media_files WHERE id % 25 = 0
            UNION ALL SELECT {dirname_sql('file_path')} || '/notes_' || id || '.txt', 'nonmedia' FROM media_files WHERE id % 25 = 0""",
        *ctes)
    q["inventory_counts"] = with_media(
        """SELECT count(*) FILTER (WHERE contains(file_path, 'Camera Uploads')) AS media_files,
                  (SELECT 2 * count(*) FROM media_files WHERE id % 25 = 0) AS skipped_nonmedia,
                  count(*) FILTER (WHERE NOT contains(file_path, 'Camera Uploads')) AS skipped_pattern
           FROM (SELECT file_path FROM media_files UNION ALL SELECT file_path FROM newf)""", *ctes)
    q["content_hash"] = with_media("SELECT file_path, md5(text) AS file_hash FROM mf_parts_paths",
                                   """mf_parts_paths AS (
  SELECT dir || '/' || stem || '.' || ext AS file_path, text FROM mf_parts)""")
    q["file_content_hash"] = q["content_hash"]
    q["probe_json_ingest"] = with_media(
        """SELECT file_path, duration, width, height, codec_name, codec_long_name, bit_rate,
                  format_name, format_long_name, frame_rate, creation_date
           FROM media_files WHERE media_type = 'video' AND NOT is_corrupted""")
    q["exif_json_ingest"] = with_media(
        """SELECT file_path, creation_date FROM media_files WHERE media_type = 'image' AND NOT is_corrupted
           UNION ALL SELECT file_path, TIMESTAMP '2023-03-20 10:15:00' FROM newf""", *ctes)
    q["corruption_classes"] = with_media(
        """SELECT file_path, is_corrupted, error_message FROM reanalyzed WHERE error_message IS NOT NULL
           UNION ALL SELECT file_path, is_corrupted, error_message FROM new_rows WHERE error_message IS NOT NULL""",
        *ctes)
    q["incremental_skip"] = with_media(
        "SELECT file_path FROM media_files WHERE id % 4 = 0 UNION ALL SELECT file_path FROM newf", *ctes)
    build = f"""SELECT {CATALOG_COLS} FROM media_files WHERE id % 4 <> 0
               UNION ALL SELECT {CATALOG_COLS} FROM reanalyzed WHERE touched
               UNION ALL SELECT {CATALOG_COLS} FROM new_rows"""
    q["incremental_catalog_build"] = with_media(build, *ctes)
    q["stream_catalog_upsert"] = q["bucketed_catalog_build"] = q["incremental_catalog_build"]
    q["catalog_upsert"] = with_media(
        f"""SELECT {CATALOG_COLS} FROM reanalyzed UNION ALL SELECT {CATALOG_COLS} FROM new_rows""", *ctes)
    q["status_counters"] = with_media(
        """SELECT (SELECT count(*) FROM media_files WHERE id % 4 = 0) + (SELECT count(*) FROM newf) AS processed,
                  (SELECT count(*) FROM media_files WHERE id % 4 <> 0) AS skipped,
                  (SELECT count(*) FROM reanalyzed WHERE touched AND is_corrupted)
                    + (SELECT count(*) FROM new_rows WHERE is_corrupted) AS corrupted,
                  0 AS errors""", *ctes)


# --- plans ----------------------------------------------------------------------------

_INVENTORY = f"""inventory AS (
  SELECT file_path, file_size FROM media_files WHERE id % 9 <> 0
  UNION ALL
  SELECT {dirname_sql('file_path')} || '/' || {stem_sql('file_path')} || '_jpg.jpg',
         CAST(file_size * 3 / 10 AS BIGINT)
  FROM media_files WHERE id % 5 = 0 AND lower({ext_sql('file_path')}) IN ('.dng', '.cr2', '.nef')
)"""
_LISTED = """listed AS (SELECT id, file_path FROM media_files)"""


def _plan_sql(q: dict[str, str]) -> None:
    base = (_INVENTORY, _LISTED)
    q["file_list_scan"] = with_media("SELECT file_path FROM listed", *base)
    q["missing_files"] = with_media(
        "SELECT file_path FROM listed WHERE file_path NOT IN (SELECT file_path FROM inventory)", *base)
    q["directory_list_union"] = with_media(
        f"SELECT {dirname_sql('file_path')} AS dir_path FROM listed UNION ALL SELECT '/library'", *base)
    d = dirname_sql("l.file_path")
    q["deletion_plan"] = with_media(
        f"""SELECT l.file_path AS input_path,
                   CASE WHEN i.file_path IS NULL THEN 'missing' ELSE 'delete' END AS status,
                   i.file_size AS original_size,
                   length({d}) - length(replace({d}, '/', '')) AS depth, {d} AS dir,
                   {basename_sql('l.file_path')} AS name
            FROM listed l LEFT JOIN inventory i USING (file_path)
            WHERE contains(l.file_path, 'Camera Uploads')""", *base)
    q["deletion_totals"] = with_media(
        """SELECT count(i.file_path) AS files_to_delete,
                  CAST(coalesce(sum(i.file_size), 0) AS BIGINT) AS bytes_to_free,
                  count(*) - count(i.file_path) AS missing
           FROM listed l LEFT JOIN inventory i USING (file_path)
           WHERE contains(l.file_path, 'Camera Uploads')""", *base)
    q["empty_dirs"] = with_media(
        f"""SELECT DISTINCT e AS dir_path, len(list_filter(string_split(e, '/'), lambda x: x <> '')) + 1 AS parts
            FROM (SELECT {dirname_sql('file_path')} || '/empty' || id AS e FROM media_files WHERE id % 50 = 0)
            WHERE NOT EXISTS (SELECT 1 FROM media_files m
                              WHERE {dirname_sql('m.file_path')} = e
                                 OR starts_with({dirname_sql('m.file_path')}, e || '/'))""")
    enc = f"""SELECT l.file_path AS input_path,
                     {dirname_sql('l.file_path')} || '/' || {stem_sql('l.file_path')} || '_encoded'
                       || {ext_sql('l.file_path')} AS output_path,
                     'encode' AS status, i.file_size AS original_size,
                     i.file_size * CAST(0.6 AS DOUBLE) AS estimated_size, false AS output_exists
              FROM listed l JOIN inventory i USING (file_path)"""
    q["encode_plan"] = with_media(enc, *base)
    q["encode_totals"] = with_media(
        """SELECT count(*) AS successes, 0 AS skipped, 0 AS errors,
                  CAST(coalesce(sum(original_size), 0) AS BIGINT) AS original_bytes,
                  round(coalesce(sum(estimated_size), 0.0), 2) AS estimated_bytes,
                  CASE WHEN sum(original_size) > 0 THEN
                    round((sum(original_size) - sum(estimated_size)) / sum(original_size) * 100, 6)
                  ELSE 0.0 END AS percent_saved
           FROM enc""", *base, f"enc AS ({enc})")
    raw = f"""SELECT m.file_path AS input_path,
                     CASE WHEN is_raw THEN {dirname_sql('m.file_path')} || '/' || {stem_sql('m.file_path')}
                          || '_jpg.jpg' END AS output_path,
                     i.file_size AS original_size, is_raw
              FROM (SELECT *, lower({ext_sql('file_path')}) IN ({RAW_SQL}) AS is_raw FROM media_files
                    WHERE media_type = 'image' AND NOT is_corrupted) m
              JOIN inventory i USING (file_path)"""
    rawp = """SELECT r.input_path, r.output_path,
                     CASE WHEN NOT r.is_raw THEN 'filtered' WHEN o.file_path IS NOT NULL THEN 'skipped'
                          ELSE 'convert' END AS status,
                     r.original_size,
                     CASE WHEN r.is_raw AND o.file_path IS NULL THEN r.original_size * CAST(0.3 AS DOUBLE) END AS estimated_size,
                     o.file_path IS NOT NULL AS output_exists
              FROM raw r LEFT JOIN inventory o ON o.file_path = r.output_path"""
    q["raw_convert_plan"] = with_media(rawp, *base, f"raw AS ({raw})")
    q["raw_convert_totals"] = with_media(
        """SELECT count(*) FILTER (WHERE status = 'convert') AS successes,
                  count(*) FILTER (WHERE status = 'skipped') AS skipped, 0 AS errors,
                  CAST(coalesce(sum(original_size) FILTER (WHERE status = 'convert'), 0) AS BIGINT) AS original_bytes,
                  round(coalesce(sum(estimated_size) FILTER (WHERE status = 'convert'), 0.0), 2) AS estimated_bytes,
                  CASE WHEN sum(original_size) FILTER (WHERE status = 'convert') > 0 THEN
                    round((sum(original_size) FILTER (WHERE status = 'convert')
                           - sum(estimated_size) FILTER (WHERE status = 'convert'))
                          / sum(original_size) FILTER (WHERE status = 'convert') * 100, 6)
                  ELSE 0.0 END AS percent_saved
           FROM rawp""", *base, f"raw AS ({raw})", f"rawp AS ({rawp})")
    plan_size = lambda x: size_label_sql(x, ("B", "KB", "MB", "GB"), "TB")
    q["conversion_log"] = with_media(
        f"""SELECT input_path, output_path,
                   'CONVERT_SUCCESS: ' || input_path || ' -> ' || output_path || ' | Size: '
                   || {plan_size('original_size')} || ' -> ' || {plan_size('estimated_size')}
                   || ' (-' || printf('%.1f', round_even((original_size - estimated_size) / original_size * 100, 1))
                   || '%) | Resolution: Unknown | Duration: 00:00' AS message
            FROM rawp WHERE status = 'convert'""", *base, f"raw AS ({raw})", f"rawp AS ({rawp})")
    c8 = f"""SELECT file_path, file_name, media_type,
                    coalesce({ts_text_sql(path_date_sql('file_path'))}, {epoch_text_sql('modified_at')}) AS suggested
             FROM media_files WHERE creation_date IS NULL AND NOT is_corrupted"""
    q["suggestion_list_scan"] = with_media("SELECT file_path, suggested FROM c8", *base, f"c8 AS ({c8})")
    k6 = f"""SELECT c.file_path AS input_path, c.suggested,
                    CASE WHEN lower({ext_sql('c.file_path')}) IN ('.mpg', '.mpeg', '.m2v', '.vob', '.dat')
                         THEN 'unsupported_format' ELSE 'update' END AS status,
                    CASE WHEN lower({ext_sql('c.file_path')}) IN ('.mpg', '.mpeg', '.m2v', '.vob', '.dat') THEN NULL
                         WHEN c.media_type = 'image' THEN 'EXIF' ELSE 'Video Metadata' END AS method
             FROM c8 c WHERE c.file_path IN (SELECT file_path FROM inventory)"""
    q["creation_time_plan"] = with_media(k6, *base, f"c8 AS ({c8})")
    q["creation_time_counters"] = with_media(
        """SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'update') AS updated,
                  0 AS skipped_has_metadata, 0 AS skipped_no_pattern,
                  count(*) FILTER (WHERE status = 'unsupported_format') AS unsupported_format
           FROM k6""", *base, f"c8 AS ({c8})", f"k6 AS ({k6})")
    fl = f"""SELECT file_path AS source_path, file_name AS target_name, false AS renamed,
                    '/library/' || file_name AS target_path, file_size
             FROM media_files WHERE starts_with(file_path, '/library/')
               AND {dirname_sql('file_path')} <> '/library'"""
    q["flatten_plan"] = with_media(
        "SELECT source_path, target_name, renamed, target_path FROM fl", f"fl AS ({fl})")
    q["move_totals"] = with_media(
        "SELECT count(*) AS moved, 0 AS conflicts, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size FROM fl",
        f"fl AS ({fl})")
    old_where = (f"NOT is_corrupted AND media_type = 'video' AND (codec_name IN ({OLD_CODECS_SQL}) "
                 f"OR format_name IN ({OLD_FORMATS_SQL}))")
    res = "CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR)"
    rule = "#" + "=" * 100
    body = f"""SELECT 1 AS section,
                 '# ' || upper(coalesce(media_type, 'N/A')) || ' | ' || {size_label_sql('file_size')} || ' | '
                 || CASE WHEN duration IS NOT NULL AND duration <> 0 THEN {duration_label_sql('duration')} ELSE 'N/A' END
                 || ' | ' || CASE WHEN bit_rate IS NOT NULL AND bit_rate <> 0 THEN {bitrate_label_sql('bit_rate')} ELSE 'N/A' END
                 || ' | ' || coalesce(nullif({res}, ''), 'N/A') || ' | ' || coalesce(nullif(codec_name, ''), 'N/A')
                 || chr(10) || file_path || chr(10) || chr(10) AS block
               FROM media_files WHERE {old_where}"""
    stats = f"""SELECT count(*) AS n, count(*) FILTER (WHERE media_type = 'video') AS v,
                       count(*) FILTER (WHERE media_type = 'image') AS i,
                       coalesce(sum(file_size), 0) AS size, coalesce(sum(duration), 0.0) AS dur
                FROM media_files WHERE {old_where}"""
    q["export_list"] = with_media(
        f"""{body}
            UNION ALL
            SELECT 0, '# List of video files with outdated codecs/formats' || chr(10) || '# Found ' || n
                      || ' files' || chr(10) || '# Created: 2024-01-15 10:30:00' || chr(10) || '#' || chr(10)
                      || '# Format: file_path | type | size | duration | bitrate | resolution | codec' || chr(10)
                      || '{rule}' || chr(10) || chr(10) FROM st
            UNION ALL
            SELECT 2, '{rule}' || chr(10) || '# SUMMARY:' || chr(10) || '# Total files: ' || n
                      || CASE WHEN v > 0 OR i > 0 THEN printf(' (Videos: %d, Images: %d)', v, i) ELSE '' END
                      || chr(10) || '# Total size: ' || {size_label_sql('size')}
                      || CASE WHEN dur > 0 THEN chr(10) || '# Total duration: ' || {duration_label_sql('dur')} ELSE '' END
                      || chr(10)
            FROM st""", f"st AS ({stats})")
    q["format_labels"] = with_media(
        f"""SELECT file_path, {size_label_sql('file_size')} AS size_label,
                   {plan_size('file_size')} AS plan_size_label,
                   {bitrate_label_sql('bit_rate')} AS bitrate_label,
                   {duration_label_sql('duration')} AS duration_label,
                   left(file_hash, 16) AS short_hash,
                   CASE WHEN codec_name IS NULL OR codec_name = '' THEN 'N/A' ELSE left(codec_name, 7) END AS short_codec,
                   CASE WHEN is_corrupted THEN 'BAD' ELSE 'OK' END AS status
            FROM media_files""")


# --- remaining inventory items ------------------------------------------------------------

def _misc_sql(q: dict[str, str]) -> None:
    vid = ", ".join(f"'{e}'" for e in _S.VIDEO_EXTENSIONS)
    img = ", ".join(f"'{e}'" for e in _S.PLAIN_IMAGE_EXTENSIONS)
    kind = (f"CASE WHEN lower({ext_sql('file_path')}) IN ({vid}) THEN 'video' "
            f"WHEN lower({ext_sql('file_path')}) IN ({RAW_SQL}) THEN 'raw' "
            f"WHEN lower({ext_sql('file_path')}) IN ({img}) THEN 'image' ELSE 'unsupported' END")
    q["media_type_of"] = with_media(
        f"""SELECT file_path, {kind} AS kind FROM (
              SELECT file_path FROM media_files UNION ALL SELECT file_path FROM newf
              UNION ALL SELECT {dirname_sql('file_path')} || '/.DS_Store_' || id FROM media_files WHERE id % 25 = 0
              UNION ALL SELECT {dirname_sql('file_path')} || '/.thumbnails/t_' || id || '.jpg' FROM media_files WHERE id % 25 = 0
              UNION ALL SELECT {dirname_sql('file_path')} || '/notes_' || id || '.txt' FROM media_files WHERE id % 25 = 0)""",
        _NEW_FILES)
    q["adhoc_filters"] = with_media(
        """SELECT file_path, file_size, creation_date FROM media_files
           WHERE file_size >= 1048576 AND file_size <= 41943040 AND media_type = 'image'
             AND creation_date >= TIMESTAMP '2022-06-01' AND creation_date < TIMESTAMP '2023-01-01'
             AND contains(file_path, 'photos')""")
    d = dirname_sql("file_path")
    q["examples_per_group"] = with_media(
        f"""SELECT extension, example_no, file_path, file_size FROM (
              SELECT lower({ext_sql('file_path')}) AS extension, file_path, file_size,
                     row_number() OVER (PARTITION BY lower({ext_sql('file_path')})
                                        ORDER BY length({d}) - length(replace({d}, '/', '')) DESC, {d},
                                                 {basename_sql('file_path')}) AS example_no
              FROM media_files WHERE NOT is_corrupted AND media_type = 'image'
                AND lower(right(file_path, 4)) IN ({RAW_SQL}))
            WHERE example_no <= 2""")
    q["examples_overlapping"] = with_media(
        f"""SELECT * FROM (
              SELECT "grouping", "group", row_number() OVER (
                       PARTITION BY "grouping", "group" ORDER BY length({d}) - length(replace({d}, '/', '')) DESC, {d},
                                                        {basename_sql('file_path')}) AS example_no, file_path, file_size
              FROM (SELECT 'codec' AS "grouping", codec_name AS "group", * FROM old_videos WHERE codec_name IN ({OLD_CODECS_SQL})
                    UNION ALL SELECT 'format', format_name, * FROM old_videos WHERE format_name IN ({OLD_FORMATS_SQL})
                    UNION ALL SELECT 'type', media_type, * FROM old_videos
                    UNION ALL SELECT 'all', '', * FROM old_videos))
            WHERE example_no <= 3""",
        f"""old_videos AS (SELECT * FROM media_files WHERE NOT is_corrupted AND media_type = 'video'
                           AND (codec_name IN ({OLD_CODECS_SQL}) OR format_name IN ({OLD_FORMATS_SQL})))""")
    q["depth_order"] = with_media(
        f"""SELECT row_number() OVER (ORDER BY length({d}) - length(replace({d}, '/', '')) DESC, {d},
                                      {basename_sql('file_path')}) AS position, file_path
            FROM media_files WHERE is_corrupted""")
    q["date_changes"] = "SELECT asset_id, new_date FROM (" + q["date_from_name_plan"] + ") WHERE status = 'update'"
    q["parse_resolution"] = with_assets("SELECT id, width, height FROM assets")
    move = ("(CASE WHEN file_size = 0 THEN '0 B' " + " ".join(
        f"WHEN file_size < {1024 ** (k + 1)} THEN CAST(round_even(file_size / {float(1024 ** k)}, 1) AS VARCHAR) || ' {u}'"
        for k, u in enumerate(["B", "KB", "MB", "GB"])) +
        f" ELSE CAST(round_even(file_size / {float(1024 ** 4)}, 1) AS VARCHAR) || ' TB' END)")
    q["format_labels_plans"] = with_media(
        f"""SELECT file_path, {move} AS move_size_label,
                   CASE WHEN duration IS NULL THEN 'N/A'
                        ELSE printf('%02d:%02d', CAST(floor(duration / 60) AS BIGINT),
                                    CAST(floor(duration - 60 * floor(duration / 60)) AS BIGINT)) END AS minutes_label,
                   CASE WHEN coalesce(duration, 0.0) >= 3600 THEN
                          printf('%02d:%02d:%02d', CAST(floor(duration / 3600) AS BIGINT),
                                 CAST(floor((duration - 3600 * floor(duration / 3600)) / 60) AS BIGINT),
                                 CAST(floor(duration - 60 * floor(duration / 60)) AS BIGINT))
                        ELSE printf('%02d:%02d', CAST(floor(coalesce(duration, 0.0) / 60) AS BIGINT),
                                    CAST(floor(coalesce(duration, 0.0) - 60 * floor(coalesce(duration, 0.0) / 60)) AS BIGINT))
                   END AS encoder_label,
                   CASE WHEN file_size > 1000000000 THEN 'high' WHEN file_size > 100000000 THEN 'medium'
                        ELSE 'low' END AS severity,
                   CASE WHEN bit_rate > 50000000 THEN 'high' ELSE 'normal' END AS bitrate_severity,
                   CASE WHEN duration > 3600 THEN 'long' ELSE 'normal' END AS duration_severity
            FROM media_files""")
    # Duplicate report lines
    res = "coalesce(CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR), 'None')"
    p0 = DUP_PATTERNS[0]
    member = (f"CASE WHEN copy_no = 0 THEN '# ORIGINAL: ' ELSE '# COPY ' || copy_no || ': ' END || "
              f"{size_label_sql('file_size')} || ' | ' || {duration_label_sql('duration')} || ' | ' || "
              f"{bitrate_label_sql('bit_rate')} || ' | ' || {res} || ' | ' || "
              f"CASE WHEN codec_name IS NULL OR codec_name = '' THEN 'N/A' ELSE left(codec_name, 8) END || "
              f"CASE WHEN contains(file_path, '{p0}') THEN ' ← MATCHES PATTERN' ELSE '' END || "
              f"chr(10) || '# ' || file_path")
    rule = "#" + "=" * 100
    q["export_duplicates_report"] = with_media(
        f"""SELECT 0 AS group_no, 0 AS part, 0 AS seq,
                   '# Duplicate list by hash' || chr(10) || '# Found ' || (SELECT count(*) FROM dup_groups)
                   || ' duplicate groups' || chr(10) || '# Filtered by pattern: {p0}' || chr(10)
                   || '# Created: 2024-01-15 10:30:00' || chr(10) || '#' || chr(10) || '{rule}' || chr(10) AS block
            UNION ALL
            SELECT group_no, 0, 0, '# Group ' || group_no || ': ' || n || ' files total, ' || n_delete
                   || ' copies to process, hash: ' || left(file_hash, 16) || '...' || chr(10) || '# Total size: '
                   || {size_label_sql('gsize * n')} || ', wasted: ' || {size_label_sql('gsize * (n - 1)')}
                   || chr(10) || '#' || chr(10) || '# File classification:' FROM live
            UNION ALL SELECT group_no, 1, copy_no, {member} FROM rows_live
            UNION ALL SELECT group_no, 2, 0, '#' || chr(10) || '# Files to delete (copies matching pattern):' FROM live
            UNION ALL SELECT group_no, 3, copy_no, file_path FROM rows_live
                      WHERE copy_no > 0 AND contains(file_path, '{p0}')
            UNION ALL SELECT group_no, 4, 0, '#' FROM live""",
        _HASHED, _DUP_GROUPS, _DUP_MEMBERS,
        """numbered AS (SELECT file_hash, row_number() OVER (ORDER BY file_count DESC, file_hash) AS group_no
                        FROM dup_groups)""",
        f"""per_group AS (SELECT m.file_hash, n.group_no, count(*) AS n, max(file_size) AS gsize,
                                count(*) FILTER (WHERE copy_no > 0 AND contains(file_path, '{p0}')) AS n_delete
                         FROM dup_members m JOIN numbered n USING (file_hash) GROUP BY m.file_hash, n.group_no)""",
        """live AS (SELECT * FROM per_group WHERE n_delete > 0)""",
        """rows_live AS (SELECT m.*, l.group_no FROM dup_members m JOIN live l USING (file_hash))""")
    q["protected_output_check"] = with_media(
        f"""SELECT a.file_path AS input_path, t.output_path FROM media_files a
            JOIN (SELECT file_path,
                         {dirname_sql('file_path')} || '/' || {stem_sql('file_path')} || '_720p'
                         || {ext_sql('file_path')} AS output_path FROM media_files) t USING (file_path)
            WHERE t.output_path IN (SELECT file_path FROM media_files)""")
    q["export_dir_tree"] = (
        "SELECT 1 AS section, line AS block FROM (" + q["tree_preorder"] + ")\nUNION ALL\n" +
        "SELECT * FROM (" + with_media(f"""SELECT 0, '# Directory Structure Analysis' || chr(10) || '# Created: 2024-01-15 10:30:00'
                          || chr(10) || '# Total directories analyzed: ' || count(*) || chr(10) || '#' || chr(10)
                          || '# Format: [subdirs count, files breakdown, total size]' || chr(10)
                          || '# Legend: dir/ = directory, empty = no files, images/videos/files = media types'
                          || chr(10) || '{rule}' || chr(10) FROM dfull""", *_DIR_CTES) + ")\nUNION ALL\n"
        + "SELECT * FROM (" + with_media(f"""SELECT 2, chr(10) || '{rule}' || chr(10) || '# SUMMARY:' || chr(10)
                          || '# Directories exported: ' || n || chr(10) || '# Total size: ' || {size_label_sql('size')} || chr(10)
                   FROM (SELECT count(*) AS n, CAST(coalesce(sum(direct_size), 0) AS BIGINT) AS size FROM dfull)""", *_DIR_CTES) + ")")


# --- one query per remaining SURVEY §2 name --------------------------------------------

def _names_sql(q: dict[str, str]) -> None:
    q["album_lookup"] = with_assets(
        "SELECT 'album-' || album AS album_id, album AS albumName, count(*) AS assets "
        "FROM assets WHERE album = 'purchase' GROUP BY album")
    q["path_pattern_filter"] = with_media(
        "SELECT count(*) AS before, count(*) FILTER (WHERE contains(file_path, 'Camera Uploads')) AS after "
        "FROM media_files")
    hidden = f"""SELECT file_path, status = 'hidden_dir' AS in_hidden_dir,
                        starts_with({basename_sql('file_path')}, '.') AS hidden_file
                 FROM ({q["media_inventory"]}) t(file_path, status)"""
    q["hidden_filter"] = hidden
    sup = ", ".join(f"'{e}'" for e in _S.SUPPORTED_EXTENSIONS)
    q["supported_media_filter"] = (
        f"SELECT file_path, lower({ext_sql('file_path')}) IN ({sup}) AS supported "
        f"FROM ({q['media_inventory']}) t(file_path, status)")
    img = ", ".join(f"'{e}'" for e in _S.IMAGE_EXTENSIONS)
    vid = ", ".join(f"'{e}'" for e in _S.VIDEO_EXTENSIONS)
    nodate = ", ".join(f"'{e}'" for e in _S.NO_DATE_METADATA_EXTENSIONS)
    q["metadata_writable"] = with_media(
        f"""SELECT file_path, CASE WHEN lower({ext_sql('file_path')}) IN ({nodate}) THEN 'unsupported_format'
                                   WHEN lower({ext_sql('file_path')}) IN ({img}) THEN 'EXIF'
                                   WHEN lower({ext_sql('file_path')}) IN ({vid}) THEN 'Video Metadata'
                                   ELSE 'Unknown' END AS method
            FROM media_files""")
    cc = q["corruption_classes"]
    is_video = f"lower({ext_sql('file_path')}) IN ({vid})"
    q["image_corruption_class"] = f"SELECT * FROM ({cc}) WHERE NOT ({is_video})"
    q["video_corruption_class"] = f"SELECT * FROM ({cc}) WHERE {is_video}"
    q["listed_existing_split"] = with_media(
        """SELECT l.file_path, i.file_path IS NOT NULL AS exists, i.file_size AS original_size
           FROM listed l LEFT JOIN inventory i USING (file_path)""", _INVENTORY, _LISTED)
    q["has_creation_metadata"] = with_media(
        "SELECT l.file_path, m.creation_date IS NOT NULL AS has_metadata "
        "FROM listed l JOIN media_files m USING (file_path)", _LISTED)
    q["duplicate_detail"] = with_media(
        f"""SELECT file_hash, file_path, file_size, duration, bit_rate,
                   CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution, codec_name
            FROM dup_members""", _HASHED, _DUP_GROUPS, _DUP_MEMBERS)


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["duplicate_groups"] = with_media(
        "SELECT file_hash, file_count, group_size, wasted_bytes FROM dup_groups",
        _HASHED, _DUP_GROUPS)
    q["original_vs_copies"] = with_media(
        """SELECT file_hash, file_path, file_size, matches_pattern, file_count,
                  copy_no = 0 AS is_original
           FROM dup_members""",
        _HASHED, _DUP_GROUPS, _DUP_MEMBERS)
    q["copy_and_group_numbers"] = with_media(
        """SELECT m.file_hash, m.file_path, m.copy_no, g.group_no_all, g.file_count
           FROM dup_members m JOIN (
             SELECT file_hash, file_count,
                    row_number() OVER (ORDER BY file_count DESC, file_hash) AS group_no_all
             FROM dup_groups) g USING (file_hash)""",
        _HASHED, _DUP_GROUPS, _DUP_MEMBERS)
    q["duplicate_delete_list"] = with_media(
        f"""SELECT file_path, file_hash, file_size FROM dup_members
            WHERE copy_no > 0 AND contains(file_path, '{DUP_PATTERNS[0]}')""",
        _HASHED, _DUP_GROUPS, _DUP_MEMBERS)
    q["wasted_space"] = with_media(
        f"""SELECT count(*) AS duplicate_groups,
                   CAST(coalesce(sum(file_count - 1), 0) AS BIGINT) AS copies,
                   CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes,
                   CAST(coalesce(sum(n_delete), 0) AS BIGINT) AS files_to_delete,
                   CAST(coalesce(sum(CASE WHEN n_delete > 0 THEN wasted_bytes END), 0) AS BIGINT)
                     AS wasted_filtered
            FROM dup_groups g LEFT JOIN (
              SELECT file_hash, count(*) AS n_delete FROM dup_members
              WHERE copy_no > 0 AND contains(file_path, '{DUP_PATTERNS[0]}') GROUP BY file_hash
            ) d USING (file_hash)""",
        _HASHED, _DUP_GROUPS, _DUP_MEMBERS)
    _report_sql(q)
    _dir_sql(q)
    _date_sql(q)
    _ingest_sql(q)
    _plan_sql(q)
    _misc_sql(q)
    _names_sql(q)
    return q
