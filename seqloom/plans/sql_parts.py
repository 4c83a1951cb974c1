"""SQL building blocks of the expected results, written for DuckDB.

They state the same definitions as the Spark operators, independently of them: chords are
handled as numbers (root, kind) here and as parsed labels there.
"""

from __future__ import annotations

NAMES = "['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B']"

MACROS_FREE = """
-- events as numbered sequences
seq AS (
  SELECT user_id, event_id, ts, event_type, value, props,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos
  FROM events)
"""

# chord_root / kind: null for silence.  kind: 0 maj, 1 min, 2 seventh, 3 minor seventh
CHORDS = MACROS_FREE + f""",
raw AS (
  SELECT user_id, event_id, pos, epoch_us(ts) AS micros,
         CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) % 12 END AS cr,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
                         WHEN 'signup' THEN 3 END AS ck,
         CASE WHEN event_type = 'signup'
              THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) END AS kk
  FROM seq),
filled AS (
  SELECT *, last_value(kk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k_last,
         first_value(kk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gk
  FROM raw),
keyed AS (SELECT user_id, event_id, pos, micros, cr, ck, kk, coalesce(k_last, gk) AS k, gk FROM filled),
labelled AS (
  SELECT *,
    CASE WHEN cr IS NULL THEN 'N'
         ELSE {NAMES}[cr + 1] || ':' || ['maj','min','7','min7'][ck + 1] END AS chord,
    CASE WHEN k IS NULL THEN 'N'
         ELSE {NAMES}[k % 12 + 1] || CASE WHEN k % 2 = 0 THEN ':major' ELSE ':minor' END END AS key,
    CASE WHEN gk IS NULL THEN 'N'
         ELSE {NAMES}[gk % 12 + 1] || CASE WHEN gk % 2 = 0 THEN ':major' ELSE ':minor' END END AS global_key,
    gk % 12 AS tr, gk % 2 AS tk
  FROM keyed),
refs AS (
  SELECT *,
    CASE WHEN pos = 0 THEN tr ELSE lag(cr) OVER w END AS pr,
    CASE WHEN pos = 0 THEN tk ELSE lag(ck) OVER w END AS pk,
    CASE WHEN pos = 0 THEN gk ELSE lag(k) OVER w END AS pkey,
    CASE WHEN gk IS NULL THEN 'N'
         ELSE {NAMES}[tr + 1] || CASE WHEN tk = 0 THEN ':maj' ELSE ':min' END END AS tonic
  FROM labelled WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
refs2 AS (
  SELECT *,
    CASE WHEN pos = 0 THEN tonic ELSE lag(chord) OVER w END AS prev_chord,
    CASE WHEN pos = 0 THEN global_key ELSE lag(key) OVER w END AS prev_key
  FROM refs WINDOW w AS (PARTITION BY user_id ORDER BY pos))
"""


def rot(mask: str, steps: str) -> str:
    return f"((({mask}) << CAST({steps} AS INTEGER)) | (({mask}) >> CAST(12 - ({steps}) AS INTEGER)) & 4095) & 4095"


# chord tones above the root: major 0 4 7, minor 0 3 7, seventh 0 4 7 10, minor seventh 0 3 7 10
TONES = "[145, 137, 1169, 1161]"
STEPS = "[0,2,2,3,3,1,1,1,3,3,2,2]"
MAJOR = 2741


def _scale(k: str) -> str:
    return f"(({k}) % 12 + CASE WHEN ({k}) % 2 = 1 THEN 3 ELSE 0 END) % 12"


def tps(r: str, kind: str, key: str, r0: str, kind0: str, key0: str) -> str:
    """Distance of chord (r, kind) in key number ``key`` from (r0, kind0) in ``key0``."""
    def new(mask: str, mask0: str) -> str:
        return f"bit_count(CAST(({mask}) & ~({mask0}) & 4095 AS INTEGER))"

    s, s0 = _scale(key), _scale(key0)
    fifths = f"((({s}) - ({s0}) + 12) * 7) % 12"
    return f"""CAST(CASE
      WHEN {r} IS NULL AND {r0} IS NULL THEN 0
      WHEN {r} IS NULL OR {r0} IS NULL THEN 13
      WHEN ({key} IS NULL) <> ({key0} IS NULL) THEN 13
      ELSE {STEPS}[({r} - {r0} + 12) % 12 + 1]
        + {new(rot('1', r), rot('1', r0))}
        + {new(rot('129', r), rot('129', r0))}
        + {new(rot(f'{TONES}[{kind} + 1]', r), rot(f'{TONES}[{kind0} + 1]', r0))}
        + CASE WHEN {key} IS NULL THEN 0 ELSE
            least({fifths}, 12 - {fifths})
            + {new(rot(str(MAJOR), s), rot(str(MAJOR), s0))} END
      END AS INTEGER)"""


SERIES = CHORDS + f""",
series AS (
  SELECT *, {tps('cr', 'ck', 'k', 'pr', 'pk', 'pkey')} AS offset_d,
            {tps('cr', 'ck', 'k', 'tr', 'tk', 'gk')} AS profile_d
  FROM refs2)
"""

def spans(tick_us: int) -> str:
    return SERIES + f""",
onsets AS (SELECT *, CAST(floor((micros + {tick_us // 2}) / {tick_us}.0) AS BIGINT) AS q FROM series),
latest AS (
  SELECT * FROM onsets
  QUALIFY row_number() OVER (PARTITION BY user_id, q ORDER BY pos DESC) = 1),
spans AS (
  SELECT user_id, pos AS event_pos, chord, key, offset_d, profile_d,
         q - min(q) OVER (PARTITION BY user_id) AS t0,
         coalesce(lead(q) OVER (PARTITION BY user_id ORDER BY q), q + 1)
           - min(q) OVER (PARTITION BY user_id) AS t1
  FROM latest),
ticks AS (
  SELECT user_id, event_pos, chord, key, offset_d, profile_d, t
  FROM spans, LATERAL (SELECT unnest(range(t0, t1)) AS t))
"""


SPANS = spans(14_400_000_000)


def query(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


def _floats(values) -> str:
    return "[" + ",".join(repr(float(v)) for v in values) + "]"


def _curve_parts() -> str:
    import math

    taper = math.sqrt(0.5) / (8 * 0.5)
    signed = [0.0 if k == 0 else (1 if k > 0 else -1) * math.exp(-(taper * k) ** 2) for k in range(-8, 9)]
    scale = sum(abs(c) for c in signed) ** 2
    gauss = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
    return f""",
fr AS (
  SELECT user_id, t, event_pos, chord, key, profile_d AS v,
         list(profile_d) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS f,
         least(t, 8) AS b
  FROM ticks),
fc AS (SELECT *, {_floats(signed)}[9 - b : 8 - b + len(f)] AS c FROM fr),
nov AS (
  SELECT user_id, t, event_pos, chord, key, v, round(list_sum(list_transform(range(1, len(f) + 1), lambda i:
    c[i] * list_sum(list_transform(range(1, len(f) + 1), lambda j: c[j] / (1.0 + abs(f[i] - f[j]))))))
    / {scale!r}, 9) AS novelty
  FROM fc),
nf AS (
  SELECT *, list(novelty) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS f,
         least(t, 8) AS b FROM nov),
ng AS (SELECT *, {_floats(gauss)}[9 - b : 8 - b + len(f)] AS g FROM nf),
sm AS (
  SELECT * EXCLUDE (f, b, g), round(list_sum(list_transform(range(1, len(f) + 1), lambda i: f[i] * g[i]))
                                    / list_sum(g), 9) AS smooth FROM ng),
th AS (
  SELECT *, round(quantile_cont(smooth, 0.5) OVER (PARTITION BY user_id ORDER BY t
                    ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)
                  + 0.05 * avg(smooth) OVER (PARTITION BY user_id), 9) AS threshold,
         lag(smooth) OVER (PARTITION BY user_id ORDER BY t) AS sb,
         lead(smooth) OVER (PARTITION BY user_id ORDER BY t) AS sa
  FROM sm),
pk AS (
  SELECT *, coalesce(smooth > sb AND smooth > sa AND smooth > threshold, false) AS is_peak FROM th),
numbered AS (
  SELECT user_id, t, event_pos, chord, key, v,
         CAST(sum(CAST(is_peak AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg_ord
  FROM pk),
segments AS (
  SELECT user_id, seg_ord, min(t) AS t0, max(t) + 1 AS t1, list(v ORDER BY t) AS ts
  FROM numbered GROUP BY user_id, seg_ord)
"""


SEGMENTS = SPANS + _curve_parts()

# the two parts below may be materialised: they are read several times
RESAMPLED = SEGMENTS + """,
r0 AS (
  SELECT user_id, seg_ord, ts, list_transform(range(0, 30), lambda i: round(
    ts[CAST(floor(i * (len(ts) - 1) / 29.0) AS BIGINT) + 1] * (1 - (i * (len(ts) - 1) % 29) / 29.0)
    + ts[least(CAST(floor(i * (len(ts) - 1) / 29.0) AS BIGINT) + 2, len(ts))]
      * ((i * (len(ts) - 1) % 29) / 29.0), 9)) AS x
  FROM segments),
r1 AS MATERIALIZED (
  SELECT *, list_filter(x, lambda v, i: i = 1 OR v <> x[i - 1]) AS cls,
         x[1] AS f1, x[30] AS f2, list_max(x) AS mx, list_min(x) AS mn
  FROM r0),
r2 AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY cls) AS s,
         row_number() OVER (PARTITION BY cls ORDER BY user_id, seg_ord) AS r FROM r1),
sources AS (SELECT * FROM r2 WHERE (s <= 10 AND r = s) OR (s > 10 AND r > 10)),
xs AS MATERIALIZED (SELECT x, any_value(f1) AS f1, any_value(f2) AS f2, any_value(mx) AS mx, any_value(mn) AS mn
       FROM r2 GROUP BY x),
xpairs AS MATERIALIZED (
  SELECT a.x AS xa, b.x AS xb
  FROM (SELECT DISTINCT x, f1, f2, mx, mn FROM sources) a JOIN xs b
    ON abs(a.mx - b.mx) <= 2.000001 AND abs(a.mn - b.mn) <= 2.000001
   AND (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2) <= 4.000001)
"""

EDGES = RESAMPLED + """,
dtw AS (
  SELECT xa, xb, 0 AS d,
         list_transform(range(0, 30), lambda i: CASE WHEN i = 0 THEN (xa[1] - xb[1]) * (xa[1] - xb[1])
                                                ELSE CAST('inf' AS DOUBLE) END) AS p1,
         list_transform(range(0, 30), lambda i: CAST('inf' AS DOUBLE)) AS p2
  FROM xpairs
  UNION ALL
  SELECT xa, xb, d + 1,
         list_transform(range(0, 30), lambda i: CASE WHEN d + 1 - i BETWEEN 0 AND 29 THEN
             (xa[i + 1] - xb[d + 2 - i]) * (xa[i + 1] - xb[d + 2 - i])
             + least(coalesce(p2[i], CAST('inf' AS DOUBLE)), coalesce(p1[i], CAST('inf' AS DOUBLE)), p1[i + 1])
           ELSE CAST('inf' AS DOUBLE) END),
         p1
  FROM dtw
  WHERE d < 58 AND list_min(list_concat(p1, p2)) <= 4.000001),
xdist AS (SELECT xa, xb, round(sqrt(p1[30]), 9) AS dist FROM dtw WHERE d = 58),
ranked AS (
  SELECT s.user_id AS su, s.seg_ord AS so, t.user_id AS tu, t.seg_ord AS tord, dist,
         row_number() OVER (PARTITION BY s.user_id, s.seg_ord ORDER BY dist, t.user_id, t.seg_ord) AS rk
  FROM sources s JOIN xdist ON xa = s.x JOIN r2 t ON t.x = xb
  WHERE dist <= 2),
edges AS MATERIALIZED (
  SELECT su AS source_track, so AS source_ord, tu AS target_track, tord AS target_ord,
         round(dist, 2) AS distance, CASE WHEN dist = 0 THEN 'same' ELSE 'sim' END AS type
  FROM ranked WHERE rk <= 10 AND NOT (su = tu AND so = tord))
"""


def recursive(parts: str, select: str) -> str:
    return f"WITH RECURSIVE {parts}\n{select}"
