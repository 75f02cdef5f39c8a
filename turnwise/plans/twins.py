"""DuckDB twins of folds: the rules said again as a list_reduce whose state is a struct, apart from the JVM functions that they check."""

from __future__ import annotations

from turnwise.functions import text as tx
from turnwise.plans import workflows  # noqa: F401  its queries have twins here
from turnwise.plans.registry import ORACLES, SEG
from turnwise.sources import fixtures as fx

TWINS = {
    "smooth_speakers": f"""{SEG}, n AS (SELECT *, lead(speaker) OVER w AS ns, lead(start_ms) OVER w AS nstart FROM segments WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index)),
l AS (SELECT conversation_id, list({{'k': segment_index, 's': start_ms, 'e': end_ms, 'sp': speaker, 'n': n_words, 'ns': ns, 'nx': nstart}} ORDER BY segment_index) AS l FROM n GROUP BY 1),
f AS (SELECT conversation_id, unnest(list_reduce(l, lambda a, x: list_append(a, {{'k': x.k, 'e': x.e, 'sp': CASE WHEN coalesce(x.n <= 3 AND a[-1].sp = x.ns AND a[-1].sp <> x.sp AND x.s - a[-1].e < 1500 AND x.nx - x.e < 1500, false) THEN a[-1].sp ELSE x.sp END}}), []::STRUCT(k BIGINT, e BIGINT, sp VARCHAR)[])) AS o FROM l)
SELECT conversation_id, o.k AS segment_index, o.sp AS speaker FROM f""",
    "dedup_loops": f"""{SEG}, l AS (SELECT conversation_id, list({{'k': segment_index, 's': start_ms, 'e': end_ms, 'sp': speaker, 'n': n_words, 't': lower(trim(text))}} ORDER BY segment_index) AS l FROM segments GROUP BY 1),
f AS (SELECT conversation_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(list_filter(a, lambda k: k.sp = x.sp)[-4:], lambda k: (k.t = x.t AND x.s - k.e < 25000) OR (x.n <= 4 AND x.s - k.e < 15000 AND (contains(k.t, x.t) OR contains(x.t, k.t))))) > 0 THEN a ELSE list_append(a, x) END,
  []::STRUCT(k BIGINT, s BIGINT, e BIGINT, sp VARCHAR, n BIGINT, t VARCHAR)[])) AS o FROM l)
SELECT conversation_id, o.k AS segment_index FROM f""",
    "verify_short_turns": f"""{SEG}, n AS (SELECT *, lead(speaker) OVER (PARTITION BY conversation_id ORDER BY segment_index) AS ns, regexp_replace(trim(lower(text)), '[.?!,]+$', '') IN ('the.', 'un', 'dans pas', 'les') AS brief FROM segments),
l AS (SELECT conversation_id, list({{'k': segment_index, 'sp': speaker, 'b': brief, 'ns': ns}} ORDER BY segment_index) AS l FROM n GROUP BY 1),
f AS (SELECT conversation_id, unnest(list_reduce(l, lambda a, x: list_append(a, CASE WHEN coalesce(x.b AND a[-1].sp = x.ns AND a[-1].sp = x.sp, false) THEN {{'k': x.k, 'sp': CASE x.sp WHEN 'SPEAKER_00' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END, 'c': true}} ELSE {{'k': x.k, 'sp': x.sp, 'c': false}} END), []::STRUCT(k BIGINT, sp VARCHAR, c BOOLEAN)[])) AS o FROM l)
SELECT conversation_id, o.k AS segment_index, o.sp AS speaker, o.c AS corrected FROM f""",
    "dedup_asr": f"""{SEG}, t AS (SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', '', 'g')) AS t FROM segments), n AS (SELECT *, len(regexp_split_to_array(t, '\\s+')) AS n FROM t WHERE t <> ''),
l AS (SELECT conversation_id, coalesce(speaker, 'default') AS spk, list({{'k': segment_index, 's': start_ms, 'e': end_ms, 't': t, 'n': n, 'b': t IN ('un', 'les') OR n <= 1}} ORDER BY segment_index) AS l FROM n GROUP BY 1, 2),
r AS (SELECT conversation_id, list_reduce(l, lambda a, x: CASE WHEN coalesce(CASE WHEN coalesce(x.t = a.t, false) THEN CASE WHEN x.b THEN x.s - a.e < 1200 OR (a.streak + 1 >= 3 AND x.s - a.e < 6000) ELSE x.s - a.e < 3000 OR (a.streak + 1 >= 2 AND x.s - a.e < 10000) END
  ELSE NOT x.b AND x.n <= 4 AND (contains(a.t, x.t) OR contains(x.t, a.t)) AND x.s - a.e < 800 END, false)
  THEN {{'o': a.o, 'e': a.e, 't': a.t, 'streak': CASE WHEN coalesce(x.t = a.t, false) THEN a.streak + 1 WHEN a.t IS NULL THEN a.streak ELSE 0 END}}
  ELSE {{'o': list_append(a.o, x.k), 'e': x.e, 't': x.t, 'streak': CASE WHEN coalesce(x.t = a.t, false) THEN a.streak + 1 WHEN a.t IS NULL THEN a.streak ELSE 0 END}} END, {{'o': []::BIGINT[], 'e': NULL::BIGINT, 't': NULL::VARCHAR, 'streak': 0::BIGINT}}) AS r FROM l)
SELECT conversation_id, unnest(r.o) AS segment_index FROM r""",
    "drop_overlaps": f"""{SEG}, l AS (SELECT conversation_id, list({{'k': segment_index, 's': start_ms, 'e': end_ms}} ORDER BY segment_index) AS l FROM segments GROUP BY 1),
r AS (SELECT conversation_id, list_reduce(l, lambda a, x: CASE WHEN a.h IS NULL THEN {{'o': a.o, 'h': x}}
  WHEN least(a.h.e, x.e) - greatest(a.h.s, x.s) >= 1000 AND greatest(0, a.h.e - a.h.s) > greatest(12000, 3 * greatest(0, x.e - x.s)) THEN {{'o': a.o, 'h': x}}
  WHEN least(a.h.e, x.e) - greatest(a.h.s, x.s) >= 1000 AND greatest(0, x.e - x.s) > greatest(12000, 3 * greatest(0, a.h.e - a.h.s)) THEN {{'o': a.o, 'h': a.h}}
  ELSE {{'o': list_append(a.o, a.h.k), 'h': x}} END, {{'o': []::BIGINT[], 'h': NULL::STRUCT(k BIGINT, s BIGINT, e BIGINT)}}) AS r FROM l)
SELECT conversation_id, unnest(list_append(r.o, r.h.k)) AS segment_index FROM r""",
    "live_coaching": f"""{SEG}, l AS (SELECT conversation_id AS session_id, list({{'k': segment_index, 't': trim(lower(text)), 'at': end_ms / 1000, 'cut': segment_index % 3 = 2}} ORDER BY segment_index) AS l FROM segments WHERE text <> '' GROUP BY 1),
r AS (SELECT session_id, list_reduce(l, lambda a, x: CASE WHEN contains(x.t, 'of the') AND NOT a.e1 THEN {{'o': list_append(a.o, {{'k': x.k, 'a': 'escalation:of the'}}), 'e1': true, 'e2': a.e2, 'n': a.n, 'w': a.w, 'c': a.c, 'd': a.d}}
  WHEN contains(x.t, 'que ') AND NOT a.e2 THEN {{'o': list_append(a.o, {{'k': x.k, 'a': 'escalation:que '}}), 'e1': a.e1, 'e2': true, 'n': a.n, 'w': a.w, 'c': a.c, 'd': a.d}}
  WHEN x.cut AND a.n >= 1 AND NOT a.w THEN {{'o': list_append(a.o, {{'k': x.k, 'a': 'interruption'}}), 'e1': a.e1, 'e2': a.e2, 'n': a.n + 1, 'w': true, 'c': a.c, 'd': a.d}}
  WHEN x.at > 15 AND NOT a.c AND NOT contains(x.t, 'is') AND NOT a.d THEN {{'o': list_append(a.o, {{'k': x.k, 'a': 'consent'}}), 'e1': a.e1, 'e2': a.e2, 'n': a.n + x.cut::INT, 'w': a.w, 'c': a.c, 'd': true}}
  ELSE {{'o': a.o, 'e1': a.e1, 'e2': a.e2, 'n': a.n + x.cut::INT, 'w': a.w, 'c': a.c OR contains(x.t, 'is'), 'd': a.d}} END,
  {{'o': []::STRUCT(k BIGINT, a VARCHAR)[], 'e1': false, 'e2': false, 'n': 0::BIGINT, 'w': false, 'c': false, 'd': false}}) AS r FROM l), u AS (SELECT session_id, unnest(r.o) AS o FROM r)
SELECT session_id, o.k AS chunk, o.a AS alert FROM u""",
    "turns_from_energy": f"""{SEG}, {fx.FRAMES_SQL}, w AS (SELECT recording_id, frame, coalesce(max(energy) FILTER (channel = 0), 0) AS l, coalesce(max(energy) FILTER (channel = 1), 0) AS r FROM frames GROUP BY 1, 2),
l AS (SELECT recording_id, list({{'f': frame, 'w': CASE WHEN l > r * 1.3::DOUBLE AND l > 1e-5 THEN 0 WHEN r > l * 1.3::DOUBLE AND r > 1e-5 THEN 1 END}} ORDER BY frame) AS l FROM w GROUP BY 1),
x AS (SELECT recording_id, list_reduce(l, lambda a, x: CASE WHEN coalesce(x.w, a.now) <> a.now AND CASE WHEN coalesce(x.w, a.now) = a.waiting THEN a.n + 1 ELSE 1 END >= 2
  THEN {{'o': CASE WHEN x.f * 250 > a.since THEN list_append(a.o, {{'s': a.since, 'e': x.f * 250, 'p': a.now}}) ELSE a.o END, 'now': coalesce(x.w, a.now), 'since': x.f * 250, 'waiting': coalesce(x.w, a.now), 'n': CASE WHEN coalesce(x.w, a.now) = a.waiting THEN a.n + 1 ELSE 1 END, 'stop': x.f * 250 + 250}}
  ELSE {{'o': a.o, 'now': a.now, 'since': a.since, 'waiting': coalesce(x.w, a.now), 'n': CASE WHEN coalesce(x.w, a.now) = a.waiting THEN a.n + 1 ELSE 1 END, 'stop': x.f * 250 + 250}} END,
  {{'o': []::STRUCT(s BIGINT, e BIGINT, p INTEGER)[], 'now': 0::INTEGER, 'since': 0::BIGINT, 'waiting': 0::INTEGER, 'n': 0::INTEGER, 'stop': 0::BIGINT}}) AS a FROM l),
u AS (SELECT recording_id, unnest(CASE WHEN a.stop > a.since THEN list_append(a.o, {{'s': a.since, 'e': a.stop, 'p': a.now}}) ELSE a.o END) AS o FROM x)
SELECT recording_id, o.s AS start_ms, o.e AS end_ms, o.p AS speaker FROM u""",
    "endpoint_utterances": f"""{SEG}, w AS (SELECT CAST(conversation_id AS VARCHAR) AS session_id, start_ms, unnest(w) AS text, unnest(range(len(w))) AS i FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM segments WHERE n_words > 0)),
l AS (SELECT session_id, list({{'s': (start_ms + 400 * i) / 1000, 'e': (start_ms + 400 * i + 350) / 1000, 't': text}} ORDER BY (start_ms + 400 * i) / 1000, (start_ms + 400 * i + 350) / 1000, text) AS l FROM w GROUP BY 1),
r AS (SELECT session_id, list_reduce(l, lambda a, x: CASE WHEN a.h IS NULL THEN {{'o': a.o, 'h': x}} WHEN x.s - a.h.e >= 0.6::DOUBLE OR x.e - a.h.s > 30 THEN {{'o': list_append(a.o, a.h), 'h': x}} ELSE {{'o': a.o, 'h': {{'s': a.h.s, 'e': greatest(a.h.e, x.e), 't': a.h.t || ' ' || x.t}}}} END,
  {{'o': []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)[], 'h': NULL::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR)}}) AS r FROM l), u AS (SELECT session_id, unnest(list_append(r.o, r.h)) AS o FROM r)
SELECT session_id, o.s AS start, o.e AS "end", o.t AS text FROM u""",
    "normalize_token": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '@word')) AS token FROM documents), n AS (SELECT token, replace(replace(replace(replace(replace(lower(trim(token)), '1', 'i'), '!', 'i'), '@', 'a'), '0', 'o'), '*', '') AS t FROM t)
SELECT token, list_reduce(regexp_extract_all(t, '.'), lambda a, c: CASE WHEN right(a, 2) = c || c THEN a ELSE a || c END, '') AS normal FROM n""",
    "live_partials": f"""{SEG}, w AS (SELECT CAST(conversation_id AS VARCHAR) AS session_id, start_ms + 400 * i AS s, start_ms + 400 * i + 400 AS e, CASE WHEN i % 7 IN (5, 6) THEN '' ELSE text END AS t FROM (SELECT *, unnest(w) AS text, unnest(range(len(w))) AS i FROM (SELECT conversation_id, start_ms, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM segments WHERE n_words > 0))),
l AS (SELECT session_id, list({{'s': s, 'e': e, 't': t}} ORDER BY s, e, t) AS l FROM w GROUP BY 1),
r AS (SELECT session_id, list_reduce(l, lambda a, x: list_reduce([{{
    'o': CASE WHEN a.h IS NOT NULL AND x.s - a.h.e >= 30000 AND a.h.f IS NOT NULL THEN list_append(a.o, {{'k': 'final', 'm': a.h.e, 's': a.h.f, 'e': a.h.p, 't': a.h.t}}) ELSE a.o END,
    'b': CASE WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN x.s ELSE a.h.b END, 'e': CASE WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN x.e ELSE greatest(a.h.e, x.e) END, 'u': CASE WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN x.s ELSE a.h.u END,
    'f': CASE WHEN x.t = '' THEN CASE WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN NULL ELSE a.h.f END WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN x.s ELSE coalesce(a.h.f, x.s) END,
    'p': CASE WHEN x.t = '' THEN CASE WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN NULL ELSE a.h.p END WHEN a.h IS NULL OR x.s - a.h.e >= 30000 OR a.h.p IS NULL THEN x.e ELSE greatest(a.h.p, x.e) END,
    't': trim(CASE WHEN a.h IS NULL OR x.s - a.h.e >= 30000 THEN '' ELSE a.h.t END || ' ' || x.t)}}],
  lambda z, n: CASE WHEN n.e - n.u < 900 THEN {{'o': n.o, 'h': {{'b': n.b, 'e': n.e, 'u': n.u, 'f': n.f, 'p': n.p, 't': n.t}}}}
    WHEN n.p IS NULL AND (n.e - n.b >= 30000 OR n.e - n.b > 1500) THEN {{'o': n.o, 'h': {{'b': n.e, 'e': n.e, 'u': n.e, 'f': n.f, 'p': n.p, 't': n.t}}}}
    WHEN n.p IS NULL THEN {{'o': n.o, 'h': {{'b': n.b, 'e': n.e, 'u': n.u, 'f': n.f, 'p': n.p, 't': n.t}}}}
    WHEN n.e - n.b >= 30000 OR n.e - n.p >= 600 THEN {{'o': list_append(n.o, {{'k': 'final', 'm': n.e, 's': n.f, 'e': n.p, 't': n.t}}), 'h': {{'b': n.p, 'e': n.e, 'u': n.e, 'f': NULL::BIGINT, 'p': NULL::BIGINT, 't': ''}}}}
    ELSE {{'o': list_append(n.o, {{'k': 'partial', 'm': n.e, 's': n.f, 'e': n.p, 't': n.t}}), 'h': {{'b': n.b, 'e': n.e, 'u': n.e, 'f': n.f, 'p': n.p, 't': n.t}}}} END, a),
  {{'o': []::STRUCT(k VARCHAR, m BIGINT, s BIGINT, e BIGINT, t VARCHAR)[], 'h': NULL::STRUCT(b BIGINT, e BIGINT, u BIGINT, f BIGINT, p BIGINT, t VARCHAR)}}) AS r FROM l),
v AS (SELECT session_id, unnest(CASE WHEN r.h.p IS NOT NULL THEN list_append(r.o, {{'k': 'final', 'm': r.h.e, 's': r.h.f, 'e': r.h.p, 't': r.h.t}}) ELSE r.o END) AS o FROM r)
SELECT session_id, o.k AS kind, o.m AS "at", o.s AS start, o.e AS "end", o.t AS text FROM v""",
    "restore_punctuation": f"""{SEG}, p AS (SELECT conversation_id, segment_index, text, list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM segments),
e AS (SELECT *, list_transform(p, lambda x: x || CASE WHEN right(x, 1) IN ('.', '?', '!') THEN '' WHEN regexp_matches(lower(x), '\\b(?:que|what|was)\\b') THEN '?' ELSE '.' END) AS e FROM p)
SELECT conversation_id, segment_index, CASE WHEN trim(text) = '' THEN text ELSE array_to_string(list_transform(e, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') END AS text FROM e""",
    "corpus_der": f"""WITH {fx.SEGMENTS_SQL}, {fx.TURNS_SQL}, ref AS (SELECT DISTINCT 'call_' || conversation_id AS uri, start_ms AS s, end_ms AS e, speaker AS who FROM segments WHERE end_ms > start_ms),
hyp AS (SELECT DISTINCT 'call_' || conversation_id AS uri, t_start AS s, t_end AS e, CASE WHEN turn_index % 7 = 3 THEN 'X' ELSE turn_speaker END AS who FROM turns WHERE t_end > t_start),
edge AS (SELECT DISTINCT uri, unnest([s, e]) AS t FROM ref), cut AS (SELECT uri, t FROM edge UNION SELECT uri, t - 125 FROM edge UNION SELECT uri, t + 125 FROM edge UNION SELECT uri, unnest([s, e]) FROM hyp),
span AS (SELECT * FROM (SELECT uri, t AS b, lead(t) OVER (PARTITION BY uri ORDER BY t) AS f FROM cut) x WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edge WHERE edge.uri = x.uri AND edge.t - 125 < x.f AND edge.t + 125 > x.b)),
r AS (SELECT DISTINCT uri, b, f, who FROM span JOIN ref USING (uri) WHERE s <= b AND b < e), h AS (SELECT DISTINCT uri, b, f, who FROM span JOIN hyp USING (uri) WHERE s <= b AND b < e),
n AS (SELECT uri, f - b AS ms, coalesce((SELECT count(*) FROM r WHERE r.uri = span.uri AND r.b = span.b), 0) AS nr, coalesce((SELECT count(*) FROM h WHERE h.uri = span.uri AND h.b = span.b), 0) AS nh FROM span),
t AS (SELECT uri, sum(ms * nr) AS total, sum(ms * greatest(0, nr - nh)) AS missed, sum(ms * greatest(0, nh - nr)) AS false_alarm, sum(ms * least(nr, nh)) AS paired FROM n WHERE nr + nh > 0 GROUP BY 1),
o AS (SELECT uri, r.who AS r, h.who AS h, sum(f - b) AS ms FROM r JOIN h USING (uri, b, f) GROUP BY ALL),
p AS (SELECT t.uri, max(coalesce(o0.ms, 0) + coalesce(o1.ms, 0) + coalesce(o2.ms, 0)) AS correct FROM t CROSS JOIN (VALUES ('SPEAKER_00'), ('SPEAKER_01'), ('IVR'), ('X'), ('-a')) a(x) CROSS JOIN (VALUES ('SPEAKER_00'), ('SPEAKER_01'), ('IVR'), ('X'), ('-b')) b(y) CROSS JOIN (VALUES ('SPEAKER_00'), ('SPEAKER_01'), ('IVR'), ('X'), ('-c')) c(z)
  LEFT JOIN o o0 ON o0.uri = t.uri AND o0.r = 'SPEAKER_00' AND o0.h = x LEFT JOIN o o1 ON o1.uri = t.uri AND o1.r = 'SPEAKER_01' AND o1.h = y LEFT JOIN o o2 ON o2.uri = t.uri AND o2.r = 'IVR' AND o2.h = z WHERE x <> y AND x <> z AND y <> z GROUP BY t.uri)
SELECT t.uri, CAST(total AS BIGINT) AS total, CAST(missed AS BIGINT) AS missed, CAST(false_alarm AS BIGINT) AS false_alarm, CAST(paired - correct AS BIGINT) AS confusion, CASE WHEN total > 0 THEN (missed + false_alarm + paired - correct) / total END AS der FROM t JOIN p USING (uri)""",
    "alert_history": f"""WITH {fx.HITS_SQL}, k AS (SELECT *, datediff('day', (SELECT min(created_at)::DATE FROM hits), created_at::DATE) // 5 AS batch FROM hits), b AS (SELECT batch, max(created_at) + INTERVAL 1 MICROSECOND AS now FROM k GROUP BY 1),
r AS (SELECT DISTINCT keyword, CASE WHEN length(keyword) % 2 = 0 THEN 7 ELSE 1 END AS days FROM hits WHERE keyword <> 'error'),
c AS (SELECT keyword, days, b.batch, now, count(*) FILTER (created_at >= now - to_days(days)) AS cur, count(*) FILTER (created_at < now - to_days(days) AND created_at >= now - to_days(2 * days)) AS prev FROM r JOIN k USING (keyword) JOIN b ON k.batch <= b.batch GROUP BY ALL),
p AS (SELECT *, CASE WHEN prev > 0 THEN round(100.0 * (cur - prev) / prev, 2) WHEN cur > 0 THEN 100.0 ELSE 0.0 END AS pct FROM c),
l AS (SELECT keyword, list({{'b': batch, 'n': now, 'd': days, 'c': cur, 'p': prev, 'x': pct, 'ok': cur >= 5 AND pct >= -20 AND cur + prev > 0}} ORDER BY batch) AS l FROM p GROUP BY 1),
f AS (SELECT keyword, unnest(list_reduce(l, lambda a, x: CASE WHEN x.ok AND coalesce(a[-1].n + to_minutes(1440 * length(keyword)) <= x.n, true) THEN list_append(a, x) ELSE a END, l[1:0])) AS e FROM l)
SELECT e.b AS batch, 'rule-' || keyword AS rule_id, keyword, 'Rising: ' || keyword AS title, e.c || ' hits in ' || e.d || ' days, ' || e.p || ' before' AS summary, CASE WHEN e.x >= 40 THEN 'warning' ELSE 'info' END AS severity, e.x::DOUBLE AS pct_change, e.n AS fired_at FROM f""",
}
ORACLES |= {name: sql.replace("@word", tx.WORD) for name, sql in TWINS.items()}
