"""Equivalent SQL of the registered queries, for a row-by-row check in DuckDB."""

from __future__ import annotations

from tracemill.adapter import EVENTS_SQL

MIN = 60_000_000

EV = "WITH RECURSIVE ev AS MATERIALIZED (SELECT *, epoch_us(timestamp) AS us FROM (" + EVENTS_SQL.format(
    source="events") + "))"

V4 = "[CAST(p AS BIGINT) FOR p IN string_split({c}, '.')]"


def ext(c: str) -> str:
    """External address test by octet arithmetic."""
    o = V4.format(c=c)
    n = f"({o}[1]*16777216 + {o}[2]*65536 + {o}[3]*256 + {o}[4])"
    ranges = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
              "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
              "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
    tests = []
    for r in ranges:
        base, bits = r.split("/")
        a, b, d, e = (int(x) for x in base.split("."))
        low = a << 24 | b << 16 | d << 8 | e
        tests.append(f"{n} BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}")
    return f"({c} IS NOT NULL AND NOT ({' OR '.join(tests)}))"


def windows(minutes: int, src: str = "ev") -> str:
    return f"""
SELECT case_id, time_bucket(INTERVAL {minutes} MINUTES, timestamp) AS window_start,
 time_bucket(INTERVAL {minutes} MINUTES, timestamp) + INTERVAL {minutes} MINUTES AS window_end,
 count(*) AS event_count,
 count(*) FILTER (source_type='authentication') AS src_authentication,
 count(*) FILTER (source_type='process') AS src_process,
 count(*) FILTER (source_type='file_activity') AS src_file_activity,
 count(*) FILTER (source_type='network') AS src_network,
 count(*) FILTER (source_type='browser') AS src_browser,
 count(*) FILTER (source_type='system') AS src_system,
 count(*) FILTER (source_type='generic') AS src_generic,
 count(DISTINCT "user") AS distinct_users, count(DISTINCT host) AS distinct_hosts,
 count(DISTINCT source_ip) AS distinct_source_ips,
 count(DISTINCT destination_ip) AS distinct_destination_ips,
 count(DISTINCT process) AS distinct_processes, count(DISTINCT file_path) AS distinct_file_paths,
 count(DISTINCT evidence_id) AS distinct_evidence, count(DISTINCT action) AS distinct_event_types,
 count(*) FILTER (severity IN ('High','Critical')) AS high_severity_count,
 count(*) FILTER (severity='Critical') AS critical_severity_count,
 0::BIGINT AS duplicate_count
FROM {src} GROUP BY ALL"""


# Rule CTEs with the catalogue's parameters (see queries.RULE_PARAMS).
RULES = f"""
, lg AS (SELECT * FROM ev WHERE source_type='authentication')
, fl AS (SELECT * FROM lg WHERE status='failure'), sc AS (SELECT * FROM lg WHERE status='success')
, a1s AS (SELECT s.case_id, s."user" AS u, s.id AS sid, s.us, count(*) AS n, min(f.us) AS first_us
   FROM sc s JOIN fl f ON s.case_id=f.case_id AND s."user"=f."user" AND s.us-f.us BETWEEN 0 AND {1440 * MIN}
   GROUP BY ALL HAVING count(*)>=2)
, a1h AS (SELECT * FROM a1s QUALIFY row_number() OVER (PARTITION BY case_id,u ORDER BY n DESC, us, sid)=1)
, a1b AS (SELECT f.case_id, f."user" AS u, f.id, f.us, count(*) AS n, max(g.us) AS last_us
   FROM fl f JOIN fl g ON f.case_id=g.case_id AND f."user"=g."user" AND g.us-f.us BETWEEN 0 AND {1440 * MIN}
   WHERE NOT EXISTS (SELECT 1 FROM a1h h WHERE h.case_id=f.case_id AND h.u=f."user")
   GROUP BY ALL HAVING count(*)>=2)
, a1m AS (SELECT * FROM a1b QUALIFY row_number() OVER (PARTITION BY case_id,u ORDER BY n DESC, us, id)=1)
, a3 AS (SELECT case_id, "user" AS u, id, us, source_ip,
    lead(id) OVER w AS id2, lead(us) OVER w AS us2, lead(source_ip) OVER w AS ip2
   FROM lg WINDOW w AS (PARTITION BY case_id,"user" ORDER BY us,id))
, a3h AS (SELECT * FROM a3 WHERE us2-us<={3600 * 1_000_000} AND source_ip<>ip2
   QUALIFY row_number() OVER (PARTITION BY case_id,u ORDER BY us,id)=1)
, ps AS (SELECT * FROM ev WHERE source_type='process' AND
   (lower(process) IN ('powershell.exe','cmd.exe','python3') OR command_line LIKE '%enc%'
    OR command_line LIKE '%-nop%' OR command_line LIKE '%-w hidden%'))
, fm AS (SELECT * FROM ev WHERE source_type='file_activity' AND action IN ('write','delete'))
, fr AS (SELECT * FROM ev WHERE source_type='file_activity' AND action IN ('rename'))
, f1 AS (SELECT a.case_id, a.host, a."user" AS u, a.id, a.us, count(*) AS n, max(b.us) AS last_us
   FROM fm a JOIN fm b ON a.case_id=b.case_id AND a.host=b.host AND a."user"=b."user"
    AND b.us-a.us BETWEEN 0 AND {1440 * MIN} GROUP BY a.case_id,a.host,a."user",a.id,a.us HAVING count(*)>=3
   QUALIFY row_number() OVER (PARTITION BY a.case_id,a.host,a."user" ORDER BY count(*) DESC, a.us DESC)=1)
, f2 AS (SELECT a.case_id, a.host, a."user" AS u, a.id, a.us, count(*) AS n, max(b.us) AS last_us
   FROM fr a JOIN fr b ON a.case_id=b.case_id AND a.host=b.host AND a."user"=b."user"
    AND b.us-a.us BETWEEN 0 AND {2880 * MIN} GROUP BY a.case_id,a.host,a."user",a.id,a.us HAVING count(*)>=2
   QUALIFY row_number() OVER (PARTITION BY a.case_id,a.host,a."user" ORDER BY count(*) DESC, a.us DESC)=1)
, cn AS (SELECT * FROM ev WHERE source_type='network' AND {ext("destination_ip")})
, pr AS (SELECT * FROM ev WHERE source_type='process')
, nn AS (SELECT c.case_id, c.host, c.id, c.us, p.id AS pid, p.us AS pus
   FROM cn c JOIN pr p ON c.case_id=p.case_id AND c.host=p.host AND c.us-p.us BETWEEN 0 AND {240 * MIN}
   QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY p.us DESC, p.id)=1)
, cand AS (
   SELECT case_id,'AUTH-001' AS rule_id, u AS scope_a, '' AS scope_b, 'High' AS severity, n+1 AS n, first_us AS start_us, us AS end_us FROM a1h
   UNION ALL SELECT case_id,'AUTH-001',u,'','Medium',n,us,last_us FROM a1m
   UNION ALL SELECT case_id,'AUTH-002',source_ip,'','Medium',count(*),min(us),max(us) FROM lg WHERE {ext("source_ip")} GROUP BY case_id,source_ip HAVING count(*)>=3
   UNION ALL SELECT case_id,'AUTH-003',u,'','Low',2,us,us2 FROM a3h
   UNION ALL SELECT case_id,'PROC-001',host,"user",CASE WHEN bool_or(command_line LIKE '%enc%') THEN 'High' ELSE 'Medium' END,count(*),min(us),max(us) FROM ps GROUP BY case_id,host,"user"
   UNION ALL SELECT case_id,'FILE-001',host,u,CASE WHEN n>=15 THEN 'High' ELSE 'Medium' END,n,us,last_us FROM f1
   UNION ALL SELECT case_id,'FILE-002',host,u,'High',n,us,last_us FROM f2
   UNION ALL SELECT case_id,'NET-001',host,'','Medium',count(*),min(pus),max(us) FROM nn GROUP BY case_id,host HAVING count(*)>=2)
, kept AS (SELECT *, row_number() OVER (PARTITION BY case_id,rule_id ORDER BY start_us,scope_a,scope_b) AS rule_rank
   FROM cand QUALIFY row_number() OVER (PARTITION BY case_id,rule_id ORDER BY start_us,scope_a,scope_b)<=10)
, mem AS (
   SELECT DISTINCT k.case_id,k.rule_id,k.scope_a,k.scope_b,e.id FROM kept k JOIN fl e ON k.rule_id='AUTH-001' AND e.case_id=k.case_id AND e."user"=k.scope_a AND e.us BETWEEN k.start_us AND k.end_us
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,h.sid FROM kept k JOIN a1h h ON k.rule_id='AUTH-001' AND h.case_id=k.case_id AND h.u=k.scope_a
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,e.id FROM kept k JOIN lg e ON k.rule_id='AUTH-002' AND e.case_id=k.case_id AND e.source_ip=k.scope_a
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,unnest([h.id,h.id2]) FROM kept k JOIN a3h h ON k.rule_id='AUTH-003' AND h.case_id=k.case_id AND h.u=k.scope_a
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,e.id FROM kept k JOIN ps e ON k.rule_id='PROC-001' AND e.case_id=k.case_id AND e.host=k.scope_a AND e."user"=k.scope_b
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,e.id FROM kept k JOIN fm e ON k.rule_id='FILE-001' AND e.case_id=k.case_id AND e.host=k.scope_a AND e."user"=k.scope_b AND e.us BETWEEN k.start_us AND k.end_us
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,e.id FROM kept k JOIN fr e ON k.rule_id='FILE-002' AND e.case_id=k.case_id AND e.host=k.scope_a AND e."user"=k.scope_b AND e.us BETWEEN k.start_us AND k.end_us
   UNION SELECT k.case_id,k.rule_id,k.scope_a,k.scope_b,unnest([n.id,n.pid]) FROM kept k JOIN nn n ON k.rule_id='NET-001' AND n.case_id=k.case_id AND n.host=k.scope_a)
"""

# Window scores from the surrogate raw score, the gate, and both finding kinds.
SCORED = """
, fw AS (""" + windows(5) + """)
, raw AS (SELECT *, CAST(-(event_count*event_count + 3*distinct_users + high_severity_count) AS DOUBLE) AS raw_score FROM fw)
, st AS (SELECT case_id, count(*) AS windows_total, min(-raw_score) AS lo, max(-raw_score) AS hi, avg(raw_score) AS mean, stddev_pop(raw_score) AS std FROM raw GROUP BY case_id)
, sw AS (SELECT raw.*, windows_total, windows_total<8 AS abstained,
   CASE WHEN windows_total<8 THEN NULL WHEN hi>lo THEN (-raw_score-lo)/(hi-lo) ELSE 0.0 END AS score, mean, std
  FROM raw JOIN st USING (case_id))
, gated AS (SELECT *, NOT abstained AND coalesce(score>=0.72 AND raw_score < mean-2.0*std, false) AS flagged FROM sw)
"""

FINDINGS = RULES + SCORED + """
, evs AS (SELECT ev.*, round(g.score,6) AS anomaly_score, coalesce(g.flagged,false) AS is_anomalous
  FROM ev LEFT JOIN gated g ON ev.case_id=g.case_id AND time_bucket(INTERVAL 5 MINUTES, ev.timestamp)=g.window_start)
, mlw AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY window_start) AS ml_rank FROM gated WHERE flagged
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY window_start)<=10)
, rf AS (SELECT k.*, 'RFND-'||lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY start_us,rule_id,scope_a,scope_b) AS VARCHAR),6,'0') AS finding_uid FROM kept k)
, fe AS (SELECT m.case_id, rf.finding_uid, 'rule' AS kind, m.id FROM mem m JOIN rf USING (case_id,rule_id,scope_a,scope_b)
  UNION ALL SELECT w.case_id,'MFND-'||lpad(CAST(ml_rank AS VARCHAR),6,'0'),'ml',e.id FROM mlw w JOIN ev e ON e.case_id=w.case_id
   AND time_bucket(INTERVAL 5 MINUTES, e.timestamp)=w.window_start)
, fs AS (SELECT fe.case_id, finding_uid, any_value(kind) AS kind, count(*) AS event_count, count(DISTINCT evidence_id) AS distinct_evidence,
   round(avg(anomaly_score),6) AS anchor_score FROM fe JOIN evs ON evs.id=fe.id GROUP BY fe.case_id, finding_uid)
, fnd AS (SELECT rf.case_id, rf.finding_uid, 'rule' AS kind, rf.rule_id, rf.severity, fs.event_count, fs.distinct_evidence,
    make_timestamp(start_us) AS timestamp_start, make_timestamp(end_us) AS timestamp_end, fs.anchor_score AS anomaly
   FROM rf JOIN fs USING (case_id, finding_uid)
  UNION ALL SELECT w.case_id, 'MFND-'||lpad(CAST(ml_rank AS VARCHAR),6,'0'),'ml',NULL,
    CASE WHEN score>=0.9 THEN 'High' ELSE 'Medium' END, fs.event_count, fs.distinct_evidence, w.window_start, w.window_end, w.score
   FROM mlw w JOIN fs ON fs.case_id=w.case_id AND fs.finding_uid='MFND-'||lpad(CAST(ml_rank AS VARCHAR),6,'0'))
, fcs AS (SELECT *, round(least(1.0, 0.40*(CASE WHEN kind='ml' THEN 0.0 ELSE 0.5+0.5*(CASE severity WHEN 'Low' THEN 0.25 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.75 ELSE 1.0 END) END)
   + 0.35*greatest(0.0,least(1.0,coalesce(anomaly,0.0))) + 0.25*least(distinct_evidence/5.0,1.0)),4) AS css FROM fnd)
"""

LINKS = f"""
, pairs AS (SELECT a.case_id, a.id AS event_a_id, b.id AS event_b_id, a.us AS us_a, b.us AS us_b,
   a.host=b.host AS sh, a."user"=b."user" AS su, a.source_ip=b.source_ip AS si,
   a.source_type AS ta, b.source_type AS tb, {ext("a.destination_ip")} AS xa, {ext("b.destination_ip")} AS xb,
   a.evidence_id AS eva, b.evidence_id AS evb
  FROM ev a JOIN ev b ON a.case_id=b.case_id AND b.us BETWEEN a.us AND a.us+300000000 AND (b.us,b.id)>(a.us,a.id))
, typed AS (SELECT *, CASE
   WHEN sh AND ((ta='process' AND tb='file_activity') OR (tb='process' AND ta='file_activity')) THEN 'CORR-004'
   WHEN sh AND ((ta='process' AND tb='network' AND xb) OR (tb='process' AND ta='network' AND xa)) THEN 'CORR-005'
   WHEN su THEN 'CORR-002'
   WHEN si AND (ta IN ('authentication','network') OR tb IN ('authentication','network')) THEN 'CORR-003'
   WHEN sh THEN 'CORR-001' END AS correlation_type,
   round(least(1.0, 0.25+CASE WHEN sh THEN 0.30 ELSE 0 END+CASE WHEN su THEN 0.30 ELSE 0 END+CASE WHEN si THEN 0.15 ELSE 0 END),4)::DOUBLE AS confidence
  FROM pairs)
, lk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY us_a,event_a_id,us_b,event_b_id) AS link_rank,
   CASE WHEN confidence>=0.85 THEN 'High' WHEN confidence>=0.65 THEN 'Medium' ELSE 'Low' END AS band
  FROM typed WHERE correlation_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY us_a,event_a_id,us_b,event_b_id)<=5000)
"""

COMPONENTS = LINKS + """
, edges AS MATERIALIZED (SELECT case_id, event_a_id AS x, event_b_id AS y FROM lk UNION SELECT case_id, event_b_id, event_a_id FROM lk)
, reach AS (SELECT case_id, x AS id, x AS r FROM edges UNION SELECT reach.case_id, edges.y, reach.r FROM reach JOIN edges ON reach.case_id=edges.case_id AND reach.id=edges.x)
, comp AS (SELECT case_id, id, min(r) AS component FROM reach GROUP BY case_id, id)
"""

TAGGED = FINDINGS + LINKS + """
, tg AS (SELECT case_id, id, bool_or(kind='rule') AS rule_seen, bool_or(kind='ml') AS ml_seen FROM fe GROUP BY case_id,id)
, le AS (SELECT case_id, event_a_id AS id, link_rank FROM lk UNION ALL SELECT case_id, event_b_id, link_rank FROM lk)
, lf AS (SELECT DISTINCT case_id, id, true AS linked FROM le)
, ef AS (SELECT evs.*, coalesce(rule_seen,false) AS rule_seen, coalesce(ml_seen,false) AS ml_seen, coalesce(linked,false) AS linked
  FROM evs LEFT JOIN tg USING (case_id,id) LEFT JOIN lf USING (case_id,id))
, marked AS (SELECT *, (rule_seen OR ml_seen OR is_anomalous OR linked) AS tagged FROM ef)
"""


def entries(minutes: int, cap: int) -> str:
    return f"""
, ent AS (SELECT m.*, NOT tagged AS context FROM marked m WHERE tagged OR EXISTS (
   SELECT 1 FROM marked t WHERE t.tagged AND t.case_id=m.case_id AND abs(t.us-m.us)<={minutes * MIN}))
, pos AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY us,id) AS position FROM ent
   QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY us,id)<={cap})
"""


def _cand(rule_id: str) -> str:
    return EV + RULES + f"""SELECT case_id, rule_id, scope_a, scope_b, severity, CAST(n AS BIGINT) AS n, start_us, end_us
FROM cand WHERE rule_id='{rule_id}'"""


ORACLES = {
    "events_search": EV + """SELECT id, event_uid, case_id, timestamp, "user", host, source_ip FROM ev
WHERE source_type='authentication' AND severity='High' AND host LIKE '%WS-0%'""",
    "events_page": EV + """SELECT id, event_uid, case_id, timestamp FROM ev ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 50""",
    "external_sources": EV + f"""SELECT case_id, source_ip, {ext("source_ip")} AS external, count(*) AS events FROM ev GROUP BY ALL""",
    "severity_profile": EV + """SELECT case_id, severity, count(*) AS events,
 CASE severity WHEN 'Low' THEN 0.4 WHEN 'Medium' THEN 0.6 WHEN 'High' THEN 0.8 ELSE 0.95 END::DOUBLE AS confidence,
 CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS severity_rank FROM ev GROUP BY ALL""",
    "command_indicators": EV + """SELECT case_id, token, count(*) AS events FROM ev,
 (SELECT unnest(['-nop','-w hidden','enc','encodedcommand','frombase64','downloadstring','iex(','invoke-expression']) AS token)
WHERE source_type='process' AND contains(lower(command_line), token) GROUP BY ALL""",
    "dup_mark": EV + """SELECT id, event_uid, evidence_id, nullif(first_value(event_uid) OVER (
  PARTITION BY case_id, evidence_id, "user", action, CAST(timestamp AS DATE) ORDER BY id), event_uid) AS duplicate_of FROM ev""",
    "feature_windows_5m": EV + windows(5),
    "feature_windows_10m": EV + windows(10),
    "window_gate": EV + SCORED + "SELECT case_id, window_start, round(score,6) AS score, flagged, abstained FROM gated",
    "event_scores": EV + SCORED + """SELECT ev.id, ev.case_id, round(g.score,6) AS anomaly_score, g.flagged AS is_anomalous
FROM ev JOIN gated g ON ev.case_id=g.case_id AND time_bucket(INTERVAL 5 MINUTES, ev.timestamp)=g.window_start""",
    "css_scores": EV + """, b AS (SELECT case_id, "user", max(CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END) AS w,
  count(*) AS n, count(DISTINCT evidence_id) AS distinct_evidence FROM ev GROUP BY ALL)
, c AS (SELECT *, round(least(1.0, 0.40*(0.5+0.5*w/4.0) + 0.35*least(1.0,(n%101)/100.0) + 0.25*least(1.0,distinct_evidence/5.0)),4)::DOUBLE AS css FROM b)
SELECT case_id, "user", CASE w WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity, distinct_evidence, css,
 CASE WHEN css>=0.75 THEN 'Potentially suspicious - high priority' WHEN css>=0.55 THEN 'Anomalous - review' WHEN css>=0.35 THEN 'Low interest' ELSE 'Informational' END AS band FROM c""",
    **{name: _cand(rid) for name, rid in (
        ("auth001", "AUTH-001"), ("auth002", "AUTH-002"), ("auth003", "AUTH-003"), ("proc001", "PROC-001"),
        ("file001", "FILE-001"), ("file002", "FILE-002"), ("net001", "NET-001"))},
    "rule_union_capped": EV + RULES + "SELECT case_id, rule_id, scope_a, scope_b, severity, CAST(n AS BIGINT) AS n, rule_rank FROM kept",
    "findings": EV + FINDINGS + """SELECT case_id, finding_uid, kind, rule_id, severity, event_count, distinct_evidence,
 timestamp_start, timestamp_end, round(css,3)::DOUBLE AS css FROM fcs""",
    "finding_members": EV + FINDINGS + "SELECT case_id, finding_uid, kind, id FROM fe",
    "finding_texts": EV + FINDINGS + """, txt AS (
 SELECT rf.case_id, rf.finding_uid,
  CASE WHEN rf.severity='High' THEN scope_a||' had '||(n-1)||' failed login attempts before a successful login within 1440 minutes. This pattern is potentially suspicious and requires investigator review.'
   ELSE scope_a||' had '||n||' failed login attempts within 1440 minutes and no subsequent success was observed in the case dataset. Requires investigator review.' END AS explanation,
  CASE WHEN rf.severity='High' THEN (n-1)||' failed login(s) followed by a successful login.' ELSE n||' failed login(s) in a single window without success.' END AS reasons
 FROM rf WHERE rule_id='AUTH-001'
 UNION ALL SELECT rf.case_id, rf.finding_uid,
  n||' scripting/interpreter process event(s) for user '||scope_b||' on '||scope_a||CASE WHEN rf.severity='High' THEN ' carrying evasion indicators (-nop, -w hidden, enc).' ELSE '.' END||
  ' Script execution is common in administration but is also used to evade controls — potentially suspicious and requires investigator review.',
  'Process(es) observed: '||p.procs||' on '||scope_a||' (user '||scope_b||').'||CASE WHEN rf.severity='High' THEN ' Command-line indicators present: -nop, -w hidden, enc — elevated severity.' ELSE '' END
 FROM rf JOIN (SELECT fe.case_id, finding_uid, array_to_string(list_sort(list_distinct(list(process))),', ') AS procs FROM fe JOIN ev e ON e.id=fe.id GROUP BY ALL) p USING (case_id, finding_uid) WHERE rule_id='PROC-001'
 UNION ALL SELECT rf.case_id, rf.finding_uid,
  n||' file rename events for host '||scope_a||' / user '||scope_b||' within 2880 minutes, affecting '||len(p.fs)||' distinct path(s). Rapid rename activity is potentially suspicious and requires investigator review.',
  n||' rename(s) (>= 2) within 2880 minutes. Paths involved: '||array_to_string(p.fs[1:5],', ')||CASE WHEN len(p.fs)>5 THEN '…' ELSE '' END||'.'
 FROM rf JOIN (SELECT fe.case_id, finding_uid, list_sort(list_distinct(list(file_path))) AS fs FROM fe JOIN ev e ON e.id=fe.id GROUP BY ALL) p USING (case_id, finding_uid) WHERE rule_id='FILE-002')
SELECT * FROM txt""",
    "analysis_stats": EV + FINDINGS + """SELECT e.case_id, e.events_considered, w.windows_total, w.windows_flagged, w.abstained, f.rule_findings, f.ml_findings
FROM (SELECT case_id, count(*) AS events_considered FROM ev GROUP BY 1) e
JOIN (SELECT case_id, count(*) AS windows_total, count(*) FILTER (flagged) AS windows_flagged, bool_or(abstained) AS abstained FROM gated GROUP BY 1) w USING (case_id)
JOIN (SELECT case_id, count(*) FILTER (kind='rule') AS rule_findings, count(*) FILTER (kind='ml') AS ml_findings FROM fnd GROUP BY 1) f USING (case_id)""",
    "top_findings": EV + FINDINGS + """SELECT case_id, row_number() OVER w AS position, finding_uid, severity FROM fnd
WINDOW w AS (PARTITION BY case_id ORDER BY CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END DESC, finding_uid DESC)
QUALIFY row_number() OVER w <= 10""",
    "links": EV + LINKS + """SELECT case_id, link_rank, 'COR-'||lpad(CAST(link_rank AS VARCHAR),6,'0') AS correlation_uid, correlation_type, event_a_id, event_b_id,
 round((us_b-us_a)/1e6,3)::DOUBLE AS time_delta_seconds, confidence, band,
 CASE WHEN eva=evb THEN eva ELSE least(eva,evb)||','||greatest(eva,evb) END AS evidence_ids FROM lk""",
    "link_stats": EV + LINKS + """, lim AS (SELECT case_id, us_a, event_a_id, us_b, event_b_id FROM lk WHERE link_rank=5000)
SELECT e.case_id, 300 AS window_seconds, e.dated_events, coalesce(p.n,0) AS pairs_evaluated, coalesce(l.links,0) AS links,
 coalesce(corr_001,0) AS corr_001, coalesce(corr_002,0) AS corr_002, coalesce(corr_003,0) AS corr_003, coalesce(corr_004,0) AS corr_004, coalesce(corr_005,0) AS corr_005,
 coalesce(band_low,0) AS band_low, coalesce(band_medium,0) AS band_medium, coalesce(band_high,0) AS band_high, coalesce(l.links,0)>=5000 AS links_truncated
FROM (SELECT case_id, count(*) AS dated_events FROM ev GROUP BY 1) e
LEFT JOIN (SELECT p.case_id, count(*) AS n FROM pairs p LEFT JOIN lim m USING (case_id)
  WHERE m.case_id IS NULL OR (p.us_a,p.event_a_id,p.us_b,p.event_b_id) <= (m.us_a,m.event_a_id,m.us_b,m.event_b_id) GROUP BY 1) p USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS links, count(*) FILTER (correlation_type='CORR-001') AS corr_001, count(*) FILTER (correlation_type='CORR-002') AS corr_002,
  count(*) FILTER (correlation_type='CORR-003') AS corr_003, count(*) FILTER (correlation_type='CORR-004') AS corr_004, count(*) FILTER (correlation_type='CORR-005') AS corr_005,
  count(*) FILTER (band='Low') AS band_low, count(*) FILTER (band='Medium') AS band_medium, count(*) FILTER (band='High') AS band_high FROM lk GROUP BY 1) l USING (case_id)""",
    "link_counts": EV + LINKS + """SELECT e.case_id, e.dated_events, coalesce(l.links,0) AS links,
 coalesce(corr_001,0) AS corr_001, coalesce(corr_002,0) AS corr_002, coalesce(corr_003,0) AS corr_003, coalesce(corr_004,0) AS corr_004, coalesce(corr_005,0) AS corr_005,
 coalesce(band_low,0) AS band_low, coalesce(band_medium,0) AS band_medium, coalesce(band_high,0) AS band_high
FROM (SELECT case_id, count(*) AS dated_events FROM ev GROUP BY 1) e
LEFT JOIN (SELECT case_id, count(*) AS links, count(*) FILTER (correlation_type='CORR-001') AS corr_001, count(*) FILTER (correlation_type='CORR-002') AS corr_002,
  count(*) FILTER (correlation_type='CORR-003') AS corr_003, count(*) FILTER (correlation_type='CORR-004') AS corr_004, count(*) FILTER (correlation_type='CORR-005') AS corr_005,
  count(*) FILTER (confidence<0.65) AS band_low, count(*) FILTER (confidence>=0.65 AND confidence<0.85) AS band_medium, count(*) FILTER (confidence>=0.85) AS band_high
  FROM typed WHERE correlation_type IS NOT NULL GROUP BY 1) l USING (case_id)""",
    "components": EV + COMPONENTS + "SELECT case_id, id, component FROM comp",
    "session_components": EV + COMPONENTS + "SELECT case_id, id, component FROM comp",
    "timeline": EV + TAGGED + entries(2, 500) + """
SELECT case_id, position, event_uid, CASE WHEN rule_seen THEN 'SUSPICIOUS' WHEN ml_seen OR is_anomalous THEN 'NOTABLE' ELSE 'NORMAL' END AS significance, context,
 (SELECT count(*) FROM fe WHERE fe.case_id=p.case_id AND fe.id=p.id) AS findings,
 coalesce((SELECT string_agg('COR-'||lpad(CAST(link_rank AS VARCHAR),6,'0'), ',' ORDER BY link_rank) FROM (SELECT link_rank FROM le WHERE le.case_id=p.case_id AND le.id=p.id ORDER BY link_rank LIMIT 3)),'') AS correlation_ids
FROM pos p""",
    "timeline_totals": EV + TAGGED + entries(2, 500) + """SELECT c.case_id, coalesce(t.total,0) AS total, coalesce(t.total,0)>500 AS truncated, 0::BIGINT AS undated_events
FROM (SELECT DISTINCT case_id FROM ev) c LEFT JOIN (SELECT case_id, count(*) AS total FROM ent GROUP BY 1) t USING (case_id)""",
    "context_events": EV + TAGGED + entries(20, 500) + "SELECT case_id, id, tagged, context FROM ent",
    "trace": EV + FINDINGS + """SELECT fe.case_id, finding_uid, e.event_uid, e.timestamp, e.evidence_id, e.id AS row_index, e.content,
 lower(e.evidence_id)||'.csv' AS original_filename FROM fe JOIN ev e ON e.id=fe.id""",
}

GROUPS = TAGGED + """
, edges AS MATERIALIZED (SELECT case_id, event_a_id AS x, event_b_id AS y FROM lk UNION SELECT case_id, event_b_id, event_a_id FROM lk)
, reach AS (SELECT case_id, x AS id, x AS r FROM edges UNION SELECT reach.case_id, edges.y, reach.r FROM reach JOIN edges ON reach.case_id=edges.case_id AND reach.id=edges.x)
, comp AS (SELECT case_id, id, min(r) AS component FROM reach GROUP BY case_id, id)
, gm AS (SELECT c.component, e.*, row_number() OVER (PARTITION BY c.case_id, c.component ORDER BY us, e.id) AS position FROM comp c JOIN evs e USING (case_id,id)
  QUALIFY row_number() OVER (PARTITION BY c.case_id, c.component ORDER BY us, e.id)<=200)
, gk AS (SELECT case_id, component, count(*) AS members, min(timestamp) AS time_start, max(timestamp) AS time_end, bool_or(is_anomalous) AS anomalous,
  array_to_string(list_sort(list_distinct(list(evidence_id))),',') AS evidence_ids,
  CASE WHEN count(DISTINCT source_type)=1 THEN min(source_type) ELSE 'cross_source' END AS kind FROM gm GROUP BY ALL)
, gs0 AS (SELECT gm.case_id, component, CASE kind WHEN 'process' THEN process WHEN 'file_activity' THEN host WHEN 'network' THEN destination_ip ELSE "user" END AS subject, count(*) AS c
  FROM gm JOIN gk USING (case_id, component) GROUP BY ALL)
, gs AS (SELECT * FROM gs0 QUALIFY row_number() OVER (PARTITION BY case_id, component ORDER BY c DESC, subject)=1)
, gl AS (SELECT a.case_id, a.component, count(*) AS link_count FROM lk JOIN gm a ON a.id=lk.event_a_id JOIN gm b ON b.id=lk.event_b_id AND a.component=b.component GROUP BY ALL)
, gw AS (SELECT gm.case_id, component, max(CASE f.severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END) AS w
  FROM gm JOIN fe ON fe.id=gm.id JOIN fnd f ON f.case_id=fe.case_id AND f.finding_uid=fe.finding_uid GROUP BY ALL)
, gt AS (SELECT gk.*, coalesce(link_count,0) AS link_count,
  CASE kind WHEN 'authentication' THEN 'Authentication cluster — ' WHEN 'process' THEN 'Process execution cluster — ' WHEN 'file_activity' THEN 'File activity burst — '
   WHEN 'network' THEN 'External connection cluster — ' ELSE 'Cross-source activity group — ' END || subject AS title,
  CASE WHEN w IS NOT NULL THEN ['Low','Medium','High','Critical'][w] WHEN anomalous THEN 'Medium' ELSE 'Low' END AS severity
  FROM gk JOIN gs USING (case_id, component) LEFT JOIN gl USING (case_id, component) LEFT JOIN gw USING (case_id, component))
, gr AS (SELECT *, 'GRP-'||lpad(CAST(row_number() OVER w AS VARCHAR),6,'0') AS group_uid FROM gt
  WINDOW w AS (PARTITION BY case_id ORDER BY time_start, members DESC, title, component) QUALIFY row_number() OVER w <= 50)
"""

GRAPH = TAGGED + """
, cn0 AS (SELECT case_id, evidence_id AS node_id, 'evidence' AS node_type, NULL::VARCHAR AS severity, NULL::VARCHAR AS significance, 0 AS layer, 0 AS o1, 0::BIGINT AS o2, evidence_id AS o3, NULL::BIGINT AS id FROM ev GROUP BY ALL
 UNION ALL SELECT case_id, finding_uid, 'finding', severity, NULL, 1, CASE kind WHEN 'rule' THEN 0 ELSE 1 END, 0, finding_uid, NULL FROM fnd
 UNION ALL SELECT case_id, event_uid, 'event', NULL, CASE WHEN rule_seen THEN 'SUSPICIOUS' WHEN ml_seen OR is_anomalous THEN 'NOTABLE' END, 2,
  CASE WHEN rule_seen THEN 0 WHEN ml_seen OR is_anomalous THEN 1 WHEN linked THEN 2 ELSE 3 END, us, lpad(CAST(id AS VARCHAR),20,'0'), id FROM marked)
, nd AS (SELECT *, row_number() OVER w AS node_rank FROM cn0 WINDOW w AS (PARTITION BY case_id ORDER BY layer,o1,o2,o3) QUALIFY row_number() OVER w <= 200)
, ed0 AS (SELECT fe.case_id, fe.finding_uid AS source, n.node_id AS target, 'triggered' AS relation, 0 AS part, f.node_rank AS o1, e.us AS o2, fe.id AS o3
   FROM fe JOIN nd n ON n.id=fe.id JOIN nd f ON f.case_id=fe.case_id AND f.node_id=fe.finding_uid JOIN ev e ON e.id=fe.id
 UNION ALL SELECT e.case_id, e.evidence_id, n.node_id, 'contains', 1, e.us, e.id, 0 FROM ev e JOIN nd n ON n.id=e.id JOIN nd v ON v.case_id=e.case_id AND v.node_id=e.evidence_id
 UNION ALL SELECT lk.case_id, a.node_id, b.node_id, 'correlated', 2, link_rank, 0, 0 FROM lk JOIN nd a ON a.id=event_a_id JOIN nd b ON b.id=event_b_id)
, ed AS (SELECT *, row_number() OVER w AS edge_rank FROM ed0 WINDOW w AS (PARTITION BY case_id ORDER BY part,o1,o2,o3) QUALIFY row_number() OVER w <= 500)
"""

ORACLES.update({
    "finding_index": EV + FINDINGS + """SELECT fe.case_id, e.event_uid, fe.finding_uid, fe.kind, f.rule_id, f.severity, 'New' AS status
FROM fe JOIN ev e ON e.id=fe.id JOIN fnd f ON f.case_id=fe.case_id AND f.finding_uid=fe.finding_uid""",
    "links_strong": EV + LINKS + """SELECT lk.case_id, 'COR-'||lpad(CAST(link_rank AS VARCHAR),6,'0') AS correlation_uid, a.event_uid AS event_a_uid, b.event_uid AS event_b_uid
FROM lk JOIN ev a ON a.id=event_a_id JOIN ev b ON b.id=event_b_id WHERE correlation_type='CORR-002' AND band='High'""",
    "timeline_notes": EV + TAGGED + entries(2, 500) + """SELECT case_id, CASE WHEN count(*)>500 THEN 'Showing the first 500 of '||count(*)||' entries (TIMELINE_MAX_ENTRIES).' END AS note FROM ent GROUP BY 1""",
    "model_diagnostics": EV + FINDINGS + """SELECT case_id, count(*) AS windows_total, count(*) FILTER (flagged) AS windows_flagged, 200 AS n_estimators, NULL::VARCHAR AS abstain_reason FROM gated GROUP BY 1""",
    "groups": EV + GROUPS + "SELECT case_id, group_uid, component, kind, title, severity, members, link_count, time_start, time_end, evidence_ids FROM gr",
    "group_members": EV + GROUPS + "SELECT gm.case_id, group_uid, position, event_uid FROM gm JOIN gr USING (case_id, component)",
    "graph_nodes": EV + GRAPH + "SELECT case_id, node_rank, node_id, node_type, severity, significance FROM nd",
    "graph_edges": EV + GRAPH + "SELECT case_id, edge_rank, source, target, relation FROM ed",
})


def _whole(sql: str) -> str:
    """The same tables without their caps."""
    for cap in ("<=10)", "<=10\n", "<=200)", "<= 50)", "<= 200)", "<= 500)"):
        sql = sql.replace(cap, cap.replace(cap.strip(")\n").split("=")[1].strip(), "9000000000000"))
    return sql


_FINDINGS = _whole(FINDINGS)
_RANKED = "row_number() OVER (PARTITION BY case_id ORDER BY {}) AS position, count(*) OVER (PARTITION BY case_id) AS total"
ORACLES.update({
    "findings_complete": _whole(ORACLES["findings"]),
    "finding_members_complete": _whole(ORACLES["finding_members"]),
    # Only the caps of groups, members, nodes, edges and entries go; the findings behind them are those of a run.
    "groups_complete": EV + GROUPS[:len(TAGGED)] + _whole(GROUPS[len(TAGGED):]) + "SELECT case_id, group_uid, component, kind, title, severity, members, link_count, time_start, time_end FROM gr",
    "group_members_complete": EV + GROUPS[:len(TAGGED)] + _whole(GROUPS[len(TAGGED):]) + "SELECT gm.case_id, group_uid, position, event_uid FROM gm JOIN gr USING (case_id, component)",
    "timeline_complete": ORACLES["timeline"].replace("<=500)", "<=9000000000000)"),
    "graph_nodes_complete": EV + GRAPH[:len(TAGGED)] + _whole(GRAPH[len(TAGGED):]) + "SELECT case_id, node_rank, node_id, node_type, severity, significance FROM nd",
    "graph_edges_complete": EV + GRAPH[:len(TAGGED)] + _whole(GRAPH[len(TAGGED):]) + "SELECT case_id, edge_rank, source, target, relation FROM ed",
    "event_pages": EV + f"SELECT * FROM (SELECT case_id, {_RANKED.format('timestamp DESC, id DESC')}, event_uid, timestamp FROM ev) WHERE position BETWEEN 51 AND 150",
    "finding_pages": EV + _FINDINGS + f"SELECT * FROM (SELECT case_id, {_RANKED.format('finding_uid DESC')}, finding_uid, severity FROM fnd WHERE kind='rule') WHERE position BETWEEN 6 AND 25",
    "link_pages": EV + LINKS + f"""SELECT * FROM (SELECT case_id, {_RANKED.format('link_rank')}, 'COR-'||lpad(CAST(link_rank AS VARCHAR),6,'0') AS correlation_uid, band
 FROM lk WHERE confidence>=0.5) WHERE position BETWEEN 11 AND 210""",
    "rule_catalogue": EV + _FINDINGS + """SELECT f.case_id, f.rule_id, f.findings, position, title, report_severity, TRUE AS enabled, settings
FROM (SELECT case_id, rule_id, count(*) AS findings FROM fnd WHERE kind='rule' GROUP BY ALL) f JOIN (VALUES
 (1,'AUTH-001','Repeated failed logins followed by a successful login','High',2), (2,'AUTH-002','Authentication events from an unusual external source IP','Medium',1),
 (3,'AUTH-003','Rapid login sequence from two distinct source addresses','Low',1), (4,'PROC-001','Scripting or interpreter process execution','Medium',1),
 (5,'FILE-001','Mass file modifications in a short window','Medium',3), (6,'FILE-002','Rapid file rename burst','High',2),
 (7,'NET-001','External connection shortly after process execution','Medium',2)) c(position, rule_id, title, report_severity, settings) USING (rule_id)""",
})
ORACLES["group_pages"] = ORACLES["groups_complete"].replace(
    "SELECT case_id, group_uid, component, kind, title, severity, members, link_count, time_start, time_end FROM gr",
    f"SELECT * FROM (SELECT case_id, {_RANKED.format('group_uid')}, group_uid, title FROM gr WHERE kind='cross_source') WHERE position BETWEEN 2 AND 51")
