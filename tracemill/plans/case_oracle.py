"""SQL equivalents of the case-work queries."""

from __future__ import annotations

from tracemill.plans.assistant import KEYWORDS, TRACE_WORDS
from tracemill.operators.hash_tree import FAN
from tracemill.operators.rules import TITLES
from tracemill.plans.ingest_queries import _CSV_COUNTS, CSV_SQL
from tracemill.plans.ingest_queries import ORACLES as INGEST
from tracemill.plans.oracle import EV, FINDINGS, GRAPH, GROUPS, ORACLES as BASE, windows
from tracemill.schema import FEATURE_NAMES
from tracemill import wording as W

TALK = """
, tk AS (SELECT conv_id, turn, role, text, conv_id*100+turn AS n, 'CASE-2024-'||lpad(CAST((conv_id+turn)%4+1 AS VARCHAR),3,'0') AS case_id,
  'RFND-'||lpad(CAST(conv_id*7%60+1 AS VARCHAR),6,'0') AS finding_uid FROM conversations)
"""

_OK = """(({c}='New' AND {t}='Under Review') OR ({c}='Under Review' AND {t} IN ('Confirmed','Dismissed')) OR ({c}='Confirmed' AND {t} IN ('Under Review','Dismissed'))
  OR ({c}='Dismissed' AND {t} IN ('Under Review','Confirmed')))"""

_FOLD = f"""
, ra AS (SELECT t.case_id, t.finding_uid, n AS seq, role, ['Under Review','Confirmed','Under Review','Dismissed','New'][(conv_id*3+turn*2)%5+1] AS to_status, f.kind IS NOT NULL AS known,
  row_number() OVER (PARTITION BY t.case_id, t.finding_uid ORDER BY n) AS rn FROM tk t LEFT JOIN fnd f USING (case_id, finding_uid))
, fold AS (SELECT ra.*, 'New' AS cur, known AND {_OK.format(c="'New'", t='to_status')} AS accepted FROM ra WHERE rn=1
  UNION ALL SELECT r.*, CASE WHEN f.accepted THEN f.to_status ELSE f.cur END,
   r.known AND {_OK.format(c="(CASE WHEN f.accepted THEN f.to_status ELSE f.cur END)", t='r.to_status')}
  FROM fold f JOIN ra r ON r.case_id=f.case_id AND r.finding_uid=f.finding_uid AND r.rn=f.rn+1)
"""

FOLD = EV + FINDINGS + TALK + _FOLD

_CUSTODY = """
 SELECT case_id, unnest(['Evidence Added','Hash Generated']) AS action, count(*) AS n FROM evd GROUP BY 1,2
 UNION ALL SELECT case_id, CASE result WHEN 'VERIFIED' THEN 'Integrity Verified' ELSE 'Integrity Mismatch' END, count(*) FROM ck GROUP BY 1,2
 UNION ALL SELECT case_id, unnest(['Analysis Started','Analysis Completed']), count(*) FROM cr GROUP BY 1,2
 UNION ALL SELECT case_id, unnest(['Automated Analysis Started','Automated Analysis Completed']), 1 FROM (SELECT DISTINCT case_id FROM ev)
 UNION ALL SELECT case_id, 'Investigator Reviewed', count(*) FROM fold WHERE accepted GROUP BY 1"""

_NOTES = r"""
, nt AS (SELECT case_id, n AS note_id, CASE n%6 WHEN 0 THEN NULL WHEN 1 THEN 'XX-1' WHEN 2 THEN 'RFND-999999' ELSE finding_uid END AS finding_uid,
  CASE WHEN role='system' THEN 'investigator' ELSE role END AS author,
  regexp_replace(CASE WHEN n%10=3 THEN '  ' WHEN n%10=4 THEN repeat(text,30) ELSE ' '||text||chr(10) END,'^[ \t\n\r]+|[ \t\n\r]+$','','g') AS body FROM tk)
, nr AS (SELECT nt.*, CASE WHEN body='' THEN 'Note body must not be empty.' WHEN length(body)>4000 THEN 'Note body exceeds the 4000 character limit.'
  WHEN finding_uid NOT LIKE 'RFND-%' THEN 'finding_uid must be a RFND- or MFND- finding identifier.'
  WHEN finding_uid IS NOT NULL AND f.kind IS NULL THEN 'Finding '||finding_uid||' does not exist in this case.' END AS reject_reason
  FROM nt LEFT JOIN fnd f USING (case_id, finding_uid))
"""
NOTES = EV + FINDINGS + TALK + _NOTES

_EVIDENCE = """
, evd AS (SELECT case_id, evidence_id, min(source_type) AS evidence_type, sum(length(content))::BIGINT AS file_size, count(*) AS record_count FROM ev GROUP BY ALL)
, ck AS (SELECT case_id, evidence_id, id, us, CASE WHEN id%101=0 AND case_id='CASE-2024-001' THEN 'MISMATCH' ELSE 'VERIFIED' END AS result FROM ev WHERE source_type IN ('authentication','process'))
, lc AS (SELECT case_id, evidence_id, count(*) AS checks, count(*) FILTER (result='VERIFIED') AS verified, count(*) FILTER (result='MISMATCH') AS mismatch, arg_max(result, (us,id)) AS latest FROM ck GROUP BY ALL)
, er AS (SELECT e.case_id, count(*) AS total, 0::BIGINT AS processed, count(*) FILTER (latest='VERIFIED') AS verified, count(*) FILTER (latest='MISMATCH') AS mismatch,
  count(*) FILTER (latest IS NULL) AS unverified, 0::BIGINT AS failed, sum(file_size)::BIGINT AS total_bytes, coalesce(sum(checks),0)::BIGINT AS checks, coalesce(sum(lc.mismatch),0) AS bad
  FROM evd e LEFT JOIN lc USING (case_id, evidence_id) GROUP BY 1)
, hl AS (SELECT case_id, total AS files, checks, CASE WHEN checks=0 THEN 'Unverified' WHEN bad>0 THEN 'Mismatch' WHEN verified<total THEN 'Partially verified' ELSE 'Verified' END AS integrity_status FROM er)
"""

_RANK = "CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END"
_REVIEW = f"""
, rs AS (SELECT case_id, count(*) AS total, count(*) FILTER (severity IN ('High','Critical')) AS high_severity, count(*) AS open_items,
  count(*) FILTER (kind='rule') AS rule_findings, count(*) FILTER (kind='ml') AS ml_findings FROM fnd GROUP BY 1)
, rq AS (SELECT case_id, row_number() OVER w AS position, finding_uid, severity FROM fnd WINDOW w AS (PARTITION BY case_id ORDER BY {_RANK} DESC, finding_uid) QUALIFY row_number() OVER w<=50)
"""
_CASES = """
, cs AS (SELECT case_id, CAST(right(case_id,3) AS INT) AS no FROM ev GROUP BY 1)
, cd AS (SELECT case_id, 'Investigation '||no AS title, CASE WHEN no%2=0 THEN 'Active' ELSE 'Under Review' END AS status, CASE WHEN no%3=0 THEN 'High' ELSE 'Medium' END AS severity FROM cs)
"""
_CSV_CTES = CSV_SQL[len("WITH "):]
_BOARD = EV + GROUPS + _EVIDENCE + _CASES + _REVIEW + TALK + _FOLD + ", " + _CSV_CTES.replace("ids AS", "ids0 AS").replace("FROM ids)", "FROM ids0)") + f""", cr AS ({_CSV_COUNTS}), cu AS ({_CUSTODY})"""

_CONTAINS = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)


def _intent() -> str:
    also = {"ML_EXPLANATION": r"regexp_matches(t, '\bml\b')", "CORRELATION_SUMMARY": "correlation_ref IS NOT NULL",
            "TIMELINE_CONTEXT": "time_ref IS NOT NULL"}
    arms = "".join(
        f" WHEN {_CONTAINS(words)}{' OR ' + also[name] if name in also else ''} THEN '{name}'" for name, words in KEYWORDS)
    return (f"CASE WHEN t='' THEN 'UNKNOWN' WHEN event_ref IS NOT NULL THEN 'TIMELINE_CONTEXT' WHEN finding_ref IS NOT NULL AND ({_CONTAINS(TRACE_WORDS)}) THEN 'FINDING_TRACE'"
            " WHEN finding_ref IS NOT NULL AND (contains(t,'evidence') OR contains(t,'support')) THEN 'EVIDENCE_SUPPORT' WHEN finding_ref IS NOT NULL THEN 'FINDING_EXPLANATION'"
            " WHEN contains(t,'why was') AND contains(t,'finding') THEN 'FINDING_EXPLANATION' WHEN contains(t,'evidence') AND contains(t,'support') THEN 'EVIDENCE_SUPPORT'"
            f"{arms} ELSE 'UNKNOWN' END")


_QUESTIONS = r"""
, q AS (SELECT case_id, n AS question_id, CASE n%16 WHEN 0 THEN text WHEN 1 THEN 'Why was '||lower(finding_uid)||' flagged?' WHEN 2 THEN 'Where does '||lower(finding_uid)||' come from? '||text
  WHEN 3 THEN 'Which evidence supports '||lower(finding_uid) WHEN 4 THEN 'what happened around 10:30' WHEN 5 THEN 'Show EVT-000'||lpad(CAST(n%900+1 AS VARCHAR),3,'0')
  WHEN 6 THEN 'Which host was involved in the same host links?' WHEN 7 THEN 'Explain COR-000001' WHEN 8 THEN 'list the activity groups' WHEN 9 THEN 'Did the ML abstain?'
  WHEN 10 THEN 'Is the evidence integrity verified?' WHEN 11 THEN 'processing status please' WHEN 12 THEN 'what needs review' WHEN 13 THEN 'give me an overview' WHEN 14 THEN 'what can you do' ELSE 'important findings' END AS question FROM tk)
, qt AS (SELECT *, trim(regexp_replace(lower(question),'\s+',' ','g')) AS t FROM q)
, qr AS (SELECT *, upper(nullif(regexp_extract(t,'\b(rfnd-\d{6}|mfnd-\d{6})\b',1),'')) AS finding_ref, upper(nullif(regexp_extract(t,'\b(evt-\d{5,7})\b',1),'')) AS event_ref,
  upper(nullif(regexp_extract(t,'\b(cor-\d{6})\b',1),'')) AS correlation_ref, nullif(regexp_extract(t,'\b(\d{1,2}:\d{2})\b',1),'') AS time_ref FROM qt)
"""

_LABELS = """
, fw10 AS (""" + windows(10) + """)
, lw AS (SELECT *, CASE WHEN case_id='CASE-2024-001' THEN 'benign'
  WHEN window_end <= CASE WHEN case_id='CASE-2024-002' THEN TIMESTAMP '2024-01-10 12:00:00' ELSE TIMESTAMP '2024-01-20 00:00:00' END THEN 'benign'
  WHEN case_id='CASE-2024-002' THEN 'compromise' ELSE 'ransomware_like' END AS label FROM fw10)
, lt AS (SELECT *, (src_authentication+src_process+src_file_activity+src_network+src_browser+src_system+src_generic+distinct_users+distinct_hosts+distinct_source_ips
  +distinct_destination_ips+distinct_processes+distinct_file_paths+distinct_evidence+distinct_event_types+high_severity_count+critical_severity_count+duplicate_count)::DOUBLE AS total FROM lw)
"""

_SUMMARY = """SELECT c.case_id, coalesce(e.n,0) AS evidence_files, coalesce(v.n,0) AS events, coalesce(r.total,0) AS findings, coalesce(r.high_severity,0) AS high_severity,
 coalesce(l.n,0) AS correlations, coalesce(g.n,0) AS activity_groups FROM cd c LEFT JOIN (SELECT case_id, count(*) AS n FROM evd GROUP BY 1) e USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) AS n FROM ev GROUP BY 1) v USING (case_id) LEFT JOIN rs r USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM lk GROUP BY 1) l USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) AS n FROM gr GROUP BY 1) g USING (case_id)"""

# All links of a case and all groups of them; the findings behind them are those of a run.
_ALL_GROUPS = GROUPS.replace("<=5000)", "<=9000000000000)").replace("<=5000\n", "<=9000000000000\n").replace("<= 50)", "<= 9000000000000)")

ORACLES = {
    "review_fold": FOLD + """SELECT case_id, finding_uid, seq, CASE WHEN known THEN cur END AS from_status, to_status, accepted,
 CASE WHEN NOT known THEN 'FINDING_NOT_FOUND' WHEN to_status=cur THEN 'FINDING_STATUS_UNCHANGED' WHEN NOT accepted THEN 'FINDING_STATUS_TRANSITION' END AS reject_code FROM fold""",
    "review_status": FOLD + """SELECT f.case_id, f.finding_uid, coalesce(arg_max(x.to_status, x.rn),'New') AS status FROM fnd f
 LEFT JOIN (SELECT * FROM fold WHERE accepted) x USING (case_id, finding_uid) GROUP BY ALL""",
    "notes_load": NOTES + "SELECT case_id, note_id, finding_uid, author, length(body)::INT AS length, reject_reason FROM nr",
    "notes_newest": NOTES + """SELECT case_id, row_number() OVER w AS position, note_id FROM nr WHERE reject_reason IS NULL
 WINDOW w AS (PARTITION BY case_id ORDER BY note_id DESC) QUALIFY row_number() OVER w<=20""",
    "custody_log": FOLD + _EVIDENCE + ", " + _CSV_CTES.replace("ids AS", "ids0 AS").replace("FROM ids)", "FROM ids0)") + f""", cr AS ({_CSV_COUNTS})
SELECT case_id, action, sum(n)::BIGINT AS entries FROM ({_CUSTODY}) GROUP BY 1,2""",
    "synthetic_cases": "SELECT DISTINCT 'CASE-2024-'||lpad(CAST(page_id%3+1 AS VARCHAR),3,'0') AS case_id FROM pages WHERE page_id%3=0",
    "corpus_match": EV + """SELECT case_id, arg_min(['A','B','C'][no%3+1], no%3) AS scenario FROM (SELECT DISTINCT case_id, CAST(right(evidence_id,4) AS INT) AS no FROM ev)
 WHERE case_id<>'CASE-2024-004' GROUP BY 1""",
    "evidence_append": EV + "SELECT DISTINCT case_id, evidence_id, CASE WHEN CAST(right(evidence_id,4) AS INT)%2=0 THEN 'conflict' ELSE 'append' END AS outcome FROM ev",
    "history_pins": EV + GROUPS + """, pin AS (SELECT e.case_id, e.evidence_id, count(DISTINCT link_rank) AS links FROM ev e JOIN le ON le.case_id=e.case_id AND le.id=e.id GROUP BY ALL)
SELECT case_id, evidence_id, CASE WHEN links IS NOT NULL THEN 'rebuild skipped: '||links||' preserved correlation link(s) reference these events (append-only history keeps the existing rows)'
 ELSE 'rebuild skipped: a preserved finding references these events (append-only history keeps the existing rows)' END AS reason
FROM (SELECT DISTINCT e.case_id, e.evidence_id FROM ev e JOIN (SELECT id FROM le UNION SELECT id FROM fe) x USING (id)) LEFT JOIN pin USING (case_id, evidence_id)""",
    "committed_events": EV + """, f AS (SELECT *, CAST(right(evidence_id,4) AS INT)%2=0 AND case_id<>'CASE-2024-003' AS again FROM ev)
SELECT case_id, evidence_id, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS runs, (CASE WHEN again THEN 2 ELSE 1 END*n)::BIGINT AS "rows",
 CASE WHEN NOT again THEN 'first' WHEN critical>0 THEN 'second' END AS "commit", CASE WHEN NOT again THEN n WHEN critical>0 THEN critical END AS events,
 CASE WHEN NOT again THEN all_ids ELSE critical_ids END::BIGINT AS ids
FROM (SELECT case_id, evidence_id, again, count(*) AS n, sum(id) AS all_ids, count(*) FILTER (severity='Critical') AS critical, sum(id) FILTER (severity='Critical') AS critical_ids FROM f GROUP BY ALL)""",
    "latest_checks": EV + _EVIDENCE + "SELECT * FROM lc",
    "integrity_headline": EV + _EVIDENCE + "SELECT * FROM hl",
    "evidence_rollup": EV + _EVIDENCE + "SELECT case_id, total, processed, verified, mismatch, unverified, failed, total_bytes FROM er",
    "review_queue": EV + FINDINGS + _REVIEW + "SELECT * FROM rq",
    "review_summary": EV + FINDINGS + _REVIEW + "SELECT * FROM rs",
    "finding_breakdown": EV + FINDINGS + """, v AS (SELECT 'severity' AS breakdown, unnest(['Low','Medium','High','Critical']) AS value, unnest([0,1,2,3]) AS position
 UNION ALL SELECT 'status', unnest(['New','Under Review','Confirmed','Dismissed']), unnest([0,1,2,3]) UNION ALL SELECT 'kind', unnest(['rule','ml']), unnest([0,1]))
SELECT v.*, (SELECT count(*) FROM fnd WHERE CASE breakdown WHEN 'severity' THEN severity WHEN 'status' THEN 'New' ELSE kind END = value) AS n FROM v""",
    "case_headers": EV + FINDINGS + _EVIDENCE + _CASES + """SELECT cd.*, (SELECT count(*) FROM evd WHERE evd.case_id=cd.case_id) AS evidence_count,
 (SELECT count(*) FROM fnd WHERE fnd.case_id=cd.case_id) AS finding_count FROM cd""",
    "status_breakdown": _BOARD + """, w AS (SELECT 'analysis_runs' AS breakdown, unnest(['Pending','Running','Completed','Failed']) AS value, unnest([0,1,2,3]) AS position
 UNION ALL SELECT 'correlation_runs', unnest(['Pending','Running','Completed','Failed']), unnest([0,1,2,3])
 UNION ALL SELECT 'processing_runs', unnest(['Pending','Processing','Completed','Partial','Failed']), unnest([0,1,2,3,4]) UNION ALL SELECT 'integrity', unnest(['VERIFIED','MISMATCH']), unnest([0,1]))
, x AS (SELECT 'analysis_runs' AS breakdown, 'Completed' AS value, count(DISTINCT case_id) AS n FROM ev UNION ALL SELECT 'correlation_runs', 'Completed', count(DISTINCT case_id) FROM ev
 UNION ALL SELECT 'processing_runs', CASE WHEN altered THEN 'Failed' WHEN ok<n THEN 'Partial' ELSE 'Completed' END, count(*) FROM cr GROUP BY 2 UNION ALL SELECT 'integrity', result, count(*) FROM ck GROUP BY 2)
SELECT breakdown, value, position, coalesce(x.n,0) AS n FROM w LEFT JOIN x USING (breakdown, value)
UNION ALL SELECT 'custody', action, NULL, sum(n)::BIGINT FROM cu GROUP BY action""",
    "dashboard_totals": _BOARD + _NOTES + """, m AS (SELECT sum(CASE WHEN altered THEN 0 ELSE n END)::BIGINT AS received, sum(CASE WHEN altered THEN 0 ELSE ok END)::BIGINT AS kept,
 sum(CASE WHEN altered THEN 0 ELSE n-ok END)::BIGINT AS rejected, sum(copies)::BIGINT AS copies FROM cr)
""" + " UNION ALL ".join(f"SELECT '{metric}' AS metric, ({value}) AS value" for metric, value in {
        "cases": "SELECT count(DISTINCT case_id) FROM ev", "evidence": "SELECT count(*) FROM evd", "raw_records": "SELECT count(*) FROM ev",
        "forensic_events": "SELECT count(*) FROM ev", "processing_runs": "SELECT count(*) FROM cr", "analysis_runs": "SELECT count(DISTINCT case_id) FROM ev",
        "correlation_runs": "SELECT count(DISTINCT case_id) FROM ev", "correlations": "SELECT count(*) FROM lk", "investigation_groups": "SELECT count(*) FROM gr",
        "integrity_checks": "SELECT count(*) FROM ck", "custody_events": "SELECT sum(n)::BIGINT FROM cu", "rule_findings": "SELECT count(*) FROM fnd WHERE kind='rule'",
        "ml_findings": "SELECT count(*) FROM fnd WHERE kind='ml'", "assistant_queries": "SELECT count(*) FROM tk", "investigation_reports": "SELECT count(DISTINCT case_id) FROM ev",
        "investigator_notes": "SELECT count(*) FROM nr WHERE reject_reason IS NULL", "records_received": "SELECT received FROM m",
        "records_normalized": "SELECT kept FROM m", "records_rejected": "SELECT rejected FROM m", "duplicates_detected": "SELECT copies FROM m"}.items()),
    "totals": EV + GROUPS + _EVIDENCE + """SELECT 'cases' AS metric, (SELECT count(DISTINCT case_id) FROM ev) AS value UNION ALL SELECT 'evidence', (SELECT count(*) FROM evd)
 UNION ALL SELECT 'events', (SELECT count(*) FROM ev) UNION ALL SELECT 'findings', (SELECT count(*) FROM fnd) UNION ALL SELECT 'finding_events', (SELECT count(*) FROM fe)
 UNION ALL SELECT 'links', (SELECT count(*) FROM lk) UNION ALL SELECT 'groups', (SELECT count(*) FROM gr) UNION ALL SELECT 'integrity_checks', (SELECT count(*) FROM ck)
 UNION ALL SELECT 'notes', (SELECT count(*) FROM conversations) UNION ALL SELECT 'runs', (SELECT count(DISTINCT event_id//500) FROM events)""",
    "kpis": _BOARD + """
SELECT cd.*, (SELECT count(*) FROM evd x WHERE x.case_id=cd.case_id) AS evidence_count, (SELECT count(*) FROM evs x WHERE x.case_id=cd.case_id) AS event_count,
 (SELECT count(*) FROM evs x WHERE x.case_id=cd.case_id AND is_anomalous) AS anomalous_event_count, (SELECT count(*) FROM cr x WHERE x.case_id=cd.case_id) AS processing_runs,
 (SELECT coalesce(sum(ok),0)::BIGINT FROM cr x WHERE x.case_id=cd.case_id AND NOT altered) AS records_normalized, (SELECT coalesce(sum(n-ok),0)::BIGINT FROM cr x WHERE x.case_id=cd.case_id AND NOT altered) AS records_rejected,
 rs.rule_findings, rs.ml_findings, 0::BIGINT AS confirmed_findings, (SELECT count(*) FROM lk x WHERE x.case_id=cd.case_id) AS correlations, (SELECT count(*) FROM gr x WHERE x.case_id=cd.case_id) AS activity_groups,
 (SELECT count(*) FROM ck x WHERE x.case_id=cd.case_id) AS integrity_checks, (SELECT count(*) FROM ck x WHERE x.case_id=cd.case_id AND result='VERIFIED') AS integrity_verified,
 (SELECT count(*) FROM ck x WHERE x.case_id=cd.case_id AND result='MISMATCH') AS integrity_mismatch, (SELECT sum(n)::BIGINT FROM cu x WHERE x.case_id=cd.case_id) AS custody_events,
 (SELECT count(*) FROM tk x WHERE x.case_id=cd.case_id) AS assistant_queries, 1::BIGINT AS reports FROM cd LEFT JOIN rs USING (case_id)""",
    "ml_rollup": EV + FINDINGS + "SELECT count(DISTINCT case_id) AS completed_runs, count(*) AS windows_total, count(*) FILTER (flagged) AS windows_flagged, 0::BIGINT AS abstained_runs FROM gated",
    "run_resolution": EV + """, r AS (SELECT case_id, strftime(timestamp,'%Y%m%d') AS run_uid, count(*) AS n FROM ev GROUP BY ALL)
SELECT case_id, run_uid, n, CASE WHEN n%2=1 THEN 'Failed' ELSE 'Completed' END AS status FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n%2, run_uid DESC)=1""",
    "intent_classify": "WITH " + TALK.strip().lstrip(",") + _QUESTIONS + f"SELECT question_id, {_intent()} AS intent, finding_ref, event_ref, correlation_ref, time_ref FROM qr",
    "answer_confidence": EV + GROUPS + TALK + _QUESTIONS + f""", qi AS (SELECT *, {_intent()} AS intent FROM qr)
SELECT intent, CASE WHEN intent='UNKNOWN' THEN 'LOW' WHEN intent IN ('FINDING_EXPLANATION','FINDING_TRACE','EVIDENCE_SUPPORT') AND finding_ref IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fnd f WHERE f.case_id=qi.case_id AND f.finding_uid=qi.finding_ref) THEN 'LOW'
  WHEN intent='CORRELATION_SUMMARY' AND case_id NOT IN (SELECT case_id FROM lk) THEN 'LOW' WHEN intent='GROUP_SUMMARY' AND case_id NOT IN (SELECT case_id FROM gr) THEN 'LOW'
  WHEN intent='PROCESSING_STATUS' AND case_id NOT IN (SELECT 'CASE-2024-'||lpad(CAST(event_id//500%4+1 AS VARCHAR),3,'0') FROM events) THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, count(*) AS questions FROM qi GROUP BY ALL""",
    "answer_history": "WITH " + TALK.strip().lstrip(",") + _QUESTIONS + f"""SELECT case_id, row_number() OVER w AS position, question_id, {_intent()} AS intent FROM qr
 WINDOW w AS (PARTITION BY case_id ORDER BY question_id DESC) QUALIFY row_number() OVER w<=10""",
    "report_summary": EV + _ALL_GROUPS + _EVIDENCE + _CASES + _REVIEW + f""", sm AS ({_SUMMARY})
SELECT *, evidence_files||' evidence file(s) yielded '||events||' normalized event(s), '||findings||' finding(s) ('||high_severity||' high severity), '||correlations||' correlation(s) and '||activity_groups||' activity group(s).' AS summary FROM sm""",
    "report_conclusion": EV + GROUPS + _EVIDENCE + _CASES + _REVIEW + f""", sm AS ({_SUMMARY})
SELECT case_id, CASE WHEN findings=0 THEN '{W.CONCLUSION_NO_FINDINGS}' WHEN correlations>0 THEN '{W.CONCLUSION_WITH_CORRELATION}' ELSE '{W.CONCLUSION_NO_CORRELATION}' END AS statement,
 CASE WHEN high_severity>0 THEN '{W.HIGH_SEVERITY_NOTE}' ELSE '' END AS notes FROM sm""",
    "report_integrity": EV + _EVIDENCE + """SELECT case_id, CASE WHEN unverified=total THEN 'NO CHECK AVAILABLE' WHEN mismatch>0 THEN 'INTEGRITY MISMATCH' WHEN verified=total THEN 'INTEGRITY VERIFIED' ELSE 'NOT VERIFIED' END AS status,
 total AS checked_items, verified AS verified_items, mismatch AS mismatch_items, unverified AS unverified_items FROM er""",
    "report_trace": EV + FINDINGS + """, t50 AS (SELECT case_id, finding_uid FROM fnd QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY finding_uid DESC)<=50)
SELECT t.case_id, count(*) OVER (PARTITION BY t.case_id) AS traced_findings, t.finding_uid, least(200,(SELECT count(*) FROM fe WHERE fe.case_id=t.case_id AND fe.finding_uid=t.finding_uid))::INT AS linked_events FROM t50 t""",
    "report_items": EV + FINDINGS + _EVIDENCE + TALK + _NOTES + """
SELECT case_id, 'evidence_inventory' AS section, evidence_id AS item_key, json_object('original_filename', lower(evidence_id)||'.csv', 'evidence_type', evidence_type,
  'file_size', file_size, 'sha256', sha256(case_id||'|'||evidence_id), 'record_count', record_count, 'status', 'Analyzed')::VARCHAR AS item FROM evd
 UNION ALL SELECT e.case_id, 'evidence_integrity', e.evidence_id, json_object('original_filename', lower(e.evidence_id)||'.csv', 'result',
  CASE WHEN latest='VERIFIED' THEN 'INTEGRITY VERIFIED' WHEN latest IS NOT NULL THEN 'INTEGRITY MISMATCH' ELSE 'NOT VERIFIED' END)::VARCHAR
  FROM evd e LEFT JOIN lc USING (case_id, evidence_id)
 UNION ALL SELECT fe.case_id, 'traceability', fe.finding_uid||'/'||e.event_uid, json_object('row_index', e.id, 'content', e.content, 'evidence_id', e.evidence_id,
  'original_filename', lower(e.evidence_id)||'.csv', 'sha256', sha256(e.case_id||'|'||e.evidence_id))::VARCHAR FROM fe JOIN ev e ON e.id=fe.id
 UNION ALL SELECT case_id, 'review', note_id::VARCHAR, json_object('finding_uid', finding_uid, 'author', author, 'body', body)::VARCHAR FROM nr WHERE reject_reason IS NULL""",
    "report_graph": EV + GRAPH + """SELECT n.case_id, (SELECT count(*) FROM cn0 WHERE cn0.case_id=n.case_id)>200 OR (SELECT count(*) FROM ed0 WHERE ed0.case_id=n.case_id)>500 AS truncated,
 count(*) FILTER (node_type='evidence') AS node_type_evidence, count(*) FILTER (node_type='finding') AS node_type_finding, count(*) FILTER (node_type='event') AS node_type_event,
 (SELECT count(*) FROM ed WHERE ed.case_id=n.case_id AND relation='contains') AS relation_contains, (SELECT count(*) FROM ed WHERE ed.case_id=n.case_id AND relation='triggered') AS relation_triggered,
 (SELECT count(*) FROM ed WHERE ed.case_id=n.case_id AND relation='correlated') AS relation_correlated FROM nd n GROUP BY n.case_id""",
    "workspace": EV + GROUPS + _EVIDENCE + _CASES + _REVIEW + ", " + _CSV_CTES.replace("ids AS", "ids0 AS").replace("FROM ids)", "FROM ids0)") + f""", cr AS ({_CSV_COUNTS}), sm AS ({_SUMMARY})
SELECT cd.case_id, (SELECT CASE WHEN count(*)=0 THEN 'Not processed' WHEN bool_or(altered) THEN 'Failed' WHEN bool_or(ok<n) THEN 'Partial' ELSE 'Completed' END FROM cr WHERE cr.case_id=cd.case_id) AS processing_status,
 integrity_status, evidence_files AS evidence_count, events AS event_count, (SELECT count(*) FROM evs x WHERE x.case_id=cd.case_id AND is_anomalous) AS anomalous_event_count, findings AS finding_count,
 sm.high_severity, open_items, correlations AS correlation_count, activity_groups AS activity_group_count, er.verified, er.mismatch, er.unverified, er.total_bytes,
 (SELECT finding_uid FROM rq WHERE rq.case_id=cd.case_id AND position=1) AS next_review, least(100,correlations)::INT AS links_shown
FROM cd JOIN sm USING (case_id) JOIN hl USING (case_id) JOIN er USING (case_id) JOIN rs USING (case_id)""",
    "segment_labels": EV + _LABELS + "SELECT case_id, label, count(*) AS windows FROM lw GROUP BY ALL",
    "segment_features": EV + _LABELS + "SELECT case_id, window_start, " + ", ".join([
        *[f'{c}::DOUBLE AS "count:{c}", round({c}/total,6) AS "share:{c}"' for c in FEATURE_NAMES],
        *[f"{c}::DOUBLE AS {c}" for c in ("distinct_users", "distinct_hosts", "distinct_source_ips", "distinct_file_paths",
                                          "distinct_processes", "duplicate_count")],
        *[f"round(src_{c}/total,6) AS share_{c}" for c in ("file_activity", "network", "authentication", "process")],
        "CASE WHEN distinct_hosts>0 THEN round(distinct_users/distinct_hosts,6) ELSE 0.0::DOUBLE END AS users_per_host",
        "round(total/greatest(1,distinct_hosts),6) AS events_per_host",
        "(high_severity_count+critical_severity_count)::DOUBLE AS high_or_critical_count", "total AS total_events"]) + " FROM lt",
    "segment_guard": EV + _LABELS + """, g AS (SELECT count(*) AS windows, count(*) FILTER (label='benign') AS benign, count(*) FILTER (label='compromise') AS compromise, count(*) FILTER (label='ransomware_like') AS ransomware_like FROM lw)
SELECT *, NULL::VARCHAR AS abstained_reason, false AS abstained, round(greatest(benign,compromise,ransomware_like)/windows,6) AS baseline_accuracy FROM g""",
    "segment_split": EV + _LABELS + """, c AS (SELECT label, count(*) AS n FROM lw GROUP BY 1)
SELECT label, part, CASE WHEN n%4>part THEN n//4+1 ELSE n//4 END AS windows FROM c, (SELECT unnest([0,1,2,3]) AS part)""",
}


def _item(query: str, section: str, key: str, /, **fields: str) -> str:
    made = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"SELECT case_id, '{section}' AS section, {key} AS item_key, json_object({made})::VARCHAR AS item FROM ({query})"


def _same(*names: str) -> dict[str, str]:
    return {c: c for c in names}


def _second(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_TITLE = "CASE rule_id" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + (
    " ELSE 'Anomalous activity window '||strftime(timestamp_start,'%H:%M')||'–'||strftime(timestamp_end,'%H:%M') END")
_LINK_ENDS = f"""SELECT l.*, a.event_uid AS event_a_uid, b.event_uid AS event_b_uid FROM ({BASE["links"]}) l
 JOIN ({EV}SELECT id, event_uid FROM ev) a ON a.id=event_a_id JOIN ({EV}SELECT id, event_uid FROM ev) b ON b.id=event_b_id"""
_LISTS = [
    _item(INGEST["ingest_csv_runs"], "processing", "evidence_id", **_same("parser", "status", "records_received", "records_parsed",
          "records_normalized", "records_rejected", "duplicates_detected")),
    _item(BASE["findings"], "key_findings", "finding_uid", **_same("kind", "rule_id"), title=_TITLE, severity="severity", status="'New'",
          confidence="CASE WHEN kind='ml' THEN NULL ELSE CASE severity WHEN 'Low' THEN 0.4 WHEN 'Medium' THEN 0.6 WHEN 'High' THEN 0.8 ELSE 0.95 END END::DOUBLE",
          css="css", event_count="event_count", evidence_count="distinct_evidence", first_seen=_second("timestamp_start"), last_seen=_second("timestamp_end")),
    _item(_LINK_ENDS, "correlations", "correlation_uid", **_same("correlation_type", "event_a_uid", "event_b_uid", "time_delta_seconds",
          "confidence", "band", "evidence_ids")),
    _item(BASE["groups_complete"], "activity_groups", "group_uid", **_same("kind", "title", "severity"), event_count="members",
          correlation_count="link_count", first_seen=_second("time_start"), last_seen=_second("time_end")),
    _item(BASE["timeline_complete"], "timeline", "position::VARCHAR", **_same("event_uid", "significance", "context", "findings")),
    _item(BASE["graph_edges_complete"], "graph", "edge_rank::VARCHAR", **_same("source", "relation", "target")),
]
ORACLES["report_lists"] = " UNION ALL ".join(f"({part})" for part in _LISTS)


def _seals() -> str:
    """Digests by levels of one group per FAN nodes; five levels hold FAN**5 items a case."""
    own = "||".join(f"coalesce(length({c})||':'||{c}, '-')" for c in ("section", "item_key", "item"))
    steps = f"""WITH it AS MATERIALIZED (({ORACLES["report_items"]}) UNION ALL ({ORACLES["report_lists"]}))
, n0 AS (SELECT case_id, count(*) OVER (PARTITION BY case_id) AS total, row_number() OVER (PARTITION BY case_id ORDER BY section, item_key, hash)-1 AS p, hash
  FROM (SELECT *, sha256({own}) AS hash FROM it))"""
    for level in range(1, 6):
        steps += f"""
, n{level} AS (SELECT case_id, total, p//{FAN} AS p, sha256(string_agg(hash, '' ORDER BY p)) AS hash FROM n{level - 1}
  {f"WHERE total>{FAN ** (level - 1)}" if level > 1 else ""} GROUP BY case_id, total, p//{FAN})"""
    tops = " UNION ALL ".join(f"SELECT case_id, total, hash FROM n{level} WHERE total<={FAN ** level}" for level in range(1, 6))
    return steps + f"""
, sl AS (SELECT c.case_id, 'RPT-000001' AS report_uid, coalesce(total,0) AS items, coalesce(hash, sha256('')) AS digest
  FROM ({EV}SELECT DISTINCT case_id FROM ev) c LEFT JOIN ({tops}) t USING (case_id))
"""


ORACLES["report_seals"] = _seals() + "SELECT * FROM sl"
ORACLES["report_seal_check"] = _seals() + """, lost AS (SELECT count(*) AS n FROM it WHERE case_id='CASE-2024-001' AND section='review')
SELECT case_id, report_uid, items, items-CASE WHEN case_id='CASE-2024-001' THEN n ELSE 0 END AS found,
 NOT (case_id='CASE-2024-001' AND n>0) AND NOT (case_id='CASE-2024-002' AND EXISTS (SELECT 1 FROM it WHERE it.case_id='CASE-2024-002' AND section='key_findings')) AS intact FROM sl, lost"""
