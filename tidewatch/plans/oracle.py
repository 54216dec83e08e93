"""The same results as ``queries.py`` in plain SQL for DuckDB.

``CTE`` holds the shared steps in dependency order; ``ORACLE`` one statement per
query.  The texts are written independently of the Spark operators.
"""

from __future__ import annotations

from tidewatch import dims, texts


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _map(col: str, mapping: dict, default: str) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    whens = " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


def _has(col: str, values) -> str:
    return "(" + " OR ".join(f"contains({col}, '{v}')" for v in values) + ")"


_BYPASS = "powershell.exe -ExecutionPolicy Bypass -WindowStyle Hidden -EncodedCommand QQ=="
_MIB = 1048576
_HOURS_S = {k: v[0] for k, v in dims.WORK_HOURS.items()}
_HOURS_E = {k: v[1] for k, v in dims.WORK_HOURS.items()}

CTE: list[tuple[str, str]] = []


def cte(name: str, sql: str) -> None:
    CTE.append((name, sql))


cte("raw", "SELECT event_id, ts, user_id, value, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
cte("typed", """SELECT *, CASE kind
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'Login' ELSE 'VPNConnect' END
    WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'ResourceAccess' WHEN 1 THEN 'DatabaseQuery' ELSE 'ApiCall' END
    WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 'FileWrite' ELSE 'FileRead' END
    WHEN 'purchase' THEN CASE WHEN k % 2 = 1 THEN 'FileUpload' ELSE 'FileDownload' END
    ELSE CASE WHEN k % 2 = 0 THEN 'Login' ELSE 'ProcessStart' END END AS event_type,
  CASE WHEN kind = 'error' AND k % 2 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM raw""")
cte("filled", f"""SELECT event_id, ts, printf('EMP-%04d', user_id) AS employee_id, user_id, event_type, status,
  CASE WHEN event_type NOT IN ('Login', 'VPNConnect', 'ProcessStart') THEN {_list(dims.RESOURCES)}[k % 24 + 1] END AS resource,
  CASE WHEN event_type IN ('FileUpload', 'FileDownload') THEN value * {_MIB} ELSE 0::DOUBLE END AS bytes_transferred,
  CASE WHEN event_type = 'FileWrite' THEN value * 1024 ELSE 0::DOUBLE END AS bytes_written,
  'DEV-' || (user_id * 3 + k % 3) AS device_id, '10.10.' || (user_id % 256) || '.' || k AS ip_address,
  'Office-' || ((user_id + CASE WHEN k >= 90 THEN 1 ELSE 0 END) % 5) AS geo_location,
  CASE WHEN event_type = 'ProcessStart' THEN CASE k % 10 WHEN 1 THEN '{_BYPASS}'
    WHEN 3 THEN 'run ' || {_list(dims.MALWARE_NAMES)}[k % 6 + 1]
    WHEN 5 THEN 'curl http://' || {_list(dims.C2_DOMAINS)}[k % 4 + 1] || '/beat' ELSE 'bash' END END AS command_line,
  CASE WHEN event_type = 'ProcessStart' THEN 'shell' END AS process_name,
  CASE WHEN event_type = 'ApiCall' AND k % 7 = 0 THEN {_list(dims.C2_DOMAINS)}[k % 4 + 1]
       WHEN event_type = 'ApiCall' THEN 'svc-' || (k % 5) || '.internal' END AS destination_domain,
  CASE WHEN k % 5 = 0 THEN 'VPN - MFA' ELSE 'Password' END AS auth_method, k, value FROM typed""")
cte("ev", f"""SELECT *, CASE WHEN command_line IS NOT NULL AND k < 50 THEN command_line ELSE '' END AS seq,
  CASE WHEN event_type = 'ProcessStart' AND k % 10 = 1 THEN 'Suspicious PowerShell'
       WHEN event_type = 'ProcessStart' AND k % 10 = 3 THEN 'Malware Execution'
       WHEN event_type = 'ProcessStart' AND k % 10 = 5 THEN 'Beaconing C2'
       WHEN event_type = 'FileUpload' AND bytes_transferred > {100 * _MIB} THEN 'Data Exfiltration'
       WHEN event_type = 'Login' AND status = 'FAILED' AND k < 10 THEN 'Brute Force'
       WHEN event_type = 'ResourceAccess' AND k >= 90 THEN 'Privilege Escalation'
       WHEN event_type = 'DatabaseQuery' AND k >= 95 THEN 'Lateral Movement' ELSE 'None' END AS attack_type FROM filled""")
cte("emp0", f"""SELECT c_custkey AS employee_no, printf('EMP-%04d', c_custkey) AS employee_id, 'U-' || md5(CAST(c_custkey AS VARCHAR)) AS employee_uuid,
  CASE WHEN c_custkey % 11 = 0 THEN 'Marketing' ELSE CASE c_mktsegment WHEN 'MACHINERY' THEN 'Engineering' WHEN 'FURNITURE' THEN 'Sales'
    WHEN 'BUILDING' THEN 'IT' WHEN 'AUTOMOBILE' THEN 'Finance' ELSE 'HR' END END AS department,
  ['Analyst', 'Team Manager', 'Director', 'Specialist'][c_custkey % 4 + 1] AS role, 'Office-' || (c_nationkey % 5) AS office_location,
  {_list(dims.OPERATING_SYSTEMS)}[c_custkey % 5 + 1] AS preferred_os, {_list(dims.BROWSERS)}[c_custkey % 4 + 1] AS preferred_browser,
  CASE WHEN c_custkey % 7 = 0 THEN ['DEV-' || (c_custkey * 3), 'DEV-' || (c_custkey * 3 + 1)]
       ELSE ['DEV-' || (c_custkey * 3), 'DEV-' || (c_custkey * 3 + 1), 'DEV-' || (c_custkey * 3 + 2)] END AS allowed_devices FROM customer""")
cte("emp", f"""SELECT *, CASE WHEN employee_no % 17 = 0 THEN 22 ELSE CAST({_map('department', _HOURS_S, 'NULL')} AS INTEGER) END AS work_start,
  CASE WHEN employee_no % 17 = 0 THEN 6 ELSE CAST({_map('department', _HOURS_E, 'NULL')} AS INTEGER) END AS work_end FROM emp0""")
cte("dev", f"""SELECT device_id, employee_id AS owner_id, {_list(dims.DEVICE_TYPES)}[n % 3 + 1] AS device_type, n % 9 <> 0 AS trusted
  FROM (SELECT DISTINCT device_id, employee_id, CAST(regexp_extract(device_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM ev)""")
cte("res", "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{t}', '{s}', {_list(dd)})" for r, (t, s, dd) in dims.RESOURCE_DIM.items())
    + ") AS t(resource_name, resource_type, sensitivity_level, allowed_departments)")


def _sessions(source: str, keys: str, gap: int, out: str) -> None:
    cte(f"{out}_o", f"""SELECT *, row_number() OVER w - 1 AS pos, lag(ts) OVER w AS prev FROM {source}
      WINDOW w AS (PARTITION BY {keys} ORDER BY ts, event_id)""")
    cte(f"{out}_n", f"""SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {gap}000000 THEN 1 ELSE 0 END AS is_new FROM {out}_o""")
    ident = " || '-' || ".join(k.strip() for k in keys.split(","))
    cte(out, f"""SELECT *, {ident} || '-S' || session_no AS session_id, CASE WHEN is_new = 0 THEN (epoch_us(ts) - epoch_us(prev)) / 1e6 END AS gap
      FROM (SELECT *, CAST(sum(is_new) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS BIGINT) AS session_no FROM {out}_n)""")


_sessions("ev", "employee_id", 21600, "se")
_cmd = "lower(CASE WHEN seq <> '' THEN seq ELSE coalesce(command_line, '') END)"
_proc = "lower(CASE WHEN seq <> '' THEN seq ELSE coalesce(process_name, '') END)"
_dest = "lower(destination_domain)"
cte("sx", f"""SELECT *, {_cmd} AS cmd, {_proc} AS proc, (event_type = 'ProcessStart' OR seq <> '') AND {_cmd} <> '' AS runs,
  {' + '.join(f"CAST(contains(lower(seq), '{x}') AS INTEGER)" for x in dims.C2_DOMAINS)} + CASE WHEN {_dest} IN {_in(dims.C2_DOMAINS)} THEN 1 ELSE 0 END AS hits,
  {_has(_cmd, dims.MALWARE_NAMES)} OR {_has(_proc, dims.MALWARE_NAMES)} AS mal, pos - min(pos) OVER (PARTITION BY session_id) AS idx FROM se""")


def _cf(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond})::DOUBLE AS {name}"


_ORD = "list_position(" + _list(dims.EVENT_TYPES) + ", event_type) - 1"
_ADM = _in(dims.ADMIN_RESOURCES)
cte("agg", f"""SELECT session_id, arg_min(employee_id, pos) AS employee_id, arg_min(device_id, pos) AS device_id, arg_min(geo_location, pos) AS office_location,
  arg_min(auth_method, pos) AS auth, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_events, bool_or(attack_type <> 'None') AS is_anomalous,
  coalesce(arg_max(attack_type, pos) FILTER (WHERE attack_type <> 'None'), 'None') AS attack_type,
  {_cf("event_type = 'Login' AND status = 'FAILED'", "failed_login_count")}, {_cf("event_type = 'Login' AND status = 'SUCCESS'", "successful_login_count")},
  {_cf("resource IS NOT NULL", "total_resource_accesses")}, count(DISTINCT resource)::DOUBLE AS unique_resources,
  {_cf(f"resource IN {_ADM}", "admin_resource_accesses")}, {_cf(f"resource IN {_in(dims.SENSITIVE_RESOURCES)}", "sensitive_resource_accesses")},
  {_cf("resource = 'GitHub'", "github_access_count")}, {_cf("event_type = 'DatabaseQuery'", "database_query_count")},
  {_cf("resource = 'Confluence'", "confluence_access_count")}, {_cf("resource = 'HRMS'", "hrms_access_count")}, {_cf("resource = 'ERP'", "erp_access_count")},
  {_cf("event_type = 'FileRead'", "files_read")}, {_cf("event_type = 'FileWrite'", "files_written")}, {_cf("event_type = 'FileUpload'", "files_uploaded")},
  {_cf("event_type = 'FileDownload'", "files_downloaded")},
  sum(CASE event_type WHEN 'FileUpload' THEN bytes_transferred WHEN 'FileWrite' THEN bytes_written ELSE 0 END) AS total_upload_bytes,
  sum(CASE WHEN event_type = 'FileDownload' THEN bytes_transferred ELSE 0 END) AS total_download_bytes,
  {_cf("event_type = 'ProcessStart'", "processes_started")}, {_cf("event_type = 'ProcessStop'", "processes_stopped")},
  {_cf("runs AND (contains(cmd, 'powershell') OR contains(proc, 'powershell'))", "powershell_executions")},
  {_cf(f"runs AND (mal OR {_has('cmd', dims.SUSPICIOUS_FLAGS)})", "suspicious_process_count")}, {_cf("runs AND mal", "malware_execution_count")},
  {_cf("event_type IN ('NetworkConnect', 'NetworkDisconnect')", "network_connections")}, {_cf("event_type = 'VPNConnect'", "vpn_connections")},
  {_cf("event_type = 'VPNDisconnect'", "vpn_disconnections")}, count(DISTINCT {_dest})::DOUBLE AS unique_destination_ips,
  count(DISTINCT ip_address)::DOUBLE AS unique_source_ips, sum(hits)::DOUBLE AS external_connections,
  sum(CASE WHEN event_type = 'ApiCall' THEN hits ELSE 0 END)::DOUBLE AS beaconing_event_count, count(*)::DOUBLE AS total_events,
  coalesce(avg(gap), 0) AS average_time_between_events, coalesce(max(gap), 0) AS maximum_idle_time, coalesce(min(gap), 0) AS minimum_idle_time,
  count(DISTINCT event_type)::DOUBLE AS unique_event_types,
  count(*) FILTER (WHERE event_type IN ('Login', 'Logout'))::DOUBLE / count(*) AS login_event_ratio,
  count(*) FILTER (WHERE event_type LIKE 'File%')::DOUBLE / count(*) AS file_event_ratio,
  count(*) FILTER (WHERE event_type LIKE 'Process%')::DOUBLE / count(*) AS process_event_ratio,
  count(*) FILTER (WHERE event_type LIKE '%onnect%')::DOUBLE / count(*) AS network_event_ratio,
  count(*) FILTER (WHERE event_type = 'ResourceAccess')::DOUBLE / count(*) AS resource_event_ratio,
  arg_min({_ORD}, pos)::DOUBLE AS first_event_type, arg_max({_ORD}, pos)::DOUBLE AS last_event_type, count(*)::DOUBLE AS event_sequence_length,
  coalesce((epoch_us(min(ts) FILTER (WHERE event_type = 'ResourceAccess')) - epoch_us(min(ts))) / 1e6, -1) AS login_to_first_resource_time,
  coalesce(min(idx) FILTER (WHERE resource IN {_ADM})::DOUBLE / count(*), -1) AS admin_access_position,
  coalesce(min(idx) FILTER (WHERE event_type = 'FileDownload')::DOUBLE / count(*), -1) AS file_download_position,
  coalesce(min(idx) FILTER (WHERE event_type = 'ProcessStart')::DOUBLE / count(*), -1) AS process_execution_position,
  coalesce(list(DISTINCT resource) FILTER (WHERE resource IS NOT NULL), []) AS resources FROM sx GROUP BY session_id""")
cte("rows_", f"""SELECT a.*, greatest(1.0, (epoch_us(end_time) - epoch_us(start_time)) / 1e6)::DOUBLE AS duration_seconds,
  CASE WHEN contains(lower(auth), 'vpn') THEN 'VPN' ELSE 'Office' END AS login_method, contains(lower(auth), 'vpn') AS remote_session,
  dayname(start_time) AS day_of_week, e.employee_uuid, coalesce(e.department, 'IT') AS department, coalesce(e.role, 'Staff') AS role,
  coalesce(e.preferred_browser, 'Chrome') AS browser, coalesce(e.preferred_os, 'Windows') AS operating_system,
  failed_login_count + successful_login_count AS authentication_attempts,
  CASE WHEN failed_login_count + successful_login_count > 0 THEN failed_login_count / (failed_login_count + successful_login_count) ELSE 0 END AS failed_login_ratio,
  CASE WHEN total_download_bytes > 0 THEN total_upload_bytes / total_download_bytes ELSE 0 END AS upload_download_ratio,
  CASE WHEN hour(start_time) < 7 OR hour(start_time) > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS off_hours_access, hour(start_time)::DOUBLE AS session_start_hour
  FROM agg a LEFT JOIN emp e USING (employee_id)""")
cte("rows", "SELECT *, n_events / greatest(1.0, duration_seconds / 60) AS events_per_minute FROM rows_")
cte("num", "SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY start_time, session_id) - 1 AS n_before FROM rows")

_W = "STRUCT(loc VARCHAR, dev VARCHAR, br VARCHAR, os VARCHAR, hr DOUBLE, res VARCHAR[])[]"
_D6 = list(dims.DEVIATIONS)
_score = "25 * l + 15 * d + 5 * b + 5 * o + 20 * h + 30 * r"
_cat = lambda f, c: f"1 - len(list_filter(w, lambda y: y.{f} = {c}))::DOUBLE / len(w)"
_resdev = "CASE WHEN len(resources) = 0 THEN 0 ELSE list_sum(list_transform(resources, lambda q: 1 - (len(list_filter(w, lambda y: list_contains(y.res, q))) + 2.0::DOUBLE) / (len(w) + 2.0::DOUBLE))) / len(resources) END"
cte("fold", f"""SELECT DISTINCT employee_id, -1::BIGINT AS n_before, ''::VARCHAR AS session_id, 0::DOUBLE AS l, 0::DOUBLE AS d, 0::DOUBLE AS b, 0::DOUBLE AS o,
    0::DOUBLE AS h, 0::DOUBLE AS r, 0::DOUBLE AS score, []::{_W} AS w FROM num
  UNION ALL
  SELECT employee_id, n_before, session_id, l, d, b, o, h, r, {_score},
    CASE WHEN {_score} < 25 THEN list_append(w, {{'loc': office_location, 'dev': device_id, 'br': browser, 'os': operating_system, 'hr': hr, 'res': resources}})[-10:] ELSE w END
  FROM (SELECT *, CASE WHEN few THEN 0 ELSE {_cat('loc', 'office_location')} END AS l, CASE WHEN few THEN 0 ELSE {_cat('dev', 'device_id')} END AS d,
    CASE WHEN few THEN 0 ELSE {_cat('br', 'browser')} END AS b, CASE WHEN few THEN 0 ELSE {_cat('os', 'operating_system')} END AS o,
    CASE WHEN few THEN 0 ELSE least(abs(hr - list_avg(list_transform(w, lambda y: y.hr))) / 12, 1) END AS h, CASE WHEN few THEN 0 ELSE {_resdev} END AS r
    FROM (SELECT n.employee_id, n.n_before, n.session_id, n.office_location, n.device_id, n.browser, n.operating_system, hour(n.start_time)::DOUBLE AS hr,
      n.resources, f.w, len(f.w) < 3 AS few FROM fold f JOIN num n ON n.employee_id = f.employee_id AND n.n_before = f.n_before + 1))""")
cte("dr", "SELECT employee_id, n_before, session_id, l AS location_deviation, d AS device_deviation, b AS browser_deviation, o AS operating_system_deviation, "
    "h AS working_hours_deviation, r AS resource_access_deviation, score AS behaviour_score FROM fold WHERE n_before >= 0")
_scmd, _sproc = "lower(coalesce(command_line, ''))", "lower(coalesce(process_name, ''))"
cte("pts", f"""SELECT s.*, CASE WHEN event_type = 'Login' AND status = 'FAILED' THEN 5.0 ELSE 0 END
  + CASE WHEN e.department <> 'IT' AND resource IN {_ADM} THEN 15.0 ELSE 0 END + CASE WHEN bytes_transferred > {100 * _MIB} THEN 20.0 ELSE 0 END
  + CASE WHEN event_type = 'ProcessStart' AND ({_has(_scmd, dims.MALWARE_NAMES)} OR {_has(_sproc, dims.MALWARE_NAMES)} OR {_has(_scmd, dims.SUSPICIOUS_FLAGS)})
    THEN 20.0 ELSE 0 END AS pts FROM se s LEFT JOIN emp e USING (employee_id)""")
_sev = lambda c: _map(c, dims.ATTACK_SEVERITY, "0::DOUBLE")
cte("rr", f"""SELECT r.session_id, least(100, greatest(0, {_sev('r.attack_type')} + p.points))::DOUBLE AS rule_risk
  FROM rows r JOIN (SELECT session_id, sum(pts)::DOUBLE AS points FROM pts GROUP BY 1) p USING (session_id)""")
cte("sc_", """SELECT r.*, rr.rule_risk AS risk_score, CASE WHEN attack_type = 'None' THEN 'Normal' ELSE attack_type END AS predicted_label,
  round(0.5::DOUBLE + (n_events % 10) * 0.05::DOUBLE, 4) AS confidence, round(least(1.0::DOUBLE, duration_seconds / 86400), 4) AS anomaly_score FROM rows r JOIN rr USING (session_id)""")
_w = "confidence * 0.35::DOUBLE + anomaly_score * 0.35::DOUBLE + least(risk_score / 100, 1) * 0.30::DOUBLE"
cte("sc", f"SELECT *, CASE WHEN {_w} >= 0.80::DOUBLE THEN 'Critical' WHEN {_w} >= 0.60::DOUBLE THEN 'High' WHEN {_w} >= 0.35::DOUBLE THEN 'Medium' ELSE 'Low' END AS severity FROM sc_")
cte("inc", """SELECT session_id, employee_id, predicted_label AS attack_type, confidence, anomaly_score, risk_score, severity, device_id, start_time AS ts, duration_seconds,
  hour(start_time) AS session_start_hour, n_events, list_filter([CASE WHEN failed_login_count > 0 THEN 'failed_login_count' END, CASE WHEN total_upload_bytes > 0 THEN 'total_upload_bytes' END,
   CASE WHEN powershell_executions > 0 THEN 'powershell_executions' END, CASE WHEN admin_resource_accesses > 0 THEN 'admin_resource_accesses' END], lambda x: x IS NOT NULL) AS feats FROM sc""")
cte("linked", """SELECT i.*, p.source_ip FROM inc i JOIN (SELECT session_id, arg_max(ip_address, pos) AS source_ip FROM se GROUP BY 1) p USING (session_id) WHERE attack_type <> 'Normal'""")
cte("shared", """SELECT session_id, ts, 'ip' AS kind, source_ip AS value FROM linked UNION ALL SELECT session_id, ts, 'employee', employee_id FROM linked
  UNION ALL SELECT session_id, ts, 'device', device_id FROM linked""")
cte("near", """SELECT kind, value, prev_id AS src, session_id AS dst FROM (SELECT *, lag(session_id) OVER w AS prev_id, lag(ts) OVER w AS prev_ts FROM shared
  WINDOW w AS (PARTITION BY kind, value ORDER BY ts, session_id)) WHERE epoch_us(ts) - epoch_us(prev_ts) <= 86400000000""")
# all pairs of the reference definition, not the consecutive links: shared value within 24 h
cte("pair", """SELECT DISTINCT a.session_id AS src, b.session_id AS dst FROM shared a JOIN shared b
  ON a.kind = b.kind AND a.value = b.value AND a.session_id <> b.session_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000""")
cte("reach", "SELECT session_id AS root, session_id AS node FROM linked UNION SELECT r.root, p.dst FROM reach r JOIN pair p ON p.src = r.node")
cte("comp", "SELECT node AS session_id, min(root) AS component FROM reach GROUP BY 1")
cte("mem", """SELECT l.*, c.component FROM linked l JOIN comp c USING (session_id) WHERE c.component IN (SELECT component FROM linked JOIN comp USING (session_id)
  GROUP BY 1 HAVING count(*) > 1 OR bool_or(severity IN ('High', 'Critical')))""")
cte("mpos", "SELECT *, row_number() OVER w - 1 AS mp, lag(attack_type) OVER w AS prev_attack FROM mem WINDOW w AS (PARTITION BY component ORDER BY ts, session_id)")
cte("lst", "SELECT l_orderkey, l_linenumber, l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem")


def _curve(source: str, out: str, by: str = "") -> None:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    cte(f"{out}_d", f"SELECT {g}score AS threshold, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM {source} GROUP BY {g}score")
    cte(out, f"""SELECT *, tp - p AS ptp, fp - n AS pfp FROM (SELECT *, CAST(sum(p) OVER (w ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (w ORDER BY threshold DESC) AS BIGINT) AS fp,
      CAST(sum(p) OVER w AS BIGINT) AS pos, CAST(sum(n) OVER w AS BIGINT) AS neg FROM {out}_d WINDOW w AS ({part}))""")


_curve("lst", "cv")
cte("f1c", "SELECT *, 2 * pr * rc / (pr + rc + 1e-9) AS f1 FROM (SELECT threshold, tp::DOUBLE / (tp + fp) AS pr, tp::DOUBLE / pos AS rc FROM cv)")
cte("f1b", "SELECT threshold, f1 FROM f1c ORDER BY f1 DESC, threshold ASC LIMIT 1")
cte("yb", "SELECT threshold, tp::DOUBLE / pos - fp::DOUBLE / neg AS j FROM cv ORDER BY j DESC, threshold DESC LIMIT 1")
cte("auc", "SELECT sum((fp - pfp)::DOUBLE * (tp + ptp) / 2) / (max(pos)::DOUBLE * max(neg)) AS roc_auc FROM cv")
cte("emb", "SELECT vec_id, CAST(label AS INTEGER) AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64))
    + ", [" + ", ".join(" + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(c, 64, 10)) for c in range(10)) + "] AS probs FROM embeddings")
cte("clsl", "SELECT vec_id, label, probs, i AS class, probs[i + 1] AS score, CASE WHEN label = i THEN 1 ELSE 0 END AS hit FROM emb, range(10) t(i)")
cte("topk", "SELECT vec_id, label, class, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) - 1 AS place FROM clsl")
cte("pred", "SELECT vec_id, label, CAST(class AS INTEGER) AS predicted_label FROM topk WHERE place = 0")
cte("ovs", "SELECT class, score, hit AS label FROM clsl")
_curve("ovs", "ov", "class")
cte("cm", """SELECT a.c AS true_label, b.c AS predicted_label, (SELECT count(*) FROM pred p WHERE p.label = a.c AND p.predicted_label = b.c) AS n
  FROM (SELECT label AS c FROM pred UNION SELECT predicted_label FROM pred) a, (SELECT label AS c FROM pred UNION SELECT predicted_label FROM pred) b""")
cte("rep", """SELECT class, CASE WHEN q > 0 THEN tp::DOUBLE / q ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
  CASE WHEN support + q > 0 THEN 2.0::DOUBLE * tp / (support + q) ELSE 0 END AS f1, support, tp FROM (SELECT c.c AS class,
   (SELECT count(*) FROM pred WHERE label = c.c AND predicted_label = c.c) AS tp, (SELECT count(*) FROM pred WHERE label = c.c) AS support,
   (SELECT count(*) FROM pred WHERE predicted_label = c.c) AS q FROM (SELECT label AS c FROM pred UNION SELECT predicted_label FROM pred) c)""")
cte("mean8", "SELECT " + ", ".join(f"avg(x{i}) AS m{i}" for i in range(64)) + " FROM emb")
cte("phi", "SELECT vec_id, label, CAST(c AS INTEGER) AS class, f, 'x' || f AS feature, xs[f + 1] AS x, ((((c * 7 + f * 3) % 11) - 5)::DOUBLE / 10) * (xs[f + 1] - ms[f + 1]) AS phi FROM (SELECT vec_id, label, ["
    + ", ".join(f"x{i}" for i in range(64)) + "] AS xs, [" + ", ".join(f"m{i}" for i in range(64)) + "] AS ms FROM emb, mean8), range(10) a(c), range(64) b(f)")
_SENS = {r: float(dims.SENSITIVITY.index(s)) for r, (_, s, _) in dims.RESOURCE_DIM.items()}
_VEC = [f"CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END" for t in dims.EVENT_TYPES] + [
    _map("resource", _SENS, "0"), f"CASE WHEN resource IN {_ADM} THEN 1 ELSE 0 END", "CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END",
    "least(1, coalesce(gap, 0) / 300)", "CASE WHEN contains(lower(seq), 'powershell') THEN 1 ELSE 0 END",
    f"CASE WHEN {_has('lower(seq)', dims.MALWARE_NAMES)} THEN 1 ELSE 0 END"]
cte("vec", "SELECT session_id, CAST(idx AS INTEGER) AS step, [" + ", ".join(f"({v})::DOUBLE" for v in _VEC) + "] AS vec FROM sx")
cte("stp", "SELECT session_id, step, i AS dim, vec[i + 1] AS v FROM vec, range(21) t(i)")


def _steps_stat(where: str) -> str:
    return f"SELECT dim, avg(v) AS m, CASE WHEN stddev_pop(v) > 1e-9 THEN stddev_pop(v) ELSE 1 END AS s FROM stp {where} GROUP BY dim"


cte("z", f"SELECT session_id, step, dim, (v - m) / s AS x FROM stp JOIN ({_steps_stat('WHERE step < 50')}) USING (dim) WHERE step < 50")
cte("hr_", "SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM se")
cte("dedup", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS i FROM hr_)
  SELECT event_id, session_id, ts, CAST(max(epoch_us(ts) // 1000000 - i) OVER (PARTITION BY session_id ORDER BY i) + i AS BIGINT) AS new_second FROM o""")
cte("xp", """SELECT event_id, CASE WHEN k % 4 = 0 THEN '' ELSE employee_id END AS entity_id, CASE WHEN k % 8 <> 0 THEN employee_id END AS employee_id, 'USER-X' AS user_id, ts,
  CASE WHEN k % 3 = 0 THEN '' ELSE ip_address END AS source_ip, CASE WHEN k % 2 = 0 THEN lower(resource) ELSE 'Mystery' END AS resource_accessed,
  CASE WHEN k % 5 = 0 THEN 0 ELSE k * 2 END::DOUBLE AS session_duration,
  CASE k % 6 WHEN 0 THEN ['a b', 'c'] WHEN 1 THEN ['plain cmd'] ELSE []::VARCHAR[] END AS cmds,
  CASE WHEN k % 7 = 0 THEN '' ELSE device_id END AS device_fingerprint, k % 3 = 0 AS lab,
  CASE WHEN k % 5 < 2 THEN '' WHEN k % 5 = 2 THEN 'Strange' ELSE event_type END AS event_type, status FROM ev""")
cte("xt", """SELECT *, CASE WHEN event_type = 'Strange' THEN 'ResourceAccess' WHEN event_type <> '' THEN event_type WHEN len(cmds) > 0 THEN 'ProcessStart'
  WHEN coalesce(resource_accessed, '') = '' THEN 'Login' ELSE 'ResourceAccess' END AS etype FROM xp""")
cte("camp", f"""SELECT component, count(*) AS session_count, count(DISTINCT employee_id) AS n_employees, count(DISTINCT source_ip) AS n_ips, count(DISTINCT device_id) AS n_devices,
  CASE WHEN count(*) >= 3 AND max(rk) = 2 THEN 3 ELSE max(rk) END AS rk, count(DISTINCT attack_type) AS n_attacks, string_agg(DISTINCT attack_type, ',' ORDER BY attack_type) AS attack_types,
  string_agg(DISTINCT tac, ',' ORDER BY tac) AS mitre_tactics, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, list(attack_type ORDER BY mp) AS seq
  FROM (SELECT *, CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END AS rk, {_map('attack_type', {a: t for a, (t, _, _) in dims.MITRE.items()}, 'NULL')} AS tac FROM mpos) GROUP BY component""")
# ordered subsequence of a list by a pointer walk
def _sub(seq: str, chain: list[str]) -> str:
    return f"list_reduce(list_prepend(0, list_transform({seq}, lambda a: list_position({_list(chain)}, a))), lambda st, q: CASE WHEN q = st + 1 THEN st + 1 ELSE st END) = {len(chain)}"


cte("chained", "SELECT *, CASE " + " ".join(f"WHEN {_sub('seq', c)} THEN {i + 1}" for i, c in enumerate(dims.ATTACK_CHAINS)) + " END AS std_chain FROM camp")

_NAMES = [n for n, _ in CTE]


def with_ctes(select: str, upto: str) -> str:
    """Statement with every shared step up to and including ``upto``."""
    used = ",\n".join(f"{n} AS ({q})" for n, q in CTE[: _NAMES.index(upto) + 1])
    more = select.startswith("WITH ")  # the statement brings steps of its own
    return f"WITH RECURSIVE {used}{',' if more else ''}\n{select.removeprefix('WITH ')}"


ORACLE: dict[str, str] = {}


def add(name: str, upto: str | None, select: str) -> None:
    ORACLE[name] = select if upto is None else with_ctes(select, upto)


def _r(cols, n: int = 6, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, {n}) AS {c}" for c in cols)


# --- sources, sinks ------------------------------------------------------------------
add("src_columns", None, "SELECT c_custkey, c_mktsegment FROM customer")
add("src_alignment", "rows", "SELECT session_id, 'sequences' AS missing_in FROM rows WHERE employee_id = 'EMP-0007' UNION ALL SELECT session_id || '-X', 'features' FROM rows WHERE employee_id = 'EMP-0007'")
add("snk_dims", "emp", "SELECT employee_id, employee_uuid, printf('%02d:00', work_start) AS work_start_time, printf('%02d:00', work_end) AS work_end_time, array_to_string(allowed_devices, ';') AS allowed_devices, department FROM emp")
add("snk_sessions", "rows", """SELECT regexp_replace(md5(session_id), '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', '\\1-\\2-4\\3-a\\4-\\5') AS session_uuid, printf('%.2f', duration_seconds) AS duration_seconds, session_id, employee_uuid, employee_id, department, role, device_id, browser, operating_system, office_location, login_method,
  CASE WHEN remote_session THEN 'True' ELSE 'False' END AS remote_session, day_of_week, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time,
  '0.00' AS risk_score, CASE WHEN is_anomalous THEN 'True' ELSE 'False' END AS is_anomalous, attack_type FROM rows""")
add("snk_events", "ev", """SELECT employee_id AS entity_id, 'user' AS entity_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, ip_address AS source_ip, geo_location, coalesce(resource, '') AS resource_accessed,
  auth_method, '0.00' AS session_duration, CASE WHEN seq = '' THEN '[]' ELSE '["' || seq || '"]' END AS command_sequence, device_id AS device_fingerprint, CAST(attack_type <> 'None' AS INTEGER) AS label FROM ev""")
add("snk_scores", "sc", """SELECT session_id, CAST(is_anomalous AS INTEGER) AS is_anomalous, attack_type, round(risk_score, 4) AS risk_score, round(duration_seconds / 1000, 6) AS reconstruction_error,
  anomaly_score, CAST(duration_seconds / 1000 > 20 AS INTEGER) AS predicted_label FROM sc""")
_tac = _map("attack_type", {a: t for a, (t, _, _) in dims.MITRE.items()}, "''")
_tid = lambda dflt: _map("attack_type", {a: i for a, (_, i, _) in dims.MITRE.items()}, dflt)
_tec = _map("attack_type", {a: q for a, (_, _, q) in dims.MITRE.items()}, "''")
add("snk_explanations", "inc", f"""SELECT session_id, attack_type AS prediction, {_tac} AS mitre_tactic, {_tid("''")} AS mitre_technique_id, coalesce(feats[1], '') AS top_pos_feature_1,
  CASE WHEN len(feats) > 0 THEN '1.5' ELSE '' END AS top_pos_value_1, coalesce(feats[2], '') AS top_pos_feature_2, '' AS top_pos_feature_5, coalesce(feats[1], '') AS top_neg_feature_1, '' AS top_neg_feature_2 FROM inc""")
_names3 = "(row_number() OVER (ORDER BY first_us, component))::BIGINT"
_cid = lambda n: f"'CAMP-' || CASE WHEN {n} < 1000 THEN lpad({n}::VARCHAR, 3, '0') ELSE {n}::VARCHAR END"
_sevname = "['Low', 'Medium', 'High', 'Critical'][rk + 1]"
_ischain = "(std_chain IS NOT NULL OR n_attacks > 1)"
add("snk_campaigns", "chained", f"""SELECT {_cid('no')} AS campaign_id, overall_severity, session_count, 0::BIGINT AS page, e.affected_employees, replace(attack_types, ',', ', ') AS attack_types, is_attack_chain
  FROM (SELECT *, {_names3} AS no, {_sevname} AS overall_severity, CASE WHEN {_ischain} THEN 'True' ELSE 'False' END AS is_attack_chain FROM chained)
  JOIN (SELECT component, string_agg(DISTINCT employee_id, ', ' ORDER BY employee_id) AS affected_employees FROM mem GROUP BY 1) e USING (component)""")

# --- schema adaptation ------------------------------------------------------------------
add("adp_timestamps", None, """SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 8 THEN epoch_us(o_orderdate) // 1000000 WHEN o_orderkey % 14 >= 12 THEN NULL
  ELSE epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 END AS epoch_s FROM orders""")
_words = ["user_login_success", "session_logoff", "data_exfil_push", "http_post", "file_access_read", "modify_file", "cmd_exec", "kill_proc", "sql_select", "vpn_connect", "api_call", "view_page", "zzz", ""]
_pats = " ".join(f"WHEN regexp_matches(a, '(?i)({p})') THEN '{t}'" for p, t in dims.EVENT_TYPE_PATTERNS)
add("adp_event_types", "ev", f"""SELECT event_id, CASE {_pats} WHEN k % 5 = 0 THEN 'ProcessStart' WHEN k % 3 = 0 THEN 'DatabaseQuery' WHEN k % 3 = 1 THEN 'FileRead' ELSE 'ResourceAccess' END AS event_type
  FROM (SELECT event_id, k, {_list(_words)}[k % 14 + 1] AS a FROM ev)""")
add("adp_status", "ev", "SELECT event_id, CASE WHEN k % 8 < 5 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM ev")
_pe = " ".join(f"WHEN regexp_matches(event_type, '(?i)({p})') THEN '{t}'" for p, t in dims.EVENT_TYPE_PATTERNS)
add("adp_internal", None, f"""SELECT event_id, CAST(user_id AS VARCHAR) AS employee_id, CASE {_pe} ELSE 'ResourceAccess' END AS event_type, 'DEV-UNKNOWN' AS device_id, '127.0.0.1' AS ip_address,
  'Office' AS geo_location, 'Password' AS auth_method, 'SUCCESS' AS status, 0::DOUBLE AS bytes_transferred, NULL::VARCHAR AS resource, true AS has_props, epoch_us(ts) AS ts_us FROM events""")
add("adp_report", None, """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
  n AS (SELECT count(*) FILTER (WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000) AS s, count(*) AS c, count(DISTINCT user_id) AS u FROM o)
  SELECT c AS total_rows, c AS mapped_rows, 0::BIGINT AS skipped_rows, s AS sessions_built, u AS unique_employees, 76.4::DOUBLE AS compatibility_score, 'PARTIAL' AS compatibility_level, 'WARNING' AS pipeline_status, false AS features_present, false AS features_ordered FROM n""")
add("adp_skipped", None, """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_id % 7 <> 0),
  n AS (SELECT count(*) FILTER (WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000) AS s, count(*) AS c, count(DISTINCT user_id) AS u FROM o), t AS (SELECT count(*) AS c FROM events)
  SELECT t.c AS total_rows, n.c AS mapped_rows, t.c - n.c AS skipped_rows, s AS sessions_built, u AS unique_employees, 'READY' AS pipeline_status FROM n, t""")
_unlow = "CASE lower(resource_accessed) " + " ".join(f"WHEN '{x.lower()}' THEN '{x}'" for x in dims.RESOURCES) + " END"
add("adp_standardize", "xt", f"""SELECT event_id, CASE WHEN entity_id <> '' THEN entity_id WHEN employee_id IS NOT NULL THEN employee_id ELSE 'USER-X' END AS employee_id,
  CASE WHEN source_ip = '' THEN '127.0.0.1' ELSE source_ip END AS ip_address, {_unlow} AS resource, session_duration, len(cmds)::BIGINT AS n_commands,
  CASE WHEN device_fingerprint = '' THEN 'UNKNOWN_DEVICE' ELSE device_fingerprint END AS device_id, lab AS is_anomalous, etype AS event_type, status, 'Office' AS geo_location, 'Password' AS auth_method,
  epoch_us(ts) // 1000000 AS epoch_s FROM xt""")
add("adp_labels", "ev", "SELECT event_id, CASE WHEN k % 7 < 4 THEN 1 ELSE 0 END::BIGINT AS label FROM ev")
add("adp_commands", "xt", "SELECT event_id, len(cmds)::BIGINT AS n, cmds[1] AS first FROM xt")
add("adp_infer_type", "xt", "SELECT event_id, etype AS event_type FROM xt")
add("adp_enum", "ev", "SELECT event_id, CASE WHEN k % 3 < 2 THEN resource END AS resource FROM ev")

# --- sessions ---------------------------------------------------------------------------------
_gap_sql = """WITH RECURSIVE {c}, o AS (SELECT *, row_number() OVER w - 1 AS pos, lag(ts) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY {k} ORDER BY ts, event_id)),
  n AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {g} THEN 1 ELSE 0 END AS nw FROM o),
  q AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY {k} ORDER BY ts, event_id) AS BIGINT) AS session_no FROM n) """
_evc = ",\n".join(f"{n} AS ({q})" for n, q in CTE[: _NAMES.index("ev") + 1])
ORACLE["ses_gap"] = _gap_sql.format(c=_evc, k="employee_id", g=1800000000) + "SELECT event_id, session_no, pos, CASE WHEN nw = 0 THEN round((epoch_us(ts) - epoch_us(prev)) / 1e6, 6) END AS gap FROM q"
ORACLE["ses_employee_device"] = _gap_sql.format(c=_evc, k="employee_id, device_id", g=21600000000) + "SELECT event_id, employee_id || '-' || device_id || '-S' || session_no AS session_id FROM q"
add("ses_given", "ev", """SELECT event_id, sid AS session_id, row_number() OVER w - 1 AS pos, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS gap
  FROM (SELECT *, CASE WHEN k % 10 >= 3 THEN 'G-' || employee_id || '-' || (k % 7) ELSE 'SES-GEN-' || employee_id END AS sid FROM ev) WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id)""")
add("ses_build", "rows", "SELECT session_id, employee_id, device_id, office_location, login_method, remote_session, day_of_week, n_events, round(duration_seconds, 6) AS duration_seconds, epoch_us(start_time) AS start_us FROM rows")
add("ses_recorded_duration", "se", """SELECT session_id, round(CASE WHEN f > 0 THEN f ELSE (epoch_us(b) - epoch_us(a)) / 1e6 END, 6) AS duration_seconds FROM (SELECT session_id,
  arg_min(CASE WHEN k % 2 = 0 THEN value ELSE 0 END, pos) AS f, min(ts) AS a, max(ts) AS b FROM se GROUP BY 1)""")
add("ses_labels", "rows", "SELECT r.session_id, is_anomalous, attack_type, m.v AS risk_score FROM rows r JOIN (SELECT session_id, round(max(value), 6) AS v FROM se GROUP BY 1) m USING (session_id)")
add("ses_numbers", "se", """WITH s AS (SELECT employee_id, session_no, session_id, min(event_id) AS fe FROM se GROUP BY ALL), e AS (SELECT employee_id, min(fe) AS fe, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT employee_id, CAST(sum(n) OVER (ORDER BY fe) AS BIGINT) - n AS off FROM e)
  SELECT session_id, 'SES-AD-' || lpad((off + session_no)::VARCHAR, 6, '0') AS session_ref, off + session_no AS session_number FROM s JOIN o USING (employee_id)""")
add("ses_enrich", "rows", """SELECT session_id, CASE WHEN employee_no % 9 = 0 THEN 'IT' ELSE r.department END AS department, CASE WHEN employee_no % 9 = 0 THEN 'Staff' ELSE r.role END AS role,
  CASE WHEN employee_no % 9 = 0 THEN 'Chrome' ELSE browser END AS browser, CASE WHEN employee_no % 9 = 0 THEN 'Windows' ELSE operating_system END AS operating_system FROM rows r JOIN emp USING (employee_id)""")
add("ses_dedup_timestamps", "dedup", "SELECT event_id, session_id, new_second FROM dedup")
add("ses_extended_bounds", "dedup", """SELECT session_id, min(epoch_us(ts) // 1000000) AS start_second, greatest(max(epoch_us(ts) // 1000000), max(new_second)) AS end_second,
  (greatest(max(epoch_us(ts) // 1000000), max(new_second)) - min(epoch_us(ts) // 1000000))::DOUBLE AS duration_seconds FROM dedup GROUP BY 1""")
add("ses_hot_keys", "ev", """WITH h AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN employee_id END AS employee_id, CASE WHEN event_id % 6 < 2 THEN TIMESTAMP '2024-05-05 10:00:00' ELSE ts END AS ts, ip_address FROM ev),
  g AS (SELECT *, row_number() OVER w - 1 AS pos, lag(ts) OVER w AS p FROM h WINDOW w AS (PARTITION BY employee_id ORDER BY ts, event_id)),
  n AS (SELECT *, (sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY employee_id ORDER BY ts, event_id))::BIGINT AS session_no FROM g)
  SELECT event_id, employee_id, pos, session_no, CASE WHEN ip_address <> '' AND row_number() OVER (PARTITION BY employee_id, session_no, ip_address ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END::BIGINT AS new_ip FROM n""")
add("ses_summary", "rows", """SELECT count(*) AS sessions, sum(n_events)::BIGINT AS events, count(DISTINCT employee_id) AS employees, round(avg(duration_seconds / 60), 6) AS avg_minutes,
  round(avg(CASE WHEN login_method = 'Office' THEN 1 ELSE 0 END), 6) AS office_share, round(avg(CASE WHEN login_method = 'VPN' THEN 1 ELSE 0 END), 6) AS vpn_share, round(avg(is_anomalous::INTEGER), 6) AS anomaly_share,
  round(count(*)::DOUBLE / count(DISTINCT employee_id), 6) AS sessions_per_employee, round(sum(n_events)::DOUBLE / count(*), 6) AS events_per_session FROM rows""")

# --- features -------------------------------------------------------------------------------------
_SESS = {"session_duration": "duration_seconds", "login_hour": "hour(start_time)::DOUBLE", "logout_hour": "hour(end_time)::DOUBLE", "day_of_week": "(isodow(start_time) - 1)::DOUBLE",
         "weekend_flag": "(CASE WHEN isodow(start_time) >= 6 THEN 1 ELSE 0 END)::DOUBLE", "remote_session": "remote_session::INTEGER::DOUBLE", "vpn_used": "(login_method = 'VPN')::INTEGER::DOUBLE",
         "browser": f"(list_position({_list(dims.BROWSERS)}, browser) - 1)::DOUBLE", "operating_system": f"(list_position({_list(dims.OPERATING_SYSTEMS)}, operating_system) - 1)::DOUBLE",
         "department": f"(list_position({_list(dims.DEPARTMENTS)}, department) - 1)::DOUBLE", "login_method": "(login_method = 'VPN')::INTEGER::DOUBLE"}


def _feat(cols, n=6) -> str:
    return ", ".join(f"round({_SESS.get(c, c)} + 1.7e-8, {n}) AS {c}" for c in cols)


for _q, _c in {"fea_session": dims.SESSION_FEATURES, "fea_auth": dims.AUTH_FEATURES, "fea_resource": dims.RESOURCE_FEATURES, "fea_file": dims.FILE_FEATURES, "fea_process": dims.PROCESS_FEATURES,
               "fea_network": dims.NETWORK_FEATURES, "fea_temporal": dims.TEMPORAL_FEATURES, "fea_ratio": dims.RATIO_FEATURES, "fea_order": dims.ORDER_FEATURES}.items():
    add(_q, "rows", f"SELECT session_id, {_feat(_c)} FROM rows")
_fr = f"least(100, greatest(0, 0.30::DOUBLE * behaviour_score + 0.40::DOUBLE * CASE WHEN is_anomalous THEN {_sev('attack_type')} ELSE 0 END))"
_joined = "(SELECT r.*, d.behaviour_score, " + ", ".join(f"d.{c}" for c in _D6) + " FROM rows r JOIN dr d USING (session_id))"
add("fea_vector", "dr", f"SELECT session_id, employee_id, is_anomalous::INTEGER::DOUBLE AS is_anomalous, attack_type, round({_fr} + 1.7e-8, 4) AS risk_score, {_feat(dims.FEATURES, 4)} FROM {_joined}")
add("snk_features", "dr", f"SELECT {len(dims.META_COLUMNS) + len(dims.FEATURES)}::BIGINT AS n_columns, 'risk_score' AS fifth, session_id, employee_id, attack_type, round({_fr} + 1.7e-8, 4) AS risk_score, {_feat(dims.FEATURES, 4)} FROM {_joined}")
_catg = {f: c for c, fs in dims.FEATURE_CATEGORY.items() for f in fs}
_evf = [f for f in dims.FEATURES if f not in dims.SESSION_FEATURES + dims.BEHAVIOUR_FEATURES + ["login_method"]]
add("fea_catalogue", "rows", "\nUNION ALL ".join(f"SELECT '{f}' AS feature, '{_catg.get(f, 'Session')}' AS category, '{dims.FEATURE_DESCRIPTION.get(f, f.replace('_', ' '))}' AS description, {f'round(avg({f}), 3)' if f in _evf else 'avg(NULL::DOUBLE)'} AS mean FROM rows" for f in dims.MODEL_FEATURES))
add("fea_context", "dr", f"SELECT session_id, employee_id AS entity_id, device_id AS device_fingerprint, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, round({_fr}, 4) AS risk, is_anomalous, round(device_deviation, 4) AS device_deviation FROM {_joined}")
add("fea_event_ids", "sx", "SELECT session_id, (idx // 3)::BIGINT AS page, string_agg(event_id::VARCHAR, ',' ORDER BY idx) AS event_ids FROM sx GROUP BY 1, 2")

# --- behaviour ---------------------------------------------------------------------------------------
add("beh_personal", "rows", """SELECT employee_id, count(*) AS sessions, min(hour(start_time))::INTEGER AS hour_min, max(hour(start_time))::INTEGER AS hour_max, floor(avg(n_events))::BIGINT AS mean_actions,
  round(avg(CASE WHEN isodow(start_time) >= 6 THEN 1 ELSE 0 END), 6) AS weekend_share, round(avg(remote_session::INTEGER), 6) AS remote_share, round(avg(duration_seconds) / 60, 6) AS mean_minutes,
  round(CASE WHEN count(*) > 1 THEN stddev_pop(duration_seconds) / 60 ELSE 10.0::DOUBLE / 60 END, 6) AS sd_minutes, round(CASE WHEN count(*) > 1 THEN stddev_pop(n_events) ELSE 3 END, 6) AS sd_actions FROM rows GROUP BY 1""")
_kinds = {"location": "office_location", "device": "device_id", "browser": "browser", "operating_system": "operating_system", "method": "login_method"}
add("beh_shares", "rows", "SELECT employee_id, kind, value, round(c::DOUBLE / n, 6) AS share FROM (" + " UNION ALL ".join(
    f"SELECT employee_id, '{k}' AS kind, {v} AS value, count(*) AS c FROM {'rows' if k != 'resource' else 'se WHERE resource IS NOT NULL'} GROUP BY 1, 3"
    for k, v in {**_kinds, "hour": "hour(start_time)::VARCHAR", "resource": "resource"}.items()) + ") JOIN (SELECT employee_id, count(*) AS n FROM rows GROUP BY 1) USING (employee_id)")
_bw = "(PARTITION BY employee_id ORDER BY n_before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
add("beh_asof", "num", f"""SELECT session_id, n_before, round(avg(hour(start_time)) OVER w, 4) AS mean_hour, round(avg(CASE WHEN isodow(start_time) >= 6 THEN 1 ELSE 0 END) OVER w, 4) AS weekend_share,
  round(avg(remote_session::INTEGER) OVER w, 4) AS remote_share, round(avg(duration_seconds) OVER w / 60, 4) AS mean_minutes, CASE WHEN n_before > 1 THEN round(stddev_pop(duration_seconds) OVER w / 60, 4) END AS sd_minutes,
  round(avg(n_events) OVER w, 4) AS mean_actions, CASE WHEN n_before > 1 THEN round(stddev_pop(n_events) OVER w, 4) END AS sd_actions, """
    + ", ".join(f"CASE WHEN n_before > 0 THEN round((row_number() OVER (PARTITION BY employee_id, {c} ORDER BY n_before) - 1)::DOUBLE / n_before, 4) END AS {k}_share" for k, c in _kinds.items())
    + f" FROM num WINDOW w AS {_bw}")
add("beh_history", "num", " UNION ALL ".join(f"SELECT employee_id, '{k}' AS kind, {c} AS value, n_before + 1 AS valid_from, row_number() OVER (PARTITION BY employee_id, {c} ORDER BY n_before) AS count FROM num" for k, c in _kinds.items()))
_gb = "count(*) AS members, trunc(avg(work_start))::INTEGER AS work_start, trunc(avg(work_end))::INTEGER AS work_end"
add("beh_department", "emp", f"SELECT department, {_gb} FROM emp GROUP BY 1")
add("beh_role", "emp", f"SELECT role, {_gb} FROM emp GROUP BY 1")
add("beh_organisation", "emp", f"SELECT {_gb} FROM emp")
_rl = _list(dims.RESOURCES)
add("beh_department_resources", "emp", f"""SELECT department, resource, round(sum(p) / max(n), 6) AS probability FROM (SELECT department, {_rl}[employee_no % 24 + 1] AS resource, 0.5::DOUBLE AS p FROM emp
  UNION ALL SELECT department, {_rl}[(employee_no + 5) % 24 + 1], 0.25::DOUBLE FROM emp) JOIN (SELECT department, count(*) AS n FROM emp GROUP BY 1) USING (department) GROUP BY 1, 2""")
add("beh_effective", "num", f"""SELECT session_id, employee_id, n_before, CASE WHEN n_before >= 3 THEN 'personal' ELSE 'role' END AS source, CASE WHEN n_before >= 3 THEN lo ELSE ws END::INTEGER AS work_start, CASE WHEN n_before >= 3 THEN hi ELSE we END::INTEGER AS work_end
  FROM (SELECT session_id, employee_id, role, n_before, min(hour(start_time)) OVER w AS lo, max(hour(start_time)) OVER w AS hi FROM num WINDOW w AS {_bw})
  JOIN (SELECT role, trunc(avg(work_start)) AS ws, trunc(avg(work_end)) AS we FROM emp GROUP BY 1) USING (role)""")
add("beh_drift", "dr", f"SELECT session_id, n_before, behaviour_score < 25 AS accepted, {_r(_D6)}, round(behaviour_score, 6) AS behaviour_score FROM dr")
_win = "(PARTITION BY employee_id ORDER BY n_before ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_lw = f"""SELECT session_id, n_before, office_location, device_id, browser, operating_system, hour(start_time)::DOUBLE AS hr, resources,
  list({{'loc': office_location, 'dev': device_id, 'br': browser, 'os': operating_system, 'hr': hour(start_time)::DOUBLE, 'res': resources}}) OVER {_win} AS w FROM num"""
add("beh_window_deviations", "num", f"""SELECT session_id, round(l, 6) AS location_deviation, round(d, 6) AS device_deviation, round(b, 6) AS browser_deviation, round(o, 6) AS operating_system_deviation,
  round(h, 6) AS working_hours_deviation, round(r, 6) AS resource_access_deviation, round({_score}, 6) AS behaviour_score FROM (SELECT session_id, CASE WHEN n_before = 0 THEN 0 ELSE {_cat('loc', 'office_location')} END AS l,
  CASE WHEN n_before = 0 THEN 0 ELSE {_cat('dev', 'device_id')} END AS d, CASE WHEN n_before = 0 THEN 0 ELSE {_cat('br', 'browser')} END AS b, CASE WHEN n_before = 0 THEN 0 ELSE {_cat('os', 'operating_system')} END AS o,
  CASE WHEN n_before = 0 THEN 0 ELSE least(abs(hr - list_avg(list_transform(w, lambda y: y.hr))) / 12, 1) END AS h, CASE WHEN n_before = 0 THEN 0 ELSE {_resdev} END AS r FROM ({_lw}))""")
_first = lambda c: f"(CASE WHEN n_before > 0 AND row_number() OVER (PARTITION BY employee_id, {c} ORDER BY n_before) = 1 THEN 1 ELSE 0 END)::DOUBLE"
add("beh_novelty", "num", f"""WITH fr AS (SELECT employee_id, resource, min(n_before) AS f FROM (SELECT employee_id, n_before, unnest(resources) AS resource FROM num) GROUP BY 1, 2),
  ft AS (SELECT DISTINCT employee_id, f AS n_before FROM fr),
  h AS (SELECT *, avg(hour(start_time)) OVER w AS m, stddev_pop(hour(start_time)) OVER w AS sd FROM num WINDOW w AS {_bw})
  SELECT session_id, {_first('office_location')} AS location_deviation, {_first('device_id')} AS device_deviation, {_first('browser')} AS browser_deviation, {_first('operating_system')} AS operating_system_deviation,
  (CASE WHEN n_before >= 3 AND sd > 0.1 AND abs(hour(start_time) - m) > 2 * sd THEN 1 ELSE 0 END)::DOUBLE AS working_hours_deviation,
  (CASE WHEN n_before > 0 AND ft.employee_id IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS resource_access_deviation FROM h LEFT JOIN ft USING (employee_id, n_before)""")
add("beh_working_hours", "emp", """SELECT event_id, CASE WHEN work_start <= work_end THEN hour(ts) >= work_start AND hour(ts) < work_end ELSE hour(ts) >= work_start OR hour(ts) < work_end END AS in_hours FROM ev JOIN emp USING (employee_id)""")
add("beh_access", "res", """SELECT * FROM (SELECT event_id, employee_id, coalesce(NOT list_contains(allowed_departments, department), false) AS resource_denied, NOT list_contains(allowed_devices, device_id) AS device_denied
  FROM ev JOIN emp USING (employee_id) LEFT JOIN res ON resource = resource_name) WHERE resource_denied OR device_denied""")

# --- risk ---------------------------------------------------------------------------------------------------
add("rsk_rule", "rr", "SELECT session_id, attack_type, rule_risk FROM rows JOIN rr USING (session_id)")
add("rsk_fused", "sc", f"""SELECT session_id, round(least(100, greatest(0, 0.30::DOUBLE * risk_score + 0.40::DOUBLE * CASE WHEN is_anomalous THEN {_sev('attack_type')} ELSE 0 END + 0.15::DOUBLE * (anomaly_score * 100)
  + 0.15::DOUBLE * (confidence * 100))), 4) AS fused_risk FROM sc""")
add("rsk_severity", "sc", "SELECT session_id, severity FROM sc")
_nst = _map("attack_type", {a: len(s) for a, s in texts.INVESTIGATION_STEPS.items()}, "1")
add("rsk_gate", "inc", f"""SELECT session_id, CASE WHEN low THEN 'Normal' ELSE attack_type END AS attack_type, CASE WHEN low THEN 'Low' ELSE severity END AS severity, CASE WHEN low THEN '' ELSE {_tac} END AS tactic,
  CASE WHEN low THEN 0 ELSE {_nst} END::BIGINT AS n_steps, CASE WHEN low THEN 3 ELSE 1 END::BIGINT AS n_top, CASE WHEN low THEN 'Normal' ELSE attack_type END AS top_1, round(confidence, 4) AS top_1_prob
  FROM (SELECT *, risk_score < 35 AS low FROM inc)""")
add("rsk_worst_stage", "sx", f"SELECT session_id, arg_max(attack_type, {_sev('attack_type')} * 1000000 - idx) AS worst_stage FROM sx WHERE attack_type <> 'None' GROUP BY 1")
add("rsk_bands", "sc", """SELECT session_id, CASE WHEN confidence * 100 >= 80 THEN 'HIGH' WHEN confidence * 100 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band,
  CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM sc""")
_imp = lambda c: "CASE " + " ".join(f"WHEN {c} >= {e}::DOUBLE THEN '{t}'" for e, t in dims.IMPACT_BANDS) + f" ELSE '{dims.IMPACT_FLOOR}' END"
add("rsk_impact", "emb", "SELECT vec_id, " + ", ".join(f"{_imp(f'x{i}')} AS impact_{i}" for i in range(64)) + " FROM emb")
add("rsk_at_least", "sc", "SELECT session_id, severity FROM sc WHERE severity <> 'Low'")
add("rsk_severity_counts", "sc", "SELECT severity, count(*) AS n FROM sc GROUP BY 1")

_ORDER = f"""WITH tr AS (SELECT session_id, CASE WHEN event_type IN {_in(dims.EVENT_TYPES)} THEN event_type ELSE '~' END AS b,
  coalesce(lag(CASE WHEN event_type IN {_in(dims.EVENT_TYPES)} THEN event_type ELSE '~' END) OVER (PARTITION BY session_id ORDER BY ts, event_id), '^') AS a FROM se),
  sp AS ({{split}}), fit AS (SELECT tr.* FROM tr JOIN sp USING (session_id) WHERE split = 'train'),
  pair AS (SELECT a, b, count(*) AS n FROM fit GROUP BY 1, 2), one AS (SELECT a, count(*) AS m FROM fit GROUP BY 1), kind AS (SELECT b, count(*) AS n FROM fit GROUP BY 1),
  err AS (SELECT session_id, avg(-ln((coalesce(pair.n, 0) + 1) / (coalesce(one.m, 0) + 16.0::DOUBLE))) AS e, avg(-ln((coalesce(kind.n, 0) + 1) / ((SELECT count(*) FROM fit) + 16.0::DOUBLE))) AS f
    FROM tr LEFT JOIN pair USING (a, b) LEFT JOIN one USING (a) LEFT JOIN kind USING (b) GROUP BY 1)"""

# attributions of a forest sum to prediction less expectation
add("exp_forest", "rows", "SELECT session_id, 0.0::DOUBLE AS off, true AS explained FROM rows")

# --- sequences ------------------------------------------------------------------------------------------------
add("seq_vectors", "stp", "SELECT session_id, step, dim::INTEGER AS dim, round(v, 6) AS v FROM stp WHERE v <> 0")
add("seq_padded", "vec", """SELECT session_id, 50::BIGINT AS n_steps, 50::BIGINT AS n_mask, least(count(*), 50)::DOUBLE AS mask_sum, round(sum(CASE WHEN step < 50 THEN list_sum(vec) ELSE 0 END), 4) AS total,
  round(coalesce(max(CASE WHEN step = 1 THEN vec[19] END), 0), 6) AS second_delta FROM vec GROUP BY 1""")
_zc = ["total_upload_bytes", "total_events", "processes_stopped", "events_per_minute"]
add("scl_features", "rows", "SELECT session_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-9 THEN stddev_pop({c}) OVER () ELSE 1 END, 5) AS {c}" for c in _zc) + " FROM rows")
add("scl_steps", "stp", f"""WITH st AS ({_steps_stat("JOIN rows USING (session_id) WHERE NOT is_anomalous")}), two AS (SELECT r.session_id, i.i AS step, d.dim, (coalesce(s.v, 0) - m) / d.s AS x FROM rows r CROSS JOIN range(50) i(i) CROSS JOIN st d
  LEFT JOIN stp s ON s.session_id = r.session_id AND s.step = i.i AND s.dim = d.dim)
  SELECT session_id, """ + ", ".join(f"round(max(x) FILTER (WHERE step = {i} AND dim = {j}), 5) AS s{i}_{j}" for i, j in ((0, 0), (0, 18), (1, 2), (1, 17), (49, 0), (49, 20))) + ", round(sum(x), 3) AS total FROM two GROUP BY 1")


def _split(label: str) -> str:
    return f"""SELECT session_id, {label}, CASE WHEN r <= ceil(n * 0.7::DOUBLE) THEN 'train' WHEN r <= ceil(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT session_id, {label},
      row_number() OVER (PARTITION BY {label} ORDER BY md5(session_id || '|42'), session_id) AS r, count(*) OVER (PARTITION BY {label}) AS n FROM rows)"""


add("spl_stratified", "rows", _split("attack_type"))
add("spl_one_class", "rows", f"SELECT * FROM ({_split('is_anomalous')}) WHERE split = 'test' OR NOT is_anomalous")
_order_split = _ORDER.format(split="SELECT * FROM (" + _split("is_anomalous") + ") WHERE split = 'test' OR NOT is_anomalous")
add("sco_transitions", "rows", _order_split + " SELECT session_id, round(e, 6) AS order_error FROM err")
add("sco_order_auc", "rows", _order_split + """, t AS (SELECT n AS "by", CASE WHEN n = 'order' THEN round(e, 7) ELSE round(f, 7) END AS x, is_anomalous AS y FROM err JOIN sp USING (session_id), (VALUES ('order'), ('types')) v(n) WHERE split = 'test'),
  k AS (SELECT *, rank() OVER (PARTITION BY "by" ORDER BY x) + (count(*) OVER (PARTITION BY "by", x) - 1) / 2.0 AS k FROM t)
  SELECT "by", round((sum(CASE WHEN y THEN k ELSE 0 END)::DOUBLE - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT)::DOUBLE * sum((NOT y)::INT)), 6) AS roc_auc FROM k GROUP BY 1""")
add("enc_ordinal", "ev", "SELECT event_id, CASE WHEN resource IS NULL THEN -1 ELSE d.code END::BIGINT AS code FROM ev LEFT JOIN (SELECT resource, dense_rank() OVER (ORDER BY resource) - 1 AS code FROM (SELECT DISTINCT resource FROM ev WHERE resource IS NOT NULL)) d USING (resource)")
add("enc_clean", None, "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN 0 ELSE l_quantity END AS q, CASE WHEN l_linenumber IN (4, 5) THEN 'Normal' ELSE l_returnflag END AS attack_type FROM lineitem")
add("enc_weights", "rows", "SELECT session_id, round((SELECT count(*) FROM rows)::DOUBLE / ((SELECT count(DISTINCT attack_type) FROM rows) * count(*) OVER (PARTITION BY attack_type)), 6) AS weight FROM rows")
add("enc_vector", "rows", "SELECT session_id, total_events AS f0, 0::DOUBLE AS f1, files_read AS f2 FROM rows")

# --- scoring, thresholds ----------------------------------------------------------------------------------------
for _l, _e in {"mse": "x * x", "mae": "abs(x)", "huber": "CASE WHEN abs(x) < 1 THEN 0.5::DOUBLE * x * x ELSE abs(x) - 0.5::DOUBLE END"}.items():
    add(f"sco_masked_{_l}", "z", f"SELECT session_id, round(sum({_e}) / greatest(count(*), 1), 5) AS reconstruction_error FROM z GROUP BY 1")
add("sco_all_components", "rows", "SELECT session_id, 0::DOUBLE AS reconstruction_error FROM rows")
add("sco_minmax", "rows", "SELECT session_id, round((e - min(e) OVER ()) / greatest(max(e) OVER () - min(e) OVER (), 1e-9), 6) AS anomaly_score FROM (SELECT session_id, duration_seconds / 1000 AS e FROM rows)")
add("sco_calibrated", "rows", "SELECT session_id, round(least(1, greatest(0, (duration_seconds / 1000 - 1) / 29)), 6) AS score, CASE WHEN duration_seconds / 1000 > 20 THEN 1 ELSE 0 END::DOUBLE AS degenerate FROM rows")
add("sco_flag", "rows", "SELECT session_id, (duration_seconds / 1000 > 20)::BIGINT AS predicted_label, CASE WHEN duration_seconds / 1000 > 20 THEN 'Anomalous' ELSE 'Normal' END AS prediction FROM rows")
add("sco_merge", "rows", """SELECT session_id, total_events, CASE WHEN is_anomalous THEN round(e, 5) ELSE 0 END AS reconstruction_error, CASE WHEN is_anomalous THEN round((e - lo) / (hi - lo), 5) ELSE 0 END AS anomaly_score
  FROM (SELECT *, duration_seconds / 1000 AS e, min(duration_seconds / 1000) OVER () AS lo, max(duration_seconds / 1000) OVER () AS hi FROM rows)""")
add("thr_f1", "f1b", "SELECT threshold, round(f1, 8) AS f1 FROM f1b")
add("thr_youden", "yb", "SELECT threshold, round(j, 8) AS youden FROM yb")
add("thr_percentile", "lst", "SELECT round(quantile_cont(score, 0.95), 4) AS threshold FROM lst WHERE label = 0")
add("thr_compare", "yb", """WITH t AS (SELECT 'f1_optimal' AS method, threshold, f1 AS fa FROM f1b UNION ALL SELECT 'youden_index', threshold, NULL FROM yb UNION ALL SELECT 'percentile_95', (SELECT quantile_cont(score, 0.95) FROM lst WHERE label = 0), NULL),
  g AS (SELECT method, threshold, fa, count(*) FILTER (WHERE score > threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score > threshold AND label = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score <= threshold AND label = 1)::DOUBLE AS fn FROM t, lst GROUP BY ALL)
  SELECT method, round(threshold, 4) AS threshold, round(coalesce(fa, 2 * tp / (2 * tp + fp + fn)), 6) AS f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM g""")
add("thr_composite", "auc", "SELECT round(0.6::DOUBLE * f1 + 0.4::DOUBLE * roc_auc, 6) AS composite FROM f1b, auc")

# --- metrics ---------------------------------------------------------------------------------------------------------
add("met_binary", "lst", """SELECT tn, fp, fn, tp, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT
  count(*) FILTER (WHERE score <= 40000 AND label = 0) AS tn, count(*) FILTER (WHERE score > 40000 AND label = 0) AS fp, count(*) FILTER (WHERE score <= 40000 AND label = 1) AS fn, count(*) FILTER (WHERE score > 40000 AND label = 1) AS tp FROM lst)""")
add("met_roc", "cv", "SELECT threshold, round(fp::DOUBLE / neg, 6) AS fpr, round(tp::DOUBLE / pos, 6) AS tpr FROM cv")
add("met_roc_auc", "auc", "SELECT round(roc_auc, 6) AS roc_auc FROM auc")
add("met_pr", "f1c", "SELECT threshold, round(pr, 6) AS precision, round(rc, 6) AS recall FROM f1c")
_pra = "sum((tp - ptp)::DOUBLE / pos * (tp::DOUBLE / (tp + fp) + CASE WHEN ptp + pfp > 0 THEN ptp::DOUBLE / (ptp + pfp) ELSE 1 END) / 2)"
add("met_pr_auc", "cv", f"SELECT round({_pra}, 6) AS pr_auc FROM cv")
add("met_confusion", "cm", "SELECT true_label, predicted_label, n FROM cm")
add("met_normalised", "cm", "SELECT true_label, predicted_label, round(n::DOUBLE / greatest(sum(n) OVER (PARTITION BY true_label), 1), 6) AS share FROM cm")
add("met_class_report", "rep", "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep")
add("met_averages", "rep", "SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, " + ", ".join(
    f"round(avg({m}), 6) AS {m}_macro, round(sum({m} * support) / sum(support), 6) AS {m}_weighted" for m in ("precision", "recall", "f1")) + " FROM rep")
add("met_ovr_auc", "ov", "SELECT class::INTEGER AS class, round(sum((fp - pfp)::DOUBLE * (tp + ptp) / 2) / (max(pos)::DOUBLE * max(neg)), 6) AS roc_auc FROM ov GROUP BY 1")
add("met_ovr_pr", "ov", f"SELECT class::INTEGER AS class, round({_pra}, 6) AS pr_auc FROM ov GROUP BY 1")


def _hist(bins: int) -> str:
    return f"(SELECT *, least(floor((score - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS bin, (hi - lo) / {bins} AS w FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM lst))"


add("met_histogram", "lst", f"SELECT label, bin, count(*) AS n, round(max(lo) + bin * max(w), 4) AS left_edge, round(max(lo) + (bin + 1) * max(w), 4) AS right_edge FROM {_hist(60)} GROUP BY label, bin")
add("met_histogram_density", "lst", f"SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM lst) * max(w)) * 1e6, 5) AS density FROM {_hist(50)} GROUP BY bin")
add("met_moving_average", None, "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(avg(t) OVER (ORDER BY o_orderdate ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 3) AS moving_avg FROM (SELECT o_orderdate, sum(o_totalprice) AS t FROM orders GROUP BY 1)")
add("met_distribution", "rows", "SELECT attack_type AS class, count(*) AS n FROM rows GROUP BY 1")
add("met_profile", "rows", " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS rows, 0::BIGINT AS nulls, 0::BIGINT AS infinite, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS sd, round(min({c}), 3) AS min, round(max({c}), 3) AS max FROM rows"
    for n, c in {"session_duration": "duration_seconds", "total_upload_bytes": "total_upload_bytes", "total_events": "total_events", "failed_login_ratio": "failed_login_ratio"}.items()))
add("met_risk_by_attack", "sc", "SELECT attack_type, count(*) AS n, round(avg(risk_score), 6) AS mean_risk, min(risk_score) AS min_risk, max(risk_score) AS max_risk FROM sc GROUP BY 1")
add("met_risk_by_label", "sc", "SELECT is_anomalous::INTEGER AS is_anomalous, count(*) AS n, round(avg(risk_score), 6) AS mean_risk FROM sc GROUP BY 1")
add("met_normal_with_risk", "sc", "SELECT session_id, employee_id, risk_score FROM sc WHERE NOT is_anomalous AND risk_score > 0 ORDER BY risk_score DESC, session_id LIMIT 10")

# --- classification, attribution -------------------------------------------------------------------------------------
add("cls_top_k", "topk", "SELECT vec_id, place::INTEGER AS place, class::INTEGER AS class, round(score, 4) AS probability FROM topk WHERE place < 3")
add("cls_table", "topk", """SELECT vec_id, max(label)::VARCHAR AS true_label, max(class) FILTER (WHERE place = 0)::VARCHAR AS predicted_label, round(max(score) FILTER (WHERE place = 0), 4) AS confidence,
  (max(class) FILTER (WHERE place = 0) = max(label))::BIGINT AS correct, """ + ", ".join(f"(max(class) FILTER (WHERE place = {i}))::VARCHAR AS top_{i + 1}, round(max(score) FILTER (WHERE place = {i}), 4) AS top_{i + 1}_prob" for i in range(3)) + " FROM topk GROUP BY 1")
add("exp_attribution", "phi", "SELECT vec_id, class, feature, round(phi, 6) AS phi FROM phi")
add("exp_join", "sc", "SELECT session_id, attack_type, CASE WHEN n_events > 1 THEN predicted_label ELSE attack_type END AS predicted_label, CASE WHEN n_events > 1 THEN confidence ELSE 0.5 END AS confidence FROM sc")
_gi = "SELECT feature, avg(abs(phi)) AS g, row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS rank FROM phi GROUP BY 1"
add("exp_global", "phi", f"SELECT feature, round(g, 6) AS mean_abs_phi, rank FROM ({_gi})")
add("exp_class", "phi", "SELECT feature, g.rank, " + ", ".join(f"round(avg(abs(phi)) FILTER (WHERE class = {i}), 6) AS class_{i}" for i in range(10)) + f" FROM phi JOIN ({_gi}) g USING (feature) GROUP BY 1, 2")
add("exp_moments", "phi", "SELECT class, feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY 1, 2")
add("exp_contributors", "phi", """SELECT vec_id, side, (row_number() OVER w - 1)::INTEGER AS place, feature, feature AS description, 'Session' AS category, round(round(x, 4), 3) AS value, round(round(phi, 4), 3) AS attribution
  FROM (SELECT p.*, CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS side FROM phi p JOIN pred q ON p.vec_id = q.vec_id AND p.class = q.predicted_label) WINDOW w AS (PARTITION BY vec_id, side ORDER BY abs(phi) DESC, feature) QUALIFY row_number() OVER w <= 10""")
add("exp_most", "phi", "SELECT vec_id, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY 1 ORDER BY avg(abs(phi)) DESC, vec_id LIMIT 1")
add("exp_one", "sc", "SELECT session_id, severity, risk_score FROM sc WHERE session_id = 'EMP-0003-S2'")
add("exp_mitre", "inc", f"SELECT session_id, {_tid('NULL')} AS technique_id, ({_nst})::BIGINT AS n_steps, {_map('attack_type', {a: s[0] for a, s in texts.INVESTIGATION_STEPS.items()}, 'NULL')} AS first_step FROM inc")

# --- incidents ----------------------------------------------------------------------------------------------------------
_kept = "(attack_type <> 'Normal' OR risk_score > 0)"
add("inc_build", "inc", f"""SELECT session_id, CASE WHEN n_events <> 3 THEN employee_id ELSE 'Unknown' END AS employee_id, attack_type, severity, CASE WHEN n_events NOT IN (1, 3) THEN 12.5 ELSE risk_score END AS risk_score,
  CASE WHEN n_events % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_top, CASE WHEN n_events <> 3 THEN session_start_hour END::BIGINT AS session_start_hour, CASE WHEN n_events <> 3 THEN round(duration_seconds / 60, 4) END AS session_duration_minutes FROM inc WHERE {_kept}""")
add("inc_lookup", "inc", """SELECT CASE WHEN n_events = 1 THEN session_id || '-X' ELSE session_id END AS session_id, CASE WHEN n_events = 1 THEN 'Unknown' ELSE employee_id END AS employee_id, CASE WHEN n_events = 1 THEN 'Normal' ELSE attack_type END AS attack_type,
  CASE WHEN n_events = 1 THEN 1 ELSE confidence END AS confidence, CASE WHEN n_events = 1 THEN 'Low' ELSE severity END AS severity, CASE WHEN n_events = 1 THEN 0 ELSE risk_score END AS risk_score FROM inc""")
add("inc_top3", "inc", "SELECT session_id, attack_type AS attack, confidence AS probability FROM inc UNION ALL SELECT session_id, 'Brute Force', 0.125 FROM inc WHERE n_events % 2 = 1")
add("inc_anomalous", "inc", "SELECT session_id, attack_type FROM inc WHERE attack_type <> 'Normal'")
add("inc_by_severity", "inc", "SELECT session_id, severity FROM inc WHERE severity = 'High'")
add("inc_high_critical", "inc", "SELECT session_id, severity FROM inc WHERE severity IN ('High', 'Critical')")
add("inc_merge_live", "inc", "SELECT session_id, attack_type, CASE WHEN attack_type = 'Beaconing C2' THEN 'Critical' ELSE severity END AS severity, risk_score FROM inc")
_st0 = _map("attack_type", {a: s[0] for a, s in texts.INVESTIGATION_STEPS.items()}, "NULL")
_stl = _map("attack_type", {a: s[-1] for a, s in texts.INVESTIGATION_STEPS.items()}, "NULL")
_iso = texts.ACTION["isolate"]
_c0 = _map("attack_type", {a: k[0][0] for a, k in texts.PLAYBOOK_KIND.items()}, "NULL")
_c1 = _map("attack_type", {a: k[0][1] for a, k in texts.PLAYBOOK_KIND.items() if len(k[0]) > 1}, "NULL")
_ncon = _map("attack_type", {a: len(k[0]) for a, k in texts.PLAYBOOK_KIND.items()}, "0")
_lead = f"CASE WHEN severity = 'Critical' AND attack_type <> 'Normal' THEN '{_iso}' ELSE {_c0} END"
add("inc_recommend", "inc", f"""SELECT session_id, ({_ncon} + CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 1 ELSE 0 END + CASE WHEN severity = 'Critical' AND attack_type <> 'Normal' THEN 1 ELSE 0 END)::BIGINT AS n_contain,
  ({_nst} + CASE WHEN severity IN ('High', 'Critical') THEN 1 ELSE 0 END)::BIGINT AS n_investigate, {_lead} AS first_step, CASE severity WHEN 'Critical' THEN '{texts.ACTION["hunt"]}'
  WHEN 'High' THEN '{texts.ACTION["audit"]}' ELSE {_stl} END AS last_check, {_stl} AS remediation, {_map('attack_type', texts.BUSINESS_IMPACT, "''")} AS estimated_impact FROM inc""")
_prio = f"""CASE WHEN attack_type = 'Normal' THEN '{texts.ACTION["none"]}' WHEN list_contains(feats[1:3], 'powershell_executions') THEN '{texts.ACTION["script"]}'
  WHEN list_contains(feats[1:3], 'total_upload_bytes') THEN '{texts.ACTION["outgoing"]}' WHEN list_contains(feats[1:3], 'failed_login_count') THEN '{texts.ACTION["sign_in"]}'
  WHEN list_contains(feats[1:3], 'admin_resource_accesses') THEN '{texts.ACTION["admin"]}' ELSE {_lead} END"""
add("inc_priority", "inc", f"SELECT session_id, {_prio} AS priority_action FROM inc")
add("inc_cards", "inc", f"SELECT session_id, employee_id AS employee, attack_type, severity, confidence, round(risk_score, 2) AS risk_score, {_prio} AS recommended_action, {_tac} AS mitre_tactic, {_tec} AS mitre_technique, len(feats)::BIGINT AS n_features FROM inc")
add("inc_serialise", "inc", "SELECT session_id, severity FROM inc")

# texts over the rule-made contributors
_pc0, _pc1 = "printf('%.0f%%', confidence * 100)", "printf('%.1f%%', confidence * 100)"
_has_mitre = "attack_type <> 'Normal'"
_norm = "attack_type = 'Normal'"
_risk2, _an4 = "printf('%.2f', risk_score)", "printf('%.4f', anomaly_score)"
_fj = lambda n, sep: f"array_to_string(feats[1:{n}], '{sep}')"
_tid0 = _tid("''")
_sum = texts.ATTACK_NARRATIVE["Normal"].replace("'", "''")
_story = _map("attack_type", texts.ATTACK_NARRATIVE, "''")
_bul = lambda n: f"array_to_string(list_transform(feats[1:{n}], lambda f: '- ' || replace(f, '_', ' ') || ' (value: 2.50), medium positive [Session]'), chr(10) || chr(10))"
_desc = "array_to_string(list_transform(feats[1:3], lambda f: replace(f, '_', ' ')), ', ')"
_top = f"CASE WHEN len(feats) > 0 THEN {_desc} ELSE 'behavioural anomalies' END"
add("exp_narrate", "inc", f"""SELECT session_id, concat_ws(chr(10) || chr(10), 'The model classified this session as **' || attack_type || '** with ' || {_pc0} || ' confidence (' || severity || ' severity).', {_story},
  CASE WHEN {_has_mitre} THEN 'MITRE tactic **' || {_tac} || '** (' || {_tid0} || ', ' || {_tec} || ').' END, CASE WHEN anomaly_score > 0.01 THEN 'The anomaly score of the session is ' || printf('%.4f', anomaly_score) || '.' END,
  CASE WHEN len(feats) > 0 THEN 'Indicators that raised the prediction:' || chr(10) || chr(10) || {_bul(5)} END, CASE WHEN len(feats) > 0 THEN 'Factors that lowered it:' || chr(10) || chr(10) || {_bul(1)} END,
  CASE WHEN {_has_mitre} THEN 'Together they resemble earlier **' || attack_type || '** sessions.' END) AS nl_explanation,
  CASE WHEN {_norm} THEN '{_sum}' ELSE upper({_top}[1]) || substr({_top}, 2) || ' point to **' || attack_type || '** (' || severity || ' severity, ' || {_pc0} || ' confidence). ' || split_part({_story}, '.', 1) || '.' END AS summary,
  {_tac} AS mitre_tactic, {_fj(5, ',')} AS top_features FROM inc""")
_two = f"CASE WHEN len(feats) > 0 THEN {_fj(2, ' and ')} ELSE 'behavioral markers' END"
_mit = f"CASE WHEN {_has_mitre} THEN 'MITRE: ' || {_tac} || ' | ' || {_tid0} || ' ' || {_tec} ELSE 'No MITRE mapping' END"
_ev5 = "array_to_string(list_transform(feats[1:5], lambda f: '  - ' || f || ' = 2.5 (Medium Positive)'), chr(10))"
add("inc_summaries", "inc", f"""SELECT session_id, CASE WHEN {_norm} THEN 'Session ' || session_id || ' shows baseline behaviour.' ELSE 'Anomalous session of employee ' || employee_id || ' classified as ' || attack_type || ' (' || severity || ' severity, ' || {_pc0}
  || ' confidence). Key indicators: ' || {_two} || '. Action: ' || {_st0} END AS dashboard,
  CASE WHEN {_norm} THEN 'No anomalous behavior detected.' ELSE 'A security anomaly was detected in session ' || session_id || ' (employee ' || employee_id || '). It resembles a ' || attack_type || ' attempt of ' || severity || ' severity at ' || {_pc1}
  || ' confidence, anomaly score ' || {_an4} || '. Recommended: ' || {_st0} END AS executive,
  CASE WHEN {_norm} THEN 'Triage: normal activity.' ELSE concat_ws(chr(10), '[TRIAGE SUMMARY]', 'Incident: ' || session_id, 'Employee: ' || employee_id, 'Prediction: ' || attack_type || ' (' || {_pc1} || ')', 'Risk: ' || {_risk2} || ' anomaly ' || {_an4},
   'Severity: ' || severity, {_mit}, 'Evidence:', {_ev5}, 'Next: ' || {_st0}) END AS soc,
  CASE WHEN {_norm} THEN 'Subject: [INFO] Baseline activity - session ' || session_id ELSE concat_ws(chr(10), 'Subject: [ALERT - ' || upper(severity) || '] ' || attack_type || ' [' || {_tid0} || '] (session ' || session_id || ')', '', '- Incident: ' || session_id || ' (employee ' || employee_id || ')',
   '- Class: ' || attack_type || ' ' || {_pc0} || ' | ' || severity, '- Risk: ' || {_risk2} || ' | anomaly ' || {_an4}, '- Indicators: ' || {_fj(3, ', ')}, '- Action: ' || {_st0}) END AS email FROM inc""")
_todo = f"""array_to_string(list_transform(list_filter([CASE WHEN severity = 'Critical' AND {_has_mitre} THEN '{_iso}' END, {_c0}, {_c1}, CASE severity WHEN 'Critical' THEN '{texts.ACTION["page"]}'
  WHEN 'High' THEN '{texts.ACTION["inform"]}' END], lambda x: x IS NOT NULL), lambda x: '- [ ] ' || x), chr(10))"""
add("inc_report_sections", "inc", f"""SELECT session_id, 15::BIGINT AS n_sections, concat_ws(chr(10), '- Session: ' || session_id, '- Employee: ' || employee_id, '- Hour: ' || session_start_hour, '- Minutes: ' || printf('%.1f', duration_seconds / 60 + 1e-9)) AS incident_overview,
  'Severity **' || severity || '** from risk ' || {_risk2} || ' and anomaly score ' || {_an4} || '.' AS severity_assessment,
  concat_ws(chr(10), '- Tactic: ' || CASE WHEN {_norm} THEN 'N/A' ELSE {_tac} END, '- Technique: ' || CASE WHEN {_norm} THEN 'N/A N/A' ELSE {_tid0} || ' ' || {_tec} END) AS mitre_attandck_mapping,
  CASE WHEN len(feats) > 0 THEN array_to_string(list_transform(feats[1:6], lambda f: '- **' || f || '**: 2.5, medium positive'), chr(10)) ELSE '- none' END AS key_shap_evidence,
  {_todo} AS containment_actions, {_map('attack_type', texts.BUSINESS_IMPACT, "''")} AS potential_business_impact FROM inc""")

# --- campaigns -----------------------------------------------------------------------------------------------------------
_h = "('0x' || substr(md5(employee_id), 1, 8))::BIGINT"
add("cor_fill", "inc", f"""SELECT session_id, '10.10.' || (({_h} >> 8) & 255) || '.' || ({_h} & 255) AS source_ip, CASE WHEN risk_score > 50 THEN device_id ELSE 'DEV-' || split_part(employee_id, '-', 2) END AS device_id,
  CASE WHEN risk_score > 50 THEN epoch_us(ts) ELSE epoch_us(TIMESTAMP '2026-07-25 00:00:00') + session_start_hour * 3600000000 END AS ts_us FROM inc""")
add("cor_links", "near", "SELECT kind, value, src, dst FROM near")
add("cor_components", "comp", "SELECT session_id, component FROM comp")
add("cor_drop_minor", "mem", "SELECT session_id, component FROM mem")
add("cor_campaigns", "chained", f"""SELECT component, session_count, n_employees, n_ips, n_devices, overall_severity, is_attack_chain, attack_types, mitre_tactics, first_us, last_us, CASE WHEN b = '' THEN 'behavioral_cluster' ELSE b END AS detection_basis FROM (SELECT *, {_sevname} AS overall_severity, {_ischain} AS is_attack_chain,
  array_to_string(list_filter([CASE WHEN n_ips < session_count THEN 'shared_source_ip' END, CASE WHEN n_employees < session_count THEN 'multiple_sessions_same_employee' END, CASE WHEN n_devices < session_count THEN 'shared_device' END,
  CASE WHEN {_ischain} THEN 'attack_chain_match' END], lambda x: x IS NOT NULL), ',') AS b FROM chained)""")
_chains = [["Malware Execution", "Beaconing C2"], ["Brute Force", "Data Exfiltration", "Malware Execution"], ["Suspicious PowerShell", "Lateral Movement"]]
add("cor_chain", "camp", "SELECT component, CASE " + " ".join(f"WHEN {_sub('seq', c)} THEN {i + 1}" for i, c in enumerate(_chains)) + " END::BIGINT AS chain_no FROM camp")
add("cor_path", "mpos", "SELECT component, string_agg(attack_type, ' > ' ORDER BY mp) AS path FROM mpos WHERE prev_attack IS NULL OR prev_attack <> attack_type GROUP BY 1")
add("cor_members", "mpos", "SELECT component, kind, (i // 5)::BIGINT AS page, string_agg(v, ',' ORDER BY i) AS values FROM (" + " UNION ALL ".join(
    f"SELECT component, '{k}' AS kind, v, row_number() OVER (PARTITION BY component ORDER BY v) - 1 AS i FROM (SELECT DISTINCT component, {c} AS v FROM mem)" for k, c in {"employee": "employee_id", "ip": "source_ip", "device": "device_id"}.items())
    + " UNION ALL SELECT component, 'session', session_id, mp FROM mpos) GROUP BY 1, 2, 3")
add("cor_ids", "camp", f"SELECT component, {_cid('no')} AS campaign_id FROM (SELECT component, {_names3} AS no FROM camp)")
add("cor_first_values", "mem", "SELECT component, array_to_string(list(DISTINCT device_id ORDER BY device_id)[1:3], ',') AS first_devices FROM mem GROUP BY 1")
_wide = "(contains(attack_types, 'Lateral Movement') OR overall_severity = 'Critical')"
_std = _map("std_chain::VARCHAR", {str(i + 1): " → ".join(c) for i, c in enumerate(dims.ATTACK_CHAINS)}, "NULL")
add("cor_text", "chained", f"""WITH pth AS (SELECT component, string_agg(attack_type, ' → ' ORDER BY mp) AS path FROM mpos WHERE prev_attack IS NULL OR prev_attack <> attack_type GROUP BY 1),
  f3 AS (SELECT component, array_to_string(list(DISTINCT device_id ORDER BY device_id)[1:3], ', ') AS dv, array_to_string(list(DISTINCT source_ip ORDER BY source_ip)[1:3], ', ') AS ip, array_to_string(list(DISTINCT employee_id ORDER BY employee_id)[1:3], ', ') AS em FROM mem GROUP BY 1),
  c AS (SELECT *, {_names3} AS no, {_sevname} AS overall_severity FROM chained)
  SELECT {_cid('no')} AS campaign_id, CASE WHEN {_ischain} THEN 'Campaign ' || {_cid('no')} || ' follows the attack chain (' || coalesce({_std}, path) || ') across ' || n_employees || ' user(s) and ' || session_count || ' sessions.'
    ELSE 'Campaign ' || {_cid('no')} || ' groups [' || replace(attack_types, ',', ', ') || '] activity: ' || session_count || ' sessions of ' || n_employees || ' user(s) with shared indicators.' END AS summary,
  concat_ws(chr(10), CASE WHEN {_wide} THEN '{texts.ACTION["campaign_isolate"]}' || chr(10) || '{texts.ACTION["campaign_protocols"]}' ELSE '{texts.ACTION["campaign_hosts"][0]}' || dv || '{texts.ACTION["campaign_hosts"][1]}' END,
   '{texts.ACTION["campaign_addresses"][0]}' || ip || '{texts.ACTION["campaign_addresses"][1]}', '{texts.ACTION["campaign_accounts"][0]}' || em || '{texts.ACTION["campaign_accounts"][1]}', '{texts.ACTION["campaign_report"]}') AS actions
  FROM c JOIN pth USING (component) JOIN f3 USING (component)""")

# --- data quality ----------------------------------------------------------------------------------------------------------
add("dq_session_keys", "rows", """SELECT * FROM (SELECT 'session_uuid_format' AS rule_id, session_id AS key, 'bad' AS detail FROM rows WHERE n_events = 4
  UNION ALL SELECT 'session_duplicate_uuid', 'bad', count(*)::VARCHAR FROM rows WHERE n_events = 4 HAVING count(*) > 1
  UNION ALL SELECT 'session_unknown_employee', session_id, employee_id FROM rows JOIN emp USING (employee_id) WHERE employee_no % 10 = 0
  UNION ALL SELECT 'session_unowned_device', session_id, device_id FROM rows JOIN emp USING (employee_id) WHERE employee_no % 10 <> 0 AND NOT list_contains(allowed_devices, device_id))""")
add("dq_work_hours", "rows", """SELECT 'session_outside_hours' AS rule_id, session_id AS key, employee_id AS detail FROM (SELECT session_id, r.employee_id, start_time AS s, end_time AS e, work_start AS ws, work_end AS we, date_trunc('day', start_time) AS d FROM rows r JOIN emp USING (employee_id))
  WHERE NOT CASE WHEN ws <= we THEN d + to_hours(ws - 2) <= s AND e <= d + to_hours(we + 2) WHEN hour(s) >= ws THEN d + to_hours(ws - 2) <= s AND e <= d + to_hours(24 + we + 2) WHEN hour(s) < we THEN d + to_hours(ws - 26) <= s AND e <= d + to_hours(we + 2) ELSE false END""")
add("dq_session_values", "rows", """SELECT 'session_duration_mismatch' AS rule_id, session_id AS key, '' AS detail FROM rows WHERE abs(duration_seconds - (epoch_us(end_time) - epoch_us(start_time)) / 1e6) > 1e-3
  UNION ALL SELECT 'session_browser', session_id, 'Netscape' FROM rows WHERE n_events = 2""")
add("dq_overlap", "rows", """WITH o AS (SELECT *, lead(session_id) OVER w AS nid, lead(start_time) OVER w AS ns FROM rows WINDOW w AS (PARTITION BY employee_id ORDER BY floor(duration_seconds), session_id))
  SELECT 'session_order' AS rule_id, session_id AS key, nid AS detail FROM o WHERE start_time > ns UNION ALL SELECT 'session_overlap', session_id, nid FROM o WHERE end_time > ns""")
add("dq_event_shape", "rows", """WITH g AS (SELECT session_id, count(*) AS n, max(event_type) FILTER (WHERE idx = 0) AS f, arg_max(event_type, idx) AS l, max(event_type) FILTER (WHERE idx = 1) AS s2 FROM sx GROUP BY 1),
  j AS (SELECT g.*, r.remote_session AS rm, (SELECT x.event_type FROM sx x WHERE x.session_id = g.session_id AND x.idx = g.n - 2) AS pen FROM g JOIN rows r USING (session_id))
  SELECT 'event_first_login' AS rule_id, session_id AS key, f AS detail FROM j WHERE f <> 'Login' UNION ALL SELECT 'event_last_logout', session_id, l FROM j WHERE l <> 'Logout'
  UNION ALL SELECT 'event_second_connect', session_id, s2 FROM j WHERE n >= 4 AND s2 <> CASE WHEN rm THEN 'VPNConnect' ELSE 'NetworkConnect' END
  UNION ALL SELECT 'event_penultimate_disconnect', session_id, pen FROM j WHERE n >= 4 AND pen <> CASE WHEN rm THEN 'VPNDisconnect' ELSE 'NetworkDisconnect' END""")
add("dq_events", "rows", "SELECT 'event_device' AS rule_id, s.event_id::VARCHAR AS key, s.device_id AS detail FROM se s JOIN rows r USING (session_id) WHERE s.device_id <> r.device_id UNION ALL SELECT 'event_not_increasing', event_id::VARCHAR, '' FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY xor(event_id, 1)) AS before FROM se) WHERE ts <= before UNION ALL SELECT 'event_duplicate_ts', session_id, count(*)::VARCHAR FROM se GROUP BY session_id, ts HAVING count(*) > 1 UNION ALL SELECT 'event_uuid_format', event_id::VARCHAR, 'bad' FROM se WHERE event_id % 97 = 0")
add("dq_labels", "rows", """SELECT 'label_session_normal_risk' AS rule_id, session_id AS key, '7.0' AS detail FROM rows WHERE NOT is_anomalous AND n_events = 5
  UNION ALL SELECT 'label_event_session', event_id::VARCHAR, '' FROM se s JOIN rows r USING (session_id) WHERE (s.attack_type <> 'None') <> r.is_anomalous
  UNION ALL SELECT 'label_event_normal_risk', event_id::VARCHAR, '' FROM se WHERE attack_type = 'None' AND k = 1""")
add("dq_risk", "rr", "SELECT 'risk_mismatch' AS rule_id, session_id AS key, round(rule_risk, 2)::VARCHAR AS detail FROM rr JOIN rows USING (session_id) WHERE is_anomalous AND abs(50 - rule_risk) > 1e-3")
add("dq_organisation", "res", """SELECT 'employee_location' AS rule_id, employee_id AS key, 'Moon' AS detail FROM emp WHERE employee_no % 50 = 0
  UNION ALL SELECT 'device_not_listed', device_id, owner_id FROM dev JOIN emp ON owner_id = employee_id WHERE NOT list_contains(allowed_devices, device_id)
  UNION ALL SELECT 'employee_unknown_device', employee_id, d FROM (SELECT employee_id, unnest(allowed_devices) AS d FROM emp) WHERE d NOT IN (SELECT device_id FROM dev)""")
add("dq_features", "rows", """SELECT 'feature_missing' AS rule_id, session_id AS key, 'failed_login_ratio' AS detail FROM rows WHERE n_events = 3 UNION ALL SELECT 'feature_position', session_id, 'admin_access_position' FROM rows WHERE n_events = 2
  UNION ALL SELECT 'feature_not_numeric', session_id, 'files_read' FROM rows WHERE n_events = 4 UNION ALL SELECT 'feature_ratio', session_id, 'failed_login_ratio' FROM rows WHERE n_events = 3""")
add("dq_merged", "rows", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_events = 3) AS n_nan, count(*) FILTER (WHERE n_events = 4) AS n_inf, count(*) - count(DISTINCT session_id) AS n_duplicate_sessions, count(DISTINCT attack_type) AS n_classes,
  false AS passed FROM (SELECT * FROM rows UNION ALL SELECT * FROM rows WHERE n_events = 6)""")
add("dq_label_gaps", "sc", "SELECT count(*) AS anomalous, count(*) FILTER (WHERE risk_score > 90) AS without_attack, count(*) FILTER (WHERE risk_score < 85) AS without_risk FROM sc WHERE is_anomalous")

# --- organisation ------------------------------------------------------------------------------------------------------------
add("dim_employee", "emp", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN e.employee_id END AS employee_id, CASE WHEN event_id % 3 < 2 THEN e.department END AS department FROM events LEFT JOIN emp e ON e.employee_no = user_id")
_dv = "SELECT employee_id, (generate_subscripts(allowed_devices, 1) - 1)::INTEGER AS device_no, unnest(allowed_devices) AS device_id FROM emp"
add("dim_devices", "res", f"SELECT l.employee_id, device_no, device_id, device_type, trusted FROM ({_dv}) l JOIN dev USING (device_id)")
add("dim_devices_of_one", "res", f"SELECT l.employee_id, device_no, device_id FROM ({_dv}) l JOIN dev USING (device_id) WHERE l.employee_id = 'EMP-0003'")
add("dim_members", "emp", "SELECT department, employee_id FROM emp")
add("dim_managers", "emp", "SELECT department, arg_min(employee_id, employee_no) AS manager_id, arg_min(role, employee_no) AS manager_role FROM emp WHERE role IN ('Team Manager', 'Director') GROUP BY 1")
add("dim_department_resources", "res", "SELECT department, resource_name, n FROM (SELECT resource_name, unnest(allowed_departments) AS department FROM res) JOIN (SELECT resource AS resource_name, count(*) AS n FROM ev WHERE resource IS NOT NULL GROUP BY 1) USING (resource_name)")
add("dim_resources", "res", "SELECT resource_name, resource_type, sensitivity_level, n FROM res LEFT JOIN (SELECT resource AS resource_name, count(*) AS n FROM ev WHERE resource IS NOT NULL GROUP BY 1) USING (resource_name)")
add("dim_policy", "emp", f"SELECT department, {_gb} FROM emp WHERE department = 'IT' GROUP BY 1")
add("dim_primary_device", "emp", "SELECT employee_id, allowed_devices[1] AS primary_device FROM emp")

# --- streaming -----------------------------------------------------------------------------------------------------------------
# --- written and read again ------------------------------------------------------------------------------------------
ORACLE["io_events"] = ORACLE["snk_events"]
add("io_external", None, "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type FROM events")
add("io_documents", None, "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, props, epoch_us(ts)::VARCHAR AS us, round(value * 100)::BIGINT::VARCHAR AS cents FROM events")
add("io_employees", "emp", "SELECT employee_id, employee_uuid, department, work_start::BIGINT AS work_start, work_end::BIGINT AS work_end, array_to_string(allowed_devices, ';') AS allowed_devices FROM emp")
add("io_features", "dr", f"SELECT session_id, employee_id, attack_type, round({_fr} + 1.7e-8, 4) AS risk_score, {_feat(dims.FEATURES, 4)} FROM {_joined}")
add("io_sequences", "vec", "SELECT session_id, 50::BIGINT AS n_steps, least(count(*), 50)::DOUBLE AS mask_sum FROM vec GROUP BY 1")
add("io_incidents", "inc", """SELECT session_id, attack_type, 'Case "' || session_id || '", ' || severity AS summary, severity, attack_type AS report FROM inc""")
add("io_metrics", None, "SELECT (l_returnflag = 'R')::INTEGER AS label, count(*) AS n FROM lineitem GROUP BY 1")

ORACLE["str_order"], ORACLE["str_padded"] = ORACLE["fea_order"], ORACLE["seq_padded"]
ORACLE["str_sessions"] = _gap_sql.format(c=_evc, k="employee_id", g=1800000000) + """, g AS (SELECT employee_id, session_no, count(*) AS n_events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
  count(*) FILTER (WHERE event_type = 'Login' AND status = 'FAILED') AS failed_login_count, max((attack_type <> 'None')::BIGINT) AS is_anomalous FROM q GROUP BY 1, 2)
  SELECT employee_id, n_events, start_us, end_us, failed_login_count, is_anomalous FROM g"""
add("str_drift", "dr", f"SELECT session_id, behaviour_score < 25 AS accepted, {_r(_D6)}, round(behaviour_score, 6) AS behaviour_score FROM dr")
add("str_alerts", "sc", "SELECT session_id, risk_score FROM sc WHERE risk_score >= 35")
