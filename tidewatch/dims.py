"""Reference dimensions: enums, lookup tables, thresholds.

FIXED VALUES: everything in this module is a fixed value of the analytics
domain (enum texts and their order, severities, weights, patterns).  Results
depend on these exact values, so they are stated plainly and in natural order.
"""

from __future__ import annotations

# --- enums; the position in the list is the ordinal used as a feature value ---
DEPARTMENTS = ["Finance", "Engineering", "HR", "Sales", "IT", "Marketing"]
OPERATING_SYSTEMS = ["Windows", "Linux", "macOS", "iOS", "Android"]
BROWSERS = ["Chrome", "Firefox", "Edge", "Safari"]
DEVICE_TYPES = ["Laptop", "Desktop", "Mobile"]
RESOURCES = [
    "Email", "Slack", "GitHub", "FileServer", "FinanceDB", "HRPortal", "Payroll", "CRM",
    "AdminConsole", "Jira", "Servers", "VPN", "Confluence", "Terminal", "HRMS",
    "EmployeeRecords", "ERP", "Accounting", "Invoices", "Meetings", "Analytics",
    "CampaignDashboard", "Monitoring", "Firewall",
]
EVENT_TYPES = [
    "Login", "Logout", "ResourceAccess", "FileRead", "FileWrite", "FileDownload",
    "FileUpload", "ProcessStart", "ProcessStop", "ApiCall", "DatabaseQuery",
    "VPNConnect", "VPNDisconnect", "NetworkConnect", "NetworkDisconnect",
]
ATTACK_TYPES = [
    "None", "Brute Force", "Credential Stuffing", "Credential Misuse", "Impossible Travel",
    "Device Spoofing", "Lateral Movement", "Privilege Escalation", "Data Exfiltration",
    "Insider Threat", "Off-hours Access", "USB Data Theft", "Malware Execution",
    "Suspicious PowerShell", "Beaconing C2", "Low-and-Slow Exfiltration", "Insider Drift",
]
SENSITIVITY = ["Public", "Internal", "Confidential", "Restricted"]
SESSION_STATUSES = ["Active", "Completed", "Terminated", "Failed"]
LOGIN_METHODS = ["Office", "VPN"]
SEVERITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}

ADMIN_RESOURCES = ["AdminConsole", "Servers", "Firewall"]

# --- resource -> (type, sensitivity, departments allowed to use it) ---
_ALL = ["Finance", "Engineering", "HR", "Sales", "IT", "Marketing"]
RESOURCE_DIM = {
    "Payroll": ("Web Application", "Restricted", ["Finance", "HR", "IT"]),
    "FinanceDB": ("Database", "Restricted", ["Finance", "IT"]),
    "Email": ("SaaS", "Internal", _ALL),
    "GitHub": ("SaaS", "Confidential", ["Engineering", "IT"]),
    "Jira": ("SaaS", "Internal", ["Engineering", "Sales", "IT", "HR", "Finance", "Marketing"]),
    "Slack": ("SaaS", "Internal", _ALL),
    "FileServer": ("Network Share", "Confidential", ["Engineering", "IT", "Finance", "HR", "Marketing"]),
    "HRPortal": ("Web Application", "Confidential", ["HR", "IT"]),
    "CRM": ("SaaS", "Confidential", ["Sales", "IT", "Marketing"]),
    "AdminConsole": ("Web Application", "Restricted", ["IT"]),
    "Servers": ("Infrastructure", "Restricted", ["IT"]),
    "VPN": ("Network Service", "Restricted", ["IT", "Engineering", "Finance", "HR", "Sales", "Marketing"]),
    "Confluence": ("SaaS", "Internal", ["Engineering", "IT", "Finance", "HR", "Sales", "Marketing"]),
    "Terminal": ("App", "Confidential", ["Engineering", "IT"]),
    "HRMS": ("Web Application", "Restricted", ["HR", "IT"]),
    "EmployeeRecords": ("Database", "Restricted", ["HR", "IT"]),
    "ERP": ("Web Application", "Restricted", ["Finance", "IT"]),
    "Accounting": ("Web Application", "Restricted", ["Finance", "IT"]),
    "Invoices": ("Database", "Confidential", ["Finance", "IT"]),
    "Meetings": ("SaaS", "Internal", _ALL),
    "Analytics": ("SaaS", "Confidential", ["Marketing", "Sales", "Finance", "IT"]),
    "CampaignDashboard": ("Web Application", "Confidential", ["Marketing", "IT"]),
    "Monitoring": ("Web Application", "Restricted", ["IT"]),
    "Firewall": ("Network Service", "Restricted", ["IT"]),
}
SENSITIVE_RESOURCES = [r for r in RESOURCES if RESOURCE_DIM[r][1] in ("Restricted", "Confidential")]

WORK_HOURS = {
    "Finance": (9, 18), "Engineering": (9, 18), "HR": (9, 18),
    "Sales": (8, 17), "IT": (8, 18), "Marketing": (9, 18),
}

# --- risk ---
ATTACK_SEVERITY = {
    "Off-hours Access": 40.0, "Insider Threat": 60.0, "Impossible Travel": 60.0,
    "Brute Force": 80.0, "Credential Stuffing": 80.0, "Lateral Movement": 80.0,
    "USB Data Theft": 80.0, "Malware Execution": 95.0, "Privilege Escalation": 95.0,
    "Data Exfiltration": 95.0, "Suspicious PowerShell": 90.0, "Beaconing C2": 85.0,
    "Device Spoofing": 75.0, "Low-and-Slow Exfiltration": 85.0, "Insider Drift": 50.0,
}
RISK_POINTS = {"failed_login": 5.0, "unauthorized_admin": 15.0, "large_transfer": 20.0, "suspicious_cli": 20.0}
LARGE_TRANSFER_BYTES = 100 * 1024 * 1024
RISK_WEIGHTS = {"behaviour": 0.30, "severity": 0.40, "reconstruction": 0.15, "confidence": 0.15}
ALERT_THRESHOLD = 35.0

# --- drift ---
DRIFT_WINDOW = 10
DRIFT_MIN_WINDOW = 3
DRIFT_ACCEPT_BELOW = 25.0
LAPLACE_ALPHA = 2.0
DEVIATIONS = {  # name -> weight, in feature order
    "location_deviation": 25.0,
    "device_deviation": 15.0,
    "browser_deviation": 5.0,
    "operating_system_deviation": 5.0,
    "working_hours_deviation": 20.0,
    "resource_access_deviation": 30.0,
}

# --- payload lists ---
MALWARE_NAMES = [
    "mimikatz.exe", "wannacry.exe", "revshell.ps1", "pwnage.elf", "keylogger.exe",
    "cobaltstrike.beacon",
]
C2_DOMAINS = ["malicious-c2.com", "198.51.100.42", "super-safe-update.org", "shady-traffic.net"]
SUSPICIOUS_FLAGS = ["bypass", "hidden", "encodedcommand"]

# --- schema adaptation ---
COLUMN_SYNONYMS = {
    "employee_id": ["username", "user", "user_id", "employee_id", "emp_id", "employee", "account",
                    "subject", "actor", "principal", "uid"],
    "session_id": ["session_id", "sess_id", "session", "sid", "login_session"],
    "event_timestamp": ["timestamp", "time", "datetime", "date_time", "event_time", "created_at",
                        "@timestamp", "ts", "log_time"],
    "event_type": ["action", "event", "event_type", "activity", "operation", "method", "command",
                   "event_name"],
    "device_id": ["device", "host", "hostname", "device_id", "machine", "workstation", "system",
                  "computer_name"],
    "source_ip": ["src_ip", "source_ip", "ip", "client_ip", "ip_address", "src", "remote_ip"],
    "destination_ip": ["dst_ip", "destination_ip", "target_ip", "dest_ip", "dst", "server_ip"],
    "resource": ["resource", "resource_accessed", "target", "file", "url", "uri", "db", "database",
                 "table", "path"],
    "status": ["status", "result", "outcome", "success", "flag", "status_code"],
    "location": ["geo_location", "office_location", "location", "city", "country", "region"],
    "auth_method": ["auth_method", "login_method", "authentication", "mfa", "auth_type"],
    "bytes_transferred": ["bytes", "bytes_transferred", "size", "data_size", "upload_bytes",
                          "download_bytes"],
    "process_name": ["process_name", "process", "exe", "image", "file_name", "binary"],
    "command_line": ["command_line", "cmd", "cmdline", "command_sequence", "args", "command"],
}
CORE_FIELDS = ["employee_id", "event_timestamp", "event_type"]
EVENT_TYPE_PATTERNS = [  # first match wins
    ("login|signin|logon|auth|authenticate", "Login"),
    ("logout|signout|logoff", "Logout"),
    ("download|fetch|pull|exfil", "FileDownload"),
    ("upload|push|post", "FileUpload"),
    ("read|open|access_file", "FileRead"),
    ("write|save|modify_file", "FileWrite"),
    ("process|exec|cmd|powershell|run", "ProcessStart"),
    ("stop|kill|terminate", "ProcessStop"),
    ("sql|query|select|database", "DatabaseQuery"),
    ("vpn", "VPNConnect"),
    ("api|http|rest", "ApiCall"),
    ("resource|view|access", "ResourceAccess"),
]
FIELD_DEFAULTS = {
    "employee_id": "EMP-UNKNOWN", "device_id": "DEV-UNKNOWN", "source_ip": "127.0.0.1",
    "location": "Office", "status": "SUCCESS", "auth_method": "Password",
}
EMPLOYEE_DEFAULTS = {
    "department": "IT", "role": "Staff", "preferred_browser": "Chrome", "preferred_os": "Windows",
}
TIMESTAMP_FORMATS = [  # Spark patterns, tried in order
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy hh:mm:ss a",
    "yyyy/MM/dd HH:mm:ss",
    "dd-MMM-yyyy HH:mm:ss",
    "yyyy-MM-dd",
]

# --- features ---
SESSION_FEATURES = ["session_duration", "login_hour", "logout_hour", "day_of_week", "weekend_flag",
                    "remote_session", "vpn_used", "browser", "operating_system", "department"]
AUTH_FEATURES = ["failed_login_count", "successful_login_count", "login_method",
                 "authentication_attempts", "failed_login_ratio"]
RESOURCE_FEATURES = ["total_resource_accesses", "unique_resources", "admin_resource_accesses",
                     "sensitive_resource_accesses", "github_access_count", "database_query_count",
                     "confluence_access_count", "hrms_access_count", "erp_access_count"]
FILE_FEATURES = ["files_read", "files_written", "files_uploaded", "files_downloaded",
                 "total_upload_bytes", "total_download_bytes", "upload_download_ratio"]
PROCESS_FEATURES = ["processes_started", "processes_stopped", "powershell_executions",
                    "suspicious_process_count", "malware_execution_count"]
NETWORK_FEATURES = ["network_connections", "vpn_connections", "vpn_disconnections",
                    "unique_destination_ips", "unique_source_ips", "external_connections",
                    "beaconing_event_count"]
TEMPORAL_FEATURES = ["total_events", "events_per_minute", "average_time_between_events",
                     "maximum_idle_time", "minimum_idle_time", "off_hours_access",
                     "session_start_hour"]
RATIO_FEATURES = ["unique_event_types", "login_event_ratio", "file_event_ratio",
                  "process_event_ratio", "network_event_ratio", "resource_event_ratio"]
ORDER_FEATURES = ["first_event_type", "last_event_type", "event_sequence_length",
                  "login_to_first_resource_time", "admin_access_position",
                  "file_download_position", "process_execution_position"]
BEHAVIOUR_FEATURES = list(DEVIATIONS)
META_COLUMNS = ["session_id", "employee_id", "is_anomalous", "attack_type", "risk_score"]
FEATURES = (SESSION_FEATURES + AUTH_FEATURES + RESOURCE_FEATURES + FILE_FEATURES + PROCESS_FEATURES
            + NETWORK_FEATURES + TEMPORAL_FEATURES + RATIO_FEATURES + ORDER_FEATURES
            + BEHAVIOUR_FEATURES)
SCORE_FEATURES = ["reconstruction_error", "anomaly_score"]
MODEL_FEATURES = FEATURES + SCORE_FEATURES

# --- explanation ---
MITRE = {  # attack -> (tactic, technique id, technique); Normal has none
    "Beaconing C2": ("Command and Control", "T1071", "Application Layer Protocol"),
    "Brute Force": ("Credential Access", "T1110", "Brute Force"),
    "Credential Stuffing": ("Credential Access", "T1110.004", "Credential Stuffing"),
    "Data Exfiltration": ("Exfiltration", "T1048", "Exfiltration Over Alternative Protocol"),
    "Device Spoofing": ("Defense Evasion", "T1036.005", "Match Legitimate Name or Location"),
    "Impossible Travel": ("Initial Access", "T1078", "Valid Accounts"),
    "Insider Drift": ("Defense Evasion", "T1036", "Masquerading"),
    "Insider Threat": ("Collection", "T1074", "Data Staged"),
    "Lateral Movement": ("Lateral Movement", "T1021", "Remote Services"),
    "Low-and-Slow Exfiltration": ("Exfiltration", "T1029", "Scheduled Transfer"),
    "Malware Execution": ("Execution", "T1059", "Command and Scripting Interpreter"),
    "Off-hours Access": ("Persistence", "T1078.003", "Local Accounts"),
    "Privilege Escalation": ("Privilege Escalation", "T1068", "Exploitation for Privilege Escalation"),
    "Suspicious PowerShell": ("Execution", "T1059.001", "PowerShell"),
    "USB Data Theft": ("Exfiltration", "T1052.001", "Exfiltration over USB"),
}
CLASS_LABELS = sorted(["Normal", *MITRE])
FEATURE_CATEGORY = {
    "Authentication": ["failed_login_count", "authentication_attempts", "failed_login_ratio",
                       "password_resets", "mfa_bypassed", "login_hour"],
    "Device": ["device_deviation", "usb_activity", "removable_media_count", "new_device_flag",
               "device_change_count"],
    "Location": ["location_deviation", "vpn_used", "unique_source_ips", "geolocation_anomaly",
                 "impossible_travel_flag"],
    "Resource": ["resource_access_deviation", "files_downloaded", "files_uploaded",
                 "database_query_count", "sensitive_files_accessed", "total_download_bytes",
                 "total_upload_bytes"],
    "Network": ["network_connections", "external_connections", "upload_download_ratio", "bytes_sent",
                "bytes_received", "unique_destinations", "dns_queries"],
    "Command": ["powershell_executions", "suspicious_process_count", "beaconing_event_count",
                "script_executions", "cmd_executions", "encoded_commands"],
    "Temporal": ["session_start_hour", "session_duration_minutes", "after_hours_flag",
                 "weekend_access", "time_since_last_login"],
    "Session": ["event_sequence_length", "reconstruction_error", "anomaly_score", "risk_score",
                "event_count", "unique_event_types"],
}
#: Own wording, shown beside feature names.
FEATURE_DESCRIPTION = {
    "upload_download_ratio": "bytes sent up per byte brought down",
    "files_downloaded": "files brought down",
    "external_connections": "connections that leave the network",
    "powershell_executions": "starts of the shell",
    "total_upload_bytes": "bytes sent up",
    "unique_source_ips": "different addresses of the caller",
    "session_start_hour": "hour of the first event",
    "suspicious_process_count": "starts of unwanted programs",
    "beaconing_event_count": "regular outgoing signals",
    "location_deviation": "unlike the usual place",
    "login_hour": "hour of the sign-in",
    "total_download_bytes": "bytes brought down",
    "database_query_count": "queries to databases",
    "authentication_attempts": "sign-in attempts",
    "failed_login_count": "refused sign-ins",
    "failed_login_ratio": "share of refused sign-ins",
    "device_deviation": "unlike the usual device",
    "vpn_used": "came through a tunnel",
    "network_connections": "connections of any kind",
    "event_sequence_length": "steps of the session",
    "resource_access_deviation": "unlike the usual resources",
    "anomaly_score": "scaled error of the reconstruction model",
    "reconstruction_error": "error of the reconstruction model",
    "risk_score": "combined risk",
    "session_duration_minutes": "minutes from first to last event",
    "usb_activity": "drive in use",
    "removable_media_count": "events on removable drives",
    "files_uploaded": "files sent up",
    "sensitive_files_accessed": "protected files opened",
}
IMPACT_BANDS = [(0.30, "High Positive"), (0.15, "Medium Positive"), (0.05, "Low Positive"),
                (-0.05, "Negligible"), (-0.15, "Low Negative"), (-0.30, "Medium Negative")]
IMPACT_FLOOR = "High Negative"

# --- campaigns ---
ATTACK_CHAINS = [
    ["Brute Force", "Credential Stuffing", "Lateral Movement", "Data Exfiltration"],
    ["Malware Execution", "Privilege Escalation", "Beaconing C2"],
    ["Impossible Travel", "Off-hours Access", "Data Exfiltration"],
    ["Lateral Movement", "Privilege Escalation", "USB Data Theft"],
    ["Brute Force", "Privilege Escalation", "Data Exfiltration"],
    ["Beaconing C2", "Lateral Movement", "Data Exfiltration"],
    ["Credential Stuffing", "Insider Threat", "Low-and-Slow Exfiltration"],
    ["Malware Execution", "Lateral Movement", "Beaconing C2", "Data Exfiltration"],
]
