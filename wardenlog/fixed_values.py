"""Vocabularies, weights, texts and limits of the analytics.

These are constants that results depend on literally. They are data, not logic; operators import them
and every function that uses one accepts a replacement as a parameter where a site would tune it.
"""

from __future__ import annotations

# --- Vocabularies -----------------------------------------------------------------------------------
ENTITY_TYPES = ["user", "service_account", "edge_device"]
ENTITY_ROLES = ["employee", "developer", "hr", "finance", "admin", "service", "device"]
RESOURCE_CATEGORIES = [
    "code_repo", "email", "hr_data", "finance_data", "admin_panel", "infra_config", "general",
]
AUTH_METHODS = ["password", "token", "certificate", "biometric", "sso"]
AUTH_STATUSES = ["success", "failure"]
ACTION_TYPES = [
    "login", "read", "write", "download", "upload", "config_change", "privilege_escalation",
]
PROTOCOLS = ["HTTPS", "SSH", "RDP", "VPN", "MQTT", "OPC-UA"]
LABELS = ["normal", "anomaly"]
ATTACK_TYPES = [
    "normal", "brute_force", "impossible_travel", "credential_stuffing",
    "lateral_movement", "device_spoofing", "low_slow_exfiltration", "insider_drift",
]

# --- Dimensions -------------------------------------------------------------------------------------
# place, latitude, longitude
PLACES = [
    ("Mumbai, IN", 19.0760, 72.8777),
    ("Delhi, IN", 28.6139, 77.2090),
    ("Bangalore, IN", 12.9716, 77.5946),
    ("Hyderabad, IN", 17.3850, 78.4867),
    ("Chennai, IN", 13.0827, 80.2707),
    ("Pune, IN", 18.5204, 73.8567),
    ("Kolkata, IN", 22.5726, 88.3639),
    ("Ahmedabad, IN", 23.0225, 72.5714),
    ("London, GB", 51.5074, -0.1278),
    ("New York, US", 40.7128, -74.0060),
    ("Singapore, SG", 1.3521, 103.8198),
    ("Dubai, AE", 25.2048, 55.2708),
    ("Tokyo, JP", 35.6762, 139.6503),
    ("San Francisco, US", 37.7749, -122.4194),
    ("Frankfurt, DE", 50.1109, 8.6821),
    ("Sydney, AU", -33.8688, 151.2093),
]

RESOURCES = {
    "email": [
        "/mail/inbox", "/mail/sent", "/mail/compose", "/mail/attachments", "/mail/calendar",
    ],
    "general": [
        "/docs/shared", "/docs/team-wiki", "/docs/templates", "/portal/dashboard",
        "/portal/announcements", "/intranet/directory", "/intranet/policies",
    ],
    "code_repo": [
        "/git/repo-frontend", "/git/repo-backend", "/git/repo-infra", "/git/repo-ml-pipeline",
        "/git/repo-mobile", "/ci/pipeline-build", "/ci/pipeline-deploy", "/ci/pipeline-test",
        "/staging/api-v2", "/staging/api-v3",
    ],
    "hr_data": [
        "/hr/employee-records", "/hr/onboarding", "/hr/payroll-view", "/hr/leave-management",
        "/hr/performance-reviews", "/hr/recruitment-portal",
    ],
    "finance_data": [
        "/finance/erp-dashboard", "/finance/invoices", "/finance/payroll-export",
        "/finance/tax-reports", "/finance/budget-planning", "/finance/audit-logs",
        "/api/payroll/export", "/api/finance/quarterly-report",
    ],
    "admin_panel": [
        "/admin/user-management", "/admin/access-control", "/admin/audit-trail",
        "/admin/system-settings", "/admin/security-policies", "/admin/license-management",
    ],
    "infra_config": [
        "/infra/firewall-rules", "/infra/dns-config", "/infra/load-balancer", "/infra/vpn-gateway",
        "/infra/server-monitoring", "/infra/backup-config", "/infra/k8s-cluster",
        "/infra/docker-registry", "/infra/ad-config", "/infra/certificate-manager",
    ],
}

USER_AGENTS = {
    "Windows 11": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/125.0",
    "Windows 10": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0",
    "macOS 14": "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Safari/605.1",
    "macOS 13": "Mozilla/5.0 (Macintosh; Intel Mac OS X 13_0) Safari/605.1",
    "Ubuntu 22.04": "Mozilla/5.0 (X11; Linux x86_64) Firefox/115.0",
    "Ubuntu 24.04": "Mozilla/5.0 (X11; Linux x86_64) Firefox/128.0",
    "CentOS 8": "curl/7.61.1",
    "RHEL 9": "python-requests/2.31.0",
    "Android 14": "Mozilla/5.0 (Linux; Android 14) Chrome/125.0 Mobile",
    "iOS 17": "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Safari/604.1",
}

# --- Event features ---------------------------------------------------------------------------------
CATEGORY_SENSITIVITY = {
    "general": 0.1, "email": 0.2, "code_repo": 0.4, "hr_data": 0.7,
    "finance_data": 0.8, "admin_panel": 0.9, "infra_config": 1.0,
}
CATEGORY_SENSITIVITY_DEFAULT = 0.3

SUSPICIOUS_KEYWORDS = [
    "mimikatz", "nmap", "whoami", "/etc/shadow", "/etc/passwd", "net user", "net localgroup",
    "powershell -enc", "certutil", "wget http", "chmod +x", "id_rsa", ".pem", "reg query",
    "payload", "whoami /priv",
]

# --- Composite risk ---------------------------------------------------------------------------------
FLOOR_85_ATTACKS = ["lateral_movement", "low_slow_exfiltration", "impossible_travel"]
FLOOR_70_ATTACKS = ["brute_force", "credential_stuffing", "device_spoofing"]

# --- Dynamic risk: nine weighted factors ------------------------------------------------------------
DEPARTMENT_SENSITIVITY = {
    "FINANCE": 0.90, "EXECUTIVE": 0.95, "HR": 0.85, "R_AND_D": 0.85,
    "ENGINEERING": 0.70, "IT_ADMIN": 0.90, "LEGAL": 0.80, "GENERAL": 0.40,
}
RESOURCE_SENSITIVITY = {
    "DOMAIN_CONTROLLER": 1.00, "PAYROLL_DATABASE": 0.95, "SOURCE_CODE_REPOS": 0.85,
    "VPN_GATEWAY": 0.80, "CUSTOMER_CRM": 0.75, "INTERNAL_WIKI": 0.30, "PUBLIC_PORTAL": 0.20,
}
SENSITIVITY_DEFAULT = 0.50
RISK_WEIGHTS = [
    ("behavior_deviation", 0.20),
    ("attack_confidence", 0.15),
    ("department_sensitivity", 0.10),
    ("resource_sensitivity", 0.15),
    ("time_of_day", 0.10),
    ("unknown_device", 0.08),
    ("unknown_location", 0.07),
    ("historical_risk", 0.05),
    ("repeated_anomalies", 0.10),
]
# lower bound, tier, colour, action
RISK_TIERS = [
    (80.0, "CRITICAL", "#dc2626", "Immediate Automated Account Lockout & Incident Escalate"),
    (60.0, "HIGH", "#ea580c", "Require Step-Up Out-of-Band MFA Verification"),
    (35.0, "MEDIUM", "#d97706", "Flag for Analyst Triage Queue"),
    (None, "LOW", "#16a34a", "Log Telemetry & Continue Monitoring"),
]

# --- Classification ---------------------------------------------------------------------------------
ATTACK_SEVERITY = {
    "brute_force": "High", "credential_stuffing": "High", "impossible_travel": "High",
    "lateral_movement": "Critical", "low_slow_exfiltration": "Critical",
    "device_spoofing": "Medium", "insider_drift": "Medium", "normal": "Low",
}
ATTACK_SEVERITY_DEFAULT = "High"

FEATURE_LABELS = {
    "geo_velocity_kmh": "Impossible Travel Velocity",
    "device_novelty": "Unknown Device",
    "is_off_hours": "Outside Working Hours",
    "failed_auth_count_1h": "Failed Login Burst (1h)",
    "failed_auth_count_24h": "Sustained Auth Failures",
    "unique_entities_per_ip_1h": "Multi-Account IP Spray",
    "resource_novelty": "Unusual Resource Access",
    "category_novelty": "Cross-Department Category Access",
    "bytes_zscore": "Abnormal Data Transfer Volume",
    "bytes_per_second": "High-Speed Data Extraction",
    "suspicious_cmd_flag": "Suspicious Terminal Command",
    "command_diversity": "Automated Recon Command Pattern",
    "resource_sensitivity": "High-Sensitivity Asset Targeted",
    "auth_method_change": "Authentication Method Change",
    "geo_novelty": "New Geographic Location",
    "protocol_novelty": "Unusual Access Protocol",
    "is_weekend": "Weekend Activity",
    "minutes_since_last": "Rapid Login Rate",
}

# --- Recommendations: attack type -> (action, text) --------------------------------------------------
RECOMMENDATIONS = {
    "brute_force": (
        "Require MFA & Lock Account",
        "Temporarily lock the targeted account, revoke active tokens, and enforce immediate MFA reset.",
    ),
    "credential_stuffing": (
        "Escalate to SOC & Block IP",
        "Block source IP address at firewall perimeter, trigger automated password reset for affected entities, and alert Tier 2 SOC.",
    ),
    "impossible_travel": (
        "Lock Account",
        "Temporarily disable the account and require in-person / out-of-band MFA verification.",
    ),
    "lateral_movement": (
        "Escalate to SOC & Isolate Entity",
        "Immediately isolate host/entity credentials, revoke privileged API keys, and launch active incident response investigation.",
    ),
    "device_spoofing": (
        "Investigate Device",
        "Quarantine suspicious device fingerprint, revoke device session token, and re-verify hardware PKI certificates.",
    ),
    "low_slow_exfiltration": (
        "Escalate to SOC",
        "Trigger automated DLP download caps, flag account for active packet capture monitoring, and escalate to CISO threat team.",
    ),
    "insider_drift": (
        "Monitor & Audit Access",
        "Notify HR and line manager to verify if recent resource scope expansion is business-sanctioned; monitor for 7 days.",
    ),
    "normal": ("Monitor", "No action required. Maintain baseline logging."),
}
LOW_RISK_RECOMMENDATION = (
    "Monitor", "Log event for baseline profiling; no immediate action required.",
)

# --- MITRE ATT&CK techniques: attack type -> (tactic, id, name, url) ---------------------------------
TECHNIQUES = {
    "impossible_travel": (
        "Initial Access / Defense Evasion", "T1078.004", "Valid Accounts: Cloud Accounts",
        "https://attack.mitre.org/techniques/T1078/004/",
    ),
    "brute_force": (
        "Credential Access", "T1110.001", "Brute Force: Password Guessing",
        "https://attack.mitre.org/techniques/T1110/001/",
    ),
    "lateral_movement": (
        "Lateral Movement", "T1021.002", "Remote Services: SMB/Windows Admin Shares",
        "https://attack.mitre.org/techniques/T1021/002/",
    ),
    "low_slow_exfiltration": (
        "Exfiltration", "T1041", "Exfiltration Over C2 Channel",
        "https://attack.mitre.org/techniques/T1041/",
    ),
    "credential_stuffing": (
        "Credential Access", "T1110.004", "Brute Force: Credential Stuffing",
        "https://attack.mitre.org/techniques/T1110/004/",
    ),
}
TECHNIQUE_DEFAULT = (
    "Persistence / Execution", "T1078", "Valid Accounts",
    "https://attack.mitre.org/techniques/T1078/",
)

# --- Storyline stages: attack type or action -> title ------------------------------------------------
STAGE_TITLES = {
    "login": "Stage 1: Authentication & Entry",
    "failed_login": "Stage 1: Authentication Failure",
    "device_anomaly": "Stage 2: Device Fingerprint Anomaly",
    "impossible_travel": "Stage 2: Geo-Velocity Anomaly",
    "read_document": "Stage 3: Resource Reconnaissance",
    "sensitive_file_access": "Stage 3: Privilege & Resource Access",
    "data_download": "Stage 4: Data Exfiltration Burst",
    "exfiltration": "Stage 4: Data Exfiltration Burst",
    "escalation": "Stage 5: Critical Incident Escalation",
}

# --- Identity profile defaults for entities without history ------------------------------------------
PROFILE_DEFAULTS = {
    "department": "Unknown", "hour_low": 8, "hour_high": 18, "login_frequency": 10.0,
    "typical_devices": ["Corporate-Standard"], "typical_countries": ["US"],
    "normal_resources": ["General-App"], "normal_commands": ["read"],
    "avg_session_duration": 30.0, "avg_bytes_transferred": 1000.0, "total_historical_events": 0,
}

# --- Triage ------------------------------------------------------------------------------------------
CLOSING_STATUSES = ["FALSE_POSITIVE", "RESOLVED"]
OPENING_STATUSES = ["CONFIRMED_THREAT", "UNDER_INVESTIGATION"]
STATUS_CODES = {
    "Confirmed Threat": "CONFIRMED_THREAT",
    "False Positive (Close Alert)": "FALSE_POSITIVE",
    "Under Investigation": "UNDER_INVESTIGATION",
    "Resolved": "RESOLVED",
}
