"""Names, lists and limits that results depend on."""

# Entity types and auth methods, in code order.
ENTITY_TYPES = ["user", "service_account", "edge_device"]
AUTH_METHODS = ["password", "token", "certificate", "biometric"]

# The eight classes, in index order.
NORMAL = "normal"
LABELS = [
    "normal",
    "brute_force",
    "impossible_travel",
    "credential_stuffing",
    "lateral_movement",
    "device_spoofing",
    "low_and_slow_exfiltration",
    "insider_drift",
]
ATTACKS = LABELS[1:]

# Known cities with latitude and longitude.
CITIES = [
    ("New York", 40.7128, -74.0060),
    ("London", 51.5074, -0.1278),
    ("Tokyo", 35.6762, 139.6503),
    ("Sydney", -33.8688, 151.2093),
    ("Mumbai", 19.0760, 72.8777),
    ("Berlin", 52.5200, 13.4050),
    ("São Paulo", -23.5505, -46.6333),
    ("Toronto", 43.6532, -79.3832),
    ("Dubai", 25.2048, 55.2708),
    ("Singapore", 1.3521, 103.8198),
    ("San Francisco", 37.7749, -122.4194),
    ("Chicago", 41.8781, -87.6298),
    ("Paris", 48.8566, 2.3522),
    ("Seoul", 37.5665, 126.9780),
    ("Shanghai", 31.2304, 121.4737),
]

# The resource catalogue.
RESOURCES = [
    "file://docs/quarterly_report.xlsx",
    "file://docs/employee_records.csv",
    "file://code/main_app.py",
    "file://secrets/api_keys.json",
    "file://finance/invoices_2025.pdf",
    "file://hr/salary_data.xlsx",
    "file://devops/deployment_config.yaml",
    "file://legal/contracts.docx",
    "api://auth/login",
    "api://auth/reset_password",
    "api://users/admin",
    "api://data/export",
    "api://config/update",
    "api://logs/audit",
    "port://22/ssh",
    "port://443/https",
    "port://3389/rdp",
    "port://5432/postgres",
    "port://27017/mongodb",
    "device://plc/firmware_update",
    "device://sensor/read_telemetry",
    "device://actuator/control",
    "device://gateway/config",
]

# URI schemes each entity type normally uses.
TYPICAL_SCHEMES = {
    "user": ["file", "api"],
    "service_account": ["api", "port"],
    "edge_device": ["device"],
}

# The 26 features, in vector order.
FEATURES = [
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_off_hours",
    "time_since_last_access_sec",
    "access_freq_5min",
    "access_freq_1hr",
    "access_freq_24hr",
    "access_freq_7d",
    "geo_velocity_kmh",
    "geo_distance_km",
    "geo_entropy",
    "resource_novelty_score",
    "resource_breadth",
    "resource_entropy",
    "failed_auth_count_5min",
    "failed_auth_count_1hr",
    "auth_method_changed",
    "session_duration_zscore",
    "session_duration_raw",
    "fingerprint_mismatch",
    "new_device_flag",
    "command_seq_length",
    "command_seq_novelty",
    "entity_type_encoded",
    "auth_method_encoded",
]

# Reason texts. {val:.0f}, {val:.1f} and {desc} are placeholders.
REASONS = {
    "geo_velocity_kmh": "impossible geo-velocity ({val:.0f} km/h between consecutive logins)",
    "geo_distance_km": "large geographic distance ({val:.0f} km) from usual location",
    "fingerprint_mismatch": "device fingerprint does not match historical profile",
    "new_device_flag": "access from a previously unseen device",
    "failed_auth_count_5min": "{val:.0f} failed authentication attempts in the last 5 minutes",
    "failed_auth_count_1hr": "{val:.0f} failed authentication attempts in the last hour",
    "resource_novelty_score": "accessed {val:.0f}% novel resources never seen for this entity",
    "resource_breadth": "unusual breadth of resources accessed ({val:.0f} distinct resources)",
    "session_duration_zscore": "session duration {val:.1f} standard deviations from normal",
    "is_off_hours": "access occurred during off-hours",
    "access_freq_5min": "abnormally high access frequency ({val:.0f} events in 5 min)",
    "access_freq_1hr": "elevated access frequency ({val:.0f} events in 1 hour)",
    "auth_method_changed": "authentication method changed from the usual method",
    "command_seq_novelty": "unusual command sequence pattern detected",
    "command_seq_length": "abnormally long command sequence ({val:.0f} commands)",
    "resource_entropy": "chaotic resource access pattern (high entropy)",
    "geo_entropy": "access from highly varied geographic locations",
    "time_since_last_access_sec": "unusually {desc} time since last access ({val:.0f}s)",
    "hour_of_day": "access at unusual hour ({val:.0f}:00)",
    "day_of_week": "access on unusual day of week",
    "is_weekend": "access occurred on weekend",
    "access_freq_24hr": "elevated 24-hour access volume ({val:.0f} events)",
    "access_freq_7d": "elevated 7-day access volume ({val:.0f} events)",
    "session_duration_raw": "session duration of {val:.0f} seconds",
    "entity_type_encoded": "entity type factor",
    "auth_method_encoded": "authentication method factor",
}
REASON_PREFIX = "Flagged due to: "

# Limits and weights.
EARTH_RADIUS_KM = 6371.0
FAILED_SESSION_SEC = 2.0
SEQUENCE_LENGTH = 10
DECAY = 0.95
FOCAL_ALPHA = 0.75
FOCAL_GAMMA = 2.0
RIDGE = 1e-5
UNKNOWN_ENTITY_SCORE = 0.5
RISK_THRESHOLD = 0.5
COLD_START_MIN = 10
COLD_START_FULL = 50
TOP_REASONS = 3
PAGE_SIZE = 50
DETAIL_SIZE = 20
ALERT_BUDGET = 0.01
TEST_SHARE = 0.2
DRIFT_DAYS = 30
SHORT_GAP_SEC = 10
RISK_BINS = 50
MIN_OVERSAMPLE_ROWS = 5

# Time units in microseconds.
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY
