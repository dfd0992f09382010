"""Fixed values of the data model: schemas, label codes, column lists, thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: class labels ----------------------------------------------------------
LABELS = {"human": 0, "moderate_bot": 1, "advanced_bot": 2}
LABEL_NAMES = {0: "human", 1: "moderate_bot", 2: "advanced_bot"}
CLICK_SOURCE = "talkingdata"

SEQUENCE_LENGTH = 50
SESSION_GAP_MINUTES = 30
MIN_HUMAN_SESSIONS = 1000

_L, _D, _S, _I, _T, _B = (
    T.LongType(),
    T.DoubleType(),
    T.StringType(),
    T.IntegerType(),
    T.TimestampType(),
    T.BooleanType(),
)


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# --- fixed values: source tables ---------------------------------------------------------
CLICK_SCHEMA = _schema(
    ip=_L, app=_L, device=_L, os=_L, channel=_L, click_time=_T, attributed_time=_T, is_attributed=_I
)
CLICK_COLUMNS = ["ip", "app", "device", "os", "channel", "click_time", "is_attributed"]
MOVEMENT_SCHEMA = _schema(
    user_id=_S, session_id=_S, category=_S, movement_index=_L, x_coordinate=_L, y_coordinate=_L
)
WEB_LOG_SCHEMA = _schema(
    source_file=_S, category=_S, ip=_D, timestamp=_S, method=_S, path=_S, http_version=_S,
    status_code=_L, response_size=_L, referrer=_S, session_id=_S, user_agent=_S, date=_S, time=_S,
)
WEB_ACTIVITY_SCHEMA = _schema(
    session_id=_S, total_requests=_L, successful_requests=_L, success_rate=_S, total_response_size=_L,
    avg_response_size=_L, activity_date=_S, time_range=_S,
)
MOVEMENT_SUMMARY_SCHEMA = _schema(
    user_id=_S, total_movements=_L, x_mean=_D, x_std=_D, x_min=_L, x_max=_L, y_mean=_D, y_std=_D, y_min=_L, y_max=_L
)
COMBINED_REPORT_SCHEMA = _schema(
    Category=_S, Total_Users=_L, Total_Movements=_L, Total_Sessions=_L, Total_Requests=_L,
    Avg_Movements_per_User=_L, Avg_Requests_per_Session=_L,
)

# --- fixed values: the canonical session table, in order ---------------------------------
SESSION_SCHEMA = _schema(
    session_id=_S, label=_I, bot_type=_S, data_source=_S, data_source_detail=_S, candidate_human=_B,
    session_start=_T, session_end=_T, activity_date=_S, time_range=_S,
    mouse_speed_mean=_D, mouse_speed_std=_D, mouse_path_length=_D, direction_change_count=_L, movement_std=_D,
    coordinate_entropy=_D, mouse_acceleration_std=_D, movement_curvature=_D, session_idle_ratio=_D,
    click_interval_entropy=_D, device_entropy=_D, channel_entropy=_D, app_entropy=_D, request_interval_entropy=_D,
    requests_per_minute=_D, clicks_per_minute=_D, session_duration_sec=_D, request_interval_mean=_D,
    request_interval_std=_D, click_interval_mean=_D, click_interval_std=_D,
    total_movements=_L, total_requests=_L, click_count=_L, install_count=_L, successful_requests=_L, success_rate=_D,
    browser=_S, operating_system=_S, device_type=_S, user_agent=_S, ip_address=_S, country=_S, region=_S,
    is_proxy=_I, bot_likelihood_score=_D, original_ip=_L, original_device=_L, original_os=_L,
    app=_L, device=_L, os=_L, channel=_L, logs_count=_L, total_response_size=_D, avg_response_size=_D,
)
SESSION_COLUMNS = SESSION_SCHEMA.fieldNames()

# --- fixed values: the binary table, in order --------------------------------------------
BINARY_COLUMNS = [
    "session_id", "data_source", "bot_type", "label", "session_start", "session_end",
    "year", "month", "day", "hour", "minute", "second", "activity_date", "time_range",
    "click_count", "total_requests", "successful_requests", "install_count", "logs_count", "session_duration_sec",
    "click_interval_mean", "click_interval_std", "request_interval_mean", "request_interval_std",
    "clicks_per_minute", "requests_per_minute", "device_entropy", "channel_entropy", "app_entropy",
    "ip_click_frequency", "device_click_frequency", "ip_install_rate", "combo_repeat_rate", "success_rate",
    "mouse_speed_mean", "mouse_speed_std", "mouse_path_length", "direction_change_count",
    "hover_time_mean", "hover_time_std", "scroll_count", "scroll_depth", "coordinate_entropy",
    "cursor_acceleration_std", "movement_std", "bot_likelihood_score",
    "browser", "operating_system", "device_type", "user_agent", "ip_address", "country", "region", "is_proxy",
    "original_ip", "original_device", "original_os", "app", "device", "os", "channel",
    "total_response_size", "avg_response_size",
]

# --- fixed values: cleaning --------------------------------------------------------------
REDUNDANT_COLUMNS = ["logs_count", "request_interval_entropy", "request_interval_mean", "click_interval_std"]
LEAKAGE_COLUMNS = ["device_entropy", "original_ip", "app", "device", "os", "channel", "success_rate"]
NON_MODEL_COLUMNS = [
    "data_source_detail", "candidate_human", "session_start", "session_end", "activity_date", "time_range",
    "click_interval_median",
]
MODEL_ID_COLUMNS = ["session_id", "ip_address", "user_agent", "data_source", "bot_type", "label_name"]
CATEGORICAL_COLUMNS = ["browser", "operating_system", "device_type", "country", "region"]
UPPER_CAPS = {
    "clicks_per_minute": 1500.0,
    "requests_per_minute": 1000.0,
    "mouse_path_length": 50000.0,
    "direction_change_count": 5000.0,
    "total_movements": 5000.0,
    "session_duration_sec": 10000.0,
}
PROTECTED_COLUMNS = {
    "label", "bot_likelihood_score", "anomaly_score", "click_interval_mean", "click_interval_entropy",
    "request_interval_std", "click_count", "mouse_speed_mean", "mouse_speed_std", "mouse_path_length",
    "direction_change_count", "movement_std", "movement_curvature", "mouse_acceleration_std",
    "coordinate_entropy", "total_movements", "session_duration_sec", "session_idle_ratio", "burstiness",
    "successful_requests", "success_rate", "clicks_per_minute", "requests_per_minute", "browser",
    "operating_system", "device_type", "country", "region", "is_proxy", "device_entropy", "app_entropy",
    "channel_entropy",
}
PREFERRED_OF_PAIR = {
    frozenset({"click_count", "total_requests"}): "click_count",
    frozenset({"original_device", "device"}): "device",
    frozenset({"original_os", "os"}): "os",
}

# --- fixed values: augmentation ----------------------------------------------------------
JITTER_COLUMNS = [
    "session_duration_sec", "request_interval_mean", "request_interval_std", "click_interval_mean",
    "click_interval_std", "clicks_per_minute", "requests_per_minute", "mouse_speed_mean", "mouse_speed_std",
    "mouse_path_length", "movement_std", "coordinate_entropy", "mouse_acceleration_std", "movement_curvature",
    "session_idle_ratio", "click_interval_entropy", "device_entropy", "channel_entropy",
    "request_interval_entropy",
]
BOT_NOISE = {
    "mouse_speed_mean": 0.2, "mouse_speed_std": 0.1, "mouse_path_length": 0.5, "coordinate_entropy": 0.1,
    "click_interval_entropy": 0.05, "requests_per_minute": 10.0, "session_idle_ratio": 0.02, "burstiness": 0.05,
    "movement_std": 0.1, "mouse_acceleration_std": 0.1, "click_interval_mean": 0.08, "request_interval_std": 0.08,
    "session_duration_sec": 0.2, "click_count": 0.5, "total_movements": 0.5,
}
HUMAN_NOISE = {"mouse_speed_mean": 0.1, "click_interval_entropy": 0.02, "requests_per_minute": 5.0}
BALANCED_TARGETS = {0: 5013, 1: 1000, 2: 1000}
STEP_FEATURES = [
    "mouse_speed_mean", "mouse_speed_std", "mouse_path_length", "direction_change_count", "movement_std",
    "coordinate_entropy", "mouse_acceleration_std", "movement_curvature", "click_interval_entropy",
    "click_interval_mean", "requests_per_minute", "clicks_per_minute",
]

# --- fixed values: device and network odds -----------------------------------------------
BROWSERS = {"Chrome": 0.65, "Safari": 0.18, "Firefox": 0.10, "Edge": 0.07}
THREE_CLASS_ODDS = {
    "operating_system": {"Windows": 0.40, "Android": 0.22, "iOS": 0.15, "Linux": 0.11, "MacOS": 0.12},
    "device_type": {"desktop": 0.46, "mobile": 0.45, "tablet": 0.09},
    "country": {
        "United States": 0.28, "India": 0.18, "United Kingdom": 0.10, "Germany": 0.08, "Canada": 0.08,
        "France": 0.07, "Japan": 0.06, "Brazil": 0.05, "Singapore": 0.05, "Australia": 0.05,
    },
    "bot_linux": 0.38,
    "advanced_desktop": 0.70,
    "bot_server": 0.25,
    "human_proxy": 0.05,
    "bot_proxy": 0.52,
}
BINARY_ODDS = {
    "operating_system": {"Windows": 0.38, "MacOS": 0.16, "Linux": 0.10, "Android": 0.20, "iOS": 0.16},
    "device_type": {"desktop": 0.46, "mobile": 0.46, "tablet": 0.08},
    "country": {
        "United States": 0.28, "India": 0.18, "United Kingdom": 0.10, "Germany": 0.09, "France": 0.07,
        "Canada": 0.08, "Japan": 0.07, "Brazil": 0.06, "Singapore": 0.04, "Australia": 0.03,
    },
    "bot_linux": 0.45,
    "bot_desktop": 0.80,
    "human_proxy": 0.08,
    "bot_proxy": 0.72,
}
REGIONS = {
    "United States": ["California", "New York", "Texas", "Florida", "Illinois"],
    "India": ["Maharashtra", "Karnataka", "Delhi", "Tamil Nadu", "Telangana"],
    "United Kingdom": ["England", "Scotland", "Wales"],
    "Germany": ["Berlin", "Bavaria", "Hamburg"],
    "Canada": ["Ontario", "Quebec", "British Columbia"],
    "France": ["Ile-de-France", "Auvergne-Rhone-Alpes"],
    "Japan": ["Tokyo", "Osaka", "Kanagawa"],
    "Brazil": ["Sao Paulo", "Rio de Janeiro"],
    "Singapore": ["Central Singapore"],
    "Australia": ["New South Wales", "Victoria"],
}
DATACENTRE_PREFIXES = [1, 8, 34, 35, 44, 52, 54, 64, 66, 104, 128, 136, 138, 143, 159, 167, 185, 198, 207]
RESIDENTIAL_PREFIXES = [24, 47, 73, 86, 98, 101, 103, 115, 117, 122, 149, 172, 174, 188, 203]
BOT_AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) HeadlessChrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) HeadlessChrome/121.0.6167.85 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/118.0.5993.70 Safari/537.36",
]
