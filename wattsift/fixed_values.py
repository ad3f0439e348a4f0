"""Fixed values.

Names, cut-offs and sentences that results must carry exactly. Everything here is
data; the code that uses it lives elsewhere.
"""

# --- layouts: standard column -> accepted raw names, in order of preference -------------
STATE_LAYOUT = "india_smart_meters"
ACORN_LAYOUT = "london_smart_meters"

COLUMN_ALIASES = {
    STATE_LAYOUT: {
        "consumer_id": ["Consumer_ID", "consumer_id", "ConsumerID", "Meter_Number", "meter_id", "id"],
        "timestamp": ["DateTime", "timestamp", "datetime", "Reading_Time", "date_time"],
        "consumption": ["KWH", "kwh", "consumption", "Units", "energy", "KWH/hh", "consumption_kWh"],
        "state": ["State", "state", "STATE"],
        "discom": ["DISCOM", "discom", "Utility", "Distribution_Company"],
        "city": ["City", "city", "District", "Location"],
        "consumer_type": ["Consumer_Type", "consumer_type", "Category", "Tariff_Type"],
        "tariff": ["Tariff_Category", "tariff", "Tariff"],
    },
    ACORN_LAYOUT: {
        "consumer_id": ["LCLid", "consumer_id", "id", "meter_id"],
        "timestamp": ["DateTime", "timestamp", "datetime", "date_time"],
        "consumption": ["KWH/hh", "consumption_kWh", "kwh", "energy", "consumption"],
        "acorn_group": ["Acorn_grouped", "acorn", "acorn_group", "region"],
    },
}

LAYOUT_MARKERS = {
    STATE_LAYOUT: ["state", "discom", "consumer_type", "tariff_category", "city"],
    ACORN_LAYOUT: ["acorn", "lclid", "stdortou"],
}

# --- zones, in the order in which they are tried ----------------------------------------
ACORN_ZONES = {
    "Zone A": ["ACORN-A", "ACORN-B", "ACORN-C"],
    "Zone B": ["ACORN-D", "ACORN-E", "ACORN-F"],
    "Zone C": ["ACORN-G", "ACORN-H", "ACORN-I"],
    "Zone D": ["ACORN-J", "ACORN-K", "ACORN-L"],
    "Zone E": ["ACORN-M", "ACORN-N", "ACORN-O", "ACORN-P", "ACORN-Q"],
    "Zone F": ["ACORN-U", "Affluent", "Comfortable", "Adversity"],
}
DEFAULT_ACORN_ZONE = "Zone F"

STATE_ZONES = {
    "North India": ["UP", "DL", "HR", "PB", "RJ", "UK", "HP", "JK", "CH", "LD"],
    "West India": ["MH", "GJ", "GO", "DD", "DN"],
    "South India": ["KA", "TN", "KL", "AP", "TS", "PY"],
    "East India": ["WB", "BR", "JH", "OR", "AS", "SK", "TR", "MN", "NL", "ML", "MZ", "AR"],
    "Central India": ["MP", "CG"],
}
UNKNOWN = "Unknown"

STATE_NAMES = {
    "UP": "Uttar Pradesh", "MH": "Maharashtra", "DL": "Delhi", "KA": "Karnataka",
    "GJ": "Gujarat", "TN": "Tamil Nadu", "WB": "West Bengal", "RJ": "Rajasthan",
    "MP": "Madhya Pradesh", "AP": "Andhra Pradesh", "TS": "Telangana", "KL": "Kerala",
    "BR": "Bihar", "HR": "Haryana", "PB": "Punjab", "OR": "Odisha", "AS": "Assam",
    "JH": "Jharkhand", "UK": "Uttarakhand", "HP": "Himachal Pradesh", "CG": "Chhattisgarh",
    "JK": "Jammu & Kashmir", "GO": "Goa", "TR": "Tripura", "MN": "Manipur", "ML": "Meghalaya",
    "NL": "Nagaland", "MZ": "Mizoram", "AR": "Arunachal Pradesh", "SK": "Sikkim",
    "CH": "Chandigarh", "PY": "Puducherry", "DD": "Daman & Diu", "DN": "Dadra & Nagar Haveli",
    "LD": "Ladakh",
}

# --- text that a CSV reader with the usual defaults takes as missing ---------------------
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- model inputs -------------------------------------------------------------------------
MODEL_FEATURES = [
    "avg_consumption", "std_consumption", "cv_consumption", "range_ratio", "night_day_ratio",
    "weekend_weekday_ratio", "off_peak_ratio", "low_consumption_flag", "high_variability_flag",
    "unusual_night_flag",
]
BASIC_MODEL_FEATURES = [
    "avg_consumption", "std_consumption", "min_consumption", "max_consumption",
    "night_usage_ratio", "weekend_readings_ratio", "peak_usage_ratio",
]
RATIO_EPSILON = 1e-6

# --- status -------------------------------------------------------------------------------
STATUS_CUTOFFS = [("High Risk", 0.9), ("Suspicious", 0.75), ("Review Needed", 0.5)]
NORMAL = "Normal"
STATUS_COLORS = {
    "High Risk": "#DC2626", "Suspicious": "#F59E0B", "Review Needed": "#3B82F6", "Normal": "#10B981",
}
DEFAULT_COLOR = "#6B7280"
FOREST_WEIGHT, AUTOENCODER_WEIGHT = 0.6, 0.4

# --- profiles: (label, words that mark the type) for the type rules -------------------------
TYPE_PROFILES = [
    ("Agricultural Pump", "AGR", "agri"),
    ("Industrial", "IND", "industrial"),
    ("Commercial", "COM", "commercial"),
]

# --- explanation sentences ------------------------------------------------------------------
SAY_IRREGULAR = "Detected highly irregular consumption pattern."
SAY_SUSPICIOUS = "Detected suspicious consumption behavior."
SAY_NIGHT_HIGH = "Unusually high nighttime consumption compared to daytime."
SAY_NIGHT_LOW = "Very low nighttime consumption which may indicate meter bypass during billing periods."
SAY_WEEKEND_HIGH = "Significant spike in weekend usage compared to weekdays."
SAY_WEEKEND_LOW = "Weekend usage abnormally low compared to weekday patterns."
SAY_VARIABLE = "High variability in consumption suggests irregular usage patterns."
SAY_LOW = "Consistently low readings may indicate meter tampering."
SAY_DEFAULT = "Consumption pattern deviates from normal behavior based on ML analysis."

# --- reading flags --------------------------------------------------------------------------
READING_ZERO = "Zero/Near-zero reading - possible meter bypass"
READING_LOW = "Unusually low reading"
READING_SPIKE = "Unusually high spike"
READING_NIGHT = "High consumption during night hours (1-5 AM)"
ZERO_READING = 0.005
LOWEST_LOW_THRESHOLD = 0.01
