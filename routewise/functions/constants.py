"""Fixed values that must equal the reference's for right results.

# --- fixed values (domain vocabulary and business thresholds) -------------
"""

# --- fixed values ----------------------------------------------------------
PEAK_PERIODS = ["AM_peak", "PM_peak"]
TIME_PERIODS = ["AM_peak", "midday", "PM_peak", "off_peak"]
WEEKEND_DAYS = ["Saturday", "Sunday"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
OVERCROWDED_LOAD = 1.0
ON_TIME_MAX_DELAY_MIN = 5
LOAD_FACTOR_RANGE = (0.0, 1.5)
SATISFACTION_RANGE = (1, 5)
ON_TIME_TARGET = 0.80
NULL_RATE_WARN = 0.20

VEHICLE_TYPES = ["traditional", "modernized_PUV"]
FUEL_TYPES = ["diesel", "euro4_diesel", "electric"]
FRANCHISE_TYPES = ["individual", "cooperative", "corporation"]
STOP_TYPES = ["terminal", "market", "school", "hospital", "mall", "residential"]
DESTINATION_TYPES = ["work", "school", "market", "hospital", "mall"]
TRIP_PURPOSES = ["daily_commute", "occasional", "weekend_only"]
INCOME_BRACKETS = ["low", "middle", "high"]
AB_GROUPS = ["control", "treatment"]

# SQL-side encodings (1-based, unknown -> NULL)
INCOME_CODE_SQL = {"low": 1, "middle": 2, "high": 3}
DESTINATION_CODE = {"work": 1, "school": 2, "market": 3, "hospital": 4, "mall": 5}
PURPOSE_CODE = {"daily_commute": 1, "occasional": 2, "weekend_only": 3}
# Clustering-side income encoding (0-based, unknown/NULL -> 1)
INCOME_CODE_ML = {"low": 0, "middle": 1, "high": 2}
INCOME_CODE_ML_DEFAULT = 1

CLUSTER_LABELS = {
    0: "Student Commuters",
    1: "Market Workers",
    2: "CBD Workers",
    3: "Underserved Riders",
    4: "Occasional Riders",
}
UNDERSERVED_CLUSTER = 3
UNDERSERVED_LABEL = "Underserved Riders"

# Clustering features, in matrix order
FEATURE_COLS = ["trips_per_week", "avg_fare_paid_php", "transfers_required",
                "wait_time_min", "travel_time_min", "satisfaction_score",
                "income_bracket_encoded"]
K_RANGE = list(range(2, 11))
OPTIMAL_K = 5
RANDOM_STATE = 42
DIAG_RESTARTS = 10
FINAL_RESTARTS = 20
DIAG_MAX_ITER = 300
FINAL_MAX_ITER = 500
SILHOUETTE_SAMPLE = 2000
DBSCAN_EPS = 1.2
DBSCAN_MIN_SAMPLES = 15
# Greedy prototype matching order for semantic cluster ids
REMAP_ORDER = [3, 2, 0, 4, 1]

# A/B experiment
ALPHA = 0.05
Z_95 = 1.96
CONTROL_BASE_TRAVEL_MIN = 55
BASE_FARE_PHP = 26.00
SPLIT_BALANCE_PCT = (40, 60)
EFFECT_SIZE_CUTS = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]
EFFECT_SIZE_TOP = "large"

# Severity tiers: (min wait, min transfers, max score) -> score
SEVERITY_TIERS = [((45, 2, 2), 1.00), ((35, 1, 3), 0.75), ((25, None, None), 0.50)]
SEVERITY_DEFAULT = 0.25
# Weighted severity for cluster 3
SEVERITY_WEIGHTS = {"transfers": 0.35, "wait": 0.01, "inv_score": 0.30, "travel": 0.005}

# Fare and period rules of the trip generator (re-aimed as audit expressions)
FARE_BASE_KM = 4
BASE_FARE = 13.0
ROUTE_BASE_FARE = {11: 15.0}  # routes with a base fare of their own
FARE_PER_KM = 1.50
PERIOD_HOURS = [(6, 9, "AM_peak"), (9, 17, "midday"), (17, 20, "PM_peak")]

RECENT_DAYS = 30
