"""Names, tiers, orderings and presets that results depend on."""

# Hourly table columns.
TARGET = "capacity_factor"
TIME_FEATURES = ["month_cos", "month_sin", "hour_cos", "hour_sin"]
LAG_FEATURE = "capacity_factor_hist"
FORECAST_SUFFIX = "_pred"
HOURS_PER_DAY = 24

# Weather columns, from the most to the least telling.
IRRADIANCE = ["global_tilted_irradiance"]
HIGH = IRRADIANCE + ["vapour_pressure_deficit", "relative_humidity_2m"]
MEDIUM = HIGH + ["temperature_2m", "wind_gusts_10m", "cloud_cover_low", "wind_speed_100m"]
LOW = MEDIUM + ["snow_depth", "dew_point_2m", "surface_pressure", "precipitation"]
WEATHER = LOW
WEATHER_CATEGORIES = {
    "none": [],
    "solar_irradiance_only": IRRADIANCE,
    "high_weather": HIGH,
    "medium_weather": MEDIUM,
    "low_weather": LOW,
    "all_weather": WEATHER,
}

# Default date range and split.
DEFAULT_START = "2022-01-01"
DEFAULT_END = "2024-09-28"
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
TEST_RATIO = 0.1
RANDOM_SEED = 42

# Models and their reporting order.
DEEP_MODELS = ["LSTM", "GRU", "Transformer", "TCN"]
TREE_MODELS = ["RF", "XGB", "LGBM"]
LINEAR_MODEL = "Linear"
MODEL_ORDER = ["Linear", "RF", "XGB", "LGBM", "LSTM", "GRU", "TCN", "Transformer"]

# Experiment grid. Flags: history of power, history of weather, forecast, ideal forecast.
SCENARIOS = {
    "PV": (True, False, False, False),
    "PV+HW": (True, True, False, False),
    "PV+NWP": (True, False, True, False),
    "PV+NWP+": (True, False, True, True),
    "NWP": (False, False, True, False),
    "NWP+": (False, False, True, True),
}
POWER_SCENARIOS = ["PV", "PV+HW", "PV+NWP", "PV+NWP+"]
FORECAST_ONLY_SCENARIOS = ["NWP", "NWP+"]
GRID_LOOKBACKS = [24, 72]
GRID_COMPLEXITIES = ["low", "high"]
GRID_SIZE = 284
HOURS_PER_PLANT = 2.5
PLANTS_PER_BATCH = 25

# Study dimensions.
FEATURE_TIERS = {
    "SI": "solar_irradiance_only",
    "H": "high_weather",
    "H+M": "medium_weather",
    "H+M+L": "low_weather",
}
STUDY_LOOKBACKS = [24, 72, 120, 168]
COMPLEXITY_LEVELS = ["low", "mid_low", "mid_high", "high"]
TRAINING_SCALES = {"Low": 0.2, "Medium": 0.4, "High": 0.6, "Full": 0.8}
STUDIES = {
    1: "seasonal_effect",
    2: "hourly_effect",
    3: "weather_feature_adoption",
    4: "lookback_window",
    5: "model_complexity",
    6: "training_scale",
    7: "no_shuffle",
    8: "dataset_extension",
}
MULTI_HORIZONS = [1, 3, 6, 12, 24]

# Tree presets by complexity (trees, depth, learning rate).
TREE_PRESETS = {
    "low": (10, 1, 0.2),
    "mid_low": (20, 2, 0.15),
    "mid_high": (25, 2, 0.12),
    "high": (30, 3, 0.1),
}
# Deep presets by complexity (epochs, model width, hidden width, layers, channels).
DEEP_PRESETS = {
    "low": (20, 16, 8, 1, [8, 16]),
    "mid_low": (35, 24, 12, 1, [12, 24]),
    "mid_high": (50, 28, 14, 1, [14, 28]),
    "high": (50, 32, 16, 2, [16, 32]),
}
# Deep settings shared by all complexities.
DEEP_SHARED = {
    "batch_size": 64.0,
    "learning_rate": 0.001,
    "patience": 10.0,
    "min_delta": 0.001,
    "weight_decay": 0.0001,
    "num_heads": 2.0,
    "dropout": 0.1,
    "kernel_size": 3.0,
}
# Parameters each model accepts.
ALLOWED_PARAMS = {
    "RF": ["n_estimators", "max_depth", "random_state"],
    "XGB": ["n_estimators", "max_depth", "learning_rate", "verbosity"],
    "LGBM": ["n_estimators", "max_depth", "learning_rate", "random_state"],
    "Linear": [],
}
# Learning-rate plateau schedule.
PLATEAU = {"factor": 0.5, "patience": 5, "min_lr": 1e-7, "threshold": 1e-4}
