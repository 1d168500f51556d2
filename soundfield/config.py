"""Constants of the campaign and of the published methods.

Fixed values: they must equal the published ones for results to agree.
"""

# geometry of the analysis, metres
FEATURE_RADIUS_M = 300.0
BUFFER_M = 300.0
BLOCK_M = 600.0
GRID_STEP_M = 40.0
ENVELOPE_MARGIN_M = 400.0
ROAD_ABSENT_M = 2000.0
KERNEL_FLOOR_M = 5.0

# time
MAP_HOURS = (5, 21)
REFERENCE_HOUR = 17
LOCAL_ZONE = "Asia/Bangkok"

# legal limits, dB
LIMIT_DAY = 70
LIMIT_NIGHT = 55

# evaluation
N_FOLDS = 5
N_BOOT = 2000
SEED = 0
MIN_TRAINING_ROWS = 20

# video counting
MATCH_MAX_S = 300
SAMPLE_FPS = 10.0
DEAD_BAND = 0.05
VEHICLE_CLASSES = ("bicycle", "car", "moto", "bus", "truck")
MOTOR_CLASSES = ("moto", "car", "bus", "truck")

# construction sources
CONSTRUCTION_REF_M = 56.0
CONSTRUCTION_REF_DB = 64.7
CONSTRUCTION_RADIUS_M = 250.0
CONSTRUCTION_MIN_M = 25.0
CONSTRUCTION_NEAR_M = 200.0
CORRIDOR_M = 150.0

# scenarios
AMBIENT_SHARE = 0.05
ZONE30_DB = -3.0
ZONE30_REACH_M = 150.0
PEDESTRIAN_FACTOR = 0.2

# delivered kernel: A_highway, A_residential, B
PUBLISHED_KERNEL = {"a_hw": 4.774e7, "a_res": 3.800e7, "b": 1.1e-10}

# study areas: name, latitude, longitude
SITE_CENTRES = (
    ("Hoan Kiem lake", 21.0317, 105.8514),
    ("Vinh Tuy area", 20.9928, 105.8690),
    ("Ocean Park", 20.9922, 105.9441),
)
SITE_RADIUS_M = 2000.0
MAJOR_SITES = ("Vinh Tuy area", "Hoan Kiem lake")

MAJOR_HIGHWAYS = (
    "motorway", "motorway_link", "trunk", "trunk_link",
    "primary", "primary_link", "secondary", "secondary_link",
)

DISTANCE_BANDS = {
    "d_0_10": "0-10 m (v1)", "d_0_2": "0-2 m", "d_2_10": "2-10 m",
    "d_10_30": "10-30 m", "d_30_60": "30-60 m", "d_60plus": "> 60 m",
}
ROADSIDE_PATTERN = "0-2|0-10|2-10"

# additive level offset per collector; collectors not listed have none
CALIBRATION_OFFSETS: dict[str, float] = {}

# columns that may leave the building; everything else stays in
PUBLISHED_COLUMNS = (
    "latitude", "longitude", "noise_db", "timestamp", "class", "site", "hour", "is_weekend",
)
PUBLISHED_EXTRAS = (
    "temperature_2m", "wind_speed_10m", "precipitation", "dist_to_road",
    "count_motorbikes", "count_cars", "count_heavy", "count_ev",
    "construction_nearby", "dist_to_source_m",
)
