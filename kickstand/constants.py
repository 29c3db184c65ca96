"""Fixed values of the fleet domain.

Every table below is a fixed value: results must match these numbers and words,
so they are stated plainly and kept together. Each one has fewer than 100 entries.
"""

# --- vendors (fixed values) -------------------------------------------------------
VENDORS = ("Lyft", "Lime", "Spin", "Coco")
FALLBACK_VENDOR = "Coco"
VENDOR_ALIASES = {
    "lyft": "Lyft",
    "lime": "Lime",
    "spin": "Spin",
    "coco": "Coco",
    "bird": "Coco",
    "tier": "Coco",
    "superpedestrian": "Spin",
}
VENDOR_CODES = {"Lyft": "LY", "Lime": "LI", "Spin": "SP", "Coco": "CO"}
VENDOR_SHARE_FLOORS = {"Lyft": 0.28, "Lime": 0.25, "Spin": 0.10, "Coco": 0.07}
VENDOR_INTENSITY = {"Lyft": 1.0, "Lime": 0.98, "Spin": 1.05, "Coco": 1.08}

# --- calendar and place (fixed values) --------------------------------------------
# last hour of each band, in order of the day
HOUR_BANDS = {"late_night": 5, "morning": 9, "midday": 15, "evening": 19, "night": 23}
AREA_TYPES = ("downtown", "campus", "industrial", "residential")
DEFAULT_AREA_TYPE = "residential"
LOCATION_SUFFIX = ", Chicago, IL, USA"

# --- raw trip headers, by logical name (fixed values) -----------------------------
TRIP_HEADERS = {
    "start_time": [
        "start_time", "started_at", "trip_start", "startdatetime", "starttimestamp", "startdate", "starttime",
    ],
    "vendor": ["vendor", "provider", "provider_name", "company", "operator"],
    "start_area_name": [
        "start_community_area_name", "start_area_name", "start_neighborhood", "start_zone_name", "start_community_area",
    ],
    "end_area_name": [
        "end_community_area_name", "end_area_name", "end_neighborhood", "end_zone_name", "end_community_area",
    ],
    "start_area_num": ["start_community_area_number", "start_area_id", "start_area_code"],
    "end_area_num": ["end_community_area_number", "end_area_id", "end_area_code"],
    "distance_m": ["distance_m", "trip_distance_m", "distance", "distance_meters"],
    "distance_km": ["distance_km", "trip_distance_km", "km"],
}
REQUIRED_TRIP_HEADERS = ("start_time", "vendor")

# --- demand calibration (fixed values) --------------------------------------------
DEFAULT_MONTH_MULTIPLIER = {
    1: 0.60, 2: 0.65, 3: 0.72, 4: 0.85, 5: 0.95, 6: 1.05, 7: 1.10, 8: 1.12, 9: 1.05, 10: 1.00, 11: 0.75, 12: 0.55,
}
DEFAULT_WEEKEND_BOOST = 1.08
DEFAULT_DAILY_TRIPS = 50000.0
MIN_CITY_TRIPS = 5000
VENDOR_BAND_BIAS = {
    "Lyft": {"morning": 1.05, "midday": 1.00, "evening": 1.08, "night": 0.98, "late_night": 0.95},
    "Lime": {"morning": 1.02, "midday": 1.04, "evening": 1.05, "night": 1.00, "late_night": 0.96},
    "Spin": {"morning": 0.95, "midday": 0.98, "evening": 1.05, "night": 1.12, "late_night": 1.22},
    "Coco": {"morning": 0.92, "midday": 0.96, "evening": 1.08, "night": 1.18, "late_night": 1.28},
}
VENDOR_AREA_BIAS = {
    "Lime": {"downtown": 1.08},
    "Spin": {"residential": 1.10, "industrial": 1.10},
    "Coco": {"campus": 1.25},
}

# --- fleet (fixed values) ---------------------------------------------------------
TRIPS_PER_VEHICLE_DAY = {"Lyft": 7.5, "Lime": 7.0, "Spin": 6.5, "Coco": 5.0}
DEFAULT_TRIPS_PER_VEHICLE_DAY = 7.0
MIN_FLEET = 60
DEFAULT_TRIP_KM = 1.9
ENERGY_PER_TRIP_WH = {"Lyft": 35, "Lime": 34, "Spin": 33, "Coco": 30}
DEFAULT_ENERGY_PER_TRIP_WH = 33

# --- incidents (fixed values) -----------------------------------------------------
INCIDENT_RATE_PER_1K = {
    "battery_failure": 0.35,
    "crash": 0.22,
    "illegal_parking": 0.45,
    "vandalism": 0.18,
    "theft": 0.06,
    "complaint": 0.20,
}
TRIP_RELATED_INCIDENTS = ("crash", "complaint")
INCIDENT_BAND_MULT = {
    "battery_failure": {"late_night": 0.9, "morning": 1.0, "midday": 1.0, "evening": 1.05, "night": 1.1},
    "crash": {"late_night": 0.8, "morning": 1.2, "midday": 1.05, "evening": 1.35, "night": 1.1},
    "illegal_parking": {"late_night": 1.25, "morning": 0.9, "midday": 1.0, "evening": 1.2, "night": 1.35},
    "vandalism": {"late_night": 1.5, "morning": 0.7, "midday": 0.8, "evening": 1.1, "night": 1.3},
    "theft": {"late_night": 1.4, "morning": 0.7, "midday": 0.8, "evening": 1.1, "night": 1.3},
    "complaint": {"late_night": 1.1, "morning": 1.0, "midday": 1.0, "evening": 1.1, "night": 1.2},
}
INCIDENT_AREA_MULT = {
    "battery_failure": {"downtown": 1.05, "campus": 1.0, "industrial": 0.95, "residential": 1.0},
    "crash": {"downtown": 1.25, "campus": 1.05, "industrial": 0.95, "residential": 0.95},
    "illegal_parking": {"downtown": 1.35, "campus": 1.25, "industrial": 0.8, "residential": 1.0},
    "vandalism": {"downtown": 1.1, "campus": 1.0, "industrial": 1.2, "residential": 1.1},
    "theft": {"downtown": 1.2, "campus": 1.1, "industrial": 1.2, "residential": 1.0},
    "complaint": {"downtown": 1.2, "campus": 1.1, "industrial": 0.9, "residential": 1.0},
}
# January to December
INCIDENT_MONTH_MULT = {
    "battery_failure": [1.25, 1.25, 1.15, 1.05, 1.0, 0.95, 0.9, 0.9, 0.95, 1.0, 1.1, 1.2],
    "crash": [0.8, 0.85, 0.9, 1.0, 1.05, 1.1, 1.15, 1.15, 1.05, 1.0, 0.9, 0.85],
    "illegal_parking": [0.9, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.2, 1.1, 1.0, 0.95, 0.9],
    "vandalism": [1.0, 1.0, 1.0, 1.05, 1.05, 1.1, 1.15, 1.2, 1.1, 1.05, 1.0, 1.0],
    "theft": [1.0, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.25, 1.15, 1.05, 1.0, 1.0],
    "complaint": [0.95, 0.95, 1.0, 1.0, 1.05, 1.05, 1.1, 1.1, 1.05, 1.0, 1.0, 0.95],
}

# --- status events (fixed values) -------------------------------------------------
PICKUP_EVENT = "maintenance_pickup"
DROPOFF_EVENT = "maintenance_dropoff"
STATUS_SLA_MINUTES = {"battery_low": 120, "rebalance": 180, "offline": 60, "maintenance": 480}
OFFLINE_EVENTS = ("offline", "maintenance")
STATUS_RATE_PER_1K = {"battery_low": 1.6, "rebalance": 1.3}
STATUS_RATE_PER_VEHICLE_HOUR = {"offline": 0.0022, "maintenance": 0.00025}
DEPLOY_PER_ACTIVE = 0.015
RETRIEVE_PER_ACTIVE = 0.020
STATUS_BAND_MULT = {
    "battery_low": {"late_night": 0.8, "morning": 1.0, "midday": 1.0, "evening": 1.15, "night": 1.1},
    "rebalance": {"late_night": 0.9, "morning": 1.25, "midday": 1.0, "evening": 1.2, "night": 0.9},
    "offline": {"late_night": 1.15, "morning": 1.0, "midday": 1.0, "evening": 1.1, "night": 1.2},
    "maintenance": {"late_night": 0.8, "morning": 1.0, "midday": 1.1, "evening": 1.0, "night": 0.9},
}
STATUS_AREA_MULT = {
    "battery_low": {"downtown": 1.05, "campus": 1.0, "industrial": 0.95, "residential": 1.0},
    "rebalance": {"downtown": 1.25, "campus": 1.15, "industrial": 0.9, "residential": 1.0},
    "offline": {"downtown": 1.1, "campus": 1.0, "industrial": 0.95, "residential": 1.0},
    "maintenance": {"downtown": 1.0, "campus": 1.0, "industrial": 1.1, "residential": 1.0},
}

# --- tasks (fixed values) ---------------------------------------------------------
TASK_SLA_MINUTES = {"battery_swap": 120, "rebalance": 180, "pickup_illegal_parking": 90, "repair": 1440}
TASK_RATE_PER_1K = {"battery_swap": 1.2, "rebalance": 1.4, "pickup_illegal_parking": 0.9, "repair": 0.35}
TASK_BAND_MULT = {
    "battery_swap": {"late_night": 0.7, "morning": 1.0, "midday": 1.05, "evening": 1.15, "night": 1.1},
    "rebalance": {"late_night": 0.9, "morning": 1.25, "midday": 1.0, "evening": 1.2, "night": 0.9},
    "pickup_illegal_parking": {"late_night": 1.25, "morning": 0.85, "midday": 1.0, "evening": 1.15, "night": 1.35},
    "repair": {"late_night": 0.8, "morning": 1.0, "midday": 1.05, "evening": 1.1, "night": 0.95},
}
TASK_AREA_MULT = {
    "battery_swap": {"downtown": 1.05, "campus": 1.0, "industrial": 0.95, "residential": 1.0},
    "rebalance": {"downtown": 1.3, "campus": 1.15, "industrial": 0.9, "residential": 1.0},
    "pickup_illegal_parking": {"downtown": 1.35, "campus": 1.25, "industrial": 0.8, "residential": 1.0},
    "repair": {"downtown": 1.1, "campus": 1.05, "industrial": 1.1, "residential": 1.0},
}
TASK_PRIORITY = {"battery_swap": 2, "rebalance": 2, "pickup_illegal_parking": 1, "repair": 2}
DEFAULT_TASK_PRIORITY = 2
# ops cost in USD: fixed part, part per km moved
TASK_COST = {
    "battery_swap": (6.0, 0.8),
    "rebalance": (5.0, 0.6),
    "pickup_illegal_parking": (7.0, 1.0),
    "repair": (8.0, 0.5),
}
DEFAULT_TASK_COST = 3.0
INCIDENT_TASKS = {"illegal_parking": "pickup_illegal_parking", "crash": "repair", "vandalism": "repair"}
STATUS_TASKS = {"battery_low": "battery_swap", "rebalance": "rebalance"}
LINKED_SOURCE = "incident_link"
STARTED_STATUSES = ("assigned", "done", "canceled")
