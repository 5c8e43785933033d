"""The region, thresholds, weights and small dimension tables that results must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Region, motion and detection settings.
REGION = {"lat_min": 4.0, "lat_max": 23.0, "lon_min": 79.0, "lon_max": 96.0}
EARTH_KM = 6371.0
METRES_PER_DEGREE = 111_320.0
KM_PER_DEGREE = 111.32
FORECAST_HOURS, STEP_HOURS, PARTICLES = 48, 1.0, 300
WINDAGE = (0.02, 0.03)
DIFFUSIVITY, CURRENT_SIGMA, SEED = 20.0, 0.16, 42
Z_THRESHOLD, MIN_PIXELS, MAX_HOTSPOTS = 3.5, 2, 25
RISK_WEIGHTS = {"confidence": 0.35, "proximity": 0.25, "beaching": 0.15, "persistence": 0.15, "certainty": 0.10}
TIERS = (("High", 60.0), ("Medium", 40.0))
RECURRENCE_KM, BACKTRACK_HOURS, MOUTH_KM = 15.0, 72, 60.0
BAND_NM = {"B4": 664.8, "B8": 832.8, "B11": 1612.0}
COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")

# Texts of actions and of source attribution.
ACTIONS = {
    "ashore": "Seen %d h ago; the drift model says it has most likely already washed ashore near %.2fN %.2fE: send a beach cleanup / survey team.",
    "beaching": "Likely to wash ashore near %.2fN %.2fE: half of the forecast particles are ashore by +%.0f h (%.0f%% by +48 h). Send a shoreline cleanup team and alert %s.",
    "High": "Deploy a cleanup vessel within 24 h; intercept near %.2fN %.2fE before it reaches %s.",
    "Medium": "Schedule a patrol and re-check the next satellite pass; watch the approach to %s.",
    "Low": "Monitor: low confidence or far from sensitive coast.",
}
ORIGINS = {
    "mouth": "%.0f%% of back-tracked particles reach the coast within %d h, mostly near the %s: likely a river-borne, land-based source.",
    "coast": "%.0f%% of back-tracked particles reach the nearby coastline within %d h: likely a local coastal source.",
    "sea": "Stayed at sea for the last %d h: about %.0f km %s of here %d days ago. Source further upstream than %d h.",
}

# Sensitive sites, in order (ties go to the first).
SITES = (
    ("Sundarbans mangroves", "Mangrove / UNESCO site", 21.75, 89.20, 1.0),
    ("Bhitarkanika & Gahirmatha", "Mangrove / turtle nesting", 20.70, 87.00, 1.0),
    ("Rushikulya rookery", "Olive ridley nesting", 19.37, 85.07, 0.9),
    ("Chilika Lake mouth", "Ramsar lagoon", 19.70, 85.45, 0.9),
    ("Coringa mangroves (Godavari)", "Mangrove sanctuary", 16.75, 82.30, 0.9),
    ("Krishna mangroves", "Mangrove sanctuary", 15.80, 81.00, 0.8),
    ("Pulicat Lake", "Ramsar lagoon", 13.55, 80.30, 0.8),
    ("Pichavaram mangroves", "Mangrove", 11.43, 79.80, 0.8),
    ("Point Calimere", "Ramsar wetland", 10.30, 79.85, 0.8),
    ("Mahatma Gandhi Marine NP (Andaman)", "Coral reef park", 11.55, 92.60, 1.0),
    ("Ritchie's Archipelago (Andaman)", "Coral reef", 12.10, 93.05, 0.9),
    ("St. Martin's Island", "Coral island", 20.62, 92.32, 1.0),
    ("Cox's Bazar coast", "Beach / fisheries", 21.43, 91.97, 0.7),
    ("Trincomalee coast", "Coral reef / fisheries", 8.58, 81.23, 0.8),
    ("Kolkata-Haldia port", "Major port", 22.02, 88.08, 0.6),
    ("Paradip port", "Major port", 20.26, 86.68, 0.6),
    ("Visakhapatnam port", "Major port", 17.69, 83.29, 0.6),
    ("Chennai port & Marina", "Major port / beach", 13.08, 80.30, 0.7),
    ("Chittagong port", "Major port", 22.27, 91.80, 0.6),
)

# River mouths, in order.
MOUTHS = (
    ("Hooghly (Ganga) mouth", 21.62, 88.10),
    ("Subarnarekha mouth", 21.58, 87.45),
    ("Brahmani-Baitarani mouth", 20.72, 87.02),
    ("Mahanadi mouth", 20.30, 86.72),
    ("Godavari mouth", 16.62, 82.30),
    ("Krishna mouth", 15.75, 80.95),
    ("Penner mouth", 14.60, 80.18),
    ("Chennai rivers (Adyar/Cooum)", 13.05, 80.28),
    ("Cauvery mouth", 11.35, 79.85),
    ("Meghna (Ganges-Brahmaputra) estuary", 22.40, 90.80),
    ("Karnaphuli mouth (Chittagong)", 22.22, 91.80),
    ("Irrawaddy delta", 15.85, 95.10),
)

# Offshore approach points of ports, in order.
PORTS = (
    ("Chennai", 13.09, 80.37),
    ("Ennore (Kamarajar)", 13.26, 80.38),
    ("Kakinada", 16.98, 82.40),
    ("Visakhapatnam", 17.65, 83.36),
    ("Paradip", 20.25, 86.74),
    ("Haldia (Sagar Roads)", 21.45, 88.00),
    ("Chittagong", 22.12, 91.70),
    ("Port Blair", 11.66, 92.80),
)

# Classes of the pixel classifier by id.
FLOATING_CLASSES = (1, 2, 3)
REJECTED_CLASSES = (5, 6, 12, 13, 14)
ANNOTATOR_WEIGHTS = {1: 1.0, 2: 0.7, 3: 0.4}


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(SITES)], "ord int, name string, type string, lat double, lon double, weight double")


def mouths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(MOUTHS)], "ord int, name string, lat double, lon double")


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(PORTS)], "ord int, name string, lat double, lon double")


def values_sql(rows, columns: str) -> str:
    """A SELECT of literal rows with their order, for SQL engines."""
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) if isinstance(v, int) else f"CAST({v} AS double)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(text(v) for v in (i, *r)) + ')' for i, r in enumerate(rows))}) t(ord, {columns})"

# Names of the classes, and of what a run's source texts mention.
CLASS_NAMES = {
    1: "Marine Debris", 2: "Dense Sargassum", 3: "Sparse Sargassum", 4: "Natural Organic Material", 5: "Ship", 6: "Clouds", 7: "Marine Water", 8: "Sediment-Laden Water", 9: "Foam",
    10: "Turbid Water", 11: "Shallow Water", 12: "Waves", 13: "Cloud Shadows", 14: "Wakes", 15: "Mixed Water",
}
SOURCES = {
    "PACE": (("detection", "PACE"),), "Sentinel-2": (("detection", "Sentinel-2"),), "OSCAR": (("currents", "OSCAR"),), "MERRA-2": (("wind", "MERRA-2"),),
    "Forecast": (("currents", "Open-Meteo"), ("wind", "Open-Meteo")),
}

# Scene classes (water, and what is masked with a buffer of so many pixels), kilometres of shore that are left out (coarse and fine pixels).
WATER_CLASS, MASKED_CLASSES, MASK_STEPS = 6, (3, 8, 9, 10), 5
SHORE_KM = {False: 2.5, True: 0.4}
