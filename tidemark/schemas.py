"""Schemas of what the readers take and the runs hold."""

DRIFTERS = "ID string, time timestamp_ntz, latitude double, longitude double, drogue_lost_date timestamp_ntz"
SCENE_PIXELS = (
    "scene_id string, row int, col int, lat float, lon float, B1 float, B2 float, B3 float, B4 float, B5 float, B6 float, B7 float, B8 float, B8A float, B11 float, B12 float, valid boolean"
)
SWATH = "row int, col int, wavelength float, rhos float"
SWATH_PIXELS = "row int, col int, lat float, lon float, l2_flags bigint"
FIELD = "kind string, source string, t timestamp_ntz, lat double, lon double, u float, v float"
CATALOGUE = "item_id string, datetime timestamp_ntz, cloud_cover double, epsg int, boa_offset_applied boolean"
GRANULES = "granule string, boundary array<struct<lon:double,lat:double>>, cloud_cover double, start timestamp_ntz"
POINT_FORECAST = "hourly struct<time:array<string>,ocean_current_velocity:array<double>,ocean_current_direction:array<double>,wind_speed_10m:array<double>,wind_direction_10m:array<double>>"
LABELLED_PIXELS = "split string, patch string, row int, col int, B1 float, B2 float, B3 float, B4 float, B5 float, B6 float, B7 float, B8 float, B8A float, B11 float, B12 float, cls int, conf int"
HOTSPOTS = (
    "run string, id string, lat double, lon double, pixels long, area_km2 double, radius_km double, max_z double, mean_fdi double, mean_ndvi double, cloud_edge_fraction double, confidence double, sensor string, observed timestamp_ntz"
)
RINGS = "ring_id int, seq int, lat double, lon double"
