"""Band layout, class ranges, thresholds and file formats.

These must equal the published data sets' conventions for results to be
comparable; they are data, not logic.
"""

# --- fixed values: bands --------------------------------------------------
# Channel order of the two tile roles.
X_CHANNELS = ["vv_t0", "vh_t0", "vv_t1", "vh_t1", "r_t0", "g_t0", "b_t0", "nir_t0"]
LABEL_CHANNELS = ["r_t1", "g_t1", "b_t1", "nir_t1"]

# Band name -> columns that carry it.
X_BANDS = {"VV": ["vv_t0", "vv_t1"], "VH": ["vh_t0", "vh_t1"],
           "R": ["r_t0"], "G": ["g_t0"], "B": ["b_t0"], "NIR": ["nir_t0"]}
LABEL_BANDS = {"R": ["r_t1"], "G": ["g_t1"], "B": ["b_t1"], "NIR": ["nir_t1"]}

# Band groups that share one scaler.
SAR_GROUPS = {"VV": ["vv_t0", "vv_t1"], "VH": ["vh_t0", "vh_t1"]}
OPTICAL_GROUPS = {"R,G,B": ["r_t0", "g_t0", "b_t0", "r_t1", "g_t1", "b_t1"],
                  "NIR": ["nir_t0", "nir_t1"]}
SAR_FACTOR = 1 / 2
OPTICAL_FACTOR = 1 / 5
OPTICAL_RANGE = (-1.0, 1.0)

REFLECTANCE_SCALE = 10000.0
MASK_SCALE = 5.0
SAR_SCALE = 1.0
TILE_SIZE = 256
SPLITS = ["train", "val", "test"]
ROLE_LAYOUT = {"dataX": [(1, 0), (1, 1), (2, 0)], "label": [(2, 1)]}

# --- fixed values: vegetation indices and classes ---------------------------
EVI = {"L": 1.0, "G": 2.5, "C1": 6.0, "C2": 7.5}
SEVERITY_CLASSES = [("unburnt", -1.0, 0.09), ("low", 0.09, 0.14), ("moderate", 0.14, 0.22),
                    ("high", 0.22, 0.34), ("very_high", 0.34, 0.44), ("extreme", 0.44, 2.0)]
CHANGE_THRESHOLD = 0.14
SLOPE_CLASSES = [("gentle", 0.0, 10.0), ("moderate", 10.0, 25.0),
                 ("steep", 25.0, 35.0), ("very steep", 35.0, 90.0)]
# (name, class id, low, high): half-open degrees, flat is the value -1 itself.
ASPECT_CLASSES = [("North", 1, 0.0, 22.5), ("NorthEast", 2, 22.5, 67.5), ("East", 3, 67.5, 112.5),
                  ("SouthEast", 4, 112.5, 157.5), ("South", 5, 157.5, 202.5),
                  ("SouthWest", 6, 202.5, 247.5), ("West", 7, 247.5, 292.5),
                  ("NorthWest", 8, 292.5, 337.5), ("North", 1, 337.5, 360.0)]
ASPECT_FLAT = (-1.0, 0)
N_LAND_CLASSES = 24

# --- fixed values: tile rejection -------------------------------------------
CLOUD_PIXEL_LIMIT = 20
MIN_NONZERO_SHARE = 0.7
CLOUD_MASK_VALUES = (2, 3)

# --- fixed values: cloud scoring --------------------------------------------
CLOUD_THRESHOLD = 0.2
DILATION_RADIUS = 3.0
EROSION_RADIUS = 1.5
WATER_NDVI = -0.1
DARK_SUM = 0.3
ZONE_CLOUD_MAX = 0.1
CLOUD_HEIGHTS = (200, 10000, 250)

# --- fixed values: scene catalogue ------------------------------------------
S1_DEFAULTS = {"product_type": "GRD", "mode": "IW", "instrument": "C-SAR"}
S2_DEFAULTS = {"instrument": "MSI", "processing_level": "L2A"}
AREA_FACTOR = 1.0
GRID_CELL_DEGREES = {1: 5, 2: 5, 3: 40}

# --- fixed values: scene-description file format ----------------------------
SCENE_XML_ROOT = "AUSCOPHUB_SAFE_FILEDESCRIPTION"
SCENE_XML_TILE_SOURCE = "AUSCOPHUB"

# --- fixed values: ellipsoid and projections --------------------------------
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
EARTH_RADIUS_M = 6371008.8
ALBERS_AU = {"lat1": -18.0, "lat2": -36.0, "lat0": 0.0, "lon0": 132.0}
MGRS_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"

# --- fixed values: one-look intensity speckle, 90 % sigma range -------------
SIGMA_RANGE_90 = {"low": 0.084, "high": 3.941, "std": 0.8191}
