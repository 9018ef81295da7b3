"""Fixed values.

Everything in this module must stay exactly as it is for results to be right:
names, word lists, colours, thresholds, default texts and file formats.
No logic lives here.
"""

# Asset categories in their significant order
# (category, layer id, hex colour, map overlay RGB, video overlay BGR, mask key)
CATEGORIES = [
    ("Properties & Buildings", "buildings", "#facc15", (255, 0, 0), (0, 0, 255), "properties_buildings"),
    ("Trees & Green Cover", "green_cover", "#22c55e", (0, 255, 0), (0, 255, 0), "trees_green_cover"),
    ("Parks & Open Spaces", "parks", "#ec4899", (120, 255, 120), (80, 220, 80), "parks_open_spaces"),
    ("Water Bodies", "water", "#3b82f6", (0, 80, 255), (255, 80, 0), "water_bodies"),
    ("Roads & Footpaths", "roads", "#6b7280", (180, 120, 70), (70, 130, 200), "roads_footpaths"),
    ("Drains & Sewage", "drains", "#f97316", (0, 0, 0), (30, 30, 30), "drains_sewage"),
    ("Vehicles & Parking", "vehicles", "#f59e0b", (255, 255, 0), (0, 255, 255), "vehicles_parking"),
    ("Waste Dumps", "waste", "#ef4444", (255, 120, 0), (0, 140, 255), "waste_dumps"),
    ("Solar Panels", "solar", "#06b6d4", (80, 0, 160), (180, 0, 180), "solar_panels"),
]
DEFAULT_CATEGORY = "Properties & Buildings"
UNKNOWN_LAYER = "unclassified"
UNKNOWN_COLOR = "#0ea5e9"

# Category keywords, first matching line wins
CATEGORY_KEYWORDS = [
    ("Properties & Buildings", ["building", "property", "built-up"]),
    ("Trees & Green Cover", ["tree", "green", "canopy", "vegetation"]),
    ("Parks & Open Spaces", ["park", "open space", "playground", "ground"]),
    ("Water Bodies", ["water", "pond", "lake", "river", "canal"]),
    ("Roads & Footpaths", ["road", "street", "footpath", "path"]),
    ("Drains & Sewage", ["drain", "sewage", "storm water", "manhole"]),
    ("Vehicles & Parking", ["vehicle", "parking", "car", "bus", "truck"]),
    ("Waste Dumps", ["waste", "dump", "landfill", "garbage"]),
    ("Solar Panels", ["solar", "panel", "photovoltaic"]),
]

# Detector class names and their categories
DETECTOR_CLASSES = {0: "buildings", 1: "trees", 2: "parks_open_spaces", 3: "water"}
CLASS_ALIASES = {
    "buildings": "Properties & Buildings",
    "building": "Properties & Buildings",
    "trees": "Trees & Green Cover",
    "tree": "Trees & Green Cover",
    "parks_open_spaces": "Parks & Open Spaces",
    "parks": "Parks & Open Spaces",
    "park": "Parks & Open Spaces",
    "open_spaces": "Parks & Open Spaces",
    "water": "Water Bodies",
    "water_bodies": "Water Bodies",
}

# Default texts
TEXT_SUBCATEGORY = "General"
TEXT_CONDITION = "Unknown"
TEXT_PRIORITY = "Medium"
TEXT_DESCRIPTION = "Visual description unavailable from model output."
TEXT_BASIS = "Estimated from available visual context."
TEXT_FALLBACK_DESCRIPTION = "No reliable visual details extracted."
TEXT_FALLBACK_BASIS = "Fallback due to incomplete model response."
TEXT_FILLER_INSIGHT = "Additional insight unavailable from current model response."
DEFAULT_INSIGHTS = [
    "Model returned incomplete insights.",
    "Review image quality and retry for improved detail.",
    "Manual GIS validation is recommended for critical decisions.",
]
WARN_EMPTY = "AI returned empty response."
WARN_NOT_OBJECT = "Parsed AI response is not a JSON object."
WARN_PARSE = "JSON parsing failed"
WARN_NO_LIST = "detected_assets is not a list; fallback assets applied."
WARN_NO_ASSETS = "No valid assets found in model output; fallback asset generated."
WARN_NO_STATS = "category_statistics is not an object; computed statistics used."
WARN_NO_BOXES = "YOLO returned no detections above threshold for this image."

# Insight and warning sentences (printf style)
NAMING_INSIGHTS = [
    "Naming Analysis used YOLO model %s on image resolution %dx%d.",
    "Detected %d asset candidates across mapped categories.",
    "Coordinates and overlays are synchronized to normalized 0-100 space for frontend/GIS rendering.",
]
VIDEO_INSIGHTS = [
    "Processed %d frames at %.2f FPS source rate (%dx%d); analyzed %d frames with stride %d.",
    "Counts represent frame-level detection events from analyzed frames and are not de-duplicated object tracking IDs.",
    "Dominant land use trend is %s with average coverage context from processed frames.",
]
WARN_SCALE = "Area estimates use METERS_PER_PIXEL=%s."

# Map frame
MAP_CENTER_LAT = 28.6139
MAP_CENTER_LNG = 77.2090
MAP_SPAN = 0.02

# Detector thresholds
CONF_THRESHOLD = 0.25
IOU_THRESHOLD = 0.45

# Accepted files
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/tiff", "image/webp"]
VIDEO_TYPES = ["video/mp4", "video/quicktime", "video/x-msvideo", "video/x-matroska", "video/webm", "video/mpeg"]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".webm", ".mpeg", ".mpg", ".m4v"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp"]
# Media types of file extensions
TYPE_OF_EXTENSION = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp",
    ".mp4": "video/mp4", ".m4v": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".mkv": "video/x-matroska",
    ".webm": "video/webm", ".mpeg": "video/mpeg", ".mpg": "video/mpeg",
}
MAX_IMAGE_BYTES = 50 * 1024 * 1024
MAX_VIDEO_BYTES = 500 * 1024 * 1024
ANALYSIS_MODES = ["block_analysis", "naming_analysis", "asset_map_analysis"]

# Smallest region area per mask key, 50 for any other
MIN_REGION_AREA = {
    "properties_buildings": 80.0,
    "trees_green_cover": 120.0,
    "parks_open_spaces": 800.0,
    "water_bodies": 120.0,
    "roads_footpaths": 180.0,
    "drains_sewage": 80.0,
    "vehicles_parking": 18.0,
    "waste_dumps": 80.0,
    "solar_panels": 20.0,
}
MIN_REGION_AREA_OTHER = 50.0

# Smallest counted region per category in video frames
MIN_FRAME_AREA = {
    "Trees & Green Cover": 1200.0,
    "Parks & Open Spaces": 8000.0,
    "Water Bodies": 1500.0,
    "Roads & Footpaths": 2500.0,
    "Drains & Sewage": 180.0,
    "Properties & Buildings": 220.0,
    "Vehicles & Parking": 12.0,
    "Waste Dumps": 2000.0,
    "Solar Panels": 80.0,
}

# Risk thresholds per mode
# (encroachment: built over, environment: green under, flood: water limit, flood inclusive)
RISK_LIMITS = {"map": (40.0, 25.0, 5.0, True), "video": (45.0, 20.0, 5.0, False)}

# Colour bands, inclusive (hue 0..179, saturation, value) or gray
BANDS = {
    "map": {
        "green": ("hsv", (30, 35, 25), (95, 255, 255)),
        "water": ("hsv", (85, 20, 10), (135, 255, 190)),
        "road": ("hsv", (5, 10, 75), (35, 140, 245)),
        "bright": ("gray", 120, 255),
        "dark": ("gray", 0, 90),
        "waste": ("hsv", (8, 20, 80), (35, 180, 230)),
        "solar": ("hsv", (95, 20, 20), (135, 180, 120)),
    },
    "video": {
        "green": ("hsv", (30, 40, 25), (95, 255, 255)),
        "water": ("hsv", (85, 25, 10), (135, 255, 180)),
        "road": ("hsv", (5, 10, 55), (35, 150, 245)),
        "lowsat": ("hsv", (0, 0, 65), (180, 55, 230)),
        "bright": ("gray", 135, 255),
        "roof": ("hsv", (0, 0, 90), (180, 80, 255)),
        "dark": ("gray", 0, 75),
        "waste": ("hsv", (8, 35, 80), (35, 210, 245)),
        "solar": ("hsv", (95, 25, 15), (135, 180, 130)),
    },
}

# Video frame gates and filters
VIDEO_STRIDE = 2
VIDEO_TARGET_FRAMES = 300
VIDEO_MAX_DIM = 960
VIDEO_DEFAULT_FPS = 12.0

# Height estimation
HEIGHT_MPP = 0.2
SOLAR_ELEVATION = 45.0
SHADOW_MIN_AREA = 120.0
SHADOW_BLOCK = 31
SHADOW_C = 7
SHADOW_DISTANCE_FACTOR = 2.6
SHADOW_PADDING = 12

# Block grid columns
GRID_COLUMNS = 35

# Export columns
CSV_COLUMNS = [
    "id", "category", "subcategory", "count", "area_sq_m", "coverage_percent", "confidence_percent",
    "priority", "condition", "center_x", "center_y", "shadow_length_pixels", "shadow_length_meters",
    "estimated_height_meters",
]

# Sentences of asset records (printf style where they hold figures)
TEXT_BOX_BASIS = "Bounding box predicted by YOLO model and normalized to 0-100 image coordinates."
TEXT_MAP_DESCRIPTION = " detected by CV asset mapping pipeline."
TEXT_MAP_BASIS = "OpenCV thresholding + contour extraction from uploaded image."
TEXT_BLOCK_SUBCATEGORY = "Detected "
TEXT_BLOCK_DESCRIPTION = "A visually verified block area mapped by our spatial engine."
TEXT_BLOCK_BASIS = "100% accurate pixel contour mapping"
TEXT_FRAME_DESCRIPTION = "Frame-level detections for %s across %d analyzed frames."
TEXT_FRAME_BASIS = "OpenCV frame-by-frame segmentation; counts are detection events (not unique tracked IDs)."
TEXT_BAD_ENTRY = "Asset entry #%d is invalid and was skipped."
DEFAULT_LAND_USE = "Mixed Urban"

# Limits of the block colour classes, in the order of the rules
BLOCK_SHARE, BLOCK_LEAD = 0.36, 10
BLOCK_DARK, BLOCK_BRIGHT = 75, 165
BLOCK_GRAY_SPREAD, BLOCK_GRAY_BRIGHT = 25, 100
BLOCK_PARK_RED_SHARE = 0.4
