"""Lists, thresholds and coordinates that decide the results."""

# Natures of call that count as critical for response times.
CRITICAL_NATURES = [
    "A BOX ALARM", "A FIRE ALARM", "AUTO ACC INJURY", "AUTO ACCIDENT", "B BOX ALARM",
    "B FIRE ALARM", "BICYCLE ACC", "BLDG COLLAPSE", "BOMB REMOVAL", "C BOX ALARM",
    "C FIRE ALARM", "CAR FIRE", "CARB MON DETECT", "CARB MON INCID", "CONFINED SPACE",
    "DUMPSTER FIRE", "E BOX ALARM", "E FIRE ALARM", "ELEVATOR ACCID", "ELEVATOR MEDIC",
    "ELEVATOR RESCUE", "FIRE", "FIRE EXTINGUISH", "GAS LEAK", "GAS LEAK INSIDE",
    "GAS LEAK OUTSID", "HAZMAT INC A", "HAZMAT INC L", "HAZMAT INC R", "HAZMAT INCIDENT",
    "HOSTAGE ACTIVE", "ICE RESCUE", "INDUSTRIAL ACC", "JUMPER", "L BOX ALARM",
    "L FIRE ALARM", "LIFE LINE E", "LOCK IN", "MANHOLE FIRE", "MEDICAL AID",
    "MEDICAL AID E", "MEDICAL AID L", "MEDICAL AID R", "OUTSIDE FIRE", "PEDESTRIAN ACC",
    "R BOX ALARM", "R FIRE ALARM", "S BOX ALARM", "S FIRE ALARM", "SHOOTING ACTIVE",
    "STRIK BOX ALARM", "STRIK FIRE ALAR", "STRIKE BOX ALAR", "STRK FIRE ALARM",
    "TECH RESCUE", "TRAIN INCIDENT", "WATER RESCUE",
]

# Nature of call that is no run at all.
TRAINING_NATURE = "TRAINING"

# Engine companies.
ENGINES = ["E3", "E1", "E2", "E6", "E7"]

# Addresses the geocoder is known to place wrongly.
BAD_ADDRESSES = [
    "HYDRANT TESTING, Somerville, Massachusetts",
    "HYDRANT SHOVELING, Somerville, Massachusetts",
    "1 MUTUAL AID - CAMBRIDGE, Somerville, Massachusetts",
    "ROUTE 93 NORTH, Somerville, Massachusetts",
    "ROUTE 93 SOUTH, Somerville, Massachusetts",
    "1 MUTUAL AID - EVERETT, Somerville, Massachusetts",
    "1 , Somerville, Massachusetts",
    "1 BIKE PATH, Somerville, Massachusetts",
]

# A latitude below this one is outside the town.
MIN_GOOD_LAT = 42.37

# Longitudes a geocoder falls back to when it finds nothing.
FALLBACK_LONGITUDES = [
    -71.0994968, -82.5346435, -82.1660239, -92.057063, -119.6289038, -80.8905922,
]

# Address whose street number is missing although it needs one.
AMBIGUOUS_ADDRESSES = ["BROADWAY, Somerville, MA"]

# Text put after an address, and its clean-up rules in order.
ADDRESS_SUFFIX = {"v1": ", Somerville, Massachusetts", "v2": ", Somerville, MA"}
ADDRESS_REPLACEMENTS = {
    "v1": [
        ("AV,", "AVE,"), ("AV &", "AVE &"), (" A ", " "), (" B ", " "), (" R ", " "),
        (" & ,", ","), (" OPPOSITE ", " "), (" & ", " and "),
    ],
    "v2": [
        ("AV,", "AVE,"), ("AV &", "AVE &"), (" A ", " "), (" B ", " "),
        (" & ,", ","), (" OPPOSITE ", " "),
    ],
}

# Stations and where they stand.
STATIONS = {
    "Lowell": "651 Somerville Ave, Somerville, MA",
    "HQ": "266 Broadway, Somerville, MA",
    "FiveFifteen": "515 Somerville Ave, Somerville, MA",
    "JoyWashington": "146 Washington St, Somerville, MA",
    "Highland": "265 Highland Ave, Somerville, MA",
    "Teele": "238 Holland St Somerville, MA",
    "Union": "243 Somerville Ave, Somerville, MA",
}

# Stations open in each siting scenario.
SCENARIOS = {
    "JW_and_Lowell": ["JoyWashington", "Lowell", "HQ", "Highland", "Teele"],
    "JW_and_FiveFifteen": ["JoyWashington", "FiveFifteen", "HQ", "Highland", "Teele"],
    "Union_and_Lowell": ["Union", "Lowell", "HQ", "Highland", "Teele"],
    "FiveFifteen_alone": ["FiveFifteen", "HQ", "Highland", "Teele"],
}
CURRENT_SCENARIO = "Union_and_Lowell"

# Pairs of stations whose times are compared (first minus second).
STATION_PAIRS = {
    "HQ_v_Lowell": ("HQ", "Lowell"),
    "FiveFifteen_v_Lowell": ("FiveFifteen", "Lowell"),
    "JW_v_FiveFifteen": ("JoyWashington", "FiveFifteen"),
    "JW_v_Lowell": ("JoyWashington", "Lowell"),
}

# Calibration rules.
TIME_EPSILON = 0.001
SCALE_EPSILON = 0.0001
LONG_TRIP_MINUTES = 4.5
LONG_TRIP_FACTOR = 0.82
TRIM_DIFF = (-3.0, 3.5)
TRIM_RATIO = (0.5, 2.0)

# Spatial grid and density surface.
CELL_DEGREES = 0.002
DENSITY_BANDS = 16
