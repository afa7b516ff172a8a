"""Values that decide results: phrases, labels, patterns and keyword lists.

FIXED VALUES.  Everything in this file must stay as it is for the structured
table to come out right; order is significant wherever a list is ordered.
"""

# Characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

QUESTIONS = (1, 2, 3, 4, 5, 6, 7)

# --- question 1 -------------------------------------------------------------
VERDICT_RULES = [
    (["Yes,", "Yes."], "Yes"),
    (["No,", "No."], "No"),
]
VERDICT_DEFAULT = "Other"

# --- question 2, automated vehicle ------------------------------------------
# Phrases that introduce the automated vehicle, and the heading that replaces them.
AV_LEAD_INS = [
    "Autonomous Vehicle:",
    "Vehicle 1 (Autonomous Vehicle):",
    "Vehicle 1 (Automated Vehicle):",
    "The automated vehicle was a",
    "The autonomous vehicle was a",
    "One vehicle was involved: a",
    "Vehicle 1:",
]
AV_HEADING = "Automated Vehicle:"
AV_BOLD_HEADING = "**Automated Vehicle:**"
AV_PATTERN_REWRITES = [(r"Apple Inc.", "Apple")]
# (text, replacement), applied in this order.
AV_TEXT_REWRITES = [
    ("(Not Specified)", "Unknown"),
    (" (indicated by a blank space)", ""),
    ("Year:", "Year"),
    ("Brand:", "Brand"),
    ("Model:", "Model"),
    ("Unknown (likely a Tesla)", "Tesla"),
    ("Unknown (likely Tesla based on the form)", "Tesla"),
    ("Unknown (likely Toyota based on the form)", "Toyota"),
    ('Unknown (indicated by "AV")', "Unknown"),
]
# (phrases, brand, model, year)
AV_KNOWN_PHRASES = [
    (
        ["Google AV", "Google Auto LLC", "Google Automated Vehicle", "Google LLC",
         "Google Lexus RX450 (automated vehicle)"],
        "Google", None, None,
    ),
    (
        ["Cruise AV", "Cruise Vehicle", "Cruise Automated Vehicle", "Cruise LLC"],
        "Cruise", None, None,
    ),
    (["Zoom AV"], "Zoom", None, None),
    (["Waymo"], "Waymo", None, None),
    (["2017 Volvo XC 90 (autonomous vehicle)"], "Volvo", "XC 90", "2017"),
    (["2016 Model C-4 Grand Touring 4D UTV"], "Citroen", "C-4", "2016"),
    (["2019 Tesla Model X (Autonomous Vehicle)"], "Tesla", "Model X", "2019"),
    (["Year 2019, Brand Unknown (likely a Tesla)"], "Tesla", None, "2019"),
    (["2016 Nissan (make unknown)"], "Nissan", None, "2016"),
]
AV_YEAR_BRAND_MODEL = (
    r"Automated Vehicle: Year (Unknown|\d{4}), Brand ([A-Za-z-]+), Model ([A-Za-z0-9\s]+)"
)
AV_BARE_YEAR_BRAND_MODEL = (
    r"Automated Vehicle: (Unknown|\d{4}), Brand ([A-Za-z-]+), Model ([A-Za-z0-9\s]+)"
)
AV_YEAR_BRAND = r"Automated Vehicle: Year (Unknown|\d{4}), Brand ([A-Za-z\s]+)\."
AV_FREE_TEXT = r"Automated Vehicle:\s*(\d{4})?\s*([^.,*()]+)"
# (parts of the lower-cased brand, brand)
BRAND_NAMES = [
    (["waymo", "wayne"], "Waymo"),
    (["google"], "Google"),
    (["tesla"], "Tesla"),
    (["cruise"], "Cruise"),
    (["apple"], "Apple"),
    (["ford"], "Ford"),
    (["toyota", "lexus"], "Toyota"),
    (["chrysler"], "Chrysler"),
    (["nissan"], "Nissan"),
    (["volvo"], "Volvo"),
    (["hyundai"], "Hyundai"),
    (["kia"], "Kia"),
    (["bmw"], "BMW"),
    (["chevrolet"], "Chevrolet"),
    (["land rover", "range rover"], "Land Rover"),
    (["lincoln"], "Lincoln"),
    (["honda"], "Honda"),
    (["subaru"], "Subaru"),
    (["nio"], "Nio"),
    (["mosaic"], "Mosaic"),
    (["mercedes-benz", "daimler", "mercedes"], "Mercedes-Benz"),
]
# Case-sensitive parts that show something else than a brand was captured.
NOT_A_BRAND = ["Year", "Zero-Emission Vehicle"]
TESLA_MODEL_IN_BRAND = ("model 3", "Model 3")
MODEL_UNKNOWN_PART = "not specified"
MODEL_NAMES = [("av", "Unknown"), ("3", "Model 3"), ("x", "Model X"), ("s", "Model S")]
UNKNOWN = "Unknown"

# --- question 2, other road user --------------------------------------------
ROAD_USER_LEAD_INS = [
    "Other Involved Road User:",
    "The other involved party was a",
    "The other involved road user was the",
    "other party was a",
    "road user was a",
    "Other Involved Party:",
]
ROAD_USER_HEADING = "Other Road User:"
ROAD_USER_BOLD_HEADING = "**Other Road User:**"
ROAD_USER_PATTERN = r"Other Road User: \s*([^\n]*)"
ROAD_USER_PHRASES = [
    (["a pedestrian was also involved", "Pedestrian:"], "Pedestrian"),
    (["2013 Honda Civic"], "Driver in vehicle"),
]
ROAD_USER_KINDS = [
    (["pedestrian", "walking", "male", "female"], "Pedestrian"),
    (["bicyclist", "bicycle", "cyclist"], "Cyclist"),
    (["scooter", "moped"], "Scooter"),
    (["motorcycle", "motorbike"], "Motorcycle"),
    (["fixed object", "parked car", "parked vehicle", "stationary"], "Fixed object"),
    (["driver"], "Driver in vehicle"),
]
ROAD_USER_VEHICLE_HEADINGS = ["Other Vehicle:", "Vehicle 2:", "Other Car:"]
ROAD_USER_IN_VEHICLE = "Driver in vehicle"

# --- question 2, other vehicle ----------------------------------------------
OTHER_VEHICLE_LEAD_INS = ["Vehicle 2:", "Hyundai:", "Other Car:"]
OTHER_VEHICLE_HEADING = "Other Vehicle:"
OTHER_VEHICLE_TEXT_REWRITES = [
    ("**Other Vehicle:**", "Other Vehicle:"),
    ("Make:", "Brand"),
    ("Model:", "Model"),
    ("Year:", "Year"),
    ("Brand:", "Brand"),
    ("Model:", "Model"),
    ("A 2023:", "2023"),
]
OTHER_VEHICLE_NONE_PHRASES = [
    "No other vehicles were involved",
    "No other vehicle was involved",
    'A truck is listed as "other vehicle"',
]
OTHER_VEHICLE_TRUCK_PHRASE = 'Unknown year, brand and model (only "Truck" is listed)'
OTHER_VEHICLE_TRUCK = "Truck"
OTHER_VEHICLE_YEAR_BRAND_MODEL = (
    r"Other Vehicle: Year (UNK|Unknown|\d{4}), Brand ([A-Za-z-]+), Model ([A-Za-z0-9\s]+)"
)
OTHER_VEHICLE_FREE_TEXT = r"Other Vehicle:\s*(\d{4})?\s*([^.,*()]+)"
OTHER_VEHICLE_MEANS_UNKNOWN = [
    "A pickup truck",
    "The report indicates a second vehicle",
    "Not specified",
    "Year and model are unknown",
]
OTHER_VEHICLE_MEANS_NULL = [
    "Not applicable",
    "A bicycle",
    "A bicyclist",
    "A truck is listed as",
    "A pedestrian",
    "",
    "None",
    "None listed",
    "N/A - only one vehicle was involved",
]
# (marker where the text is cut, what replaces the tail)
OTHER_VEHICLE_CUTS = [
    ("The autonomous vehicle", ""),
    ("The automated vehicle", ""),
    ("A Toyota", "Toyota"),
    ("A Nissan", "Nissan"),
    ("pickup truck", ""),
    ("truck", ""),
]

# --- questions without a rule -----------------------------------------------
NO_RULE = "wrong question"

# --- question 4 -------------------------------------------------------------
ENVIRONMENT_LABELS = [
    ("weather", "Weather"),
    ("lighting_conditions", "Lighting Conditions"),
    ("road_surface", "Road Surface"),
    ("road_conditions", "Road Conditions"),
]

# --- question 5 -------------------------------------------------------------
COLLISION_LABEL = "Type of Collision"
DAMAGE_LABEL = "Vehicle Damage"
INJURIES_LABEL = "Injuries/Deaths/Property Damage"
DAMAGE_CATEGORIES = {
    "minor": ["minor", "slight", "minimal", "cosmetic"],
    "moderate": ["moderate", "considerable", "visible", "damaged", "dent"],
    "severe": ["severe", "major", "extensive", "significant", "heavy"],
    "total": ["total", "destroyed", "totaled"],
}
DAMAGE_DEFAULT = "unknown"
AV_DAMAGE_PATTERN = r"(Tesla|AV|automated vehicle|autonomous vehicle)[^.]*(damage[^.]*)"
OTHER_DAMAGE_PATTERN = r"([^T]oyota|Honda|Ford|Chrysler|other vehicle)[^.]*(damage[^.]*)"
INJURY_PATTERN = r"injur(y|ies|ed)"
NO_INJURY_PATTERN = r"no injur(y|ies|ed)"
NO_INJURIES_TEXT = "no injuries"

# --- question 6 -------------------------------------------------------------
AV_FAULT_PATTERN = r"(autonomous|automated|AV).*?\bat fault\b"
OTHER_FAULT_PATTERN = r"(pedestrian|other road user|driver).*?\bat fault\b"
FAULT_TEXT = "at fault"
FACTORS_QUOTED_PATTERN = r'Contributing Factors:.*?"([^"]+)"'
FACTORS_PLAIN_PATTERN = r"Contributing Factors:([^*]+)"
FACTORS_SEPARATORS = r",|\band\b|;"

# --- question 7 -------------------------------------------------------------
TRAFFIC_LABEL = "Traffic"
AV_MOVEMENT_PATTERN = (
    r"(autonomous|automated|AV).*?((?:traveling|moving|driving|stopped)[^.]*)"
)
OTHER_MOVEMENT_PATTERN = (
    r"(pedestrian|other road user|driver).*?"
    r"((?:walking|running|crossing|stopped|traveling|moving)[^.]*)"
)
DIRECTION_PATTERN = r"(same|different) direction"
LANE_PATTERN = r"(same|different) lanes?"
