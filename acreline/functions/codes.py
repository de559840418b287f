"""Code lists, labels and patterns used by the classification expressions.

Everything in this module is data. The operators take these tables as default
arguments, so another assessor's codes can be passed instead.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The results depend on these exact codes, labels and patterns.
# ---------------------------------------------------------------------------

LEVY_CODES = ("0010", "0011", "0013", "0014", "0016", "0025", "0030", "0032")
TAX_STATUSES = ("T", "O")
EXEMPT_REASONS = ("EX", "FS", "CU", "HP", "NP", "OP")
NON_MODELLED_TYPES = ("M", "N", "U", "X", "T")

QUALITY_LABELS = {
    1: "Very Low", 2: "Low", 3: "Fair", 4: "Average", 5: "Good",
    6: "Very Good", 7: "Excellent", 8: "Luxury", 9: "Landmark",
}
CONSTRUCTION_LABELS = {
    0: "Unknown", 1: "Steel", 2: "Reinforced Concrete", 3: "Masonry",
    4: "Wood/Frame", 5: "Pre-Fabricated",
}
FEATURE_LABELS = {
    751: "Parking Garage", 760: "Surface Parking",
    761: "Canopy/Carport", 763: "Other Feature",
}
COMPLEX_LABELS = {
    1: "Standard Condo", 2: "Co-op", 3: "Timeshare", 4: "MFTE",
    5: "Other", 6: "Leasehold", 10: "Condo Hotel",
}
CONDO_SEGMENTS = {
    1: "Standard Condo", 4: "MFTE Condo", 2: "Co-op",
    6: "Leasehold", 10: "Condo Hotel",
}
LAUNDRY_LABELS = {0: "None", 1: "Hookup", 2: "Common"}
HIGHEST_BEST_USE_LABELS = {
    1: "SINGLE FAMILY", 2: "DUPLEX", 3: "TRIPLEX", 4: "MOBILE HOME",
    5: "OTHER SF DWELLING", 6: "MULTI-FAMILY DWELLING", 7: "GROUP RESIDENCE",
    8: "TEMPORARY LODGING", 9: "PARK/RECREATION", 10: "AMUSEMENT/ENTERTAINMENT",
    11: "CULTURAL", 12: "EDUCATIONAL SERVICE", 13: "COMMERCIAL SERVICE",
    14: "RETAIL/WHOLESALE", 15: "MANUFACTURING", 16: "AGRICULTURAL",
    17: "FORESTRY", 18: "FISH & WILDLIFE MGMT", 19: "MINERAL",
    20: "REGIONAL LAND USE", 21: "MIXED USE",
}
PREDOMINANT_USE_LABELS = {
    300: "Office Building", 304: "Medical/Dental Office", 309: "Office Park",
    311: "Recreation/Club", 326: "Gas Station", 341: "Fast Food",
    344: "Restaurant/Lounge", 348: "Car Wash", 349: "Auto Dealer",
    350: "Shopping Center/Mall", 352: "Retail Store",
    353: "Supermarket/Grocery", 365: "Mini-Storage/Warehouse",
    386: "Hotel/Motel", 406: "Warehouse", 407: "Manufacturing/Industrial",
    419: "Nursing Home", 426: "Hospital", 453: "Church/Religious",
    459: "School/University", 470: "Apartments (5+ units)",
    472: "Senior Housing", 494: "Community Center",
    528: "Garage/Service Repair", 531: "Car Lot/Dealer", 551: "Parking Garage",
    706: "Mixed Use Commercial", 820: "Park/Open Space", 830: "Golf Course",
    840: "Cemetery", 860: "Utility/Infrastructure",
}

# Half-open [low, high) ranges; None is an open end. The first hit wins, so the
# 460-480 class can never be reached: that order is part of the rule.
USE_BUCKETS = (
    (300, 340, "office"), (340, 400, "retail"), (400, 500, "industrial"),
    (500, 700, "institutional"), (700, 800, "parking"), (800, None, "other"),
)
USE_CLASSES = (
    (300, 340, "Office"), (340, 400, "Retail"), (400, 500, "Industrial"),
    (460, 480, "Multifamily"), (500, 700, "Institutional"),
    (700, 710, "Mixed Use"), (800, None, "Land/Special"),
)
BUILDING_SIZE_TIERS = (
    (None, 5000, "Small (<5k sqft)"), (5000, 20000, "Medium (5-20k sqft)"),
    (20000, 100000, "Large (20-100k sqft)"),
    (100000, None, "Very Large (100k+ sqft)"),
)
COMPLEX_SIZE_TIERS = (
    (None, 600, "Micro (<600 sqft)"), (600, 900, "Small (600-900)"),
    (900, 1400, "Medium (900-1400)"), (1400, 2000, "Large (1400-2000)"),
    (2000, None, "Extra Large (2000+)"),
)
UNIT_SIZE_TIERS = (
    (None, 500, "Studio (<500)"), (500, 800, "1BR (500-800)"),
    (800, 1200, "2BR (800-1200)"), (1200, 1800, "3BR (1200-1800)"),
    (1800, None, "Large (1800+)"),
)

# Baseline distances that stay with the panel.
DISTANCE_COLUMNS = ("dist_to_public_km", "dist_to_private_km", "dist_to_lightrail_km")

# Change-log attribute -> snapshot column. `area` is baseline only.
CHANGE_ATTRIBUTES = {
    "area": "area", "currentzoning": "current_zoning_3",
    "hbuasifvacantdesc": "hbu_as_if_vacant_desc",
    "unbuildable": "unbuildable", "sqftlot": "sq_ft_lot",
    "nuisancescore": "nuisance_score", "mtrainier": "mt_rainier",
    "olympics": "olympics", "cascades": "cascades",
    "territorial": "territorial", "seattleskyline": "seattle_skyline",
    "pugetsound": "puget_sound", "lakewashington": "lake_washington",
    "seismichazard": "seismic_hazard",
    "landslidehazard": "landslide_hazard",
    "steepslopehazard": "steep_slope_hazard",
    "trafficnoise": "traffic_noise", "airportnoise": "airport_noise",
    "powerlines": "power_lines", "othernuisances": "other_nuisances",
    "contamination": "contamination", "historicsite": "historic_site",
    "log_appr_land_val_lag1": "log_appr_land_val_lag1",
}

# Subgroups in priority order: specialty names and present-use codes.
SUBGROUP_SPECIALTIES = {
    "apt": ("Apartment", "Nursinghome"),
    "office": ("MajorOffice",),
    "industrial": ("Industrial", "Warehouse"),
    "retail": ("MajorRetail",),
    "hospitality": ("Hotel", "Restaurants"),
    "medical": ("Biotech",),
}
SUBGROUP_USES = {
    "apt": (10, 11, 16, 17, 18, 49, 56, 57, 59),
    "office": (106, 118, 126, 273),
    "industrial": (138, 195, 202, 210, 216, 223, 245, 246, 252, 168, 186, 261,
                   262, 263, 264, 271, 276, 344, 345, 346),
    "retail": (60, 61, 62, 63, 64, 96, 101, 104, 105, 161, 162, 163, 167, 191,
               194, 274),
    "hospitality": (51, 58, 171, 183, 188, 275, 278, 340, 341),
    "medical": (55, 122, 173),
}
VACANT_USES = (299, 300, 301, 309, 316, 323, 324, 325, 326, 327, 328, 330, 331,
               332, 333, 334, 335, 336, 337, 339)
PARKING_USES = (159, 180, 182, 277)

# Building-section use codes: named sets first, then half-open ranges.
SECTION_USE_SETS = (
    ((344, 345, 346, 347), "office"),
    ((341, 342, 343, 313, 320), "medical"),
    ((349, 350, 351), "hospitality"),
    ((300, 352, 354, 355, 356, 357), "apt"),
    ((353, 318, 319, 304, 303, 531, 532), "retail"),
    ((386, 406, 407, 408, 409, 410, 528), "industrial"),
)
SECTION_USE_RANGES = (
    (330, 348, "office"), (348, 353, "hospitality"),
    (353, 400, "retail"), (400, 500, "industrial"),
)
ZONING_PREFIXES = (
    ("^(IG|IB|IC|IH)", "industrial"),
    ("^(DOC|DMC|DH|DMR)", "office"),
    ("^(NC|C1|C2|SM|MIO)", "retail"),
    ("^(LR|MR|HR|RSL|MPC)", "apt"),
)
TEXT_SOURCES = ("SectionDescr", "BldgDescr", "ComplexDescr", "PermitProject",
                "PropertyName")

# Keyword patterns in precedence order.
KEYWORDS = (
    ("medical",
     r"\b(MEDICAL|DENTAL|CLINIC|HOSPITAL|SURGERY|SURGICAL|HEALTH ?CENTER|"
     r"BIOTECH|BIOMEDICAL|LABORATOR(Y|IES)|LIFE ?SCIENCE|DIAGNOSTIC|"
     r"URGENT ?CARE|PHARMAC(Y|EUTICAL)|NURSING|HOSPICE|REHAB)S?\b"),
    ("hospitality",
     r"\b(HOTEL|MOTEL|INN|LODGE|RESORT|HOSTEL|BED ?(AND|&) ?BREAKFAST|"
     r"RESTAURANT|CAFE|CAFETERIA|COFFEE|BISTRO|DINER|EATER(Y|IES)|"
     r"TAVERN|BAR ?(AND|&) ?GRILL|GRILL|BREWERY|BREWPUB|PUB|LOUNGE|"
     r"BANQUET|CATERING|FOOD ?(COURT|HALL|SERVICE)|PIZZ(A|ERIA)|"
     r"SUITES|HOSPITALITY)S?\b"),
    ("apt",
     r"\b(APARTMENT|APTS?|MULTI-?FAMILY|MULTIFAMILY|RESIDEN(CE|TIAL|CES)|"
     r"DORM(ITORY)?|SENIOR ?(LIVING|HOUSING)|ASSISTED ?LIVING|"
     r"CONGREGATE|STUDIOS?|LOFTS?|FLATS?|TOWNHO(ME|USE)S?|"
     r"WORKFORCE ?HOUSING|AFFORDABLE ?HOUSING)S?\b"),
    ("industrial",
     r"\b(WAREHOUSE|DISTRIBUTION|FULFIL?LMENT|LOGISTICS|MANUFACTURING|"
     r"FACTORY|PLANT|INDUSTRIAL|FLEX|SHOP ?BUILDING|MACHINE ?SHOP|"
     r"COLD ?STORAGE|SELF ?STORAGE|MINI ?STORAGE|STORAGE ?(FACILITY|"
     r"BUILDING)|TERMINAL|FREIGHT|SHIPYARD|DRY ?DOCK|FOUNDRY|"
     r"MAINTENANCE ?(FACILITY|BUILDING)|YARD|DATA ?CENTER)S?\b"),
    ("retail",
     r"\b(RETAIL|STORE|SHOP(S|PING)?|SHOPPING ?(CENTER|CENTRE|CTR|MALL)|"
     r"MALL|MARKET|MARKETPLACE|GROCER(Y|S)|SUPERMARKET|PHARMACY|"
     r"SHOWROOM|DEALERSHIP|AUTO ?(SALES|CENTER)|SERVICE ?STATION|"
     r"GAS ?STATION|CAR ?WASH|BANK|CREDIT ?UNION|SALON|"
     r"BOUTIQUE|OUTLET|PLAZA|STOREFRONT)S?\b"),
    ("office",
     r"\b(OFFICE|OFC|TOWER|CORPORATE ?(CENTER|CENTRE|CAMPUS|HQ)|"
     r"HEADQUARTERS|BUSINESS ?(CENTER|CENTRE|PARK)|PROFESSIONAL ?(BLDG|"
     r"BUILDING|CENTER)|EXECUTIVE ?(SUITES?|CENTER)|"
     r"COWORKING|CO-?WORK)S?\b"),
)
KEYWORD_NOISE = (
    r"\b(LLC|L\.?L\.?C|INC|INCORPORATED|CORP(ORATION)?|CO|COMPANY|"
    r"LP|LLP|LTD|TRUST|PARTNERS(HIP)?|ASSOCIATES?|ASSOC|PROPERT(Y|IES)|"
    r"HOLDINGS?|INVESTMENTS?|VENTURES?|GROUP|ENTERPRISES?|REALTY|"
    r"REAL ?ESTATE|MANAGEMENT|MGMT|DEVELOPMENT|DEVELOPERS?|"
    r"BUILDING|BLDG|PARCEL|LOT|UNIT|PHASE|PORTFOLIO)\b"
)
LLC_PATTERNS = (
    r"\bLLC\b", r"\bL\.?L\.?C\.?\b", r"\bLIMITED\s+LIABILITY\s+CO",
)
ENTITY_PATTERNS = (
    r"\bINC\.?\b", r"\bCORP\.?\b", r"\bLLP\b", r"\b(LIVING\s+)?TRUST\b",
    r"\bLP\b", r"\bLTD\b",
)
STREET_ABBREVIATIONS = {
    "AVENUE": "AVE", "AV": "AVE", "STREET": "ST", "BOULEVARD": "BLVD",
    "DRIVE": "DR", "ROAD": "RD", "PLACE": "PL", "COURT": "CT", "LANE": "LN",
    "HIGHWAY": "HWY", "PARKWAY": "PKWY", "TERRACE": "TER", "CIRCLE": "CIR",
    "SQUARE": "SQ", "TRAIL": "TRL", "WY": "WAY", "NORTH": "N", "SOUTH": "S",
    "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW",
    "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
UNIT_SUFFIX = r"\s+(STE|SUITE|UNIT|APT|BLDG|FL|FLOOR|RM|ROOM|#).*$"

NEW_PERMIT = r"\b(NEW|NEW CONST|CONSTRUCTION|ADDITION)\b"
CLOSED_PERMIT = r"\b(FINAL|COMPLETE|CLOSED|EXPIRED|CANCEL)"
PERMIT_ITEMS = {41: "owner_val", 51: "permit_sqft", 53: "permit_units",
                55: "permit_bldgs"}

# Report row shapes.
RES_RATE_ROW = (
    r"^\s*Area\s+(\d+)\s+(Sales|Pop)\s+(-?\$?\s?[\d,]+)\s+(-?\$?\s?[\d,]+)\s+"
    r"([-+]?\$?\s?[-+]?[\d,]+)\s+([-+]?[\d.]+)\s?%"
)
DISTRICT_HEADER = r"Geo\s*Area\s+\d{4}\s+Total Value"
DISTRICT_ROW = (
    r"^\s*(\d{1,3})\s+(-?\$\s?[\d,]+)\s+(-?\$\s?[\d,]+)\s+"
    r"(-?\$\s?-?[\d,]+|\$\s?-[\d,]+)\s+(-?[\d.]+)\s?%"
)
SPECIALTY_NUMBER = r"(?:Specialty(?:\s+Area)?|Area:)\s*(\d{2,3})"
SPECIALTY_HEADER = r"(?i)CHANGE IN TOTAL ASSESSED VALUE"
SPECIALTY_TOTAL = (
    r"^\s*(\$\s*[\d,]+)\s+(\$\s*[\d,]+)\s+(\$?\s*\(?-?[\d,]+\)?)\s+"
    r"(-?[\d.]+)\s?%"
)
SPECIALTY_ROW = (
    r"^\s*(\d{2,3})[-\s]+(\d{3})\s+.*?\$\s*([\d,]+)\s+\$\s*[\d,]+\s+"
    r"(-?[\d.]+)\s?%"
)
RATE_NAME_PATTERN = (
    r"(?i)rate|pct|growth|return|index|rent|cap|price|adr|revpar|occupancy"
)

# Aggregate forecast: groups by specialty name and by use code, and the weights
# that spread what is left.
GROUP_BY_SPECIALTY = {
    "Apartment": "Multifamily", "Nursinghome": "Multifamily",
    "Industrial": "Industrial", "Warehouse": "Industrial",
    "Biotech": "Industrial", "MajorRetail": "Retail",
    "Restaurants": "Retail", "Hotel": "Hotels", "MajorOffice": "Major Office",
}
GROUP_BY_USE = {
    300: "Major Office", 309: "Major Office",
    304: "Medical/Life Science", 426: "Medical/Life Science",
    365: "Industrial", 406: "Industrial", 407: "Industrial",
    528: "Industrial",
    326: "Retail", 348: "Retail", 349: "Retail", 350: "Retail",
    352: "Retail", 353: "Retail", 531: "Retail",
    341: "Hotels", 344: "Hotels", 386: "Hotels",
    419: "Multifamily", 470: "Multifamily", 472: "Multifamily",
    706: "Multifamily",
}
GROUP_BLEND = {"Major Office": 0.22, "Industrial": 0.25, "Retail": 0.40,
               "Multifamily": 0.13}
GROUP_RATE_SOURCE = {
    "Major Office": "Major Office", "Industrial": "Industrial",
    "Retail": "Retail", "Hotels": "Hotels", "Multifamily": "Multifamily",
    "Medical/Life Science": "Multifamily",
}

# Market series without values in the forecast years, and the macro series kept.
DEAD_SERIES = (
    "availability_rate", "avail_rate_direct", "avail_rate_sublet",
    "available_sf", "leasing_sf", "base_rent", "base_rent_direct",
    "gross_rent", "gross_rent_direct", "cap_rate", "median_cap_rate",
    "median_price_sf", "under_constr_sf", "constr_starts_sf",
    "cap_value_index",
)
MACRO_PREDICTORS = (
    "econ_employment_thous_yoy_lag1",
    "econ_services_providing_yoy_lag1",
    "econ_population_thous_yoy_lag1",
    "econ_wholesale_and_retail_trade_yoy_lag1",
    "econ_housing_permits_thous_yoy_lag1",
    "econ_seattle_msa_s_p_corelogic_case_shilller_home_price_index_yoy_lag1",
    "econ_seattle_msa_cpi_u_1982_1984_100_yoy_lag1",
    "econ_employment_thous_lvl_lag1",
    "econ_services_providing_lvl_lag1",
    "econ_population_thous_lvl_lag1",
    "econ_seattle_msa_s_p_corelogic_case_shilller_home_price_index_lvl_lag1",
    "econ_seattle_msa_cpi_u_1982_1984_100_lvl_lag1",
)

REALIZATION_RATE = 0.47
MAX_LOG_CHANGE = 0.4054651081081644  # ln(1.5)
MAPE_FLOOR = 20000
IMPORTANCE_FAMILIES = (
    ("^econ_", "econ"), ("^sea_", "market"),
    ("^permits_|^val_last_|^sqft_last_|^units_last_", "permits"),
)

# Certified totals, personal property and appraised values (billions) by track.
EXEMPT_2023 = 1172001173
CERTIFIED_BEFORE_EXEMPT_2023 = 307774003816
CERTIFIED = (
    # tax year, grand total, certified total (None: derived), personal property
    (2022, 276293453116, None, 7490457363),
    (2023, 308874491598, None, 8542526282),
    (2024, 301214631275, 299443737414, 8947018132),
    (2025, 299963009621, 297696494175, 9073883825),
    (2026, 308777816989, 306466960900, 9330922938),
)
APPRAISED_BILLIONS = (
    (2022, "res", 136.44), (2022, "com", 99.12), (2022, "condo", 28.88),
    (2023, "res", 159.58), (2023, "com", 104.96), (2023, "condo", 30.76),
    (2024, "res", 147.84), (2024, "com", 105.44), (2024, "condo", 32.85),
    (2025, "res", 158.89), (2025, "com", 94.53), (2025, "condo", 30.94),
    (2026, "res", 165.53), (2026, "com", 94.79), (2026, "condo", 32.25),
)
