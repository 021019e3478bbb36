"""Fixed values that every operator shares; they bound what counts as plausible and as enough."""

# Fixed values.
SALES_GROUP = "Sales"
PRICE_M2_MIN, PRICE_M2_MAX = 500, 200_000
RENT_M2_MIN, RENT_M2_MAX = 50, 20_000
SALE_MIN_DATE = "1990-01-01"
RENT_HORIZON_YEARS = 2
CAGR_MIN_YEARS, CAGR_ANCHOR_MIN_N = 2.0, 5
TIER_STRONG_N, TIER_THIN_N = 20, 5
ANCHOR_MONTHS, DAYS_PER_YEAR, MIN_YEARS_FOR_CAGR = 12, 365.25, 1.0
SPLIT_WINDOW_DAYS, SPLIT_MIN_OVERLAP_PCT = 45, 30
CENTROID_RADIUS_M = 3000
TRIGRAM_MIN, RESOLVE_MARGIN = 0.30, 0.05
MIN_SAMPLE = 20
BULK, GATEWAY = 1, 2
VOLATILE_KEYS = ("RN", "TOTAL", "TOTAL_SELLER", "TOTAL_BUYER", "TOTAL_PROPERTIES", "DEFAULT_SORT")
EARTH_RADIUS_M = 6_371_008.8
AREA_ADDRESS_TYPES = ("suburb", "neighbourhood", "quarter", "residential", "city_district", "town", "village", "hamlet")
PROJECT_ADDRESS_TYPES = (*AREA_ADDRESS_TYPES, "building", "construction", "commercial", "retail", "industrial", "house", "apartments", "tower", "hotel", "attraction", "island", "leisure")
PLACE_TYPES = ("establishment", "premise", "point_of_interest", "subpremise", "street_address", "landmark", "building")
ORDINAL_TOKENS = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "NORTH", "SOUTH", "EAST", "WEST")
