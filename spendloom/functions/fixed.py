"""Fixed values of the data model: names, word lists, defaults and charges.

They decide results, so they are stated here once, as plain text.
"""

# Default texts.
UNKNOWN_VENDOR = "Unknown Vendor"
OTHER_CATEGORY = "Other"
NO_DESCRIPTION = "No description"
KEYWORD_IMPACT = "Standard operational expense"
DEFAULT_IMPACT = "Standard expense"
LOW_RISK = "Low"
KEYWORD_CONFIDENCE = 0.85

# Vendor keywords, first match wins.
VENDOR_RULES = [
    (("google",), "Google Workspace"),
    (("meta", "facebook"), "Meta"),
    (("amazon",), "Amazon"),
    (("digitalocean",), "DigitalOcean"),
    (("stripe",), "Stripe"),
]

# Category keywords, first match wins.
CATEGORY_RULES = [
    (("meta", "facebook"), "Marketing & Advertising"),
    (("notion", "zoom", "slack"), "Software & Technology"),
    (("amazon",), "Office Supplies & Equipment"),
]

# The nominal category list.
CATEGORIES = [
    "Marketing & Advertising",
    "Software & Technology",
    "Office Supplies & Equipment",
    "Travel & Transportation",
    "Meals & Entertainment",
    "Professional Services",
    "Insurance & Legal",
    "Utilities & Rent",
    "Employee Benefits",
    "Banking & Finance",
    "Other",
]

# Charge per request in cents, reply length and temperature.
REQUEST_CENTS = {"vendor": 1, "category": 1, "analysis": 2}
REQUEST_MAX_TOKENS = {"vendor": 50, "category": 150, "analysis": 200}
REQUEST_TEMPERATURE = {"vendor": 0.1, "category": 0.2, "analysis": 0.3}

# Placeholder hit rate never exceeds this.
HIT_RATE_CEILING = 0.3
REPORT_VERSION = "v4.2"

# Reject reasons of the payload reader.
REJECT_NOT_JSON = "Payload is not valid JSON"
REJECT_TYPE = "Input must be a dictionary or list"
REJECT_SHAPE = "Unrecognized data format"
REJECT_EMPTY = "No transactions provided"
REJECT_ITEM = "All transaction items must be objects"
REJECT_MERCHANT = "All transactions must have a 'merchant' field"
# Not a fixed value: our own reason for options that are not valid.
REJECT_CONFIG = "Config is not valid"

# Every character that counts as white space around a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
