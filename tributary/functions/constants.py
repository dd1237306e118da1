"""Word lists and patterns of the feature functions."""

# Canonical first names and their short forms. Where a short form stands for
# several names, the first one counts.
NICKNAMES = {
    "ROBERT": ["BOB", "ROB", "BOBBY", "ROBBIE"],
    "WILLIAM": ["BILL", "WILL", "BILLY", "WILLY"],
    "RICHARD": ["RICK", "DICK", "RICH", "RICKY"],
    "JAMES": ["JIM", "JIMMY", "JAMIE"],
    "JOHN": ["JACK", "JOHNNY", "JON"],
    "JOSEPH": ["JOE", "JOEY"],
    "THOMAS": ["TOM", "TOMMY"],
    "MICHAEL": ["MIKE", "MIKEY"],
    "CHARLES": ["CHUCK", "CHARLIE"],
    "EDWARD": ["ED", "TED", "EDDIE", "TEDDY"],
    "DAVID": ["DAVE", "DAVY"],
    "DANIEL": ["DAN", "DANNY"],
    "MATTHEW": ["MATT", "MATTY"],
    "ANTHONY": ["TONY"],
    "CHRISTOPHER": ["CHRIS"],
    "NICHOLAS": ["NICK", "NICKY"],
    "BENJAMIN": ["BEN", "BENNY"],
    "SAMUEL": ["SAM", "SAMMY"],
    "JONATHAN": ["JON", "NATHAN"],
    "STEPHEN": ["STEVE"],
    "STEVEN": ["STEVE"],
    "TIMOTHY": ["TIM", "TIMMY"],
    "ANDREW": ["ANDY", "DREW"],
    "PATRICK": ["PAT", "PADDY"],
    "ALEXANDER": ["ALEX", "SANDY"],
    "GREGORY": ["GREG"],
    "LAWRENCE": ["LARRY"],
    "RAYMOND": ["RAY"],
    "CATHERINE": ["CATHY", "KATE", "KATHY"],
    "ELIZABETH": ["LIZ", "BETH", "ELIZA", "BETTY", "LIZZY"],
    "JENNIFER": ["JEN", "JENNY"],
    "MARGARET": ["MAGGIE", "MEG", "PEGGY"],
    "PATRICIA": ["PAT", "PATTY"],
    "JESSICA": ["JESS", "JESSIE"],
    "REBECCA": ["BECKY", "BECCA"],
    "SUSAN": ["SUE", "SUZY"],
    "DOROTHY": ["DOT", "DOTTY"],
    "VIRGINIA": ["GINNY", "GINGER"],
    "BARBARA": ["BARB", "BARBIE"],
    "DEBORAH": ["DEB", "DEBBIE"],
    "CHRISTINE": ["CHRIS", "TINA"],
    "CHRISTINA": ["CHRIS", "TINA"],
    "VICTORIA": ["VICKY", "TORI"],
    "ALEXANDRA": ["ALEX", "SANDY"],
}

# Abbreviations of the postal addressing standard (street suffixes, directions, units).
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "ROAD": "RD",
    "HIGHWAY": "HWY", "PARKWAY": "PKWY", "PLACE": "PL", "CIRCLE": "CIR", "COURT": "CT", "TERRACE": "TER",
    "TRAIL": "TRL", "WAY": "WAY", "SQUARE": "SQ", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "TURNPIKE": "TPKE",
    "PIKE": "PIKE", "ALLEY": "ALY", "CROSSING": "XING", "CRESCENT": "CRES", "HEIGHTS": "HTS", "JUNCTION": "JCT",
    "LOOP": "LOOP", "RIDGE": "RDG", "VALLEY": "VLY", "POINT": "PT", "GROVE": "GRV", "GARDENS": "GDNS",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW",
    "SOUTHEAST": "SE", "SOUTHWEST": "SW", "APARTMENT": "APT", "SUITE": "STE", "BUILDING": "BLDG",
    "FLOOR": "FL", "DEPARTMENT": "DEPT",
}

# Patterns of names, businesses and numbers.
SALUTATION = "MR|MRS|MS|MISS|DR|PROF|REV|HON"
NAME_SUFFIX = "JR|SR|II|III|IV|V|VI|VII|VIII|IX|X|ESQ|PHD|MD"
GENERATION = "JR|SR|JUNIOR|SENIOR|II|III|IV|V|VI|VII|VIII|2ND|3RD|4TH"
ROMAN = "II|III|IV|VI|VII|VIII|IX|XI|XII"
BUSINESS_SUFFIX = (
    "LLC|INC|CORP|CORPORATION|LTD|LIMITED|LP|LLP|PLLC|PC|PA|COMPANY|CO|GROUP|HOLDINGS|ENTERPRISES?|"
    "ASSOCIATES?|PARTNERS?|SERVICES?|SOLUTIONS?|INTERNATIONAL|INTL|NATIONAL|NATL"
)
BUSINESS_TYPE = "LLC|INC|INCORPORATED|CORP|CORPORATION|LTD|LIMITED|LP|LLP|PLLC|PC|PA|COMPANY|CO"
DBA_NOISE = "LLC|INC|CORP|LTD|LP|LLP|PLLC|PC|PA|CO|COMPANY|THE"
DBA = "DBA|D/B/A|T/A|AKA|A/K/A"
BUSINESS_WORDS = (
    "LLC|INC|CORP|LTD|LP|LLP|PLLC|PC|PA|COMPANY|CO|ENTERPRISES|PARTNERS|GROUP|HOLDINGS|"
    "INDUSTRIES|SERVICES|SOLUTIONS|ASSOCIATES|CONSULTING"
)
ORGANIZATION_WORDS = (
    "TRUST|ESTATE|FOUNDATION|ASSOCIATION|SOCIETY|INSTITUTE|CHURCH|MINISTRY|UNIVERSITY|COLLEGE|"
    "SCHOOL|HOSPITAL|COUNCIL|COMMISSION|AUTHORITY|BUREAU|DEPARTMENT|AGENCY|BOARD"
)
CARE_OF = (
    "HOA|HOMEOWNERS|HOME OWNERS|TRUST|TRUSTEE|ESTATE OF|C/O|CARE OF|ATTN|ATTENTION|FBO|FOR BENEFIT OF|"
    "AS AGENT|AS TRUSTEE|AS CUSTODIAN|POA|POWER OF ATTORNEY"
)
DIRECTIONS = (
    "NORTH|SOUTH|EAST|WEST|CENTRAL|NORTHEAST|NORTHWEST|SOUTHEAST|SOUTHWEST|NORTHERN|SOUTHERN|EASTERN|WESTERN"
)
UNIT = r"(?:APT|SUITE|STE|UNIT|#|NO)\.?\s*(\w+)"
NUMBERED = r"(?:#|NO\.?|NUM(?:BER)?\.?|UNIT|SUITE|STE|APT|BLDG|BUILDING)\s*(\d+)"
TITLE_PAIR = r"\b(MR|MRS|MS|DR)\.?\s*(AND|&)\s*(MR|MRS|MS|DR)\.?"
FAMILY = r"^THE\s+\w+\s+FAMILY$"
SLASH = r"\w+\s*/\s*\w+"
FREE_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com", "protonmail.com",
    "live.com", "msn.com",
]
MORE_FREE_DOMAINS = [
    "zoho.com", "yandex.com", "me.com", "gmx.com", "inbox.com",
]
DISPOSABLE_DOMAINS = [
    "mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "sharklasers.com", "dispostable.com",
    "yopmail.com", "trashmail.com",
]
ROLE_ADDRESSES = [
    "info", "admin", "sales", "support", "contact", "help", "service", "billing", "noreply", "no-reply", "webmaster",
    "postmaster", "abuse", "marketing", "office", "hr", "jobs", "careers", "press", "media", "team", "hello",
    "general", "enquiries", "inquiries",
]

# What is entered where a value is missing.
PLACEHOLDER_PHONE = r"^((\d)\2{6,}|1234567890|0123456789|9876543210)$"
PLACEHOLDER_EMAIL = (
    r"^(noemail|no[._-]?email|test|nobody|placeholder|noreply|no[._-]?reply|fake|example|invalid|unknown|n/?a|none|null|"
    r"donotreply|do[._-]?not[._-]?reply|sample|temp|dummy|abc|xxx|info|admin)@"
)
PLACEHOLDER_DOMAIN = r"@(example|test|fake|invalid|placeholder|noemail|mailinator)\.com$"
PLACEHOLDER_NAMES = [
    "UNKNOWN", "N/A", "NA", "N A", "TBD", "TBA", "PENDING", "TEST", "TESTING", "DECEASED", "DECEDENT", "DO NOT USE",
    "DO NOT MAIL", "DO NOT CONTACT", "NONE", "NULL", "DUMMY", "SAMPLE", "TEMP", "TEMPORARY", "GENERAL DELIVERY",
    "OCCUPANT", "CURRENT RESIDENT", "RESIDENT", "NOT PROVIDED", "NOT AVAILABLE", "UNAVAILABLE", "BLANK", "XXX", "XXXX",
    "XXXXX", "ZZZ", "ZZZZ", "JOHN DOE", "JANE DOE", "BABY BOY", "BABY GIRL", "FNU", "LNU", "NMN", "NFN",
]
PLACEHOLDER_ADDRESSES = [
    "123 MAIN ST", "123 MAIN STREET", "000", "0000", "GENERAL DELIVERY", "NO ADDRESS", "NONE", "N/A", "NA", "UNKNOWN",
    "HOMELESS", "TRANSIENT", "REFUSED", "NOT PROVIDED", "NOT AVAILABLE", "UNAVAILABLE", "PO BOX 0", "PO BOX 000", "TEST",
    "TEMP", "TBD",
]
PLACEHOLDER_SSN = r"^((\d)\2{8}|123456789|987654321)$"
ACCENTED = "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŸÑÇÐÞßÆ"
UNACCENTED = "AAAAAAEEEEIIIIOOOOOOUUUUYYNC"
