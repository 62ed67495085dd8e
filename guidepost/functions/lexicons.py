"""Default word lists. Every operator takes its lists as arguments; these are defaults.

All lists below are fixed values.
"""

DIMENSION_WORDS = {
    "check_1_revpar_guidance": ["revpar", "guidance", "actual", "miss", "beat", "outlook"],
    "check_2_room_additions": ["room additions", "new keys", "hotel opening", "expansion", "pipeline", "greenfield"],
    "check_3_occupancy_vs_adr": ["occupancy", "adr", "average daily rate", "pricing", "demand driver"],
    "check_4_fnb_mix_margin": ["f&b", "food and beverage", "banquet", "mix", "ebitda margin", "margin pressure"],
    "check_5_debt_coverage": ["debt", "interest coverage", "finance cost", "leverage", "refinancing", "borrowings"],
    "check_6_supply_overhang": ["new supply", "pipeline", "city supply", "oversupply", "new rooms", "market share pressure"],
}
DIMENSION_RULE_WORDS = {
    "check_1_revpar_guidance": ["earnings", "results", "guidance", "outlook", "estimate"],
    "check_2_room_additions": ["opening", "launch", "expansion", "pipeline", "new hotel", "new property"],
    "check_3_occupancy_vs_adr": ["demand", "pricing", "premium", "occupancy", "adr", "travel demand"],
    "check_4_fnb_mix_margin": ["margin", "profitability", "f&b", "banquet", "food and beverage"],
    "check_5_debt_coverage": ["debt", "borrowings", "finance cost", "interest", "leverage", "refinancing"],
    "check_6_supply_overhang": ["policy", "regulatory", "sebi", "city supply", "new supply", "oversupply", "tourism policy"],
}
MATERIAL_WORDS = [
    "earnings", "results", "guidance", "management commentary", "analyst", "rating", "downgrade", "upgrade",
    "merger", "acquisition", "m&a", "regulatory", "sebi", "exchange filing",
]
PRESS_WORDS = ["press release", "pr newswire", "business wire", "globenewswire", "sponsored", "advertorial"]
POSITIVE_WORDS = ["beat", "upgrade", "strong", "growth", "expansion", "improved", "record", "outperform", "higher", "upside"]
NEGATIVE_WORDS = ["miss", "downgrade", "weak", "decline", "fall", "cut", "risk", "concern", "pressure", "default"]
WATCH_WORDS = ["investigation", "regulatory", "audit", "pledge", "contingent", "litigation", "governance"]
SPECIFIC_WORDS = [
    "revpar", "occupancy", "adr", "ebitda", "debt", "guidance", "room nights", "key additions", "branded inventory",
    "hotel supply", "pipeline rooms", "management contract", "asset light", "hotel opening", "check-in", "room revenue",
    "banquet", "resort fee", "hospitality sector", "hospitality industry", "star hotel", "luxury hotel", "budget hotel",
    "mid-market hotel", "5-star", "4-star", "3-star", "investor day", "earnings call", "annual report",
    "q1 fy", "q2 fy", "q3 fy", "q4 fy", "fy25", "fy26", "fy24",
]
NOISE_WORDS = [
    "cricket", "ipl", "sports", "bollywood", "movie", "election", "parliament", "political party", "prime minister",
    "oil price", "petrol", "diesel", "cryptocurrency", "bitcoin", "agriculture", "farming", "monsoon", "weather forecast",
    "school", "college", "university", "education board", "hospital", "medicine", "pharma drug", "vaccine",
]
BOILERPLATE = [
    "digitally signed by", "page 1 of", "page 2 of", "scrip code", "bse limited", "national stock exchange",
    "yours sincerely", "you are requested to kindly",
]
STATEMENT_BOILERPLATE = [
    "limited review", "ind as", "listing regulations", "our conclusion is not modified",
    "according to the information and explanations", "auditor", "board of directors", "statement includes the results",
    "results have not been reviewed", "digitally signed",
]
NON_MANAGEMENT = ["moderator", "operator", "participant", "analyst", "investor"]
SCOPE_WORDS = [
    " we ", " our ", " us ", " company", " management", " portfolio", " hotel", " room", " property", " properties",
    " business", " revenue", " ebitda", " debt", " capex",
]
PROMISE_METRICS = {
    "Revenue": ["revenue", "sales", "top line", "topline", "income"],
    "Occupancy": ["occupancy", "occupancy rate"],
    "RevPAR": ["revpar", "rev par", "revenue per available room"],
    "ADR": ["adr", "average daily rate", "average rate", "arr"],
    "EBITDA Margin": ["ebitda margin", "operating margin", "opm", "margin expansion", "ebitda", "gop"],
    "Net Profit": ["pat", "profit after tax", "net profit", "bottom line", "profit"],
    "Debt": ["debt", "leverage", "borrowing", "net debt", "deleverag"],
    "Expansion": ["rooms", "keys", "properties", "hotels", "new openings", "pipeline", "portfolio"],
    "Capex": ["capex", "capital expenditure", "investment", "cwip"],
}
VERIFIABLE_METRICS = ["Revenue", "EBITDA Margin", "Net Profit", "Debt"]
EVIDENCE_FIELDS = ["title", "source", "url", "published_date", "dimension_primary", "citation"]
NODE_MIN_COUNTS = {"COMPANY": 1, "PERSON": 2, "TOPIC": 2, "BRAND": 2, "LOCATION": 2, "STRATEGY": 2, "TIME_PERIOD": 3}
RECENCY = [(("2026", "fy27"), 1.0), (("2025", "fy26"), 0.9), (("2024", "fy25"), 0.8), (("2023", "fy24"), 0.7), (("2022", "fy23"), 0.6)]

# News scope: words of the home sector and of the sector abroad.
SECTOR_WORDS = ("indian hospitality", "india hotel sector", "revpar", "occupancy", "adr", "hotel pipeline", "new keys", "tourism policy", "mice")
WORLD_WORDS = ("global hotel", "international hospitality", "marriott", "hilton", "hyatt", "ihg", "accor", "travel demand", "interest rates")
# News impact: (required dimension or None, words, verdict), first match wins.
IMPACT_RULES = (
    (None, ("investigation", "forensic", "fraud", "governance", "audit qualification", "default", "debt stress", "pledged", "downgrade"), "Watch"),
    ("check_5_debt_coverage", ("reduction in debt", "improved coverage", "refinanced at lower cost"), "Neutral"),
    ("check_5_debt_coverage", ("higher finance cost", "rising debt", "coverage pressure", "leverage concern"), "Negative"),
    (None, ("guidance raised", "beat estimates", "strong demand", "occupancy improvement", "adr growth"), "Positive"),
    ("check_6_supply_overhang", ("new supply", "pipeline", "oversupply"), "Watch"),
)
