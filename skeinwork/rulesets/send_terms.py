"""Vocabulary of the gate before sending. Fixed values, in lower case, by lexicon."""

SEND_TERMS: dict[str, tuple[str, ...]] = {
    "s_leadership": ("future of", "future with", "from sci-fi to reality", "opinion", "commentary", "analysis", "thought leadership", "fireside chat", "roundtable", "keynote"),
    "s_interview": ("with dr.", "podcast", "webinar", "summit", "expo", "interview", "q&a"),
    "s_military": ("military", "battlefield", "combat", "defense", "defence", "frontline", "weapon", "weapons", "missile", "munitions", "armed forces", "strike drone"),
    "s_profile": ("banker", "billionaire", "estate", "mansion", "luxury home", "luxury estate", "personal fortune", "net worth", "executive profile", "private residence", "villa"),
    "s_launch": ("launches", "launch", "released", "release", "unveils", "update", "updates", "platform", "tool", "software", "capabilities"),
    "s_operation": (
        "deploy", "deployment", "factory", "factories", "manufacturing", "production", "production facility", "production facilities", "factory floor", "robot cells", "robot cell", "3d vision", "scara", "virtual twin", "virtual twins",
        "layout", "routes", "agv", "amr", "modular teaching spaces", "jobsite", "worksite", "data factory", "real-world data", "real world data", "drive-by-wire", "driverless", "haul truck", "mining truck", "heavy equipment", "mine site",
        "surface finishing", "industrial automation systems", "autonomous industrial automation", "automation systems", "factory automation systems",
    ),
    "s_sustained": ("8-hour shift", "8-hour shifts", "8 hour shift", "8 hour shifts", "full shift", "full shifts", "without intervention", "factory-style", "factory style", "continuous operation"),
    "s_execution": ("modular", "prefab", "prefabrication", "off-site", "offsite", "assembly", "factory-built", "construction", "building", "component"),
    "s_ai_world": (
        "physical ai", "physics ai", "robotics", "robot", "robots", "virtual twin", "virtual twins", "digital twin", "digital twins", "manufacturing workflow", "manufacturing workflows", "production workflow", "production workflows",
        "engineering workflow", "engineering workflows", "physical industries", "factory floor",
    ),
    "s_capability": (
        "robot", "robots", "robotics", "humanoid", "physical ai", "physics ai", "industrial automation", "machine vision", "robot programming", "construction robotics", "construction automation", "prefab", "prefabrication", "modular",
        "offsite", "off-site", "contech", "building tech", "housing delivery",
    ),
    "s_access": ("humanoid", "aliexpress", "global sales", "global availability", "broader market", "entry point", "western peers", "experimentation", "entry-level", "low-cost", "lower-cost"),
    "s_statistics": (
        "bauhauptgewerbe", "auftragseingang", "baugenehmigungen", "fertigstellungen", "fertiggestellte", "fertiggestellter", "wohnungen gebaut", "wohnungen fertiggestellt", "construction orders", "building permits", "housing approvals",
        "housing completions", "completed homes", "completions", "construction output", "orders", "permits", "approvals", "output",
    ),
    "s_housing": (
        "housing market", "wohnungsmarkt", "housebuilding", "wohnungsbau", "wohnungsnot", "wohnraum", "einfaches bauen", "senat", "gesetz", "überbelegten wohnungen", "uberbelegten wohnungen", "overcrowded dwellings", "overcrowded housing",
        "rents", "mieten", "house prices", "kaufpreise", "immobilienfinanzierung", "immobilienfinanzierungsindex", "finanzierungsindex", "difi", "zinsen", "real estate finance", "property finance", "affordable housing", "build-to-rent",
        "btr", "residential demand", "housing supply", "building permits", "housing approvals", "energieeffizienz", "fertigstellungen", "fertiggestellt", "fertiggestellte", "fertiggestellter", "wohnungen gebaut", "gebaute wohnungen",
        "completions", "completion", "genehmigung", "genehmigungen",
    ),
    "s_housing_sign": (
        "%", "index", "study", "report", "forecast", "shortfall", "shortage", "gesetz", "reform", "higher", "lower", "increase", "decrease", "rise", "fall", "month", "months", "monat", "monate", "year", "years", "jahr", "jahre",
        "26 monate", "two years", "more than two years",
    ),
    "s_uk": (
        "construction activity", "construction output", "project starts", "main contract awards", "planning approvals", "planning applications", "construction sector", "infrastructure", "commercial", "housing", "industrial", "regional",
        "materials prices", "workforce", "labour costs",
    ),
    "s_uk_sign": ("%", "index", "report", "forecast", "bn", "billion", "framework", "fall", "fell", "drop", "decline", "rise", "rose", "increase", "higher", "lower"),
    "s_training": ("data factory", "train robot ai", "training robot ai", "robot ai", "real-world data", "real world data", "real-world autonomy", "real world autonomy", "mobile manipulator"),
    "s_heavy": ("drive-by-wire", "driverless", "mining truck", "haul truck", "autonomous haulage", "heavy equipment", "mine site", "off-road"),
    "s_introduced": ("introduced", "introduces", "unveiled", "unveils", "launches", "launched"),
    "s_fabrication": ("robotic arm", "robot mills", "robotic fabrication", "robotic mass timber", "robotic timber", "kuka", "milling", "precision"),
    "s_reuse": ("olympic village", "student housing", "student accommodation", "reopen to students", "converted", "converting", "conversion", "four-month", "four months", "publicly supported student housing"),
    "s_strategy": ("national strategy", "five-year plan", "industrial system", "physical applications", "international federation of robotics"),
    "s_governance": ("rulebook", "rulebooks", "rules conflict", "safer decisions", "transparent decisions", "real-world situations", "real world situations"),
    "s_joint": ("partner on", "partners on", "partnership", "collaboration", "joint solution", "joint offering", "integrated solution", "combined offering"),
    "s_platform": ("industrial automation", "autonomous industrial automation", "automation systems", "factory automation", "factory automation systems", "robotics platform", "automation platform", "ai-powered robotics", "ai powered robotics"),
    "s_plant": ("manufacturing", "factory", "production", "industrial"),
    "s_works": ("factory", "manufacturing", "production"),
    "s_constraint": ("cap", "height cap", "height limit", "approval", "approvals", "approval pathway", "permitting", "permit", "insurance", "insurers", "fire", "restriction", "restrictions", "barrier", "barriers"),
    "s_policy": ("code", "codes", "standard", "standards", "regulation", "regulations", "regulatory", "policy", "policies"),
    "s_friction": ("concern", "concerns", "challenge", "challenges", "conflict", "friction", "restrict", "restricted", "restriction", "limit", "limits", "cap", "caps", "open new front"),
    "s_economics": ("premium", "premiums", "cost", "costs", "price", "prices", "pricing", "economics", "economic", "viability", "commercial viability", "competitiveness", "affordability"),
    "s_times": ("%", "times higher", "times lower", "six to ten times", "higher than", "lower than"),
    "s_barrier": ("barrier", "barriers", "adoption", "commercial", "competitive", "scaling", "scale-up", "viable", "viability"),
    "s_performance": ("heat loss", "thermal bridges", "thermal bridge", "building performance", "energy performance", "operational energy", "cold zones", "identical typology"),
    "s_material": ("concrete", "steel", "mass timber", "clt", "glulam"),
    "s_measured": ("%", "per cent", "more heat", "less heat", "higher than", "lower than"),
    "s_project": ("project", "development", "tower", "hotel", "housing", "apartment", "apartments", "storey", "storeys", "rezoning", "planning application", "rezoning application", "units"),
    "s_shift": ("glass", "curtain wall", "curtain walling", "masonry", "brick", "concrete", "rammed earth", "hybrid construction", "engineered timber", "embodied carbon", "thermal mass"),
    "s_shift_context": ("architect", "architects", "architectural", "adoption", "demand", "growth", "climate urgency", "designed to last", "durable architecture", "opening the way", "opening the door", "material shift", "age with grace"),
    "s_mid_rise": ("mid-rise", "mid rise"),
    "s_residential": ("housing", "residential", "apartment", "apartments", "multifamily", "multi-family"),
    "s_institution": ("fire station", "airport", "school", "college", "university", "civic", "public building", "terminal", "emergency services"),
}
