"""Vocabulary of the market signals and of what is in and out of scope. Fixed values, in lower case, by lexicon."""

SCOPE_TERMS: dict[str, tuple[str, ...]] = {
    "statistics_subject": ("bauhauptgewerbe", "baugenehmigungen", "auftragseingang", "construction orders", "building permits", "housing approvals", "wohnungen"),
    "statistics_sign": ("%", "increase", "decrease", "higher", "lower", "month", "year", "vomormonat", "vorjahresmonat", "gestiegen", "gesunken"),
    "timber_policy": ("cap", "code", "approval", "approvals", "approval pathway", "rezoning", "rezoning application", "planning application", "permitting", "insurance", "insurers", "standard", "standards", "regulation", "regulatory", "policy", "height", "fire"),
    "mid_rise": ("mid-rise", "mid rise", "housing", "residential", "apartments", "apartment", "multifamily", "multi-family", "homes", "homebuilding"),
    "institution": ("fire station", "airport", "school", "college", "university", "civic", "public building", "public buildings", "terminal", "station", "emergency services", "community facility"),
    "timber_cost": ("premium", "premiums", "cost", "costs", "price", "prices", "pricing", "economics", "economically"),
    "timber_quantified": ("%", "times higher", "times lower", "six to ten times", "higher than", "lower than"),
    "timber_barrier": ("commercial viability", "viability", "adoption barrier", "adoption barriers", "competitive", "competitiveness", "affordability", "commercial", "scaling", "scale-up", "cost comparison", "times higher", "times lower", "six to ten times", "higher than", "lower than"),
    "german_market": (
        "immobilienpreisindex", "preisindex", "wohnungsmarkt", "wohnungsbau", "wohnungsmangel", "wohnungsnot", "wohnungen", "wohneigentum", "überbelegten wohnungen", "uberbelegten wohnungen", "overcrowded dwellings", "overcrowded housing",
        "mieten", "mietpreis", "mietpreise", "kaufpreise", "hauspreise", "baugenehmigungen", "wohnungsbestand", "energieeffizienz", "investoren", "immobilienfinanzierung", "immobilienfinanzierungsindex", "finanzierungsindex", "difi",
        "zinsen", "zinssatz", "neubau", "residential market", "housing market", "real estate finance", "property finance", "building permits", "housing approvals", "rents", "house prices", "apartment market", "affordable housing",
    ),
    "german_policy": ("koalition", "senat", "gesetz", "einfaches bauen", "wohnungsnot", "wohnungsbau", "wohnraum", "wohnraummangel", "housing shortage", "housing supply", "building law", "planning reform"),
    "uk_housing": (
        "housing market", "housebuilding", "homebuilding", "housing delivery", "housing shortage", "affordable housing", "build-to-rent", "btr", "residential market", "rents", "rental market", "house prices", "planning reform",
        "planning system", "planning approvals", "residential demand", "housing supply", "starts", "completions",
    ),
    "uk_construction": (
        "construction activity", "construction output", "project starts", "main contract awards", "planning approvals", "starts on site", "planning applications", "construction sector", "industry output", "materials prices", "workforce",
        "regional", "housing", "infrastructure", "industrial", "commercial", "civils", "engineering order books", "productivity", "labour costs",
    ),
    "uk_priority": (
        "activity", "output", "housing", "residential", "infrastructure", "industrial", "inflation", "materials prices", "material prices", "labour costs", "labor costs", "planning approvals", "planning applications", "timber",
        "mass timber", "modular", "prefab", "prefabrication", "framework", "procurement", "demolition",
    ),
    "uk_programme": ("framework", "framework launched", "housing framework", "public-sector procurement", "public sector procurement", "procurement", "demolition"),
    "uk_other_sector": ("hotel", "hotels", "leisure"),
    "market_sign": (
        "%", "index", "preisindex", "finanzierungsindex", "immobilienfinanzierungsindex", "difi", "study", "report", "forecast", "fall", "fell", "drop", "decline", "declined", "rise", "rose", "increase", "increased", "higher", "lower",
        "verteuert", "verteuerung", "teurer", "shortfall", "shortage", "demand", "supply", "investor", "investors",
    ),
    "briefing_scope": ("mass timber", "timber", "clt", "glulam", "modular", "prefab", "prefabrication", "offsite", "off-site", "industrialized construction", "factory-built housing", "construction robotics", "jobsite robotics", "construction automation", "housing delivery", "building permits", "planning reform"),
    "engineering_scope": ("robot", "robots", "robotics", "humanoid", "physical ai", "factory automation", "industrial automation", "automation system", "autonomous system", "robot cell", "warehouse automation", "construction automation", "drive-by-wire", "driverless", "mining truck", "haul truck", "heavy equipment", "off-road"),
    "engineering_off_scope": ("space", "orbit", "satellite", "military", "defense", "defence", "missile", "drone strike", "fighter jet", "quantum", "fusion", "battery breakthrough", "consumer gadget", "smartphone"),
    "consumer_robot": ("home robot", "domestic robot", "home assistant", "robot vacuum", "companion robot", "entertainment robot", "toy robot", "consumer robot"),
    "ride_service": ("robotaxi", "robotaxi service", "autonomous taxi", "self-driving taxi", "ride-hailing", "ride hailing", "ride service", "ride-sharing", "ridesharing", "autonomous ride service", "self-driving ride service", "public rides"),
    "ride_guide": ("how to ride", "costs", "cost to ride", "crash record", "where available", "available in", "ride in", "book a ride", "hail a ride", "app-based", "ride app", "city expansion", "service availability", "public ride"),
    "military": (
        "military robot", "military robotics", "battlefield robot", "battlefield robots", "battlefield robotics", "combat robot", "combat robots", "combat robotics", "combat drone", "combat drones", "defense robot", "defence robot",
        "defense robotics", "defence robotics", "war robot", "warfare robot", "battlefield", "combat", "defense", "defence", "frontline", "weapon system", "weapons system", "armed forces", "military drone", "strike drone", "lethal",
        "munitions", "missile",
    ),
    "business_profile": ("banker", "billionaire", "estate", "mansion", "luxury home", "luxury estate", "personal fortune", "net worth", "executive profile", "wealth", "private residence", "villa"),
    "medical": (
        "medical", "clinical", "diagnostic", "diagnostics", "healthcare", "hospital", "hospitals", "patient", "patients", "therapy", "therapeutic", "surgical", "surgeon", "surgeons", "physician", "physicians", "dermatology",
        "dermatologist", "dermatologists", "medtech", "skin cancer",
    ),
    "medical_business": ("manufacturing", "production", "seed round", "funding", "raises", "raised"),
    "pharma": (
        "cancer drug", "cancer drugs", "drug manufacturing", "pharmaceutical manufacturing", "pharma manufacturing", "pharmaceutical", "pharmaceuticals", "pharma", "biotech", "biotech therapeutics", "therapeutic production",
        "clinical production", "medical production", "drug production", "pharmaceutical production", "therapeutic manufacturing", "biopharma", "biopharmaceutical", "biopharmaceuticals", "therapeutics", "drug discovery",
    ),
    "space_word": ("space", "orbit", "orbital", "in-space", "microgravity"),
    "space_pharma": ("in-space drug manufacturing", "orbital pharma", "space biotech", "space pharma", "microgravity drug", "microgravity pharmaceutical", "microgravity therapeutics"),
    "robot_exception": ("robot", "robots", "robotics", "factory automation", "construction automation"),
    "industrial_context": ("construction", "industrial", "manufacturing", "jobsite", "worksite", "factory", "prefab", "modular", "assembly", "production", "timber", "permitting", "code"),
    "factory_signal": ("factory", "factories", "manufacturing", "production line", "production lines", "manufacturing line", "manufacturing lines", "manufacturing facility", "manufacturing facilities", "hardware manufacturing", "vertically integrated", "capacity to build"),
    "autonomy_exception": (
        "warehouse", "warehousing", "logistics", "intralogistics", "material handling", "autonomous mobile robots", "mobile industrial robots", "amr", "amrs", "agv", "agvs", "construction automation", "construction autonomy",
        "jobsite robotics", "off-road", "mining", "mine site", "heavy equipment", "earthmoving", "haul truck", "autonomous haulage", "infrastructure automation", "data center construction",
    ),
    "topic": (
        "robot", "robots", "robotics", "humanoid", "automation", "automated", "autonomy", "autonomous", "prefab", "prefabrication", "modular", "offsite", "off-site", "osm", "construction", "contech", "timber", "mass timber", "factory",
        "permitting", "code", "policy",
    ),
    "broad_scope": (
        "jobsite", "worksite", "prefab", "prefabrication", "modular", "off-site", "offsite", "industrialized", "industrialized construction", "construction robotics", "jobsite robotics", "industrial robot", "industrial robotics",
        "industrial automation", "construction automation", "construction equipment", "heavy equipment", "mass timber", "clt", "glulam", "permitting", "approval", "building code", "housing delivery", "modular housing",
        "factory-built housing",
    ),
    "high_intent": (
        "jobsite", "worksite", "prefab", "prefabrication", "modular", "off-site", "offsite", "industrialized construction", "construction robotics", "jobsite robotics", "industrial robot", "industrial robotics", "industrial automation",
        "construction automation", "construction equipment", "heavy equipment", "mass timber", "clt", "glulam", "permitting", "building code", "housing delivery", "modular housing", "factory-built housing", "physical ai",
        "virtual twin", "virtual twins", "robot cell", "robot cells", "scara", "3d vision", "machine vision", "production facility", "production facilities", "factory floor", "factories",
    ),
    "warehousing": ("warehouse", "warehousing", "logistics", "intralogistics", "material handling"),
    "robotics": ("robot", "robots", "robotics", "humanoid", "autonomy", "autonomous"),
    "robotics_launch": ("launches", "launched", "introduces", "introduced", "unveils", "unveiled", "releases", "released", "rolls out", "rolled out", "debuts", "debuted"),
    "robotics_product": ("automation cell", "robot cell", "robotic cell", "surface finishing", "finishing cell", "sanding", "polishing", "grinding", "painting", "coating", "manufacturing cell", "factory automation", "industrial automation", "manufacturing automation", "autonomous cell"),
    "automation": ("automation", "automated"),
    "plant_word": ("industrial", "manufacturing", "factory"),
    "work_place": ("industrial", "manufacturing", "factory", "factories", "jobsite", "worksite", "production", "assembly"),
    "robotics_context": ("physical ai", "virtual twin", "virtual twins", "robot cell", "robot cells", "scara", "3d vision", "machine vision", "robot programming", "programming platform", "production facility", "production facilities", "factory floor", "factories"),
    "robotics_business": ("teradyne robotics", "universal robots", "mobile industrial robots", "mir", "robotics revenue", "robotics segment revenue", "robotics segment", "collaborative robots", "cobots", "mobile robots", "amrs", "autonomous mobile robots"),
    "performance": ("revenue", "sales", "orders", "margin", "earnings", "quarter", "q1", "q2", "q3", "q4", "segment", "growth", "grew", "decline", "declined", "rises", "rose", "falls", "fell"),
    "built": ("jobsite", "worksite", "prefab", "prefabrication", "modular", "offsite", "off-site", "industrialized construction", "housing delivery", "factory-built", "mass timber", "timber", "clt", "glulam", "permitting", "building code", "code approval"),
    "timber_logistics": ("marine terminal", "port", "ports", "terminal", "timber terminal", "one-stop-shop", "one-stop shop", "logistics", "distribution", "shipping", "export hub", "import hub", "supply chain"),
    "timber_kept": (
        "construction", "building", "buildings", "project", "projects", "development", "developments", "housing", "homes", "apartment", "apartments", "tower", "campus", "jobsite", "worksite", "site", "new homes", "modular housing",
        "factory-built housing",
    ),
    "business_topic": ("robot", "robots", "robotics", "humanoid", "physical ai", "factory automation", "industrial automation", "construction", "housing", "timber", "mass timber", "prefab", "prefabrication", "modular"),
}
