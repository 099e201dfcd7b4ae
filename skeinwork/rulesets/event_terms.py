"""Vocabulary of the event flags. Words and phrases, in lower case, by lexicon."""

EVENT_TERMS: dict[str, tuple[str, ...]] = {
    "funding": ("raises", "raised", "series a", "series b", "series c", "series d", "seed round", "pre-seed", "funding round", "investment", "financing"),
    "raised_otherwise": ("raised concerns", "raised fresh concerns", "raised questions", "raised alarms"),
    "partnership": ("partnership", "partners with", "partnered with", "partnered", "partnering", "partner on", "partners on", "collaboration", "collaborating with", "co-development", "joint development"),
    "acquisition": ("acquires", "acquisition", "acquired", "buys", "buying", "purchase", "purchases", "purchased", "takeover", "takeovers", "merger", "merge", "merged"),
    "deployment": ("deployment", "deployed", "pilot", "rollout", "contract", "framework agreement"),
    "factory": ("factory opening", "factory expansion", "new factory", "production line", "manufacturing facility", "manufacturing plant", "plant expansion", "capacity expansion"),
    "opening_verb": ("opens", "opened", "opening", "launches", "launched", "announces", "announced", "expands", "expanded"),
    "factory_context": ("factory", "factories", "production line", "production lines", "manufacturing facility", "manufacturing facilities", "manufacturing plant", "manufacturing plants", "hardware manufacturing", "production capacity", "capacity to build"),
    "code_policy": ("permitting", "permit", "building code", "code approval", "approval pathway", "planning approval", "regulation", "regulatory", "zoning", "standard", "policy reform"),
    "timber": ("timber", "mass timber", "glulam", "clt", "engineered wood", "engineered wood products"),
    "timber_narrow": ("timber", "mass timber", "clt", "glulam"),
    "timber_strategic": ("demand", "adoption", "floor area", "square metre", "sq m", "growth", "capacity", "mid-rise", "housing", "residential"),
    "timber_performance": ("heat loss", "thermal bridges", "thermal bridge", "building performance", "energy performance", "operational energy", "cold zones", "identical typology", "embodied carbon", "concrete and steel", "concrete vs mass timber", "steel vs timber"),
    "timber_showcase": ("showcase", "design", "architecture", "pavilion", "residence", "award"),
    "construction_innovation": ("modular", "prefab", "prefabrication", "offsite", "off-site", "factory-built"),
    "timber_fabrication": ("robotic arm", "robot mills", "robotic fabrication", "robotic mass timber", "robotic timber", "robotic construction", "kuka", "milling", "millimetre precision", "millimeter precision"),
    "reuse_delivery": ("olympic village", "student housing", "student accommodation", "students", "dormitory", "dormitories", "reopen to students", "converted", "converting", "conversion", "adaptive reuse", "four-month", "four months", "works programme", "publicly supported student housing"),
    "reuse_housing": ("student housing", "student accommodation", "students", "housing", "accommodation"),
    "reuse_speed": ("four months", "four-month", "reopen", "converted", "converting", "conversion"),
    "robotics_strategy": ("national strategy", "five-year plan", "15th five-year plan", "industrial system", "core of national strategy", "physical applications", "ifr reports", "international federation of robotics"),
    "strategy_robot": ("robot", "robots", "robotics", "ai-powered robots", "physical ai"),
    "robot_governance": ("rulebook", "rulebooks", "rules conflict", "safer decisions", "safe decisions", "transparent decisions", "safety", "governance", "real-world situations", "real world situations"),
    "governed_robot": ("robot", "robots", "robotics", "autonomous robots", "autonomous systems"),
    "governance_world": ("real-world", "real world", "rules conflict", "transparent", "decisions", "safety"),
    "industrial_robotics": (
        "physical ai", "virtual twin", "virtual twins", "robot cell", "robot cells", "scara", "3d vision", "machine vision", "robot programming", "programming platform", "production facility", "production facilities", "factory floor",
        "factories", "drive-by-wire", "driverless", "mining truck", "haul truck", "autonomous haulage", "heavy equipment", "off-road", "mine site", "surface finishing", "data factory", "real-world data", "real world data",
    ),
    "robot_or_autonomy": ("robot", "robots", "robotics", "humanoid", "automation", "autonomous", "driverless"),
    "robot_word": ("robot", "robots", "robotics", "humanoid"),
    "robotic_word": ("robot", "robots", "robotic", "robotics", "automation"),
    "affordability": ("entry-level", "lower-cost", "low-cost", "affordable", "price point", "globally", "global sales", "global availability", "aliexpress", "western peers", "broader market", "entry point", "experimentation"),
    "humanoid": ("humanoid", "humanoid robot", "humanoid robots", "droid"),
    "launch_verb": ("launches", "launched", "unveils", "unveiled", "introduces", "introduced", "releases", "released", "updates", "updated", "rolls out", "rolled out", "debuts", "debuted"),
    "launch_noun": ("product", "platform", "tool", "software", "system", "family", "cobot", "cobots", "robot", "robots", "controller", "assistant"),
    "launch_operation": (
        "robot cell", "robot cells", "scara", "3d vision", "machine vision", "physical robots", "programming platform", "cobot", "cobots", "automated guided vehicles", "agv", "agvs", "autonomous mobile robots", "mobile robot",
        "mobile robots", "factory", "factories", "production", "industrial tasks",
    ),
    "logistics": ("warehouse", "logistics", "intralogistics", "material handling"),
    "strategic_context": ("construction", "industrial", "manufacturing", "factory", "factories", "jobsite", "worksite", "assembly", "production"),
    "ai_core": ("ai", "artificial intelligence", "foundation model", "vision-language-action", "vla model", "physical ai", "physics ai"),
    "ai_company": ("ai", "artificial intelligence", "physical ai", "physics ai", "startup", "startups", "company", "companies", "lab", "labs"),
    "ai_model": ("model", "models", "platform", "platforms", "system", "systems"),
    "ai_word": ("ai", "artificial intelligence"),
    "physical_strong": ("aerospace", "automotive", "advanced manufacturing", "manufacturing", "industrial", "robotics", "robot", "robots", "robotic interactions", "engineering workflows", "engineering software", "factory", "factories", "production", "materials", "industrial automation"),
    "physical_weak_1": ("engineering",),
    "physical_weak_2": ("automation",),
    "physical_weak_3": ("physical world",),
    "physical_weak_4": ("drug discovery",),
    "ai_physical": (
        "engineering", "engineering software", "manufacturing", "manufacturing workflow", "manufacturing workflows", "factory", "factories", "factory floor", "industrial automation", "robotics", "robot", "robots", "physical ai",
        "physics ai", "virtual twin", "virtual twins", "digital twin", "digital twins", "simulation", "industrial software", "robot programming",
    ),
    "major_deal": ("valuation", "valued at", "strategic deal", "strategic merger"),
    "strategic_word": ("strategic",),
    "capability_target": (
        "robot", "robots", "robotics", "humanoid", "autonomous system", "autonomous systems", "physical ai", "physics ai", "industrial automation", "machine vision", "robot programming", "construction robotics",
        "construction automation", "prefab", "prefabrication", "modular", "offsite", "off-site", "contech", "building tech", "housing delivery", "mass timber", "timber",
    ),
    "capability_company": ("startup", "startups", "company", "companies", "platform", "platforms", "technology", "technologies", "software", "systems", "system", "developer", "developers", "capability", "capabilities", "ambitions"),
}
