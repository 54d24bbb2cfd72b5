"""Word lists, header names and assumption tables.

They decide results, so they are stated here in full and in their own order.
"""

from __future__ import annotations

# Words that never become terms (English, then funding boilerplate).
TERM_STOPWORDS = tuple(dict.fromkeys("""
a about above after again against all am an and any are as at be because
been before being below between both but by can could did do does doing down during each few
for from further had has have having he her here hers him his how i if in into is it its
itself let more most my no nor not of off on once only or other our ours out over own same
she should so some such than that the their theirs them then there these they this those
through to too under until up very was we were what when where which while who whom why with
would you your yours
european europe eu union commission council parliament regulation directive decision
communication proposal amending final com annex article shall member states state horizon
call topic topics action actions activities project projects proposal proposals programme
work new including well also related relevant based use used using support supporting
ensure ensuring measures framework strategy plan sample
""".split()))

# Geographic levels, Italian and English spellings.
GEO_LEVELS = {
    "nazionale": "National",
    "national": "National",
    "nuts 2": "NUTS 2",
    "nuts2": "NUTS 2",
    "nuts 3": "NUTS 3",
    "nuts3": "NUTS 3",
    "regionale": "Regional",
    "regional": "Regional",
}

# Headers of the paper list. The relevance header names a project
# between the prefix and suffix of RELEVANCE_HEADER.
PAPER_HEADERS = {
    "Titolo articolo": "title",
    "Anno di pubblicazione": "year",
    "Autori": "authors",
    "Journal": "journal",
    "Tipo di pubblicazione (su rivista, proceedings, etc)": "publication_type",
    "DOI": "doi",
    "Abstract": "abstract",
    "Keyword 1": "keyword_1",
    "Keyword 2": "keyword_2",
    "Keyword 3": "keyword_3",
    "Keyword 4": "keyword_4",
    "Keyword 5": "keyword_5",
    "Paese/i UE menzionati": "countries_mentioned",
    "Livello geografico (NUTS2/NUTS3/Nazionale)": "geographic_level",
    "Tipo di attività": "activity_type",
    "Tipo di emissioni (CO2/CH4/N2O/GHG totale)": "emission_type",
    "Metodo usato (es. LCA, GIS, modellizzazione)": "method",
    "Tipo di analisi effettuata (economico, ambientale, sociale, mix)": "analysis_type",
    "Hotspot identificati (descrizione)": "hotspots",
    "Dati utilizzati (fonte e granularità)": "data_sources",
    "Note aggiuntive": "notes",
    "TIPO": "sector_tag",
}
RELEVANCE_HEADER = ("Rilevanza per ", "(Alta/Media/Bassa)")

# Code dimensions of the codebook and its other renamed headers.
CODE_DIMENSIONS = ("CE", "BIO", "BARRIERS", "DRIVERS", "STAKEHOLDERS")
CODEBOOK_HEADERS = {
    "Titolo articolo": "title",
    "BUSINESS MODEL": "business_model",
    "SPECIFIC REGION": "specific_region",
    "SPECIFIC REGION?": "specific_region",
    "TIPO": "sector_tag",
}

# Relevance labels of the two target classes.
RELEVANCE_HIGH = ("alta", "molto alta", "media/alta")
RELEVANCE_LOW = ("media", "bassa")

# Search defaults of the document finder.
DEFAULT_KEYWORDS = (
    "bioeconomy", "circular economy", "biomass", "just transition",
    "carbon farming", "renewable energy", "carbon capture", "soil",
)
GRANT_TYPES = ("1",)
GRANT_STATUSES = ("31094501", "31094502", "31094503")
POLICY_TYPES = ("REG", "DIR", "DEC", "COM")
GRANT_PORTAL = (
    "https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/"
    "opportunities/topic-details/"
)
POLICY_PORTAL = "https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"

# Proxy assumptions.
PROXY_ASSUMPTIONS = {
    "drivers": {
        "time": ["time_s", "time", "t", "Time", "Time (min)"],
        "temperature": ["temperature", "temp", "T", "Temperature", "Temperature (°C)"],
        "stirring": ["stiring", "stirring", "rpm", "RPM", "Stiring", "Stirring"],
    },
    "energy": {
        "method": "weighted_sum",
        "weights": {"time": 0.4, "temperature": 0.4, "stirring": 0.2},
        "normalize": "minmax",
    },
    "metrics": {
        "co2": "0.7*energy + 0.3*y_pred_n",
        "mci": "clip(1 - (0.6*energy + 0.4*y_pred_n), 0, 1)",
    },
}

# Mitigation topics (match terms, score, GtCO2e per year, example tasks).
MITIGATION = (
    {
        "topic": "Solar & wind energy",
        "match_terms": [
            "solar",
            "photovoltaic",
            "wind energy",
            "wind",
            "renewable energy",
            "renewables",
        ],
        "score": 20,
        "gtco2e_yr": [4.0, 11.0],
        "example_tasks": [
            "commission a site solar/wind yield assessment with a grid-connection pre-study",
            "tender a rooftop-PV or wind feasibility study including permitting screening",
            "negotiate a power purchase agreement (PPA) or set up an energy community",
        ],
    },
    {
        "topic": "Bioenergy & biofuels",
        "match_terms": [
            "bioenergy",
            "biofuel",
            "biofuels",
            "biogas",
            "biomass energy",
        ],
        "score": 8,
        "gtco2e_yr": [0.5, 2.0],
        "example_tasks": [
            "inventory available residue and feedstock streams (quantities, seasonality, moisture)",
            "run a pre-feasibility study for a biogas/bioenergy unit including heat off-take mapping",
            "secure feedstock letters of intent with local suppliers",
        ],
    },
    {
        "topic": "Forests & land restoration",
        "match_terms": [
            "forest",
            "forestry",
            "afforestation",
            "reforestation",
            "deforestation",
            "ecosystem restoration",
            "nature-based",
        ],
        "score": 16,
        "gtco2e_yr": [3.0, 7.0],
        "example_tasks": [
            "map degraded parcels and agree restoration targets with land owners",
            "establish a carbon-sink monitoring baseline (field plots + remote sensing)",
            "pursue sustainable forest-management certification (e.g. FSC/PEFC)",
        ],
    },
    {
        "topic": "Agriculture & soil carbon",
        "match_terms": [
            "soil",
            "carbon farming",
            "agriculture",
            "agroecology",
            "agroforestry",
            "nutrient",
            "peatland",
        ],
        "score": 14,
        "gtco2e_yr": [1.8, 4.1],
        "example_tasks": [
            "run a soil-carbon baseline measurement on representative parcels",
            "pilot carbon-farming practices (cover crops, reduced tillage) on selected fields",
            "set up monitoring/reporting (MRV) and register with a carbon-farming certification scheme",
        ],
    },
    {
        "topic": "Circular economy & material efficiency",
        "match_terms": [
            "circular economy",
            "circular",
            "recycling",
            "recyclability",
            "material efficiency",
            "reuse",
            "secondary raw",
        ],
        "score": 10,
        "gtco2e_yr": [0.5, 1.6],
        "example_tasks": [
            "map waste and by-product streams including volumes and gate fees",
            "hold an industrial-symbiosis matchmaking workshop with neighbouring plants",
            "pilot one recycled/secondary-material substitution in production",
        ],
    },
    {
        "topic": "Bio-based products replacing fossil materials",
        "match_terms": [
            "bio-based",
            "biorefinery",
            "bioeconomy",
            "biomass",
            "bioplastic",
        ],
        "score": 8,
        "gtco2e_yr": [0.3, 1.0],
        "example_tasks": [
            "screen your product portfolio for fossil components replaceable by bio-based alternatives",
            "run lab/pilot trials with bio-based material suppliers",
            "commission a life-cycle assessment (LCA) to document the footprint advantage",
        ],
    },
    {
        "topic": "Carbon capture, removal & storage",
        "match_terms": [
            "carbon capture",
            "ccus",
            "ccs",
            "beccs",
            "carbon removal",
            "carbon removals",
            "direct air capture",
            "carbon storage",
        ],
        "score": 8,
        "gtco2e_yr": [0.3, 2.0],
        "example_tasks": [
            "screen on-site CO₂ point sources (volume, concentration, purity)",
            "identify storage or utilisation partners and feasible transport routes",
            "commission a pre-FEED study for a capture pilot",
        ],
    },
    {
        "topic": "Energy & buildings efficiency",
        "match_terms": [
            "energy efficiency",
            "efficient",
            "buildings",
            "renovation",
            "heat pump",
        ],
        "score": 12,
        "gtco2e_yr": [1.5, 4.0],
        "example_tasks": [
            "commission an energy audit (EN 16247) of buildings and processes",
            "implement quick-win measures (heat recovery, insulation, controls)",
            "prepare a renovation investment plan with financing options",
        ],
    },
    {
        "topic": "Low-carbon transport & fuels",
        "match_terms": [
            "transport",
            "mobility",
            "electric vehicle",
            "aviation",
            "shipping",
            "fuel",
        ],
        "score": 10,
        "gtco2e_yr": [1.0, 3.7],
        "example_tasks": [
            "establish a fleet and logistics emissions baseline",
            "pilot electric or low-emission vehicles on selected routes",
            "assess renewable-fuel supply options for heavy transport",
        ],
    },
    {
        "topic": "Waste & methane reduction",
        "match_terms": [
            "waste",
            "bio-waste",
            "landfill",
            "methane",
            "waste water",
        ],
        "score": 6,
        "gtco2e_yr": [0.3, 1.0],
        "example_tasks": [
            "audit waste streams and landfill-diversion options",
            "pilot separate collection and valorisation of biowaste",
            "assess biogas capture from residual organic streams",
        ],
    },
    {
        "topic": "Hydrogen & industrial decarbonisation",
        "match_terms": [
            "hydrogen",
            "electrolyser",
            "steel",
            "cement",
            "industrial decarbonisation",
        ],
        "score": 6,
        "gtco2e_yr": [0.2, 1.0],
        "example_tasks": [
            "assess on-site hydrogen demand and supply options",
            "join or initiate a regional hydrogen-valley partnership",
            "pre-study electrolyser integration with renewable supply",
        ],
    },
    {
        "topic": "Enablers: digitalisation, data & monitoring",
        "match_terms": [
            "digital",
            "data space",
            "monitoring",
            "artificial intelligence",
            "fair data",
        ],
        "score": 2,
        "gtco2e_yr": [0.0, 0.0],
        "example_tasks": [
            "set up FAIR data infrastructure for material and emission tracking",
            "pilot a digital product passport for one product line",
        ],
    },
    {
        "topic": "Enablers: just transition & social innovation",
        "match_terms": [
            "just transition",
            "reskilling",
            "citizen engagement",
            "stakeholder",
            "social innovation",
        ],
        "score": 2,
        "gtco2e_yr": [0.0, 0.0],
        "example_tasks": [
            "map affected stakeholders and set up a co-creation forum",
            "design reskilling paths with regional training providers",
        ],
    },
)

# Cost-saving drivers (match terms, EUR per year).
SAVINGS = (
    {
        "driver": "Avoided EU ETS / CBAM carbon costs",
        "match_terms": [
            "emissions trading",
            "ets",
            "carbon price",
            "carbon border",
            "cbam",
            "carbon capture",
            "decarbonisation",
        ],
        "save_eur_yr": [500000, 10000000],
    },
    {
        "driver": "Avoided non-compliance fines & enforcement penalties",
        "match_terms": [
            "waste water",
            "packaging",
            "ecodesign",
            "pollution",
            "emission",
            "reporting",
            "monitoring",
            "compliance",
            "directive",
        ],
        "save_eur_yr": [10000, 1000000],
    },
    {
        "driver": "Energy cost savings (efficiency & own renewables)",
        "match_terms": [
            "energy efficiency",
            "renewable energy",
            "solar",
            "wind",
            "heat pump",
            "renovation",
            "bioenergy",
            "biogas",
        ],
        "save_eur_yr": [100000, 5000000],
    },
    {
        "driver": "Material & waste-disposal savings from circularity",
        "match_terms": [
            "circular economy",
            "recycling",
            "reuse",
            "secondary raw",
            "material efficiency",
            "waste",
            "industrial symbiosis",
            "valorisation",
        ],
        "save_eur_yr": [50000, 2000000],
    },
    {
        "driver": "Avoided agricultural input costs",
        "match_terms": [
            "nutrient",
            "fertiliser",
            "fertilizer",
            "soil",
            "carbon farming",
            "agroecology",
        ],
        "save_eur_yr": [20000, 500000],
    },
    {
        "driver": "Carbon-credit & certification revenue",
        "match_terms": [
            "carbon removal",
            "carbon removals",
            "carbon storage",
            "certification",
            "carbon farming",
        ],
        "save_eur_yr": [50000, 2000000],
    },
)
