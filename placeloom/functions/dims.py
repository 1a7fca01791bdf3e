"""Vocabularies, word lists and patterns that results depend on."""

# fixed values: legal forms and corporate filler removed from normalised names
LEGAL_FORMS = (
    "sarl|sas|sasu|eurl|sa|sci|scp|scm|selarl|snc|gie|eirl|earl|scop|scic|asso(?:ciation)?|societe|ste|ets|"
    "etablissements?|entreprise|cie|compagnie|groupe|holding|france|international|gmbh|ltd|llc|inc|bv|nv|spa|srl|plc|ag"
)

# fixed values: trade words that alone do not identify a business
TRADE_WORDS = (
    "creche ecole college lycee boulangerie patisserie boucherie pharmacie restaurant brasserie cafe bar tabac presse "
    "garage hotel salon coiffure agence cabinet centre maison clinique institut bureau magasin boutique atelier banque "
    "immobilier opticien pressing fleuriste librairie supermarche epicerie traiteur primeur poissonnerie fromagerie "
    "caviste auto taxi clinic shop store market school office"
).split()

# fixed values: street type words dropped from the front of a street, and articles dropped anywhere
STREET_TYPES = "rue|avenue|av|boulevard|bd|quai|place|pl|impasse|allee|chemin|route|rte|cours|square|passage"
STREET_ARTICLES = r"\bde\s+la\b|\bdes\b|\bdu\b|\bde\b|\ble\b|\bla\b|\bl\b"

# fixed values: headcount bands in declared order (code, lower bound, label); -1 is unknown
SIZE_BANDS = [
    ("NN", -1, "non déterminé"), ("00", 0, "0 salarié"), ("01", 1, "1 à 2"), ("02", 3, "3 à 5"), ("03", 6, "6 à 9"),
    ("11", 10, "10 à 19"), ("12", 20, "20 à 49"), ("21", 50, "50 à 99"), ("22", 100, "100 à 199"), ("31", 200, "200 à 249"),
    ("32", 250, "250 à 499"), ("41", 500, "500 à 999"), ("42", 1000, "1 000 à 1 999"), ("51", 2000, "2 000 à 4 999"),
    ("52", 5000, "5 000 à 9 999"), ("53", 10000, "10 000 et plus"),
]

# fixed values: NACE sections (letter, first division, last division, label)
NACE_SECTIONS = [
    ("A", 1, 3, "Agriculture, forestry, fishing"), ("B", 5, 9, "Mining and quarrying"), ("C", 10, 33, "Manufacturing"),
    ("D", 35, 35, "Electricity and gas"), ("E", 36, 39, "Water, waste, remediation"), ("F", 41, 43, "Construction"),
    ("G", 45, 47, "Trade and vehicle repair"), ("H", 49, 53, "Transport and storage"), ("I", 55, 56, "Hospitality and food service"),
    ("J", 58, 63, "Information and communication"), ("K", 64, 66, "Finance and insurance"), ("L", 68, 68, "Real estate"),
    ("M", 69, 75, "Professional, scientific, technical"), ("N", 77, 82, "Administrative and support services"),
    ("O", 84, 84, "Public administration"), ("P", 85, 85, "Education"), ("Q", 86, 88, "Health and social work"),
    ("R", 90, 93, "Arts, entertainment, recreation"), ("S", 94, 96, "Other services"), ("T", 97, 98, "Household employers"),
    ("U", 99, 99, "Extraterritorial bodies"),
]

# fixed values: US SIC divisions (letter, first major group, last major group, label)
US_SIC_DIVISIONS = [
    ("A", 1, 9, "Agriculture, forestry, fishing (US SIC)"), ("B", 10, 14, "Mining (US SIC)"), ("C", 15, 17, "Construction (US SIC)"),
    ("D", 20, 39, "Manufacturing (US SIC)"), ("E", 40, 49, "Transport, utilities, communications (US SIC)"),
    ("F", 50, 51, "Wholesale trade (US SIC)"), ("G", 52, 59, "Retail trade (US SIC)"),
    ("H", 60, 67, "Finance, insurance, real estate (US SIC)"), ("I", 70, 89, "Services (US SIC)"),
    ("J", 91, 97, "Public administration (US SIC)"), ("K", 99, 99, "Nonclassifiable (US SIC)"),
]

# fixed values: what a page is for, by its path; the first that matches decides
PAGE_ROLES = [
    ("careers", "careers?|jobs?|emplois?|recrutement|nous-rejoindre|rejoignez|join-us|hiring|carriere|carrières?|karriere|stellen|stellenangebote|jobboerse|empleo|trabaja-con-nosotros|ofertas-de-empleo|lavora-con-noi"),
    ("pricing", "pricing|tarifs?|prix|nos-tarifs|abonnements?|plans?|devis|preise|preisliste|precios|tarifas|prezzi"),
    ("about", "about|about-us|a-propos|à-propos|qui-sommes-nous|notre-histoire|entreprise|company|ueber-uns|über-uns|unternehmen|wir-ueber-uns|sobre-nosotros|quienes-somos|empresa|chi-siamo"),
    ("team", "team|equipe|équipe|notre-equipe|people|staff|collaborateurs|direction|mitarbeiter|ansprechpartner|equipo|nuestro-equipo"),
    ("contact", "contact|contactez-nous|nous-contacter|contact-us|kontakt|kontaktieren|contacto|contatti"),
    ("legal", "mentions-legales|mentions-légales|legal|legal-notice|legal-notices|impressum|imprint|anbieterkennzeichnung|aviso-legal|informacion-legal|note-legali|cgv|cgu|conditions-generales|privacy|confidentialite|datenschutz"),
    ("services", "services?|prestations?|expertises?|solutions?|savoir-faire|metiers?|métiers?"),
    ("products", "products?|produits?|boutique|shop|catalogue|collections?"),
    ("cases", "case-stud(?:y|ies)|references?|réalisations?|realisations|portfolio|clients?|temoignages?|témoignages?"),
    ("news", "news|blog|actualites?|actualités?|articles?|presse|press"),
]

# fixed values: fingerprints of content systems, analytics and shops in HTML
CMS = [
    ("WordPress", r'wp-content|wp-includes|name="generator"[^>]*WordPress'), ("Shopify", r"cdn\.shopify\.com|Shopify\.theme"),
    ("Wix", r"static\.wixstatic\.com|X-Wix-"), ("Squarespace", r"squarespace\.com|static1\.squarespace"),
    ("Webflow", r'assets(?:-global)?\.website-files\.com|generator"[^>]*Webflow'), ("Drupal", r'generator"[^>]*Drupal|sites/all/(?:themes|modules)'),
    ("Joomla", r'generator"[^>]*Joomla'), ("PrestaShop", r"""generator"[^>]*PrestaShop|/themes/[^"']*/assets/js/theme"""),
    ("Magento", r"Magento_|mage/cookies"), ("HubSpot CMS", r"hs-scripts\.com|hubspotusercontent"), ("Framer", r"framerusercontent\.com"),
    ("Odoo", r'generator"[^>]*Odoo|web/static/src'), ("Next.js", r"/_next/static/"), ("Nuxt", r"/_nuxt/"),
]
ANALYTICS = [
    ("Google Analytics", r"googletagmanager\.com/gtag|google-analytics\.com|gtag\('config'"), ("Google Tag Manager", r"googletagmanager\.com/gtm\.js"),
    ("Matomo", r"matomo\.js|piwik\.js"), ("Plausible", r"plausible\.io/js"), ("Fathom", r"cdn\.usefathom\.com"), ("Hotjar", r"static\.hotjar\.com"),
    ("Meta Pixel", r"""connect\.facebook\.net/[^"']*/fbevents\.js"""), ("LinkedIn Insight", r"snap\.licdn\.com"), ("HubSpot", r"js\.hs-scripts\.com"),
    ("Intercom", r"widget\.intercom\.io"), ("Crisp", r"client\.crisp\.chat"), ("Axeptio", r"axeptio\.imgix\.net|axept\.io"),
]
ECOMMERCE = r"add-to-cart|ajouter-au-panier|data-product-id|woocommerce|shopify|prestashop|panier|checkout|stripe\.com/v3|paypal\.com/sdk"

# fixed values: social hosts and the link shapes that are no profile
SOCIAL_LINK = r"""https?://(?:[a-z]{2,3}\.)?(?:www\.)?(?:facebook\.com|instagram\.com|linkedin\.com|twitter\.com|x\.com|youtube\.com|tiktok\.com)/[^\s"'<>)]+"""
NOT_A_PROFILE = r"/(?:sharer|share|intent|embed|watch|shorts|login|signup|home|policies|privacy|legal|about|developers?|plugins?|tr\?id=)\b|[?&](?:u|text|url|status|via)="

# fixed values: job boards by the links they leave, and path words that are no account
BOARDS = [
    ("greenhouse", r"(?:boards|job-boards|boards-api)\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"), ("lever", r"jobs\.(?:eu\.)?lever\.co/([a-z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9_.-]+)"), ("recruitee", r"https?://([a-z0-9-]+)\.recruitee\.com"), ("teamtailor", r"https?://([a-z0-9-]+)\.teamtailor\.com"),
    ("workable", r"apply\.workable\.com/([a-z0-9-]+)"), ("welcometothejungle", r"welcometothejungle\.com/[a-z]{2}/companies/([a-z0-9-]+)"),
    ("personio", r"https?://([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"), ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([a-zA-Z0-9_-]+)"),
    ("softgarden", r"https?://([a-z0-9-]+)\.(?:career\.softgarden\.de|softgarden\.io)"), ("join", r"join\.com/companies/([a-z0-9-]+)"),
]
NOT_AN_ACCOUNT = "embed www api jobs boards app help blog about static assets js css marketplace support career careers portal login".split()

# fixed values: VAT number shapes by country
VAT = [
    ("at", r"ATU\d{8}"), ("be", r"BE0\d{9}"), ("bg", r"BG\d{9,10}"), ("cy", r"CY\d{8}[A-Z]"), ("cz", r"CZ\d{8,10}"), ("de", r"DE\d{9}"),
    ("dk", r"DK\d{8}"), ("ee", r"EE\d{9}"), ("el", r"EL\d{9}"), ("es", r"ES[A-Z0-9]\d{7}[A-Z0-9]"), ("fi", r"FI\d{8}"),
    ("fr", r"FR[0-9A-Z]{2}\d{9}"), ("hr", r"HR\d{11}"), ("hu", r"HU\d{8}"), ("ie", r"IE\d[A-Z0-9+*]\d{5}[A-Z]{1,2}"), ("it", r"IT\d{11}"),
    ("lt", r"LT(?:\d{9}|\d{12})"), ("lu", r"LU\d{8}"), ("lv", r"LV\d{11}"), ("mt", r"MT\d{8}"), ("nl", r"NL\d{9}B\d{2}"), ("pl", r"PL\d{10}"),
    ("pt", r"PT\d{9}"), ("ro", r"RO\d{2,10}"), ("se", r"SE\d{12}"), ("si", r"SI\d{8}"), ("sk", r"SK\d{10}"),
]

# fixed values: score weights
WEIGHTS = {
    "hasSite": 10, "siteWorks": 5, "fresh": 15, "depth": 5, "hiring": 15, "openRoles": 10, "size": 12, "revenue": 8, "registered": 8,
    "contactable": 10, "ecommerce": 4, "pricing": 4, "matchedRoles": 20, "termMatches": 12, "staleRole": 8,
}

# fixed values: score bands of the histogram (label, low, high), in report order
SCORE_BANDS = [("70+", 70, 1000000), ("50-69", 50, 69), ("30-49", 30, 49), ("1-29", 1, 29), ("0", 0, 0)]
