"""Fixed values that results depend on; where several modules need one, it stands here once."""

# freshness in days, by kind of evidence
FRESH_DAYS = {"crawl": 7, "performance": 14, "technology": 30, "contacts": 30}

# crawl frontier
MAX_PAGES = 15
PRIORITY_PATHS = ("/", "/contact", "/contact-us", "/about", "/about-us", "/services", "/locations", "/pricing")

# weights of the website health dimensions
HEALTH_WEIGHTS = {
    "performance": 0.18, "mobileUx": 0.15, "seo": 0.15, "security": 0.12,
    "accessibility": 0.10, "technical": 0.10, "designUx": 0.10, "conversion": 0.10,
}

PRIMARY_FLOOR = 0.7
MATCH_THRESHOLD = 0.82
DEFAULT_COUNTRY = "91"
RETRY_MS = (5_000, 30_000)
LEASE_SECONDS = 300

LEGAL_WORDS = ("pvt", "ltd", "llc", "inc", "co", "company", "private", "limited")
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".css", ".js")

AGGREGATOR_HOSTS = (
    "zomato.com", "swiggy.com", "magicpin.in", "dineout.co.in", "eazydiner.com", "tablecheck.com", "opentable.com",
    "resy.com", "yelp.com", "tripadvisor.com", "tripadvisor.in", "justdial.com", "sulekha.com", "indiamart.com",
    "practo.com", "urbancompany.com", "urbanclap.com", "zocdoc.com", "makemytrip.com", "goibibo.com", "booking.com",
    "agoda.com", "airbnb.com", "trivago.in", "doordash.com", "ubereats.com", "grubhub.com", "foursquare.com",
    "petpooja.in", "dotpe.in", "mydukaan.io", "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com",
    "linkedin.com", "youtube.com", "whatsapp.com", "wa.me", "wa.link", "t.me", "linktr.ee", "bit.ly",
)
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.google.com", "metadata")

# technology fingerprints: name, category, pattern (case does not matter), confidence
FINGERPRINTS = (
    ("WordPress", "cms", r"wp-content|wp-includes", 0.9),
    ("Shopify", "cms", r"cdn\.shopify\.com|Shopify\.theme", 0.9),
    ("Wix", "cms", r"static\.wixstatic\.com|wix\.com", 0.9),
    ("Webflow", "cms", r"webflow", 0.85),
    ("Squarespace", "cms", r"squarespace\.com|static\.squarespace", 0.9),
    ("Drupal", "cms", r"drupal\.settings|sites/default/files", 0.85),
    ("Next.js", "framework", r"__NEXT_DATA__|_next/static", 0.9),
    ("Nuxt", "framework", r"__NUXT__|_nuxt/", 0.9),
    ("React", "framework", r"react(?:-dom)?(?:\.production|\.min)?\.js|data-reactroot", 0.7),
    ("Angular", "framework", r"ng-version|angular(?:\.min)?\.js", 0.8),
    ("Vue", "framework", r"vue(?:\.runtime)?(?:\.min)?\.js|data-v-", 0.7),
    ("jQuery", "library", r"jquery(?:\.min)?\.js", 0.85),
    ("Bootstrap", "library", r"bootstrap(?:\.min)?\.(?:js|css)", 0.85),
    ("Tailwind CSS", "library", r"tailwindcss|cdn\.tailwindcss", 0.75),
    ("Cloudflare", "cdn", r"cdnjs\.cloudflare|cloudflare\.com/cdn|cf-ray", 0.8),
    ("Fastly", "cdn", r"fastly\.net|fastly-insights", 0.8),
    ("Google Analytics", "analytics", r"google-analytics\.com|gtag/js|googletagmanager\.com/gtag", 0.9),
    ("Google Tag Manager", "tag-manager", r"googletagmanager\.com/gtm\.js", 0.95),
    ("Meta Pixel", "analytics", r"connect\.facebook\.net/.+/fbevents\.js|fbq\(", 0.9),
    ("Microsoft Clarity", "analytics", r"clarity\.ms|clarity\(", 0.9),
    ("Hotjar", "analytics", r"static\.hotjar\.com|hj\(", 0.9),
    ("HubSpot", "marketing", r"js\.hs-scripts\.com|hubspot", 0.85),
    ("LinkedIn Insight", "analytics", r"snap\.licdn\.com|linkedin\.com/px|_linkedin_partner_id", 0.9),
    ("TikTok Pixel", "analytics", r"analytics\.tiktok\.com|ttq\.load", 0.9),
)
MARKETING = {
    "analytics": "Google Analytics", "gtm": "Google Tag Manager", "metaPixel": "Meta Pixel", "clarity": "Microsoft Clarity",
    "hotjar": "Hotjar", "hubspot": "HubSpot", "linkedinInsight": "LinkedIn Insight", "tiktokPixel": "TikTok Pixel",
}

# Latin letters with accents and what they fold to, position by position
ACCENTED = "àáâãäåāăąçćčďèéêëēĕęěğìíîïīĭįñńňòóôõöōŏőŕřśşšţťùúûüūŭůűųýÿžźż"
FOLDED = "aaaaaaaaacccdeeeeeeeegiiiiiiinnnoooooooorrsssttuuuuuuuuuyyzzz"

# patterns shared by both dialects
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
EMAIL_IN_TEXT = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE_IN_TEXT = r"\+?[0-9][0-9\s().-]{7,}[0-9]"
NOISE_LOCAL = r"(?i)^([0-9a-f]{16,}|you|your|youremail|someone|user|username|name|email|test|example)$"
NOISE_DOMAIN = r"(?i)((^|\.)sentry[.-]|(^|\.)wixpress\.com$|(^|\.)(sentry\.io|localhost|invalid)$)"
BUSINESS_WORDS = r"info|sales|contact|hello|admin|support"
CONTACT_PATH = r"contact|about|location"
SHELL_MARKS = r"""(?i)id=["']root["']|id=["']app["']|__NEXT_DATA__|ng-version|data-reactroot"""
SCRIPT_MARKS = r"(?i)Please enable JavaScript|noscript|webpackJsonp|window\.__INITIAL_STATE__"
