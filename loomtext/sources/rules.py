"""Rule tables. Every operator takes its rules as a parameter; these are the defaults.

The values below are fixed values: results must agree with what they select, so they are stated as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: markup -------------------------------------------------------------------------------------------
NOISE_TAGS = ("script", "style", "noscript", "iframe", "nav", "header", "footer", "aside")
NOISE_MARKS = ("cookie", "breadcrumb", "sidebar", "social", "share", "print", "skip", "banner", "popup", "modal", "overlay", "advertisement", "advert")
CONTENT_SELECTORS = {
    "hdb": ("main#main-content", "div.hdb-content", "main", "article"),
    "ura": ("div.mainWrap", "div.fullbody-wrapper", "div.text-cms-col", "main", "article"),
    "iras": ("div.sfContentBlock", "article.content", "main", "article"),
    "mas": ("div.mas-content", "div#content", "main", "article"),
    "cpf": ("div#cpf-content", "main", "article"),
}
GENERIC_SELECTORS = ("main", "article", "div[role=main]")
CRAWL_NOISE_TAGS = ("nav", "footer", "header", "script", "style", "noscript", "iframe")
CRAWL_NOISE_CLASSES = ("nav", "footer", "sidebar", "cookie", "banner", "menu")
CRAWL_NOISE_IDS = ("nav", "footer", "sidebar")

# --- fixed values: metadata -----------------------------------------------------------------------------------------
AGENCIES = {"hdb": "HDB", "ura": "URA", "iras": "IRAS", "mas": "MAS", "cpf": "CPF"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_RULES = (
    (r"with\s+effect\s+from\s+(\d{1,2})\s+(\w+)\s+(\d{4})", "dmy"),
    (r"effective\s+(?:from\s+)?(\d{1,2})\s+(\w+)\s+(\d{4})", "dmy"),
    (r"as\s+(?:at|of|from)\s+(\d{1,2})\s+(\w+)\s+(\d{4})", "dmy"),
    (r"last\s+updated[:\s]+(\d{1,2})\s+(\w+)\s+(\d{4})", "dmy"),
    (rf"(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})", "dmy"),
    (r"(\d{4})-(\d{2})-(\d{2})", "iso"),
)
# A rule is a label and alternatives; each is matched as whole words unless it ends in an asterisk.
PROPERTY_RULES = (
    ("HDB", ("hdb",)),
    ("EC", (r"executive\s+condominium", "EC")),
    ("private", (r"private\s+(?:residential|property)", "non-landed", r"landed\s+residential", "condominium", "condo")),
    ("commercial", (r"commercial\s+property", "industrial")),
)
CITIZENSHIP_RULES = (
    ("SC", (r"singapore\s+citizen", "SC")),
    ("PR", (r"singapore\s+(?:permanent\s+resident|PR)", r"permanent\s+resident")),
    ("foreigner", ("foreigner", r"non[-\s]?resident", r"non[-\s]?citizen")),
)
TOPIC_RULES = (
    ("stamp_duty", (r"stamp\s+duty", "ABSD", "BSD", r"additional\s+buyer.s\s+stamp\s+duty", r"buyer.s\s+stamp\s+duty")),
    ("SSD", ("SSD", r"seller.s\s+stamp\s+duty")),
    ("LTV", ("LTV", r"loan[-\s]to[-\s]value")),
    ("TDSR", ("TDSR", r"total\s+debt\s+servicing\s+ratio")),
    ("MSR", ("MSR", r"mortgage\s+servicing\s+ratio")),
    ("CPF", ("CPF", r"central\s+provident\s+fund")),
    ("housing_grant", (r"hdb\s+grant", r"housing\s+grant", "EHG", "PHG", r"family\s+grant", r"proximity\s+housing\s+grant")),
    ("eligibility", ("eligibilit*",)),
    ("first_time_buyer", (r"first[-\s]time",)),
    ("cooling_measure", (r"cooling\s+measure*",)),
    ("property_tax", (r"property\s+tax",)),
    ("rental", ("rent", "rental")),
)

# --- fixed values: links --------------------------------------------------------------------------------------------
ASSET_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".css", ".js", ".ico")


@dataclass(frozen=True)
class FollowRule:
    """Which links of a source to follow: none with a skip part; those with a section, or a PDF where these count."""

    skip: tuple[str, ...]
    sections: tuple[str, ...]
    prefix: bool  # sections begin the path, otherwise they occur in it
    fold_path: bool  # the path is lower-cased before sections are looked for
    pdf: bool


FOLLOW_RULES = {
    "hdb": FollowRule(
        ("/feedback", "/contact-us", "/sitemap", "/search", "/login", "/e-services", "/about-us", "/careers", "/news", "/community", "/car-parks", "/business"),
        ("/residential/buying-a-flat", "/residential/selling-a-flat", "/residential/living-in-an-hdb-flat", "/residential/renting-a-flat", "/residential/financing-a-flat-purchase", "/cs/infoweb/residential"),
        True, True, False,
    ),
    "ura": FollowRule(
        ("/feedback", "/contact-us", "/sitemap", "/search", "/login", "/careers", "/maps", "/e-services", "/SPACE", "/Corporate/Data"),
        ("/Corporate/Property", "/Corporate/Guidelines", "/Corporate/Media-Room/Forum-Replies"),
        True, False, True,
    ),
    "iras": FollowRule(
        ("/feedback", "/contact-us", "/sitemap", "/search", "/login", "/e-services", "/careers", "/news-events", "/about-us", "/irashome"),
        ("/taxes/stamp-duty", "/taxes/property-tax", "/taxes/stamp-duty-for-property", "/quick-links/buyers-sellers"),
        False, True, True,
    ),
    "mas": FollowRule(
        ("/feedback", "/contact-us", "/sitemap", "/search", "/login", "/careers", "/about", "/statistics", "/bonds", "/fintech", "/insurance", "/payments", "/capital-markets"),
        ("/regulation", "/news", "/monetary-policy"),
        False, True, True,
    ),
    "cpf": FollowRule(
        ("/feedback", "/contact-us", "/sitemap", "/search", "/login", "/e-services", "/careers", "/about-us", "/newsroom", "/member/healthcare", "/member/retirement", "/employer", "/member/account-services"),
        ("/member/home-ownership", "/member/growing-your-savings", "/member/tools-and-services"),
        False, True, True,
    ),
}
RELEVANCE_KEYWORDS = ("property", "mortgage", "loan-to-value", "ltv", "tdsr", "total debt servicing", "housing loan", "residential property", "real estate")
HOME_KEYWORDS = ("home ownership", "housing", "property", "ordinary account", "withdrawal", "accrued interest", "valuation limit", "cpf housing", "hdb flat", "private property", "executive condominium")

# --- fixed values: chunks -------------------------------------------------------------------------------------------
CHUNK_TOKENS, CHUNK_OVERLAP = 512, 64
LEAST_TOKENS, MOST_TOKENS = 50, 600
BOILERPLATE = (
    r"^(skip to (main )?content|jump to navigation)$",
    r"^(home\s*[>»|/]\s*){1,}",
    r"^(menu|nav(igation)?|sidebar|footer|header|cookie policy|privacy policy)$",
    r"^\s*©\s*\d{4}",
    r"^(last (updated|modified|reviewed):?\s*[\d/\-]+)$",
    r"^(share (this )?page|print this page|back to top|[↑▲]\s*top)$",
    r"^(subscribe|sign up|log in|register|contact us)$",
    r"^[\s\|\-•·,;:]+$",
    r"^\d+\s*$",
)
REQUIRED_METADATA = ("chunk_index", "chunk_type", "source_agency")
SCANNED_WORDS = 20
EMBED_TOKENS, EMBED_ITEMS = 250_000, 2048
DIMENSION = 3072
