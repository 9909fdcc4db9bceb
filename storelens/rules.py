"""Rule dictionaries used by the operators.

Everything here is data: ordered tuples that the operators turn into CASE
chains or array literals.  Every operator takes its dictionary as a parameter,
so a user extends a rule by passing another tuple, not by writing a UDF.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Word lists, patterns and limits that decide results.
# --------------------------------------------------------------------------

# Text markers of a hosted store page (strict) and of a candidate page (loose).
PLATFORM_URL_MARK = "myshopify.com"
PLATFORM_MARKS = (
    "Shopify.theme",
    "shopify.com",
    "cdn.shopify.com",
    "Shopify.shop",
    "shopify-features",
    "shopify-section",
    "myshopify.com",
)
PLATFORM_MARKS_LOOSE = (
    "shopify",
    "cdn.shopify.com",
    "myshopify.com",
    "shopify-analytics",
    "shopify_stats",
    "shop_id",
    "shopify.theme",
    "shopifycdn.com",
)
PLATFORM_HEADERS = ("x-shopify-stage", "x-shopid")

# Social platforms: (slot, domains).  First matching platform takes the link.
SOCIAL_RULES = (
    ("instagram", ("instagram.com",)),
    ("facebook", ("facebook.com",)),
    ("twitter", ("twitter.com", "x.com")),
    ("tiktok", ("tiktok.com",)),
    ("youtube", ("youtube.com",)),
    ("linkedin", ("linkedin.com",)),
    ("pinterest", ("pinterest.com",)),
)

# Important links: (slot, substrings of href or link text).
IMPORTANT_LINK_RULES = (
    ("order_tracking", ("track", "tracking", "order-status", "track-order")),
    ("contact_us", ("contact", "contact-us", "get-in-touch")),
    ("blogs", ("blog", "blogs", "news", "articles")),
    ("about_us", ("about", "about-us", "our-story")),
    ("shipping_info", ("shipping", "delivery", "shipping-info")),
    ("size_guide", ("size", "size-guide", "sizing", "fit-guide")),
    ("careers", ("career", "careers", "jobs", "join-us")),
)

# Policy links: (group, default title, substrings).  A link may fall into several groups.
POLICY_LINK_RULES = (
    ("privacy", "Privacy Policy", ("privacy", "privacy-policy", "privacy_policy")),
    (
        "terms",
        "Terms of Service",
        (
            "terms",
            "terms-of-service",
            "terms_of_service",
            "terms-and-conditions",
            "terms_and_conditions",
            "tos",
            "legal",
            "conditions",
        ),
    ),
    ("cookie", "Cookie Policy", ("cookie", "cookies", "cookie-policy", "cookie_policy")),
    (
        "data_protection",
        "Data Protection Policy",
        ("data-protection", "data_protection", "gdpr", "ccpa", "data-privacy", "data_privacy"),
    ),
    (
        "refund",
        "Refund Policy",
        (
            "refund",
            "refunds",
            "return",
            "returns",
            "refund-policy",
            "refund_policy",
            "return-policy",
            "return_policy",
            "exchange",
            "exchanges",
        ),
    ),
    (
        "shipping",
        "Shipping Policy",
        (
            "shipping",
            "delivery",
            "shipping-policy",
            "shipping_policy",
            "delivery-policy",
            "delivery_policy",
            "fulfillment",
        ),
    ),
)
POLICY_LINK_CONTENT = "Policy content available at the linked URL"

# Older policy dictionary: (slot, title, substrings), first match takes the link.
POLICY_LINK_RULES_LEGACY = (
    ("privacy_policy", "Privacy Policy", ("privacy", "privacy-policy")),
    ("return_policy", "Return Policy", ("return", "returns", "return-policy")),
    ("refund_policy", "Refund Policy", ("refund", "refunds", "refund-policy")),
    ("terms_of_service", "Terms of Service", ("terms", "tos", "terms-of-service", "terms-conditions")),
)

# Headings that introduce policy text on the page itself: (group, title, keywords).
POLICY_HEADING_RULES = (
    ("privacy", "Privacy Policy", ("privacy", "data protection")),
    ("terms", "Terms of Service", ("terms", "conditions", "agreement")),
)

# Policy class from url and title, and from title and content.
POLICY_TYPE_RULES = (
    ("privacy", ("privacy", "data protection", "gdpr")),
    ("terms", ("terms", "conditions", "agreement")),
    ("cookie", ("cookie", "cookies")),
    ("refund", ("refund", "return", "exchange")),
    ("shipping", ("shipping", "delivery", "fulfillment")),
)
POLICY_TYPE_CONTENT_RULES = (
    ("privacy", ("privacy", "personal data", "gdpr", "data protection")),
    ("terms", ("terms of service", "terms and conditions", "user agreement")),
    ("cookie", ("cookie", "cookies", "tracking")),
    ("refund", ("refund", "return", "exchange", "money back")),
    ("shipping", ("shipping", "delivery", "fulfillment")),
)

# Store record slot of a policy, by its title.
POLICY_SLOT_RULES = (
    ("privacy_policy", ("privacy",)),
    ("return_policy", ("return",)),
    ("refund_policy", ("refund",)),
    ("terms_of_service", ("terms", "conditions")),
)

# Classes of the blocks that hold the text of a policy page, and of its title.
POLICY_TITLE_SELECTORS = ("h1", ".page-title", ".policy-title", ".legal-title", "title")
POLICY_CONTENT_SELECTORS = (
    ".policy-content",
    ".legal-content",
    ".page-content",
    ".main-content",
    ".content",
    "main",
    ".rte",
)
POLICY_DATE_PATTERNS = (
    r"last updated:?\s*([\d/\-\.]+)",
    r"updated:?\s*([\d/\-\.]+)",
    r"effective:?\s*([\d/\-\.]+)",
    r"revised:?\s*([\d/\-\.]+)",
)

# Payment indicators: (substring, name).
PAYMENT_RULES = (
    ("visa", "Visa"),
    ("mastercard", "Mastercard"),
    ("amex", "American Express"),
    ("paypal", "PayPal"),
    ("stripe", "Stripe"),
    ("apple pay", "Apple Pay"),
    ("google pay", "Google Pay"),
    ("shopify pay", "Shopify Pay"),
    ("klarna", "Klarna"),
    ("afterpay", "Afterpay"),
    ("cod", "Cash on Delivery"),
    ("cash on delivery", "Cash on Delivery"),
)
PAYMENT_ICON_PATTERN = r"(?i)(visa|mastercard|paypal|stripe|payment)"

# Brand name: title suffixes to drop, and where a logo is looked for.
TITLE_SUFFIX_PATTERN = r"(?i)\s*[-–|]\s*(Shop|Store|Online|Official).*$"
LOGO_ALT_SELECTORS = ('img[alt*="logo"]', ".logo img", ".brand img", ".site-logo img")
LOGO_SELECTORS = (".logo img", ".site-logo img", ".brand img", 'img[alt*="logo" i]', ".header img")

# FAQ rules.
FAQ_PATHS = (
    "/pages/faq",
    "/pages/frequently-asked-questions",
    "/pages/help",
    "/pages/support",
    "/pages/customer-service",
    "/faq",
    "/help",
    "/support",
)
FAQ_CATEGORY_RULES = (
    ("Shipping & Orders", ("ship", "deliver", "order", "track")),
    ("Returns & Refunds", ("return", "refund", "exchange", "warranty")),
    ("Payment & Billing", ("payment", "billing", "credit", "paypal", "price")),
    ("Account & Profile", ("account", "login", "password", "profile")),
    ("Product Information", ("product", "size", "ingredient", "material", "specification")),
    ("Subscription", ("subscription", "recurring", "auto", "membership")),
    ("Customer Support", ("contact", "support", "help", "phone", "email")),
)
FAQ_DEFAULT_CATEGORY = "General"
FAQ_HEADER_PATTERNS = (
    r"^(general|shipping|payment|product|account|subscription|support).*info.*$",
    r"^(faq|faqs)$",
    r"^.*information$",
    r"^additional.*$",
    r"^.*program.*faq.*$",
)
FAQ_CONTAINER_WORDS = ("faq", "question", "help")
FAQ_ACCORDION_WORDS = ("accordion", "toggle", "collaps", "expand")
FAQ_ANSWER_WORDS = ("content", "answer", "body")
FAQ_LEGACY_SELECTORS = (".faq", ".faq-item", ".accordion", ".accordion-item", ".question", '[class*="faq"]')
FAQ_LEGACY_QUESTION = (".question", ".faq-question", "h3", "h4", ".accordion-header", '[class*="question"]')
FAQ_LEGACY_ANSWER = (".answer", ".faq-answer", ".accordion-body", ".accordion-content", '[class*="answer"]')

# Contact address blocks.
ADDRESS_SELECTORS = (".address", ".contact-address", '[class*="address"]')

# Product cards: where a field is looked for, in order.
CARD_NAME_SELECTORS = (
    ".product-title",
    ".product-name",
    "h2",
    "h3",
    "h4",
    ".title",
    "[data-product-title]",
    'a[href*="/products/"]',
)
HERO_NAME_SELECTORS = (
    ".product-title",
    ".product-name",
    "h1",
    "h2",
    "h3",
    "h4",
    ".title",
    "[data-product-title]",
    'a[href*="/products/"]',
)
CARD_PRICE_SELECTORS = (".price", ".product-price", ".money", "[data-price]", ".price-current", ".sale-price")
CARD_ORIGINAL_PRICE_SELECTORS = (".price-compare", ".original-price", ".was-price", ".compare-price", ".price-old")
CARD_AVAILABILITY_SELECTORS = (".availability", ".stock-status", "[data-availability]")
CARD_DESCRIPTION_SELECTORS = (".product-description", ".product-summary", ".description", "p")
CARD_TAG_SELECTORS = (".product-tags .tag", ".tags .tag", ".categories .category")
LEGACY_NAME_SELECTORS = (
    ".product-title",
    ".product-name",
    "h3",
    "h2",
    "[data-product-title]",
    ".grid-product__title",
)
LEGACY_PRICE_SELECTORS = (".price", ".product-price", ".money", "[data-price]", ".price-item--regular")
LEGACY_ORIGINAL_PRICE_SELECTORS = (".price--compare", ".was-price", ".compare-at-price", ".price-item--sale")
LEGACY_CARD_SELECTORS = (
    ".product-item",
    ".product-card",
    ".grid-product",
    ".product-block",
    "[data-product-id]",
    ".shopify-product-gallery",
    ".product",
)
LEGACY_UNAVAILABLE_PATTERN = r"(?i)(sold out|out of stock|unavailable)"

# Product branches of a page, in order of preference after structured data.
GRID_SELECTORS = (
    ".product-grid .product-item",
    ".products-grid .product",
    ".collection-grid .product-card",
    ".product-list .product-item",
    "[data-product-item]",
    ".product-card",
    ".product-tile",
)
SECTION_ITEM_SELECTORS = (".product-item", ".product-card", ".product", "[data-product]")
COLLECTION_SELECTORS = (
    ".collection .product",
    ".collection-products .product-item",
    ".products .product-card",
    "#CollectionProductGrid .product",
)
SINGLE_PRODUCT_SELECTORS = (".product", ".product-single", ".product-details", "#product", "[data-product-single]")

# Featured products: tags, and page sections by kind.
HOMEPAGE_TAG = "homepage"
HERO_TAGS = (
    "homepage", "hero", "featured", "main", "highlight", "spotlight",
    "bestseller", "best seller", "best-seller", "top seller", "top-seller",
    "trending", "popular", "most popular", "staff pick", "staff-pick",
    "editor choice", "editor-choice", "recommended", "must have", "must-have",
    "signature", "flagship", "star product", "star-product",
    "front page", "front-page", "home", "banner", "promo", "promotional",
)
HERO_BOOSTS = (
    (("homepage",), 50),
    (("hero",), 30),
    (("featured",), 20),
    (("bestseller", "best seller", "best-seller"), 15),
)
HERO_SECTION_RULES = (
    (
        "hero",
        (
            ".hero",
            ".hero-section",
            ".banner-hero",
            ".main-hero",
            ".homepage-hero",
            '[data-section-type="hero"]',
            ".slideshow",
            ".hero-banner",
        ),
    ),
    (
        "featured",
        (
            ".featured-products",
            ".featured-collection",
            ".homepage-featured",
            '[data-section-type="featured-products"]',
            '[data-section-type="featured-collection"]',
            ".featured",
            ".best-sellers",
            ".trending-products",
        ),
    ),
    (
        "banner",
        (
            ".banner",
            ".promo-banner",
            ".product-banner",
            ".promotional-banner",
            ".homepage-banner",
            ".collection-banner",
        ),
    ),
    (
        "carousel",
        (
            ".carousel",
            ".slider",
            ".slideshow",
            ".product-slider",
            ".featured-slider",
            "[data-slick]",
            "[data-carousel]",
            ".swiper-container",
        ),
    ),
    (
        "collection",
        (
            ".homepage-collections",
            ".collection-list",
            ".featured-collections",
            ".collection-grid",
            ".collections-showcase",
        ),
    ),
)
HERO_ITEM_SELECTORS = (".product", ".product-item", ".product-card", "[data-product]")
FEATURED_ITEM_SELECTORS = (".product-item", ".product-card", ".product", "[data-product]", ".featured-product")

# Pages that list products, in order of preference.
COLLECTION_PATHS = ("/collections/all", "/collections", "/products")

# Competitor rules: brand category, excluded hosts, known stores by category.
BRAND_CATEGORY_RULES = (
    ("fashion", ("fashion", "clothing", "apparel", "style", "wear", "dress", "shirt")),
    ("beauty", ("beauty", "cosmetics", "skincare", "makeup", "fragrance", "perfume")),
    ("fitness", ("fitness", "gym", "workout", "supplement", "protein", "nutrition")),
    ("gaming", ("gaming", "gamer", "esports", "energy drink", "gfuel")),
    ("electronics", ("electronics", "tech", "gadget", "device", "smartphone")),
    ("home", ("home", "furniture", "decor", "kitchen", "living")),
    ("jewelry", ("jewelry", "watch", "ring", "necklace", "bracelet")),
    ("sports", ("sports", "athletic", "outdoor", "running", "basketball")),
    ("food", ("food", "snack", "drink", "beverage", "organic")),
    ("pet", ("pet", "dog", "cat", "animal", "puppy")),
)
BRAND_DEFAULT_CATEGORY = "ecommerce"
EXCLUDED_HOSTS = (
    "google.com", "facebook.com", "instagram.com", "twitter.com",
    "youtube.com", "wikipedia.org", "amazon.com", "ebay.com",
    "linkedin.com", "reddit.com", "pinterest.com",
)
STORE_DIRECTORY = (
    ("gaming", "Razer", "https://www.razer.com"),
    ("gaming", "SteelSeries", "https://steelseries.com"),
    ("gaming", "HyperX", "https://www.hyperxgaming.com"),
    ("gaming", "Corsair", "https://www.corsair.com"),
    ("fashion", "Allbirds", "https://www.allbirds.com"),
    ("fashion", "Everlane", "https://www.everlane.com"),
    ("fashion", "Bombas", "https://bombas.com"),
    ("fashion", "Outdoor Voices", "https://outdoorvoices.com"),
    ("beauty", "Glossier", "https://www.glossier.com"),
    ("beauty", "ColourPop", "https://colourpop.com"),
    ("beauty", "Fenty Beauty", "https://fentybeauty.com"),
    ("beauty", "Kylie Cosmetics", "https://kyliecosmetics.com"),
    ("fitness", "Gymshark", "https://www.gymshark.com"),
    ("fitness", "Lululemon", "https://shop.lululemon.com"),
    ("fitness", "Alo Yoga", "https://www.aloyoga.com"),
    ("fitness", "Athletic Greens", "https://athleticgreens.com"),
    ("default", "Allbirds", "https://www.allbirds.com"),
    ("default", "ColourPop", "https://colourpop.com"),
    ("default", "Gymshark", "https://www.gymshark.com"),
    ("default", "Bombas", "https://bombas.com"),
)
DIRECTORY_DEFAULT = "default"

# Saved search-result pages: (engine, link class or None for any link, first n links, host to skip).
SEARCH_ENGINE_RULES = (
    ("duckduckgo", "result__a", 15, None),
    ("bing", None, 20, "bing.com"),
    ("startpage", "w-gl__result-title", 15, None),
)

# Text patterns.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERNS = (
    r"\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
    r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}",
    r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\+\d{10,15}",
)
PRICE_PATTERNS = (
    r"[\$₹€£¥][\d,]+\.?\d*",
    r"[\d,]+\.?\d*\s*[\$₹€£¥]",
    r"Rs\.?\s*[\d,]+\.?\d*",
    r"USD\s*[\d,]+\.?\d*",
)

# Limits.
CATALOG_LIMIT = 100
MAIN_PAGE_PRODUCT_LIMIT = 50
PRODUCT_PAGE_PRODUCT_LIMIT = 10
PRODUCT_PAGE_LIMIT = 20
PRODUCT_URL_LIMIT = 100
COMPETITOR_LIMIT = 10
CANDIDATE_QUOTA = 20
HOMEPAGE_HERO_LIMIT = 10
HERO_LIMIT = 6
TOP_VALUES = 5
EMBEDDED_PARTS_LIMIT = 11
