"""Built-in selector sets: rows of (site, field, selector) in fallback order."""

from __future__ import annotations

from pagequarry.operators.extract import Rule

# Selectors of the four built-in sites.
BUILT_IN = (
    ("amazon", "product_container", 'div[data-component-type="s-search-result"]'),
    ("amazon", "name", "h2.a-size-medium span"),
    ("amazon", "name", "h2.a-size-medium"),
    ("amazon", "name", "span.a-size-medium"),
    ("amazon", "current_price", "span.a-price-whole"),
    ("amazon", "current_price", ".a-price .a-price-whole"),
    ("amazon", "current_price", 'span.a-price[data-a-size="xl"]'),
    ("amazon", "original_price", "span.a-price.a-text-price"),
    ("amazon", "original_price", "span.a-text-price"),
    ("amazon", "rating", "span.a-size-small.a-color-base"),
    ("amazon", "rating", ".a-icon-alt"),
    ("amazon", "reviews", "span.a-size-mini"),
    ("amazon", "reviews", 'a[href*="customerReviews"] span'),
    ("amazon", "discount", 'span:contains("% off")'),
    ("amazon", "discount", 'span:contains("off")'),
    ("amazon", "offers", "span.s-coupon-unclipped"),
    ("amazon", "offers", 'span.a-color-base:contains("coupon")'),
    ("amazon", "offers", 'span:contains("back with")'),
    ("flipkart", "product_container", 'div[class*="_4WELSP"]'),
    ("flipkart", "name", 'a[class*="wjcEIp"]'),
    ("flipkart", "name", "a[title]"),
    ("flipkart", "name", "img[alt]"),
    ("flipkart", "name", 'a[href*="/p/"]'),
    ("flipkart", "current_price", 'div[class*="Nx9bqj"]'),
    ("flipkart", "current_price", 'div[class*="hl05eU"] div[class*="Nx9bqj"]'),
    ("flipkart", "current_price", 'div:contains("₹")'),
    ("flipkart", "current_price", 'span:contains("₹")'),
    ("flipkart", "original_price", 'div[class*="yRaY8j"]'),
    ("flipkart", "original_price", 'div[class*="hl05eU"] div[class*="yRaY8j"]'),
    ("flipkart", "original_price", 'span[class*="strike"]'),
    ("flipkart", "original_price", "del"),
    ("flipkart", "rating", 'div[class*="XQDdHH"]'),
    ("flipkart", "rating", 'span[class*="Y1HWO0"] div[class*="XQDdHH"]'),
    ("flipkart", "rating", 'div[class*="_5OesEi"] span[class*="Y1HWO0"] div[class*="XQDdHH"]'),
    ("flipkart", "rating", 'div[class*="star"]'),
    ("flipkart", "rating", 'span[class*="rating"]'),
    ("flipkart", "reviews", 'span[class*="Wphh3N"]'),
    ("flipkart", "reviews", 'div[class*="_5OesEi"] span[class*="Wphh3N"]'),
    ("flipkart", "reviews", 'span:contains("(")'),
    ("flipkart", "reviews", 'span:contains("ratings")'),
    ("flipkart", "reviews", 'div:contains("ratings")'),
    ("flipkart", "discount", 'div[class*="UkUFwK"] span'),
    ("flipkart", "discount", 'div[class*="hl05eU"] div[class*="UkUFwK"] span'),
    ("flipkart", "discount", 'span:contains("% off")'),
    ("flipkart", "discount", 'div:contains("% off")'),
    ("flipkart", "offers", 'div[class*="+7E521"]'),
    ("flipkart", "offers", 'div[class*="oUss6M"]'),
    ("flipkart", "offers", 'div[class*="offer"]'),
    ("flipkart", "offers", 'span[class*="coupon"]'),
    ("flipkart", "offers", 'div:contains("Save")'),
    ("meesho", "product_container", 'div[class*="product"]'),
    ("meesho", "name", 'div[class*="title"]'),
    ("meesho", "name", "h1"),
    ("meesho", "name", "h2"),
    ("meesho", "name", "h3"),
    ("meesho", "name", 'span[class*="title"]'),
    ("meesho", "current_price", 'span[class*="price"]'),
    ("meesho", "current_price", 'div[class*="price"]'),
    ("meesho", "current_price", 'span[class*="amount"]'),
    ("meesho", "original_price", 'span[class*="strike"]'),
    ("meesho", "original_price", 'span[class*="original"]'),
    ("meesho", "rating", 'span[class*="rating"]'),
    ("meesho", "rating", 'div[class*="star"]'),
    ("meesho", "rating", 'span[class*="score"]'),
    ("meesho", "reviews", 'span[class*="review"]'),
    ("meesho", "reviews", 'span:contains("ratings")'),
    ("meesho", "discount", 'span:contains("% off")'),
    ("meesho", "discount", 'span:contains("off")'),
    ("meesho", "offers", 'span[class*="offer"]'),
    ("meesho", "offers", 'div[class*="coupon"]'),
    ("sathya", "product_container", "div.product-box"),
    ("sathya", "name", 'a[href*="/category/"]'),
    ("sathya", "name", "img[alt]"),
    ("sathya", "name", "h4"),
    ("sathya", "name", "h3"),
    ("sathya", "name", 'div[class*="title"]'),
    ("sathya", "current_price", 'h4:contains("₹")'),
    ("sathya", "current_price", 'span:contains("₹")'),
    ("sathya", "current_price", 'div:contains("₹")'),
    ("sathya", "current_price", 'p:contains("₹")'),
    ("sathya", "original_price", 'span[class*="strike"]'),
    ("sathya", "original_price", 'span[class*="original"]'),
    ("sathya", "original_price", "del"),
    ("sathya", "original_price", 'span:contains("MRP")'),
    ("sathya", "original_price", 'span:contains("M.R.P")'),
    ("sathya", "original_price", 'div:contains("MRP")'),
    ("sathya", "original_price", 'p:contains("MRP")'),
    ("sathya", "rating", 'div[class*="star"]'),
    ("sathya", "rating", 'span[class*="rating"]'),
    ("sathya", "rating", 'div[class*="review"]'),
    ("sathya", "rating", 'div[class*="rating"]'),
    ("sathya", "rating", 'span[class*="score"]'),
    ("sathya", "rating", 'div[class*="Rating"]'),
    ("sathya", "reviews", 'span[class*="review"]'),
    ("sathya", "reviews", 'span:contains("ratings")'),
    ("sathya", "reviews", 'div:contains("ratings")'),
    ("sathya", "reviews", 'span:contains("Reviews")'),
    ("sathya", "reviews", 'div:contains("Reviews")'),
    ("sathya", "reviews", 'span[class*="Review"]'),
    ("sathya", "discount", 'span:contains("% off")'),
    ("sathya", "discount", 'span:contains("off")'),
    ("sathya", "discount", 'div:contains("Save")'),
    ("sathya", "offers", 'span[class*="offer"]'),
    ("sathya", "offers", 'div[class*="coupon"]'),
    ("sathya", "offers", 'div:contains("Save")'),
)

# Templates per platform.
TEMPLATES = (
    ("flipkart", "product_container", "div[data-id]"),
    ("flipkart", "name", "a.s1Q9rs"),
    ("flipkart", "name", "div._4rR01T"),
    ("flipkart", "name", "a.IRpwTa"),
    ("flipkart", "name", "div.KzDlHZ"),
    ("flipkart", "name", "a[title]"),
    ("flipkart", "current_price", "div._30jeq3._16Jk6d"),
    ("flipkart", "current_price", "div._30jeq3"),
    ("flipkart", "current_price", "div.Nx9bqj"),
    ("flipkart", "original_price", "div._3I9_wc._27UcVY"),
    ("flipkart", "original_price", "div.yRaY8j"),
    ("flipkart", "original_price", "div._3I9_wc"),
    ("flipkart", "original_price", "span[aria-hidden='true'] span._3I9_wc"),
    ("flipkart", "rating", "div._3LWZlK"),
    ("flipkart", "rating", "span._1lRcqv"),
    ("flipkart", "rating", "div.XQDdHH"),
    ("flipkart", "reviews", "span._2_R_DZ"),
    ("flipkart", "reviews", "span._2_R_DZ span"),
    ("flipkart", "reviews", "span.Wphh3N"),
    ("flipkart", "discount", "div._3Ay6Sb span"),
    ("flipkart", "discount", "div.UkUFwK span"),
    ("flipkart", "discount", "span[class*='discount']"),
    ("flipkart", "offers", "div[class*='offer']"),
    ("flipkart", "offers", "span[class*='offer']"),
    ("flipkart", "offers", "span[class*='coupon']"),
    ("ajio", "product_container", "div[class*='product']"),
    ("ajio", "product_container", "li[class*='product']"),
    ("ajio", "product_container", "div[itemprop='itemListElement']"),
    ("ajio", "product_container", "li[id^='pid_']"),
    ("ajio", "product_container", "article"),
    ("ajio", "name", "a[title]"),
    ("ajio", "name", "div[class*='name']"),
    ("ajio", "name", "h2"),
    ("ajio", "name", "h3"),
    ("ajio", "current_price", "span[class*='price']"),
    ("ajio", "current_price", "div[class*='price'] span"),
    ("ajio", "current_price", "[data-price]"),
    ("ajio", "original_price", "span[class*='mrp']"),
    ("ajio", "original_price", "span.strike"),
    ("ajio", "original_price", "div[class*='price'] s"),
    ("ajio", "rating", "span[class*='rating']"),
    ("ajio", "rating", "[aria-label*='out of']"),
    ("ajio", "reviews", "span[class*='ratings']"),
    ("ajio", "discount", "span[class*='discount']"),
    ("ajio", "discount", "span:contains(% off)"),
    ("ajio", "offers", "div[class*='offer']"),
    ("ajio", "offers", "span[class*='coupon']"),
    ("myntra", "product_container", "li.product-base"),
    ("myntra", "product_container", "li[data-id]"),
    ("myntra", "name", "h3.product-brand"),
    ("myntra", "name", "h4.product-product"),
    ("myntra", "name", "div.product-product"),
    ("myntra", "current_price", "span.product-discountedPrice"),
    ("myntra", "current_price", "span.product-price"),
    ("myntra", "original_price", "span.product-strike"),
    ("myntra", "original_price", "span.product-mrp"),
    ("myntra", "rating", "div.ratings"),
    ("myntra", "rating", "div.ratings-container span"),
    ("myntra", "rating", "[aria-label*='out of']"),
    ("myntra", "reviews", "span.product-ratingsCount"),
    ("myntra", "discount", "span.product-discountPercentage"),
    ("myntra", "offers", "div[class*='offer']"),
    ("myntra", "offers", "span[class*='coupon']"),
    ("amazon", "product_container", "div.s-result-item[data-asin]"),
    ("amazon", "product_container", "div[data-component-type='s-search-result']"),
    ("amazon", "name", "h2 a.a-link-normal.a-text-normal span"),
    ("amazon", "name", "h2 a span"),
    ("amazon", "name", "h2 span"),
    ("amazon", "current_price", "span.a-price span.a-offscreen"),
    ("amazon", "current_price", "span.a-price-whole"),
    ("amazon", "current_price", "span.a-offscreen"),
    ("amazon", "original_price", "span.a-text-price span.a-offscreen"),
    ("amazon", "original_price", "span.a-price.a-text-price span"),
    ("amazon", "rating", "span.a-icon-alt"),
    ("amazon", "reviews", "span.a-size-base.s-underline-text"),
    ("amazon", "reviews", "span[aria-label$='ratings']"),
    ("amazon", "discount", "span.savingsPercentage"),
    ("amazon", "discount", "span.a-letter-space+span"),
    ("amazon", "offers", "span.coupon"),
    ("amazon", "offers", "span.promo"),
    ("generic", "product_container", "[data-id]"),
    ("generic", "product_container", "li"),
    ("generic", "product_container", "article"),
    ("generic", "product_container", "div"),
    ("generic", "name", "h1"),
    ("generic", "name", "h2"),
    ("generic", "name", "h3"),
    ("generic", "name", "a[title]"),
    ("generic", "current_price", "[class*='price']"),
    ("generic", "current_price", "[data-price]"),
    ("generic", "original_price", "s"),
    ("generic", "original_price", ".strike"),
    ("generic", "original_price", "[class*='mrp']"),
    ("generic", "rating", "[aria-label*='out of']"),
    ("generic", "reviews", "span:contains(reviews)"),
    ("generic", "reviews", "span:contains(ratings)"),
    ("generic", "discount", "span:contains(% off)"),
    ("generic", "discount", "[class*='discount']"),
)

# Further sets for single sites - the advanced and the workflow flipkart set, the
# amazon search set and the meesho set.
OTHERS = (
    ("flipkart_advanced", "product_container", "div[data-id]"),
    ("flipkart_advanced", "product_container", 'div[class*="slAVV4"]'),
    ("flipkart_advanced", "product_container", 'div[class*="_4WELSP"]'),
    ("flipkart_advanced", "name", "img[alt]"),
    ("flipkart_advanced", "name", 'a[class*="wjcEIp"]'),
    ("flipkart_advanced", "name", "a[title]"),
    ("flipkart_advanced", "name", 'a[href*="/p/"]'),
    ("flipkart_advanced", "current_price", 'div[class*="Nx9bqj"]'),
    ("flipkart_advanced", "current_price", 'div[class*="hl05eU"] div[class*="Nx9bqj"]'),
    ("flipkart_advanced", "current_price", 'div:contains("₹")'),
    ("flipkart_advanced", "current_price", 'span:contains("₹")'),
    ("flipkart_advanced", "original_price", 'div[class*="yRaY8j"]'),
    ("flipkart_advanced", "original_price", 'div[class*="hl05eU"] div[class*="yRaY8j"]'),
    ("flipkart_advanced", "original_price", 'span[class*="strike"]'),
    ("flipkart_advanced", "original_price", "del"),
    ("flipkart_advanced", "rating", 'div[class*="XQDdHH"]'),
    ("flipkart_advanced", "rating", 'span[class*="Y1HWO0"] div[class*="XQDdHH"]'),
    ("flipkart_advanced", "rating", 'div[class*="_5OesEi"] span[class*="Y1HWO0"] div[class*="XQDdHH"]'),
    ("flipkart_advanced", "rating", 'div[class*="star"]'),
    ("flipkart_advanced", "rating", 'span[class*="rating"]'),
    ("flipkart_advanced", "reviews", 'span[class*="Wphh3N"]'),
    ("flipkart_advanced", "reviews", 'div[class*="_5OesEi"] span[class*="Wphh3N"]'),
    ("flipkart_advanced", "reviews", 'span:contains("(")'),
    ("flipkart_advanced", "reviews", 'span:contains("ratings")'),
    ("flipkart_advanced", "reviews", 'div:contains("ratings")'),
    ("flipkart_advanced", "discount", 'div[class*="UkUFwK"] span'),
    ("flipkart_advanced", "discount", 'div[class*="hl05eU"] div[class*="UkUFwK"] span'),
    ("flipkart_advanced", "discount", 'span:contains("% off")'),
    ("flipkart_advanced", "discount", 'div:contains("% off")'),
    ("flipkart_advanced", "offers", 'div[class*="+7E521"]'),
    ("flipkart_advanced", "offers", 'div[class*="oUss6M"]'),
    ("flipkart_advanced", "offers", 'div[class*="offer"]'),
    ("flipkart_advanced", "offers", 'span[class*="coupon"]'),
    ("flipkart_advanced", "offers", 'div:contains("Save")'),
    ("flipkart_workflow", "product_container", "div[data-id]"),
    ("flipkart_workflow", "product_container", "div.cPHDOP"),
    ("flipkart_workflow", "product_container", "div.slAVV4"),
    ("flipkart_workflow", "product_container", "div._75nlfW"),
    ("flipkart_workflow", "product_container", 'div[class*="product"]'),
    ("flipkart_workflow", "name", "div.KzDlHZ"),
    ("flipkart_workflow", "name", "a.wjcEIp"),
    ("flipkart_workflow", "name", "a.WKTcLC"),
    ("flipkart_workflow", "name", 'div[class*="title"]'),
    ("flipkart_workflow", "name", "a[title]"),
    ("flipkart_workflow", "current_price", "div.Nx9bqj"),
    ("flipkart_workflow", "current_price", "div._4b5DiR"),
    ("flipkart_workflow", "current_price", "div._1vC4OE"),
    ("flipkart_workflow", "current_price", 'div[class*="price"]'),
    ("flipkart_workflow", "current_price", 'span[class*="price"]'),
    ("flipkart_workflow", "original_price", "div.yRaY8j"),
    ("flipkart_workflow", "original_price", "div._3auQ3N"),
    ("flipkart_workflow", "original_price", "div._25b18c"),
    ("flipkart_workflow", "original_price", 'span[class*="strike"]'),
    ("flipkart_workflow", "rating", "div.XQDdHH"),
    ("flipkart_workflow", "rating", "div._2_KrJI"),
    ("flipkart_workflow", "rating", 'span[class*="rating"]'),
    ("flipkart_workflow", "rating", 'div[class*="stars"]'),
    ("flipkart_workflow", "reviews", "span.Wphh3N"),
    ("flipkart_workflow", "reviews", "span._2_R_DZ"),
    ("flipkart_workflow", "reviews", 'span[class*="review"]'),
    ("flipkart_workflow", "reviews", 'span[class*="rating"]'),
    ("flipkart_workflow", "discount", "div.UkUFwK"),
    ("flipkart_workflow", "discount", "div._3Ay6Sb"),
    ("flipkart_workflow", "discount", 'span[class*="discount"]'),
    ("flipkart_workflow", "discount", 'span[class*="off"]'),
    ("flipkart_workflow", "offers", 'div[class*="offer"]'),
    ("flipkart_workflow", "offers", 'span[class*="coupon"]'),
    ("flipkart_workflow", "offers", 'div[class*="bank"]'),
    ("flipkart_workflow", "offers", 'span[class*="save"]'),
    ("amazon_search", "product_container", 'div[data-component-type="s-search-result"]'),
    ("amazon_search", "product_container", "div.s-result-item"),
    ("amazon_search", "product_container", "div[data-asin]"),
    ("amazon_search", "product_container", ".s-result-item"),
    ("amazon_search", "name", "h2 a span"),
    ("amazon_search", "name", "h2 span"),
    ("amazon_search", "name", ".s-size-mini span"),
    ("amazon_search", "name", "a span[aria-label]"),
    ("amazon_search", "name", "h2 a span[aria-label]"),
    ("amazon_search", "current_price", ".a-price-whole"),
    ("amazon_search", "current_price", ".a-offscreen"),
    ("amazon_search", "current_price", ".a-price .a-offscreen"),
    ("amazon_search", "current_price", ".a-price-range"),
    ("amazon_search", "current_price", ".a-price .a-price-whole"),
    ("amazon_search", "original_price", ".a-price.a-text-price .a-offscreen"),
    ("amazon_search", "original_price", ".a-text-strike"),
    ("amazon_search", "original_price", ".a-price.a-text-price"),
    ("amazon_search", "rating", ".a-icon-alt"),
    ("amazon_search", "rating", ".a-icon-star"),
    ("amazon_search", "rating", '[aria-label*="stars"]'),
    ("amazon_search", "rating", ".a-icon-star-small"),
    ("amazon_search", "reviews", ".a-size-base"),
    ("amazon_search", "reviews", 'a[href*="reviews"] span'),
    ("amazon_search", "reviews", ".a-link-normal span"),
    ("amazon_search", "reviews", ".a-size-small"),
    ("amazon_search", "discount", ".a-badge-text"),
    ("amazon_search", "discount", ".a-color-base"),
    ("amazon_search", "discount", ".a-color-price"),
    ("amazon_search", "discount", ".a-text-bold"),
    ("amazon_search", "offers", ".a-color-base"),
    ("amazon_search", "offers", ".a-text-bold"),
    ("amazon_search", "offers", ".a-badge-text"),
    ("amazon_search", "offers", ".a-color-secondary"),
    ("meesho_cards", "product_container", "div[data-testid='product-card']"),
    ("meesho_cards", "product_container", "div[class*='ProductCard']"),
    ("meesho_cards", "product_container", "div[class*='Card']"),
    ("meesho_cards", "product_container", "a[href*='/item']"),
    ("meesho_cards", "product_container", "a[href*='/p/']"),
    ("meesho_cards", "product_container", "li"),
    ("meesho_cards", "product_container", "article"),
    ("meesho_cards", "name", "a[title]"),
    ("meesho_cards", "name", "h1"),
    ("meesho_cards", "name", "h2"),
    ("meesho_cards", "name", "h3"),
    ("meesho_cards", "name", "p"),
    ("meesho_cards", "name", "span"),
    ("meesho_cards", "current_price", "span:contains(₹)"),
    ("meesho_cards", "current_price", "[class*='price']"),
    ("meesho_cards", "current_price", "[class*='Price']"),
    ("meesho_cards", "current_price", "span[class*='price']"),
    ("meesho_cards", "original_price", "s"),
    ("meesho_cards", "original_price", ".strike"),
    ("meesho_cards", "original_price", "[class*='mrp']"),
    ("meesho_cards", "original_price", "span[class*='strike']"),
    ("meesho_cards", "rating", "[aria-label*='out of']"),
    ("meesho_cards", "rating", "span[class*='rating']"),
    ("meesho_cards", "rating", "div[class*='rating']"),
    ("meesho_cards", "reviews", "span:contains(Reviews)"),
    ("meesho_cards", "reviews", "span:contains(ratings)"),
    ("meesho_cards", "reviews", "[class*='review']"),
    ("meesho_cards", "discount", "span:contains(% off)"),
    ("meesho_cards", "discount", "span[class*='discount']"),
    ("meesho_cards", "discount", "[class*='Off']"),
)

# Comma-list schema of a product card (field, selector list).
LIST_SCHEMA = (
    ("name", "h1, h2, h3, h4, h5, [class*='title'], [class*='name'], [class*='product-title'], [class*='product-name']"),
    ("current_price", "[class*='price'], [class*='current-price'], [class*='selling-price'], span:contains('₹'), div:contains('₹'), [class*='amount']"),
    ("original_price", "[class*='mrp'], [class*='original-price'], [class*='strike'], [class*='was-price']"),
    ("image", "img[src], img[data-src], img[data-lazy-src], [class*='product-image'] img"),
    ("link", "a[href*='/p/'], a[href*='/product/'], a[href*='/dp/']"),
    ("rating", "[class*='rating'], [class*='star'], [class*='score'], [class*='review-rating']"),
    ("reviews", "[class*='review'], [class*='rating-count'], [class*='review-count']"),
    ("discount", "[class*='discount'], [class*='offer'], [class*='save'], [class*='off']"),
    ("availability", "[class*='stock'], [class*='available'], [class*='out-of-stock']"),
)


def _sites(rows: tuple[tuple[str, str, str], ...]) -> dict[str, dict[str, tuple[Rule, ...]]]:
    sites: dict[str, dict[str, tuple[Rule, ...]]] = {}
    for site, name, selector in rows:
        fields = sites.setdefault(site, {})
        fields[name] = (*fields.get(name, ()), Rule(selector))
    return sites


def built_in_sites() -> dict[str, dict[str, tuple[Rule, ...]]]:
    return _sites(BUILT_IN)


def platform_templates() -> dict[str, dict[str, tuple[Rule, ...]]]:
    return _sites(TEMPLATES)


def other_sets() -> dict[str, dict[str, tuple[Rule, ...]]]:
    return _sites(OTHERS)


def list_schema() -> dict[str, tuple[Rule, ...]]:
    return {name: (Rule(selectors),) for name, selectors in LIST_SCHEMA}
