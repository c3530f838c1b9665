"""FunnelSpec: the value domains of the funnel, declared once.

The analyses read URLs and labels from a ``FunnelSpec`` instead of literals
scattered through every query, so a site with other pages only swaps the spec.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the analysed site's page names and labels
# for the results to be right; they are stated here plainly, in natural order.
# ---------------------------------------------------------------------------

# Product page URL -> product page label (label spelling as used by the views).
PRODUCT_PAGES = (
    ("/the-original-mr-fuzzy", "The Original Mr Fuzzy"),
    ("/the-forever-love-bear", "The Forever Love Bear"),
    ("/the-birthday-sugar-panda", "The Birthday Sugar Panda"),
    ("/the-hudson-river-mini-bear", "The Hudson River Mini bear"),
)

# Column-name stems of the per-product pivots, in the order of PRODUCT_PAGES.
PRODUCT_COLUMN_STEMS = ("Mr_Fuzzy", "Forever_Love_Bear", "Birthday_Panda", "Hudson_Mini_Bear")

# Landing URL -> landing label.
LANDING_PAGES = (
    ("/home", "Home"),
    ("/lander-1", "Lander-1"),
    ("/lander-2", "Lander-2"),
    ("/lander-3", "Lander-3"),
    ("/lander-4", "Lander-4"),
    ("/lander-5", "Lander-5"),
)

PRODUCTS_URL = "/products"
CART_URL = "/cart"
SHIPPING_URL = "/shipping"
BILLING_URLS = ("/billing", "/billing-2")
THANK_YOU_URL = "/thank-you-for-your-order"

# The 16 page names expected after URL -> page_name derivation.
KNOWN_PAGE_NAMES = (
    "home", "products", "cart", "shipping", "billing", "billing-2",
    "thank-you-for-your-order", "lander-1", "lander-2", "lander-3",
    "lander-4", "lander-5", "the-original-mr-fuzzy", "the-forever-love-bear",
    "the-birthday-sugar-panda", "the-hudson-river-mini-bear",
)

# Product catalogue (product_id, product_name).
PRODUCT_NAMES = (
    (1, "The Original Mr. Fuzzy"),
    (2, "The Forever Love Bear"),
    (3, "The Birthday Sugar Panda"),
    (4, "The Hudson River Mini bear"),
)

# Recency buckets: (low, high, label), inclusive on both ends; anything else
# (including an unknown day count) goes to the ELSE label.
RECENCY_BUCKETS = (
    (0, 30, "Recently Lapsed (0-30 days)"),
    (31, 90, "Moderately Lapsed (31-90 days)"),
    (91, 180, "Cold (91-180 days)"),
    (181, 365, "Very Cold (181-365 days)"),
)
RECENCY_ELSE = "Likely Gone (365+ days)"

# Segment labels.
SEGMENT_NEW = "New"
SEGMENT_RETURNING = "Returning"
ORDER_SINGLE = "Single Item"
ORDER_TWO = "Two Items"
PERIOD_BEFORE = "Before Lander-5 (Mar 2012 - Jul 2014)"
PERIOD_AFTER = "After Lander-5 introduced (Aug 2014 - Mar 2015)"
UNTRACKED_LABEL = "None (untracked)"
FILL_VALUE = "none"


@dataclass(frozen=True)
class FunnelSpec:
    """Ordered funnel steps and page domains."""

    product_pages: tuple = PRODUCT_PAGES
    product_column_stems: tuple = PRODUCT_COLUMN_STEMS
    landing_pages: tuple = LANDING_PAGES
    products_url: str = PRODUCTS_URL
    cart_url: str = CART_URL
    shipping_url: str = SHIPPING_URL
    billing_urls: tuple = BILLING_URLS
    thank_you_url: str = THANK_YOU_URL
    known_page_names: tuple = KNOWN_PAGE_NAMES
    recency_buckets: tuple = RECENCY_BUCKETS
    recency_else: str = RECENCY_ELSE
    # Split date of the before/after landing comparison.
    period_split: str = "2014-08-01"

    @property
    def product_urls(self) -> tuple:
        return tuple(u for u, _ in self.product_pages)

    @property
    def product_labels(self) -> tuple:
        return tuple(lbl for _, lbl in self.product_pages)

    @property
    def landing_urls(self) -> tuple:
        return tuple(u for u, _ in self.landing_pages)


DEFAULT_SPEC = FunnelSpec()
