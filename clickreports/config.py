"""Fixed vocabulary of the reports, and the default sizes of those that are cut off."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: the reports' vocabulary, labels, edges and limits. ---------

USER_ID_PREFIX = "U"
PURCHASE = "purchase"

FUNNEL_STEPS = (
    ("view_item_list", "View Items"),
    ("add_to_cart", "Add to Cart"),
    ("view_cart", "View Cart"),
    ("begin_checkout", "Begin Checkout"),
    ("add_payment_info", "Add Payment"),
    ("purchase", "Purchase"),
)
FUNNEL_TOTAL_STEP = ("all", "Total Users")

# The events that make up journeys and transitions, with their labels.
EVENT_LABELS = {
    "page_view": "Page View",
    "session_start": "Session Start",
    "first_visit": "First Visit",
    "view_item_list": "View Items",
    "view_search_results": "Search Results",
    "view_cart": "View Cart",
    "add_to_cart": "Add to Cart",
    "remove_from_cart": "Remove from Cart",
    "begin_checkout": "Begin Checkout",
    "add_payment_info": "Add Payment",
    "purchase": "Purchase",
    "login": "Login",
    "signup": "Signup",
    "user_engagement": "User Engagement",
    "click_top_seller_number": "Click Top Seller",
}

# Position of each labelled event along the shop; transitions must go deeper.
EVENT_DEPTH = {
    "First Visit": 0,
    "Session Start": 1,
    "Page View": 2,
    "User Engagement": 3,
    "Click Top Seller": 4,
    "Search Results": 5,
    "View Items": 6,
    "Add to Cart": 7,
    "Remove from Cart": 8,
    "View Cart": 9,
    "Login": 10,
    "Signup": 11,
    "Begin Checkout": 12,
    "Add Payment": 13,
    "Purchase": 14,
}
DEPTH_OF_UNKNOWN_SOURCE = 0
DEPTH_OF_UNKNOWN_TARGET = 99

# Buckets: (upper bound, bound is inclusive, label); the last label takes the rest.
ORDER_VALUE_BUCKETS = (
    (100, False, "0-99"),
    (500, False, "100-499"),
    (1000, False, "500-999"),
    (2000, False, "1K-1.9K"),
    (5000, False, "2K-4.9K"),
    (None, False, "5K+"),
)
ENGAGEMENT_SECOND_BUCKETS = (
    (10, False, "0-10s"),
    (30, False, "10-30s"),
    (60, False, "30-60s"),
    (180, False, "1-3m"),
    (600, False, "3-10m"),
    (None, False, "10m+"),
)
# Exact-value buckets come first, as (value, label).
SESSION_EXACT = ((1, "1"), (2, "2"))
SESSION_BUCKETS = ((5, True, "3-5"), (10, True, "6-10"), (None, True, "11+"))
PSEUDO_ID_EXACT = ((1, "1"), (2, "2"), (3, "3"))
PSEUDO_ID_BUCKETS = ((5, True, "4-5"), (10, True, "6-10"), (None, True, "11+"))

# Page categories in matching order: a URL belongs to the first one it contains.
PAGE_PATHS = (
    "/cart",
    "/safe",
    "/highlights",
    "/jidrid",
    "/profile",
    "/orders",
    "/register",
    "/dashboard",
    "/prize-history",
)
PAGE_PATH_REST = "/ (home)"

# Traffic-source groups, in matching order.
SOURCE_DIRECT = ("(direct)", "")
SOURCE_GROUP_DIRECT = "Direct"
SOURCE_GROUPS = (
    ("LINE Richmenu", ("richmenu%",)),
    ("Search", ("%google%", "%bing%")),
    ("Social", ("%facebook%", "%tiktok%", "%line%")),
)
SOURCE_GROUP_REST = "Others"

DAY_NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
PATH_SEPARATOR = " → "
UNKNOWN = "Unknown"
NOT_SET = "(not set)"
NO_REFERRER = "(direct)"
# --- End of fixed values. -----------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Default sizes of the cut-off reports; ``report`` takes others by keyword.

    ``referrer_urls`` limits the URLs that referrer domains are summed over; None is all.
    """

    transition_min_users: int = 100
    transition_links: int = 50
    journey_steps: int = 10
    journey_paths: int = 20
    top_values: int = 15
    referrer_urls: int | None = None
    referrer_domains: int = 20


LIMITS = Limits()
