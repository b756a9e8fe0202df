"""Names that appear in results.

Fixed values: report consumers match on these texts, so they must not change.
"""

DELIVERED = "delivered"
OTHER_CATEGORY = "other"

# revenue concentration: spend quintile -> name
SPEND_QUINTILES = (
    "Top 20% (Quintile 1)",
    "Q2 (21-40%)",
    "Q3 (41-60%)",
    "Q4 (61-80%)",
    "Bottom 20% (Q5)",
)

# Pareto classes with the cumulative percentage each one reaches
ABC_A, ABC_B, ABC_C = "A (Top 80%)", "B (Next 15%)", "C (Bottom 5%)"
ABC_A_LIMIT, ABC_B_LIMIT = 80, 95

# payment plans: upper number of installments -> name
INSTALLMENT_BUCKETS = (
    (1, "1 (Full Payment)"),
    (3, "2-3 Installments"),
    (6, "4-6 Installments"),
    (10, "7-10 Installments"),
)
INSTALLMENT_REST = "10+ Installments"

# score-based customer segments
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
NEW = "New Customers"
POTENTIAL = "Potential Loyalists"
AT_RISK = "At Risk"
CANT_LOSE = "Cant Lose Them"
LOST = "Lost"
NEED_ATTENTION = "Need Attention"

# lifetime-value tiers, lowest first
CLV_TIERS = ("Basic", "Bronze", "Silver", "Gold", "Platinum")

# delivery against the promise, earliest first
# whole days early against the promise: lowest value -> name; below all of them, or unknown: the rest
DELIVERY_BUCKETS = (
    (10, "1. Very Early (10+ days early)"),
    (1, "2. Early (1-9 days)"),
    (0, "3. On Time"),
    (-5, "4. Slightly Late (1-5 days)"),
)
DELIVERY_REST = "5. Very Late (5+ days)"

# the same idea with right-closed cuts: (lower bound, upper bound, name)
DELIVERY_CUTS = (
    (-999, -5, "Very Late (5+ days)"),
    (-5, -1, "Slightly Late (1-5 days)"),
    (-1, 0, "On Time"),
    (0, 9, "Early (1-9 days)"),
    (9, 999, "Very Early (10+ days)"),
)

# parcel weight: upper grams -> name
WEIGHT_BUCKETS = (
    (500, "Light (≤500g)"),
    (2000, "Medium (500g-2kg)"),
    (5000, "Heavy (2-5kg)"),
)
WEIGHT_REST = "Very Heavy (5kg+)"

# month-on-month delivery trend
IMPROVING, WORSENING, STABLE = "Improving", "Worsening", "Stable"

# seller reliability quartiles, best first
RELIABILITY_TIERS = ("Excellent", "Good", "Fair", "Poor")

# k-means clusters, highest mean spend first
CLUSTER_SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "At Risk",
    "Need Attention",
    "Lost",
    "Hibernating",
    "New",
)

# p-value marks: (exclusive upper bound, mark)
SIGNIFICANCE_MARKS = (
    (0.001, "*** (p < 0.001)"),
    (0.01, "** (p < 0.01)"),
    (0.05, "* (p < 0.05)"),
)
NOT_SIGNIFICANT = "ns (not significant)"
REJECT, FAIL_TO_REJECT = "REJECT", "FAIL TO REJECT"

# effect size by |d|: (exclusive upper bound, name)
EFFECT_SIZES = ((0.5, "Small"), (0.8, "Medium"))
EFFECT_LARGE = "Large"

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
