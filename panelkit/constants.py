"""Fixed values that must equal the reference's labels and thresholds."""

# --- fixed values (reference labels, verbatim) ---
COVERAGE_BANDS = [(75.0, "High (>=75%)"), (40.0, "Medium (40-75%)")]
COVERAGE_LOW = "Low (<40%)"
MISSING_ALWAYS = "Always missing (no sub-meter)"
MISSING_NEVER = "Never missing (has sub-meter)"
MISSING_PARTLY = "Partially missing (unusual)"
COVERAGE_THRESHOLDS = (99.5, 95.0, 90.0)
OVERDISPERSION_FLAG = 1.5
ROW_BUDGET = 100_000
# --- end fixed values ---
