"""The checks and decisions of a review, thresholds, seeds and price lists."""

# Decisions in order, each with its checks in order.
DECISION_CHECKS = {
    "explore": ["explore.output-reproducible", "explore.assumptions-catalogued"],
    "rely": [
        "rely.intended-use-defined", "rely.acceptance-criteria-defined", "rely.acceptance-criteria-met", "rely.failure-modes-tested", "rely.limitations-stated",
    ],
    "operate": [
        "operate.deliverable-gate-passed", "operate.operational-owner-assigned", "operate.assurance-defined", "operate.fallback-defined", "operate.recovery-tested",
        "operate.support-maintenance-defined", "operate.operating-cost-known",
    ],
    "measure-outcome": [
        "measure-outcome.outcome-measure-defined", "measure-outcome.baseline-defined", "measure-outcome.outcome-measured",
        "measure-outcome.measurement-definition-consistent", "measure-outcome.important-confounds-named",
    ],
    "scale-renew-stop": [
        "scale-renew-stop.outcome-evidence-available", "scale-renew-stop.full-cost-accounted", "scale-renew-stop.risk-tradeoffs-assessed",
        "scale-renew-stop.alternatives-compared", "scale-renew-stop.value-rule-explicit",
    ],
}
STATES = ["pass", "claimed", "fail", "unknown"]
STATE_RANK = {"pass": 3, "claimed": 2, "fail": 1, "unknown": 0}

# Thresholds.
FLOOR, MIN_VALUES = 10, 5
AC1_MIN, PRECISION_MIN, ESTIMABLE_PASSES = 0.70, 0.85, 10
AUDIT_BAR, RECALL_BAR, RECALL_CONTRIBUTING = 0.10, 0.7, 8
SPAN_CHARS, CHUNK_CHARS, TOKEN_CAP, CHARS_PER_TOKEN = 1500, 40_000, 20_000, 4
DF_K, NGRAM, QUOTE_WORDS, VOCAB_DF = 3, 6, 40, 10
STAGE2_TEXT_MIN, TOP_SOURCES, H2_GROUP_MIN, SOURCE_GROUP_MIN = 500, 8, 30, 10

# Function words that masking leaves alone.
COMMON_WORDS = (
    "a an the and or but nor of to in on at by for from with without into onto over under about as is are was were be been being "
    "it its this that these those there here we our us you your they their them he she his her i my me not no yes do does did "
    "can could will would should may might must has have had if then than so too also only just each every all any some more most "
    "when where which who whom what how why while after before up down out off per via"
).split()
