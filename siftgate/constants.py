"""Fixed values of the screening rules. Results depend on them; do not edit."""

# Fusion layers in summing order, with weights.
LAYERS = ("text_risk", "vision", "metadata", "porn", "ad", "political", "logo")
FUSION_WEIGHTS = {
    "text_risk": 0.10,
    "vision": 0.20,
    "metadata": 0.10,
    "porn": 0.20,
    "ad": 0.15,
    "political": 0.15,
    "logo": 0.10,
}
REJECT_AT = 0.85
REVIEW_AT = 0.40

# Severity weights of the planned text score.
SEVERITY_WEIGHTS = {"原则性错误": 1.0, "一般错误": 0.6, "提示": 0.2}

# Ids under which the default scorers appear in the audit table.
PREPROCESS_ID = "preprocess-agent-003"
FUSION_ID = "risk-fusion-agent"
DEFAULT_SCORER_IDS = {
    "text_risk": "text-risk-stub-002",
    "vision": "vision-stub-002",
    "metadata": "metadata-stub-002",
    "porn": "porn-stub-004",
    "ad": "ad-stub-004",
    "political": "political-stub-004",
    "logo": "logo-stub-004",
}
SPECIALISED_TARGETS = ("porn", "ad", "political", "logo")
DEFAULT_SCORE = 0.5

# States of a screening run, main path, end states, legal steps.
MAIN_PATH = ("init", "preprocess", "parallel-fan-out", "fan-in", "fusion", "done")
TERMINAL_STATES = ("done", "cancelled", "failed")
TRANSITIONS = (
    ("init", "preprocess"),
    ("init", "cancelled"),
    ("init", "failed"),
    ("preprocess", "parallel-fan-out"),
    ("preprocess", "cancelled"),
    ("preprocess", "failed"),
    ("parallel-fan-out", "fan-in"),
    ("parallel-fan-out", "cancelled"),
    ("parallel-fan-out", "failed"),
    ("fan-in", "fusion"),
    ("fan-in", "cancelled"),
    ("fan-in", "failed"),
    ("fusion", "done"),
    ("fusion", "cancelled"),
    ("fusion", "failed"),
)
# The blocklist fast path steps outside the legal table.
FAST_PATH_STEP = ("preprocess", "fusion")

# Audit line envelope.
AUDIT_LEVEL = "INFO"
AUDIT_PHASE = "AGENT_RUN"
AUDIT_MESSAGE = "agent.audit"

# Fixed value: whitespace of the matching rules, as a regex class (Java and RE2 read it alike).
WHITESPACE = (
    r"[\t\n\x0B\f\r\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
