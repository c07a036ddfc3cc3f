"""Names, patterns, lists and limits that results depend on. Plain text, natural order."""

# --- limits -----------------------------------------------------------------------------------
MAX_URL_LENGTH = 4096
MAX_SEGMENT_LENGTH = 180
MAX_DISPLAY_SEGMENT_LENGTH = 120
MAX_STABLE_ID_LENGTH = 80
MAX_CLASS_TOKEN_LENGTH = 64
MAX_FRONTEND_MARKERS = 20
MAX_LABEL_LENGTH = 300
MAX_STYLE_VALUE_LENGTH = 2048
IDENTITY_INDEX_LIMIT = 20000
MAX_SCAN_BUDGET = 20000
MIN_SCAN_BUDGET = 1000
MAX_EMITTED_ELEMENTS = 1000
TEXT_NODE_LIMIT = 500
TEXT_CHARACTER_LIMIT = 200000
TEXT_SCAN_NODE_LIMIT = 20000
TEXT_SCAN_CHARACTER_LIMIT = 2000000
TEXT_SCAN_ANCESTOR_STEP_LIMIT = 200000
MAX_CONTEXT_DOCUMENTS = 500
MAX_CONTEXT_ELEMENTS = 50000
MAX_PACKAGE_ENTRIES = 10000
MAX_PACKAGE_ENTRY_BYTES = 64000000
MAX_PACKAGE_BYTES = 256000000
MAX_PATH_BYTES = 4096
MAX_SESSION_BYTES = 220000000
MAX_SCREENSHOT_BYTES = 16000000
MAX_SNAPSHOT_BYTES = 12000000
MAX_SESSION_CAPTURES = 1000
MAX_CHUNKS = 10000
MAX_CHUNK_CHARACTERS = 524288
MAX_CHUNK_BYTES = 1048576
STALE_JOB_SECONDS = 30
RETENTION_DAYS = 30
MAINTENANCE_INTERVAL_SECONDS = 900
STABLE_SAMPLES = 3
READINESS_TIMEOUT_MS = 1500
MAX_READINESS_TIMEOUT_MS = 5000
SCROLL_TOLERANCE = 1
STANDARD_LIMITS = (750, 24)
DEEP_LIMITS = (1000, 40)

# --- patterns ---------------------------------------------------------------------------------
CREDENTIAL_LIKE = r"(?i)(?:^|[-_.])(token|nonce|secret|password|passwd|auth|session|jwt|key)(?:$|[-_.])"
EMAIL_SEGMENT = r"^[^/@\s]+@[^/@\s]+\.[^/@\s]+$"
JWT_SEGMENT = r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}$"
HIGH_ENTROPY = r"^[A-Za-z0-9_-]{48,}$"
SENSITIVE_WORD = (
    r"(?i)(password|passwd|passcode|token|secret|auth|login|credit|card|cc-number|cvv|cvc|iban|ssn|message|chat)"
)
EMAIL_ANYWHERE = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
JWT_ANYWHERE = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
RANDOM_TOKEN = r"^(?:[a-f0-9]{16,}|[A-Za-z0-9_-]{24,})$"
STABLE_ID = r"^[A-Za-z0-9][A-Za-z0-9_:-]*$"
CLASS_TOKEN = r"^[A-Za-z0-9_-]+$"
STRICT_CLASS_PREFIX = r"(?i)^(elementor|e-|widget|section|container|grid|flex|button|heading|image|menu|nav)"
WIDGET_MARKER = r"^elementor-widget-[A-Za-z0-9_-]{1,120}$"
ROLE_TOKEN = r"^[a-z][a-z0-9-]{0,63}$"
INPUT_TYPE_TOKEN = r"^[a-z][a-z0-9-]{0,31}$"
CONTEXT_KEY = r"^[a-z][a-z0-9_]{0,80}$"
UNSAFE_CONTEXT_KEY = (
    r"(?i)(cookie|token|credential|password|secret|localstorage|sessionstorage|form_value|dom_excerpt|page_text)"
)
SAFE_IDENTIFIER = r"^[A-Za-z0-9_.:-]{1,160}$"
DIGEST = r"^sha256:[0-9a-f]{64}$"
HEX64 = r"^[0-9a-f]{64}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
NODE_ID = r"^node-[0-9]{6}$"
MESSAGE_KEY = r"^diagnostic\.[a-z0-9_.-]{1,160}$"
CHECKSUM_LINE = r"^(sha256:[0-9a-f]{64})  (.+)$"
PREVIEW_RULES = (
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\b", "[REDACTED_TOKEN]"),
    ("keyed", r"(?i)\b(?:bearer|token|secret|password)\s*[:=]?\s*[A-Za-z0-9._~+/-]{8,}\b", "[REDACTED_TOKEN]"),
    ("number", r"\b(?:[0-9][ -]?){13,19}\b", "[REDACTED_NUMBER]"),
    ("entropy", r"\b[A-Za-z0-9_-]{48,}\b", "[REDACTED_TOKEN]"),
)
CLIENT_FAMILIES = (
    ("Edge", r"Edg/([0-9.]+)"),
    ("Chrome", r"Chrome/([0-9.]+)"),
    ("Firefox", r"Firefox/([0-9.]+)"),
    ("Safari", r"Version/([0-9.]+).*Safari"),
)
CLIENT_PLATFORMS = (
    ("TABLET", r"tablet|ipad"),
    ("MOBILE", r"mobile|android|iphone"),
    ("DESKTOP", r"windows|macintosh|linux|cros"),
)

# --- markup -----------------------------------------------------------------------------------
PAGE_ID_ATTRIBUTE = "data-elementor-id"
ELEMENT_ID_ATTRIBUTE = "data-id"
INDEXED_ATTRIBUTES = ("data-elementor-id", "data-id", "id", "data-testid")
MARKER_CLASS_PREFIXES = ("elementor-", "e-")
PAGE_ROOT_CLASS = "elementor-html"
PAGE_BODY_CLASS = "elementor-page"
SECTION_CLASSES = ("elementor-section", "elementor-inner-section")
CONTAINER_CLASSES = ("e-con", "e-con-inner", "elementor-container")
ATOMIC_CLASSES = ("e-grid", "e-flexbox", "e-div-block")
STRUCTURE_CLASSES = (
    "elementor-section", "elementor-inner-section", "elementor-container", "e-con", "e-con-inner",
    "e-grid", "e-flexbox", "e-div-block",
)
STRUCTURAL_KINDS = ("section", "container", "inner_section", "e-div-block", "e-grid", "e-flexbox")
SKIPPED_TAGS = ("base", "head", "link", "meta", "noscript", "script", "style", "template", "title")
INTERACTIVE_TAGS = ("button", "input", "select", "textarea", "summary")
INTERACTIVE_ROLES = ("button", "link")
TEXT_EXCLUDED_TAGS = ("input", "textarea", "select", "option", "script", "style", "template")
CONTROL_TAGS = ("input", "textarea", "select", "option")
CODE_TAGS = ("script", "style", "template")
LANDMARK_TAGS = (
    ("header", "banner"), ("main", "main"), ("nav", "navigation"), ("aside", "complementary"),
    ("footer", "contentinfo"),
)
LANDMARK_ROLES = (
    "banner", "main", "navigation", "contentinfo", "complementary", "region", "search", "form",
)
NATIVE_KINDS = (
    ("button", "BUTTON"), ("a", "ANCHOR"), ("input", "INPUT"), ("select", "SELECT"),
    ("textarea", "TEXTAREA"), ("details", "DETAILS"), ("summary", "SUMMARY"),
)
DISABLEABLE_TAGS = ("button", "input", "select", "textarea", "option", "optgroup", "fieldset")
STORE_HOSTS = ("chrome.google.com", "chromewebstore.google.com", "microsoftedge.microsoft.com")
STORE_HOST_SUFFIX = ".addons.mozilla.org"
BASE_STYLES = (
    "display", "position", "inset", "inset-block-start", "inset-block-end", "inset-inline-start",
    "inset-inline-end", "top", "right", "bottom", "left", "z-index", "box-sizing", "overflow-x",
    "overflow-y", "contain", "isolation", "width", "height", "min-width", "max-width", "min-height",
    "max-height", "aspect-ratio", "flex-direction", "flex-wrap", "flex-grow", "flex-shrink",
    "flex-basis", "justify-content", "align-items", "align-content", "align-self", "gap", "row-gap",
    "column-gap", "grid-template-columns", "grid-template-rows", "grid-auto-flow", "margin-top",
    "margin-right", "margin-bottom", "margin-left", "padding-top", "padding-right", "padding-bottom",
    "padding-left", "border-top-width", "border-right-width", "border-bottom-width",
    "border-left-width", "border-top-left-radius", "border-top-right-radius",
    "border-bottom-right-radius", "border-bottom-left-radius", "font-family", "font-size",
    "font-weight", "line-height", "letter-spacing", "text-align", "white-space", "overflow-wrap",
    "word-break", "text-overflow", "visibility", "opacity", "content-visibility", "pointer-events",
    "clip-path", "transform",
)
COLOR_STYLES = ("color", "background-color", "border-color")

# --- closed value lists -----------------------------------------------------------------------
BINDING_STATES = ("EXACT", "PROBABLE", "AMBIGUOUS", "UNMATCHED")
PROCESS_STATES = ("STABLE", "UNSTABLE", "TIMEOUT", "INSUFFICIENT", "ERROR")
PROFILES = ("DESKTOP", "TABLET", "MOBILE", "CUSTOM")
REQUIRED_PROFILES = ("DESKTOP", "TABLET", "MOBILE")
ID_UNIQUENESS = ("UNIQUE", "DUPLICATE", "MISSING")
SEVERITIES = ("INFO", "WARNING", "ERROR")
SCOPES = ("SEMANTIC", "OPERATIONAL")
SNAPSHOT_STATES = ("AVAILABLE", "PARTIAL", "UNAVAILABLE", "FAILED")
ACTIVE_JOB_STATES = ("PREPARED", "INJECTED", "RECEIVING", "ASSEMBLING")
TERMINAL_JOB_STATES = ("COMPLETE", "FAILED", "CANCELLED", "NAVIGATED", "INTERRUPTED")
STRICT_MODE = "MINIMUM_PYTHON_FEED"
PLAIN_MODE = "RUNTIME_EVIDENCE"
LEGACY_CHUNK_HASH = "LEGACY_UNVERIFIED"
OPERATIONAL_KEYS = (
    "captured_at", "created_at", "confirmed_at", "imported_at", "analysis_set_id",
    "wordpress_bundle_id", "runtime_bundle_id", "session_id", "snapshot_id", "observation_set_id",
    "observation_index", "sample_count", "settle_duration_ms",
)
DANGEROUS_KEYS = ("__proto__", "prototype", "constructor")
INVALID_READINESS_CODES = (
    "OBSERVATION_INDEX_INVALID", "PAGE_FINGERPRINT_MISMATCH", "SOURCE_CONTEXT_REFERENCE_MISMATCH",
    "SOURCE_CONTEXT_INCOMPATIBLE", "SESSION_WORKFLOW_MODE_MISMATCH",
)
FAILURE_BOUNDARIES = (
    "REQUEST_CONSTRUCTION_FAILURE", "TRANSPORT_FAILURE", "LISTENER_FAILURE", "CONTENT_CAPTURE_FAILURE",
    "CHUNK_VALIDATION_FAILURE", "STORAGE_WRITE_FAILURE", "MIGRATION_STORAGE_READ_FAILURE",
    "EXPORT_PREFLIGHT_FAILURE", "PACKAGE_GENERATION_FAILURE", "BROWSER_QUALIFICATION_FAILURE",
    "SERVICE_WORKER_RESTART_RECOVERY_FAILURE", "RESTRICTED_PAGE_ACTIVE_TAB_SCRIPTING_INJECTION_FAILURE",
    "RESPONSE_ENVELOPE_VALIDATION_FAILURE",
)
DIAGNOSTIC_CODES = (
    "UNSUPPORTED_PAGE", "PERMISSION_DENIED", "TAB_NAVIGATED", "ELEMENT_LIMIT_REACHED",
    "STYLE_VALUE_LIMIT_REACHED", "STORAGE_QUOTA_EXCEEDED", "SERIALIZATION_FAILED", "SCREENSHOT_FAILED",
    "PARTIAL_IDENTITY", "IDENTITY_COLLISION", "NON_FINITE_GEOMETRY", "WORKER_INTERRUPTED",
    "EXPORT_VALIDATION_FAILED", "CAPTURE_CANCELLED", "MESSAGE_REJECTED", "SNAPSHOT_SIZE_LIMIT",
    "DEPTH_LIMIT_REACHED", "SCAN_LIMIT_REACHED", "CORRUPT_STORED_SNAPSHOT", "SOURCE_CONTEXT_INVALID",
    "SOURCE_CONTEXT_LIMIT_REACHED", "SOURCE_CONTEXT_NOT_SELECTED", "SOURCE_BINDING_AMBIGUOUS",
    "SOURCE_BINDING_UNMATCHED", "RELATIONSHIP_LIMIT_REACHED", "TEXT_SHAPE_LIMIT_REACHED",
    "READINESS_TIMEOUT", "READINESS_UNSTABLE", "READINESS_ERROR", "LOCATOR_REDACTED",
    "ACTIVE_CAPTURE_EXISTS_FOR_TAB", "ACTIVE_CAPTURE_EXISTS_FOR_SESSION", "SOURCE_CONTEXT_REQUIRED",
    "SOURCE_CONTEXT_INCOMPATIBLE", "DUPLICATE_MEASURED_VIEWPORT", "REQUIRED_PROFILE_ALREADY_CAPTURED",
    "REQUIRED_VIEWPORT_PROFILE_MISSING", "PAGE_FINGERPRINT_MISMATCH", "SCHEMA_ID_NOT_REGISTERED",
    "SOURCE_CONTEXT_NOT_IMPORTED", "SINGLE_VIEWPORT_ONLY", "SCREENSHOT_NOT_REQUESTED",
    "HIDDEN_ELEMENTS_EXCLUDED", "INCOMPLETE_IMAGES_OUTSIDE_VIEWPORT", "DOCUMENT_NOT_FOCUSED",
    "ELEMENTOR_METRIC_INVARIANT_VIOLATION", "DUPLICATE_OBSERVATION_INDEX",
    "NON_CONTIGUOUS_OBSERVATION_INDEX", "ORPHAN_SNAPSHOT", "MISSING_SNAPSHOT",
    "LAZY_LOAD_SWEEP_COMPLETED", "LAZY_LOAD_SWEEP_FAILED", "PAGE_NOT_AT_CANONICAL_SCROLL",
    "PAGE_NOT_VISIBLE", "PAGE_PRERENDERING", "WORDPRESS_ADMIN_BAR_PRESENT_OR_AMBIGUOUS",
    "ELEMENTOR_EDITOR_PREVIEW_NOT_CANONICAL", "IFRAME_CAPTURE_NOT_CANONICAL",
    "VIEWPORT_IMAGES_NOT_READY", "SESSION_WORKFLOW_MODE_MISMATCH", "MALFORMED_RESPONSE",
    "STORAGE_READ_FAILED", "BROWSER_QUALIFICATION_FAILED", "RESTRICTED_PAGE_INJECTION_FAILED",
    "EXPORT_PROVENANCE",
)
