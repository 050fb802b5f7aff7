"""Fixed values shared by the operators: limits, defaults, messages, rules."""

# Limits and defaults.
DEFAULT_LANGUAGE = "en"
DEFAULT_PAGENO = 1
DEFAULT_RESULTS_LIMIT = 20
MAX_RESULTS_LIMIT = 100
DEFAULT_SUBPAGE_LIMIT = 5
MAX_SUBPAGE_LIMIT = 10
MAX_FETCH_CONTENT = 1024 * 1024
MAX_SNIPPET = 10000
SIMPLE_SNIPPET = 200
PRETTY_SNIPPET = 300
EXTRACT_MAX_LENGTH = 512 * 1024
EXTRACT_MAX_BODY_BYTES = 512 * 1024
CACHE_TTL_SECONDS = 86400
CACHE_KEY_VERSION = 2

# Accepted words.
TIME_RANGES = ("day", "month", "year")
CONTENT_FORMATS = ("txt", "markdown", "html")
DEFAULT_CONTENT_FORMAT = "txt"
VALIDATION_MODES = ("strict", "coerce")
DEFAULT_VALIDATION_MODE = "coerce"

# Text pieces of results and reports.
LINKS_MARKER = "\n\nLinks found on this page:"
TRUNCATED_SUFFIX = "...\n[Content truncated]"
NO_RESULTS = "No results found"
REDACTED = "[REDACTED]"

# Error messages.
QUERY_REQUIRED = "Query is required"
URL_REQUIRED = "URL is required"
TIME_RANGE_INVALID = "time_range must be one of: day, month, year"
SCHEMA_REQUIRED = "Error: json_schema is required"
SCHEMA_TYPE = "Error: json_schema must be an object"
CONTENT_EMPTY = "Error: fetched content is empty or whitespace-only after cleaning"
CONTENT_TOO_LONG = "Error: content exceeds EXTRACT_MAX_LENGTH ({limit} Unicode code units)"
BODY_TOO_LARGE = "request body exceeds EXTRACT_MAX_JSON_BODY_BYTES ({limit})"
SIDECAR_EMPTY = "content must be non-empty and not whitespace-only"
SIDECAR_TOO_LONG = "content exceeds EXTRACT_MAX_LENGTH ({limit} Unicode code units)"
FORMAT_INVALID = 'content_format must be one of: "txt", "markdown", "html"'
MODE_INVALID = 'validation_mode must be "strict" or "coerce"'
FETCH_ERROR = "Fetch error: "
HTTP_ERROR = "HTTP Error "
SEARCH_ERROR = "Search error: "
RESPONSE_ERROR = "Error: "
EXTRACTION_FAILED = "extraction failed: "
# Our own message: a url that the page table does not hold.
PAGE_NOT_FOUND = "page not found"
PAGE_WITHOUT_BODY = "page has no body"
# Our own message: an unreadable context.
CONTEXT_INVALID = "extraction_context must be JSON"
