"""Table schemas, as DDL strings."""

RESULTS_RAW = "ARRAY<STRUCT<query: STRING, user_agent: STRING, proxy: STRING, urls: ARRAY<STRING>, chunk: BIGINT>>"
RESULTS_LINE = "query STRING, user_agent STRING, proxy STRING, urls ARRAY<STRING>"

#: one row per (query, url); ``pos`` carries the rank order, since partitions have none
RESULTS = "query STRING, url STRING, pos BIGINT, file STRING"

QUERIES = "query STRING, pos BIGINT"

#: one row per template entry, in file order
TEMPLATE = (
    "key STRING, ord INT, extract STRING, extract_prepend STRING, extract_append STRING, "
    "validate STRING, validate_browser BOOLEAN, validate_browser_wait DOUBLE, "
    "validate_headers MAP<STRING, STRING>, validate_cookies MAP<STRING, STRING>"
)

#: what an outside fetcher delivers
RESPONSES = "url STRING, final_url STRING, status INT, body BINARY, text STRING, error STRING"

INPUTS = "url STRING, key STRING, file STRING"

EXTRACTION = "extraction"
VALIDATION = "validation"

SUCCESS = "success"
NO_MATCH = "no_match"
ERROR = "error"
