"""Values fixed by the telemetry contract; results depend on them exactly."""

# Upper bounds per metric name.
SAFETY_CAPS = {
    "commits_total": 1_000_000,
    "commits_30d": 100_000,
    "lines_of_code": 10_000_000,
    "repo_stars": 1_000_000,
}

# Counted source suffixes.
SOURCE_SUFFIXES = (".py", ".html", ".css", ".js", ".ts", ".tsx", ".jsx", ".md", ".json")

# Folders whose files are not counted.
EXCLUDED_FOLDERS = (
    ".git", ".vercel", ".venv", "venv", "node_modules", "__pycache__",
    ".pytest_cache", ".mypy_cache", "dist", "build", ".idea",
)

# Fixed value: the page number of the rel="last" link.
LAST_PAGE_PATTERN = r'<[^>]*[?&]page=(\d+)[^>]*>;\s*rel="last"'

# Time rules and contract enums.
CACHE_TTL_SECONDS = 300
HARVEST_SECONDS = 3 * 4  # three calls of a harvest, each at most four seconds
ACTIVITY_WINDOW_DAYS = 30
POLL_SECONDS = 30
SCHEMA_VERSION = 1
STATUSES = ("operational", "degraded", "down")
MODES = ("live", "showcase")
UNKNOWN = "Unknown"
MISSING = "—"

# Titles and subtitles of the metric cards.
COMMITS_TOTAL_TITLE = "Commits · total"
COMMITS_30D_TITLE = "Commits · 30d"
REPO_STARS_TITLE = "Repo stars"
LINES_OF_CODE_TITLE = "Lines of code"
PRIMARY_LANGUAGE_TITLE = "Primary language"
LAST_COMMIT_TITLE = "Last commit"
COMMITS_30D_SUBTITLE = "Trailing 30 days"
LANGUAGE_SUBTITLE = "Mostly "
NO_LANGUAGE_SUBTITLE = "All sources"
