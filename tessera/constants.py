"""Fixed values.  They must be exactly these for results to agree with existing indexes."""

# --- fixed values: file selection -------------------------------------------------
CODE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".cs", ".rb", ".php"]
DOC_EXTENSIONS = [".md", ".rst", ".txt", ".mdx"]
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json", ".toml", ".ini", ".env", ".ipynb"]
INDEXED_EXTENSIONS = CODE_EXTENSIONS + DOC_EXTENSIONS + [e for e in CONFIG_EXTENSIONS if e != ".env"]
EXCLUDED_NAMES = ["package-lock.json", "yarn.lock"]
EXCLUDED_GLOBS = [
    "*/node_modules/*", "*/.git/*", "*/dist/*", "*/build/*", "*/__pycache__/*",
    "*.min.js", "*.min.css", "*.pb.go", "*_generated.*", "*.lock",
    "package-lock.json", "yarn.lock",
]
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp", ".rb": "ruby", ".php": "php",
    ".md": "markdown", ".rst": "restructuredtext", ".txt": "text", ".mdx": "markdown",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini", ".env": "env",
    ".ipynb": "notebook",
}

# --- fixed values: chunking -------------------------------------------------------
SECTION_MAX_CHARS = 1500
WHOLE_DOC_MAX_CHARS = 2000
LARGE_DEFINITION_LINES = 150
WINDOW_LINES = 100
WINDOW_OVERLAP = 20

# --- fixed values: vectors and ranking --------------------------------------------
SPARSE_SPACE = 1_000_000
FUSION_OFFSET = 60
DEFAULT_TOP_K = 7

# --- fixed values: graph vocabulary -----------------------------------------------
NODE_LABELS = [
    "Repository", "File", "Function", "Class", "Issue", "PullRequest", "Commit", "Contributor",
    "Dependency", "Module", "Label", "Snapshot",
]
REL_TYPES = [
    "CONTAINS", "IMPORTS", "DEFINED_IN", "INHERITS_FROM", "CALLS", "DEPENDS_ON", "MENTIONS", "AUTHORED",
    "MODIFIES", "HAS_LABEL", "REFERENCES", "OPENED", "LABELED", "CLOSES", "TOUCHES",
]
PYTHON_STDLIB = [
    "os", "sys", "re", "json", "ast", "math", "datetime", "typing", "collections", "itertools", "functools",
    "pathlib", "logging", "asyncio", "hashlib", "time", "uuid", "subprocess", "random", "urllib", "threading",
    "queue", "concurrent", "unittest", "pytest", "argparse", "sqlite3", "csv", "xml", "html", "http", "socket",
    "ssl", "email", "base64", "configparser", "contextlib", "copy",
]
HIDDEN_GRAPH_PROPERTIES = ["health_report", "health_report_commit_sha", "health_checked_at", "snapshot"]

# --- fixed values: question routing -----------------------------------------------
CALL_ROUTE_TERMS = ["calls", "called by", "call graph", "who calls", "what calls"]
IMPORT_ROUTE_TERMS = [
    "import ", "imports", "imported by", "depends on", "dependency", "package", "module usage",
]
HISTORY_ROUTE_TERMS = ["history", "modified", "changed", "pr ", "pull request", "commit"]
DEPENDENCY_HINTS = ["dependency", "package", "module usage", "imports"]
TARGET_STOPWORDS = [
    "who", "what", "where", "imports", "import", "imported", "by", "dependency", "usage", "of", "package",
    "module", "depends", "on",
]
SECRET_TERMS = [
    "env file", ".env", "environment file", "api key", "apikey", "secret", "password", "passwd", "token",
    "credential", "private key", "access key",
]
SECRET_VERBS = [
    "content", "contents", "show", "print", "reveal", "what is", "what are", "give", "share", "dump", "value",
    "values",
]
HIDDEN_SOURCE_TEXT = "[REDACTED: sensitive configuration content is not shown]"

# --- fixed values: health evidence, in pick order ---------------------------------
EVIDENCE_PATTERNS = [
    (".env", "environment and secrets surface"),
    ("requirements", "python dependencies"),
    ("package.json", "javascript dependencies"),
    ("pyproject", "python project configuration"),
    ("docker", "container/deployment configuration"),
    ("test", "test coverage signals"),
    ("auth", "authentication and authorization surface"),
    ("middleware", "request middleware surface"),
    ("config", "configuration surface"),
]
EVIDENCE_FILLER_REASON = "representative indexed chunk"
REPORT_SECTION_TITLES = [
    "Overall Summary", "Architecture And Coupling Signals", "Security-Sensitive Areas To Review",
    "Secret Exposure Signals", "Dependency Surface", "Testing And Maintainability Signals",
    "Recommended Next Actions", "Evidence Reviewed",
]

# --- fixed values: jobs, events, limits -------------------------------------------
TERMINAL_STATES = ["done", "error", "lost"]
LOST_JOB_MESSAGE = "No events are known for this job."
JOB_MAX_AGE_SECONDS = 3600
LIMITS = {
    "repo_count_limit": (2, "repos"),
    "repo_too_large": (500, "MB"),
    "too_many_files": (500, "files"),
    "too_many_chunks": (3000, "chunks"),
}
DAILY_QUOTA = {"ingest": ("daily_ingest_limit", 2), "query": ("daily_query_limit", 30), "health": ("health_check_limit", 1)}
