"""Column layouts of the engine's inputs and tables (Spark DDL)."""

FILES = (
    "user_id string, is_public boolean, repo string, branch string, commit_sha string, "
    "path string, size bigint, file_sha string, content string"
)
LISTING = "path string, type string, size bigint, sha string"
PREVIOUS_FILES = "user_id string, repo string, branch string, path string, file_sha string"

_RECORD = (
    "number int, title string, state string, body string, created_at string, "
    "user struct<login:string,type:string>, labels array<struct<name:string>>"
)
ISSUES = _RECORD + ", pull_request string"
PULL_REQUESTS = _RECORD + ", merged_at string, base struct<ref:string>, head struct<ref:string>"
PR_FILES = "pr_number int, filename string, status string, additions int, deletions int"
COMMITS = (
    "sha string, commit struct<message:string,author:struct<date:string>>, "
    "author struct<login:string,type:string>, files array<struct<filename:string,status:string>>"
)
WEBHOOKS = (
    "delivery_id string, ts timestamp, event string, "
    "repository struct<full_name:string,name:string,owner:struct<login:string>>, ref string, "
    "commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>, "
    f"pull_request struct<{_RECORD.replace(' string', ':string').replace(' int', ':int').replace(' struct', ':struct').replace(' array', ':array')},merged_at:string>, "
    f"issue struct<{_RECORD.replace(' string', ':string').replace(' int', ':int').replace(' struct', ':struct').replace(' array', ':array')}>"
)

CHUNKS = (
    "chunk_id string, user_id string, is_public boolean, repo string, branch string, commit_sha string, "
    "file_sha string, ingest_run_id string, run_seq bigint, ordinal int, file_path string, language string, "
    "source_type string, chunk_type string, function_name string, class_name string, signature string, "
    "start_line int, end_line int, section_title string, text string, full_body string, large_function boolean, "
    "issue_number int, pr_number int, state string, labels array<string>, secrets_redacted int, "
    "security_censored boolean, indexed_at timestamp, metadata map<string,string>"
)
NODES = (
    "id string, label string, raw_id string, user_id string, is_public boolean, repo string, branch string, "
    "name string, path string, props map<string,string>"
)
EDGES = "src string, dst string, rel_type string, user_id string, repo string, branch string, props map<string,string>"
INGEST_EVENTS = (
    "job_id string, user_id string, repo string, seq bigint, ts timestamp, type string, state string, "
    "stage string, message string, meta map<string,string>"
)
QUESTIONS = (
    "qid bigint, user_id string, query string, repo string, branch string, language string"
)


def columns_of(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
