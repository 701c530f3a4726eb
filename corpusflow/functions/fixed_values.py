"""Fixed values that results depend on."""

# File suffixes accepted by the document scan.
DOC_SUFFIXES = (".md", ".mdx", ".txt", ".rst", ".html", ".graphql")

# Platforms, one collection each.
PLATFORMS = ("databricks", "snowflake", "aws", "datahub")

# Retrieval defaults.
TOP_K = 5
SCORE_FLOOR = 0.30
NO_CONTEXT = "No relevant documentation retrieved."

# Chunking defaults.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", " ", "")

# Article extraction tag sets.
MUTED_TAGS = ("script", "style", "nav", "svg", "button", "noscript")
BLOCK_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "pre", "tr", "div")

# Refresh and publish defaults.
MIN_PAGE_CHARS = 200
MAX_AGE_DAYS = 7
MIN_SUCCESS_RATIO = 0.80
MAX_LISTED_FILES = 50

# Kinds of document sources.
SOURCE_TYPES = ("github_dir", "github_file", "botocore_svc", "web_sitemap")
WEB_TYPE = "web_sitemap"

# Session and listing defaults.
MAX_TURNS = 10
MAX_FIELDS = 50
API_DOC_CHARS = 400

# Routing keywords per platform.
ROUTING_KEYWORDS = {
    "databricks": [
        "databricks", "unity catalog", "delta lake", "delta table", "mlflow", "mosaic ai", "dbfs",
        "dlt", "lakeflow", "autoloader", "dbsql", "databricks sql", "medallion", "lakehouse",
    ],
    "snowflake": [
        "snowflake", "cortex", "snowpark", "iceberg", "snowpipe", "virtual warehouse", "time travel",
        "zero-copy clone", "tasks", "streams", "dynamic tables", "cortex analyst",
    ],
    "aws": [
        "aws", "amazon", "s3", "glue", "bedrock", "lambda", "ec2", "ecs", "iam", "cloudformation",
        "cdk", "sagemaker", "athena", "redshift", "step functions", "sns", "sqs", "kinesis",
        "lakeformation", "boto3",
    ],
    "datahub": [
        "datahub", "data hub", "acryl", "urn:li:", "gms", "business glossary", "glossary term",
        "lineage", "metadata ingestion", "ingestion recipe", "ingestion source", "data contract",
        "assertion", "data product", "metadata graph",
    ],
}

# Routing keywords that count twice.
STRONG_ROUTING_KEYWORDS = {
    "databricks": [
        "databricks", "unity catalog", "delta lake", "delta table", "mlflow", "dlt", "lakeflow",
        "dbsql", "databricks sql",
    ],
    "snowflake": ["snowflake", "cortex", "snowpark", "snowpipe", "cortex analyst"],
    "aws": [
        "aws", "amazon", "bedrock", "boto3", "cloudformation", "sagemaker", "athena", "redshift",
        "lakeformation",
    ],
    "datahub": ["datahub", "data hub", "acryl", "urn:li:", "glossary term", "ingestion recipe"],
}
