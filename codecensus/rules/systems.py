"""External systems and how code or configuration betrays that it uses them."""

# Fixed values: (id, name, kind, technology, case-insensitive pattern).
SIGNATURES = (
    ("postgres", "PostgreSQL", "database", "PostgreSQL",
     r"""postgres(?:ql)?://|\bpsycopg2?\b|\basyncpg\b|\bpg\.Pool\b|require\(['\"]pg['\"]\)|from\s+['\"]pg['\"]|Npgsql|jdbc:postgresql|POSTGRES_(?:HOST|USER|DB|PASSWORD)|gorm\.io/driver/postgres|lib/pq"""),
    ("mysql", "MySQL / MariaDB", "database", "MySQL",
     r"mysql(?:2)?://|jdbc:mysql|\bmysql2?\b|MySqlConnection|go-sql-driver/mysql|MYSQL_(?:HOST|USER|DATABASE|ROOT_PASSWORD)|mariadb"),
    ("sqlite", "SQLite", "database", "SQLite",
     r"sqlite3?://|\bsqlite3\b|\.sqlite3?\b|Microsoft\.Data\.Sqlite|mattn/go-sqlite3"),
    ("mssql", "SQL Server", "database", "Microsoft SQL Server",
     r"jdbc:sqlserver|SqlConnection|mssql://|Server=.*Database=|System\.Data\.SqlClient|denisenkom/go-mssqldb"),
    ("oracle", "Oracle Database", "database", "Oracle",
     "jdbc:oracle|cx_Oracle|oracledb|OracleConnection"),
    ("cockroach", "CockroachDB", "database", "CockroachDB",
     "cockroach(?:db|labs)"),
    ("mongodb", "MongoDB", "database", "MongoDB",
     r"mongodb(?:\+srv)?://|\bpymongo\b|\bmongoose\b|MongoClient|MONGO_(?:URI|URL|HOST)|go\.mongodb\.org"),
    ("redis", "Redis", "cache", "Redis",
     r"redis://|rediss://|\bioredis\b|\bredis\.createClient|StrictRedis|Redis\(|go-redis|StackExchange\.Redis|REDIS_(?:URL|HOST)"),
    ("memcached", "Memcached", "cache", "Memcached",
     "memcached?|pylibmc|gomemcache"),
    ("dynamodb", "DynamoDB", "database", "AWS DynamoDB",
     r"""DynamoDB|dynamodb|boto3\.resource\(['\"]dynamodb"""),
    ("cassandra", "Cassandra", "database", "Apache Cassandra",
     "cassandra|datastax|cqlsh|gocql"),
    ("neo4j", "Neo4j", "database", "Neo4j",
     "neo4j://|bolt://|neo4j-driver"),
    ("clickhouse", "ClickHouse", "database", "ClickHouse",
     "clickhouse"),
    ("snowflake", "Snowflake", "database", "Snowflake",
     r"snowflake(?:-connector|\.com|_conn)"),
    ("bigquery", "BigQuery", "database", "Google BigQuery",
     "bigquery|BigQueryClient"),
    ("couchbase", "Couchbase", "database", "Couchbase",
     "couchbase"),
    ("influx", "InfluxDB", "database", "InfluxDB",
     "influxdb"),
    ("supabase", "Supabase", "database", "Supabase",
     "supabase"),
    ("firebase", "Firebase", "database", "Google Firebase",
     "firebase|firestore|FIREBASE_(?:API_KEY|PROJECT)"),
    ("elasticsearch", "Elasticsearch / OpenSearch", "search", "Elasticsearch",
     "elasticsearch|opensearch|ELASTIC_(?:URL|HOST)"),
    ("algolia", "Algolia", "search", "Algolia",
     "algolia"),
    ("meilisearch", "Meilisearch", "search", "Meilisearch",
     "meilisearch"),
    ("kafka", "Apache Kafka", "queue", "Kafka",
     r"\bkafka\b|KafkaProducer|KafkaConsumer|confluent[_-]kafka|segmentio/kafka-go|KAFKA_(?:BROKERS|BOOTSTRAP)"),
    ("rabbitmq", "RabbitMQ", "queue", "RabbitMQ",
     r"amqps?://|\bpika\b|\bamqplib\b|RabbitMQ|streadway/amqp"),
    ("sqs", "AWS SQS", "queue", "Amazon SQS",
     r"""\bSQS\b|sqs\.amazonaws\.com|boto3\.client\(['\"]sqs"""),
    ("sns", "AWS SNS", "queue", "Amazon SNS",
     r"""\bSNS\b|sns\.amazonaws\.com|boto3\.client\(['\"]sns"""),
    ("eventbridge", "AWS EventBridge", "queue", "EventBridge",
     r"EventBridge|events\.amazonaws\.com"),
    ("pubsub", "Google Pub/Sub", "queue", "Google Pub/Sub",
     "pubsub|PubSubClient|google-cloud-pubsub"),
    ("servicebus", "Azure Service Bus", "queue", "Azure Service Bus",
     r"ServiceBus|servicebus\.windows\.net"),
    ("nats", "NATS", "queue", "NATS",
     r"nats://|nats\.go|\bnats-py\b|jetstream"),
    ("mqtt", "MQTT broker", "queue", "MQTT",
     "mqtt://|paho|mosquitto"),
    ("celery", "Celery workers", "queue", "Celery",
     r"\bcelery\b|CELERY_BROKER"),
    ("sidekiq", "Sidekiq", "queue", "Sidekiq",
     "sidekiq"),
    ("bullmq", "BullMQ", "queue", "BullMQ",
     r"bullmq|new Queue\("),
    ("temporal", "Temporal", "queue", "Temporal",
     r"temporal\.io|temporalio"),
    ("s3", "AWS S3", "storage", "Amazon S3",
     r"""\bS3\b|s3://|s3\.amazonaws\.com|boto3\.client\(['\"]s3|@aws-sdk/client-s3|AWS_S3_BUCKET"""),
    ("gcs", "Google Cloud Storage", "storage", "GCS",
     r"storage\.googleapis\.com|google-cloud-storage|gs://"),
    ("azureblob", "Azure Blob Storage", "storage", "Azure Blob",
     r"blob\.core\.windows\.net|BlobServiceClient|azure-storage-blob"),
    ("minio", "MinIO", "storage", "MinIO",
     r"\bminio\b"),
    ("cloudinary", "Cloudinary", "storage", "Cloudinary",
     "cloudinary"),
    ("auth0", "Auth0", "auth", "Auth0",
     "auth0"),
    ("okta", "Okta", "auth", "Okta",
     r"\bokta\b"),
    ("keycloak", "Keycloak", "auth", "Keycloak",
     "keycloak"),
    ("cognito", "AWS Cognito", "auth", "Cognito",
     "cognito"),
    ("entra", "Microsoft Entra ID", "auth", "Entra ID / Azure AD",
     r"login\.microsoftonline\.com|AzureAD|MicrosoftIdentity|msal"),
    ("oauth", "OAuth / OIDC provider", "auth", "OAuth2 / OIDC",
     r"oauth2?|openid[-_]?connect|\.well-known/openid-configuration"),
    ("jwt", "JWT tokens", "auth", "JWT",
     r"\bjsonwebtoken\b|\bPyJWT\b|jwt\.sign|jwt\.decode|Bearer "),
    ("ldap", "LDAP / Active Directory", "auth", "LDAP",
     r"ldaps?://|ldap3|System\.DirectoryServices"),
    ("stripe", "Stripe", "payment", "Stripe",
     r"\bstripe\b|STRIPE_(?:SECRET|API)_KEY"),
    ("paypal", "PayPal", "payment", "PayPal",
     "paypal"),
    ("adyen", "Adyen", "payment", "Adyen",
     "adyen"),
    ("braintree", "Braintree", "payment", "Braintree",
     "braintree"),
    ("vipps", "Vipps", "payment", "Vipps",
     r"\bvipps\b"),
    ("klarna", "Klarna", "payment", "Klarna",
     "klarna"),
    ("sendgrid", "SendGrid", "mail", "SendGrid",
     "sendgrid"),
    ("ses", "AWS SES", "mail", "Amazon SES",
     r"""\bSES\b|email\.amazonaws\.com|boto3\.client\(['\"]ses"""),
    ("mailgun", "Mailgun", "mail", "Mailgun",
     "mailgun"),
    ("smtp", "SMTP server", "mail", "SMTP",
     "smtp://|smtplib|SMTP_(?:HOST|PORT|USER)|nodemailer"),
    ("twilio", "Twilio", "mail", "Twilio",
     "twilio"),
    ("slack", "Slack", "api", "Slack API",
     r"hooks\.slack\.com|slack_sdk|@slack/"),
    ("teams", "Microsoft Teams", "api", "Teams webhook",
     r"outlook\.office\.com/webhook|teams\.microsoft\.com"),
    ("sentry", "Sentry", "observability", "Sentry",
     "sentry"),
    ("datadog", "Datadog", "observability", "Datadog",
     "datadog|dd-trace|DD_API_KEY"),
    ("prometheus", "Prometheus", "observability", "Prometheus",
     r"prometheus|/metrics\b|prom_client"),
    ("grafana", "Grafana", "observability", "Grafana",
     "grafana"),
    ("otel", "OpenTelemetry collector", "observability", "OpenTelemetry",
     "opentelemetry|otel[-_]|OTEL_EXPORTER"),
    ("newrelic", "New Relic", "observability", "New Relic",
     "newrelic|new_relic"),
    ("elk", "Logstash / ELK", "observability", "Logstash",
     "logstash|filebeat"),
    ("appinsights", "Azure Application Insights", "observability", "App Insights",
     "ApplicationInsights|APPINSIGHTS_"),
    ("openai", "OpenAI API", "ai", "OpenAI",
     r"api\.openai\.com|\bopenai\b|OPENAI_API_KEY"),
    ("anthropic", "Anthropic API", "ai", "Anthropic",
     r"api\.anthropic\.com|anthropic|ANTHROPIC_API_KEY"),
    ("bedrock", "AWS Bedrock", "ai", "Bedrock",
     "bedrock"),
    ("vertex", "Google Vertex AI", "ai", "Vertex AI",
     "vertexai|aiplatform"),
    ("huggingface", "Hugging Face", "ai", "Hugging Face",
     r"huggingface|transformers\b"),
    ("ollama", "Ollama", "ai", "Ollama",
     "ollama"),
    ("aws", "AWS", "api", "Amazon Web Services",
     r"\bboto3\b|aws-sdk|amazonaws\.com|AWS_ACCESS_KEY_ID|@aws-sdk/"),
    ("gcp", "Google Cloud", "api", "Google Cloud",
     r"google-cloud|googleapis\.com|GOOGLE_APPLICATION_CREDENTIALS"),
    ("azure", "Microsoft Azure", "api", "Azure",
     r"azure-|Azure\.Identity|AZURE_(?:CLIENT_ID|TENANT_ID)|\.azure\.com"),
    ("k8sapi", "Kubernetes API", "api", "Kubernetes",
     r"kubernetes\.client|client-go|KUBERNETES_SERVICE_HOST"),
    ("docker", "Docker daemon", "api", "Docker",
     r"/var/run/docker\.sock|docker\.from_env"),
    ("vault", "HashiCorp Vault", "auth", "Vault",
     "hashicorp/vault|VAULT_ADDR|hvac"),
    ("github", "GitHub API", "api", "GitHub",
     r"api\.github\.com|@octokit|PyGithub|GITHUB_TOKEN"),
    ("gitlab", "GitLab API", "api", "GitLab",
     r"gitlab\.com/api|python-gitlab"),
    ("jira", "Jira", "api", "Atlassian Jira",
     r"atlassian\.net|jira"),
    ("salesforce", "Salesforce", "api", "Salesforce",
     r"salesforce|force\.com"),
    ("shopify", "Shopify", "api", "Shopify",
     "shopify"),
    ("maps", "Maps provider", "api", "Maps API",
     r"maps\.googleapis\.com|mapbox"),
    ("graphql_client", "GraphQL upstream", "api", "GraphQL",
     "ApolloClient|graphql-request"),
    ("grpc_client", "gRPC upstream", "api", "gRPC",
     r"grpc\.Dial|grpc\.insecure_channel|createChannel"),
)

# Outbound URL, hosts that are local, hosts that are documentation.
URL = r"https?://([a-zA-Z0-9._\-]+\.[a-zA-Z]{2,})(?::\d+)?(/[\w./\-{}$:]*)?"
LOCAL_HOST = r"^(localhost|127\.0\.0\.1|0\.0\.0\.0|host\.docker\.internal|example\.(com|org)|schemas?\..*|www\.w3\.org|.*\.local)$"
DOC_HOST = r"(github\.com|gitlab\.com|npmjs\.com|pypi\.org|golang\.org|apache\.org|mit-license\.org|stackoverflow\.com|wikipedia\.org|readthedocs\.io|medium\.com|youtube\.com|docs\.|opensource\.org|creativecommons\.org|json-schema\.org|maven\.apache\.org|shields\.io|badge\.|img\.|fonts\.googleapis\.com|cdn\.jsdelivr\.net|unpkg\.com|cdnjs\.cloudflare\.com)"

# Ways of reading an environment variable; shell names are no configuration.
ENV_READ = r"""(?:os\.(?:getenv|environ(?:\.get)?)\s*\(?\s*["']([A-Z][A-Z0-9_]{2,})["']|process\.env\.([A-Z][A-Z0-9_]{2,})|process\.env\[["']([A-Z][A-Z0-9_]{2,})["']\]|System\.getenv\(\s*["']([A-Z][A-Z0-9_]{2,})["']|os\.Getenv\(\s*["']([A-Z][A-Z0-9_]{2,})["']|ENV\[["']([A-Z][A-Z0-9_]{2,})["']\]|Environment\.GetEnvironmentVariable\(\s*["']([A-Z][A-Z0-9_]{2,})["']|\$\{?([A-Z][A-Z0-9_]{2,})\}?)"""
SHELL_NAMES = ("PATH", "HOME", "USER", "PWD", "SHELL", "LANG", "TERM")

# First needle found in the name decides the kind.
ENV_KINDS = (
    ("DATABASE", "database"),
    ("DB_", "database"),
    ("POSTGRES", "database"),
    ("MYSQL", "database"),
    ("MONGO", "database"),
    ("REDIS", "cache"),
    ("KAFKA", "queue"),
    ("RABBIT", "queue"),
    ("AMQP", "queue"),
    ("S3", "storage"),
    ("BUCKET", "storage"),
    ("SMTP", "mail"),
    ("MAIL", "mail"),
    ("STRIPE", "payment"),
    ("AUTH", "auth"),
    ("OAUTH", "auth"),
    ("JWT", "auth"),
    ("API_KEY", "api"),
    ("TOKEN", "auth"),
    ("SENTRY", "observability"),
    ("OTEL", "observability"),
    ("AWS", "api"),
    ("AZURE", "api"),
    ("GCP", "api"),
)

# Container image -> (pattern, name, kind, technology), first match wins.
IMAGES = (
    ("postgres|timescale|pgvector", "PostgreSQL", "database", "PostgreSQL"),
    ("mysql|mariadb", "MySQL / MariaDB", "database", "MySQL"),
    ("mongo", "MongoDB", "database", "MongoDB"),
    ("redis|valkey", "Redis", "cache", "Redis"),
    ("memcached", "Memcached", "cache", "Memcached"),
    ("kafka|redpanda|cp-kafka", "Apache Kafka", "queue", "Kafka"),
    ("zookeeper", "ZooKeeper", "queue", "ZooKeeper"),
    ("rabbitmq", "RabbitMQ", "queue", "RabbitMQ"),
    ("nats", "NATS", "queue", "NATS"),
    ("elasticsearch|opensearch", "Elasticsearch / OpenSearch", "search", "Elasticsearch"),
    ("minio", "MinIO", "storage", "MinIO"),
    ("localstack", "LocalStack (AWS emulation)", "api", "LocalStack"),
    ("clickhouse", "ClickHouse", "database", "ClickHouse"),
    ("cassandra|scylla", "Cassandra", "database", "Cassandra"),
    ("neo4j", "Neo4j", "database", "Neo4j"),
    ("prometheus", "Prometheus", "observability", "Prometheus"),
    ("grafana", "Grafana", "observability", "Grafana"),
    ("jaeger|zipkin|tempo", "Tracing backend", "observability", "Jaeger/Zipkin"),
    ("keycloak", "Keycloak", "auth", "Keycloak"),
    ("vault", "HashiCorp Vault", "auth", "Vault"),
    ("nginx|traefik|caddy|haproxy|envoy", "Reverse proxy / ingress", "api", "Nginx/Traefik"),
    ("mailhog|mailpit|maildev", "Mail catcher (dev)", "mail", "MailHog"),
    ("sqlserver|mssql", "SQL Server", "database", "SQL Server"),
    ("influxdb", "InfluxDB", "database", "InfluxDB"),
    ("temporalio", "Temporal", "queue", "Temporal"),
)
