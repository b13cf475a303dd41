"""Fixed values.

Word lists, mappings and rates that must be exactly these for results to be
right.  They are data, not logic; order matters wherever a tuple is used.
"""

# --- thresholds -----------------------------------------------------------
CPU_THRESHOLD = 0.30
MEMORY_THRESHOLD = 0.30
MIN_STREAK_ROWS = 24
IDLE_DAYS = 3

# --- rates ----------------------------------------------------------------
ROW_SAVINGS_RATE = 0.6
GCP_WASTE_RATIO = 0.7
AWS_WASTE_RATIO = 0.5
WEEKS_PER_MONTH = 4.33
WEEKS_PER_YEAR = 52
SYSTEM_COST_PER_MONTH = 150.0
REINVEST_SHARE = 0.75

# --- confidence of an estimate ---------------------------------------------
EXACT_MATCH_CONFIDENCE = 1.0
GLOBAL_AVERAGE_CONFIDENCE = 0.3

# --- provider words ---------------------------------------------------------
# Split of the rollup into clouds.
CLOUD_WORDS = {
    "GCP": ("gcp", "google"),
    "AWS": ("aws", "amazon"),
}
# Configurable filter on charges, as regular expressions.
CLOUD_FILTER_PATTERNS = {
    "GCP": ("GCP", "Google Cloud", "google"),
    "AWS": ("AWS", "Amazon Web Services", "amazon"),
}

# --- compute services ---------------------------------------------------------
COMPUTE_WORDS = (
    "compute engine", "cloud run", "app engine", "cloud functions",
    "kubernetes engine", "gke",
    "ec2", "elastic compute", "lambda", "ecs", "fargate", "eks",
    "elastic beanstalk",
    "compute", "vm", "instance", "container", "function",
)

# --- resource type of a raw billing row, by service name ----------------------
RAW_RESOURCE_TYPES = (
    ("Compute", ("engine", "run", "app engine", "kubernetes")),
    ("Storage", ("storage", "filestore", "persistent disk")),
    ("Database", ("sql", "spanner", "firestore", "bigtable", "memorystore")),
    ("Networking", ("cdn", "load balancing", "armor", "vpc")),
    ("Analytics", ("bigquery", "dataflow", "dataproc", "pub/sub")),
    ("AI/ML", ("ai", "ml", "vertex", "dialogflow", "vision", "speech")),
    ("Developer Tools", ("build", "functions", "scheduler", "tasks")),
    ("Monitoring", ("monitoring", "logging", "trace", "profiler")),
    ("Security", ("secret", "kms", "security")),
    ("Container Registry", ("registry", "artifact")),
)

# --- service category -----------------------------------------------------------
SERVICE_CATEGORIES = (
    ("Compute", ("compute engine", "ec2", "amazon ec2", "cloud functions", "lambda",
                 "aws lambda", "cloud run", "ecs", "fargate", "app engine",
                 "elastic beanstalk")),
    ("Container", ("kubernetes engine", "gke", "eks", "amazon eks")),
    ("Database", ("cloud sql", "rds", "amazon rds", "aurora", "dynamodb", "bigtable",
                  "firestore", "elasticache", "redshift")),
    ("Storage", ("cloud storage", "s3", "amazon s3", "persistent disk", "ebs", "efs")),
    ("Analytics", ("bigquery", "athena", "dataproc", "emr", "kinesis", "glue")),
    ("AI_ML", ("vertex ai", "sagemaker", "automl")),
    ("Networking", ("vpc", "cloud load balancing", "elb", "cloudfront", "cloud cdn")),
    ("Monitoring", ("cloud monitoring", "cloudwatch")),
    ("Security", ("iam", "kms", "waf")),
    ("Messaging", ("pub/sub", "sns", "sqs")),
)
# Tried after the list above by the classifier only.
GENERIC_CATEGORIES = (
    ("Compute", ("compute", "instance", "vm")),
    ("Database", ("sql", "database", "db")),
    ("Storage", ("storage", "bucket", "disk")),
    ("Networking", ("network", "vpc", "cdn")),
)

# --- resource type from the service name, for the models --------------------------
CLASSIFIER_RESOURCE_TYPES = (
    ("VM", ("vm", "instance", "ec2", "compute engine")),
    ("Container", ("container", "docker", "ecs", "gke", "eks")),
    ("Function", ("function", "lambda", "serverless")),
    ("Database", ("sql", "database", "rds")),
    ("Storage", ("storage", "s3", "bucket")),
)
BOOSTING_RESOURCE_TYPES = (
    ("VM", ("vm", "instance", "engine", "compute", "ec2")),
    ("Container", ("container", "kubernetes", "ecs", "eks", "gke")),
    ("Function", ("function", "lambda", "cloud functions")),
    ("ObjectStorage", ("storage", "bucket", "s3", "gcs")),
    ("BlockStorage", ("disk", "volume", "ebs")),
    ("Database", ("sql", "database", "rds", "spanner", "dynamodb")),
    ("Network", ("network", "vpc", "load balancer", "cdn")),
)

# --- AWS service -> GCP service, first match wins -----------------------------------
SERVICE_MAPPING = (
    ("Amazon Elastic Compute Cloud", "App Engine"),
    ("AWS Lambda", "Cloud Run"),
    ("Amazon Elastic Container Service", "Cloud Run"),
    ("Amazon Elastic Kubernetes Service", "App Engine"),
    ("Amazon EC2", "App Engine"),
    ("Amazon Simple Storage Service", "Cloud Filestore"),
    ("Amazon Elastic Block Store", "Cloud Filestore"),
    ("Amazon Elastic File System", "Cloud Filestore"),
    ("Amazon S3", "Cloud Filestore"),
    ("Amazon Relational Database Service", "Cloud SQL"),
    ("Amazon DynamoDB", "Cloud SQL"),
    ("Amazon ElastiCache", "Cloud SQL"),
    ("Amazon RDS", "Cloud SQL"),
    ("Amazon Virtual Private Cloud", "Cloud Armor"),
    ("Elastic Load Balancing", "Cloud Armor"),
    ("Amazon CloudFront", "Cloud Armor"),
    ("Amazon VPC", "Cloud Armor"),
    ("Amazon Athena", "Cloud Dataflow"),
    ("Amazon EMR", "Cloud Dataflow"),
    ("Amazon Kinesis", "Cloud Pub/Sub"),
    ("Amazon SageMaker", "Dialogflow"),
    ("Amazon Rekognition", "Dialogflow"),
    ("Amazon Comprehend", "Dialogflow"),
    ("AmazonCloudWatch", "Cloud Monitoring"),
    ("AWS CloudTrail", "Cloud Monitoring"),
    ("AWS Secrets Manager", "Secret Manager"),
    ("AWS KMS", "Secret Manager"),
    ("AWS Step Functions", "Cloud Tasks"),
    ("Amazon SQS", "Cloud Tasks"),
    ("Amazon ECR", "Artifact Registry"),
)
# Used when no mapping file has been written yet.
DEFAULT_SERVICE_MAPPING = (
    ("Amazon Elastic Compute Cloud", "Compute Engine"),
    ("AWS Lambda", "Cloud Functions"),
    ("Amazon Elastic Container Service", "Cloud Run"),
    ("Amazon Elastic Kubernetes Service", "Kubernetes Engine"),
    ("Amazon Simple Storage Service", "Cloud Storage"),
    ("Amazon Elastic Block Store", "Persistent Disk"),
    ("Amazon Elastic File System", "Cloud Filestore"),
    ("Amazon Relational Database Service", "Cloud SQL"),
    ("Amazon DynamoDB", "Cloud Firestore"),
    ("Amazon ElastiCache", "Cloud Memorystore"),
    ("Amazon Virtual Private Cloud", "Virtual Private Cloud"),
    ("Elastic Load Balancing", "Cloud Load Balancing"),
    ("Amazon CloudFront", "Cloud CDN"),
    ("Amazon Athena", "BigQuery"),
    ("Amazon EMR", "Cloud Dataproc"),
    ("Amazon Kinesis", "Cloud Pub/Sub"),
    ("Amazon SageMaker", "Vertex AI"),
    ("Amazon Rekognition", "Cloud Vision API"),
    ("Amazon Comprehend", "Cloud Natural Language"),
    ("AmazonCloudWatch", "Cloud Monitoring"),
    ("AWS CloudTrail", "Cloud Logging"),
)

# --- words that explain a free charge ---------------------------------------------
FREE_CHARGE_WORDS = (
    "free tier", "free", "$0.00", "no charge", "included", "credit",
    "promotional", "trial",
)

# --- column names looked for, in order ----------------------------------------------
CPU_COLUMNS = ("AvgCPUUsage", "SimulatedCPUUsage", "CPUUsage")
MEMORY_COLUMNS = ("AvgMemoryUsage", "SimulatedMemoryUsage", "MemoryUsage")
TIME_COLUMNS = ("HourlyTimestamp", "ChargePeriodStart", "Date", "Timestamp", "Hour")
TIME_COLUMN_WORDS = ("date", "period", "time")

# --- model search spaces and the numbers models are compared with ------------------
FOREST_REGRESSION_SPACE = {
    "numTrees": (50, 100, 200),
    "maxDepth": (5, 10, 15, 20),
    "minSplitWeight": (2, 5, 10),
    "minInstancesPerNode": (1, 2, 5),
    "featureSubsetStrategy": ("sqrt", "log2"),
}
FOREST_CLASSIFICATION_SPACE = {
    "numTrees": (50, 100, 150, 200),
    "maxDepth": (10, 15, 20, 25, -1),
    "minSplitWeight": (2, 5, 10),
    "minInstancesPerNode": (1, 2, 4),
    "featureSubsetStrategy": ("sqrt", "log2", "all"),
    "classWeight": ("balanced", "balanced_subsample", "none"),
}
BOOSTING_SPACE = {
    "maxIter": (50, 100, 150, 200, 300),
    "maxDepth": (3, 5, 7, 10, 15),
    "stepSize": (0.01, 0.05, 0.1, 0.2, 0.3),
    "subsamplingRate": (0.6, 0.7, 0.8, 0.9, 1.0),
    "columnSampling": (0.6, 0.7, 0.8, 0.9, 1.0),
    "l1": (0.0, 0.1, 0.5, 1.0),
    "l2": (0.0, 0.1, 0.5, 1.0),
    "minChildWeight": (1.0, 3.0, 5.0, 7.0),
}
FOREST_BASELINE = {
    "cpu_mae": 0.2369,
    "cpu_r2": 0.0895,
    "memory_mae": 0.2371,
    "memory_r2": 0.0947,
}
RANDOM_GUESS_ACCURACY_PERCENT = 33.33
USAGE_CLASSES = ("Low", "Medium", "High")
