"""The log record: schema, enumerations and the fixed lists of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()
_D = T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


LOG_SCHEMA = _struct(
    id=_S,
    timestamp=T.TimestampType(),
    service=_struct(
        name=_S, version=_S, environment=_S, instance_id=_S, host=_S, region=_S
    ),
    level=_S,
    category=_S,
    message=_S,
    error=_struct(type=_S, message=_S, stack_trace=_S, code=_S),
    request=_struct(
        id=_S, method=_S, path=_S, user_id=_S, ip=_S, user_agent=_S, duration_ms=_I
    ),
    business=_struct(
        transaction_id=_S,
        amount=T.DecimalType(18, 2),
        currency=_S,
        payment_method=_S,
    ),
    metrics=_struct(
        cpu_usage=_D, memory_mb=_I, response_time_ms=_I, db_query_time_ms=_I
    ),
    tags=T.ArrayType(_S),
    geo=_struct(country=_S, city=_S, location=_struct(lat=_D, lon=_D)),
)

# How each leaf is mapped: (dotted path, mapped type). Drives validation.
LEAF_TYPES: list[tuple[str, str]] = [
    ("id", "keyword"),
    ("timestamp", "date"),
    ("service.name", "keyword"),
    ("service.version", "keyword"),
    ("service.environment", "keyword"),
    ("service.instance_id", "keyword"),
    ("service.host", "keyword"),
    ("service.region", "keyword"),
    ("level", "keyword"),
    ("category", "keyword"),
    ("message", "text"),
    ("error.type", "keyword"),
    ("error.message", "text"),
    ("error.stack_trace", "text"),
    ("error.code", "keyword"),
    ("request.id", "keyword"),
    ("request.method", "keyword"),
    ("request.path", "keyword"),
    ("request.user_id", "keyword"),
    ("request.ip", "ip"),
    ("request.user_agent", "text"),
    ("request.duration_ms", "integer"),
    ("business.transaction_id", "keyword"),
    ("business.amount", "scaled_float"),
    ("business.currency", "keyword"),
    ("business.payment_method", "keyword"),
    ("metrics.cpu_usage", "float"),
    ("metrics.memory_mb", "integer"),
    ("metrics.response_time_ms", "integer"),
    ("metrics.db_query_time_ms", "integer"),
    ("tags", "keyword[]"),
    ("geo.country", "keyword"),
    ("geo.city", "keyword"),
    ("geo.location", "geo_point"),
]

KEYWORD_IGNORE_ABOVE = 256

# --- Fixed values -----------------------------------------------------------
# The enumerations, weights and text lists of the log domain. Results that
# zero-fill a domain or draw synthetic records depend on exactly these values.

LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
LEVEL_WEIGHTS = [5, 15, 60, 15, 4, 1]

ENVIRONMENTS = ["production", "staging", "development"]
ENVIRONMENT_WEIGHTS = [70, 20, 10]

CATEGORIES = ["application", "security", "performance", "audit", "system"]

SERVICES = [
    "api-gateway",
    "auth-service",
    "payment-service",
    "user-service",
    "notification-service",
    "order-service",
    "inventory-service",
    "analytics-service",
    "search-service",
]
SERVICE_WEIGHTS = [25, 15, 10, 12, 8, 10, 8, 7, 5]

REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-south-1"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]
PAYMENT_METHODS = ["credit_card", "debit_card", "paypal", "bank_transfer"]
CURRENCIES = ["USD", "EUR", "GBP", "BRL", "INR"]
EXTRA_TAGS = ["monitoring", "alert", "performance"]

MESSAGES = {
    "trace": [
        "Entering method processRequest in {service}",
        "Executing query on database",
        "Cache lookup for key",
    ],
    "debug": [
        "Processing request with parameters",
        "Database query executed successfully",
        "Cache hit for key",
    ],
    "info": [
        "Request processed successfully",
        "User authenticated successfully",
        "Data synchronized with external service",
        "Batch job completed",
    ],
    "warn": [
        "High memory usage detected",
        "Slow query detected",
        "Deprecated API endpoint used",
        "Rate limit approaching threshold",
    ],
    "error": [
        "Failed to process payment",
        "Database connection timeout",
        "External service unavailable",
        "Validation failed for user input",
    ],
    "fatal": [
        "Critical system failure",
        "Database corruption detected",
        "Out of memory error",
        "Unrecoverable error in core service",
    ],
}

ERROR_MESSAGES = {
    "TimeoutException": ["Connection timeout", "Request timeout after 30s"],
    "DatabaseException": ["Query execution failed", "Connection pool exhausted"],
    "ValidationException": ["Invalid input data", "Missing required field"],
    "AuthenticationException": ["Invalid credentials", "Token expired"],
    "PaymentGatewayException": ["Payment provider timeout", "Insufficient funds"],
    "NetworkException": ["Network unreachable", "Connection refused"],
    "ServiceUnavailableException": [
        "Service temporarily unavailable",
        "Circuit breaker open",
    ],
}
ERROR_TYPES = list(ERROR_MESSAGES)

API_PATHS = {
    "api-gateway": ["/api/v1/health", "/api/v1/users", "/api/v1/orders"],
    "auth-service": ["/auth/login", "/auth/logout", "/auth/refresh"],
    "payment-service": [
        "/payments/process",
        "/payments/refund",
        "/payments/status",
    ],
    "user-service": ["/users/profile", "/users/settings", "/users/delete"],
    "order-service": ["/orders/create", "/orders/update", "/orders/cancel"],
}
DEFAULT_API_PATH = "/api/v1/generic"

SEARCH_PHRASES = [
    "payment gateway timeout error",
    "user authentication successful",
    "order processing completed",
    "high latency detected",
    "inventory synchronization delayed",
]

# Error-log entry kinds.
ERROR_KINDS = ["insertion", "stream", "connection", "serialization", "unknown"]
# --- end of fixed values ----------------------------------------------------

# Own choice: the places synthetic records are drawn from.
COUNTRIES = ["US", "BR", "DE", "FR", "GB", "IN", "JP", "CA", "AU", "ES", "MX", "ZA"]
CITIES = ["Springfield", "Riverton", "Lakeside", "Georgetown", "Fairview"]
