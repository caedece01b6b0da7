"""Schemas and fixed values of the scoring engine."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

# The scoring rules and the index format are defined by these.
MAX_AMOUNT = 10000.0
MAX_INSTALLMENTS = 12.0
AMOUNT_VS_AVG_RATIO = 10.0
MAX_MINUTES = 1440.0
MAX_KM = 1000.0
MAX_TX_COUNT_24H = 20.0
MAX_MERCHANT_AVG_AMOUNT = 10000.0
DIMS = 14
DIMS_PADDED = 16
K = 5
THRESHOLD = 0.6
SCALE = 10000
QUANTISED_LIMIT = 32767
MAX_MERCHANTS = 16
BLOCK_SIZE = 128
MAX_NPROBE = 64
MAX_CENTROIDS = 2048
ADAPTIVE_TARGET = 48
MAX_REPAIR_CANDIDATES = 128
REPAIR_CANDIDATES = 64
REPAIR_MIN, REPAIR_MAX = 1, 4
KMEANS_ITERATIONS = 15
INDEX_VERSIONS = (3, 4, 5)
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_RISK_DEFAULT = 0.5
#: (nprobe, rank bits with the nearest as the lowest bit, largest centroid gap)
RISKY_PATTERNS = [
    (10, 0b00110, 500000), (10, 0b01010, 500000), (10, 0b01100, 600000), (10, 0b10010, 1200000), (10, 0b10011, 500000), (10, 0b10110, 700000), (10, 0b11100, 150000),
    (12, 0b00110, 1600000), (12, 0b01010, 3800000), (12, 0b01100, 1000000), (12, 0b10010, 1800000), (12, 0b10011, 500000), (12, 0b11100, 150000),
]

#: Centroids are kept at 1/CENTROID_FINE of a quantised unit until they are stored, so that all distances are exact integers.
CENTROID_FINE = 64

PAYLOAD = StructType(
    [
        StructField("id", StringType()),
        StructField("transaction", StructType([StructField("amount", DoubleType()), StructField("installments", IntegerType()), StructField("requested_at", StringType())])),
        StructField("customer", StructType([StructField("avg_amount", DoubleType()), StructField("tx_count_24h", IntegerType()), StructField("known_merchants", ArrayType(StringType()))])),
        StructField("merchant", StructType([StructField("id", StringType()), StructField("mcc", StringType()), StructField("avg_amount", DoubleType())])),
        StructField("terminal", StructType([StructField("is_online", BooleanType()), StructField("card_present", BooleanType()), StructField("km_from_home", DoubleType())])),
        StructField("last_transaction", StructType([StructField("timestamp", StringType()), StructField("km_from_current", DoubleType())])),
    ]
)

REFERENCE_ENTRY = StructType([StructField("vector", ArrayType(DoubleType())), StructField("label", StringType())])
