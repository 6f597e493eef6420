"""Fixed schemas and the names a structured query may use."""

from __future__ import annotations

from pyspark.sql import types as T

# The twelve columns every distributor report is brought to.
ROYALTY_SCHEMA = T.StructType(
    [
        T.StructField("isrc", T.StringType(), False),
        T.StructField("upc", T.StringType(), True),
        T.StructField("title", T.StringType(), False),
        T.StructField("artist", T.StringType(), False),
        T.StructField("album", T.StringType(), True),
        T.StructField("platform", T.StringType(), False),
        T.StructField("territory", T.StringType(), True),
        T.StructField("transaction_type", T.StringType(), True),
        T.StructField("reporting_date", T.DateType(), False),
        T.StructField("net_revenue", T.DecimalType(38, 9), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("quantity", T.LongType(), False),
    ]
)
ROYALTY_COLUMNS = ROYALTY_SCHEMA.fieldNames()

# Stored royalty files carry their dataset as a partition column.
DATASET_ID = "dataset_id"
STORED_SCHEMA = T.StructType(
    ROYALTY_SCHEMA.fields + [T.StructField(DATASET_ID, T.StringType(), True)]
)

# Names a structured query may group by or filter on. `country`
# has no column of its own and reads `territory`.
DIMENSIONS = (
    "isrc",
    "upc",
    "title",
    "artist",
    "album",
    "platform",
    "territory",
    "country",
    "transaction_type",
    "reporting_date",
    "currency",
)
DIMENSION_COLUMN = {"country": "territory"}

# Split percentages are NUMERIC(5,2), rates NUMERIC(10,6). A product of
# decimal(38,9) would lose digits, so amounts narrow to this type first.
PERCENT = T.DecimalType(5, 2)
RATE = T.DecimalType(10, 6)
AMOUNT = T.DecimalType(22, 9)
MONEY = T.DecimalType(38, 9)

UNKNOWN_ARTIST = "Unknown Artist"
DEFAULT_CURRENCY = "USD"


class RequestError(ValueError):
    """The request or file cannot be served; the message says why."""
