"""Royalty data, catalog, rules and logs made from the given tables.

Each frame has its SQL twin below it, a CTE the check queries start with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.operators import catalog
from cadenza.session import configure

EMPTY_ARTISTS = "id string, owner_user_id string, name string"
EMPTY_ALBUMS = (
    "id string, owner_user_id string, artist_id string, title string, upc string, release_date date"
)
EMPTY_TRACKS = (
    "id string, owner_user_id string, artist_id string, album_id string, isrc string, title string"
)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Its schema is looked up once, so later reads open no file
    before they run."""
    configure(spark)
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _spread(frame: DataFrame) -> DataFrame:
    """Rows of a few files over all cores, before work that costs much per row.

    Input with at least as many splits as cores is left alone, so nothing is
    shuffled where files are many or large.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


#: Bytes of a table's files up to which it is joined as Spark broadcasts it by default.
SMALL_BYTES = 10 * 1024 * 1024
_SMALL: dict[str, bool] = {}


def _is_small(spark: SparkSession, sf: str, name: str) -> bool:
    """Whether a given table's files are few bytes; looked up once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SMALL:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        _SMALL[path] = files.getContentSummary(place).getLength() <= SMALL_BYTES
    return _SMALL[path]


def royalties(spark: SparkSession, sf: str, *extra: str, costly: bool = False) -> DataFrame:
    """The royalty table; `extra` names of dataset_id, owner_user_id, line.

    `costly` tells that much work per row follows, so few files are spread.
    """
    line = table(spark, sf, "lineitem")
    line = (_spread(line) if costly else line).alias("l")
    orders = table(spark, sf, "orders").alias("o")
    customer = table(spark, sf, "customer").alias("c")
    nation = table(spark, sf, "nation").alias("n")
    part = table(spark, sf, "part").alias("p")
    supplier = table(spark, sf, "supplier").alias("s")
    same_order, same_customer, same_nation = map(F.expr, ("l_orderkey = o_orderkey", "o_custkey = c_custkey", "c_nationkey = n_nationkey"))
    if _is_small(spark, sf, "orders"):
        sold = line.join(orders, same_order).join(customer, same_customer).join(nation, same_nation)
    else:  # orders, fewer than lines, get their customer first: the lines are shuffled once for all three
        sold = line.join(orders.join(customer, same_customer).join(nation, same_nation), same_order)
    joined = (
        sold.join(part, F.expr("l_partkey = p_partkey"))
        .join(supplier, F.expr("l_suppkey = s_suppkey"))
    )
    added = {
        "dataset_id": "concat('ds-', cast(n_regionkey as string)) AS dataset_id",
        "owner_user_id": "concat('u-', n_name) AS owner_user_id",
        "line": "l_linenumber AS line",
    }
    return joined.selectExpr(
        "concat('US', lpad(cast(l_partkey as string), 10, '0')) AS isrc",
        "lpad(replace(p_brand, 'Brand#', ''), 12, '0') AS upc",
        "p_name AS title",
        "s_name AS artist",
        "p_brand AS album",
        "o_orderpriority AS platform",
        "n_name AS territory",
        "l_returnflag AS transaction_type",
        "cast(l_shipdate as date) AS reporting_date",
        "cast(l_extendedprice * (1 - l_discount) as decimal(38,9)) AS net_revenue",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'MACHINERY' THEN 'EUR' "
        "WHEN 'HOUSEHOLD' THEN 'GBP' WHEN 'FURNITURE' THEN 'CAD' ELSE 'JPY' END AS currency",
        "cast(l_quantity as bigint) AS quantity",
        *[added[name] for name in extra],
    )


ROYALTY_CTE = """WITH RECURSIVE royalty_data AS (
  SELECT concat('US', lpad(CAST(l.l_partkey AS VARCHAR), 10, '0')) AS isrc,
         lpad(replace(p.p_brand, 'Brand#', ''), 12, '0') AS upc,
         p.p_name AS title, s.s_name AS artist, p.p_brand AS album,
         o.o_orderpriority AS platform, n.n_name AS territory,
         l.l_returnflag AS transaction_type,
         CAST(l.l_shipdate AS DATE) AS reporting_date,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(38,9)) AS net_revenue,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'MACHINERY' THEN 'EUR'
              WHEN 'HOUSEHOLD' THEN 'GBP' WHEN 'FURNITURE' THEN 'CAD' ELSE 'JPY' END AS currency,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         concat('ds-', CAST(n.n_regionkey AS VARCHAR)) AS dataset_id,
         concat('u-', n.n_name) AS owner_user_id,
         l.l_linenumber AS line
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)
"""
COLUMNS = (
    "isrc, upc, title, artist, album, platform, territory, transaction_type, "
    "reporting_date, net_revenue, currency, quantity"
)


def raw_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Royalty rows as untidy report cells: the line number picks how untidy."""
    return royalties(spark, sf, "dataset_id", "line", costly=True).selectExpr(
        "isrc", "upc", "title", "artist", "album", "platform", "territory",
        "transaction_type", "currency", "dataset_id",
        "CASE line WHEN 1 THEN date_format(reporting_date, 'yyyy-MM-dd') "
        "WHEN 2 THEN date_format(reporting_date, 'yyyy/MM/dd') "
        "WHEN 3 THEN date_format(reporting_date, 'MM/dd/yyyy') "
        "WHEN 4 THEN concat(' ', date_format(reporting_date, 'dd/MM/yyyy')) "
        "WHEN 5 THEN date_format(reporting_date, 'yyyy-MM') "
        "WHEN 6 THEN date_format(reporting_date, 'MM/yyyy') "
        "ELSE date_format(reporting_date, 'yyyy-MM-dd HH:mm:ss') END AS date_cell",
        "CASE line WHEN 1 THEN concat('$', cast(net_revenue as string)) "
        "WHEN 2 THEN concat('(', cast(net_revenue as string), ')') "
        "WHEN 3 THEN concat(cast(net_revenue as string), ' USD') "
        "WHEN 4 THEN concat(cast(net_revenue as string), 'e7') "
        "WHEN 5 THEN concat('-', cast(net_revenue as string)) "
        "WHEN 6 THEN '' ELSE concat('1,', cast(net_revenue as string)) END AS amount_cell",
        "CASE line WHEN 1 THEN cast(quantity as string) "
        "WHEN 2 THEN concat(cast(quantity as string), '.0') "
        "WHEN 3 THEN '' WHEN 4 THEN 'abc' "
        "WHEN 5 THEN concat('1,', cast(quantity as string)) "
        "WHEN 6 THEN CAST(NULL AS STRING) ELSE cast(quantity as string) END AS quantity_cell",
    )


RAW_CTE = ROYALTY_CTE + """, raw_cells AS (
  SELECT *,
    CASE line WHEN 1 THEN strftime(reporting_date, '%Y-%m-%d')
      WHEN 2 THEN strftime(reporting_date, '%Y/%m/%d')
      WHEN 3 THEN strftime(reporting_date, '%m/%d/%Y')
      WHEN 4 THEN concat(' ', strftime(reporting_date, '%d/%m/%Y'))
      WHEN 5 THEN strftime(reporting_date, '%Y-%m')
      WHEN 6 THEN strftime(reporting_date, '%m/%Y')
      ELSE strftime(reporting_date, '%Y-%m-%d %H:%M:%S') END AS date_cell,
    CASE line WHEN 1 THEN concat('$', CAST(net_revenue AS VARCHAR))
      WHEN 2 THEN concat('(', CAST(net_revenue AS VARCHAR), ')')
      WHEN 3 THEN concat(CAST(net_revenue AS VARCHAR), ' USD')
      WHEN 4 THEN concat(CAST(net_revenue AS VARCHAR), 'e7')
      WHEN 5 THEN concat('-', CAST(net_revenue AS VARCHAR))
      WHEN 6 THEN '' ELSE concat('1,', CAST(net_revenue AS VARCHAR)) END AS amount_cell,
    CASE line WHEN 1 THEN CAST(quantity AS VARCHAR)
      WHEN 2 THEN concat(CAST(quantity AS VARCHAR), '.0')
      WHEN 3 THEN '' WHEN 4 THEN 'abc'
      WHEN 5 THEN concat('1,', CAST(quantity AS VARCHAR))
      WHEN 6 THEN NULL ELSE CAST(quantity AS VARCHAR) END AS quantity_cell
  FROM royalty_data
), clean_cells AS (
  SELECT *,
    CAST(coalesce(try_strptime(trim(date_cell), '%Y-%m-%d'), try_strptime(trim(date_cell), '%Y/%m/%d'),
      try_strptime(trim(date_cell), '%m/%d/%Y'), try_strptime(trim(date_cell), '%d/%m/%Y'),
      try_strptime(trim(date_cell), '%Y-%m'), try_strptime(trim(date_cell), '%m/%Y'),
      TIMESTAMP '1970-01-01') AS DATE) AS date_value,
    coalesce(TRY_CAST(regexp_replace(amount_cell, '[^0-9.\\-]', '', 'g') AS DECIMAL(38,9)),
      CAST(0 AS DECIMAL(38,9))) AS amount_value,
    coalesce(TRY_CAST(quantity_cell AS BIGINT), 1) AS quantity_value
  FROM raw_cells
)
"""

# Headers of the four layouts: (header, cell of `raw_cells`).
REPORT_COLUMNS = {
    "DistroKid": (
        ("Reporting Month", "date_cell"), ("Store", "platform"), ("Artist", "artist"),
        ("Song Title", "title"), ("ISRC", "isrc"), ("UPC", "upc"),
        ("Quantity", "quantity_cell"), ("Country of Sale", "territory"),
        ("Earnings (USD)", "amount_cell"), ("Currency", "currency"),
    ),
    "TuneCore": (
        ("Sales Period", "date_cell"), ("Store", "platform"), ("Country", "territory"),
        ("Artist", "artist"), ("Release Title", "album"), ("Track Title", "title"),
        ("UPC", "upc"), ("ISRC", "isrc"), ("Sales Type", "transaction_type"),
        ("Quantity", "quantity_cell"), ("Total Earned", "amount_cell"),
        ("Currency", "currency"),
    ),
    "CDBaby": (
        ("Period", "date_cell"), ("Partner", "platform"), ("Artist Name", "artist"),
        ("Track Title", "title"), ("Album Title", "album"), ("UPC", "upc"),
        ("ISRC", "isrc"), ("Country", "territory"), ("Quantity", "quantity_cell"),
        ("Payable", "amount_cell"), ("Currency", "currency"),
    ),
    "Symphonic": (
        ("Reporting Month", "date_cell"), ("DSP", "platform"), ("Track Title", "title"),
        ("UPC", "upc"), ("ISRC", "isrc"), ("Units", "quantity_cell"),
        ("Net Revenue", "amount_cell"),
    ),
}


def raw_report(spark: SparkSession, sf: str, source: str, *carried: str) -> DataFrame:
    """Every royalty row as a report of one layout."""
    cells = raw_cells(spark, sf)
    return cells.select(
        *[F.col(cell).alias(header) for header, cell in REPORT_COLUMNS[source]], *carried
    )


def owned_items(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_items(royalties(spark, sf, "owner_user_id", costly=True))


def label_catalog(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Catalog of one label, kept in the shape the catalog jobs write.

    Each title keeps one artist (the last by name), each brand one album.
    """
    part = table(spark, sf, "part")
    supplier = table(spark, sf, "supplier")
    artist_of = (
        table(spark, sf, "lineitem")
        .join(supplier, F.expr("l_suppkey = s_suppkey"))
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.max("s_name").alias("artist"))
    )
    artists = supplier.selectExpr("concat('ar-', s_name) AS id", "'u-label' AS owner_user_id", "s_name AS name")
    albums = part.select("p_brand").distinct().selectExpr(
        "concat('al-', p_brand) AS id", "'u-label' AS owner_user_id",
        "CAST(NULL AS STRING) AS artist_id", "p_brand AS title",
        "lpad(replace(p_brand, 'Brand#', ''), 12, '0') AS upc", "CAST(NULL AS DATE) AS release_date",
    )
    tracks = part.join(artist_of, "p_partkey").selectExpr(
        "concat('tr-', cast(p_partkey as string)) AS id", "'u-label' AS owner_user_id",
        "concat('ar-', artist) AS artist_id", "concat('al-', p_brand) AS album_id",
        "concat('US', lpad(cast(p_partkey as string), 10, '0')) AS isrc", "p_name AS title",
    )
    return {"artists": artists, "albums": albums, "tracks": tracks, "splits": splits(spark, sf)}


CATALOG_CTES = """, artists AS (
  SELECT concat('ar-', s_name) AS id, 'u-label' AS owner_user_id, s_name AS name FROM supplier
), albums AS (
  SELECT DISTINCT concat('al-', p_brand) AS id, 'u-label' AS owner_user_id,
    CAST(NULL AS VARCHAR) AS artist_id, p_brand AS title,
    lpad(replace(p_brand, 'Brand#', ''), 12, '0') AS upc, CAST(NULL AS DATE) AS release_date
  FROM part
), tracks AS (
  SELECT concat('tr-', CAST(p_partkey AS VARCHAR)) AS id, 'u-label' AS owner_user_id,
    concat('ar-', max(s_name)) AS artist_id, concat('al-', p_brand) AS album_id,
    concat('US', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS isrc, p_name AS title
  FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY p_partkey, p_brand, p_name
)
"""


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on small parts, all brands, suppliers in credit and the workspace."""
    part = table(spark, sf, "part")
    supplier = table(spark, sf, "supplier")
    nothing = "CAST(NULL AS STRING)"
    columns = [
        "id", "workspace_id", "artist_id", "album_id", "track_id", "payee_id", "payee_name",
        "percentage", "effective_from", "effective_to",
    ]

    def rules(rows, key, artist, album, track, payee, pct, start, end):
        return rows.selectExpr(
            f"concat('sp-', {key}) AS id", "'ws-label' AS workspace_id", f"{artist} AS artist_id",
            f"{album} AS album_id", f"{track} AS track_id", f"concat('pa-', {payee}) AS payee_id",
            f"{payee} AS payee_name", f"CAST({pct} AS DECIMAL(5,2)) AS percentage",
            f"{start} AS effective_from", f"{end} AS effective_to",
        ).select(*columns)

    small = part.where("p_size <= 10")
    track = "concat('tr-', cast(p_partkey as string))"
    key = "cast(p_partkey as string)"
    parts = [
        rules(small, f"concat('w-', {key})", nothing, nothing, track,
              "concat('Writer ', p_brand)", "33.33", "DATE'1996-01-01'", "CAST(NULL AS DATE)"),
        rules(small, f"concat('s-', {key})", nothing, nothing, track,
              "concat('Singer ', cast(p_size as string))", "p_size * 5", "DATE'1995-06-01'",
              "date_add(DATE'1998-01-01', p_size * 30)"),
        rules(part.select("p_brand").distinct(), "concat('l-', p_brand)", nothing,
              "concat('al-', p_brand)", nothing, "concat('Label ', p_brand)", "40.00",
              "DATE'1996-01-01'", "DATE'1999-12-31'"),
        rules(part.select("p_brand").distinct(), "concat('p-', p_brand)", nothing,
              "concat('al-', p_brand)", nothing, "concat('Producer ', p_brand)", "70.55",
              "DATE'1998-01-01'", "DATE'2000-06-30'"),
        rules(supplier.where("s_acctbal > 0"), "concat('m-', s_name)",
              "concat('ar-', s_name)", nothing, nothing,
              "concat('Manager ', cast(s_nationkey as string))", "12.50", "CAST(NULL AS DATE)",
              "CAST(NULL AS DATE)"),
        rules(table(spark, sf, "region"), "concat('r-', r_name)", nothing, nothing, nothing,
              "concat('Fund ', r_name)", "1.25", "CAST(NULL AS DATE)", "DATE'2001-01-01'"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


SPLITS_CTE = """, splits AS (
  SELECT concat('sp-w-', CAST(p_partkey AS VARCHAR)) AS id, 'ws-label' AS workspace_id,
    CAST(NULL AS VARCHAR) AS artist_id, CAST(NULL AS VARCHAR) AS album_id,
    concat('tr-', CAST(p_partkey AS VARCHAR)) AS track_id,
    concat('pa-Writer ', p_brand) AS payee_id, concat('Writer ', p_brand) AS payee_name,
    CAST(33.33 AS DECIMAL(5,2)) AS percentage, DATE '1996-01-01' AS effective_from,
    CAST(NULL AS DATE) AS effective_to FROM part WHERE p_size <= 10
  UNION ALL
  SELECT concat('sp-s-', CAST(p_partkey AS VARCHAR)), 'ws-label', NULL, NULL,
    concat('tr-', CAST(p_partkey AS VARCHAR)), concat('pa-Singer ', p_size), concat('Singer ', p_size),
    CAST(p_size * 5 AS DECIMAL(5,2)), DATE '1995-06-01',
    CAST(DATE '1998-01-01' + CAST(p_size * 30 AS INTEGER) AS DATE) FROM part WHERE p_size <= 10
  UNION ALL
  SELECT DISTINCT concat('sp-l-', p_brand), 'ws-label', NULL, concat('al-', p_brand), NULL,
    concat('pa-Label ', p_brand), concat('Label ', p_brand), CAST(40 AS DECIMAL(5,2)),
    DATE '1996-01-01', DATE '1999-12-31' FROM part
  UNION ALL
  SELECT DISTINCT concat('sp-p-', p_brand), 'ws-label', NULL, concat('al-', p_brand), NULL,
    concat('pa-Producer ', p_brand), concat('Producer ', p_brand), CAST(70.55 AS DECIMAL(5,2)),
    DATE '1998-01-01', DATE '2000-06-30' FROM part
  UNION ALL
  SELECT concat('sp-m-', s_name), 'ws-label', concat('ar-', s_name), NULL, NULL,
    concat('pa-Manager ', s_nationkey), concat('Manager ', s_nationkey),
    CAST(12.5 AS DECIMAL(5,2)), NULL, NULL FROM supplier WHERE s_acctbal > 0
  UNION ALL
  SELECT concat('sp-r-', r_name), 'ws-label', NULL, NULL, NULL,
    concat('pa-Fund ', r_name), concat('Fund ', r_name), CAST(1.25 AS DECIMAL(5,2)),
    NULL, DATE '2001-01-01' FROM region
)
"""


def fx_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rates; a day without orders in a currency has none."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    currency = (
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'EUR' WHEN 'HOUSEHOLD' THEN 'GBP' "
        "WHEN 'FURNITURE' THEN 'CAD' ELSE 'JPY' END"
    )
    return (
        orders.join(customer, F.expr("o_custkey = c_custkey"))
        .where("c_mktsegment <> 'BUILDING'")
        .groupBy(F.expr("cast(o_orderdate as date)").alias("date"), F.expr(currency).alias("currency_code"))
        .agg(F.expr("cast(0.5 + (sum(o_orderkey) % 1000) * 0.001234 as decimal(10,6))").alias("rate_to_usd"))
    )


FX_CTE = """, fx_rates AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'EUR' WHEN 'HOUSEHOLD' THEN 'GBP'
      WHEN 'FURNITURE' THEN 'CAD' ELSE 'JPY' END AS currency_code,
    CAST(0.5 + CAST(sum(o_orderkey) % 1000 AS BIGINT) * 0.001234 AS DECIMAL(10,6)) AS rate_to_usd
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'
  GROUP BY 1, 2
)
"""


def workspaces(spark: SparkSession, sf: str) -> DataFrame:
    """One workspace per nation, owned by its first customer."""
    return (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(F.min("c_custkey").alias("owner"))
        .selectExpr(
            "concat('ws-', cast(c_nationkey as string)) AS workspace_id",
            "concat('u-', cast(owner as string)) AS owner_user_id",
        )
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "concat('ws-', cast(c_nationkey as string)) AS workspace_id",
        "concat('u-', cast(c_custkey as string)) AS user_id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'Manager' WHEN 'MACHINERY' THEN 'Admin' "
        "WHEN 'HOUSEHOLD' THEN 'Guest' ELSE 'Viewer' END AS role",
    )


MEMBERS_CTE = """WITH workspaces AS (
  SELECT concat('ws-', c_nationkey) AS workspace_id, concat('u-', min(c_custkey)) AS owner_user_id
  FROM customer GROUP BY c_nationkey
), members AS (
  SELECT concat('ws-', c_nationkey) AS workspace_id, concat('u-', c_custkey) AS user_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Manager' WHEN 'MACHINERY' THEN 'Admin'
      WHEN 'HOUSEHOLD' THEN 'Guest' ELSE 'Viewer' END AS role
  FROM customer
)
"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "concat('ws-', cast(user_id as string)) AS workspace_id",
        "concat('u-', cast(user_id as string)) AS user_id",
        "concat('SELECT SUM(', event_type, ') FROM royalty_data') AS sql_executed",
        "event_id AS row_count",
        "cast(value * 100 as bigint) AS execution_time_ms",
        "ts AS created_at",
    )


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('ds-', cast(l_orderkey as string)) AS dataset_id",
        "CASE l_returnflag WHEN 'A' THEN 'PROCESSING' WHEN 'N' THEN 'READY' ELSE 'FAILED' END AS status",
        "l_partkey AS row_count",
        "l_shipdate AS updated_at",
        "l_linenumber AS seq",
    )


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    return orders.join(customer, F.expr("o_custkey = c_custkey")).selectExpr(
        "concat('ds-', cast(o_orderkey as string)) AS id",
        "concat('ws-', cast(c_nationkey as string)) AS workspace_id",
        "cast(o_totalprice * 100 as bigint) AS file_size_bytes",
        "o_orderdate AS created_at",
    )


DATASETS_CTE = """WITH datasets AS (
  SELECT concat('ds-', o_orderkey) AS id, concat('ws-', c_nationkey) AS workspace_id,
    CAST(trunc(o_totalprice * 100) AS BIGINT) AS file_size_bytes, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""
