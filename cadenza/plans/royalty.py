"""Queries over the royalty table: ingestion, structured requests, payouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import cleaning
from cadenza.functions.music import normalize_platform
from cadenza.operators import access, catalog, fx, history, paging, splits, structured, summary
from cadenza.operators.normalize import dataset_row_counts, normalize, rejects, union_reports
from cadenza.plans import fixtures as fx_data
from cadenza.plans.fixtures import (
    CATALOG_CTES,
    COLUMNS,
    DATASETS_CTE,
    FX_CTE,
    MEMBERS_CTE,
    RAW_CTE,
    ROYALTY_CTE,
    SPLITS_CTE,
    royalties,
    table,
)
from cadenza.plans.registry import query
from cadenza.session import staged
from cadenza.sources.detect import detect_source, source_of
from cadenza.sources.files import json_rows

R = ROYALTY_CTE
PAY = ROYALTY_CTE + CATALOG_CTES + SPLITS_CTE

# --- sources -----------------------------------------------------------------

HEADERS = {
    "en": "Sales Period,Store,Track Title,ISRC,Sales Type,Total Earned",
    "de": "Period,Partner,Track Title,ISRC,Payable",
    "fr": "Reporting Month,DSP,Track Title,ISRC,Net Revenue",
}


def _report_text():
    header = F.lit("Reporting Month,Store,Song Title,ISRC,Earnings (USD)")
    for lang, line in HEADERS.items():
        header = F.when(F.col("lang") == lang, line).otherwise(header)
    return F.concat(header, F.lit("\n"), F.col("text"))


REPORT_TEXT_SQL = (
    "concat(CASE lang "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADERS.items())
    + " ELSE 'Reporting Month,Store,Song Title,ISRC,Earnings (USD)' END, chr(10), text)"
)
DETECT_CTE = f"""WITH snippets AS (
  SELECT doc_id, source, lower(coalesce(try(decode(encode({REPORT_TEXT_SQL})[1:1024])), '')) AS s
  FROM documents
), detected AS (
  SELECT doc_id, source,
    CASE WHEN s LIKE '%sales type%' OR s LIKE '%total earned%' THEN 'TuneCore'
         WHEN s LIKE '%partner%' OR s LIKE '%payable%' THEN 'CDBaby'
         WHEN s LIKE '%dsp%' OR s LIKE '%net revenue%' THEN 'Symphonic'
         ELSE 'DistroKid' END AS detected
  FROM snippets
)
"""


@query("detect_source", DETECT_CTE + "SELECT doc_id, detected FROM detected")
def _(spark, sf):
    content = F.encode(_report_text(), "UTF-8")
    return table(spark, sf, "documents").select("doc_id", detect_source(content).alias("detected"))


DECLARED = {"src0": " Tune_Core ", "src1": "CDBABY", "src2": "distro_kid", "src3": "Symphonic"}


@query(
    "source_name",
    DETECT_CTE
    + """SELECT doc_id, CASE source WHEN 'src0' THEN 'TuneCore' WHEN 'src1' THEN 'CDBaby'
      WHEN 'src2' THEN 'DistroKid' WHEN 'src3' THEN 'Symphonic' ELSE detected END AS source_name
    FROM detected""",
)
def _(spark, sf):
    declared = F.lit("someone else")
    for source, name in DECLARED.items():
        declared = F.when(F.col("source") == source, name).otherwise(declared)
    content = F.encode(_report_text(), "UTF-8")
    return table(spark, sf, "documents").select(
        "doc_id", source_of(declared, content).alias("source_name")
    )


@query(
    "result_json",
    R
    + """SELECT '[' || to_json(platform) || ',' || to_json(territory) || ',' ||
      CAST(CAST(sum(net_revenue) AS DECIMAL(38,9)) AS VARCHAR) || ',' || CAST(sum(quantity) AS VARCHAR) || ']' AS "row"
    FROM royalty_data GROUP BY platform, territory""",
)
def _(spark, sf):
    result = structured.structured_query(
        royalties(spark, sf), ["platform", "territory"], ["net_revenue", "quantity"], limit=None
    )
    return json_rows(result)


# --- normalization -----------------------------------------------------------


def _norm_sql(source: str) -> str:
    shown = {
        "DistroKid": {"album": "''", "transaction_type": "''", "currency": "'USD'"},
        # `Country` holds `count` and comes before `Quantity`; `Release Title`
        # holds `title` and comes before `Track Title`.
        "TuneCore": {"title": "album", "quantity": "1"},
        "CDBaby": {"transaction_type": "''"},
        "Symphonic": {
            "artist": "'Unknown Artist'", "album": "''", "territory": "''",
            "transaction_type": "''", "currency": "'USD'",
        },
    }[source]
    base = {
        "reporting_date": "date_value", "net_revenue": "amount_value",
        "quantity": "quantity_value",
    }
    columns = []
    for name in COLUMNS.split(", "):
        text = shown.get(name, base.get(name, name))
        columns.append(f"CAST({text} AS BIGINT) AS {name}" if name == "quantity" else f"{text} AS {name}")
    return f"SELECT {', '.join(columns)} FROM clean_cells"


def _register_norm(source: str) -> None:
    @query(f"norm_{source.lower()}", RAW_CTE + _norm_sql(source))
    def _(spark, sf):
        return normalize(fx_data.raw_report(spark, sf, source), source)


for _source in ("DistroKid", "TuneCore", "CDBaby", "Symphonic"):
    _register_norm(_source)


@query("norm_dates", RAW_CTE + "SELECT date_cell, date_value, count(*) AS n FROM clean_cells GROUP BY 1, 2")
def _(spark, sf):
    value = cleaning.report_date(F.col("date_cell"))
    return (
        fx_data.raw_cells(spark, sf)
        .groupBy("date_cell", value.alias("date_value"))
        .agg(F.count("*").alias("n"))
    )


@query("norm_amounts", RAW_CTE + "SELECT amount_cell, amount_value FROM clean_cells")
def _(spark, sf):
    value = cleaning.amount(F.col("amount_cell"))
    return fx_data.raw_cells(spark, sf).select("amount_cell", value.alias("amount_value"))


@query(
    "norm_quantity",
    RAW_CTE + "SELECT quantity_cell, quantity_value, count(*) AS n FROM clean_cells GROUP BY 1, 2",
)
def _(spark, sf):
    value = cleaning.quantity(F.col("quantity_cell"))
    return (
        fx_data.raw_cells(spark, sf)
        .groupBy("quantity_cell", value.alias("quantity_value"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "norm_union",
    RAW_CTE
    + ", every_report AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}' AS source, * FROM ({_norm_sql(s)}) AS x"
        for s in ("DistroKid", "TuneCore", "CDBaby", "Symphonic")
    )
    + ") SELECT platform, currency, count(*) AS n, CAST(sum(net_revenue) AS DECIMAL(38,9)) AS revenue, "
    "CAST(sum(quantity) AS BIGINT) AS streams FROM every_report GROUP BY 1, 2",
)
def _(spark, sf):
    parts = [
        normalize(fx_data.raw_report(spark, sf, source), source)
        for source in ("DistroKid", "TuneCore", "CDBaby", "Symphonic")
    ]
    return union_reports(parts).groupBy("platform", "currency").agg(
        F.count("*").alias("n"),
        F.sum("net_revenue").alias("revenue"),
        F.sum("quantity").alias("streams"),
    )


@query(
    "norm_rejects",
    RAW_CTE
    + """, notes AS (
      SELECT dataset_id, 'reporting_date' AS field, 'no date' AS reason FROM clean_cells WHERE line = 7
      UNION ALL SELECT dataset_id, 'net_revenue', 'no amount' FROM clean_cells WHERE line = 6
      UNION ALL SELECT dataset_id, 'net_revenue', 'amount misread' FROM clean_cells WHERE line IN (2, 4)
      UNION ALL SELECT dataset_id, 'quantity', 'no quantity' FROM clean_cells WHERE line IN (3, 4, 5, 6))
    SELECT dataset_id, field, reason, count(*) AS n FROM notes GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    raw = fx_data.raw_report(spark, sf, "DistroKid", "dataset_id").drop("Country of Sale")
    return rejects(raw, "DistroKid").groupBy("dataset_id", "field", "reason").agg(
        F.count("*").alias("n")
    )


@query("dataset_row_counts", R + "SELECT dataset_id, count(*) AS row_count FROM royalty_data GROUP BY 1")
def _(spark, sf):
    return dataset_row_counts(royalties(spark, sf, "dataset_id"))


# --- structured requests -----------------------------------------------------


def request(name: str, sql: str, extra: tuple[str, ...] = (), **params) -> None:
    """Register a structured request over the royalty table."""

    @query(name, R + sql)
    def _(spark, sf):
        return structured.structured_query(royalties(spark, sf, *extra), **params)


REV = "CAST(SUM(net_revenue) AS DECIMAL(38,9)) AS total_revenue"
QTY = "CAST(SUM(quantity) AS BIGINT) AS total_streams"

request(
    "scan_project",
    "SELECT isrc, platform, territory AS country, reporting_date FROM royalty_data",
    dimensions=["isrc", "platform", "country", "reporting_date"],
    limit=None,
)
request("select_star", f"SELECT {COLUMNS} FROM royalty_data", limit=None)
request(
    "filter_date_range",
    "SELECT isrc, reporting_date FROM royalty_data "
    "WHERE reporting_date >= DATE '1997-03-01' AND reporting_date <= DATE '1998-02-28'",
    dimensions=["isrc", "reporting_date"],
    date_range={"from": "1997-03-01", "to": "1998-02-28"},
    limit=None,
)
request(
    "filter_eq",
    f"SELECT territory, {REV} FROM royalty_data WHERE platform = '1-URGENT' GROUP BY 1",
    dimensions=["territory"],
    metrics=["net_revenue"],
    filters=[{"field": "platform", "operator": "eq", "value": "1-URGENT"}],
    limit=None,
)
request(
    "filter_ne",
    f"SELECT currency, {QTY} FROM royalty_data WHERE currency <> 'USD' GROUP BY 1",
    dimensions=["currency"],
    metrics=["quantity"],
    filters=[{"field": "currency", "operator": "ne", "value": "USD"}],
    limit=None,
)
request(
    "filter_cmp",
    "SELECT isrc, upc, reporting_date FROM royalty_data WHERE reporting_date > DATE '1996-01-31' "
    "AND reporting_date < DATE '2000-06-01' AND upc >= '000000000010' AND isrc <= 'US0000001000'",
    dimensions=["isrc", "upc", "reporting_date"],
    filters=[
        {"field": "reporting_date", "operator": "gt", "value": "1996-01-31"},
        {"field": "reporting_date", "operator": "lt", "value": "2000-06-01"},
        {"field": "upc", "operator": "gte", "value": "000000000010"},
        {"field": "isrc", "operator": "lte", "value": "US0000001000"},
    ],
    limit=None,
)
request(
    "filter_like",
    f"SELECT title, {QTY} FROM royalty_data WHERE title LIKE '%ring%' GROUP BY 1",
    dimensions=["title"],
    metrics=["quantity"],
    filters=[{"field": "title", "operator": "like", "value": "%ring%"}],
    limit=None,
)
request(
    "filter_in",
    f"SELECT album, {REV} FROM royalty_data WHERE album IN ('Brand#1', 'Brand#12', 'Brand#25') GROUP BY 1",
    dimensions=["album"],
    metrics=["net_revenue"],
    filters=[{"field": "album", "operator": "in", "value": ["Brand#1", "Brand#12", "Brand#25"]}],
    limit=None,
)
request(
    "filter_and",
    f"SELECT territory AS country, platform, {REV}, {QTY} FROM royalty_data "
    "WHERE reporting_date >= DATE '1996-01-01' AND transaction_type = 'R' AND territory <> 'NATION_3' "
    "AND dataset_id IN ('ds-0', 'ds-3') GROUP BY 1, 2",
    extra=("dataset_id",),
    dimensions=["country", "platform"],
    metrics=["net_revenue", "quantity"],
    date_range={"from": "1996-01-01"},
    filters=[
        {"field": "transaction_type", "operator": "eq", "value": "R"},
        {"field": "country", "operator": "ne", "value": "NATION_3"},
    ],
    dataset_ids=["ds-0", "ds-3"],
    limit=None,
)
request(
    "transform_col",
    "SELECT platform, total_revenue, total_streams, "
    "round(CAST(total_revenue AS DOUBLE) / total_streams, 4) AS per_stream FROM ("
    f"SELECT platform, {REV}, {QTY} FROM royalty_data GROUP BY 1)",
    dimensions=["platform"],
    metrics=["net_revenue", "quantity"],
    transform={"per_stream": "round(cast(total_revenue as double) / total_streams, 4)"},
    limit=None,
)
request(
    "agg_revenue_by_dim",
    f"SELECT artist, {REV} FROM royalty_data GROUP BY 1",
    dimensions=["artist"],
    metrics=["net_revenue"],
    limit=None,
)
request(
    "agg_streams_by_dim",
    f"SELECT reporting_date, {QTY} FROM royalty_data GROUP BY 1",
    dimensions=["reporting_date"],
    metrics=["quantity"],
    limit=None,
)
FLAGSHIP = {
    "dimensions": ["platform", "territory"],
    "metrics": ["net_revenue", "quantity"],
    "date_range": {"from": "1995-06-01", "to": "2001-06-30"},
    "limit": None,
}
request(
    "agg_multi_dim",
    f"SELECT platform, territory, {REV}, {QTY} FROM royalty_data WHERE reporting_date "
    "BETWEEN DATE '1995-06-01' AND DATE '2001-06-30' GROUP BY 1, 2",
    **FLAGSHIP,
)
request(
    "distinct_dims",
    "SELECT DISTINCT artist, territory FROM royalty_data",
    dimensions=["artist", "territory"],
    metrics=[],
    limit=None,
)
request("agg_global", f"SELECT {REV}, {QTY} FROM royalty_data", metrics=["net_revenue", "quantity"], limit=None)
request(
    "limit_default",
    f"SELECT artist, platform, {REV} FROM royalty_data GROUP BY 1, 2 "
    "ORDER BY artist NULLS LAST, platform NULLS LAST LIMIT 100",
    dimensions=["artist", "platform"],
    metrics=["net_revenue"],
)
request(
    "sort_dims",
    f"SELECT title, currency, {REV} FROM royalty_data GROUP BY 1, 2 "
    "ORDER BY total_revenue DESC NULLS FIRST, title, currency LIMIT 25",
    dimensions=["title", "currency"],
    metrics=["net_revenue"],
    sort=[("total_revenue", "DESC"), ("title", "ASC"), ("currency", "ASC")],
    limit=25,
)
request(
    "limit_offset",
    f"SELECT isrc, {QTY} FROM royalty_data GROUP BY 1 ORDER BY total_streams DESC, isrc LIMIT 20 OFFSET 40",
    dimensions=["isrc"],
    metrics=["quantity"],
    sort=[("total_streams", "DESC"), ("isrc", "ASC")],
    limit=20,
    offset=40,
)

# --- summary -----------------------------------------------------------------

KPI_SQL = """SELECT CAST(COALESCE(SUM(net_revenue), 0) AS DOUBLE) AS total_net_revenue,
  COUNT(DISTINCT isrc) AS total_tracks_monetized,
  CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS total_streams FROM royalty_data"""


@query("summary_kpis", R + KPI_SQL)
def _(spark, sf):
    return summary.kpis(royalties(spark, sf))


def _top_sql(column: str) -> str:
    return (
        f"SELECT {column} FROM royalty_data GROUP BY {column} "
        f"ORDER BY SUM(net_revenue) DESC, {column} LIMIT 1"
    )


SUMMARY_SQL = (
    R + f"SELECT k.*, ({_top_sql('artist')}) AS top_artist, ({_top_sql('platform')}) AS top_platform, "
    f"({_top_sql('title')}) AS top_track FROM ({KPI_SQL}) AS k"
)


@query("summary_full", SUMMARY_SQL)
def _(spark, sf):
    return summary.summary(royalties(spark, sf))


def _register_top(name: str, column: str) -> None:
    sql = f"SELECT {column}, CAST(SUM(net_revenue) AS DECIMAL(38,9)) AS rev FROM royalty_data " \
          f"GROUP BY 1 ORDER BY rev DESC, {column} LIMIT 1"

    @query(name, R + sql)
    def _(spark, sf):
        return summary.top_by_revenue(royalties(spark, sf), column)


_register_top("top_platform", "platform")
_register_top("top_track", "title")
_register_top("top_artist", "artist")

# --- pages -------------------------------------------------------------------

CURSOR = "ds-77"


@query(
    "page_desc",
    DATASETS_CTE
    + f"""SELECT * FROM datasets WHERE (created_at, id) < (SELECT (created_at, id) FROM datasets
    WHERE id = '{CURSOR}') ORDER BY created_at DESC, id DESC LIMIT 51""",
)
def _(spark, sf):
    return paging.page(fx_data.datasets(spark, sf), cursor=CURSOR)


@query(
    "page_asc",
    DATASETS_CTE
    + f"""SELECT * FROM datasets WHERE (created_at, id) > (SELECT (created_at, id) FROM datasets
    WHERE id = '{CURSOR}') ORDER BY created_at, id LIMIT 21""",
)
def _(spark, sf):
    return paging.page(fx_data.datasets(spark, sf), cursor=CURSOR, limit=20, newest_first=False)


@query(
    "page_meta",
    DATASETS_CTE
    + """, fetched AS (SELECT * FROM datasets ORDER BY created_at DESC, id DESC LIMIT 51),
    shown AS (SELECT * FROM fetched ORDER BY created_at DESC, id DESC LIMIT 50)
    SELECT CASE WHEN (SELECT count(*) FROM fetched) > 50
             THEN (SELECT id FROM shown ORDER BY created_at, id LIMIT 1) END AS next_cursor,
      (SELECT count(*) FROM fetched) > 50 AS has_more, CAST(50 AS BIGINT) AS page_limit""",
)
def _(spark, sf):
    return paging.page_meta(paging.page(fx_data.datasets(spark, sf)), None)


# --- catalog -----------------------------------------------------------------

ITEMS_CTE = R + """, items AS (
  SELECT DISTINCT owner_user_id, artist, album AS album_title, upc, isrc, title AS track_title
  FROM royalty_data
)
"""


@query("catalog_items", ITEMS_CTE + "SELECT * FROM items")
def _(spark, sf):
    return fx_data.owned_items(spark, sf)


@query(
    "catalog_rejects",
    RAW_CTE
    + """SELECT 'blank isrc' AS reason, count(*) AS rejected FROM clean_cells WHERE trim(amount_cell) = ''
    UNION ALL SELECT 'blank title', count(*) FROM clean_cells
    WHERE trim(amount_cell) <> '' AND trim(coalesce(quantity_cell, '')) = ''""",
)
def _(spark, sf):
    # Reports whose isrc and title columns hold the untidy cells instead.
    cells = fx_data.raw_cells(spark, sf).select(
        F.col("amount_cell").alias("isrc"), F.col("quantity_cell").alias("title")
    )
    return catalog.catalog_rejects(cells)


def _known_artists(spark, sf):
    """A catalog in which every supplier already belongs to its own nation's owner."""
    nation = table(spark, sf, "nation")
    return table(spark, sf, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "concat('old-', s_name) AS id", "concat('u-', n_name) AS owner_user_id", "s_name AS name"
    )


KNOWN_ARTISTS_CTE = """, known_artists AS (
  SELECT concat('old-', s_name) AS id, concat('u-', n_name) AS owner_user_id, s_name AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), next_artists AS (
  SELECT id, owner_user_id, name FROM known_artists
  UNION ALL
  SELECT sha256(concat(owner_user_id, chr(31), artist)), owner_user_id, artist
  FROM (SELECT DISTINCT owner_user_id, artist FROM items) AS i
  WHERE NOT EXISTS (SELECT 1 FROM known_artists k
                    WHERE k.owner_user_id = i.owner_user_id AND k.name = i.artist)
)
"""


@query("upsert_artists", ITEMS_CTE + KNOWN_ARTISTS_CTE + "SELECT * FROM next_artists")
def _(spark, sf):
    return catalog.upsert_artists(fx_data.owned_items(spark, sf), _known_artists(spark, sf))


def _known_albums(spark, sf):
    """Each owner already has one album per region code, some with a known UPC."""
    nation = table(spark, sf, "nation")
    part = table(spark, sf, "part").select("p_brand").distinct()
    old = nation.join(part, F.expr("p_brand = concat('Brand#', cast(n_nationkey as string))"))
    return old.selectExpr(
        "concat('old-', n_name) AS id", "concat('u-', n_name) AS owner_user_id",
        "CAST(NULL AS STRING) AS artist_id", "'Old title' AS title",
        "lpad(replace(p_brand, 'Brand#', ''), 12, '0') AS upc", "DATE'1994-05-01' AS release_date",
    )


KNOWN_ALBUMS_CTE = """, known_albums AS (
  SELECT concat('old-', n_name) AS id, concat('u-', n_name) AS owner_user_id,
    CAST(NULL AS VARCHAR) AS artist_id, 'Old title' AS title,
    lpad(replace(p_brand, 'Brand#', ''), 12, '0') AS upc, DATE '1994-05-01' AS release_date
  FROM nation JOIN (SELECT DISTINCT p_brand FROM part) AS p
    ON p_brand = concat('Brand#', CAST(n_nationkey AS VARCHAR))
), coded AS (
  SELECT owner_user_id, upc, max(artist) AS artist, max(album_title) AS title
  FROM items GROUP BY 1, 2
), next_albums AS (
  SELECT coalesce(k.id, sha256(concat(coalesce(k.owner_user_id, c.owner_user_id), chr(31), 'upc',
      chr(31), coalesce(k.upc, c.upc)))) AS id,
    coalesce(k.owner_user_id, c.owner_user_id) AS owner_user_id,
    coalesce(a.id, k.artist_id) AS artist_id, coalesce(c.title, k.title) AS title,
    coalesce(k.upc, c.upc) AS upc, k.release_date
  FROM known_albums k FULL JOIN coded c ON k.owner_user_id = c.owner_user_id AND k.upc = c.upc
  LEFT JOIN next_artists a ON a.owner_user_id = c.owner_user_id AND a.name = c.artist
)
"""


def _next_albums(spark, sf, items):
    # Later jobs read the items (staged, too) and artists again, so both are worked out once.
    artists = staged(catalog.upsert_artists(items, _known_artists(spark, sf)))
    return artists, catalog.upsert_albums(items, _known_albums(spark, sf), artists)


@query("upsert_albums", ITEMS_CTE + KNOWN_ARTISTS_CTE + KNOWN_ALBUMS_CTE + "SELECT * FROM next_albums")
def _(spark, sf):
    facts = catalog.catalog_facts(royalties(spark, sf, "owner_user_id", costly=True))
    return _next_albums(spark, sf, staged(facts.drop("isrc", "track_title")))[1]


# Album titles without a UPC, in two spellings, so that titles match case-blind.
PLAIN_ITEMS_CTE = R + """, items AS (
  SELECT DISTINCT owner_user_id, artist,
    CASE WHEN transaction_type = 'R' THEN upper(platform) ELSE lower(platform) END AS album_title,
    isrc, title AS track_title
  FROM royalty_data
)
"""


@query(
    "upsert_albums_by_title",
    PLAIN_ITEMS_CTE
    + KNOWN_ARTISTS_CTE
    + """SELECT sha256(concat(i.owner_user_id, chr(31), a.id, chr(31), lower(album_title))) AS id,
      i.owner_user_id, a.id AS artist_id, max(album_title) AS title, CAST(NULL AS VARCHAR) AS upc,
      CAST(NULL AS DATE) AS release_date
    FROM items i JOIN next_artists a ON a.owner_user_id = i.owner_user_id AND a.name = i.artist
    GROUP BY i.owner_user_id, a.id, lower(album_title)""",
)
def _(spark, sf):
    spelled = F.when(F.col("transaction_type") == "R", F.upper("platform")).otherwise(
        F.lower("platform")
    )
    rows = royalties(spark, sf, "owner_user_id").withColumns({"album": spelled, "upc": F.lit("")})
    items = catalog.catalog_items(rows)
    artists = catalog.upsert_artists(items, _known_artists(spark, sf))
    return catalog.upsert_albums(items, spark.createDataFrame([], fx_data.EMPTY_ALBUMS), artists)


@query(
    "upsert_tracks",
    ITEMS_CTE
    + KNOWN_ARTISTS_CTE
    + KNOWN_ALBUMS_CTE
    + """, best AS (
      SELECT owner_user_id, isrc, max(artist) AS artist, max(album_title) AS album_title,
        max(upc) AS upc, max(track_title) AS track_title FROM items GROUP BY 1, 2
    ), known_tracks AS (
      SELECT DISTINCT concat('old-', owner_user_id, '-', isrc) AS id, owner_user_id, isrc,
        concat('al-', platform) AS album_id FROM royalty_data
      WHERE platform = '5-LOW' AND transaction_type = 'N'
    )
    SELECT coalesce(k.id, sha256(concat(b.owner_user_id, chr(31), b.isrc))) AS id, b.owner_user_id,
      a.id AS artist_id, al.id AS album_id, b.isrc, b.track_title AS title
    FROM best b
    LEFT JOIN known_tracks k ON k.owner_user_id = b.owner_user_id AND k.isrc = b.isrc
    LEFT JOIN next_artists a ON a.owner_user_id = b.owner_user_id AND a.name = b.artist
    LEFT JOIN next_albums al ON al.owner_user_id = b.owner_user_id AND al.upc = b.upc""",
)
def _(spark, sf):
    fields = ("owner_user_id", "artist", "album", "upc", "isrc", "title", "platform", "transaction_type")
    rows = staged(royalties(spark, sf, "owner_user_id", costly=True).select(*fields))
    items = catalog.catalog_facts(rows)
    artists, albums = _next_albums(spark, sf, items)
    albums = staged(albums)
    known = (
        rows.where("platform = '5-LOW' AND transaction_type = 'N'")
        .select("owner_user_id", "isrc", "platform")
        .distinct()
        .selectExpr(
            "concat('old-', owner_user_id, '-', isrc) AS id", "owner_user_id",
            "CAST(NULL AS STRING) AS artist_id", "concat('al-', platform) AS album_id", "isrc",
            "'Old title' AS title",
        )
    )
    return catalog.upsert_tracks(items, known, albums, artists)


@query(
    "upsert_members",
    MEMBERS_CTE
    + """, changes AS (
      SELECT concat('ws-', c_nationkey) AS workspace_id, concat('u-', o_custkey) AS user_id,
        max(CASE o_orderstatus WHEN 'F' THEN 'Admin' ELSE 'Manager' END) AS new_role
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
      GROUP BY 1, 2)
    SELECT m.workspace_id, m.user_id, coalesce(new_role, role) AS role FROM members m
    LEFT JOIN changes c ON c.workspace_id = m.workspace_id AND c.user_id = m.user_id""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    changes = orders.join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "concat('ws-', cast(c_nationkey as string)) AS workspace_id",
        "concat('u-', cast(o_custkey as string)) AS user_id",
        "CASE o_orderstatus WHEN 'F' THEN 'Admin' ELSE 'Manager' END AS role",
    )
    return catalog.upsert_members(changes, fx_data.members(spark, sf))


@query(
    "patch_apply",
    R
    + CATALOG_CTES
    + """SELECT id, owner_user_id, artist_id, CASE WHEN p_size > 40 THEN 'al-moved' ELSE album_id END
      AS album_id, isrc, CASE WHEN p_size > 25 THEN concat('Renamed ', title) ELSE title END AS title
    FROM tracks JOIN part ON id = concat('tr-', CAST(p_partkey AS VARCHAR))""",
)
def _(spark, sf):
    changes = table(spark, sf, "part").where("p_size > 25").selectExpr(
        "concat('tr-', cast(p_partkey as string)) AS id",
        "concat('Renamed ', p_name) AS title",
        "CASE WHEN p_size > 40 THEN 'al-moved' END AS album_id",
    )
    return catalog.patch(
        fx_data.label_catalog(spark, sf)["tracks"], changes, ["album_id", "title"]
    )


def _after_deletes(spark, sf):
    """Artists deeply in debt are deleted, then one brand's album."""
    frames = fx_data.label_catalog(spark, sf)
    debtors = table(spark, sf, "supplier").where("s_acctbal < 2000").selectExpr(
        "concat('ar-', s_name) AS id"
    )
    album = table(spark, sf, "part").where("p_brand = 'Brand#7'").selectExpr(
        "concat('al-', p_brand) AS id"
    ).distinct()
    return catalog.delete_albums(album, catalog.delete_artists(debtors, frames))


@query(
    "delete_cascade",
    R
    + CATALOG_CTES
    + SPLITS_CTE
    + """, gone_artists AS (SELECT concat('ar-', s_name) AS id FROM supplier WHERE s_acctbal < 2000),
    kept_tracks AS (SELECT id, CASE WHEN album_id <> 'al-Brand#7' THEN album_id END AS album_id
      FROM tracks WHERE artist_id NOT IN (SELECT id FROM gone_artists)),
    gone_tracks AS (SELECT id FROM tracks WHERE artist_id IN (SELECT id FROM gone_artists))
    SELECT 'artists' AS kind, id, CAST(NULL AS VARCHAR) AS album_id FROM artists
      WHERE id NOT IN (SELECT id FROM gone_artists)
    UNION ALL SELECT 'albums', id, NULL FROM albums WHERE id <> 'al-Brand#7'
    UNION ALL SELECT 'tracks', id, album_id FROM kept_tracks
    UNION ALL SELECT 'splits', id, album_id FROM splits
      WHERE (artist_id IS NULL OR artist_id NOT IN (SELECT id FROM gone_artists))
        AND (album_id IS NULL OR album_id <> 'al-Brand#7')
        AND (track_id IS NULL OR track_id NOT IN (SELECT id FROM gone_tracks))""",
)
def _(spark, sf):
    rest = _after_deletes(spark, sf)
    nothing = F.lit(None).cast("string").alias("album_id")
    out = None
    for kind in ("artists", "albums", "tracks", "splits"):
        album = F.col("album_id") if kind in ("tracks", "splits") else nothing
        rows = rest[kind].select(F.lit(kind).alias("kind"), "id", album)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "payees_in_use",
    R
    + SPLITS_CTE
    + """SELECT DISTINCT concat('pa-Manager ', CAST(s_nationkey AS VARCHAR)) AS id FROM supplier
    WHERE concat('pa-Manager ', CAST(s_nationkey AS VARCHAR)) IN (SELECT payee_id FROM splits)""",
)
def _(spark, sf):
    gone = table(spark, sf, "supplier").selectExpr(
        "concat('pa-Manager ', cast(s_nationkey as string)) AS id"
    ).distinct()
    return catalog.payees_in_use(gone, fx_data.splits(spark, sf))


@query(
    "dup_keys",
    ITEMS_CTE + "SELECT owner_user_id, isrc, count(*) AS copies FROM items GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return catalog.duplicate_keys(fx_data.owned_items(spark, sf), ["owner_user_id", "isrc"])


# --- splits and payouts ------------------------------------------------------

RULES_CTE = R + SPLITS_CTE
AS_OF = "1998-06-15"


@query(
    "splits_effective",
    RULES_CTE
    + f"""SELECT payee_name, percentage, track_id, album_id, artist_id FROM splits
    WHERE COALESCE(effective_from, DATE '1900-01-01') <= DATE '{AS_OF}'
      AND COALESCE(effective_to, DATE '2099-12-31') >= DATE '{AS_OF}'""",
)
def _(spark, sf):
    live = splits.effective_splits(fx_data.splits(spark, sf), AS_OF, "ws-label")
    return live.select("payee_name", "percentage", "track_id", "album_id", "artist_id")


@query(
    "splits_for_target",
    RULES_CTE
    + "SELECT id, payee_name, percentage FROM splits WHERE workspace_id = 'ws-label' AND album_id = 'al-Brand#3'",
)
def _(spark, sf):
    found = splits.splits_for_target(fx_data.splits(spark, sf), "ws-label", album_id="al-Brand#3")
    return found.select("id", "payee_name", "percentage")


TARGETED_CTE = """, targeted AS (
  SELECT *, CASE WHEN track_id IS NOT NULL THEN 'track' WHEN album_id IS NOT NULL THEN 'album'
      WHEN artist_id IS NOT NULL THEN 'artist' ELSE 'workspace' END AS target_kind,
    coalesce(track_id, album_id, artist_id, workspace_id) AS target_id,
    coalesce(effective_from, DATE '1900-01-01') AS day_from,
    coalesce(effective_to, DATE '2099-12-31') AS day_to
  FROM splits
), totals AS (
  SELECT t.workspace_id, t.target_kind, t.target_id, sum(t.percentage) AS total,
    count(*) AS payees FROM targeted t GROUP BY 1, 2, 3
), peaks AS (
  SELECT workspace_id, target_kind, target_id, max(live) AS peak FROM (
    SELECT a.workspace_id, a.target_kind, a.target_id, a.day_from, sum(b.percentage) AS live
    FROM (SELECT DISTINCT workspace_id, target_kind, target_id, day_from FROM targeted) a
    JOIN targeted b ON a.workspace_id = b.workspace_id AND a.target_kind = b.target_kind
      AND a.target_id = b.target_id AND b.day_from <= a.day_from AND b.day_to >= a.day_from
    GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2, 3
)
"""


@query(
    "split_totals",
    RULES_CTE
    + TARGETED_CTE
    + """SELECT workspace_id, target_kind, target_id, CAST(total AS DECIMAL(38,2)) AS total,
      CAST(peak AS DECIMAL(38,2)) AS peak, payees, total > 100 AS "over"
    FROM totals JOIN peaks USING (workspace_id, target_kind, target_id)""",
)
def _(spark, sf):
    return splits.split_totals(fx_data.splits(spark, sf))


@query(
    "split_violations",
    RULES_CTE
    + TARGETED_CTE
    + """SELECT workspace_id, id AS subject, 'not exactly one target' AS reason FROM targeted
      WHERE target_kind = 'workspace'
    UNION ALL SELECT workspace_id, id, 'ends before it starts' FROM splits
      WHERE effective_from > effective_to
    UNION ALL SELECT workspace_id, id, 'percentage out of range' FROM splits
      WHERE percentage < 0.01 OR percentage > 100
    UNION ALL SELECT workspace_id, id, 'blank payee' FROM splits WHERE trim(payee_name) = ''
    UNION ALL SELECT workspace_id, target_id, 'total over 100' FROM totals WHERE total > 100
    UNION ALL SELECT workspace_id, target_id, 'too many payees' FROM totals WHERE payees > 50""",
)
def _(spark, sf):
    return splits.split_violations(fx_data.splits(spark, sf))


# Suppliers are payees of one album per length of name, each with a rule of its own, wrong in ways that follow from its keys.
HARD_CTE = """WITH splits AS (
  SELECT 'sp-' || s_suppkey AS id, 'ws-' || length(s_name) AS workspace_id, NULL::VARCHAR AS artist_id, 'al-' || length(s_name) AS album_id,
    NULL::VARCHAR AS track_id, CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE s_name END AS payee_name,
    CAST((s_suppkey % 3) * 50.01 AS DECIMAL(5,2)) AS percentage,
    CASE WHEN s_nationkey % 2 = 0 THEN DATE '2000-01-01' ELSE DATE '1996-01-01' END AS effective_from,
    CASE WHEN s_nationkey % 3 = 0 THEN DATE '1999-12-31' END AS effective_to FROM supplier
)"""


@query(
    "split_violations_hard",
    HARD_CTE
    + """SELECT workspace_id, id AS subject, 'ends before it starts' AS reason FROM splits WHERE effective_from > effective_to
    UNION ALL SELECT workspace_id, id, 'percentage out of range' FROM splits WHERE percentage < 0.01 OR percentage > 100
    UNION ALL SELECT workspace_id, id, 'blank payee' FROM splits WHERE trim(payee_name) = ''
    UNION ALL SELECT workspace_id, album_id, 'total over 100' FROM splits GROUP BY 1, 2 HAVING sum(percentage) > 100
    UNION ALL SELECT workspace_id, album_id, 'too many payees' FROM splits GROUP BY 1, 2 HAVING count(*) > 50""",
)
def _(spark, sf):
    rules = table(spark, sf, "supplier").selectExpr(
        "concat('sp-', s_suppkey) AS id", "concat('ws-', length(s_name)) AS workspace_id", "CAST(NULL AS STRING) AS artist_id",
        "concat('al-', length(s_name)) AS album_id", "CAST(NULL AS STRING) AS track_id", "concat('pa-', s_suppkey) AS payee_id",
        "CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE s_name END AS payee_name",
        "CAST((s_suppkey % 3) * 50.01 AS DECIMAL(5,2)) AS percentage",
        "CASE WHEN s_nationkey % 2 = 0 THEN DATE'2000-01-01' ELSE DATE'1996-01-01' END AS effective_from",
        "CASE WHEN s_nationkey % 3 = 0 THEN DATE'1999-12-31' END AS effective_to",
    )
    return splits.split_violations(rules)


# Payments per royalty row and rule, at every level, told apart by row number.
PAID_CTES = PAY + """, numbered AS (
  SELECT row_number() OVER () AS rn, r.*, t.id AS track_id, t.album_id, t.artist_id
  FROM royalty_data r JOIN tracks t ON t.isrc = r.isrc
), matches AS (
  SELECT n.rn, 0 AS lvl, 'track' AS level, s.* FROM numbered n JOIN splits s ON s.track_id = n.track_id
    AND n.reporting_date BETWEEN coalesce(effective_from, DATE '1900-01-01') AND coalesce(effective_to, DATE '2099-12-31')
  UNION ALL
  SELECT n.rn, 1, 'album', s.* FROM numbered n JOIN splits s ON s.album_id = n.album_id
    AND n.reporting_date BETWEEN coalesce(effective_from, DATE '1900-01-01') AND coalesce(effective_to, DATE '2099-12-31')
  UNION ALL
  SELECT n.rn, 2, 'artist', s.* FROM numbered n JOIN splits s ON s.artist_id = n.artist_id
    AND n.reporting_date BETWEEN coalesce(effective_from, DATE '1900-01-01') AND coalesce(effective_to, DATE '2099-12-31')
  UNION ALL
  SELECT n.rn, 3, 'workspace', s.* FROM numbered n JOIN splits s ON s.track_id IS NULL
    AND s.album_id IS NULL AND s.artist_id IS NULL
    AND n.reporting_date BETWEEN coalesce(effective_from, DATE '1900-01-01') AND coalesce(effective_to, DATE '2099-12-31')
), amounts AS (
  SELECT m.rn, m.lvl, m.level, m.payee_name, m.percentage,
    CAST(round(CAST(n.net_revenue AS DECIMAL(22,9)) * m.percentage * CAST(0.01 AS DECIMAL(3,2)), 9)
      AS DECIMAL(38,9)) AS amount
  FROM matches m JOIN numbered n USING (rn)
), chosen AS (
  SELECT a.* FROM amounts a JOIN (SELECT rn, min(lvl) AS lvl FROM amounts GROUP BY rn) b
    ON a.rn = b.rn AND a.lvl = b.lvl
), payouts AS (
  SELECT rn, level, payee_name, percentage, amount FROM chosen
  UNION ALL
  SELECT n.rn, NULL, 'UNALLOCATED', NULL,
    CAST(n.net_revenue - coalesce((SELECT sum(amount) FROM chosen c WHERE c.rn = n.rn), 0) AS DECIMAL(38,9))
  FROM numbered n
)
"""
SHOWN = "n.isrc, n.platform, n.reporting_date, n.net_revenue"


def _payable(spark, sf):
    rows = royalties(spark, sf, costly=True)
    return rows.select("isrc", "platform", "reporting_date", "net_revenue")


@query(
    "payout_fanout",
    PAID_CTES + f"SELECT {SHOWN}, level, payee_name, percentage, amount FROM amounts JOIN numbered n USING (rn)",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    return splits.payout_fanout(_payable(spark, sf), frames["tracks"], frames["splits"])


@query(
    "payout_cascade",
    PAID_CTES + f"SELECT {SHOWN}, level, payee_name, percentage, amount FROM payouts JOIN numbered n USING (rn)",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    return splits.payout_cascade(_payable(spark, sf), frames["tracks"], frames["splits"])


@query(
    "payout_by_payee",
    PAID_CTES
    + "SELECT payee_name, CAST(sum(amount) AS DECIMAL(38,9)) AS amount, count(*) AS payments FROM payouts GROUP BY 1",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    return splits.payout_by_payee(_payable(spark, sf), frames["tracks"], frames["splits"])


@query(
    "royalty_catalog_join",
    R
    + CATALOG_CTES
    + """SELECT r.isrc, r.platform, r.net_revenue, t.id AS track_id, al.title AS album_title,
      ar.name AS artist_name FROM royalty_data r LEFT JOIN tracks t ON t.isrc = r.isrc
    LEFT JOIN albums al ON al.id = t.album_id LEFT JOIN artists ar ON ar.id = t.artist_id""",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    joined = splits.with_catalog(
        royalties(spark, sf), frames["tracks"], frames["albums"], frames["artists"]
    )
    return joined.select("isrc", "platform", "net_revenue", "track_id", "album_title", "artist_name")


# Two workspaces of two owners: every royalty belongs to one, each owner has all
# tracks under the same isrcs, and each workspace has its share of the rules.
TWO_CTES = PAY + """, owned AS (
  SELECT row_number() OVER () AS rn, r.* EXCLUDE (owner_user_id), 'ws-' || length(platform) % 2 AS workspace_id,
    'u-' || length(platform) % 2 AS owner_user_id FROM royalty_data r
), two_tracks AS (
  SELECT 'u-' || k AS owner_user_id, 'u' || k || id AS id, 'u' || k || album_id AS album_id,
    'u' || k || artist_id AS artist_id, isrc FROM tracks, (VALUES (0), (1)) v(k)
), two_rules AS (
  SELECT 'ws-' || k AS workspace_id, 'u' || k || track_id AS track_id, 'u' || k || album_id AS album_id,
    'u' || k || artist_id AS artist_id, payee_name || ' of ' || k AS payee_name, percentage,
    coalesce(effective_from, DATE '1900-01-01') AS d1, coalesce(effective_to, DATE '2099-12-31') AS d2
  FROM splits, (VALUES (0), (1)) v(k) WHERE k = 0 OR length(id) % 2 = 0
), found AS (
  SELECT o.rn, o.workspace_id, o.net_revenue, s.payee_name, s.percentage,
    CASE WHEN s.track_id IS NOT NULL THEN 0 WHEN s.album_id IS NOT NULL THEN 1
      WHEN s.artist_id IS NOT NULL THEN 2 ELSE 3 END AS lvl
  FROM owned o JOIN two_tracks t ON t.isrc = o.isrc AND t.owner_user_id = o.owner_user_id
  JOIN two_rules s ON s.workspace_id = o.workspace_id AND o.reporting_date BETWEEN s.d1 AND s.d2
    AND coalesce(s.track_id, t.id) = t.id
    AND (s.track_id IS NOT NULL OR coalesce(s.album_id, t.album_id) = t.album_id)
    AND (s.track_id IS NOT NULL OR s.album_id IS NOT NULL OR coalesce(s.artist_id, t.artist_id) = t.artist_id)
), paid AS (
  SELECT rn, workspace_id, payee_name,
    CAST(round(CAST(net_revenue AS DECIMAL(22,9)) * percentage * CAST(0.01 AS DECIMAL(3,2)), 9) AS DECIMAL(38,9)) AS amount
  FROM (SELECT *, min(lvl) OVER (PARTITION BY rn) AS nearest FROM found) f WHERE lvl = nearest
), every AS (
  SELECT workspace_id, payee_name, amount FROM paid
  UNION ALL
  SELECT o.workspace_id, 'UNALLOCATED', CAST(o.net_revenue - coalesce(p.spent, 0) AS DECIMAL(38,9))
  FROM owned o LEFT JOIN (SELECT rn, sum(amount) AS spent FROM paid GROUP BY rn) p USING (rn)
)
"""


def _two_of_each(frame, *ids: str, owner: bool = True):
    """Rows once per owner, their ids told apart."""
    twice = frame.withColumn("k", F.explode(F.array(F.lit("0"), F.lit("1"))))
    for name in ids:
        twice = twice.withColumn(name, F.concat(F.lit("u"), "k", name))
    return twice.withColumn("owner_user_id", F.concat(F.lit("u-"), "k")) if owner else twice


def _owned(rows):
    which = (F.length("platform") % 2).cast("string")
    return rows.withColumn("workspace_id", F.concat(F.lit("ws-"), which)).withColumn("owner_user_id", F.concat(F.lit("u-"), which))


@query(
    "payout_two_workspaces",
    TWO_CTES
    + """SELECT workspace_id, payee_name, CAST(sum(amount) AS DECIMAL(38,9)) AS amount, count(*) AS payments
    FROM every GROUP BY 1, 2""",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    tracks = _two_of_each(frames["tracks"], "id", "album_id", "artist_id")
    rules = _two_of_each(frames["splits"], "track_id", "album_id", "artist_id", owner=False)
    rules = rules.where("k = '0' OR length(id) % 2 = 0").withColumn("workspace_id", F.concat(F.lit("ws-"), "k"))
    rules = rules.withColumn("payee_name", F.concat("payee_name", F.lit(" of "), "k"))
    return splits.payout_by_payee(_owned(_payable(spark, sf)), tracks, rules)


@query(
    "royalty_catalog_two_owners",
    R
    + CATALOG_CTES
    + """SELECT r.isrc, r.platform, r.net_revenue, 'u-' || length(r.platform) % 2 AS owner_user_id,
      'u' || length(r.platform) % 2 || t.id AS track_id, al.title AS album_title, ar.name AS artist_name
    FROM royalty_data r LEFT JOIN tracks t ON t.isrc = r.isrc
    LEFT JOIN albums al ON al.id = t.album_id LEFT JOIN artists ar ON ar.id = t.artist_id""",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    tracks = _two_of_each(frames["tracks"], "id", "album_id", "artist_id")
    albums = _two_of_each(frames["albums"], "id")
    artists = _two_of_each(frames["artists"], "id")
    joined = splits.with_catalog(_owned(royalties(spark, sf)), tracks, albums, artists)
    return joined.select("isrc", "platform", "net_revenue", "owner_user_id", "track_id", "album_title", "artist_name")


@query(
    "royalty_orphans",
    R
    + """, kept AS (SELECT concat('US', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS isrc FROM part
      WHERE p_size <> 13 UNION ALL SELECT concat('ZZ', p_brand) FROM part)
    SELECT DISTINCT isrc, 'no track' AS problem FROM royalty_data WHERE isrc NOT IN (SELECT isrc FROM kept)
    UNION ALL SELECT DISTINCT isrc, 'no royalties' FROM kept WHERE isrc NOT IN (SELECT isrc FROM royalty_data)""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    tracks = part.where("p_size <> 13").selectExpr(
        "concat('US', lpad(cast(p_partkey as string), 10, '0')) AS isrc"
    ).unionByName(part.selectExpr("concat('ZZ', p_brand) AS isrc"))
    return splits.orphans(royalties(spark, sf), tracks)


# Every third platform's rows have padded isrc cells; the catalog has them trimmed.
PADDED = "CASE WHEN length(platform) % 3 = 0 THEN concat(' ', isrc, '  ') ELSE isrc END"


def _padded(rows):
    return rows.withColumn("isrc", F.expr(PADDED))


@query(
    "payout_padded_isrc",
    PAID_CTES
    + f"""SELECT isrc, payee_name, CAST(sum(amount) AS DECIMAL(38,9)) AS amount, count(*) AS payments FROM (
      SELECT {PADDED.replace("isrc", "n.isrc").replace("platform", "n.platform")} AS isrc, payee_name, amount
      FROM payouts JOIN numbered n USING (rn)) x GROUP BY 1, 2""",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    paid = splits.payout_cascade(_padded(_payable(spark, sf)), frames["tracks"], frames["splits"])
    return paid.groupBy("isrc", "payee_name").agg(F.sum("amount").alias("amount"), F.count("*").alias("payments"))


@query(
    "royalty_catalog_padded_isrc",
    R
    + CATALOG_CTES
    + f"""SELECT {PADDED.replace("isrc", "r.isrc")} AS isrc, r.net_revenue, t.id AS track_id, t.isrc IS NULL AS orphan
    FROM royalty_data r LEFT JOIN (SELECT * FROM tracks WHERE right(isrc, 1) <> '7') t ON t.isrc = r.isrc""",
)
def _(spark, sf):
    frames = fx_data.label_catalog(spark, sf)
    tracks = frames["tracks"].where("right(isrc, 1) <> '7'")
    rows = _padded(royalties(spark, sf))
    lost = splits.orphans(rows, tracks).where("problem = 'no track'").select(F.col("isrc").alias("lost"))
    joined = splits.with_catalog(rows, tracks, frames["albums"], frames["artists"])
    joined = joined.join(lost, F.trim("isrc") == F.col("lost"), "left")
    return joined.select("isrc", "net_revenue", "track_id", F.col("lost").isNotNull().alias("orphan"))


# --- currency ----------------------------------------------------------------

USD = (
    "CASE WHEN r.currency = 'USD' THEN r.net_revenue ELSE CAST(round(CAST(r.net_revenue AS DECIMAL(22,9)) "
    "* rate_to_usd, 9) AS DECIMAL(38,9)) END AS net_revenue_usd"
)
FX_SHOWN = ["isrc", "currency", "reporting_date", "net_revenue", "net_revenue_usd", "rate"]
RATE_SQL = "CASE WHEN r.currency = 'USD' THEN CAST(1 AS DECIMAL(10,6)) ELSE rate_to_usd END AS rate"


@query(
    "fx_exact",
    R
    + FX_CTE
    + f"""SELECT r.isrc, r.currency, r.reporting_date, r.net_revenue, {USD}, {RATE_SQL} FROM royalty_data r
    LEFT JOIN fx_rates f ON f.currency_code = r.currency AND f.date = r.reporting_date""",
)
def _(spark, sf):
    return fx.convert_exact(royalties(spark, sf, costly=True), fx_data.fx_rates(spark, sf)).select(*FX_SHOWN)


# Every day of an even date has a second, lower rate.
TWICE_CTE = FX_CTE.replace("fx_rates AS", "rates_once AS") + """, fx_rates AS (
  SELECT * FROM rates_once
  UNION ALL SELECT date, currency_code, CAST(rate_to_usd - 0.25 AS DECIMAL(10,6)) FROM rates_once WHERE day(date) % 2 = 0
), fx_daily AS (SELECT date, currency_code, max(rate_to_usd) AS rate_to_usd FROM fx_rates GROUP BY 1, 2)
"""


def _rates_twice(spark, sf):
    rates = fx_data.fx_rates(spark, sf)
    lower = rates.where("day(date) % 2 = 0").withColumn("rate_to_usd", F.expr("CAST(rate_to_usd - 0.25 AS DECIMAL(10,6))"))
    return rates.unionByName(lower)


@query(
    "fx_repeated_rate",
    R
    + TWICE_CTE
    + f"""SELECT r.isrc, r.currency, r.reporting_date, r.net_revenue, {USD}, {RATE_SQL} FROM royalty_data r
    LEFT JOIN fx_daily f ON f.currency_code = r.currency AND f.date = r.reporting_date""",
)
def _(spark, sf):
    return fx.convert_exact(royalties(spark, sf, costly=True), _rates_twice(spark, sf)).select(*FX_SHOWN)


@query(
    "fx_rate_conflicts",
    R
    + TWICE_CTE
    + """SELECT currency_code, date, count(*) AS rates, min(rate_to_usd) AS least_rate, max(rate_to_usd) AS greatest_rate
    FROM fx_rates GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf):
    return fx.repeated_rates(_rates_twice(spark, sf))


@query(
    "fx_asof",
    R
    + FX_CTE
    + f"""SELECT r.isrc, r.currency, r.reporting_date, r.net_revenue, {USD}, {RATE_SQL} FROM royalty_data r
    ASOF LEFT JOIN fx_rates f ON f.currency_code = r.currency AND f.date <= r.reporting_date""",
)
def _(spark, sf):
    return fx.convert_as_of(royalties(spark, sf, costly=True), fx_data.fx_rates(spark, sf)).select(*FX_SHOWN)


@query(
    "fx_missing",
    R
    + FX_CTE
    + """SELECT DISTINCT currency, reporting_date FROM royalty_data r WHERE currency <> 'USD' AND NOT EXISTS
    (SELECT 1 FROM fx_rates f WHERE f.currency_code = r.currency AND f.date = r.reporting_date)""",
)
def _(spark, sf):
    return fx.missing_rates(royalties(spark, sf), fx_data.fx_rates(spark, sf))


@query(
    "normalize_platform",
    R
    + """SELECT platform, CASE platform WHEN '1-URGENT' THEN '1 Urgent' WHEN '2-HIGH' THEN '2 High'
      WHEN '3-MEDIUM' THEN '3 Medium' WHEN '4-NOT SPECIFIED' THEN '4 Not Specified'
      WHEN '5-LOW' THEN '5 Low' ELSE platform END AS platform_name, count(*) AS n FROM royalty_data GROUP BY 1, 2""",
)
def _(spark, sf):
    name = normalize_platform(F.col("platform")).alias("platform_name")
    return royalties(spark, sf).groupBy("platform", name).agg(F.count("*").alias("n"))


# --- access, storage, history ------------------------------------------------

REQUESTS_CTE = MEMBERS_CTE + """, requests AS (
  SELECT concat('u-', c_custkey) AS user_id, concat('ws-', n2.n_nationkey) AS workspace_id,
    CASE WHEN c_acctbal < 0 THEN 'Viewer' ELSE 'Manager' END AS required_role
  FROM customer JOIN nation n1 ON c_nationkey = n1.n_nationkey
  JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey
)
"""


@query(
    "effective_role",
    REQUESTS_CTE
    + """, held AS (
      SELECT q.*, w.owner_user_id AS owner,
        CASE WHEN w.owner_user_id = q.user_id THEN 'Owner'
             WHEN m.role = 'Guest' THEN 'Viewer' ELSE m.role END AS role
      FROM requests q LEFT JOIN workspaces w ON w.workspace_id = q.workspace_id
      LEFT JOIN members m ON m.workspace_id = q.workspace_id AND m.user_id = q.user_id)
    SELECT workspace_id, user_id, required_role, CASE WHEN owner IS NOT NULL THEN role END AS role,
      CASE WHEN owner IS NULL THEN 'no workspace' WHEN role IS NULL THEN 'not a member'
        WHEN required_role = 'Viewer' OR role <> 'Viewer' THEN 'granted' ELSE 'forbidden' END AS outcome
    FROM held""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    asked = nation.select(F.col("n_nationkey").alias("asked"), "n_regionkey")
    requests = (
        table(spark, sf, "customer")
        .join(home, "c_nationkey")
        .join(asked, "n_regionkey")
        .selectExpr(
            "concat('u-', cast(c_custkey as string)) AS user_id",
            "concat('ws-', cast(asked as string)) AS workspace_id",
            "CASE WHEN c_acctbal < 0 THEN 'Viewer' ELSE 'Manager' END AS required_role",
        )
    )
    return access.effective_role(
        requests, fx_data.workspaces(spark, sf), fx_data.members(spark, sf)
    )


@query(
    "tenant_semi",
    R
    + """SELECT r.isrc, r.territory, r.net_revenue FROM royalty_data r WHERE r.owner_user_id IN
    (SELECT concat('u-', n_name) FROM nation JOIN customer ON c_nationkey = n_nationkey
     WHERE c_custkey = 42)""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    entitled = table(spark, sf, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "concat('u-', n_name) AS workspace_id", "concat('c-', cast(c_custkey as string)) AS user_id"
    )
    rows = royalties(spark, sf, "owner_user_id").withColumnRenamed("owner_user_id", "workspace_id")
    return access.visible_to(rows, entitled, "c-42").select("isrc", "territory", "net_revenue")


@query(
    "workspace_storage",
    DATASETS_CTE
    + """SELECT workspace_id, CAST(sum(file_size_bytes) AS BIGINT) AS storage_used_bytes,
      count(*) AS datasets FROM datasets GROUP BY 1""",
)
def _(spark, sf):
    return access.workspace_storage(fx_data.datasets(spark, sf))


HISTORY_CTE = """WITH runs AS (
  SELECT concat('ws-', user_id) AS workspace_id, concat('u-', user_id) AS user_id,
    concat('SELECT SUM(', event_type, ') FROM royalty_data') AS sql_executed, event_id AS row_count,
    CAST(trunc(value * 100) AS BIGINT) AS execution_time_ms, ts AS created_at FROM events
), history AS (
  SELECT workspace_id, user_id, concat('q_', substr(md5(sql_executed), 1, 16)) AS query_id,
    sql_executed, row_count, execution_time_ms, created_at FROM runs
)
"""


@query("query_history", HISTORY_CTE + "SELECT * FROM history")
def _(spark, sf):
    return history.history_records(fx_data.history(spark, sf))


@query(
    "history_latest",
    HISTORY_CTE
    + """SELECT workspace_id, user_id, query_id, sql_executed, row_count, execution_time_ms, created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY workspace_id, query_id
        ORDER BY created_at DESC, execution_time_ms DESC, user_id DESC) AS rn FROM history) x WHERE rn = 1""",
)
def _(spark, sf):
    return history.latest_by_query_id(history.history_records(fx_data.history(spark, sf)))


@query(
    "dataset_status",
    """WITH log AS (SELECT concat('ds-', l_orderkey) AS dataset_id, CASE l_returnflag WHEN 'A' THEN 'PROCESSING'
      WHEN 'N' THEN 'READY' ELSE 'FAILED' END AS status, l_partkey AS row_count, l_shipdate AS updated_at,
      l_linenumber AS seq FROM lineitem)
    SELECT dataset_id, status, row_count, updated_at, seq FROM (SELECT *, row_number() OVER
      (PARTITION BY dataset_id ORDER BY updated_at DESC, seq DESC, status DESC, row_count DESC) AS rn FROM log) x
    WHERE rn = 1""",
)
def _(spark, sf):
    return history.dataset_status(fx_data.status_log(spark, sf))
