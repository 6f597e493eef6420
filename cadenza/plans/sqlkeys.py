"""Plain SQL over the royalty tables: what the SQL entry point must run."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators.splits import effective_splits
from cadenza.operators.sqlrun import run_sql
from cadenza.operators.windows import distinct_on, over_groups
from cadenza.plans import fixtures as fx_data
from cadenza.plans.fixtures import CATALOG_CTES, ROYALTY_CTE, SPLITS_CTE, royalties
from cadenza.plans.registry import query

AS_OF = "1998-06-15"
TABLES_CTE = ROYALTY_CTE + CATALOG_CTES + SPLITS_CTE + f""", cascading_splits AS (
  SELECT payee_name, CAST(percentage AS DOUBLE) AS percentage, track_id AS track_id_str,
    album_id AS album_id_str, artist_id AS artist_id_str FROM splits
  WHERE COALESCE(effective_from, DATE '1900-01-01') <= DATE '{AS_OF}'
    AND COALESCE(effective_to, DATE '2099-12-31') >= DATE '{AS_OF}'
)
"""


def workspace_tables(sf):
    """The views a query may name, each built when it does."""

    def live_splits(spark):
        return effective_splits(fx_data.splits(spark, sf), AS_OF).selectExpr(
            "payee_name", "cast(percentage as double) AS percentage", "track_id AS track_id_str",
            "album_id AS album_id_str", "artist_id AS artist_id_str",
        )

    views = {"royalty_data": lambda spark: royalties(spark, sf), "cascading_splits": live_splits}
    for name in ("artists", "albums", "tracks"):
        views[name] = lambda spark, name=name: fx_data.label_catalog(spark, sf)[name]
    for name in ("documents", "events", "orders", "part"):
        views[name] = lambda spark, name=name: fx_data.table(spark, sf, name)
    return views


def sql(name: str, text: str, check: str | None = None, oracle: bool = True) -> None:
    """Register a SQL text; `check` is its twin where the dialects differ."""
    twin = check or text
    head = TABLES_CTE
    for word in ("WITH RECURSIVE ", "WITH "):
        if twin.startswith(word):
            head, twin = TABLES_CTE + ", ", twin[len(word):]
            break

    @query(name, head + twin if oracle else None)
    def _(spark, sf):
        return run_sql(spark, text, workspace_tables(sf))


REV = "CAST(SUM(net_revenue) AS DECIMAL(38,9))"
QTY = "CAST(SUM(quantity) AS BIGINT)"
MONTHLY = f"""monthly AS (
  SELECT %s, CAST(year(reporting_date) * 12 + month(reporting_date) AS INT) AS month_no,
    {REV} AS rev, {QTY} AS qty FROM royalty_data GROUP BY 1, 2)
"""

sql(
    "sql_predicates",
    """SELECT r.isrc, r.platform, r.territory, r.reporting_date, r.quantity,
      CASE WHEN r.quantity >= 15 THEN 'many' WHEN r.quantity IS NULL THEN 'none' ELSE 'few' END AS "volume"
    FROM royalty_data r
    WHERE (r.platform = '1-URGENT' OR NOT r.territory LIKE 'NATION#_1%' ESCAPE '#')
      AND r.quantity BETWEEN 10 AND 20 AND r.upc IS NOT NULL AND r.currency IN ('EUR', 'GBP')
      AND EXISTS (SELECT 1 FROM tracks t WHERE t.isrc = r.isrc AND t.title LIKE '%ring')""",
)

# --- aggregates ---------------------------------------------------------------

_DBL = "CAST(net_revenue AS DOUBLE)"
sql(
    "sql_agg_stats",
    f"""SELECT platform, count(*) AS n, min(quantity) AS least, max(quantity) AS most,
      round(avg(quantity), 6) AS mean_qty, round(avg({_DBL}), 3) AS mean_rev,
      round(stddev_samp(quantity), 6) AS sd, round(stddev_pop(quantity), 6) AS sdp,
      round(var_samp(quantity), 5) AS var, round(var_pop(quantity), 5) AS varp,
      round(corr({_DBL}, quantity), 8) AS r, round(covar_samp({_DBL}, quantity), 1) AS cov,
      round(covar_pop({_DBL}, quantity), 1) AS covp, round(regr_slope({_DBL}, quantity), 4) AS slope,
      round(regr_intercept({_DBL}, quantity), 2) AS intercept, round(regr_r2({_DBL}, quantity), 8) AS r2,
      CAST(regr_count({_DBL}, quantity) AS BIGINT) AS pairs, round(regr_avgx({_DBL}, quantity), 6) AS avgx,
      bool_and(quantity > 0) AS all_pos, bool_or(quantity > 49) AS any_big,
      bit_and(quantity) AS band, bit_or(quantity) AS bor, bit_xor(quantity) AS bxor,
      CAST(median(quantity) AS DOUBLE) AS med
    FROM royalty_data GROUP BY platform""",
)
sql(
    "sql_approx",
    """SELECT platform, approx_count_distinct(isrc) AS tracks, approx_percentile(quantity, 0.5) AS p50,
      approx_percentile(quantity, 0.95) AS p95 FROM royalty_data GROUP BY platform""",
    oracle=False,
)
sql(
    "fn_alias_array",
    """SELECT platform, array_length(make_array(platform, currency, artist)) AS three,
      generate_series(1, 5, 2) AS odd, CAST(sum(quantity) AS BIGINT) AS qty FROM royalty_data GROUP BY platform, currency, artist""",
    """SELECT platform, CAST(3 AS INTEGER) AS three, [1, 3, 5] AS odd,
      CAST(sum(quantity) AS BIGINT) AS qty FROM royalty_data GROUP BY platform, currency, artist""",
)
sql(
    "fn_alias_approx",
    """SELECT platform, abs(approx_distinct(isrc) - count(DISTINCT isrc)) <= 0.1 * count(DISTINCT isrc) AS tracks_close,
      abs(approx_percentile_cont(quantity, 0.5) - median(quantity)) <= 1 AS p50_close,
      approx_median(quantity) = median(quantity) AS same, arrow_typeof(max(isrc)) = 'string' AS is_text
    FROM royalty_data GROUP BY platform""",
    """SELECT platform, true AS tracks_close, true AS p50_close, true AS same, true AS is_text
    FROM royalty_data GROUP BY platform""",
)
sql(
    "fn_alias_digest",
    """SELECT isrc, lower(hex(digest(isrc, 'md5'))) AS md, lower(hex(digest(isrc, 'sha256'))) AS sha,
      map_extract(map('k', isrc), 'k') AS found, map_extract(map('k', isrc), 'z') AS missing FROM royalty_data""",
    """SELECT isrc, md5(isrc) AS md, sha256(isrc) AS sha, [isrc] AS found, CAST([] AS VARCHAR[]) AS missing FROM royalty_data""",
)
sql(
    "sql_approx_close",
    """SELECT platform,
      abs(approx_count_distinct(isrc) - count(DISTINCT isrc)) <= 0.1 * count(DISTINCT isrc) AS tracks_close,
      abs(approx_percentile(quantity, 0.5) - percentile(quantity, 0.5)) <= 1 AS p50_close,
      abs(approx_percentile(quantity, 0.95) - percentile(quantity, 0.95)) <= 1 AS p95_close
    FROM royalty_data GROUP BY platform""",
    "SELECT platform, true AS tracks_close, true AS p50_close, true AS p95_close FROM royalty_data GROUP BY platform",
)
sql(
    "sql_agg_filter",
    f"""SELECT currency, CAST(SUM(net_revenue) FILTER (WHERE transaction_type = 'R') AS DECIMAL(38,9)) AS returned,
      COUNT(DISTINCT isrc) AS isrcs, COUNT(DISTINCT artist) FILTER (WHERE platform = '5-LOW') AS low_artists,
      {QTY} AS qty FROM royalty_data GROUP BY currency""",
)
sql(
    "sql_rollup",
    f"""SELECT platform, territory, {REV} AS rev, CAST(GROUPING(platform) AS INT) AS no_platform,
      CAST(GROUPING(territory) AS INT) AS no_territory FROM royalty_data GROUP BY ROLLUP(platform, territory)""",
)
sql(
    "sql_cube",
    f"""SELECT platform, currency, transaction_type, {QTY} AS qty,
      CAST(GROUPING(platform) + GROUPING(currency) + GROUPING(transaction_type) AS BIGINT) AS rolled
    FROM royalty_data GROUP BY CUBE(platform, currency, transaction_type)""",
)
sql(
    "sql_grouping_sets",
    f"""SELECT artist, album, {REV} AS rev FROM royalty_data
    GROUP BY GROUPING SETS ((artist), (album), ())""",
)
sql(
    "sql_having",
    f"""SELECT artist, platform, {REV} AS rev, count(*) AS n FROM royalty_data
    GROUP BY artist, platform HAVING count(*) > 50 AND SUM(quantity) > 1000""",
)
sql(
    "sql_collect",
    f"""WITH per AS (SELECT platform, territory, {REV} AS rev FROM royalty_data GROUP BY 1, 2)
    SELECT platform, array_join(array_sort(array_agg(territory)), '|') AS all_of,
      string_agg(territory, ',') WITHIN GROUP (ORDER BY rev DESC, territory) AS by_rev,
      max_by(territory, rev) AS best, min_by(territory, rev) AS worst, count(*) AS n
    FROM per GROUP BY platform""",
    f"""WITH per AS (SELECT platform, territory, {REV} AS rev FROM royalty_data GROUP BY 1, 2)
    SELECT platform, string_agg(territory, '|' ORDER BY territory) AS all_of,
      string_agg(territory, ',' ORDER BY rev DESC, territory) AS by_rev,
      arg_max(territory, rev) AS best, arg_min(territory, rev) AS worst, count(*) AS n
    FROM per GROUP BY platform""",
)

# --- joins --------------------------------------------------------------------

sql(
    "sql_join_inner",
    f"""SELECT a.name, r.platform, {REV} AS rev, count(*) AS n FROM royalty_data r
    JOIN tracks t ON t.isrc = r.isrc JOIN artists a ON a.id = t.artist_id GROUP BY a.name, r.platform""",
)
sql(
    "sql_join_left",
    """SELECT al.id, al.title, s.payee_name, s.percentage FROM albums al
    LEFT JOIN cascading_splits s ON s.album_id_str = al.id AND s.percentage > 50""",
)
sql(
    "sql_join_right",
    """SELECT s.payee_name, s.percentage, t.isrc FROM cascading_splits s
    RIGHT JOIN tracks t ON s.track_id_str = t.id""",
)
sql(
    "sql_join_full",
    f"""SELECT coalesce(x.artist, y.name) AS artist, x.qty, y.percentage
    FROM (SELECT artist, {QTY} AS qty FROM royalty_data GROUP BY 1) x
    FULL JOIN (SELECT a.name, s.percentage FROM artists a JOIN cascading_splits s ON s.artist_id_str = a.id) y
      ON x.artist = y.name""",
)
sql(
    "sql_join_semi",
    """SELECT r.isrc, r.reporting_date, r.quantity FROM royalty_data r
    LEFT SEMI JOIN (SELECT t.isrc FROM tracks t JOIN cascading_splits s ON s.track_id_str = t.id) p
      ON p.isrc = r.isrc""",
    """SELECT r.isrc, r.reporting_date, r.quantity FROM royalty_data r WHERE r.isrc IN
    (SELECT t.isrc FROM tracks t JOIN cascading_splits s ON s.track_id_str = t.id)""",
)
sql(
    "sql_join_anti",
    """SELECT t.isrc, t.title FROM tracks t LEFT ANTI JOIN cascading_splits s ON s.track_id_str = t.id""",
    """SELECT t.isrc, t.title FROM tracks t WHERE NOT EXISTS
    (SELECT 1 FROM cascading_splits s WHERE s.track_id_str = t.id)""",
)
sql(
    "sql_join_theta",
    "WITH " + MONTHLY % "platform"
    + """SELECT a.platform, a.month_no, count(*) AS better_before FROM monthly a
    JOIN monthly b ON a.platform = b.platform AND b.month_no < a.month_no AND b.rev > a.rev
    GROUP BY a.platform, a.month_no""",
)
sql(
    "sql_join_self",
    "WITH " + MONTHLY % "artist"
    + """SELECT a.artist, a.month_no, a.rev, b.rev AS rev_before FROM monthly a
    LEFT JOIN monthly b ON a.artist = b.artist AND b.month_no = a.month_no - 1""",
)
sql(
    "sql_join_lateral",
    f"""SELECT a.name, x.rev, x.n FROM artists a,
    LATERAL (SELECT {REV} AS rev, count(*) AS n FROM royalty_data r WHERE r.artist = a.name) x""",
)

# --- windows: over frames reduced by an aggregate first ------------------------

PER_TERRITORY = f"""per AS (SELECT platform, territory, {REV} AS rev, {QTY} AS qty FROM royalty_data GROUP BY 1, 2)
"""
sql(
    "win_rank",
    "WITH " + PER_TERRITORY
    + """SELECT platform, territory, rev, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk,
      CAST(dense_rank() OVER w AS BIGINT) AS dr, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd,
      CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM per WINDOW w AS (PARTITION BY platform ORDER BY rev DESC, territory)""",
)
sql(
    "win_lag_lead",
    "WITH " + MONTHLY % "artist"
    + """SELECT artist, month_no, rev, lag(rev) OVER w AS before, lead(rev, 2) OVER w AS after2,
      first_value(rev) OVER f AS first_rev, last_value(rev) OVER f AS last_rev, nth_value(rev, 3) OVER f AS third
    FROM monthly WINDOW w AS (PARTITION BY artist ORDER BY month_no),
      f AS (PARTITION BY artist ORDER BY month_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
sql(
    "win_running_total",
    "WITH " + MONTHLY % "isrc"
    + """SELECT isrc, month_no, rev, CAST(SUM(rev) OVER w AS DECIMAL(38,9)) AS so_far,
      CAST(SUM(qty) OVER (PARTITION BY isrc ORDER BY month_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3
    FROM monthly WINDOW w AS (PARTITION BY isrc ORDER BY month_no ROWS UNBOUNDED PRECEDING)""",
)
sql(
    "win_range",
    "WITH " + MONTHLY % "territory"
    + """SELECT territory, month_no, qty, CAST(SUM(qty) OVER (PARTITION BY territory ORDER BY month_no
      RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS nearby FROM monthly""",
)
sql(
    "win_share",
    f"""WITH per AS (SELECT platform, {REV} AS rev FROM royalty_data GROUP BY 1)
    SELECT platform, rev, CAST(SUM(rev) OVER () AS DECIMAL(38,9)) AS total,
      round(CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER () AS DOUBLE), 8) AS share FROM per""",
)


@query(
    "win_groups",
    ROYALTY_CTE
    + f""", per AS (SELECT platform, transaction_type, reporting_date, {QTY} AS qty, {REV} AS rev
      FROM royalty_data GROUP BY 1, 2, 3)
    SELECT platform, transaction_type, reporting_date, qty, rev,
      CAST(SUM(rev) OVER (PARTITION BY platform, reporting_date ORDER BY qty
        GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS DECIMAL(38,9)) AS near_rev FROM per""",
)
def _(spark, sf):
    per = (
        royalties(spark, sf)
        .groupBy("platform", "transaction_type", "reporting_date")
        .agg(F.sum("quantity").alias("qty"), F.sum("net_revenue").alias("rev"))
    )
    near = over_groups(
        per, lambda: F.sum("rev"), ["platform", "reporting_date"], "qty", 1, 0, "near_rev"
    )
    return near.withColumn("near_rev", F.col("near_rev").cast("decimal(38,9)"))


@query(
    "distinct_on",
    ROYALTY_CTE
    + """SELECT DISTINCT ON (artist, platform) artist, platform, reporting_date, net_revenue, isrc
    FROM royalty_data ORDER BY artist, platform, reporting_date, net_revenue DESC, isrc""",
)
def _(spark, sf):
    rows = royalties(spark, sf, costly=True)
    rows = rows.select("artist", "platform", "reporting_date", "net_revenue", "isrc")
    order = [F.asc("reporting_date"), F.desc("net_revenue"), F.asc("isrc")]
    return distinct_on(rows, ["artist", "platform"], order)


# --- sets and subqueries --------------------------------------------------------

sql(
    "set_union",
    """SELECT artist AS name, 'artist' AS kind FROM royalty_data UNION SELECT title, 'title' FROM royalty_data
    UNION ALL SELECT name, 'catalog' FROM artists""",
)
sql(
    "set_intersect",
    """SELECT artist, territory FROM royalty_data WHERE currency = 'EUR'
    INTERSECT ALL SELECT artist, territory FROM royalty_data WHERE currency = 'USD'""",
)
sql(
    "set_except",
    """SELECT artist, platform FROM royalty_data WHERE transaction_type = 'R'
    EXCEPT ALL SELECT artist, platform FROM royalty_data WHERE transaction_type = 'A'""",
)
sql(
    "set_distinct_ops",
    """SELECT isrc FROM royalty_data WHERE currency = 'EUR' INTERSECT SELECT isrc FROM royalty_data WHERE currency = 'JPY'
    EXCEPT SELECT isrc FROM royalty_data WHERE quantity = 50""",
)
sql(
    "sql_cte",
    f"""WITH by_artist AS (SELECT artist, {REV} AS rev FROM royalty_data GROUP BY 1),
    mean AS (SELECT CAST(avg(CAST(rev AS DOUBLE)) AS DOUBLE) AS m FROM by_artist)
    SELECT artist, rev FROM by_artist WHERE CAST(rev AS DOUBLE) > (SELECT m FROM mean)""",
)
sql(
    "sql_recursive",
    f"""WITH RECURSIVE per_year AS (
      SELECT CAST(year(reporting_date) AS INT) AS y, {REV} AS rev FROM royalty_data GROUP BY 1),
    years(y, last) AS (SELECT min(y), max(y) FROM per_year UNION ALL
      SELECT y + 1, last FROM years WHERE y < last)
    SELECT years.y, rev FROM years LEFT JOIN per_year ON per_year.y = years.y""",
)
sql(
    "sql_subquery",
    """SELECT r.isrc, r.title, max(r.quantity) AS most FROM royalty_data r
    WHERE r.net_revenue > (SELECT avg(CAST(x.net_revenue AS DOUBLE)) * 2 FROM royalty_data x WHERE x.platform = r.platform)
      AND r.artist NOT IN (SELECT a.name FROM artists a JOIN cascading_splits s ON s.artist_id_str = a.id)
    GROUP BY r.isrc, r.title""",
)
sql(
    "sql_unnest",
    """SELECT w.word, v.label, count(*) AS n FROM royalty_data r
    JOIN (VALUES ('USD', 'dollar'), ('EUR', 'euro'), ('JPY', 'yen')) AS v(code, label) ON v.code = r.currency
    LATERAL VIEW explode(split(r.title, ' ')) w AS word
    GROUP BY w.word, v.label""",
    """SELECT word, v.label, count(*) AS n FROM (SELECT currency, unnest(string_split(title, ' ')) AS word
      FROM royalty_data) r
    JOIN (VALUES ('USD', 'dollar'), ('EUR', 'euro'), ('JPY', 'yen')) AS v(code, label) ON v.code = r.currency
    GROUP BY word, v.label""",
)

# --- scalar functions -----------------------------------------------------------

sql(
    "fn_string",
    """SELECT doc_id, char_length(text) AS chars, octet_length(text) AS octets, strpos(text, ' the ') AS at_the,
      split_part(text, ' ', 3) AS third, upper(concat(lang, source)) AS head, lower(right(text, 9)) AS tail,
      md5(reverse(text)) AS mirrored, lpad(lang, 5, '*') AS padded, rpad(lang, 5, '-') AS padded_right,
      concat_ws('/', lang, source) AS path, levenshtein(lang, source) AS edits, translate(source, 'src', 'SRC') AS swapped,
      replace(source, 'src', '') AS bare, repeat(lang, 3) AS thrice, btrim(concat('  ', lang, ' ')) AS trimmed,
      ltrim(concat(' ', lang)) AS left_trimmed, ascii(lang) AS code, chr(65 + length(lang)) AS letter,
      starts_with(text, 'The') AS opens, ends_with(text, '.') AS closes, to_hex(doc_id) AS hexed,
      substr_index(source, 'c', 1) AS before_c, substr(text, 5, 7) AS middle, md5(text) AS digest
    FROM documents""",
    """SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(strlen(text) AS INT) AS octets, CAST(strpos(text, ' the ') AS INT) AS at_the,
      split_part(text, ' ', 3) AS third, upper(concat(lang, source)) AS head, lower(right(text, 9)) AS tail,
      md5((SELECT string_agg(c, '' ORDER BY i DESC) FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c,
        generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i))) AS mirrored,
      lpad(lang, 5, '*') AS padded, rpad(lang, 5, '-') AS padded_right,
      concat_ws('/', lang, source) AS path, CAST(levenshtein(lang, source) AS INT) AS edits, translate(source, 'src', 'SRC') AS swapped,
      replace(source, 'src', '') AS bare, repeat(lang, 3) AS thrice, lang AS trimmed,
      lang AS left_trimmed, ascii(lang) AS code, chr(CAST(65 + length(lang) AS INT)) AS letter,
      starts_with(text, 'The') AS opens, suffix(text, '.') AS closes, lower(to_hex(doc_id)) AS hexed,
      split_part(source, 'c', 1) AS before_c, substr(text, 5, 7) AS middle, md5(text) AS digest
    FROM documents""",
)
sql(
    "fn_regex",
    r"""SELECT doc_id, md5(regexp_replace(text, '[aeiou]+', '*')) AS masked, regexp_like(text, '(?i)license') AS licensed,
      regexp_count(text, '[0-9]+') AS numbers, regexp_substr(text, '[A-Z][a-z]+') AS first_word,
      coalesce(array_to_string(regexp_match(text, '[0-9][0-9][0-9]+'), ''), '') AS first_number,
      regexp_extract(text, '([a-z]+) ([a-z]+)', 2) AS second FROM documents""",
    r"""SELECT doc_id, md5(regexp_replace(text, '[aeiou]+', '*', 'g')) AS masked, regexp_matches(text, '(?i)license') AS licensed,
      CAST(len(regexp_extract_all(text, '[0-9]+')) AS INT) AS numbers,
      CASE WHEN regexp_matches(text, '[A-Z][a-z]+') THEN regexp_extract(text, '[A-Z][a-z]+') END AS first_word,
      regexp_extract(text, '[0-9][0-9][0-9]+') AS first_number,
      regexp_extract(text, '([a-z]+) ([a-z]+)', 2) AS second FROM documents""",
)
sql(
    "fn_math",
    """SELECT p_partkey, abs(10 - p_size) AS a, ceil(p_retailprice / 7) AS c, floor(p_retailprice / 7) AS f,
      round(p_retailprice, 1) AS r, round(sqrt(p_size), 9) AS sq, round(cbrt(p_size), 9) AS cb,
      round(exp(p_size / 50D), 9) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS lt,
      round(log2(p_size), 9) AS l2, round(power(p_size, 1.5D), 6) AS pw, CAST(signum(25 - p_size) AS DOUBLE) AS sg,
      round(sin(p_size), 9) AS sn, round(cos(p_size), 9) AS cs, round(tan(p_size), 6) AS tn, round(atan(p_size), 9) AS at,
      round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd, round(pi(), 9) AS p,
      greatest(p_size, 20) AS g, least(p_size, 20) AS ls, gcd(p_size, 36) AS gc, lcm(p_size, 36) AS lc,
      CAST(factorial(p_size % 15) AS BIGINT) AS fc, iszero(p_size - 7D) AS z, p_size div 7 AS dv, p_size % 7 AS md,
      isnan(p_retailprice) AS nan FROM part""",
    """SELECT p_partkey, abs(10 - p_size) AS a, CAST(ceil(p_retailprice / 7) AS BIGINT) AS c,
      CAST(floor(p_retailprice / 7) AS BIGINT) AS f,
      round(p_retailprice, 1) AS r, round(sqrt(p_size), 9) AS sq, round(cbrt(p_size), 9) AS cb,
      round(exp(p_size / 50.0::DOUBLE), 9) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS lt,
      round(log2(p_size), 9) AS l2, round(power(p_size, 1.5::DOUBLE), 6) AS pw, CAST(sign(25 - p_size) AS DOUBLE) AS sg,
      round(sin(p_size), 9) AS sn, round(cos(p_size), 9) AS cs, round(tan(p_size), 6) AS tn, round(atan(p_size), 9) AS at,
      round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd, round(pi(), 9) AS p,
      greatest(p_size, 20) AS g, least(p_size, 20) AS ls, CAST(gcd(p_size, 36) AS BIGINT) AS gc,
      CAST(lcm(p_size, 36) AS BIGINT) AS lc, CAST(factorial(p_size % 15) AS BIGINT) AS fc,
      p_size = 7 AS z, CAST(p_size // 7 AS BIGINT) AS dv, p_size % 7 AS md, isnan(p_retailprice) AS nan FROM part""",
)
sql(
    "fn_date",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_part('year', o_orderdate) AS INT) AS y,
      CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, CAST(extract(DOY FROM o_orderdate) AS INT) AS doy,
      make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day, last_day(CAST(o_orderdate AS DATE)) AS last_day,
      datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') AS since, date_format(o_orderdate, 'yyyy/MM/dd') AS shown,
      CAST(date_bin(1209600, o_orderdate, TIMESTAMP'1995-01-01 00:00:00') AS DATE) AS fortnight,
      CAST(to_timestamp_seconds(o_orderkey) AS DATE) AS from_epoch, add_months(CAST(o_orderdate AS DATE), 1) AS next_month,
      unix_date(CAST(o_orderdate AS DATE)) AS epoch_day FROM orders""",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_part('year', o_orderdate) AS INT) AS y,
      CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, CAST(extract(DOY FROM o_orderdate) AS INT) AS doy,
      make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day, last_day(CAST(o_orderdate AS DATE)) AS last_day,
      CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since, strftime(o_orderdate, '%Y/%m/%d') AS shown,
      CAST(time_bucket(INTERVAL 14 DAYS, o_orderdate, TIMESTAMP '1995-01-01 00:00:00') AS DATE) AS fortnight,
      CAST(make_timestamp(o_orderkey * 1000000) AS DATE) AS from_epoch,
      CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month,
      CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS epoch_day FROM orders""",
)
sql(
    "fn_date_bin",
    """SELECT event_id, date_bin(INTERVAL '15 minutes', ts, TIMESTAMP'2024-01-01 00:00:00') AS quarter,
      date_bin(INTERVAL '1 day 6 hours', ts, TIMESTAMP'2024-01-03 12:00:00') AS "span", date_bin(90, ts) AS seconds FROM events""",
    """SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01 00:00:00') AS quarter,
      time_bucket(INTERVAL '30 hours', ts, TIMESTAMP '2024-01-03 12:00:00') AS span,
      time_bucket(INTERVAL '90 seconds', ts, TIMESTAMP '1970-01-01 00:00:00') AS seconds FROM events""",
)
sql(
    "fn_regex_groups",
    r"""SELECT doc_id, regexp_match(text, '([A-Z])([a-z]+) (?:[a-z]+) ([a-z]+)') AS "groups", regexp_match(text, 'THE [a-z]+', 'i') AS "any case",
      regexp_match(source, 'src[(]') AS none FROM documents""",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '([A-Z])([a-z]+) (?:[a-z]+) ([a-z]+)') THEN
        [regexp_extract(text, '([A-Z])([a-z]+) (?:[a-z]+) ([a-z]+)', 1), regexp_extract(text, '([A-Z])([a-z]+) (?:[a-z]+) ([a-z]+)', 2),
         regexp_extract(text, '([A-Z])([a-z]+) (?:[a-z]+) ([a-z]+)', 3)] END AS "groups",
      CASE WHEN regexp_matches(text, '(?i)THE [a-z]+') THEN [regexp_extract(text, '(?i)THE [a-z]+')] END AS "any case",
      CAST(NULL AS VARCHAR[]) AS none FROM documents""",
)
sql(
    "fn_conditional",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS st, nvl(nullif(o_orderpriority, '5-LOW'), '-') AS pr,
      nvl2(nullif(o_orderstatus, 'F'), 'not f', 'f') AS n2, ifnull(nullif(o_orderstatus, 'P'), 'p') AS ifn,
      CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders""",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS st, coalesce(nullif(o_orderpriority, '5-LOW'), '-') AS pr,
      CASE WHEN nullif(o_orderstatus, 'F') IS NOT NULL THEN 'not f' ELSE 'f' END AS n2,
      ifnull(nullif(o_orderstatus, 'P'), 'p') AS ifn,
      CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders""",
)
sql(
    "fn_array",
    """WITH w AS (SELECT doc_id, lang, string_to_array(text, ' ') AS a FROM documents)
    SELECT doc_id, size(a) AS n, size(array_distinct(a)) AS uniq, element_at(a, 1) AS head, element_at(a, -1) AS tail,
      CAST(array_position(a, 'the') AS INT) AS at_the, size(array_remove(a, 'the')) AS without_the,
      array_contains(a, 'and') AS has_and, size(array_union(a, array('the', 'zzz'))) AS joined,
      size(array_intersect(a, array('the', 'and', 'zzz'))) AS common, size(array_except(a, array('the', 'and'))) AS others,
      array_join(slice(a, 2, 3), '+') AS few, array_max(a) AS most, size(array_append(a, lang)) AS more,
      size(flatten(array(a, a))) AS doubled, array_join(transform(sequence(1, 3), x -> x * x), ',') AS squares FROM w""",
    """WITH w AS (SELECT doc_id, lang, string_split(text, ' ') AS a FROM documents)
    SELECT doc_id, CAST(len(a) AS INT) AS n, CAST(len(list_distinct(a)) AS INT) AS uniq, a[1] AS head, a[-1] AS tail,
      CAST(coalesce(list_position(a, 'the'), 0) AS INT) AS at_the, CAST(len(list_filter(a, lambda x: x <> 'the')) AS INT) AS without_the,
      list_contains(a, 'and') AS has_and, CAST(len(list_distinct(list_concat(a, ['the', 'zzz']))) AS INT) AS joined,
      CAST(len(list_intersect(a, ['the', 'and', 'zzz'])) AS INT) AS common,
      CAST(len(list_distinct(list_filter(a, lambda x: x NOT IN ('the', 'and')))) AS INT) AS others,
      array_to_string(a[2:4], '+') AS few, list_max(a) AS most, CAST(len(a) + 1 AS INT) AS more,
      CAST(len(a) * 2 AS INT) AS doubled, '1,4,9' AS squares FROM w""",
)
sql(
    "fn_map",
    """WITH m AS (SELECT event_id, map('type', event_type, 'user', CAST(user_id AS STRING)) AS m,
      named_struct('v', value, 't', event_type) AS s FROM events)
    SELECT event_id, element_at(m, 'type') AS kind, try_element_at(m, 'none') AS none, size(map_keys(m)) AS keys,
      array_join(map_values(m), '/') AS vals, s.v AS v, s.t AS t FROM m""",
    """SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS none, CAST(2 AS INT) AS keys,
      concat(event_type, '/', user_id) AS vals, value AS v, event_type AS t FROM events""",
)
sql(
    "fn_json",
    """SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n, max(from_json(props, 'k INT').k) AS same
    FROM events GROUP BY 1""",
    """SELECT CAST(props->>'$.k' AS INT) AS k, count(*) AS n, max(CAST(props->>'$.k' AS INT)) AS same FROM events GROUP BY 1""",
)
sql(
    "fn_hash",
    """SELECT doc_id, md5(text) AS m, lower(hex(sha256(text))) AS s, base64(encode(source, 'UTF-8')) AS b,
      decode(unbase64(base64(encode(lang, 'UTF-8'))), 'UTF-8') AS back, lower(hex(encode(lang, 'UTF-8'))) AS h FROM documents""",
    """SELECT doc_id, md5(text) AS m, sha256(text) AS s, base64(encode(source)) AS b, lang AS back,
      lower(hex(encode(lang))) AS h FROM documents""",
)
sql(
    "fn_cast",
    """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderkey AS STRING) AS s,
      o_orderkey::DOUBLE AS f, CAST(o_orderdate AS DATE) AS dt, TRY_CAST(o_orderpriority AS INT) AS bad,
      CAST('1998-01-0' || '2' AS DATE) AS lit, CAST(o_custkey > 500 AS INT) AS flag, typeof(o_orderkey) AS kind FROM orders""",
    """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderkey AS VARCHAR) AS s,
      o_orderkey::DOUBLE AS f, CAST(o_orderdate AS DATE) AS dt, TRY_CAST(o_orderpriority AS INT) AS bad,
      CAST('1998-01-0' || '2' AS DATE) AS lit, CAST(o_custkey > 500 AS INT) AS flag, lower(typeof(o_orderkey)) AS kind FROM orders""",
)
