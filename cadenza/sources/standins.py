"""Stand-in tables: the datasets of the catalogue, derived from the driver's star schema by portable SQL.

Every table is one query that both Spark and DuckDB run, so results can be compared between the two.  Entities are
suppliers, months those of shipment; codes, links and statement items follow from ids and totals by fixed rules.  The
only functions used are common to both dialects, and number literals are doubles (``1e-1``), never decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans.stage import Tables

# Items of annual statements that the catalogue names.
ANNUAL_ITEMS = """aco act ao ap at capx ceq ceqt che cogs csho cshrc dc dlc dlcch dltis dltr dltt dp drc drlt dv dvc dvpa dvt ebitda emp epspx fatb fatl
fincf fopt ib ibcom intan invt ivao ivncf ivst lco lct lo lt mib ni oancf ob oibdp ppegt ppenb ppenls ppent prcc_f prstkc prstkcc pstk pstkl pstkrv rect
revt sale seq sstk tstkp txdi txditc txfed txfo txp txt wcapch xacc xad xad0 xint xpp xrd xsga""".split()
QUARTERLY_ITEMS = "atq capxy cheq cshprq epspiq epspxq ibq niq oancfy revtq saleq txtq xrdq".split()


def _item(k: int, name: str, total: str, count: str, year: str) -> str:
    """A statement item: its own mix of totals, negative in some years for some items, missing now and then."""
    sign = f"CASE WHEN (e * 7 + {year} * 3 + {k}) % 9 = 0 THEN -1e0 ELSE 1e0 END" if name in ("ib", "ni", "ibcom", "oancf", "fopt", "epspx", "wcapch", "ivncf", "fincf", "ibq", "niq", "oancfy", "epspxq", "epspiq") else "1e0"
    size = f"({total} * {(k * 7 % 11) + 1}e-2 + {count} * {k % 5 + 1}e0 * (1 + (e + {year}) % {k % 4 + 3}))"
    return f"CASE WHEN (e * 5 + {year} * 11 + {k}) % 17 = 0 THEN NULL WHEN (e + {year} + {k}) % 23 = 0 THEN 0e0 ELSE {sign} * {size} END AS {name}"


def _month(day: str) -> str:
    return f"CAST(year({day}) * 12 + month({day}) - 1 AS INT)"


_YEAR = "CAST(floor(m / 12) AS INT)"
_LAGGED = "PARTITION BY e ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING"

QUERIES: dict[str, str] = {
    "sales": f"SELECT l_suppkey AS e, {_month('l_shipdate')} AS m, CAST(sum(l_quantity) AS DOUBLE) AS vol, CAST(sum(l_extendedprice) AS DOUBLE) AS val FROM {{lineitem}} WHERE (l_suppkey * 31 + year(l_shipdate) * 12 + month(l_shipdate)) % 29 <> 0 GROUP BY 1, 2",
    "priced": f"SELECT e, m, vol, val, val / vol AS prc, val / vol / max(val / vol) OVER ({_LAGGED}) - 1e0 AS ret FROM {{sales}}",
    "stock_month": f"SELECT p.e, p.m, p.vol, CASE WHEN (p.e + p.m) % 31 = 0 THEN NULL ELSE p.ret END AS ret, CASE WHEN (p.e + p.m) % 37 = 0 THEN -p.prc ELSE p.prc END AS prc, CAST(100 + p.e % 50 + (CASE WHEN {_YEAR.replace('m /', 'p.m /')} % 2 = 0 THEN p.e % 3 ELSE 0 END) AS DOUBLE) AS shrout, CAST(1 + (CASE WHEN p.m > 23988 THEN p.e % 2 ELSE 0 END) AS DOUBLE) AS cfacshr, CAST(CASE WHEN (p.e * 3 + floor(p.m / 18)) % 11 = 0 THEN 4 ELSE 1 + (p.e + (CASE WHEN p.m > 23976 AND p.e % 7 = 0 THEN 1 ELSE 0 END)) % 3 END AS DOUBLE) AS exchcd, CAST(CASE WHEN (p.e * 5 + p.m) % 41 = 0 THEN 14 ELSE 10 + p.e % 3 END AS DOUBLE) AS shrcd, CAST(2000 + s.s_nationkey * 200 + p.e % 4 AS DOUBLE) AS sicCRSP, CASE WHEN (p.e + p.m) % 43 = 0 THEN NULL ELSE p.prc * (100 + p.e % 50) END AS mve_c, p.prc * (110 + p.e % 50) AS mve_permco FROM {{priced}} p JOIN {{supplier}} s ON s.s_suppkey = p.e",
    "years": f"SELECT e, {_YEAR} AS fyear, sum(val) AS total, sum(vol) AS units FROM {{sales}} GROUP BY 1, 2",
    "statement_year": "SELECT e + 1000 AS firm, e, fyear, make_date(fyear, CASE WHEN e % 5 = 0 THEN 6 ELSE 12 END, CASE WHEN e % 5 = 0 THEN 30 ELSE 31 END) AS datadate, CAST((fyear * 12 + CASE WHEN e % 5 = 0 THEN 11 ELSE 17 END) AS INT) AS m, CAST(CAST(2000 + (e % 8) * 200 AS INT) AS VARCHAR(8)) AS sic, " + ", ".join(_item(k, name, "total", "units", "fyear") for k, name in enumerate(ANNUAL_ITEMS)) + " FROM {years}",
    "steps": "SELECT CAST(n AS INT) AS step FROM (VALUES " + ", ".join(f"({n})" for n in range(12)) + ") AS v(n)",
    "statement_month": "SELECT y.firm, y.e, CAST(y.m + s.step AS INT) AS m, y.datadate, y.sic, CAST(CASE WHEN y.e % 3 = 0 THEN NULL ELSE y.sic END AS VARCHAR(8)) AS sich, " + ", ".join(f"y.{c}" for c in ANNUAL_ITEMS) + " FROM {statement_year} y CROSS JOIN {steps} s",
    "quarters": "SELECT e, CAST(floor(m / 3) AS INT) AS q, sum(val) AS total, sum(vol) AS units FROM {sales} GROUP BY 1, 2",
    "quarter_rows": "SELECT e + 1000 AS firm, q, CAST(floor(q / 4) AS INT) AS fyearq, CAST(q % 4 + 1 AS DOUBLE) AS fqtr, make_date(CAST(floor((q * 3 + 2) / 12) AS INT), CAST((q * 3 + 2) % 12 + 1 AS INT), 28) AS datadateq, make_date(CAST(floor((q * 3 + 4) / 12) AS INT), CAST((q * 3 + 4) % 12 + 1 AS INT), CAST(1 + (e * 3 + q) % 27 AS INT)) AS rdq, " + ", ".join(_item(k, name, "total", "units", "q") for k, name in enumerate(QUARTERLY_ITEMS)) + " FROM {quarters}",
    "statement_quarter": "SELECT r.firm, CAST(r.q * 3 + 5 + s.step AS INT) AS m, r.fyearq, r.fqtr, r.datadateq, r.rdq, " + ", ".join(f"r.{c}" for c in QUARTERLY_ITEMS) + " FROM {quarter_rows} r CROSS JOIN {steps} s WHERE s.step < 3",
    "universe": "SELECT e, m, CASE WHEN e % 19 = 0 THEN NULL ELSE e + 1000 END AS firm, CASE WHEN e % 13 = 0 THEN NULL ELSE concat('T', CAST(e - e % 2 AS VARCHAR(12))) END AS ticker, ret, prc, exchcd, shrcd, mve_c AS mve, sicCRSP FROM {stock_month} WHERE shrcd IN (10, 11, 12) AND exchcd IN (1, 2, 3)",
    "horizons": "SELECT fpi, months FROM (VALUES ('0', 60), ('1', 12), ('2', 24), ('6', 3)) AS v(fpi, months)",
    "estimates": "SELECT concat('T', CAST(e - e % 2 AS VARCHAR(12))) AS ticker, m, fpi, make_date(CAST(floor(m / 12) AS INT), CAST(m % 12 + 1 AS INT), 15) AS statpers, CASE WHEN (e + m) % 47 = 0 THEN NULL ELSE make_date(CAST(floor((m - m % 12 + months - 1) / 12) AS INT), 12, 31) END AS fpedats, prc * (1 + (m + months) % 7) * 1e-2 AS meanest, prc * (1 + (m + months) % 5) * 1e-2 AS medest, CAST(1 + (e + m) % 9 AS DOUBLE) AS numest, prc * (1 + m % 3) * 1e-3 AS stdev FROM {priced} CROSS JOIN {horizons} WHERE e % 2 = 0 AND months > 3",
    "estimates_adjusted": "SELECT concat('T', CAST(e - e % 2 AS VARCHAR(12))) AS ticker, m, fpi, make_date(CAST(floor(m / 12) AS INT), CAST(m % 12 + 1 AS INT), 15) AS statpers, make_date(CAST(floor(m / 12) AS INT), CAST(m % 12 + 1 AS INT), CAST(16 + e % 10 AS INT)) AS anndats_act, CASE WHEN (e * m) % 11 = 0 THEN NULL ELSE prc * (1 + m % 6) * 1e-2 END AS actual, prc * (1 + (m + e) % 5) * 1e-2 AS meanest, prc AS price FROM {priced} CROSS JOIN {horizons} WHERE e % 2 = 0 AND months < 13",
    "recommendations": f"SELECT concat('T', CAST(l_suppkey - l_suppkey % 2 AS VARCHAR(12))) AS ticker, l_partkey % 7 AS analyst, CAST(l_shipdate AS DATE) AS day, {_month('l_shipdate')} AS m, CAST(max(1 + (l_partkey + l_linenumber) % 5) AS DOUBLE) AS ireccd FROM {{lineitem}} GROUP BY 1, 2, 3, 4",
    "actuals": "SELECT concat('T', CAST(e - e % 2 AS VARCHAR(12))) AS ticker, m, CASE WHEN m % 13 = 0 THEN 0e0 ELSE prc * (1 + m % 4) * 1e-2 END AS fy0a, prc * (1 + m % 5) * 1e-2 AS int0a FROM {priced} WHERE e % 2 = 0",
    "distributions": f"SELECT l_suppkey AS e, {_month('l_shipdate')} AS m, CAST(l_shipdate AS DATE) AS exdt, CAST(1000 + 200 + (l_suppkey % 7) * 10 + l_linenumber % 5 AS DOUBLE) AS distcd, 1 AS cd1, CAST(CASE WHEN l_linenumber = 1 THEN 2 ELSE 3 END AS INT) AS cd2, CAST(l_suppkey % 7 AS INT) AS cd3, CAST(l_linenumber % 5 AS INT) AS cd4, CAST(sum(l_discount) AS DOUBLE) AS divamt FROM {{lineitem}} WHERE l_linenumber < 3 AND month(l_shipdate) % 3 = l_suppkey % 3 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8",
    "sales_day": f"SELECT l_suppkey AS e, CAST(l_shipdate AS DATE) AS d, {_month('l_shipdate')} AS m, CAST(sum(l_quantity) AS DOUBLE) AS vol, CAST(sum(l_extendedprice) AS DOUBLE) AS val FROM {{lineitem}} GROUP BY 1, 2, 3",
    "stock_day": "SELECT e, d, CASE WHEN (e + m + day(d)) % 11 = 0 THEN 0e0 ELSE vol END AS vol, val / vol AS prc, CASE WHEN (e * 3 + m + day(d)) % 19 = 0 THEN NULL ELSE (val / vol / lag(val / vol) OVER (PARTITION BY e ORDER BY d) - 1e0) * 1e-1 END AS ret, 1e0 AS cfacpr, CAST(100 + e % 50 AS DOUBLE) AS shrout FROM {sales_day}",
    "factors_day": "SELECT d, avg(ret) AS mktrf, avg(CASE WHEN e % 2 = 0 THEN ret ELSE -ret END) AS smb, avg(CASE WHEN e % 3 = 0 THEN ret ELSE 0e0 END) AS hml, 1e-5 AS rf FROM {stock_day} WHERE ret IS NOT NULL GROUP BY d",
    "factors_month": "SELECT m, avg(ret) * 1e-1 AS mktrf, avg(CASE WHEN e % 2 = 0 THEN ret ELSE -ret END) * 1e-1 AS smb, avg(CASE WHEN e % 3 = 0 THEN ret ELSE 0e0 END) * 1e-1 AS hml, 1e-4 AS rf FROM {priced} WHERE ret IS NOT NULL GROUP BY m",
    "market_month": "SELECT m, avg(ret) AS ewretd, sum(ret * val) / sum(val) AS vwretd, sum(val) AS usdval FROM {priced} WHERE ret IS NOT NULL GROUP BY m",
    "liquidity_month": "SELECT m, avg(CASE WHEN e % 5 < 2 THEN ret ELSE -ret END) AS ps_innov FROM {priced} WHERE ret IS NOT NULL GROUP BY m",
    "links": "SELECT e + 1000 AS firm, e, make_date(1994 + CAST(e % 3 AS INT), 1, 1) AS first_day, CASE WHEN e % 4 = 0 THEN make_date(2000, 6, 30) ELSE NULL END AS last_day FROM (SELECT DISTINCT e FROM {sales}) x",
    "industries": "SELECT CAST(n * 250 AS DOUBLE) AS low, CAST(n * 250 + 249 AS DOUBLE) AS high, CAST(n AS INT) AS industry FROM (VALUES " + ", ".join(f"({n})" for n in range(40)) + ") AS v(n)",
}

DRIVER = ("lineitem", "supplier", "orders", "customer", "part", "events")


#: Tables that others are made of, or that most queries read: computed once for a session.
KEPT = ("priced", "stock_month", "statement_year", "statement_quarter", "universe", "stock_day", "factors_day")


class Standins:
    """Tables by name, each built once for a session and folder.

    The tables of ``KEPT`` stand for files that a user would have; they are persisted (a lost executor's parts are
    computed again), so that queries do not each derive them anew.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            made = self._build(name)
            self._made[name] = made.persist() if name in KEPT else made
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in DRIVER:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "liquidity_month":
            from pyspark.sql import functions as F

            return self.spark.sql(QUERIES[name], priced=self("priced")).withColumn("ps_innov_pit", F.col("ps_innov"))
        used = {k: self(k) for k in [*QUERIES, *DRIVER] if "{" + k + "}" in QUERIES[name]}
        return self.spark.sql(QUERIES[name], **used)


_OPEN: dict[tuple[str, str], Standins] = {}


def standins(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Standins(spark, sf_dir)
    return _OPEN[key]


def duckdb_with(*names: str) -> str:
    """The WITH list that defines these tables, and what they are made of, in DuckDB (materialised: used several times)."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done or name in DRIVER:
            return
        for k in [*QUERIES, *DRIVER]:
            if "{" + k + "}" in QUERIES[name]:
                need(k)
        done[name] = QUERIES[name].format(**{k: k for k in [*QUERIES, *DRIVER]})

    for n in names:
        need(n)
    return ", ".join(f"{k} AS MATERIALIZED ({q})" for k, q in done.items())
