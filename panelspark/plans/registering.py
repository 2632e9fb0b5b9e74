"""How a query is registered: by name, with its oracle where SQL has one."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from panelspark.streaming.jobs import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STORED: dict[tuple[str, str, str], str] = {}

# The domain frames that the driver tables stand for, as SQL for the oracles.
BARS = """px AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS session,
  l_extendedprice / l_quantity AS price, l_quantity AS q, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS k
  FROM lineitem),
bars AS (SELECT ticker, session, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, k) AS close, CAST(sum(q) AS BIGINT) AS volume,
  arg_max(price, k) * CASE WHEN session < DATE '1998-01-01' THEN 0.5 ELSE 1.0 END AS adj
  FROM px GROUP BY ticker, session),
bench AS (SELECT session, avg(price) AS price FROM px GROUP BY session),
cal AS (SELECT session, price, row_number() OVER (ORDER BY session) - 1 AS idx,
  lead(session) OVER (ORDER BY session) AS next_session FROM bench),
panel AS (SELECT b.*, c.idx, c.next_session FROM bars b JOIN cal c USING (session))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def stored(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """A frame that many queries share: written once per application and input, below the shared folder, and read by all
    of them; written anew where the folder has been cleared."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in STORED:
        try:
            return spark.read.parquet(STORED[key])
        except AnalysisException:
            del STORED[key]
    path = work_dir(spark, name)
    build(spark, sf_dir).write.parquet(path)
    STORED[key] = path
    return spark.read.parquet(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a fresh folder and read back: worked out once, and its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
