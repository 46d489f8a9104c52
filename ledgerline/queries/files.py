"""Sources and sinks (S): the given tables written in each format to the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.plans import testpanel as tp
from ledgerline.plans.reuse import shared_dir
from ledgerline.registry import query
from ledgerline.sources import files


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def s01(spark, d):
    p = place(spark, "csv")
    tp.table(spark, d, "customer").write.option("header", True).csv(p)
    return files.csv(spark, p, ["c_custkey", "c_name"])


@query("s02_multi_file_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def s02(spark, d):
    p = place(spark, "regions")
    n = tp.table(spark, d, "nation")
    for r in (0, 1):  # two regional files
        n.where(F.col("n_regionkey") % 2 == r).write.option("header", True).csv(f"{p}/part{r}")
    return files.csv(spark, f"{p}/part*", ["n_nationkey", "n_name"], ["n_nationkey", "n_name", "n_regionkey"])


@query("s03_parquet_projection", "SELECT o_orderkey, o_totalprice FROM orders")
def s03(spark, d):
    return files.panel(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("s04_format_dispatch", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def s04(spark, d):
    p = place(spark, "dispatch") + ".csv"
    tp.table(spark, d, "supplier").write.option("header", True).csv(p)
    return files.panel(spark, p, ["s_suppkey", "s_name"])


#: Filings of a file, some 400 bytes each.
FILINGS = 50_000


def xml(spark, d) -> str:
    p = place(spark, "xml")
    header = "named_struct('ReturnTypeCd', if(c_custkey % 9 = 0, '990EZ', '990'), 'TaxPeriodEndDt', '1999-12-31', 'Filer', named_struct('EIN', string(c_custkey), 'BusinessName', named_struct('BusinessNameLine1Txt', c_name))) AS ReturnHeader"
    data = "named_struct('IRS990', named_struct('CYTotalRevenueAmt', if(c_custkey % 7 = 0, 'n/a', string(c_acctbal)))) AS ReturnData"
    # a task reads whole XML files, so these are of bounded size, and as many tasks as there are cores write them
    rows = tp.table(spark, d, "customer").repartition(spark.sparkContext.defaultParallelism, "c_custkey").selectExpr(header, data)
    rows.write.format("xml").options(rootTag="Returns", rowTag="Return", maxRecordsPerFile=FILINGS).save(p)
    return p


@query("s05_filing_xml", "SELECT CAST(c_custkey AS VARCHAR) AS ein, c_name AS org_name, 1999 AS fiscal_year, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS total_revenue FROM customer")
def s05(spark, d):
    return files.filings(spark, xml(spark, d)).select("ein", "org_name", "fiscal_year", "total_revenue")


@query("s06_record_accounting", "SELECT CASE WHEN c_custkey % 9 = 0 THEN '990EZ' ELSE '990' END AS return_type, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'malformed', count(DISTINCT c_custkey // 100) FROM customer WHERE c_custkey % 10 = 3")
def s06(spark, d):
    """Well-formed filings, and files whose elements do not close: each is one malformed record."""
    p = xml(spark, d)
    broken = F.concat(F.lit("<Return><ReturnHeader><Filer><EIN>"), F.col("c_custkey").cast("string"), F.lit("</Filer></EIN></ReturnHeader></Return>"))
    rows = tp.table(spark, d, "customer").where("c_custkey % 10 = 3").select(broken.alias("value"), F.floor(F.col("c_custkey") / 100).alias("lot"))
    rows.repartition("lot").write.partitionBy("lot").text(f"{p}-broken")
    return files.accounted(files.filings(spark, p).unionByName(files.filings(spark, f"{p}-broken/*")))


@query("s07_parquet_sink", "SELECT c_custkey, c_nationkey FROM customer")
def s07(spark, d):
    p = place(spark, "parquet")
    files.write_parquet(tp.table(spark, d, "customer"), p, "c_nationkey")
    return files.panel(spark, p, ["c_custkey", "c_nationkey"])


@query("s08_csv_sink", "SELECT r_regionkey, r_name FROM region")
def s08(spark, d):
    p = place(spark, "csvout")
    files.write_csv(tp.table(spark, d, "region"), p)
    return files.csv(spark, p, ["r_regionkey", "r_name"]).withColumn("r_regionkey", F.col("r_regionkey").cast("int"))


@query("s09_json_sink", "SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS nations FROM nation GROUP BY 1")
def s09(spark, d):
    p = place(spark, "json")
    nested = tp.table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    files.write_records(nested, nested.agg(F.count("*").alias("total")), p)
    return spark.read.json(f"{p}/organizations").select(F.col("n_regionkey").alias("region"), F.size("nations").cast("long").alias("nations"))


@query("s10_contract_projection", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(NULL AS DOUBLE) AS score, r_name FROM region")
def s10(spark, d):
    contract = T.StructType([T.StructField("r_regionkey", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("r_name", T.StringType())])
    return files.conform(tp.table(spark, d, "region").withColumn("extra", F.lit(1)), contract)
