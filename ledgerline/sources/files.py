"""Scans and sinks: CSV marts, Parquet, filings in XML, nested JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import blank_to_null, collapsed, joined_name


def csv(spark: SparkSession, path, columns: list[str], header: list[str] | None = None) -> DataFrame:
    """A CSV mart, or several by a glob or list, every column as text; only the wanted columns are parsed."""
    reader = spark.read.option("header", True).option("escape", '"')
    if header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    return reader.csv(path).select(*columns)


def panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet or CSV by the path's ending."""
    df = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The contract's columns in its order: missing ones null, others dropped, types cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file; for reports of bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_records(records: DataFrame, summary: DataFrame, path: str) -> None:
    """Nested records as JSON lines, and beside them their summary."""
    records.write.mode("overwrite").json(f"{path}/organizations")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


#: Where a filing keeps its amounts and counts. Names with a second place fall back on it.
AMOUNTS = {
    "total_revenue": "CYTotalRevenueAmt", "total_expenses": "CYTotalExpensesAmt", "total_assets_eoy": "TotalAssetsEOYAmt", "total_liabilities_eoy": "TotalLiabilitiesEOYAmt", "net_assets_eoy": "NetAssetsOrFundBalancesEOYAmt",
    "net_assets_boy": "NetAssetsOrFundBalancesBOYAmt", "contributions_grants": "CYContributionsGrantsAmt", "program_service_revenue": "CYProgramServiceRevenueAmt", "investment_income": "CYInvestmentIncomeAmt",
    "other_revenue": "CYOtherRevenueAmt", "program_expenses": "TotalFunctionalExpensesGrp.ProgramServicesAmt", "management_general_expenses": "TotalFunctionalExpensesGrp.ManagementAndGeneralAmt",
    "fundraising_expenses": "TotalFunctionalExpensesGrp.FundraisingAmt", "total_functional_expenses": "TotalFunctionalExpensesGrp.TotalAmt", "cash_non_interest_bearing": "CashNonInterestBearingGrp.EOYAmt",
    "savings_temporary_investments": "SavingsAndTempCashInvstGrp.EOYAmt", "perm_restricted_net_assets": "PermanentlyRstrNetAssetsGrp.EOYAmt", "grants_paid": "CYGrantsAndSimilarPaidAmt",
    "compensation_top_officer": "CompCurrentOfcrDirectorsGrp.TotalAmt", "government_grants": "GovernmentGrantsAmt",
}
COUNTS = {"num_employees": "TotalEmployeeCnt", "num_volunteers": "TotalVolunteersCnt", "num_voting_board_members": "VotingMembersGoverningBodyCnt", "formation_year": "FormationYr"}
ALTERNATES = {
    "unrestricted_net_assets": ("NoDonorRestrictionNetAssetsGrp.EOYAmt", "UnrestrictedNetAssetsGrp.EOYAmt"),
    "temp_restricted_net_assets": ("DonorRstrNetAssetsGrp.EOYAmt", "TemporarilyRstrNetAssetsGrp.EOYAmt"),
}
HEADER = (
    "ReturnTypeCd", "TaxPeriodEndDt", "ReturnTs", "Filer.EIN", "Filer.BusinessName.BusinessNameLine1Txt", "Filer.BusinessName.BusinessNameLine2Txt", "Filer.USAddress.StateAbbreviationCd", "Filer.USAddress.CityNm",
    "Filer.ForeignAddress.CountryCd", "Filer.ForeignAddress.CityNm",
)


def _nested(paths) -> T.StructType:
    tree: dict = {}
    for p in paths:
        reduce(lambda d, k: d.setdefault(k, {}), p.split("."), tree)
    build = lambda d: T.StructType([T.StructField(k, build(v) if v else T.StringType()) for k, v in d.items()])
    return build(tree)


def filings(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Return element below path, parsed in tasks, with _corrupt for records that are no XML."""
    body = [*AMOUNTS.values(), *COUNTS.values(), *[p for pair in ALTERNATES.values() for p in pair], "MissionDesc", "ActivityOrMissionDesc"]
    schema = _nested([*[f"ReturnHeader.{h}" for h in HEADER], *[f"ReturnData.IRS990.{b}" for b in body]]).add("_corrupt", T.StringType())
    raw = spark.read.format("xml").options(rowTag="Return", ignoreNamespace="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").schema(schema).load(path)
    h, b = (lambda n: F.col(f"ReturnHeader.{n}")), (lambda n: F.col(f"ReturnData.IRS990.{n}"))
    number = lambda n: b(n).try_cast("double")
    either: dict[str, Column] = {k: F.coalesce(F.nullif(number(x), F.lit(0.0)), number(y)) for k, (x, y) in ALTERNATES.items()}
    return raw.select(
        h("Filer.EIN").alias("ein"),
        joined_name(h("Filer.BusinessName.BusinessNameLine1Txt"), h("Filer.BusinessName.BusinessNameLine2Txt")).alias("org_name"),
        F.coalesce(h("Filer.USAddress.StateAbbreviationCd"), h("Filer.ForeignAddress.CountryCd")).alias("state"),
        F.coalesce(h("Filer.USAddress.CityNm"), h("Filer.ForeignAddress.CityNm")).alias("city"),
        h("TaxPeriodEndDt").try_cast("date").alias("tax_period_end"),
        F.left(h("TaxPeriodEndDt"), F.lit(4)).try_cast("int").alias("fiscal_year"),
        blank_to_null(h("ReturnTypeCd")).alias("return_type"),
        h("ReturnTs").alias("submitted_on"),
        *[number(p).alias(n) for n, p in AMOUNTS.items()],
        *[x.alias(n) for n, x in either.items()],
        *[b(p).try_cast("int").alias(n) for n, p in COUNTS.items()],
        collapsed(F.coalesce(b("MissionDesc"), b("ActivityOrMissionDesc"))).alias("mission_desc"),
        F.col("_metadata.file_name").alias("source_file"),
        "_corrupt",
    )


def accounted(rows: DataFrame) -> DataFrame:
    """return_type, n: how many filings of each type were read; malformed ones under their own heading."""
    kind = F.when(F.col("_corrupt").isNotNull() | F.col("ein").isNull(), "malformed").otherwise(F.coalesce("return_type", F.lit("unknown")))
    return rows.groupBy(kind.alias("return_type")).agg(F.count("*").alias("n"))
