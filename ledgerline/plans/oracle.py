"""The same views and stages as DuckDB common table expressions; queries build their oracle on top."""

from __future__ import annotations

_AMOUNTS = """
  CAST(sum(net) AS DOUBLE) AS total_revenue,
  CAST(sum(net * (0.7 + 8 * CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS total_expenses,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(c_acctbal AS DECIMAL(8,2))) AS DOUBLE) / 5000 AS net_assets_eoy,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) END AS cash_non_interest_bearing,
  greatest(max(c_acctbal), 0.0) * 40 AS savings_temporary_investments,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN net END) AS DOUBLE) AS contributions_grants,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN net END) AS DOUBLE) AS program_service_revenue,
  CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN net END) AS DOUBLE) AS investment_income,
  CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN net END) AS DOUBLE) AS other_revenue"""
_SHARES = """
  contributions_grants / nullif(total_revenue, 0) AS pct_contributions, program_service_revenue / nullif(total_revenue, 0) AS pct_program_revenue,
  investment_income / nullif(total_revenue, 0) AS pct_investment_income, other_revenue / nullif(total_revenue, 0) AS pct_other_revenue"""
_WHO = """
  CAST(c_custkey AS VARCHAR) AS ein, c_name AS org_name, upper(left(r_name, 2)) AS state,
  CASE WHEN c_custkey % 17 <> 0 THEN left(c_mktsegment, 1) END AS ntee_major_category, '990' AS return_type"""

CTES: dict[str, str] = {
    "lines": """SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "panel": f"""SELECT *, {_SHARES} FROM (SELECT {_WHO}, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
      CAST(max(o_orderdate) AS DATE) AS tax_period_end, {_AMOUNTS}
      FROM lines GROUP BY c_custkey, c_name, r_name, c_mktsegment, year(o_orderdate))""",
    "filings": f"""SELECT *, {_SHARES} FROM (SELECT o_orderkey AS filing_id, {_WHO}, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
      CAST(o_orderdate AS DATE) AS tax_period_end, {_AMOUNTS}
      FROM lines GROUP BY c_custkey, c_name, r_name, c_mktsegment, o_orderkey, o_orderdate)""",
    "spine": "SELECT *, CAST(NULL AS VARCHAR) AS submitted_on FROM filings WHERE filing_id % 5 <> 0 OR filing_id % 10 = 0",
    "feed": """SELECT * REPLACE (CASE WHEN filing_id % 20 = 0 THEN round(total_revenue * 1.01, 2) ELSE total_revenue END AS total_revenue,
      CAST(NULL AS DOUBLE) AS cash_non_interest_bearing), '2002-01-01' AS submitted_on FROM filings WHERE filing_id % 5 = 0""",
    "bucketed": """SELECT *, CASE WHEN total_revenue <= 0 THEN NULL WHEN total_revenue < 500000 THEN '<500K' WHEN total_revenue < 2000000 THEN '500K-2M'
      WHEN total_revenue < 10000000 THEN '2M-10M' WHEN total_revenue >= 10000000 THEN '>10M' END AS size_bucket FROM panel""",
    "metrics": """SELECT *, (total_revenue - total_expenses) / nullif(total_revenue, 0) AS operating_margin,
      net_assets_eoy / nullif(total_expenses / 12, 0) AS operating_runway_proxy_months,
      CASE WHEN coalesce(pct_contributions, pct_program_revenue, pct_investment_income, pct_other_revenue) IS NOT NULL THEN
        1 - (coalesce(pct_contributions, 0) * coalesce(pct_contributions, 0) + coalesce(pct_program_revenue, 0) * coalesce(pct_program_revenue, 0)
        + coalesce(pct_investment_income, 0) * coalesce(pct_investment_income, 0) + coalesce(pct_other_revenue, 0) * coalesce(pct_other_revenue, 0))
      END AS revenue_diversification_index,
      (coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0)) / nullif(total_expenses / 12, 0) AS shock_absorption_months
      FROM bucketed""",
    "eligible": """SELECT *, total_revenue > 0 AND total_expenses IS NOT NULL AND net_assets_eoy IS NOT NULL AND size_bucket IS NOT NULL AS scoring_eligible,
      fiscal_year IN (2000, 2001) AS is_scoring_year FROM metrics""",
}
_USES = {"lines": [], "panel": ["lines"], "filings": ["lines"], "spine": ["filings"], "feed": ["filings"], "bucketed": ["panel"], "metrics": ["bucketed"], "eligible": ["metrics"]}


def add(name: str, sql: str, *uses: str) -> None:
    CTES[name], _USES[name] = sql, list(uses)


def oracle(select: str, *uses: str) -> str:
    """WITH the named views and all they build on, then the select."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in _USES[n]:
            visit(m)
        order.append(n)

    for n in uses:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + select
