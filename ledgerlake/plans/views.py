"""The five analytic views over the gold sales table.

Each view is one SQL text, used both for DataFrames and for persistent catalog
views.  The gold table is aggregated once; everything else works on that much
smaller result.

Views over people (customers, employees) can have very many rows per period, so
no window over a whole period reads them.  They are first reduced to the distinct
values that occur in a period: ranks and totals come from that list and are
joined back.  Distinct positive totals that add up to T number at most about
sqrt(2 T), so even trillions of products per period leave a few million rows per
window.  Employee days use pairs of sales and products; n sales of bounded
quantity leave on the order of n^(2/3) distinct pairs, never more than employees.
Views over districts window directly: a period has one row per district.

The repeated aggregation reads the gold table once, because both uses plan the
same exchange and Spark reuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlake.sources.lake import Lake


def _share(part: str, whole: str) -> str:
    """Percentage with two digits, halves up.

    Spark rounds a double by its shortest decimal text, so exact halves go up as
    they do for decimals, without decimal division per row.
    """
    return f"ROUND(try_divide({part} * 100D, {whole}), 2)"


def _change(value: str, entity: str) -> str:
    """Difference to the entity's previous present month; 0 in its first month."""
    return (
        f"{value} - LAG({value}, 1, {value}) OVER "
        f"(PARTITION BY {entity} ORDER BY event_year, event_month)"
    )


_SALES_BY_DISTRICT = f"""
WITH daily AS (
  {{totals}}
), placed AS (
  SELECT *,
         DENSE_RANK() OVER (PARTITION BY event_date ORDER BY sales DESC) AS sales_rank,
         SUM(sales) OVER (PARTITION BY event_date) AS day_sales,
         SUM(products) OVER (PARTITION BY event_date) AS day_products
  FROM daily
)
SELECT event_date,
       district,
       sales AS total_sales_per_day,
       sales_rank,
       {_share('sales', 'day_sales')} AS percent_total_sales_per_day,
       products AS total_products_sold_per_day,
       {_share('products', 'day_products')} AS percent_products_sold_per_day
FROM placed
"""

_SALES_BY_EMPLOYEE = f"""
WITH daily AS (
  {{totals}}
), level AS (
  SELECT event_date, sales, products,
         SUM(sales) AS level_sales, SUM(products) AS level_products
  FROM daily
  GROUP BY event_date, sales, products
), ranked AS (
  SELECT event_date, sales, products,
         DENSE_RANK() OVER (PARTITION BY event_date
                            ORDER BY try_divide(products, sales) DESC) AS effectiveness_rank,
         DENSE_RANK() OVER (PARTITION BY event_date ORDER BY sales DESC) AS sales_rank,
         SUM(level_sales) OVER (PARTITION BY event_date) AS day_sales,
         SUM(level_products) OVER (PARTITION BY event_date) AS day_products
  FROM level
)
SELECT d.event_date,
       d.employee,
       {_share('d.products', 'd.sales')} AS employee_effectiveness,
       effectiveness_rank,
       d.sales AS total_sales_per_day,
       sales_rank,
       {_share('d.sales', 'day_sales')} AS percent_total_sales_per_day,
       d.products AS total_products_sold_per_day,
       {_share('d.products', 'day_products')} AS percent_products_sold_per_day
FROM daily d JOIN ranked r
  ON d.event_date <=> r.event_date AND d.sales = r.sales AND d.products <=> r.products
"""

_CUSTOMERS_BY_DISTRICT = f"""
WITH monthly AS (
  {{totals}}
), shares AS (
  SELECT *,
         SUM(customers) OVER (PARTITION BY event_year, event_month) AS month_customers,
         SUM(employees) OVER (PARTITION BY event_year, event_month) AS month_employees,
         SUM(products) OVER (PARTITION BY event_year, event_month) AS month_products
  FROM monthly
)
SELECT event_year,
       event_month,
       district,
       customers AS total_customers_per_district,
       {_share('customers', 'month_customers')} AS percent_total_customers_per_district,
       {_change('customers', 'district')} AS difference_in_customers_from_last_month,
       employees AS total_employees_per_district,
       {_share('employees', 'month_employees')} AS percent_total_employees_per_district,
       {_change('employees', 'district')} AS difference_in_employees_from_last_month,
       ROUND(try_divide(customers, employees), 0) AS employees_per_customer_ratio,
       products AS total_products_sold,
       {_share('products', 'month_products')} AS percent_total_products_sold,
       {_change('products', 'district')} AS difference_in_products_sold_from_last_month
FROM shares
"""


def _best(who: str, rank: str, verb: str) -> str:
    """Monthly ranking of customers or employees by products."""
    return f"""
WITH monthly AS (
  {{totals}}
), level AS (
  SELECT event_year, event_month, products, SUM(products) AS level_products
  FROM monthly
  GROUP BY event_year, event_month, products
), ranked AS (
  SELECT event_year, event_month, products,
         DENSE_RANK() OVER (PARTITION BY event_year, event_month ORDER BY products DESC) AS place,
         SUM(level_products) OVER (PARTITION BY event_year, event_month) AS month_products
  FROM level
), compared AS (
  SELECT *, {_change('products', who)} AS difference
  FROM monthly
)
SELECT m.event_year,
       m.event_month,
       m.{who},
       m.products AS total_products_{verb},
       place AS {rank},
       {_share('m.products', 'month_products')} AS percent_total_products_{verb},
       difference AS difference_in_products_{verb}_from_last_month
FROM compared m JOIN ranked r
  ON m.event_year <=> r.event_year AND m.event_month <=> r.event_month
 AND m.products <=> r.products
"""


def _daily(who: str) -> str:
    return (
        f"SELECT event_date, {who}, COUNT(order_id) AS sales, SUM(quantity_products) AS products "
        f"FROM {{gold}} GROUP BY event_date, {who}"
    )


def _monthly(who: str, more: str = "") -> str:
    return (
        f"SELECT event_year, event_month, {who}, {more}SUM(quantity_products) AS products "
        f"FROM {{gold}} GROUP BY event_year, event_month, {who}"
    )


_PEOPLE = "COUNT(DISTINCT customer) AS customers, COUNT(DISTINCT employee) AS employees, "

# The one aggregation of the sales that each view begins with.
TOTALS_SQL = {
    "vw_gld_sales_districts": _daily("district"),
    "vw_gld_sales_employees": _daily("employee"),
    "vw_gld_customers_districts": _monthly("district", _PEOPLE),
    "vw_gld_best_customers": _monthly("customer"),
    "vw_gld_best_employees": _monthly("employee"),
}

# What each view makes of its totals.
VIEW_SQL = {
    "vw_gld_sales_districts": _SALES_BY_DISTRICT,
    "vw_gld_sales_employees": _SALES_BY_EMPLOYEE,
    "vw_gld_customers_districts": _CUSTOMERS_BY_DISTRICT,
    "vw_gld_best_customers": _best("customer", "best_customer_rank", "bought"),
    "vw_gld_best_employees": _best("employee", "best_employee_rank", "sold"),
}


def _over(name: str, gold: DataFrame) -> DataFrame:
    return gold.sparkSession.sql(VIEW_SQL[name].format(totals=TOTALS_SQL[name]), gold=gold)


def sales_by_district(gold: DataFrame) -> DataFrame:
    """Sales and products per day and district, with rank and daily shares."""
    return _over("vw_gld_sales_districts", gold)


def sales_by_employee(gold: DataFrame) -> DataFrame:
    """Sales, products and effectiveness per day and employee, with ranks and shares."""
    return _over("vw_gld_sales_employees", gold)


def customers_by_district(gold: DataFrame) -> DataFrame:
    """Distinct customers and employees per month and district, shares and changes."""
    return _over("vw_gld_customers_districts", gold)


def best_customers(gold: DataFrame) -> DataFrame:
    """Monthly customer ranking by products bought."""
    return _over("vw_gld_best_customers", gold)


def best_employees(gold: DataFrame) -> DataFrame:
    """Monthly employee ranking by products sold."""
    return _over("vw_gld_best_employees", gold)


def create_views(lake: Lake) -> list[str]:
    """Create or replace the persistent views over the lake's gold table."""
    names = []
    for view, text in VIEW_SQL.items():
        name = lake.name(view)
        totals = TOTALS_SQL[view].format(gold=lake.name("gld_sales"))
        lake.spark.sql(f"CREATE OR REPLACE VIEW {name} AS {text.format(totals=totals)}")
        names.append(name)
    return names
