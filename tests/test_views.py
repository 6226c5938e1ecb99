import datetime as dt

import pytest

from conftest import final_plan, rows
from ledgerlake.plans import views
from ledgerlake.sources.shared import materialize

JAN, FEB = dt.date(2024, 1, 5), dt.date(2024, 2, 5)


def sale(date, district, employee, customer, quantity, order="o"):
    month = (date.year, date.month) if date else (None, None)
    return (order, employee, customer, district, quantity, *month, date)


SALES = [
    sale(JAN, "north", "eva", "ana", 5),
    sale(JAN, "north", "eva", "ben", 5),
    sale(JAN, "south", "tom", "ana", 10),
    sale(JAN, "east", "tom", "cid", 1),
    sale(FEB, "north", "tom", "ana", 3),
    sale(FEB, "north", "eva", "ben", None),
    sale(FEB, "west", "eva", "ben", 8, None),
    sale(None, "north", "eva", "ana", 2),
    sale(None, "south", "tom", "ana", 4),
]


@pytest.fixture(scope="module")
def gold(spark):
    schema = ("order_id string, employee string, customer string, district string, "
              "quantity_products int, event_year int, event_month int, event_date date")
    return materialize(spark.createDataFrame(SALES, schema), "gold")


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_sales_by_district(gold):
    found = keyed(views.sales_by_district(gold), "event_date", "district")
    north = found[JAN, "north"]
    assert (north["total_sales_per_day"], north["sales_rank"]) == (2, 1)
    assert north["percent_total_sales_per_day"] == 50.0
    assert north["percent_products_sold_per_day"] == 47.62
    assert found[JAN, "south"]["sales_rank"] == found[JAN, "east"]["sales_rank"] == 2
    # A sale without order id counts as no sale, but its products count.
    assert (found[FEB, "west"]["total_sales_per_day"], found[FEB, "west"]["total_products_sold_per_day"]) == (0, 8)
    assert found[None, "south"]["percent_products_sold_per_day"] == 66.67
    assert len(found) == 7


def test_sales_by_employee_keeps_every_row(gold):
    found = keyed(views.sales_by_employee(gold), "event_date", "employee")
    assert len(found) == 6
    eva, tom = found[JAN, "eva"], found[JAN, "tom"]
    assert (eva["employee_effectiveness"], eva["effectiveness_rank"]) == (500.0, 2)
    assert (tom["employee_effectiveness"], tom["effectiveness_rank"]) == (550.0, 1)
    assert eva["sales_rank"] == tom["sales_rank"] == 1
    assert found[None, "tom"]["percent_products_sold_per_day"] == 66.67


def test_customers_by_district(gold):
    found = keyed(views.customers_by_district(gold), "event_year", "event_month", "district")
    january, february = found[2024, 1, "north"], found[2024, 2, "north"]
    assert (january["total_customers_per_district"], january["total_employees_per_district"]) == (2, 1)
    assert january["difference_in_products_sold_from_last_month"] == 10 - 2
    assert february["difference_in_customers_from_last_month"] == 0
    assert february["difference_in_employees_from_last_month"] == 1
    assert january["employees_per_customer_ratio"] == 2.0
    assert found[2024, 1, "east"]["difference_in_products_sold_from_last_month"] == 0
    assert january["percent_total_customers_per_district"] == 50.0


def test_best_customers_and_employees(gold):
    found = keyed(views.best_customers(gold), "event_year", "event_month", "customer")
    ana, ben = found[2024, 1, "ana"], found[2024, 1, "ben"]
    assert (ana["total_products_bought"], ana["best_customer_rank"]) == (15, 1)
    assert ana["percent_total_products_bought"] == 71.43
    assert ana["difference_in_products_bought_from_last_month"] == 15 - 6
    assert ben["best_customer_rank"] == 2 and ben["difference_in_products_bought_from_last_month"] == 0
    assert found[2024, 2, "ana"]["difference_in_products_bought_from_last_month"] == 3 - 15
    staff = keyed(views.best_employees(gold), "event_year", "event_month", "employee")
    assert staff[2024, 1, "tom"]["best_employee_rank"] == 1
    assert staff[2024, 2, "tom"]["difference_in_products_sold_from_last_month"] == 3 - 11
    assert len(staff) == 6


def test_exact_halves_round_up(spark):
    # 29 of 20000 is 0.145 percent, 1 of 800 is 0.125 percent.
    df = spark.sql(
        "SELECT d AS event_date, district, order_id, q AS quantity_products FROM VALUES "
        "(DATE'2024-01-01', 'a', 'x', 29), (DATE'2024-01-01', 'b', 'x', 19971), "
        "(DATE'2024-01-02', 'a', 'x', 1), (DATE'2024-01-02', 'b', 'x', 799) AS t(d, district, order_id, q)"
    )
    shares = views.sales_by_district(df).filter("district = 'a'")
    assert rows(shares, "percent_products_sold_per_day") == [(0.13,), (0.15,)]


def test_gold_is_scanned_once(gold):
    for view in (views.sales_by_employee, views.best_customers, views.best_employees):
        plan = final_plan(view(gold))
        assert "ReusedExchange" in plan and plan.count("FileScan") == 1


def test_people_are_not_windowed_by_period(gold):
    plan = final_plan(views.best_customers(gold))
    # The ranking window reads the distinct totals, not the customers.
    ranking = plan[plan.index("dense_rank"):]
    assert "partial_sum(products" in ranking


def test_persistent_views(spark, lake, gold):
    columns = lake.schema_of("gld_sales").fieldNames()
    filled = gold.selectExpr(
        "*", "0D AS latitude", "0D AS longitude", "'d' AS partition_date", "1 AS event_hour", "1 AS event_day"
    )
    lake.append("gld_sales", filled.select(*columns))
    names = views.create_views(lake)
    assert len(names) == 5
    assert names == views.create_views(lake)
    stored = spark.table(lake.name("vw_gld_best_customers"))
    assert rows(stored) == rows(views.best_customers(gold))


def test_shuffled_join_back(gold, no_broadcast):
    """Levels too many to broadcast: sort-merge joins on exchanges that can be split."""
    for view in (views.sales_by_employee, views.best_customers):
        joined = view(gold)
        plan = final_plan(joined)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "ReusedExchange" in plan
        # Every person of every period is still there.
        assert joined.count() == 6
