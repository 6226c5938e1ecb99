import pytest

from conftest import rows
from contract import frames
from contract.queries import _staged_lake
from ledgerlake.plans.sales import region_index, to_gold, to_silver, unreadable_dates
from ledgerlake.streaming import hops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Three hops, twice, with new files before the second run."""
    root = tmp_path_factory.mktemp("stream")
    lake = _staged_lake(spark, SF)
    sales = frames.sales_raw(spark, SF)
    queries = []
    for part in ("employee_id < 60", "employee_id >= 60"):
        frames.write_events(sales.filter(part), str(root / "events"), 12)
        queries.append(hops.ingest_sales(lake, str(root / "events"), str(root / "ck1"), writers=2))
        hops.refine_sales(lake, str(root / "ck2"), max_files=500, writers=2)
        hops.publish_sales(lake, str(root / "ck3"), max_files=500)
    return lake, root, queries


def test_bronze_holds_every_sale_once(spark, filled):
    lake, _, _ = filled
    sales = frames.sales_raw(spark, SF)
    assert rows(lake.read("brz_sales"), *sales.columns) == rows(sales)


def test_files_per_batch_are_limited(filled):
    _, _, queries = filled
    batches = [p for p in queries[0].recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 2


def test_stream_equals_batch(spark, filled):
    lake, _, _ = filled
    regions = region_index(lake.read("slv_neighborhoods"))
    silver = to_silver(frames.sales_raw(spark, SF), regions)
    assert rows(lake.read("slv_sales"), *silver.columns) == rows(silver)
    gold = to_gold(silver, lake.read("slv_customers"), lake.read("slv_employees"))
    assert rows(lake.read("gld_sales"), *gold.columns) == rows(gold)
    assert gold.count() > 0


def test_another_run_adds_nothing(filled):
    lake, root, _ = filled
    before = [lake.read(t).count() for t in ("brz_sales", "slv_sales", "gld_sales")]
    hops.ingest_sales(lake, str(root / "events"), str(root / "ck1"))
    hops.refine_sales(lake, str(root / "ck2"))
    hops.publish_sales(lake, str(root / "ck3"))
    assert [lake.read(t).count() for t in ("brz_sales", "slv_sales", "gld_sales")] == before


def test_large_dimensions_in_the_stream(spark, filled, no_broadcast):
    """Shuffled and salted stream joins give the same tables as broadcasts."""
    lake, root, _ = filled
    other = _staged_lake(spark, SF)
    hops.ingest_sales(other, str(root / "events"), str(root / "other1"), max_files=100, writers=1)
    hops.refine_sales(other, str(root / "other2"), 500, 1, broadcast_bytes=0, salts=3)
    hops.publish_sales(other, str(root / "other3"), 500, 1, broadcast_bytes=0, salts=3)
    for table in ("slv_sales", "gld_sales"):
        assert rows(other.read(table)) == rows(lake.read(table))


def test_unreadable_dates_do_not_stop_the_job(spark):
    sales = frames.sales_raw(spark, SF).limit(3).selectExpr(
        "* EXCEPT (date)", "CASE WHEN order_id = '0' THEN 'soon' WHEN order_id = '1' THEN '31/02/2024 10:00:00' "
        "WHEN order_id = '2' THEN NULL END AS date")
    assert unreadable_dates(sales).count() == 2


def test_bytes_per_batch_are_limited(spark, tmp_path):
    lake = frames.new_lake(spark)
    frames.write_events(frames.sales_raw(spark, SF), str(tmp_path / "events"), 4)
    query = hops.ingest_sales(lake, str(tmp_path / "events"), str(tmp_path / "ck"), max_bytes=1)
    batches = [p for p in query.recentProgress if p["numInputRows"] > 0]
    # A batch takes at least one file, and no second one beyond the limit.
    assert len(batches) == len(list((tmp_path / "events").glob("*.json"))) > 1
    assert lake.read("brz_sales").count() == frames.sales_raw(spark, SF).count()
