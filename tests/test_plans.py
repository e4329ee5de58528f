from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from pipelinekit.plans import customers as plan
from pipelinekit.plans import markets
from pipelinekit.plans.config import ReformatConfig, load_config
from pipelinekit.plans.reformat import reformat, reformat_then
from pipelinekit.sources import fixture_frame


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(n, 1, float(n)) for n in range(50)]  # a busy customer
    rows += [(100, 2, 2.5), (101, 2, None), (102, 3, 1.25), (103, 9, 7.0), (104, None, 1.0), (None, 3, 1.0)]
    return spark.createDataFrame(rows, "order_id int, customer_id int, amount double")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [(1, "Ann", "Lee", "2020-01-01"), (2, "Bo", None, "bad date"), (3, "Cy", "Fox", "2021-06-01"), (3, "Cy", "Fox", "2021-06-01"),
         (4, "Di", "Ray", None), (None, "No", "Key", None)],
        "customer_id int, first_name string, last_name string, account_open_date string",
    )


AS_OF = datetime.date(2022, 1, 1)


def test_summing_before_the_join_changes_nothing(orders, customers, rows):
    """The chain of single steps, joining first, gives the same."""
    joined = plan.orders_with_customers(orders, customers)
    aged = plan.account_age(joined, F.lit(AS_OF))
    chained = aged.groupBy("customer_id").agg(
        F.count("order_id").alias("orders"), F.sum("amount").alias("amounts"), F.first("account_length_days").alias("account_length_days")
    )
    whole = plan.customer_orders(orders, customers, F.lit(AS_OF))
    assert rows(whole) == rows(chained) == [(1, 50, 1225.0, 731), (2, 2, 2.5, None), (3, 2, 4.5, 214)]

    named = plan.customers_with_orders(customers, orders).groupBy("customer_id").agg(
        F.first("first_name").alias("first_name"), F.first("last_name").alias("last_name"), F.sum("amount").alias("amounts")
    )
    assert rows(plan.customer_totals(customers, orders)) == rows(plan.full_name_totals(named))


def test_customer_totals_in_order(orders, customers):
    got = [tuple(r) for r in plan.customer_totals(customers, orders).collect()]
    assert got == [("Ann Lee", 1225, 1), ("Cy Fox", 5, 3), (None, 3, 2)]


def test_top_customers_is_one_top_k(spark, orders, customers):
    summary = plan.customer_orders(orders, customers)
    top = plan.top_customers(summary, 2)
    assert [r["customer_id"] for r in top.collect()] == [1, 3]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    tied = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, None)], "customer_id int, amounts double")
    assert [r["customer_id"] for r in plan.top_customers(tied).collect()] == [1, 3, 2]


def test_account_age_defaults_to_today(spark):
    df = spark.createDataFrame([("2020-01-01", 1, 1, 1.0)], "account_open_date string, order_id int, customer_id int, amount double")
    expected = spark.sql("select datediff(current_date(), date'2020-01-01')").first()[0]
    assert plan.account_age(df).first()["account_length_days"] == expected


@pytest.fixture(scope="module")
def market_inputs(spark):
    market_rows = spark.createDataFrame([("1",), ("1",), ("2",), (None,), ("77",), ("00000",)], "zip string")
    returns = spark.createDataFrame(
        [
            ("1", "6", "20"), ("1", "1", "80"), ("2", "6", "1"), ("2", "5", "99"), ("3", "6", "50"), ("3", "2", "50"), ("4", "1", "10"),
            ("5", "6", "bad"), ("5", "x", "3"), ("6", "6", "0"), ("00000", "6", "1"), ("99999", "6", "1"), (None, "6", "1"),
        ],
        "zipcode string, agi_stub string, N1 string",
    )
    return market_rows, returns


def test_market_report(market_inputs):
    got = markets.market_report(*market_inputs).first().asDict()
    # 1: market, 20 % high; 2: market, 1 %; 3: 50 %; 4: none high; 5: no number among high,
    # so 0 of 3 and low; 6: no returns at all, so neither high nor low
    assert got == {
        "has_fm_high_income_percent": 50.0, "no_fm_high_income_percent": 25.0, "has_fm_high_income": 1, "has_fm_low_income": 1,
        "no_fm_high_income": 1, "no_fm_low_income": 2, "num_zipcodes": 6,
    }


def test_market_report_of_nothing(market_inputs):
    market_rows, returns = market_inputs
    got = markets.market_report(market_rows, returns.filter("false")).collect()
    assert len(got) == 1 and got[0]["num_zipcodes"] == 0 and got[0]["has_fm_high_income_percent"] is None


def test_unused_columns_are_not_read(spark, tmp_path):
    wide = spark.range(10).select(F.col("id").cast("string").alias("zip"), *[F.lit(i).alias(f"c{i}") for i in range(58)])
    wide.write.parquet(str(tmp_path / "wide"))
    counted = markets.known_zips(spark.read.parquet(str(tmp_path / "wide"))).transform(markets.markets_by_zip)
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<zip:string>" in text and "IsNotNull(zip)" in text


def test_reformat_unit_rows(spark, rows):
    names = ["customer_id", "first_name", "last_name", "phone", "email", "country_code", "account_open_date", "account_flags"]
    schema = {"type": "struct", "fields": [{"name": n, "type": "string"} for n in names]}
    data = {
        "values": [["761-351-2493", "groubeix0@yellowpages.com", "2", "Griz", "Roubeix"]],
        "columns": ["phone", "email", "customer_id", "first_name", "last_name"],
    }
    df = fixture_frame(spark, schema, data)
    out = reformat(df)
    assert out.columns == ["col1", *names]
    assert out.first()["col1"] == "GrizRoubeixstring$$%^&*#@65530true"
    assert rows(out, *data["columns"]) == [tuple(data["values"][0])]
    scripted = reformat_then(df, script=lambda d: d.select("col1"))
    assert scripted.columns == ["col1"]


def test_config_layers():
    assert load_config(ReformatConfig) == ReformatConfig("string$$%^&*#@", 65530, True)
    got = load_config(ReformatConfig, {}, {"c_string": "string_new_value", "c_int": 45, "c_boolean": False}, {"c_int": 7}, None)
    assert got == ReformatConfig("string_new_value", 7, False)
    with pytest.raises(TypeError, match="c_int"):
        load_config(ReformatConfig, {"c_int": True})
    with pytest.raises(KeyError, match="other"):
        load_config(ReformatConfig, {"other": 1})
